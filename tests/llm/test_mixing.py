"""Mixing: targets against plain water-filling, sums kept by each step, and the whole query."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from emberwatch.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Deal the words by weight; cut what is above its limit and deal the excess again to those below."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest = dict.fromkeys(order, 0.0), float(sum(sizes.values()))
    free = list(order)
    while rest > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in order:
            if target[s] > most * sizes[s] + 1e-12:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
        free = [s for s in free if target[s] < most * sizes[s] - 1e-12]
    return target


def words(n):
    return " ".join(["w"] * n)


def check(rows, docs):
    """What holds for every result; gives the taken words by source."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len((text or "").encode().split())
    aims = slow_targets(sizes)
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((i, len((t or "").encode().split()), s) for i, t, s in docs)
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(aims[r.source], abs=1e-6) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    return aims, taken


@pytest.mark.parametrize("seed", range(4))
def test_flight_keeps_both_sums(seed):
    rng = np.random.default_rng(seed)
    size = np.sort(rng.integers(0, 50 if seed else 3, 400))[::-1]
    p = rng.random(400) if seed % 2 else np.full(400, 0.37)
    out = mixing.settle_three(size, p, rng.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and (out * size).sum() == pytest.approx((p * size).sum(), abs=1e-5)


def test_flight_and_landing_draw_by_chance():
    """Every unit is taken as often as its probability says."""
    size, p = np.array([9, 7, 5, 4, 2, 1, 1, 0]), np.array([0.3, 0.5, 0.2, 0.9, 0.4, 0.5, 0.6, 0.6])
    rng = np.random.default_rng(1)
    flown = np.mean([mixing.settle_three(size, p, rng.random(8)) for _ in range(4000)], axis=0)
    assert np.abs(flown - p).max() < 0.03
    landed = np.mean([mixing.land(size, p, rng.random(8)) for _ in range(4000)], axis=0)
    assert np.abs(landed - p)[:5].max() < 0.15  # the last ones are rounded towards the sum of words


def test_landing_comes_near_the_words():
    rng = np.random.default_rng(2)
    for n in (50, 500):
        size = np.r_[rng.integers(1000, 20_000, n // 10), rng.integers(1, 300, n)]
        p = np.full(len(size), 0.41)
        landed = mixing.land(size, p, rng.random(len(size)))
        out = mixing.polished(size, p, landed)
        assert set(landed) | set(out) <= {0.0, 1.0}
        if n > 50:
            assert abs((landed * size).sum() - (p * size).sum()) <= 300 and abs(landed.sum() - p.sum()) <= 3
        assert abs((out * size).sum() - (p * size).sum()) <= 3


def test_mix_small_sources(spark):
    docs = [(i, words(1 + i * 37 % 90), f"s{i % 7}") for i in range(700)]
    docs += [(1000 + i, words(5), "S") for i in range(4)] + [(2000 + i, words(i), None) for i in range(40)] + [(3000, None, "empty"), (None, "a b", "s1")]
    docs += [(5, "the same row", "s5")] * 3 + [(9000 + i, words(2000), "\U0001f600") for i in range(30)] + [(9500, words(3), "～")]
    frame = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, source string, size int, target double")
    rows = mixing.mix(frame).collect()
    aims, taken = check(rows, docs)
    for source, aim in aims.items():
        assert abs(taken[source] - aim) <= (5 if source in {f"s{i}" for i in range(7)} else 1000), source
    again = mixing.mix(frame.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_in_many_flights(spark, monkeypatch):
    """Buckets far smaller than a source: several turns of flight before the landing."""
    monkeypatch.setattr(mixing, "BUCKET", 60)
    monkeypatch.setattr(mixing, "LANDING", 40)
    monkeypatch.setattr(mixing, "RESERVE", 20)
    docs = [(i, words(1 + i * i % 97), "ab"[i % 3 == 0]) for i in range(4000)] + [(9999, words(3000), "a"), (7, words(8), "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    aims, taken = check(mixing.mix(frame).collect(), docs)
    for source in "ab":
        assert abs(taken[source] - aims[source]) <= 30


def test_one_row_many_times(spark):
    docs = [(None, "a b c", "x")] * 3000 + [(1, words(50), "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    aims, taken = check(mixing.mix(frame).collect(), docs)
    assert abs(taken["x"] - aims["x"]) <= 3


def test_nasty_rows(nasty, nasty_rows, nothing):
    rows = mixing.mix(nasty).collect()
    aims, taken = check(rows, [(i, t, s) for i, t, _, s, *_ in nasty_rows])
    assert mixing.mix(nothing).collect() == []
