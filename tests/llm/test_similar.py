"""The near-duplicate stage by bands and rings: links against all pairs, recall at a given similarity; exact dedup's steps."""

import random
from collections import Counter

import numpy as np
import pytest

from emberwatch.llm import exact_dedup, simhash
from emberwatch.llm.common import components


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_ring_keeps_every_row_within_the_limit():
    """Pigeonring: what is within the limit passes from some start; what passes is within the limit."""
    rng = np.random.default_rng(1)
    apart = rng.integers(0, 40, (5000, 4))
    for limit in (0, 7, 46, 90):
        assert (simhash.ring_passes(apart, limit) == (apart.sum(axis=1) <= limit)).all()


def test_band_forest_joins_what_its_links_join(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    bits = centres[rng.integers(0, 3, 200)]
    for row in bits:
        for b in rng.integers(0, 256, rng.integers(0, 40)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    links = simhash.band_forest(bits, 30)
    assert len(links) < 200

    def classes(pairs):
        label = list(range(200))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    every = [(a, b) for a in range(200) for b in range(a) if int(np.bitwise_count(bits[a] ^ bits[b]).sum()) <= 30]
    assert classes(links) == classes(every) and len(set(classes(every))) > 3


def test_recall_of_similar_texts(spark):
    """Of all pairs with 0.8 or more common five-word shingles at least nine tenths are joined; strangers are not."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, pairs = [], []
    for i in range(260):
        words = rng.choices(vocabulary, k=rng.choice([60, 150, 400, 900]))
        rows.append((2 * i, " ".join(words)))
        share = rng.uniform(0.8, 0.97)
        # Each changed word takes five shingles of both texts.
        changes = max(1, round(len(words) * (1 - share) / (1 + share) / 5 * 1.05))
        for at in rng.sample(range(len(words)), changes):
            words[at] = f"new{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(words)))
        a, b = (shingles(rows[-k][1]) for k in (2, 1))
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * i, len(a & b) / len(a | b)))
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 150 and sum(s < 0.86 for _, s in pairs) > 30
    found = [got[i] == got[i + 1] for i, _ in pairs]
    assert sum(found) / len(found) >= 0.9
    low = [got[i] == got[i + 1] for i, s in pairs if s < 0.86]
    assert sum(low) / len(low) >= 0.85
    assert all(got[2 * i] >= 2 * i for i in range(260))  # no component holds two of the made texts


@pytest.mark.parametrize("block", [2048, 8])
def test_similar_against_all_pairs(spark, nasty, nasty_rows, block):
    rng = random.Random(block)
    base = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"x{i}" for w in base)) for i in range(60)] + [(900 + i, f"other text {i}") for i in range(5)]
    docs = spark.createDataFrame(rows + [(i, t) for i, t, *_ in nasty_rows], "doc_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    made = [simhash.sketch(t, 5) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(made):
        for j, b in enumerate(made[:i]):
            if sum((x ^ y).bit_count() for x, y in zip(a[0], b[0])) <= 46 and any(x == y for x, y in zip(a[1], b[1])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low = {x: min((rows[i][0] for i in range(len(rows)) if label[i] == x and rows[i][0] is not None), default=None) for x in set(label)}
    got = simhash.similar(docs, block=block).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((r[0], low[x]) for r, x in zip(rows, label))
    kept = simhash.drop_similar(nasty, block=block)
    assert kept.columns == nasty.columns and 10 < kept.count() < len(nasty_rows)


def test_similar_of_nothing(nothing):
    assert simhash.similar(nothing).count() == 0 and simhash.drop_similar(nothing).count() == 0


def test_full_hash_takes_only_rows_whose_length_and_prefix_recur(spark):
    """Half of 2,000 texts share length and prefix with another; only they (and rows of an equal fold) reach the hash."""
    rows = [(i, "p" * 200 + f"{i % 50:04d}") for i in range(1000)] + [(1000 + i, f"{i:05d}" + "q" * 300 + "z" * (i % 7)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    close = exact_dedup.close_rows(docs).where("close").count()
    assert 1000 <= close <= 1020
    assert exact_dedup.hashed_rows(docs, "doc_id", "text").count() == close
    assert exact_dedup.drop_exact(docs).count() == 1050
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
