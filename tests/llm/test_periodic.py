"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from emberwatch.llm import periodic
from emberwatch.llm.queries import periodic_digest


def slow_runs(words, min_words, min_exponent):
    """For every period the longest stretches that keep it, without those of a smaller period."""
    n, found = len(words), []
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(min_words, min_exponent * p):
                if not any(words[i:i + size - q] == words[i + q:i + size] for q in range(1, p)):
                    found.append((i, size, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None or not words:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last == 0:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def slow_row(doc_id, text):
    words = planted_words(doc_id, text)
    runs = slow_runs(words, 6, 4)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    milli = None if best is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), milli, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("min_words,min_exponent", [(6, 4), (1, 2), (3, 3), (10, 2)])
def test_runs_of_random_documents(min_words, min_exponent):
    rng = random.Random(min_words)
    for _ in range(300):
        documents = []
        for _ in range(rng.randint(1, 4)):
            letters, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 60)
            words = [b"w%d" % rng.randint(0, letters) for _ in range(n)]
            if n > 4 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            documents.append(words)
        assert periodic.runs_of(documents, min_words, min_exponent) == [slow_runs(w, min_words, min_exponent) for w in documents]


def test_long_documents_stay_cheap():
    same, period = [b"a"] * 200_000, [b"%d" % (i % 7) for i in range(200_000)]
    assert periodic.runs_of([same, period]) == [[(0, 200_000, 1)], [(0, 200_000, 7)]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:
        a, b = b, b + a
    assert periodic.runs_of([b]) == [[]]  # Fibonacci words repeat everywhere, but never four times in a row
    assert periodic.runs_of([b[:500]], 1, 2)[0] == slow_runs(b[:500], 1, 2)


def test_query_columns(spark):
    rng = random.Random(5)
    texts = [None, "", "  \t ", "one", "a a a a a a", "a a a\x1ca a a", "x y x y x y x y z z z z z z z"]
    texts += [" ".join(rng.choice(["a", "b", "C", "é"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (7, "twice"), (7, "twice"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "r", [2]) for i, t in rows], "doc_id long, text string, runs int, id string, n array<int>")
    got = [tuple(r) for r in periodic_digest(docs.repartition(4)).collect()]
    assert Counter(got) == Counter(slow_row(i, t) for i, t in rows)
    assert sum(r[1] > 0 for r in got) > 10 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_nasty_rows(nasty, nasty_rows, nothing):
    got = periodic.periodic_runs(nasty).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, *_ in nasty_rows)
    again = next(r for r in got if r.doc_id == 15)
    assert [tuple(x) for x in again.runs] == [(0, 20_000, 1)] and again.text == "again"
    assert periodic_digest(nothing).collect() == [] and periodic_digest(nasty).count() == len(nasty_rows)
    with pytest.raises(ValueError):
        periodic.periodic_runs(nasty, min_exponent=1)
