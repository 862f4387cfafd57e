"""Pruned search against whole lists: BM25 blocks, cells of vectors, byte codes, fused ranks."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.operators import anomaly, bm25, retrieval, vectors
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def corpus_of(spark, texts, tenant="t"):
    return spark.createDataFrame([(f"d{i:05d}", tenant, T0 + dt.timedelta(minutes=i), x) for i, x in enumerate(texts)],
                                 "incident_id string, tenant_id string, created_at timestamp, text string")


def queries_of(spark, texts, tenant="t"):
    return spark.createDataFrame([(f"q{i}", tenant, x) for i, x in enumerate(texts)], "query_id string, tenant_id string, query string")


def slow_bm25(queries, texts, k1=1.5, b=0.75):
    """{query number: [document number, best first]} with their scores, over all documents."""
    docs = [Counter(x.lower().split()) for x in texts]
    size = [sum(d.values()) for d in docs]
    mean, df = sum(size) / len(size), Counter(w for d in docs for w in d)
    out = {}
    for n, query in enumerate(queries):
        scores = []
        for i, d in enumerate(docs):
            s = sum(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * (k1 + 1) / (d[w] + k1 * (1 - b + b * size[i] / mean))
                    for w in query.lower().split() if w in d)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), -i))
        out[n] = [(-i, -s) for s, i in sorted(scores)]
    return out


@pytest.mark.parametrize(("block_docs", "whole"), [(1, 0), (7, 0), (64, 0), (64, 10**6)])
def test_bm25_blocks_lose_nothing(spark, block_docs, whole):
    rng = random.Random(block_docs)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(1, 60))) for _ in range(400)]
    asked = ["w0 w1", "w5 w30", "w39", "w0 w0 w38", "w12 w13 w14 w0", "none"]
    want = slow_bm25(asked, texts)
    corpus, queries = corpus_of(spark, texts), queries_of(spark, asked)
    got = defaultdict(list)
    for r in retrieval.bm25_topk(queries, corpus, k=12, block_docs=block_docs, whole=whole).orderBy("query_id", "rank").collect():
        got[int(r.query_id[1:])].append((int(r.incident_id[1:]), r.score))
    for n, full in want.items():
        assert [i for i, _ in got[n]] == [i for i, _ in full[:12]]
        assert [s for _, s in got[n]] == pytest.approx([s for _, s in full[:12]], abs=2e-6)
    index = bm25.bm25_index(queries, corpus, block_docs=block_docs)
    full = {(r.query_id, r.incident_id): r["rank"] for r in index.every().collect()}
    assert full == {(f"q{n}", f"d{i:05d}"): at for n, own in want.items() for at, (i, _) in enumerate(own, 1)}
    pairs = [(f"q{n}", f"d{i:05d}") for n in want for i in rng.sample(range(400), 30)]
    frame = spark.createDataFrame([("t", *p) for p in pairs], "tenant_id string, query_id string, incident_id string")
    ranks = {(r.query_id, r.incident_id): r["rank"] for r in index.ranks(frame).collect()}
    assert ranks == {p: full[p] for p in pairs if p in full}


def test_bm25_chunks_are_scored_where_they_lie(spark):
    """Chunks of few documents and queries give the whole list; rows leave a task per query and document, not per posting."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(12)], k=rng.randint(1, 40))) for _ in range(150)]
    asked = [" ".join(f"w{i}" for i in rng.sample(range(12), 6)) for _ in range(5)] + ["none"]
    want = slow_bm25(asked, texts)
    index = bm25.bm25_index(queries_of(spark, asked), corpus_of(spark, texts))
    small = {"chunk_docs": 16, "chunk_queries": 2}
    pairs = spark.createDataFrame([("t", f"q{n}", f"d{i:05d}") for n in want for i in (3, 77, 149)], "tenant_id string, query_id string, incident_id string")
    found = index.scan(4, pairs, **small).cache()
    got = {(r.query_id, r.incident_id): r.score for r in found.collect()}
    full = {(f"q{n}", f"d{i:05d}"): s for n, own in want.items() for i, s in own}
    assert all(full[p] == pytest.approx(s, abs=2e-6) for p, s in got.items())
    best = {(f"q{n}", f"d{i:05d}") for n, own in want.items() for i, _ in own[:4]}
    assert best | {(r.query_id, r.incident_id) for r in pairs.collect() if (r.query_id, r.incident_id) in full} <= set(got)
    places = {(r.query_id, r.incident_id): r["rank"] for r in index.places(found, **small).collect()}
    assert places == {p: at for n, own in want.items() for at, (i, _) in enumerate(own, 1) if (p := (f"q{n}", f"d{i:05d}")) in got}
    plan = index.scan(None)._jdf.queryExecution().executedPlan().toString()
    assert "weight" not in plan.split("FlatMapCoGroupsInPandas")[0]  # no pair is joined or aggregated behind the tasks


def test_scores_are_rounded_as_in_sql(spark):
    x = [0.0000005, 1.0000005, 2.5, 0.1234565, 1.2345675, 7.9999995, -0.0000005, 3.1415926535, 123.4567895]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert bm25.half_up(np.array(x), 6).tolist() == want


def test_bm25_reads_a_tenth_of_a_common_word(spark):
    """'common' is in a third of the documents, 'rare' in twenty; a tenth of the postings decides."""
    rng = random.Random(9)
    texts = [" ".join(["common"] * (i % 3 == 0) + [f"x{rng.randrange(9000)}" for _ in range(rng.randint(5, 300))]) for i in range(9000)]
    for i in rng.sample(range(0, 9000, 3), 20):
        texts[i] += " rare"
    corpus, queries = corpus_of(spark, texts), queries_of(spark, ["common rare"])
    index = bm25.bm25_index(queries, corpus, block_docs=8)
    top, read = index.top(5, whole=0)
    assert [int(r.incident_id[1:]) for r in top.orderBy("rank").collect()] == [i for i, _ in slow_bm25(["common rare"], texts)[0][:5]]
    postings = index.blocks.agg(F.sum("n")).first()[0]
    assert postings > 2900 and read.agg(F.sum("n")).first()[0] <= postings / 10
    # The common word's postings lie in many blocks, each a key of its own.
    assert index.blocks.where("term = 'common'").count() > 300


def clustered(n, clusters, dim, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    return centres[np.arange(n) % clusters] + spread * rng.standard_normal((n, dim))


def frame_of(spark, m, name, tenant="t"):
    return spark.createDataFrame([(tenant, i, [float(x) for x in v]) for i, v in enumerate(m)], f"tenant_id string, {name} long, embedding array<float>")


def test_pruned_search_is_exact_and_builds_few_pairs(spark):
    m = np.r_[clustered(900, 30, 12, 1), np.zeros((2, 12))]
    c, q = frame_of(spark, m, "item_id"), frame_of(spark, np.r_[m[:90], -m[:3], np.zeros((1, 12))], "query_id")
    got, pairs = vectors.pruned_scores(q, c, ["tenant_id"], k=7, cell_rows=30, block_rows=16)
    plain = vectors.blocked_scores(q, c, ["tenant_id"], k=7)
    columns = ["query_id", "item_id", "similarity", "rank"]
    assert sorted(rows(got.select(columns))) == sorted(rows(plain.select(columns)))
    # Opposite and zero vectors have no cell that could be left out; the others read less than a fifth.
    near = pairs.where("query_id < 90")
    assert near.agg(F.sum("n")).first()[0] <= 90 * len(m) / 5


def test_pruned_search_with_bounds(spark):
    m = clustered(600, 20, 8, 3)
    rng = np.random.default_rng(4)
    far = rng.standard_normal((40, 8))
    c, q = frame_of(spark, m, "item_id"), frame_of(spark, np.r_[m[:60], far], "query_id")
    plain = {r.query_id: (r.item_id, r.similarity) for r in vectors.blocked_scores(q, c, ["tenant_id"], k=1).collect()}
    least = {r.query_id: (r.item_id, r.similarity) for r in vectors.nearest_exact(q, c, ["tenant_id"], k=1, cell_rows=30, least=0.9).collect()}
    assert {i: x for i, x in least.items() if x[1] >= 0.9} == {i: x for i, x in plain.items() if x[1] >= 0.9}
    series = [x.withColumn("service", F.lit("s")) for x in (q, c)]
    novel = {r.query_id: r.similarity for r in anomaly.novel_vs_baseline(*series, threshold=0.7, cell_rows=30).collect()}
    assert novel == {i: s for i, (_, s) in plain.items() if s < 0.7} and novel


def test_ranks_of_given_pairs(spark):
    m = np.round(clustered(300, 10, 3, 5, spread=0.4), 1)  # coarse values: many ties
    c, q = frame_of(spark, m, "item_id"), frame_of(spark, m[:20], "query_id")
    full = {(r.query_id, r.item_id): r["rank"] for r in vectors.blocked_scores(q, c, ["tenant_id"], k=None, block_rows=64).collect()}
    assert len(full) == 20 * 300 and {full[i, j] for i in range(1) for j in range(300)} == set(range(1, 301))
    rng = random.Random(6)
    pairs = [(i, j) for i in range(20) for j in rng.sample(range(320), 15)]
    asked = spark.createDataFrame([("t", *p) for p in pairs], "tenant_id string, query_id long, item_id long")
    for cell_rows in (20, 10_000):
        got = vectors.vector_ranks(q, c, asked, ["tenant_id"], block_rows=50, cell_rows=cell_rows)
        assert {(r.query_id, r.item_id): r["rank"] for r in got.collect()} == {p: full[p] for p in pairs if p[1] < 300}


@pytest.mark.parametrize("n", [1_000, 20_000])
def test_byte_codes_find_neighbours(spark, n):
    """Recall of 0.9 on clustered vectors while whole vectors are compared for a small part of all pairs."""
    m = clustered(n, max(20, n // 100), 24, 7)
    c = frame_of(spark, m, "item_id").repartition(8)
    q = c.where(F.col("item_id") % (n // 50) == 0).withColumnRenamed("item_id", "query_id")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in retrieval.vector_topk_ann(q, c, k=10).collect():
        got[r.query_id].add(r.item_id)
    asked = range(0, n, n // 50)
    hits = sum(len(got[i] & set(np.argsort(-np.round(unit @ unit[i], 6), kind="stable")[:10].tolist())) for i in asked)
    assert hits / (10 * len(asked)) >= 0.9 and 4 * 10 <= n / 10
    sample = vectors.sampled(c, 20_000)
    centres = vectors.cell_centres(sample, round(n ** 0.5))
    assert vectors.probes_for(sample, centres, 10, 0.95) <= len(centres) / 3


def test_queries_meet_few_shelves_of_codes(spark, monkeypatch):
    """Vectors without structure: a query is sent to few shelves, not to most of as many cells as the square root."""
    n = 1500
    m = np.random.default_rng(11).standard_normal((n, 16))
    c, met = frame_of(spark, m, "item_id"), []
    plain = retrieval.code_shortlist

    def seen(q, v, *keys, **how):
        met.append((q.count(), v.count()))
        return plain(q, v, *keys, **how)

    monkeypatch.setattr(retrieval, "code_shortlist", seen)
    got = defaultdict(set)
    for r in retrieval.vector_topk_ann(c.withColumnRenamed("item_id", "query_id"), c, k=10).collect():
        got[r.query_id].add(r.item_id)
    assert met == [(n, n)]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = sum(len(got[i] & set(np.argsort(-np.round(unit @ unit[i], 6), kind="stable")[:10].tolist())) for i in range(0, n, 30))
    assert hits / (10 * len(range(0, n, 30))) >= 0.9
    # Several shelves and several blocks of items in each.
    few = retrieval.vector_topk_ann(c.withColumnRenamed("item_id", "query_id").where("query_id % 30 = 0"), c, k=10, shelf_rows=100, block_rows=64)
    hits = sum(r.item_id in got[r.query_id] for r in few.collect())
    assert met[1][0] <= 50 * 15 and hits / 500 >= 0.9


def slow_fused(texts, asked, doc_vectors, query_vectors, k):
    """Whole lists, fused; documents and vectors share their number."""
    words, out = slow_bm25(asked, texts), []
    unit = [v / np.linalg.norm(v) for v in doc_vectors]
    for n in range(len(asked)):
        score = defaultdict(float)
        for at, (i, _) in enumerate(words[n], 1):
            score[f"d{i:05d}"] += 1 / (60 + at)
        q = query_vectors[n] / np.linalg.norm(query_vectors[n])
        order = sorted(range(len(unit)), key=lambda i: (-round(float(q @ unit[i]), 6), f"d{i:05d}"))
        for at, i in enumerate(order, 1):
            score[f"d{i:05d}"] += 1 / (60 + at)
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:k]
        out += [(f"q{n}", i, round(score[i], 9), at) for at, i in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_fused_topk_equals_whole_lists(spark, k):
    rng = random.Random(k)
    n = 500
    texts = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=rng.randint(3, 30))) for _ in range(n)]
    asked = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=3)) for _ in range(6)] + ["nothing here"]
    gen = np.random.default_rng(k)
    docs, queries = gen.standard_normal((n, 8)), gen.standard_normal((len(asked), 8))
    items = spark.createDataFrame([("t", f"d{i:05d}", [float(x) for x in v]) for i, v in enumerate(docs.astype("float32"))],
                                  "tenant_id string, item_id string, embedding array<float>")
    qvec = spark.createDataFrame([("t", f"q{i}", [float(x) for x in v]) for i, v in enumerate(queries.astype("float32"))],
                                 "tenant_id string, query_id string, embedding array<float>")
    got = retrieval.fused_topk(queries_of(spark, asked), corpus_of(spark, texts), qvec, items, k=k)
    want = slow_fused(texts, asked, docs.astype("float32").astype(float), queries.astype("float32").astype(float), k)
    assert sorted(rows(got.select("query_id", "item_id", "score", "final_rank"))) == sorted(want)


def test_rank_eleven_in_both_lists_wins(spark):
    """Two lists that agree on their eleventh document only: it beats the first of either."""
    n, m = 200, 80
    texts = [("apple " * (200 - i) if i < m else "") + "pear " * 200 for i in range(n)]
    both = 10
    near = [*range(m, m + 10), both, *range(m + 10, n), *(i for i in range(m) if i != both)]
    angle = {i: at / (2 * n) for at, i in enumerate(near)}
    items = spark.createDataFrame([("t", f"d{i:05d}", [math.cos(angle[i]), math.sin(angle[i])]) for i in range(n)],
                                  "tenant_id string, item_id string, embedding array<double>")
    qvec = spark.createDataFrame([("t", "q0", [1.0, 0.0])], "tenant_id string, query_id string, embedding array<double>")
    corpus, queries = corpus_of(spark, texts), queries_of(spark, ["apple"])
    words = slow_bm25(["apple"], texts)[0]
    assert words[10][0] == both
    got = retrieval.hybrid_search(queries, corpus, qvec, items, k=3).where("final_rank = 1").first()
    assert (got.item_id, got.bm25_rank, got.vector_rank) == (f"d{both:05d}", 11, 11)


def test_depth_is_proven():
    for k in (1, 3, 10, 100):
        d = retrieval.proven_depth(k)
        assert 2 / (60 + d + 1) < 1 / (60 + k) and d <= 60 + 2 * k  # whatever the size of the corpus
