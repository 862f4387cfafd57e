import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.functions.scoring import cosine
from emberwatch.operators import cache, retrieval, vectors
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def vec_table(spark, n, dim, seed, name, tenants=("t",), extra=None):
    rng = np.random.default_rng(seed)
    data = [(tenants[i % len(tenants)], i, [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]
    return spark.createDataFrame(data, f"tenant_id string, {name} long, embedding array<float>")


def test_cosine_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0]),
                                ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0])], "a array<float>, b array<float>")
    assert rows(df.select(cosine(F.col("a"), F.col("b")))) == [(1.0,), (0.0,), (0.0,), (0.0,)]


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_blocked_scores_equal_brute_force(spark, block_rows):
    q, c = vec_table(spark, 40, 6, 1, "query_id", ("hot", "hot", "hot", "b")), vec_table(spark, 60, 6, 2, "item_id", ("hot", "hot", "hot", "b", "none"))
    got = vectors.blocked_scores(q, c, ["tenant_id"], k=5, block_rows=block_rows)
    have = {}
    for r in got.collect():
        have.setdefault(r.query_id, []).append((r.rank, r.item_id, r.similarity))
    cs = c.collect()
    for r in q.collect():
        v = np.array(r.embedding, dtype=float)
        sims = [(round(float(v @ np.array(x.embedding) / np.linalg.norm(v) / np.linalg.norm(x.embedding)), 6) + 0.0, x.item_id)
                for x in cs if x.tenant_id == r.tenant_id]
        want = sorted(sims, key=lambda s: (-s[0], s[1]))[:5]
        assert [(i + 1, item, sim) for i, (sim, item) in enumerate(want)] == sorted(have[r.query_id])


def test_ann_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    data = [("t", i, [float(x) for x in centres[i % 20] + 0.2 * rng.standard_normal(16)]) for i in range(600)]
    c = spark.createDataFrame(data, "tenant_id string, item_id long, embedding array<float>")
    q = c.where("item_id % 20 < 3").withColumnRenamed("item_id", "query_id")
    exact = set(rows(retrieval.vector_topk(q, c, k=5).select("query_id", "item_id")))
    near = set(rows(retrieval.vector_topk_ann(q, c, k=5, cells=20, probes=4, block_rows=50).select("query_id", "item_id")))
    assert len(exact & near) / len(exact) > 0.9


def test_ann_recall_without_clusters(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        (F.col("label") % 5).cast("string").alias("tenant_id"), F.col("vec_id").alias("item_id"), "embedding")
    q = c.withColumnRenamed("item_id", "query_id")
    exact = set(rows(retrieval.vector_topk(q, c).select("query_id", "item_id")))
    near = retrieval.vector_topk_ann(q, c).select("query_id", "item_id", "rank")
    assert near.groupBy("query_id").count().agg(F.max("count")).first()[0] == 10
    assert len(exact & set(rows(near.select("query_id", "item_id")))) / len(exact) >= 0.9
    assert retrieval.vector_topk_ann(q, c.limit(0)).count() == 0


def test_bm25_formula_ties_and_negative_idf(spark):
    docs = ["red apple pie", "red car", "green pear apple apple", "blue sky over red sea", "grey fox"]
    corpus = spark.createDataFrame([(f"d{i}", "t", i, d) for i, d in enumerate(docs)], "incident_id string, tenant_id string, n int, text string"
                                   ).withColumn("created_at", F.timestamp_seconds(F.col("n") * 60))
    q = spark.createDataFrame([("q1", "t", "Apple apple PIE"), ("q2", "t", "red"), ("q3", "u", "red"), ("q4", "t", "  ")],
                              "query_id string, tenant_id string, query string")
    got = {(r.query_id, r.incident_id): (r.score, r.rank) for r in retrieval.bm25_topk(q, corpus, k=10).collect()}
    n, avg = 5, sum(len(d.split()) for d in docs) / 5

    def score(query, doc):
        total = 0.0
        for term in query.lower().split():
            tf, df = doc.split().count(term), sum(term in d.split() for d in docs)
            if tf:
                total += math.log((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc.split()) / avg))
        return round(total, 6)

    want = {("q1", f"d{i}"): score("Apple apple PIE", d) for i, d in enumerate(docs)}
    assert {k: v[0] for k, v in got.items() if k[0] == "q1"} == {k: v for k, v in want.items() if v > 0}
    assert not [k for k in got if k[0] in ("q2", "q3", "q4")]  # 'red' is in most documents: negative


def test_rrf_and_rerank(spark):
    words = spark.createDataFrame([("t", "q", "a", 1), ("t", "q", "b", 5), ("t", "q", "c", 1)], "tenant_id string, query_id string, item_id string, rank int")
    near = spark.createDataFrame([("t", "q", "a", 1), ("t", "q", "b", 2)], words.schema)
    got = {r.item_id: r for r in retrieval.rrf(words, near).collect()}
    assert [round(got[i].rrf_score, 4) for i in "abc"] == [0.0328, 0.0315, 0.0164]
    assert got["c"].vector_rank is None and got["b"].bm25_rank == 5
    fused = retrieval.rrf(words, near)
    assert [r.item_id for r in retrieval.rerank_topk(fused, k=2).orderBy("final_rank").collect()] == ["a", "b"]
    outside = spark.createDataFrame([("t", "q", "c", 9.0)], "tenant_id string, query_id string, item_id string, rerank_score double")
    assert retrieval.rerank_topk(fused, outside, k=1).first().item_id == "c"


def test_cache_lookup_respects_ttl_and_threshold(spark):
    def t(s):
        return F.timestamp_seconds(F.lit(s))

    entries = spark.createDataFrame([("t", 1, [1.0, 0.0], "r1", 1000), ("t", 2, [1.0, 0.1], "r2", 80000), ("t", 3, [1.0, 0.0], None, 80001),
                                     ("u", 4, [1.0, 0.0], "r4", 80000), ("t", 5, [0.0, 1.0], "r5", 80002)],
                                    "tenant_id string, entry_id long, embedding array<float>, rca_result string, s long")
    entries = entries.withColumn("created_at", F.timestamp_seconds("s")).drop("s")
    queries = spark.createDataFrame([("t", 1, [1.0, 0.0], 87399), ("t", 2, [1.0, 0.0], 87400), ("t", 3, [1.0, 1.0], 90000), ("t", 4, [1.0, 0.0], 500),
                                     ("u", 5, [1.0, 0.0], 80000), ("v", 6, [1.0, 0.0], 80000)],
                                    "tenant_id string, query_id long, embedding array<float>, s long")
    queries = queries.withColumn("asked_at", F.timestamp_seconds("s")).drop("s")
    got = {r.query_id: (r.cache_hit, r.item_id, r.rca_result) for r in cache.cache_lookup(queries, entries).collect()}
    assert got == {1: (True, 1, "r1"), 2: (True, 2, "r2"), 3: (False, None, None), 4: (False, None, None), 5: (True, 4, "r4"), 6: (False, None, None)}
    looked = cache.cache_lookup(queries, entries)
    assert {r.tenant_id: r.keys_stored for r in cache.cache_stats(looked, entries, as_of=F.timestamp_seconds(F.lit(87400))).collect()} == {
        "t": 3, "u": 1, "v": 0}
    stats = {r.tenant_id: r for r in cache.cache_stats(looked, entries).collect()}
    assert (stats["t"].hits, stats["t"].misses, stats["t"].hit_rate, stats["t"].cost_saved_usd) == (2, 2, 0.5, 0.04)
    assert stats["v"].hit_rate == 0.0 and stats["v"].keys_stored == 0


def test_bm25_epsilon_by_hand(spark):
    """Negative IDFs become a quarter of the mean IDF over all words of the tenant, query words or not."""
    texts = ["a b c", "a b", "a d d", "a", "e f"]
    corpus = spark.createDataFrame([("t", str(i), T0 + dt.timedelta(i), x) for i, x in enumerate(texts)],
                                   "tenant_id string, incident_id string, created_at timestamp, text string")
    queries = spark.createDataFrame([("t", "q", "A d d zzz")], "tenant_id string, query_id string, query string")
    docs = [x.split() for x in texts]
    n, mean_len = len(docs), sum(map(len, docs)) / len(docs)
    idf = {w: math.log((n - df + 0.5) / (df + 0.5)) for w in {w for d in docs for w in d} for df in [sum(w in d for d in docs)]}
    low = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: low if x < 0 else x for w, x in idf.items()}
    want = {}
    for i, d in enumerate(docs):
        score = sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean_len)) for w in "a d d zzz".split())
        if round(score, 6) > 0:
            want[str(i)] = round(score, 6)
    got = {r.incident_id: r.score for r in retrieval.bm25_topk(queries, corpus, idf="epsilon").collect()}
    assert got == want and low > 0
