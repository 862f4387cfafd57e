"""Registered queries of group H, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.operators import retrieval as op
from emberwatch.plans.fixtures import Tables, with_views


def full_corpus(t: Tables) -> DataFrame:
    return t.past.withColumn("text", F.concat_ws(" ", "description", "root_cause"))


def bm25(t: Tables, k: int | None = 10) -> DataFrame:
    return op.bm25_topk(t.kbq, full_corpus(t), k=k).withColumnRenamed("incident_id", "item_id")


def all_vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    q = t.vec.select("tenant_id", F.col("vec_id").alias("query_id"), "embedding")
    return q, t.vec.select("tenant_id", F.col("vec_id").alias("item_id"), "embedding")


def fused(t: Tables) -> DataFrame:
    """Whole lists, every rank."""
    return op.rrf(bm25(t, None), op.vector_topk(t.qvec, t.kbvec, k=None))


def hybrid(t: Tables) -> DataFrame:
    return op.hybrid_search(t.kbq, op.corpus_recent(t.past), t.qvec, t.kbvec)


def _ranks(df: DataFrame) -> list:
    return [F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "vector_rank")]


QUERIES = {
    "corpus_recent": lambda t: op.corpus_recent(t.past).select("tenant_id", "incident_id", F.sha2("text", 256).alias("text_hash")),
    "bm25_topk": lambda t: bm25(t).select("tenant_id", "query_id", "item_id", "score", "rank"),
    "bm25_topk_floor": lambda t: op.bm25_topk(t.kbq, full_corpus(t), idf="floor")
        .select("tenant_id", "query_id", "incident_id", "score", "rank"),
    "bm25_topk_epsilon": lambda t: op.bm25_topk(t.kbq, full_corpus(t), idf="epsilon")
        .select("tenant_id", "query_id", "incident_id", "score", "rank"),
    "vector_topk": lambda t: op.vector_topk(*all_vectors(t)).select("tenant_id", "query_id", "item_id", "similarity", "rank"),
    "vector_topk_ann": lambda t: op.vector_topk_ann(*all_vectors(t)).select(
        "tenant_id", "query_id", "item_id", "similarity", "rank"),
    "rrf": lambda t: (lambda f: f.select("tenant_id", "query_id", "item_id", *_ranks(f), F.round("rrf_score", 9).alias("rrf_score")))(fused(t)),
    "rerank_topk": lambda t: op.fused_topk(t.kbq, full_corpus(t), t.qvec, t.kbvec).select("tenant_id", "query_id", "item_id", "score", "final_rank"),
    "hybrid_search": lambda t: hybrid(t).select(
        "tenant_id", "query_id", F.coalesce("item_id", F.lit("-")).alias("item_id"),
        F.coalesce("final_rank", F.lit(0)).alias("final_rank"), "novel"),
}

_COS = "round(list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[])), 6)"


def _bm25(corpus: str, idf: str = "raw") -> str:
    raw = "ln((n_docs - df + 0.5) / (df + 0.5))"
    idf_sql = {"floor": f"greatest({raw}, 0)", "epsilon": f"CASE WHEN {raw} < 0 THEN 0.25e0 * mean_idf ELSE {raw} END"}.get(idf, raw)
    return f"""corpus AS ({corpus}),
  toks AS (
    SELECT tenant_id, incident_id, created_at,
           list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS t FROM corpus),
  totals AS (SELECT tenant_id, count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks GROUP BY 1),
  post AS (
    SELECT tenant_id, incident_id, created_at, len, term, count(*) AS tf
    FROM (SELECT tenant_id, incident_id, created_at, len(t) AS len, unnest(t) AS term FROM toks) GROUP BY ALL),
  dfs AS (SELECT tenant_id, term, count(*) AS df FROM post GROUP BY ALL),
  means AS (SELECT tenant_id, avg({raw}) AS mean_idf FROM dfs JOIN totals USING (tenant_id) GROUP BY 1),
  qs AS (
    SELECT tenant_id, query_id, term, count(*) AS qtf
    FROM (SELECT tenant_id, query_id,
                 unnest(list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '')) AS term FROM kbq_v) GROUP BY ALL),
  scores AS (
    SELECT q.tenant_id, q.query_id, p.incident_id AS item_id, p.created_at,
           round(sum(q.qtf * {idf_sql} * p.tf * 2.5e0 / (p.tf + 1.5e0 * (0.25e0 + 0.75e0 * p.len / t.avg_len))), 6) AS score
    FROM qs q JOIN post p ON p.tenant_id = q.tenant_id AND p.term = q.term
    JOIN dfs d ON d.tenant_id = q.tenant_id AND d.term = q.term JOIN totals t ON t.tenant_id = q.tenant_id
    JOIN means m ON m.tenant_id = q.tenant_id GROUP BY ALL),
  words AS (
    SELECT tenant_id, query_id, item_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, item_id DESC) AS rank
    FROM scores WHERE score > 0)"""


_FULL = "SELECT tenant_id, incident_id, created_at, description || ' ' || root_cause AS text FROM past_v"
_NEAR = f"""near AS (
    SELECT q.tenant_id, q.query_id, v.item_id, {_COS.format('q.embedding', 'v.embedding')} AS similarity
    FROM qvec_v q JOIN kbvec_v v ON v.tenant_id = q.tenant_id),
  near_ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM near),
  fused AS (
    SELECT tenant_id, query_id, item_id, w.rank AS bm25_rank, n.rank AS vector_rank,
           coalesce(1e0 / (60 + w.rank), 0) + coalesce(1e0 / (60 + n.rank), 0) AS rrf_score
    FROM words w FULL JOIN near_ranks n USING (tenant_id, query_id, item_id)),
  top3 AS (
    SELECT tenant_id, query_id, item_id, round(rrf_score, 9) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, item_id) AS final_rank
    FROM fused QUALIFY final_rank <= 3)"""

ORACLES = {
    "corpus_recent": f"WITH c AS ({_FULL}) SELECT tenant_id, incident_id, sha256(text) AS text_hash FROM c",
    "bm25_topk": f"WITH {_bm25(_FULL)} SELECT * FROM words WHERE rank <= 10",
    "bm25_topk_floor": f"WITH {_bm25(_FULL, 'floor')} SELECT tenant_id, query_id, item_id AS incident_id, score, rank FROM words WHERE rank <= 10",
    "bm25_topk_epsilon": f"WITH {_bm25(_FULL, 'epsilon')} SELECT tenant_id, query_id, item_id AS incident_id, score, rank FROM words WHERE rank <= 10",
    "vector_topk": f"""SELECT q.tenant_id, q.vec_id AS query_id, v.vec_id AS item_id,
             {_COS.format('q.embedding', 'v.embedding')} AS similarity,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, v.vec_id) AS rank
      FROM vec_v q JOIN vec_v v ON v.tenant_id = q.tenant_id QUALIFY rank <= 10""",
    "rrf": f"""WITH {_bm25(_FULL)}, {_NEAR} SELECT tenant_id, query_id, item_id, coalesce(bm25_rank, 0) AS bm25_rank,
        coalesce(vector_rank, 0) AS vector_rank, round(rrf_score, 9) AS rrf_score FROM fused""",
    "rerank_topk": f"WITH {_bm25(_FULL)}, {_NEAR} SELECT * FROM top3",
    "hybrid_search": f"""WITH {_bm25(_FULL)}, {_NEAR} SELECT k.tenant_id, k.query_id, coalesce(t.item_id, '-') AS item_id,
        coalesce(t.final_rank, 0) AS final_rank, t.item_id IS NULL AS novel
      FROM kbq_v k LEFT JOIN top3 t ON t.query_id = k.query_id""",
}
ORACLES = {name: with_views(sql) for name, sql in ORACLES.items()}
