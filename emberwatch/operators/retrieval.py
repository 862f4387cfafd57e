"""Hybrid retrieval over past incidents: BM25, vector top-k, rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.scoring import signed_cosine
from emberwatch.operators.bm25 import WHOLE, best_first, bm25_index
from emberwatch.operators.ordered import newest
from emberwatch.operators.vectors import (
    blocked_scores, byte_codes, cell_centres, cells_of, code_shortlist, in_cells, nearest_exact, probes_for, sampled, shelves, vector_ranks,
)
from emberwatch.session import saved


def corpus_recent(past: DataFrame, *, k: int | None = None) -> DataFrame:
    """Incidents with their search text: all, or the newest ``k`` of each tenant."""
    return (newest(past, ["tenant_id"], [F.desc("created_at"), F.desc("incident_id")], k).drop("_rank")
            .withColumn("text", F.concat_ws(" ", "description", "root_cause")))


def bm25_topk(queries: DataFrame, corpus: DataFrame, *, k: int | None = 10, k1: float = 1.5, b: float = 0.75,
              idf: str = "raw", decimals: int = 6, block_docs: int = 64, whole: int = WHOLE) -> DataFrame:
    """Top ``k`` documents per query by Okapi BM25, each tenant's corpus on its own; all of positive score without ``k``.

    Queries: query_id, tenant_id, query. Corpus: incident_id, tenant_id, created_at, text. Tokens are
    lower-case whitespace words; a repeated query word counts repeatedly. IDF is
    ``ln((N - df + 0.5) / (df + 0.5))``, negative for words in most documents; ``idf="floor"``
    replaces negative values by 0, ``idf="epsilon"`` by a quarter of the mean IDF of the tenant's words.
    Ranks are taken over all documents, then rows with score <= 0 drop out (they rank behind every
    positive one). Ties: newer document first. Posting blocks that cannot reach the k-th score are not read (``bm25.py``).
    """
    index = bm25_index(queries, corpus, k1=k1, b=b, idf=idf, decimals=decimals, block_docs=block_docs)
    return (index.every() if k is None else index.top(k, whole)[0]).drop("at")


def vector_topk(queries: DataFrame, vectors: DataFrame, *, k: int | None = 10, block_rows: int = 4096, cell_rows: int = 2048) -> DataFrame:
    """Exact cosine top ``k`` per query inside the tenant, by cells that can hold it; all similarities without ``k``."""
    if k is None:
        return blocked_scores(queries, vectors, ["tenant_id"], k=None, block_rows=block_rows)
    return nearest_exact(queries, vectors, ["tenant_id"], k=k, block_rows=block_rows, cell_rows=cell_rows)


def vector_topk_ann(queries: DataFrame, vectors: DataFrame, *, k: int = 10, cells: int | None = None, probes: int | None = None,
                    sample: int = 20_000, refine: int = 4, recall: float = 0.95, block_rows: int = 4096, shelf_rows: int = 16_384) -> DataFrame:
    """Approximate top ``k``: codes of one byte per dimension are scanned around the nearest cells, and the ``refine * k``
    nearest codes of a query are scored again with the whole vectors.

    There are about as many cells as the square root of all vectors (4,096 at most); every vector lies in one. Centres come
    from a sample of at most ``sample`` vectors. How many cells a query probes is measured on that sample: as many as hold
    the share ``recall`` of true neighbours. Clustered vectors need a few, vectors without structure most of them; whole
    vectors are compared for ``refine * k`` pairs per query in both cases. Near cells share a shelf of about ``shelf_rows``
    vectors of a tenant. A query is sent to the shelves of its cells and scans them whole, so it costs a row per shelf and not
    one per cell.
    """
    n = vectors.count()
    if not n:
        return blocked_scores(queries, vectors, ["tenant_id"], k=k, block_rows=block_rows)
    m = sampled(vectors, sample)
    centres = cell_centres(m, cells or min(4096, max(1, round(n ** 0.5))))
    probes = probes or probes_for(m, centres, k, recall)
    shelf = shelves(centres, cells_of(vectors, ["tenant_id"], shelf_rows))
    q = saved(in_cells(queries.select("tenant_id", "query_id", "embedding", byte_codes("embedding").alias("code")), centres, probes, shelf)
              .drop("embedding"), "query-codes")
    v = saved(in_cells(vectors.select("tenant_id", "item_id", "embedding", byte_codes("embedding").alias("code")), centres, 1, shelf)
              .drop("embedding"), "vector-codes")
    short = code_shortlist(q, v, ["tenant_id", "_shelf"], short=refine * k, block_rows=block_rows, shelf_rows=shelf_rows)
    pairs = (short.join(queries.select("tenant_id", "query_id", F.col("embedding").alias("_q")), ["tenant_id", "query_id"])
             .select("tenant_id", "query_id", "_q", F.explode("items.item_id").alias("item_id"))
             .join(vectors.select("tenant_id", "item_id", F.col("embedding").alias("_v")), ["tenant_id", "item_id"]))
    scored = pairs.select("tenant_id", "query_id", "item_id", F.round(signed_cosine(F.col("_q"), F.col("_v")), 6).alias("similarity"))
    return newest(scored, ["tenant_id", "query_id"], [F.desc("similarity"), "item_id"], k, rank="rank")


def rrf(*ranked: DataFrame, k: int = 60, names: tuple[str, ...] = ("bm25", "vector")) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (tenant_id, query_id, item_id, rank); keeps both ranks."""
    lists = [r.select("tenant_id", "query_id", "item_id", F.col("rank").cast("int").alias("rank"), F.lit(i).alias("_src"))
             for i, r in enumerate(ranked)]
    union = reduce(DataFrame.unionByName, lists)
    per_source = [F.min(F.when(F.col("_src") == i, F.col("rank"))).alias(f"{n}_rank") for i, n in enumerate(names)]
    return (union.groupBy("tenant_id", "query_id", "item_id").agg(*per_source)
            .withColumn("rrf_score", fused_score([f"{n}_rank" for n in names], k)))


def fused_score(ranks: Iterable[str], k: int) -> Column:
    return sum((F.coalesce(F.lit(1.0) / (F.col(r) + k), F.lit(0.0)) for r in ranks), F.lit(0.0))


def rerank_topk(fused: DataFrame, scores: DataFrame | None = None, *, k: int = 3, decimals: int = 9) -> DataFrame:
    """Top ``k`` by external score where given, else by fused score; ties by item id."""
    value = F.col("rrf_score")
    if scores is not None:
        fused = fused.join(scores.select("tenant_id", "query_id", "item_id", "rerank_score"),
                           ["tenant_id", "query_id", "item_id"], "left")
        value = F.coalesce("rerank_score", value)
    scored = fused.withColumn("score", F.round(value, decimals))
    return newest(scored, ["tenant_id", "query_id"], [F.desc("score"), "item_id"], k, rank="final_rank")


def proven_depth(k: int, rrf_k: int = 60) -> int:
    """Depth of two lists beyond which no document reaches the fused top ``k``.

    If a list has k documents, the k-th fused score is 1 / (rrf_k + k) at least; a document below depth d in both has at
    most 2 / (rrf_k + d + 1), which is less from d = rrf_k + 2 k on. Lists of fewer documents are read whole.
    """
    return rrf_k + 2 * k


def fused_topk(queries: DataFrame, corpus: DataFrame, query_vectors: DataFrame, vectors: DataFrame, *, k: int = 3, rrf_k: int = 60,
               decimals: int = 9, slack: float = 1e-8) -> DataFrame:
    """The rows of ``rerank_topk(rrf(words, near))`` over the whole BM25 and vector lists, without the lists.

    Both lists are read to the proven depth, so all documents that can win are known. One that stands in one list only has
    its rank in the other between there and infinity; if that interval decides anything, the rank is counted, for these
    pairs alone.
    """
    depth, query = proven_depth(k, rrf_k), ["tenant_id", "query_id"]
    index = bm25_index(queries, corpus)
    near = saved(vector_topk(query_vectors, vectors, k=depth), "fused-near")
    scanned = saved(index.scan(depth, near.withColumnRenamed("item_id", "incident_id")), "fused-words")
    words = newest(scanned, query, best_first(), depth, rank="rank").withColumnRenamed("incident_id", "item_id")
    fused = saved(rrf(words, near, k=rrf_k), "fused")
    # A list that ends before the depth has no further ranks.
    names = ("bm25_rank", "vector_rank")
    ends = fused.groupBy(*query).agg(*(F.coalesce(F.max(n), F.lit(0)).alias(f"_{n}") for n in names))
    maybe = {n: F.col(n).isNull() & (F.col(f"_{n}") >= depth) for n in names}
    gain = sum((F.when(c, F.lit(1.0) / (rrf_k + depth + 1)).otherwise(0.0) for c in maybe.values()), F.lit(0.0))
    kth = newest(fused, query, [F.desc("rrf_score")], k).where(F.col("_rank") == k).select(*query, F.col("rrf_score").alias("_kth"))
    left = saved(fused.join(ends, query).withColumns({"_upper": F.col("rrf_score") + gain, **{f"_open_{n}": c for n, c in maybe.items()}})
                 .join(kth, query, "left").where(F.col("_upper") + slack >= F.coalesce("_kth", F.lit(0.0))), "fused-open")
    asked = left.select(*query, "item_id", *(f"_open_{n}" for n in names))
    own = scanned.join(asked.where(F.col("_open_bm25_rank")).select(*query, F.col("item_id").alias("incident_id")), [*query, "incident_id"], "left_semi")
    word_ranks = index.places(own).select(
        *query, F.col("incident_id").alias("item_id"), F.col("rank").alias("_bm25"))
    near_ranks = vector_ranks(query_vectors, vectors, asked.where(F.col("_open_vector_rank")), ["tenant_id"]).select(
        *query, "item_id", F.col("rank").alias("_vector"))
    both = left.join(word_ranks, [*query, "item_id"], "left").join(near_ranks, [*query, "item_id"], "left")
    ranked = both.select(*query, "item_id", F.coalesce("bm25_rank", "_bm25").alias("bm25_rank"), F.coalesce("vector_rank", "_vector").alias("vector_rank"))
    return rerank_topk(ranked.withColumn("rrf_score", fused_score(names, rrf_k)), k=k, decimals=decimals)


def hybrid_search(queries: DataFrame, corpus: DataFrame, query_vectors: DataFrame, vectors: DataFrame, *, k: int = 3) -> DataFrame:
    """The top ``k`` of fused BM25 and vector ranks over the whole corpus. A query without any result is ``novel``."""
    top = fused_topk(queries, corpus, query_vectors, vectors, k=k)
    return (queries.select("tenant_id", "query_id").join(top, ["tenant_id", "query_id"], "left")
            .withColumn("novel", F.col("item_id").isNull()))
