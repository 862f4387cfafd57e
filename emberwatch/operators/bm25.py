"""BM25 over an inverted index of posting blocks with score bounds.

The postings of a word are cut into blocks of about ``block_docs`` documents of similar length, each with the largest part
that it can add to a score. A query first scores the few blocks of documents whose bounds add up to most; the k-th score
found there is a threshold, and of all other blocks only those are read whose bounds can reach it. Bounds take a negative
weight as 0, so nothing is lost.

Whole lists, ranks and fused search, which leave no block out, score chunks of documents instead: one task holds a chunk's
postings and adds them up per query, so no pair of a query and a posting is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import tokens
from emberwatch.operators.ordered import full_ranks, newest
from emberwatch.session import saved

#: Documents of one length class differ in length by this factor at most.
LENGTH_STEP = 1.2
#: Postings of all queries together that are read without a look at their bounds.
WHOLE = 2_000_000
#: Rounding of scores, and more than all sums differ by.
SLACK = 1e-6


#: Documents and queries of a tenant that one task scores at once.
CHUNK_DOCS, CHUNK_QUERIES = 4096, 256
#: Stands for an unknown time inside a task: it is older than all others.
NEVER = -2**63


def half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    """``round`` as in SQL: half up, by the shortest decimal form."""
    scale = 10.0 ** decimals
    y = x * scale
    out = np.rint(y) / scale
    for i in np.flatnonzero(np.abs(np.abs(y - np.floor(y)) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))
    return out


@dataclass
class Bm25Index:
    """``wanted``: (tenant_id, query_id, term, weight). ``postings``: (tenant_id, term, incident_id, at, len, part) with the
    columns of ``totals``: (tenant_id, n_docs, avg_len, n_queries). ``blocks``: (tenant_id, term, block, top, n, rows), written
    when first used."""

    wanted: DataFrame
    postings: DataFrame
    classes: DataFrame
    totals: DataFrame
    decimals: int
    block_docs: int

    @cached_property
    def blocks(self) -> DataFrame:
        placed = (self.postings.withColumn("class", size_class()).join(self.classes, ["tenant_id", "class"])
                  .withColumn("block", F.shiftleft("class", 40) + F.pmod(F.xxhash64("incident_id"), F.ceil(F.col("_docs") / self.block_docs).cast("long"))))
        return saved(placed.groupBy("tenant_id", "term", "block").agg(
            F.max("part").alias("top"), F.count("*").alias("n"), F.collect_list(F.struct("incident_id", "at", "part")).alias("rows")), "bm25-blocks")

    def _chunks(self, score, schema: str, more: DataFrame | None = None, chunk_docs: int = CHUNK_DOCS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
        """``score(query row, scores, times, ids)`` for every query and chunk of the tenant's documents, as rows of ``schema``.
        ``more``: further columns of a query; queries that it lacks have nulls."""
        query, out = ["tenant_id", "query_id"], [x.split()[0] for x in schema.split(", ")]
        docs, groups = (F.ceil(F.col(n) / size).cast("long") for n, size in (("n_docs", chunk_docs), ("n_queries", chunk_queries)))
        span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        left = self.postings.select(
            "tenant_id", "term", "incident_id", F.coalesce("at", F.lit(NEVER)).alias("at"), F.xxhash64("incident_id", "at").alias("doc"), "part",
            F.pmod(F.xxhash64("incident_id"), docs).alias("_chunk"), span(groups).alias("_qb"))
        asked = self.wanted.groupBy(*query).agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
        if more is not None:
            asked = asked.join(more, query, "left")
        right = asked.join(F.broadcast(self.totals), "tenant_id").select(
            *asked.columns, F.pmod(F.xxhash64("query_id"), groups).alias("_qb"), span(docs).alias("_chunk"))

        def scored(ps: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
            if not len(ps) or not len(qs):
                return pd.DataFrame(columns=out)
            doc, one = np.unique(ps["doc"].to_numpy(), return_index=True)
            ids, times = ps["incident_id"].to_numpy(dtype=object)[one], ps["at"].to_numpy()[one]
            doc = np.searchsorted(doc, ps["doc"].to_numpy())
            term, terms = pd.factorize(ps["term"])
            order = np.argsort(term, kind="stable")
            ends = np.cumsum(np.bincount(term, minlength=len(terms)))
            doc_of, part_of, place, parts = doc[order], ps["part"].to_numpy()[order], {x: i for i, x in enumerate(terms)}, []
            for row in qs.itertuples(index=False):
                sums = np.zeros(len(ids))
                for x, weight in sorted(zip(row.terms, row.weights)):
                    if (i := place.get(x)) is not None:
                        mine = slice(ends[i - 1] if i else 0, ends[i])
                        np.add.at(sums, doc_of[mine], weight * part_of[mine])
                parts.append(score(row, half_up(sums, decimals), times, ids).assign(tenant_id=row.tenant_id, query_id=row.query_id))
            return pd.concat(parts)[out]

        decimals, keys = self.decimals, ["tenant_id", "_chunk", "_qb"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scored, schema)

    def _schema(self) -> str:
        types = dict(self.wanted.dtypes)
        return ", ".join(f"{x} {types[x]}" for x in ("tenant_id", "query_id"))

    def scan(self, k: int | None, also: DataFrame | None = None, **sizes) -> DataFrame:
        """(tenant_id, query_id, incident_id, at, score): of every chunk of documents the ``k`` best with all that tie with the
        last, and those of the pairs ``also``; positive scores only, all of them without ``k``."""
        picked = also is not None

        def best(row, scores: np.ndarray, times: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
            at = np.flatnonzero(scores > 0)
            if k is not None and len(at) > k:
                known = np.isin(ids[at], row.items) if picked and row.items is not None else False
                at = at[(scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]) | known]
            return pd.DataFrame({"incident_id": ids[at], "at": times[at], "score": scores[at]})

        more = also.groupBy("tenant_id", "query_id").agg(F.collect_set("incident_id").alias("items")) if picked else None
        found = self._chunks(best, f"{self._schema()}, incident_id {dict(self.postings.dtypes)['incident_id']}, at long, score double", more, **sizes)
        return found.withColumn("at", F.nullif("at", F.lit(NEVER)))

    def bounds(self, wanted: DataFrame | None = None) -> DataFrame:
        """(tenant_id, query_id, block, bound, n, terms): blocks of documents that can hold a positive score."""
        top = F.greatest("weight", F.lit(0.0)) * F.col("top")
        met = (self.wanted if wanted is None else wanted).join(self.blocks.select("tenant_id", "term", "block", "top", "n"), ["tenant_id", "term"])
        return met.groupBy("tenant_id", "query_id", "block").agg(
            F.sum(top).alias("bound"), F.sum("n").alias("n"), F.collect_list(F.struct("term", "weight")).alias("terms")).where("bound > 0")

    def scored(self, chosen: DataFrame) -> DataFrame:
        """(tenant_id, query_id, incident_id, at, score) of the documents of chosen blocks, positive scores only."""
        each = chosen.select("tenant_id", "query_id", "block", F.inline("terms")).join(
            self.blocks.select("tenant_id", "term", "block", "rows"), ["tenant_id", "term", "block"])
        parts = each.select("tenant_id", "query_id", "weight", F.inline("rows"))
        return (parts.groupBy("tenant_id", "query_id", "incident_id", "at").agg(F.sum(F.col("weight") * F.col("part")).alias("_s"))
                .withColumn("score", F.round("_s", self.decimals)).where("score > 0").drop("_s"))

    def top(self, k: int, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
        """The k best per query with their rank, and the blocks that were read for them. Up to ``whole`` postings are read in
        one pass, as a second one costs more than it spares."""
        bounds = saved(self.bounds(), "bm25-bounds")
        query = ["tenant_id", "query_id"]
        if (bounds.agg(F.sum("n")).first()[0] or 0) <= whole:
            return newest(self.scored(bounds), query, best_first(), k, rank="rank"), bounds
        first = newest(bounds, query, [F.desc("bound"), "block"], k + 4).drop("_rank")
        found = saved(self.scored(first), "bm25-first")
        kth = newest(found, query, [F.desc("score")], k).where(F.col("_rank") == k).select(*query, F.col("score").alias("_kth"))
        rest = (bounds.join(first.select(*query, "block"), [*query, "block"], "left_anti").join(kth, query, "left")
                .where(F.col("bound") + SLACK >= F.coalesce("_kth", F.lit(0.0))).drop("_kth"))
        every = found.unionByName(self.scored(rest))
        return newest(every, query, best_first(), k, rank="rank"), first.unionByName(rest)

    def every(self) -> DataFrame:
        """All positive scores with their rank."""
        return full_ranks(saved(self.scan(None), "bm25-every"), ["tenant_id", "query_id"], best_first(), F.floor(F.col("score") * -64))

    def ranks(self, pairs: DataFrame) -> DataFrame:
        """(tenant_id, query_id, incident_id, rank) of given pairs, those without a positive score left out."""
        query = ["tenant_id", "query_id"]
        own = self.scan(1, pairs).join(pairs.select(*query, "incident_id").distinct(), [*query, "incident_id"], "left_semi")
        return self.places(saved(own, "bm25-asked"))

    def places(self, own: DataFrame, **sizes) -> DataFrame:
        """(tenant_id, query_id, incident_id, rank) of given rows of ``scan``: better documents are counted chunk by chunk, and
        nothing but counts is kept of them."""
        query = ["tenant_id", "query_id"]

        def above(row, scores: np.ndarray, times: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
            asked = [] if row.keys is None else row.keys
            count, ordered = [], np.sort(scores)
            for key in asked:
                tied = np.flatnonzero(scores == key["score"])
                later = [(times[i], ids[i]) > (key["at"], key["incident_id"]) for i in tied]
                count.append(len(scores) - int(np.searchsorted(ordered, key["score"], side="right")) + sum(later))
            return pd.DataFrame({"incident_id": pd.Series([x["incident_id"] for x in asked], dtype=object), "docs": np.array(count, dtype="int64")})

        keys = own.groupBy(*query).agg(F.collect_list(F.struct("score", F.coalesce("at", F.lit(NEVER)).alias("at"), "incident_id")).alias("keys"))
        found = self._chunks(above, f"{self._schema()}, incident_id {dict(own.dtypes)['incident_id']}, docs long", keys, **sizes)
        return found.groupBy(*query, "incident_id").agg((F.sum("docs") + 1).cast("int").alias("rank"))


def size_class() -> Column:
    return F.floor(F.log(LENGTH_STEP, F.col("len") + 1)).cast("long")


def best_first() -> list[Column | str]:
    """Order of a result list: ties go to the newer document."""
    return [F.desc("score"), F.desc("at"), F.desc("incident_id")]


def bm25_index(queries: DataFrame, corpus: DataFrame, *, k1: float = 1.5, b: float = 0.75, idf: str = "raw",
               decimals: int = 6, block_docs: int = 64) -> Bm25Index:
    """Index of the words that occur in some query of the tenant; see ``retrieval.bm25_topk`` for columns and formula.

    Each text is split once: its words that occur in a query, and an empty word that stands for the document, are counted
    and written to the shared folder; sizes, document frequencies and blocks all read that table.
    """
    wanted = (queries.select("tenant_id", "query_id", F.explode(tokens(F.col("query"))).alias("term"))
              .groupBy("tenant_id", "query_id", "term").agg(F.count("*").alias("qtf")))
    vocabulary = wanted.select("tenant_id", "term").unionByName(queries.select("tenant_id", F.lit("").alias("term"))).distinct()
    docs = corpus.select("tenant_id", "incident_id", F.unix_micros("created_at").alias("at"), tokens(F.col("text")).alias("_t"))
    words = docs.select("tenant_id", "incident_id", "at", F.size("_t").alias("len"),
                        F.explode(F.concat(F.array(F.lit("")), "_t")).alias("term"))
    counted = saved(words.join(vocabulary, ["tenant_id", "term"], "left_semi")
                    .groupBy("tenant_id", "term", "incident_id", "at", "len").agg(F.count("*").alias("tf")), "postings")
    asking = queries.groupBy("tenant_id").agg(F.count("*").alias("n_queries"))
    totals = saved(counted.where("term = ''").groupBy("tenant_id").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
                   .join(asking, "tenant_id"), "bm25-totals")
    postings = counted.where("term <> ''")
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = (postings.groupBy("tenant_id", "term").agg(F.count("tf").alias("df")).join(totals, "tenant_id")
             .withColumn("idf", F.greatest(raw, F.lit(0.0)) if idf == "floor" else raw))
    if idf == "epsilon":
        every = docs.select("tenant_id", F.explode(F.array_distinct("_t")).alias("term")).groupBy("tenant_id", "term").agg(
            F.count("*").alias("df")).join(totals, "tenant_id")
        means = every.groupBy("tenant_id").agg(F.avg(raw).alias("_mean"))
        terms = terms.join(means, "tenant_id").withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.col("_mean")).otherwise(F.col("idf")))
    # Blocks hold documents of one length class, so that their bounds differ; a class is cut by hash into equal blocks.
    classes = counted.where("term = ''").groupBy("tenant_id", size_class().alias("class")).agg(F.count("*").alias("_docs"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # One row per tenant: a join by a shuffle would put all postings of a tenant into one task.
    placed = postings.join(F.broadcast(totals), "tenant_id").withColumn("part", part)
    weights = wanted.join(terms, ["tenant_id", "term"]).select("tenant_id", "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    return Bm25Index(weights, placed, classes, totals, decimals, block_docs)
