"""Exact nearest-neighbour scoring in bounded blocks, and cells for approximate search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.scoring import signed_cosine
from emberwatch.operators.ordered import full_ranks, newest
from emberwatch.session import saved


OUT = -2.0  # below every cosine: a pair that does not count


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length 1; a zero vector stays zero, so its similarity is 0."""
    m = np.array(vectors.tolist(), dtype="float64")
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _block_counts(q: DataFrame, c: DataFrame, keys: list[str], block_rows: int, corpus_rows: int | None = None) -> DataFrame:
    """Numbers of blocks of both sides, for keys that both have; those of the corpus may have a size of their own."""
    return (q.groupBy(*keys).agg(F.count("*").alias("_q")).join(c.groupBy(*keys).agg(F.count("*").alias("_c")), keys)
            .select(*keys, F.ceil(F.col("_q") / block_rows).cast("long").alias("nqb"),
                    F.ceil(F.col("_c") / (corpus_rows or block_rows)).cast("long").alias("ncb")))


def _blocks(df: DataFrame, sizes: DataFrame, keys: list[str], id_col: str, mine: str, other: str) -> DataFrame:
    """Assign each row one of ``mine`` blocks and copy it to all ``other`` blocks of its key."""
    return (df.join(sizes, keys)
            .withColumn(mine, F.pmod(F.xxhash64(id_col), F.col(f"n{mine}")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{other}") - 1)))
            .drop(f"n{mine}", f"n{other}"))


def blocked_scores(queries: DataFrame, corpus: DataFrame, keys: list[str], *, k: int | None,
                   block_rows: int = 4096, max_age_us: int | None = None, exclude_self: bool = False,
                   decimals: int = 6, distinct: bool = False, clip: bool = False) -> DataFrame:
    """Top ``k`` corpus rows per query by cosine, among rows with equal ``keys``.

    Queries: keys, ``query_id``, ``embedding`` (and ``at``, microseconds). Corpus: keys, ``item_id``,
    ``embedding`` (and ``at``). Each key is cut into blocks of about ``block_rows`` on both sides, so
    a hot key becomes many equal tasks; a task multiplies two blocks and emits k rows per query, not
    pairs. With ``max_age_us`` an item counts only if ``at_query - max_age < at_item <= at_query``.
    Similarities are rounded before ranking; ties go to the smaller item id. ``clip`` raises negative
    ones to 0, as the cache wants it. Without ``k`` every similarity of a query comes out, ranked.
    """
    timed = max_age_us is not None
    q_cols, c_cols = ["query_id", "embedding"], ["item_id", "embedding"]
    q = queries.select(*keys, *q_cols, *(["at"] if timed else []))
    # Fresh column identities: queries and corpus may come from the same table.
    c = corpus.select(*[F.col(x).alias(x) for x in (*keys, *c_cols, *(["at"] if timed else []))])
    sizes = _block_counts(q, c, keys, block_rows)
    types = dict(queries.dtypes) | {"item_id": dict(corpus.dtypes)["item_id"]}
    key_schema = ", ".join(f"{x} {types[x]}" for x in keys)
    schema = f"{key_schema}, query_id {types['query_id']}, item_id {types['item_id']}, similarity double"
    group = [*keys, "qb", "cb"]

    def score(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "query_id", "item_id", "similarity"]
        if not len(qs) or not len(cs):
            return pd.DataFrame(columns=cols)
        cs = cs.sort_values("item_id", kind="stable").reset_index(drop=True)
        cm, items = unit_rows(cs["embedding"]), cs["item_id"].to_numpy()
        parts = []
        for lo in range(0, len(qs), 1024):
            part = qs.iloc[lo:lo + 1024]
            sim = np.clip(unit_rows(part["embedding"]) @ cm.T, 0.0 if clip else -1.0, 1.0)
            sim = np.round(sim, decimals) + 0.0  # no negative zero
            if timed:
                age = part["at"].to_numpy()[:, None] - cs["at"].to_numpy()[None, :]
                sim[(age < 0) | (age >= max_age_us)] = OUT
            if exclude_self:
                sim[part["query_id"].to_numpy()[:, None] == items[None, :]] = OUT
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(part)), top.shape[1])
            flat = top.ravel()
            out = part[keys].iloc[rows].reset_index(drop=True)
            out["query_id"] = part["query_id"].to_numpy()[rows]
            out["item_id"] = items[flat]
            out["similarity"] = sim[rows, flat]
            parts.append(out[out["similarity"] > OUT])
        return pd.concat(parts)[cols]

    best = (_blocks(q, sizes, keys, "query_id", "qb", "cb").groupBy(*group)
            .cogroup(_blocks(c, sizes, keys, "item_id", "cb", "qb").groupBy(*group))
            .applyInPandas(score, schema))
    if distinct:
        # Under several keys (cells) a query has a list for each: one list of distinct items.
        plain = [x for x in keys if not x.startswith("_")]
        best = best.groupBy(*plain, "query_id", "item_id").agg(F.max("similarity").alias("similarity"))
        keys = plain
    if k is None:
        return full_ranks(best, [*keys, "query_id"], [F.desc("similarity"), "item_id"], F.floor(F.col("similarity") * -1024))
    return newest(best, [*keys, "query_id"], [F.desc("similarity"), "item_id"], k, rank="rank")


def sampled(vectors: DataFrame, sample: int) -> np.ndarray:
    """At most ``sample`` unit vectors, chosen by a hash of the id."""
    rows = vectors.select("embedding", F.xxhash64("item_id").alias("_h")).orderBy("_h").limit(sample).toPandas()
    return unit_rows(rows["embedding"]) if len(rows) else np.zeros((0, 1))


def cell_centres(m: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Cell centres of unit vectors by spherical k-means."""
    centres = m[:min(cells, len(m))].copy()
    for _ in range(rounds if len(m) else 0):
        at = (m @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            mean = m[at == j].sum(axis=0)
            if np.linalg.norm(mean) > 0:
                centres[j] = mean / np.linalg.norm(mean)
    return centres


def in_cells(df: DataFrame, centres: np.ndarray, probes: int, shelf: np.ndarray) -> DataFrame:
    """One row per (row, shelf) that holds one of the ``probes`` nearest cells, as column ``_shelf``; ``shelf`` gives that of a cell."""

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        out, step = [], max(1, 2_000_000 // max(1, len(centres)))
        for lo in range(0, len(vectors), step):
            m = unit_rows(vectors.iloc[lo:lo + step])
            near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes]
            hit = np.zeros((len(m), int(shelf.max()) + 1), dtype=bool)
            hit[np.arange(len(m))[:, None], shelf[near]] = True
            out += [np.flatnonzero(x).astype("int32") for x in hit]
        return pd.Series(out, dtype=object)

    return df.withColumn("_shelf", F.explode(nearest("embedding")))


def shelves(centres: np.ndarray, n: int) -> np.ndarray:
    """Cells put together with near ones: the number of each cell's shelf, below ``n``."""
    return (centres @ cell_centres(centres, n).T).argmax(axis=1)


#: Rounding of similarities, and more than angles computed in two ways differ by.
SLACK = 1e-6


def cell_bounds(corpus: DataFrame, keys: list[str], centres: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The corpus with its ``_cell``, written, and per key its cells with their sizes and angular radii (as many as centres at
    most)."""

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "angle": pd.Series([], dtype=float)})
        m = unit_rows(vectors)
        sims = m @ centres.T
        at = sims.argmax(axis=1)
        return pd.DataFrame({"cell": at.astype("int32"), "angle": np.arccos(np.clip(sims[np.arange(len(m)), at], -1, 1))})

    placed = saved(corpus.withColumn("_at", nearest("embedding")).select(
        *corpus.columns, F.col("_at.cell").alias("_cell"), F.col("_at.angle").alias("_angle")), "vector-cells")
    each = placed.groupBy(*keys, "_cell").agg(F.count("*").alias("n"), F.max("_angle").alias("radius"))
    cells = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_cell").alias("cell"), "n", "radius"))).alias("cells"))
    return placed.drop("_angle"), cells


def routed(queries: DataFrame, cells: DataFrame, keys: list[str], centres: np.ndarray, k: int) -> DataFrame:
    """(keys, query_id, _cell, n, bound, lead): the cells of each query's key with the highest similarity that a vector in
    them can have. A query's leading cells are those of the highest bounds that hold k vectors together."""

    @F.pandas_udf("array<struct<cell:int,n:long,bound:double,lead:boolean>>")
    def route(vectors: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        m = unit_rows(vectors) if len(vectors) else np.zeros((0, centres.shape[1]))
        for row, known in zip(m, own):
            cell = np.array([c["cell"] for c in known])
            n, radius = (np.array([c[x] for c in known]) for x in ("n", "radius"))
            sims = np.clip(centres[cell] @ row, -1, 1)
            # No angle to a vector of the cell is smaller than the angle to its centre less its radius.
            bound = np.cos(np.maximum(0.0, np.arccos(sims) - radius)) if row.any() else np.zeros(len(cell))
            order = np.lexsort((cell, -sims, -bound))
            before = np.cumsum(n[order]) - n[order]
            out.append([{"cell": int(cell[i]), "n": int(n[i]), "bound": float(bound[i]), "lead": bool(b < k)} for i, b in zip(order, before)])
        return pd.Series(out, dtype=object)

    met = queries.select(*keys, "query_id", "embedding").join(cells, keys)
    return met.select(*keys, "query_id", F.inline(route("embedding", "cells"))).withColumnRenamed("cell", "_cell")


def cells_of(corpus: DataFrame, keys: list[str], cell_rows: int) -> int:
    """Number of cells that leaves about ``cell_rows`` vectors of a key in each."""
    rows, groups = corpus.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    return -(-(rows or 0) // max(1, cell_rows * groups))


def pruned_scores(queries: DataFrame, corpus: DataFrame, keys: list[str], *, k: int, block_rows: int = 4096, cell_rows: int = 2048,
                  max_cells: int = 1024, sample: int = 20_000, least: float | None = None, enough: float | None = None,
                  decimals: int = 6) -> tuple[DataFrame, DataFrame | None]:
    """The exact top ``k`` of ``blocked_scores`` where cells keep most blocks apart, and the (query, cell) pairs scored.

    Vectors lie in the cell of their nearest centre (centres from a bounded sample, all vectors placed), and a cell knows its
    largest angle. A query scores its leading cells first; of the others only those follow which, by the triangle
    inequality, can hold a vector as similar as its k-th so far. Rows below ``least`` are not looked for; a query whose k-th
    similarity is ``enough`` needs no second look. Cells have about ``cell_rows`` vectors of a key, so small tables take one
    (then all is scored and the second value is None).
    """
    cells = min(max_cells, cells_of(corpus, keys, cell_rows))
    if cells <= 1:
        return blocked_scores(queries, corpus, keys, k=k, block_rows=block_rows, decimals=decimals), None
    centres = cell_centres(sampled(corpus, sample), cells)
    placed, known = cell_bounds(corpus.select(*keys, "item_id", "embedding"), keys, centres)
    ways = saved(routed(queries, known, keys, centres, k), "vector-ways")
    mine = [*keys, "query_id"]
    asked = queries.select(*mine, "embedding")

    def scores(chosen: DataFrame) -> DataFrame:
        return blocked_scores(asked.join(chosen.select(*mine, "_cell"), mine), placed, [*keys, "_cell"], k=k, block_rows=block_rows,
                              decimals=decimals, distinct=True).drop("rank")

    floor = -1.0 if least is None else least
    lead = ways.where(F.col("lead") & (F.col("bound") + SLACK >= floor))
    found = saved(scores(lead), "vector-lead")
    kth = newest(found, mine, [F.desc("similarity")], k).where(F.col("_rank") == k).select(*mine, F.col("similarity").alias("_kth"))
    rest = ways.where(~F.col("lead")).join(kth, mine, "left").where(
        F.col("bound") + SLACK >= F.greatest(F.lit(floor), F.coalesce("_kth", F.lit(-1.0))))
    if enough is not None:
        rest = rest.where(F.coalesce(F.col("_kth") < enough, F.lit(True)))
    rest = saved(rest.drop("_kth"), "vector-rest")
    best = found.unionByName(scores(rest))
    return newest(best, mine, [F.desc("similarity"), "item_id"], k, rank="rank"), lead.unionByName(rest)


def nearest_exact(queries: DataFrame, corpus: DataFrame, keys: list[str], *, k: int, **how) -> DataFrame:
    return pruned_scores(queries, corpus, keys, k=k, **how)[0]


def probes_for(m: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
    """How many nearest cells hold the share ``recall`` of the true neighbours, measured on the sample itself."""
    q = m[:asked]
    sims = q @ m.T
    sims[np.arange(len(q)), np.arange(len(q))] = OUT
    near = np.argsort(-sims, axis=1, kind="stable")[:, :min(k, max(1, len(m) - 1))]
    at = (m @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    return 1 + int(np.quantile(place[np.arange(len(q))[:, None], at[near]], recall, method="higher"))


def byte_codes(vector: str) -> Column:
    """A vector in one signed byte per dimension, scaled by its largest value: its direction, not its length."""

    @F.pandas_udf("binary")
    def code(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        m = unit_rows(vectors)
        top = np.abs(m).max(axis=1, keepdims=True)
        codes = np.rint(np.divide(m * 127, top, out=np.zeros_like(m), where=top > 0)).astype("int8")
        return pd.Series([c.tobytes() for c in codes])

    return code(vector)


def code_shortlist(queries: DataFrame, corpus: DataFrame, keys: list[str], *, short: int, block_rows: int, shelf_rows: int) -> DataFrame:
    """(keys, query_id, items): per query the ``short`` items of its blocks with the nearest codes, as (far, item_id), nearest first.

    Both sides carry ``code`` only, and a block gives one row per query. Blocks are dealt as in ``blocked_scores``, those of
    items up to twice a shelf's usual size.
    """
    q, c = queries.select(*keys, "query_id", "code"), corpus.select(*[F.col(x).alias(x) for x in (*keys, "item_id", "code")])
    sizes = _block_counts(q, c, keys, block_rows, 2 * shelf_rows)
    types = dict(queries.dtypes) | {"item_id": dict(corpus.dtypes)["item_id"]}
    schema = ", ".join(f"{x} {types[x]}" for x in [*keys, "query_id"]) + f", item_id array<{types['item_id']}>, far array<float>"

    def matrix(codes: pd.Series) -> np.ndarray:
        m = np.frombuffer(b"".join(codes), dtype="int8").reshape(len(codes), -1).astype("float32")
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def scan(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        cols = [*keys, "query_id", "item_id", "far"]
        if not len(qs) or not len(cs):
            return pd.DataFrame(columns=cols)
        cs = cs.sort_values("item_id", kind="stable")
        cm, items, parts = matrix(cs["code"]), cs["item_id"].to_numpy(), []
        take, step = min(short, len(cs)), max(1, min(1024, 4_000_000 // len(cs)))
        for lo in range(0, len(qs), step):
            part = qs.iloc[lo:lo + step]
            sims = matrix(part["code"]) @ cm.T
            top = np.argpartition(sims, len(cs) - take, axis=1)[:, -take:]
            parts.append(part[[*keys, "query_id"]].assign(item_id=list(items[top]), far=list(-np.take_along_axis(sims, top, axis=1))))
        return pd.concat(parts)[cols]

    rough = (_blocks(q, sizes, keys, "query_id", "qb", "cb").groupBy(*keys, "qb", "cb")
             .cogroup(_blocks(c, sizes, keys, "item_id", "cb", "qb").groupBy(*keys, "qb", "cb")).applyInPandas(scan, schema))
    plain = [x for x in keys if not x.startswith("_")]
    near = F.flatten(F.collect_list(F.arrays_zip("far", "item_id")))
    return rough.groupBy(*plain, "query_id").agg(F.slice(F.array_sort(near), 1, short).alias("items"))


def vector_ranks(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, keys: list[str], *, block_rows: int = 4096,
                 cell_rows: int = 2048, max_cells: int = 1024, sample: int = 20_000, decimals: int = 6) -> DataFrame:
    """(keys, query_id, item_id, rank): the rank that given pairs have in the whole list of their query, those without a
    vector left out. Nearer vectors are counted block by block and nothing else is kept of them; cells that hold none as near
    as a query's farthest pair are passed over."""
    mine = [*keys, "query_id"]
    side = queries.select(*mine, "embedding")
    own = (pairs.select(*mine, "item_id").distinct().join(side.withColumnRenamed("embedding", "_q"), mine)
           .join(vectors.select(*[F.col(x).alias(x) for x in keys], F.col("item_id").alias("item_id"), F.col("embedding").alias("_v")), [*keys, "item_id"])
           .select(*mine, "item_id", F.round(signed_cosine(F.col("_q"), F.col("_v")), decimals).alias("sim")))
    asked = saved(own.groupBy(*mine).agg(F.collect_list("item_id").alias("items"), F.collect_list("sim").alias("sims"), F.min("sim").alias("least"))
                  .join(side, mine), "vector-asked")
    group, corpus = list(keys), vectors.select(*keys, "item_id", "embedding")
    cells = min(max_cells, cells_of(corpus, keys, cell_rows))
    if cells > 1:
        centres = cell_centres(sampled(corpus, sample), cells)
        corpus, known = cell_bounds(corpus, keys, centres)
        ways = routed(asked, known, keys, centres, 1).select(*mine, "_cell", "bound")
        asked = asked.join(ways, mine).where(F.col("bound") + SLACK >= F.col("least")).drop("bound")
        group = [*keys, "_cell"]
    sizes = _block_counts(asked, corpus, group, block_rows)
    types = dict(asked.dtypes)
    schema = ", ".join(f"{x} {types[x]}" for x in mine) + f", item_id {dict(vectors.dtypes)['item_id']}, nearer long"

    def count(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        cols = [*mine, "item_id", "nearer"]
        if not len(qs) or not len(cs):
            return pd.DataFrame(columns=cols)
        cm, ids, parts = unit_rows(cs["embedding"]), cs["item_id"].to_numpy(), []
        for lo in range(0, len(qs), 1024):
            part = qs.iloc[lo:lo + 1024]
            all_sims = np.round(np.clip(unit_rows(part["embedding"]) @ cm.T, -1.0, 1.0), decimals) + 0.0
            for row, (_, query) in zip(all_sims, part.iterrows()):
                items, sims = np.array(query["items"]), np.array(query["sims"])[:, None]
                nearer = (row > sims) & (ids != items[:, None])
                tied = np.flatnonzero((row == sims).any(axis=0))
                nearer[:, tied] |= (row[tied] == sims) & (ids[tied] < items[:, None])
                parts.append(pd.DataFrame({**{x: query[x] for x in mine}, "item_id": items, "nearer": nearer.sum(axis=1)}))
        return pd.concat(parts)[cols]

    found = (_blocks(asked.select(*group, "query_id", "items", "sims", "embedding"), sizes, group, "query_id", "qb", "cb").groupBy(*group, "qb", "cb")
             .cogroup(_blocks(corpus.select(*[F.col(x).alias(x) for x in (*group, "item_id", "embedding")]), sizes, group, "item_id", "cb", "qb")
                      .groupBy(*group, "qb", "cb")).applyInPandas(count, schema))
    return own.join(found.groupBy(*mine, "item_id").agg(F.sum("nearer").alias("nearer")), [*mine, "item_id"], "left").select(
        *mine, "item_id", (F.coalesce("nearer", F.lit(0)) + 1).cast("int").alias("rank"))
