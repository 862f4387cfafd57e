"""Mixing sources to target weights by the cube method.

Each source has a target: its weight's share of all words, at most ``most`` times its own words, the excess going to the
others by weight. A document enters floor(r) times for the ratio r of target and size of its source, and once more with
probability r - floor(r). Which ones enter once more is drawn by balanced sampling: the fractional probabilities move
along directions that keep the expected sum of words and the number of documents of the source, until they are 0 or 1.

* Flight: a bucket of a source's documents is one task, buckets hold about BUCKET units. A unit moves against two others,
  the one direction in which three units keep two totals, until one of them is settled. Two units at most stay open, and
  these fly on together in new buckets until a source's open units fit LANDING.
* Landing: one task per source takes what is open, the documents that hold a large part of their source (1 / LARGE of its
  words and more, so at most LARGE documents) and RESERVE others chosen by hash. From the largest down each is settled
  while all smaller ones move a little against it, which again keeps both totals; with two left only the words count, and
  the last one is rounded. What a source of few documents then lacks is made good by exchanging two of these units.

Equal rows (id, source, size and text) are one unit with its multiplicity, so an id repeated a million times is one row in
the sampling. All draws come from hashes of ids and texts: reruns agree, however the input is dealt to tasks.

Null texts have no words; null sources are a source of their own, the last. A source without words has target 0. Null ids
stay. Other columns play no part, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

BUCKET = 20_000
LANDING = 4_000
LARGE = 256
RESERVE = 512
TINY = 1e-9
UNIT = "source_id long, unit long, size long, p double"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds place: the position of each source by code point, null last, counted by ranges and not in one task."""
    # UTF-8 bytes order as code points do.
    ordered = stored(sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source")
                     .sortWithinPartitions("last", "source").withColumn("at", F.monotonically_increasing_id()), "sources")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # One row per partition.
    before = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).select(
        "part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return ordered.withColumn("part", part).join(before, "part").select(
        *sources.columns, "last", (F.col("before") + inside).alias("place"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size) with place and target. Weights repeat over the places; all targets together are ``share`` of
    all words (up to ``most`` times what there is)."""
    weighted = stored(numbered(sources).withColumn("weight", F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))), "source-weights")
    limit = F.lit(float(most)) * F.col("source_size")
    total = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, None
    while True:
        # Sources whose share would be above their limit are cut to it; the rest is dealt anew to the others.
        over = F.lit(level) * F.col("weight") > limit
        state = weighted.agg(F.count_if(over).alias("capped"), F.sum(F.when(over, limit)).alias("cut"),
                             F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not state.open or state.capped == capped:
            break
        level, capped = (total - (state.cut or 0.0)) / state.open, state.capped
    return weighted.withColumn("target", F.least(F.lit(level) * F.col("weight") if state.open else limit, limit))


def settle_three(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Chances after the flight of three units at a time: all but two at most are 0 or 1, and the sums of chances and of
    chance times size are kept."""
    out = chances.tolist()
    size = sizes.tolist()
    draw = iter(draws.tolist())
    held: list[int] = []
    for i in range(len(out)):
        if TINY < out[i] < 1 - TINY:
            held.append(i)
        while len(held) == 3:
            a, b, c = held
            way = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(way):
                way = (1, -1, 0)
            up = min((1 - out[k]) / w if w > 0 else out[k] / -w for k, w in zip(held, way) if w)
            down = min(out[k] / w if w > 0 else (1 - out[k]) / -w for k, w in zip(held, way) if w)
            step = up if next(draw) * (up + down) < down else -down
            for k, w in zip(held, way):
                out[k] += step * w
            held = [k for k in held if TINY < out[k] < 1 - TINY]
    return np.clip(np.where(np.abs(np.array(out) - np.round(out)) <= TINY, np.round(out), out), 0, 1)


def land(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """0 or 1 for each unit: the largest first, all smaller ones moving against it."""
    size, p = sizes.astype(float), chances.copy()
    todo = np.lexsort((np.arange(len(p)), -size))
    off, draw = 0.0, iter(np.r_[draws, draws])
    while True:
        todo = todo[(p[todo] > TINY) & (p[todo] < 1 - TINY)]
        if not len(todo):
            return np.round(p)
        first, rest = todo[0], todo[1:]
        s = size[rest]
        norm = (s * s).sum()
        if len(rest) == 0 or norm == 0:
            # Nothing can move against it any more: the side on which the words come nearer to their sum.
            choice = float(abs(off + (1 - p[first]) * size[first]) < abs(off - p[first] * size[first])) if size[first] else round(p[first])
            off += (choice - p[first]) * size[first]
            p[first] = choice
            continue
        spread = len(rest) * norm - s.sum() ** 2
        if len(rest) > 1 and spread > TINY * len(rest) * norm:
            # The rest moves by alpha + beta * size, the smallest move that keeps both sums.
            alpha = (-norm + s.sum() * size[first]) / spread
            beta = (s.sum() - len(rest) * size[first]) / spread
            way = np.r_[1.0, alpha + beta * s]
        else:
            way = np.r_[1.0, -size[first] * s / norm]
        now = p[todo]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(way > 0, (1 - now) / way, np.where(way < 0, now / -way, np.inf)).min()
            down = np.where(way > 0, now / way, np.where(way < 0, (1 - now) / -way, np.inf)).min()
        step = up if next(draw) * (up + down) < down else -down
        p[todo] = np.clip(now + step * way, 0, 1)


def polished(sizes: np.ndarray, chances: np.ndarray, landed: np.ndarray) -> np.ndarray:
    """Landed units with one taken unit exchanged for another, or one changed alone, as long as the words come nearer to
    their sum. A source with few documents needs this: nothing small enough is left there to move against the last."""
    out = landed.copy()
    off = float(((out - chances) * sizes).sum())
    for _ in range(len(out)):
        fixed = (chances <= TINY) | (chances >= 1 - TINY)
        into, away = (np.r_[0, 1 + np.flatnonzero(~fixed & (out == side))] for side in (0, 1))
        size = np.r_[0, sizes].astype(float)  # unit 0 stands for none
        into = into[np.argsort(size[into], kind="stable")]
        # For each unit to leave the two units whose size is nearest to what then lacks.
        at = np.searchsorted(size[into], size[away] - off)
        pairs = [(abs(off - size[a] + size[into[k]]), a, into[k]) for a, k in
                 [(a, k) for a, n in zip(away, at) for k in (n - 1, n) if 0 <= k < len(into)]]
        best, a, b = min(pairs, key=lambda x: (x[0], (x[1] == 0) != (x[2] == 0), x[1], x[2]))
        if best >= abs(off) - 1e-6:
            break
        off += size[b] - size[a]
        for unit, side in ((a, 0.0), (b, 1.0)):
            if unit:
                out[unit - 1] = side
    return out


def drawn(units: np.ndarray, turn: int) -> np.ndarray:
    """A number in [0, 1) for each unit, from its hash and the turn."""
    return np.random.default_rng([turn, int(np.bitwise_xor.reduce(units.view(np.uint64), initial=0))]).random(len(units))


def flight(turn: int):
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "unit"], ascending=[False, True], kind="stable")
        p = settle_three(rows["size"].to_numpy(), rows["p"].to_numpy(), drawn(rows["unit"].to_numpy(), turn))
        return rows[["source_id", "unit", "size"]].assign(p=p)

    return fly


def landing(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "unit"], ascending=[False, True], kind="stable")
    size, p = rows["size"].to_numpy(), rows["p"].to_numpy()
    landed = polished(size, p, land(size, p, drawn(rows["unit"].to_numpy(), 0)))
    return rows[["source_id", "unit", "size"]].assign(p=landed)


def balanced(units: DataFrame) -> DataFrame:
    """Units (source_id, unit, size, p) with p settled at 0 or 1, both sums of each source kept as far as possible."""
    sums = units.groupBy("source_id").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("unit", F.lit("reserve")), F.col("n"))
    large = (F.col("size") > 0) & (F.col("size") * LARGE >= F.col("words"))
    marked = stored(units.join(sums, "source_id").withColumn("late", large | (part < RESERVE) | (F.col("n") <= LANDING)), "mix-units")
    settled = [marked.where((F.col("p") <= TINY) | (F.col("p") >= 1 - TINY)).select("source_id", "unit", "size", F.round("p").alias("p"))]
    fractional = marked.where((F.col("p") > TINY) & (F.col("p") < 1 - TINY))
    late, flying = (fractional.where(c).select("source_id", "unit", "size", "p") for c in (F.col("late"), ~F.col("late")))
    turn = 0
    while True:
        most = flying.groupBy("source_id").agg(F.count("*").alias("open")).agg(F.max("open")).first()[0] or 0
        if most <= LANDING // 2:
            break
        turn += 1
        buckets = flying.groupBy("source_id").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
        dealt = flying.join(buckets, "source_id").withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit(turn)), "buckets"))
        flown = stored(dealt.groupBy("source_id", "bucket").applyInPandas(flight(turn), UNIT), f"mix-flight-{turn}")
        settled.append(flown.where("p = 0 or p = 1"))
        flying = flown.where("p > 0 and p < 1")
    settled.append(late.unionByName(flying).groupBy("source_id").applyInPandas(landing, UNIT))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per document: id, size, source, source_size, target (its source's), copies and taken = copies * size."""
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), word_count(text).alias("size"),
                       F.xxhash64(text).alias("content"))
    # Rows that are equal in all of this are exchangeable.
    same = stored(rows.groupBy("id", "source", "size", "content").agg(F.count("*").alias("rows")), "mix-rows")
    sources = same.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    aims = stored(targets(sources, weights, most).select("source", "place", "source_size", "target"), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    extra = F.col("rows") * (F.col("ratio") - F.floor("ratio"))
    placed = same.join(aims, same["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    units = stored(placed.withColumn("ratio", ratio).withColumn("sure", F.floor(extra)).withColumn("p", extra - F.col("sure"))
                   .withColumn("unit", F.xxhash64("place", "id", "size", "content")), "mix-sampling")
    # Units of one hash are one unit's worth of chance: the first is drawn, which its copies in the join then share.
    drawn_units = balanced(units.groupBy(F.col("place").alias("source_id"), "unit").agg(F.max("size").alias("size"), F.max("p").alias("p")))
    picks = drawn_units.select(F.col("source_id").alias("place"), "unit", F.col("p").cast("long").alias("more"))
    whole = units.join(picks, ["place", "unit"]).withColumn("extras", F.col("sure") + F.col("more"))
    each = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.floor("ratio") + F.when(F.col("copy") <= F.col("extras"), 1).otherwise(0)
    return each.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target",
                       copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
