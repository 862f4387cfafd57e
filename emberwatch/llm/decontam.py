"""Benchmark decontamination: MinHash containment search over size-partitioned items, verified exactly.

A document contains an item when at least `threshold` of the item's distinct word shingles occur in it. An item
of q shingles may miss at most q - ceil(threshold * q) of them, so among any (that number + 1) of its shingles
one must be in the document. The search takes the item's smallest hashes (its MinHash sketch); the sketch length
follows from the item's size class, a power of two, whose largest member sets it. Documents of any length are
searched through all their shingles, so a short item inside a long document is found as surely as in a short one,
and no candidate is lost. A candidate pair is then verified on the words themselves.

Words are runs of letters and digits, lower-cased. An item of fewer words than `words` is one shingle of all its
words; items without words match nothing. Null texts have no words; null ids are kept as ids. Pairs are distinct,
so repeated rows give one pair. Other columns play no part; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import let, stored

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Rows up to which sketches or candidates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def _shingle(w: Column, i: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)])


def shingles(found: Column, k: int) -> Column:
    return let(found, lambda w: F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(0), F.size(w) - k), lambda i: _shingle(w, i, k))).otherwise(F.array().cast("array<string>")))


def hashes(found: Column, k: int) -> Column:
    """One hash per shingle, taken from its words."""
    return let(found, lambda w: F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(
        F.array().cast("array<bigint>")))


def item_sets(items: DataFrame, k: int, threshold: float, item_col: str, text_col: str) -> DataFrame:
    """(item, q, shingles, sketch) of the items whose shingles have k words."""
    rows = items.select(items[item_col].alias("item"), tokens(items[text_col]).alias("w"))
    rows = rows.select("item", F.array_distinct(shingles(F.col("w"), k)).alias("shingles"),
                       F.array_sort(F.array_distinct(hashes(F.col("w"), k))).alias("hashes"))
    rows = rows.withColumn("q", F.size("shingles")).where("q > 0").withColumn("size_class", F.floor(F.log2("q")).cast("int"))
    largest = F.pow(F.lit(2), F.col("size_class") + 1) - 1
    length = (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int")
    return rows.select("item", "q", "shingles", F.slice("hashes", F.lit(1), length).alias("sketch"))


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its rows are few, and whether they are."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (F.broadcast(df) if few else df), few


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, item, item_shingles, found, containment) of every contaminated document and item."""
    own_words = F.least(F.size(tokens(items[item_text])), F.lit(words))
    lengths = items.select(own_words.alias("k")).where("k > 0").distinct()
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    parts = []
    for k in sorted(r.k for r in lengths.collect()):  # at most `words` values
        sets = stored(item_sets(items.where(own_words == k), k, threshold, item_col, item_text), "items")
        sketch, few_items = _small(sets.select("item", F.explode("sketch").alias("hash")))
        rows = docs.select(docs[id_col].alias("id"), th.alias("th"), hashes(tokens(docs[text_col]), k).alias("h"))
        # The words stay behind: only hashes are exploded, and only hits go on.
        hits = rows.select("id", "th", F.explode("h").alias("hash")).join(sketch, "hash")
        pairs = stored(hits.select(F.col("id").alias("pair_id"), F.col("th").alias("pair_th"), "item").distinct(), "candidates")
        pairs, _ = _small(pairs)
        met = docs[id_col].eqNullSafe(F.col("pair_id")) & (th == F.col("pair_th"))
        near = docs.join(pairs, met).select("pair_id", "item", tokens(docs[text_col]).alias("w"))
        sets = sets.withColumnRenamed("item", "set_item")
        near = near.join(F.broadcast(sets) if few_items else sets, F.col("item").eqNullSafe(F.col("set_item")))
        found = F.size(F.array_intersect(F.col("shingles"), shingles(F.col("w"), k)))
        near = near.select(F.col("pair_id").alias("id"), "item", "q", found.alias("found"))
        parts.append(near.groupBy("id", "item", "q").agg(F.max("found").alias("found")))
    if not parts:
        none = docs.select(docs[id_col].alias("id")).limit(0)
        parts = [none.select("id", F.lit(None).cast(items.schema[item_col].dataType).alias("item"), F.lit(0).alias("q"), F.lit(0).alias("found"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.where(F.col("found") >= threshold * F.col("q") - 1e-9)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("q").cast("long").alias("item_shingles"),
                      F.col("found").cast("long").alias("found"), (F.col("found") / F.col("q")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item, all columns; rows that share a contaminated id go together."""
    bad = contaminated(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("__bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad")), "left_anti")
