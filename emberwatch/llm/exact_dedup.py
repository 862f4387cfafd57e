"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Rows, never texts, are shuffled: every hash is taken where the text is read, and the full hash once, after the earlier steps
have left only rows whose length and prefix hash recur. Equal texts are identical texts; null counts as empty. Of equal texts
the row with the largest id stays (null ids rank below all others); of identical rows (same id, same text) one stays. Other
columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import stored

LENGTH_BUCKETS = 65536


def _rows(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("id"), text.alias("t"), F.octet_length(text).alias("n"),
                       F.xxhash64(F.substring(text, 1, prefix)).alias("p"))


def close_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128) -> DataFrame:
    """(id, t, n, p, close) of every row: close where the length and then the hash of the prefix recur.

    Lengths fold into 65,536 buckets and recurring (length, prefix hash) keys into as many, so what is broadcast has at most
    that many rows; a fold of two keys only lets a few rows through to the full hash.
    """
    rows = _rows(docs, id_col, text_col, prefix)
    length = F.pmod("n", F.lit(LENGTH_BUCKETS)).alias("b")
    lengths = F.broadcast(rows.groupBy(length).agg(F.count("*").alias("c")).where("c > 1").select("b"))
    fold = F.pmod(F.xxhash64("n", "p"), F.lit(LENGTH_BUCKETS)).alias("f")
    some = rows.select("n", "p", length).join(lengths, "b", "left_semi")
    keys = some.groupBy("n", "p").agg(F.count("*").alias("c")).where("c > 1")
    folds = F.broadcast(stored(keys.select(fold).distinct(), "prefixes").withColumn("close", F.lit(True)))
    return rows.withColumn("f", fold).join(folds, "f", "left").select("id", "t", "n", "p", F.coalesce("close", F.lit(False)).alias("close"))


def hashed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha, copies) of the rows that reach the full hash, those with equal id and text as one; written, so that the hash
    is taken once. Copies collapse in the task that reads them: a text held by a third of all rows is a row per task."""
    close = close_rows(docs, id_col, text_col).where("close")
    return stored(close.groupBy("id", F.sha2("t", 256).alias("sha")).agg(F.count("*").alias("copies")), "hashed")


def classes_of(hashed: DataFrame) -> DataFrame:
    """(sha, keep_id, group_size) of every text held by two rows or more; as a table it can be joined with a hot text's rows
    split over many tasks."""
    classes = hashed.groupBy("sha").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")).where("group_size > 1")
    return stored(classes, "classes")


def exact_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. The last column needs one full hash of every text,
    which is the one that compares the rows that are left; the others are in no class."""
    rows = close_rows(docs, id_col, text_col).groupBy("id", "close", F.sha2("t", 256).alias("sha")).agg(F.count("*").alias("copies"))
    rows = stored(rows, "hashed")
    rows = rows.join(classes_of(rows.where("close")), "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    rows = rows.withColumn("keep", keep).select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return rows.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns. Only rows whose id has a verdict (and those that share its fold) are shuffled."""
    hashed = hashed_rows(docs, id_col, text_col)
    rows = hashed.join(classes_of(hashed), "sha")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    verdict = stored(rows.where(~stays | (F.col("copies") > 1)).select(
        F.col("id").alias("__id"), F.col("sha").alias("__sha"), stays.alias("__repeated")), "verdicts")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    folds = F.broadcast(verdict.select(F.pmod(F.xxhash64("__id"), F.lit(LENGTH_BUCKETS)).alias("__fold")).distinct().withColumn("__some", F.lit(True)))
    marked = docs.withColumns({"__key_id": docs[id_col], "__text": text, "__fold": F.pmod(F.xxhash64(docs[id_col]), F.lit(LENGTH_BUCKETS))}
                              ).join(folds, "__fold", "left")
    keyed = marked.where("__some").withColumn("__key", F.sha2("__text", 256))
    met = F.col("__key_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha"))
    judged = keyed.join(verdict, met, "left")
    once = judged.where("__repeated").dropDuplicates(["__key_id", "__key"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return (marked.where("__some IS NULL").select(*columns).unionByName(judged.where(F.col("__repeated").isNull()).select(*columns))
            .unionByName(once.select(*columns)))
