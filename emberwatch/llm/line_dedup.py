"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least
min_chars code points held by at least min_docs documents lose all their lines except in the document with the
largest id (null ids rank lowest). A null or empty text is one empty line. Documents are told apart by id and
text, so rows that share an id keep their own lines; rows with one id count as one document. Other columns play
no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import ascii_lower, stored

BLANK = " \t\n\x0b\x0c\r"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, th, pos, h1, h2) of every line whose key is long enough; two hashes make 128 bits."""
    lines = _rows(docs, id_col, text_col).select("id", "th", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.octet_length("line") >= min_chars).select("id", "th", "pos", F.btrim("line", F.lit(BLANK)).alias("s"))
    lines = lines.where(F.char_length("s") >= min_chars).withColumn("k", ascii_lower(F.col("s")))
    return lines.select("id", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                        min_docs: int = 5) -> DataFrame:
    """One row per document: id, text without the dropped lines, n_lines, n_dropped."""
    lines = long_lines(docs, id_col, text_col, min_chars)
    held = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    common = held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("keep")).where(
        F.col("docs") >= min_docs).select("h1", "h2", "keep")
    # As a table it can be joined with a hot line's rows split over many tasks.
    common = stored(common, "common-lines")
    gone = lines.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keep")))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).agg(
        F.sort_array(F.collect_set("pos")).alias("cut"))
    rows = _rows(docs, id_col, text_col).join(
        gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    rows = rows.select("id", "t", F.split("t", "\n", -1).alias("lines"), "cut")
    # The kept lines are the runs between cuts: linear in the lines, whatever their number.
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "cut"), F.concat("cut", F.array(F.size("lines"))),
                      lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1))
    text = F.when(F.col("cut").isNull(), F.col("t")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return rows.select(F.col("id").alias(id_col), text.alias(text_col), F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"))
