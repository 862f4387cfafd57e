"""License scan by diagonal voting.

Every rolling word k-gram of a text is hashed and joined to the hashed k-grams of short notice templates. A hit
votes for the diagonal (place in the text minus place in the template); votes are counted per text, template and
diagonal. Neighbouring diagonals that overlap merge into one span (words put in or left out shift the diagonal),
and a span stands when enough of the template's k-grams are found in it.

Base phrases are templates too, but only whole places count: each place where all the phrase's words stand
consecutively is one base place. Null counts as an empty text without words; rows that share id and text count
as separate rows with equal results; null ids are kept. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberwatch.llm.common import ascii_lower, let

# The phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening sentences of public licenses and common notices, and the labels given for them.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution license",
    "spdx": "spdx license identifier",
    "copyright-notice": "copyright c all rights reserved",
}

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_TEMPLATE = -1


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of any other characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAK), "")


def _grams(found: Column, k: int) -> Column:
    """Hashes of the rolling k-grams of an array of words."""
    return let(found, lambda w: F.when(F.size(w) >= k, F.transform(
        F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(
        F.array().cast("array<bigint>")))


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str], k: int) -> DataFrame:
    """(hash, template, label, is_base, at, grams, size): one row per k-gram of each phrase; a fixed list in the
    code, so its size is bounded. Phrases of fewer than k words use all their words as one gram."""
    rows = [(text, label, True) for text, label in base.items()] + [(text, label, False) for label, text in notices.items()]
    rows = [(n, text.split(), label, is_base) for n, (text, label, is_base) in enumerate(rows)]
    phrases = spark.createDataFrame(rows, "template int, w array<string>, label string, is_base boolean")
    parts = [phrases.where(F.least(F.size("w"), F.lit(k)) == j).select(
        "template", "label", "is_base", F.size("w").alias("size"), F.size(_grams(F.col("w"), j)).alias("grams"),
        F.posexplode(_grams(F.col("w"), j)).alias("at", "hash")) for j in {min(len(r[1]), k) for r in rows}]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None,
          notices: dict[str, str] | None = None, k: int = 3, drift: int = 3, least: float = 0.7) -> DataFrame:
    """(id, th, copies, n_words, label, is_base, first_word, last_word, found): verified spans; a text without
    any has one row with a null label."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    spark = docs.sparkSession
    known = templates(spark, base, notices, k)
    sizes = sorted({min(len(t.split()), k) for t in [*base, *notices.values()]})
    marker = spark.range(1).select(
        F.lit(NO_TEMPLATE).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_base"),
        F.lit(0).alias("size"), F.lit(0).alias("grams"), F.lit(0).alias("at"), F.lit(0).alias("k"),
        F.lit(0).cast("bigint").alias("hash"))
    known = known.withColumn("k", F.least("size", F.lit(k))).unionByName(marker)
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("th"),
                       words(text).alias("w"))
    # One gram row per text besides, which always meets the marker: texts without a hit stay in the result.
    marked = F.array(F.struct(F.lit(0).alias("k"), F.array(F.lit(0).cast("bigint")).alias("hashes")))
    grams = F.concat(marked, F.array(*[F.struct(F.lit(j).alias("k"), _grams(F.col("w"), j).alias("hashes")) for j in sizes]))
    rows = rows.select("id", "th", F.size("w").alias("n_words"), F.explode(grams).alias("g"))
    rows = rows.select("id", "th", "n_words", F.col("g.k").alias("k"), F.posexplode("g.hashes").alias("pos", "hash"))
    hits = rows.join(F.broadcast(known), ["hash", "k"])
    diagonal = (F.col("pos") - F.col("at")).alias("diagonal")
    votes = hits.groupBy("id", "th", "n_words", "template", "label", "is_base", "size", "grams", "k", diagonal).agg(
        F.collect_set("at").alias("ats"), F.sum(F.when(F.col("template") == NO_TEMPLATE, 1)).alias("copies"))
    votes = votes.select("*", (F.col("diagonal") + F.array_min("ats")).alias("lo"),
                         (F.col("diagonal") + F.array_max("ats") + F.greatest("k", F.lit(1)) - 1).alias("hi"))
    # Neighbouring diagonals of a template in a text, as long as they overlap or nearly so, are one span.
    order = Window.partitionBy("id", "th", "template").orderBy("lo", "diagonal")
    new = (F.col("is_base") | F.lag("lo").over(order).isNull()
           | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > drift)
           | (F.col("lo") - F.lag("hi").over(order) > drift + 1))
    merged = votes.withColumn("run", F.sum(new.cast("int")).over(order))
    merged = merged.groupBy("id", "th", "n_words", "template", "label", "is_base", "grams", "run").agg(
        F.min("lo").alias("first_word"), F.max("hi").alias("last_word"), F.max("copies").alias("copies"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("met"))
    found = F.when(F.col("grams") > 0, F.col("met") / F.col("grams"))
    merged = merged.withColumn("found", found).where(
        (F.col("template") == NO_TEMPLATE) | F.when(F.col("is_base"), F.col("met") == F.col("grams")).otherwise(
            F.col("found") >= least))
    return merged.select("id", "th", "copies", "n_words", "label", "is_base", "first_word", "last_word", "found")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best share of a template's k-grams found in one span, 0 without a span."""
    found = spans(docs, id_col, text_col, **options)
    base = F.col("is_base") & F.col("label").isNotNull()

    def joined(label: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(label)), ",")

    per = found.groupBy("id", "th", "n_words").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("found"), F.lit(0.0)).alias("score"), F.max("copies").alias("copies"))
    per = per.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
    return per.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word",
                      "last_word", "base_labels", "labels", "score")
