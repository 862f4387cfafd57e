"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from emberwatch.llm import (
    align, decontam, exact_dedup, html_text, langid, license_scan, line_dedup, mixing, packing, periodic, quality, simhash, token_counts,
)
from emberwatch.llm.common import table

def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files are on this machine; executors have them at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_digest(table(spark, sf_dir, "documents"))


def periodic_digest(docs: DataFrame) -> DataFrame:
    """Runs and collapsed words as digests, of documents a tenth of which are made periodic first."""
    out = periodic.periodic_runs(periodic.planted(docs)).withColumn("best", periodic.strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


OP1_SQL = r"""
WITH words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 5) AS k FROM words WHERE len(w) > 0),
item_shingles AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
docs AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM docs, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
sizes AS (SELECT item_id, count(*) AS q FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, q AS item_shingles, count(*) AS found, count(*) / q AS containment
FROM item_shingles JOIN doc_shingles USING (k, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, q HAVING count(*) >= 0.8 * q - 1e-9
"""

OP8_SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
grouped AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t, doc_id) AS copy FROM rows)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, sha256(t) AS text_sha256
FROM grouped
"""

OP9_SQL = r"""
WITH rows AS (SELECT doc_id, sha256(coalesce(text, '')) AS th, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, th, unnest(l) AS line, unnest(range(len(l))) AS pos FROM rows),
keyed AS (
  SELECT doc_id, th, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, th, line, pos, common.k IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, th
"""

_LICENSE_ROWS = ", ".join(
    f"({n}, '{text}', '{label}', {str(base).lower()})" for n, (text, label, base) in enumerate(
        [(t, x, True) for t, x in license_scan.BASE.items()] + [(t, x, False) for x, t in license_scan.NOTICES.items()]))

OP10_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
templates AS (
  SELECT template, label, is_base, string_split(phrase, ' ') AS w, least(3, len(string_split(phrase, ' '))) AS k
  FROM (VALUES {_LICENSE_ROWS}) AS t(template, phrase, label, is_base)),
known AS (
  SELECT template, label, is_base, k, len(w) - k + 1 AS grams, i - 1 AS tpos, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM templates)),
grams AS (
  SELECT rid, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM templates) WHERE len(w) >= k)),
votes AS (
  SELECT rid, template, label, is_base, k, grams, pos - tpos AS diagonal, list(tpos) AS ats, min(pos) AS lo, max(pos) + k - 1 AS hi
  FROM grams JOIN known USING (k, gram) GROUP BY rid, template, label, is_base, k, grams, pos - tpos),
cuts AS (
  SELECT *, CASE WHEN is_base OR lag(lo) OVER o IS NULL OR abs(diagonal - lag(diagonal) OVER o) > 3 OR lo - lag(hi) OVER o > 4
            THEN 1 ELSE 0 END AS new
  FROM votes WINDOW o AS (PARTITION BY rid, template ORDER BY lo, diagonal)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY lo, diagonal) AS run FROM cuts),
spans AS (
  SELECT rid, template, label, is_base, run, min(lo) AS first_word, len(list_distinct(flatten(list(ats)))) / grams AS found
  FROM runs GROUP BY rid, template, label, is_base, run, grams),
good AS (SELECT * FROM spans WHERE found >= CASE WHEN is_base THEN 1 ELSE 0.7 END)
SELECT doc_id, len(any_value(w)) AS n_words, count(*) FILTER (is_base) AS n_base, min(first_word) FILTER (is_base) AS first_word,
       max(first_word) FILTER (is_base) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (is_base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
       coalesce(max(found), 0) AS score
FROM docs LEFT JOIN good USING (rid) GROUP BY rid, doc_id
"""

QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_mixing": op13_mixing,
}

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op9_line_dedup": OP9_SQL,
                           "op10_license_scan": OP10_SQL}
