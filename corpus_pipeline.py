"""From raw documents to training sequences: the stages, and run() which applies them one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberwatch.llm import decontam, exact_dedup, langid, packing, simhash
from emberwatch.llm.common import stored, table
from emberwatch.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that has half of the probability, go."""
    return langid.keep_identified(docs, least=0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the row with the largest id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of five-word shingles, the one with the smallest id stays. A share of 0.8
    common shingles is a cosine of 0.89, whose angle flips 0.15 of the bits: 39 of 256, give or take 6; 46 may differ."""
    return simhash.drop_similar(docs, words=5, limit=46)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's five-word shingles go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power of two tokens, each a sequence of its own, with their ids."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language ID and SimHash have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
