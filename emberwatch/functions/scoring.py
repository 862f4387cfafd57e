"""Severity ladders, cosine similarity, prices and small deterministic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order.
SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
# USD per 1000 tokens (input, output).
MODEL_PRICES = {
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-4": (0.01, 0.03),
    "gpt-3.5-turbo": (0.001, 0.002),
}
DEFAULT_PRICE_MODEL = "gpt-3.5-turbo"


def ladder(value: Column, steps: list[tuple[float, str]], default: str, *, strict: bool) -> Column:
    """First label whose bound ``value`` reaches (or exceeds, if strict)."""
    out = None
    for bound, label in steps:
        test = value > bound if strict else value >= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def zscore_severity(z: Column) -> Column:
    return ladder(z, [(7.0, "CRITICAL"), (5.0, "HIGH"), (4.0, "MEDIUM")], "LOW", strict=False)


def distance_severity(distance: Column) -> Column:
    return ladder(distance, [(0.7, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM")], "LOW", strict=True)


def severity_rank(severity: Column) -> Column:
    """1 (LOW) to 4 (CRITICAL); anything else 0."""
    out = None
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank) if out is None else out.when(severity == name, rank)
    return out.otherwise(0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def signed_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in [-1, 1]; 0 if either vector is zero."""
    raw = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(raw, F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clipped to [0, 1]; 0 if either vector is zero."""
    return F.greatest(F.lit(0.0), signed_cosine(a, b))


def ab_variant(id_col: Column) -> Column:
    """v1 / v2, fixed per id so that replays agree."""
    return F.when(F.conv(F.substring(F.md5(id_col), 1, 8), 16, 10).cast("long") % 2 == 0, "v1").otherwise("v2")


def stable_id(prefix: str, *cols: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 32))


def price(model: Column, side: int) -> Column:
    """Price per 1000 tokens; ``side`` 0 = input, 1 = output; unknown models cost the default."""
    out = None
    for name, pair in MODEL_PRICES.items():
        out = F.when(model == name, pair[side]) if out is None else out.when(model == name, pair[side])
    return out.otherwise(MODEL_PRICES[DEFAULT_PRICE_MODEL][side])
