"""Text helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens."""
    trimmed = F.trim(F.lower(text), F.lit(" \t\r\n\f\x0b"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def clip(text: Column, n: int, suffix: str = "") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def strip(text: Column) -> Column:
    """Trim blanks, tabs and line breaks on both sides."""
    return F.trim(text, F.lit(" \t\r\n"))


def short_iso(ts: Column) -> Column:
    """ISO text without a fraction when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(iso(ts))


def plain_number(x: Column) -> Column:
    """A double as text without an exponent from 0.0001 up to 1e16, where Spark has one below 0.001 and from 1e7 on."""
    plain = F.rtrim(x.cast("decimal(38,18)").cast("string"), F.lit("0"))
    wide = ((F.abs(x) >= 1e-4) & (F.abs(x) < 1e-3)) | ((F.abs(x) >= 1e7) & (F.abs(x) < 1e16))
    return F.when(wide, F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)).otherwise(x.cast("string"))
