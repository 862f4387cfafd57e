"""Table reads and the weekly log layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def week_start(ts: Column) -> Column:
    """Monday of the ISO week, UTC."""
    return F.date_trunc("week", ts).cast("date")


def week_label(ts: Column) -> Column:
    """Partition label such as ``logs_y2024_w01``; the year is that of the ISO week (its Thursday)."""
    thursday = F.date_add(week_start(ts), 3)
    return F.format_string("logs_y%04d_w%02d", F.year(thursday), F.weekofyear(thursday))


def write_weekly(logs: DataFrame, path: str, *, ts_col: str = "ts", parts: int | None = None, mode: str = "append") -> None:
    """Write logs partitioned by week, sorted so tenant and time filters skip row groups.

    Rows are dealt by ranges of (week, tenant, time) with equal numbers of rows, so a hot week or tenant is spread over
    as many tasks and files as it has rows for, and a quiet week lies in one file. ``parts`` is the number of ranges
    (default: the session's shuffle partitions).
    """
    order = ["week", "tenant_id", ts_col]
    dated = logs.withColumn("week", week_start(F.col(ts_col)))
    dealt = dated.repartitionByRange(*([parts] if parts else []), *order)
    dealt.sortWithinPartitions(*order).write.mode(mode).partitionBy("week").parquet(path)


def read_weekly(spark: SparkSession, path: str, *, start: str, end: str, ts_col: str = "ts") -> DataFrame:
    """Rows with ``start <= ts < end``; the derived week predicate prunes whole folders."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return (spark.read.parquet(path)
            .where((F.col("week") >= week_start(lo)) & (F.col("week") <= week_start(hi)))
            .where((F.col(ts_col) >= lo) & (F.col(ts_col) < hi)))
