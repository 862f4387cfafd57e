"""Streaming forms that wait for the watermark: rows of a key are held until no earlier one can come, then taken in time
order. So the order in which micro-batches bring them does not matter, and results equal the batch forms.

Rows older than the watermark are dropped by Spark; ``lateness`` is how long a row may be late. A key's state ends with a
timer: with the time bucket of the cache, the day of the spend, an idle investigation.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberwatch.operators.anomaly import ERROR_LEVELS, merged_columns
from emberwatch.operators.routing import routed_columns
from emberwatch.operators.vectors import unit_rows
from emberwatch.streaming.stateful import _us, use_rocksdb

MS = 1_000
#: What ``with_tick`` adds: a time that no event reaches.
FAR = "2200-01-01"


def with_tick(df: DataFrame, at: str) -> DataFrame:
    """A bounded table with one empty row far in the future, which moves the watermark past all others at its end."""
    tick = df.sparkSession.range(1).select(*[
        (F.lit(FAR).cast("timestamp") if c == at else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes])
    return df.unionByName(tick)


def timed(stream: DataFrame, at: str, lateness: str, known: Column) -> DataFrame:
    """The stream with its watermark, without ticks (for which ``known`` is false or null)."""
    # One condition that names the time: Spark does not move it before the watermark, which ticks must reach.
    return stream.withWatermark(at, lateness).where(F.when(F.col(at).isNull(), False).otherwise(known))


class Settled(StatefulProcessor):
    """Base: state ``held`` are rows that wait; ``settle`` takes the ready ones, sorted. Fields start with time and order."""

    held_schema = "at long, kind int, id string"
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)

    def fields(self, pdf: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def settle(self, key: tuple, ready: list[tuple], now: int) -> list[tuple]:
        raise NotImplementedError

    def ends(self, key: tuple) -> int | None:
        """Time (microseconds) at which the key's state may go."""
        return None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = self.fields(pd.concat(list(rows), ignore_index=True))
        self.held.appendList(fresh)
        self.handle.registerTimer(min(r[0] for r in fresh) // MS + 1)
        if self.ends(key) is not None:
            self.handle.registerTimer(self.ends(key) // MS + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * MS
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        ready, later = sorted(r for r in held if r[0] < now), [r for r in held if r[0] >= now]
        if later:
            self.held.put(later)
            self.handle.registerTimer(min(r[0] for r in later) // MS + 1)
        else:
            self.held.clear()
        yield pd.DataFrame(self.settle(key, ready, now), columns=self.columns)

    def close(self) -> None:
        pass


class CacheLookup(Settled):
    """Entries and questions of one tenant and time bucket. Its state ends with the bucket."""

    held_schema = "at long, kind int, id long, result string, embedding array<double>"
    columns = ["tenant_id", "query_id", "item_id", "similarity", "cache_hit", "rca_result"]

    def __init__(self, ttl_us: int, threshold: float, decimals: int):
        self.ttl_us, self.threshold, self.decimals = ttl_us, threshold, decimals

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entries = handle.getListState("entries", self.held_schema)

    def ends(self, key: tuple) -> int:
        return (int(key[1]) + 1) * self.ttl_us

    def fields(self, pdf: pd.DataFrame) -> list[tuple]:
        return [(int(t), int(k), int(i), r, [float(x) for x in v]) for t, k, i, r, v in
                zip(_us(pdf["at"]), pdf["kind"], pdf["id"], pdf["result"], pdf["embedding"])]

    def settle(self, key: tuple, ready: list[tuple], now: int) -> list[tuple]:
        known = [tuple(r) for r in self.entries.get()] if self.entries.exists() else []
        fresh = [r for r in ready if r[1] == 0]
        asked = [r for r in ready if r[1] == 1]
        if now > self.ends(key):
            self.entries.clear()
        elif fresh:
            self.entries.appendList(fresh)
        live = sorted(known + fresh, key=lambda r: r[2])
        out = []
        for lo in range(0, len(asked), 512):
            part = asked[lo:lo + 512]
            best = None
            if live:
                sims = np.clip(unit_rows(pd.Series([r[4] for r in part])) @ unit_rows(pd.Series([r[4] for r in live])).T, 0.0, 1.0)
                age = np.array([r[0] for r in part])[:, None] - np.array([r[0] for r in live])[None, :]
                sims = np.where((age < 0) | (age >= self.ttl_us), -1.0, np.round(sims, self.decimals) + 0.0)
                best = sims.argmax(axis=1)
            for n, question in enumerate(part):
                found = best is not None and sims[n, best[n]] >= 0
                score = float(sims[n, best[n]]) if found else None
                hit = found and score >= self.threshold
                item = live[best[n]] if hit else None
                out.append((key[0], question[2], item and item[2], score, hit, item and item[3]))
        return out


def cache_lookup_stream(events: DataFrame, *, threshold: float = 0.92, ttl_s: int = 86400, lateness: str = "10 minutes",
                        decimals: int = 6) -> DataFrame:
    """``cache_lookup`` over one stream of entries (kind 0) and questions (kind 1): tenant_id, at, kind, id, result, embedding.

    As in the batch form an entry is copied to the next bucket of TTL length, so a key holds the entries of two buckets
    at most and loses them when its bucket is over. Entries without vector or result do not count.
    """
    use_rocksdb(events.sparkSession)
    width = ttl_s * 1_000_000
    rows = timed(events, "at", lateness, (F.col("kind") == 1) | ((F.col("kind") == 0) & F.col("embedding").isNotNull() & F.col("result").isNotNull()))
    bucket = F.floor(F.unix_micros("at") / width).cast("long")
    return (rows.withColumn("bucket", F.explode(F.when(F.col("kind") == 0, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))))
            .groupBy("tenant_id", "bucket").transformWithStateInPandas(
                statefulProcessor=CacheLookup(width, threshold, decimals), outputMode="Append", timeMode="EventTime",
                outputStructType="tenant_id string, query_id long, item_id long, similarity double, cache_hit boolean, rca_result string"))


def moments(values: list[int]) -> tuple[int, float, float]:
    """Count, mean and population deviation, rounded as the batch form's aggregates round them: values that lie on the
    threshold fall on the same side."""
    mean = spread = 0.0
    for n, x in enumerate(values, 1):
        step = x - mean
        mean += step / n
        spread += step * (step - step / n)
    return len(values), sum(values) / len(values) if values else 0.0, (spread / len(values)) ** 0.5 if values else 0.0


class Crossing(Settled):
    """State: counts of the buckets of the last two windows of a series, the open one last."""

    held_schema = "at long, id long, error boolean"
    columns = ["tenant_id", "service", "bucket", "metric", "log_id", "ts", "count_at_crossing", "z_score"]

    def __init__(self, window_s: int, bucket_s: int, threshold: float, min_points: int):
        self.window_s, self.bucket_s, self.threshold, self.min_points = window_s, bucket_s, threshold, min_points

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.past = handle.getListState("past", "bucket long, errors long, volume long")

    def fields(self, pdf: pd.DataFrame) -> list[tuple]:
        return list(zip(_us(pdf["ts"]).tolist(), pdf["log_id"].tolist(), pdf["level"].isin(ERROR_LEVELS).tolist()))

    def settle(self, key: tuple, ready: list[tuple], now: int) -> list[tuple]:
        past = deque(list(r) for r in self.past.get()) if self.past.exists() else deque()
        out, base = [], {}
        for at, log_id, error in ready:
            bucket = at // 1_000_000 // self.bucket_s * self.bucket_s
            if not past or past[-1][0] != bucket:
                while past and past[0][0] < bucket - 2 * self.window_s:
                    past.popleft()
                past.append([bucket, 0, 0])
                base = {}
            if not base:
                closed = [p for p in past if p[0] <= bucket - self.bucket_s]
                base = {"errors": [p[1] for p in closed if p[1]], "volume": [p[2] for p in closed]}
                base = {m: moments(v) for m, v in base.items()}
            for column, metric in ((1, "errors"), (2, "volume")):
                if metric == "errors" and not error:
                    continue
                past[-1][column] += 1
                points, mean, std = base[metric]
                if points < self.min_points or not std:
                    continue
                n = past[-1][column]
                z = (n - mean) / std
                if z > self.threshold and (n == 1 or (n - 1 - mean) / std <= self.threshold):
                    out.append((key[0], key[1], bucket, metric, log_id, pd.Timestamp(at, unit="us"), n, round(z, 4)))
        if ready:
            self.past.put([tuple(p) for p in past])
        return out


def zscore_per_event_stream(logs: DataFrame, *, window_s: int = 3600, bucket_s: int = 60, threshold: float = 3.0,
                            min_points: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """The event at which a bucket first crosses the threshold, as the events come: closed buckets of the series are the
    baseline, the open one counts on."""
    use_rocksdb(logs.sparkSession)
    return (timed(logs.select("tenant_id", "service", "log_id", "ts", "level"), "ts", lateness, F.col("log_id").isNotNull()).groupBy("tenant_id", "service")
            .transformWithStateInPandas(
                statefulProcessor=Crossing(window_s, bucket_s, threshold, min_points), outputMode="Append", timeMode="EventTime",
                outputStructType="tenant_id string, service string, bucket long, metric string, log_id long, ts timestamp, "
                                 "count_at_crossing long, z_score double"))


class Spend(Settled):
    """State: what a tenant has spent on a day so far, in billionths, up to the watermark."""

    held_schema = "at long, kind int, id string, severity string, nano long"
    columns = ["incident_id", "tenant_id", "severity", "spend"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.total = handle.getValueState("total", "nano long")

    def ends(self, key: tuple) -> int:
        return (int(key[1]) + 1) * 86_400_000_000

    def fields(self, pdf: pd.DataFrame) -> list[tuple]:
        return [(int(t), int(k), i, None if pd.isna(s) else s, int(n)) for t, k, i, s, n in
                zip(_us(pdf["at"]), pdf["kind"], pdf["id"], pdf["severity"], pdf["nano"])]

    def settle(self, key: tuple, ready: list[tuple], now: int) -> list[tuple]:
        total, out = self.total.get()[0] if self.total.exists() else 0, []
        for _, kind, name, severity, nano in sorted(ready, key=lambda r: r[:3]):
            total += nano
            if kind == 1:
                out.append((name, key[0], severity, total / 1e9))
        if now > self.ends(key):
            self.total.clear()
        elif ready:
            self.total.update((total,))
        return out


def spend_events(incidents: DataFrame, evals: DataFrame) -> DataFrame:
    """Costs (kind 0) and incidents (kind 1) as one timeline: tenant_id, at, kind, id, severity, nano."""
    nano = (F.col("cost_usd").cast("decimal(28,9)") * 1_000_000_000).cast("long")
    return evals.select("tenant_id", F.col("evaluated_at").alias("at"), F.lit(0).alias("kind"), F.col("eval_id").alias("id"),
                        F.lit(None).cast("string").alias("severity"), F.coalesce(nano, F.lit(0)).alias("nano")).unionByName(
        incidents.select("tenant_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.col("incident_id").alias("id"),
                         "severity", F.lit(0).cast("long").alias("nano")))


def route_stream(events: DataFrame, tenants: DataFrame, *, lateness: str = "10 minutes", **options) -> DataFrame:
    """``route`` over a stream of ``spend_events``: an incident is routed once the watermark has passed it, by all costs of its
    tenant's day up to then. A cost that is later than that counts for no incident; one that is late, but within the
    lateness, counts at its own time. The table of tenants is broadcast: the micro-batch that only runs timers has no input, so
    Spark takes its results for empty and would send all of them through the driver instead."""
    use_rocksdb(events.sparkSession)
    day = F.floor(F.unix_micros("at") / 86_400_000_000).cast("long")
    spent = (timed(events, "at", lateness, F.col("id").isNotNull()).withColumn("day", day).groupBy("tenant_id", "day").transformWithStateInPandas(
        statefulProcessor=Spend(), outputMode="Append", timeMode="EventTime",
        outputStructType="incident_id string, tenant_id string, severity string, spend double"))
    return routed_columns(spent, F.broadcast(tenants), **options)


class Steps(StatefulProcessor):
    """State: the next step of an investigation and the steps that came before their turn."""

    def __init__(self, first: int, idle_us: int):
        self.first, self.idle_us = first, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "number long")
        self.held = handle.getListState("held", "step_number long, step_type string, at long")

    def release(self, key: tuple, held: list[tuple], whole: bool) -> pd.DataFrame:
        """Steps in order as far as none is missing (or all, at the end), up to the first 'complete'; -1: nothing is due any
        more."""
        due = self.next.get()[0] if self.next.exists() else self.first
        out, left = [], []
        for number, kind, at in sorted(held):
            if due < 0 or number < due and not whole:
                continue  # after the end, or a repeat
            if number > due and not whole:
                left.append((number, kind, at))
                continue
            out.append((key[0], number, kind))
            due = -1 if kind == "complete" else number + 1
        self.next.update((due,))
        self.held.put(left) if left and due >= 0 else self.held.clear()
        return pd.DataFrame(out, columns=["rca_id", "step_number", "step_type"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        at = _us(pdf["at"])
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        held += list(zip(pdf["step_number"].tolist(), pdf["step_type"].tolist(), at.tolist()))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((int(at.max()) + self.idle_us) // MS + 1)
        yield self.release(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        yield self.release(key, held, True)
        self.next.clear()
        self.held.clear()

    def close(self) -> None:
        pass


def step_stream(steps: DataFrame, *, first: int = 1, idle_s: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Steps (rca_id, step_number, step_type, at) in order up to the first 'complete', as they come.

    A step waits until those before it have come. An investigation without news for ``idle_s`` is over: what still waits
    comes out in order, and its state goes.
    """
    use_rocksdb(steps.sparkSession)
    return (timed(steps.select("rca_id", "step_number", "step_type", "at"), "at", lateness, F.col("step_number").isNotNull()).groupBy("rca_id")
            .transformWithStateInPandas(
                statefulProcessor=Steps(first, idle_s * 1_000_000), outputMode="Append", timeMode="EventTime",
                outputStructType="rca_id string, step_number long, step_type string"))


def merge_detectors_stream(stat: DataFrame, sem: DataFrame, keys: list[str], *, at: str = "at", lateness: str = "10 minutes") -> DataFrame:
    """``merge_detectors`` over two streams with a time column each. Both results of a key carry the same time; one that
    finds no other comes out when the watermark has passed it."""
    left = timed(stat, at, lateness, F.col(keys[0]).isNotNull()).select(*keys, at, F.struct(
        "anomaly_type", "severity", "confidence", "z_score", "current_value", "baseline_mean").alias("s"))
    right = timed(sem, at, lateness, F.col(keys[0]).isNotNull()).select(*keys, at, F.struct(
        "anomaly_type", "severity", "confidence", "similarity", "nearest_message").alias("m"))
    return merged_columns(left.join(right, [*keys, at], "full"), keys)
