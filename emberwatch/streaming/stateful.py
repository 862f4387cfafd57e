"""Streaming forms of the ordered operators: state per key, rows of a micro-batch in time order.

The processors hold only what the rule needs: the last accepted time, the open window, or the
stored patterns. A micro-batch is bounded by the source's trigger options.
"""

from __future__ import annotations

import hashlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberwatch.operators.vectors import unit_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs a store that spills to disk and checkpoints changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _batch(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable").reset_index(drop=True)


def _us(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").to_numpy().astype("int64")


class Cooldown(StatefulProcessor):
    """State: last accepted time."""

    def __init__(self, cooldown_us: int):
        self.cooldown_us = cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "accepted long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, ["ts", "id"])
        t = _us(pdf["ts"])
        i = int(np.searchsorted(t, self.last.get()[0] + self.cooldown_us)) if self.last.exists() else 0
        taken = []
        while i < len(t):
            taken.append(i)
            i = int(np.searchsorted(t, t[i] + self.cooldown_us))
        if taken:
            self.last.update((int(t[taken[-1]]),))
        yield pdf.iloc[taken][["tenant_id", "service", "id", "ts"]]

    def close(self) -> None:
        pass


class Correlator(StatefulProcessor):
    """State: alerts of the open window (at most ``window_us`` long, emptied by a cascade)."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getListState("window", "alert_id string, service string, severity string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, ["created_at", "alert_id"])
        window = deque(self.window.get() if self.window.exists() else [])
        services = Counter(a[1] for a in window)
        out: list[tuple] = []

        def emit(members: Iterable[tuple], trigger: tuple, cascade: bool) -> None:
            text = f"{key[0]}|{trigger[0]}|{str(cascade).lower()}"
            incident = "inc-" + hashlib.sha256(text.encode()).hexdigest()[:32]
            out.extend((incident, key[0], cascade, trigger[3], *m) for m in members)

        for alert in zip(pdf["alert_id"], pdf["service"], pdf["severity"], _us(pdf["created_at"]).tolist()):
            while window and window[0][3] < alert[3] - self.window_us:
                services.subtract([window.popleft()[1]])
            window.append(alert)
            services[alert[1]] += 1
            cascade = any(services[s] for s in services if s != alert[1])
            emit(window if cascade else [alert], alert, cascade)
            if cascade:
                window.clear()
                services.clear()
        self.window.put([tuple(a) for a in window]) if window else self.window.clear()
        cols = ["incident_id", "tenant_id", "is_cascade", "at", "alert_id", "service", "severity", "created_at"]
        done = pd.DataFrame(out, columns=cols)
        for c in ("at", "created_at"):
            done[c] = pd.to_datetime(done[c], unit="us")
        yield done

    def close(self) -> None:
        pass


class Vectors:
    """Rows of a growing matrix; room doubles, so adding stays cheap and one product scores a row against all."""

    def __init__(self) -> None:
        self.n, self.room = 0, None

    def add(self, row: np.ndarray) -> None:
        if self.room is None or self.n == len(self.room):
            bigger = np.empty((max(16, 2 * self.n), len(row)))
            if self.n:
                bigger[:self.n] = self.room
            self.room = bigger
        self.room[self.n] = row
        self.n += 1

    def rows(self) -> np.ndarray:
        return self.room[:self.n]


class ZScore(StatefulProcessor):
    """State: closed buckets of the last two windows of a series."""

    def __init__(self, window_s: int, bucket_s: int):
        self.window_s, self.bucket_s = window_s, bucket_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "bucket long, errors long, volume long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, ["bucket"])
        past = deque(tuple(r) for r in self.past.get()) if self.past.exists() else deque()
        out: list[tuple] = []
        for bucket, errors, volume in zip(pdf["bucket"].tolist(), pdf["errors"].tolist(), pdf["volume"].tolist()):
            while past and past[0][0] < bucket - 2 * self.window_s:
                past.popleft()
            ready = [p for p in past if p[0] <= bucket - self.bucket_s]
            for metric, value, base in (("errors", errors, [p[1] for p in ready if p[1] > 0]), ("volume", volume, [p[2] for p in ready])):
                if metric == "errors" and not errors:
                    continue
                mean, std = (float(np.mean(base)), float(np.std(base))) if base else (None, None)
                z = (value - mean) / std if std else None
                out.append((key[0], key[1], bucket, metric, float(value), mean, std, len(base), z))
            past.append((bucket, errors, volume))
        self.past.put(list(past))
        yield pd.DataFrame(out, columns=["tenant_id", "service", "bucket", "metric", "current_value", "baseline_mean",
                                         "baseline_std", "baseline_points", "z_score"])

    def close(self) -> None:
        pass


class Novelty(StatefulProcessor):
    """State: stored patterns of a tenant; above a given limit the oldest are evicted in batches."""

    def __init__(self, threshold: float, max_size: int | None, evict: int):
        self.threshold, self.max_size, self.evict = threshold, max_size, evict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getListState("stored", "service string, at long, embedding array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows, ["ts", "id"])
        known = [tuple(r) for r in self.stored.get()] if self.stored.exists() else []
        units, t, out = unit_rows(pdf["embedding"]), _us(pdf["ts"]), []
        before, evicted = len(known), False

        def blocks() -> dict[str, Vectors]:
            made: dict[str, Vectors] = {}
            for service, _, vector in known:
                made.setdefault(service, Vectors()).add(np.array(vector))
            return made

        by_service = blocks()
        for i, service in enumerate(pdf["service"]):
            near = by_service.get(service)
            best = round(float((near.rows() @ units[i]).max()), 9) if near else None
            if best is not None and best >= self.threshold:
                continue
            known.append((service, int(t[i]), units[i].tolist()))
            by_service.setdefault(service, Vectors()).add(units[i])
            if best is None:
                continue
            out.append((key[0], service, int(pdf["id"][i]), pdf["ts"][i], best))
            if self.max_size is not None and len(known) > self.max_size:
                known, evicted = sorted(known, key=lambda r: r[1])[self.evict:], True
                by_service = blocks()
        if evicted:
            self.stored.put(known)
        elif len(known) > before:
            self.stored.appendList(known[before:])
        yield pd.DataFrame(out, columns=["tenant_id", "service", "id", "ts", "similarity"])

    def close(self) -> None:
        pass


def zscore_stream(buckets: DataFrame, *, window_s: int = 3600, bucket_s: int = 60) -> DataFrame:
    """Z-scores of closed buckets as they arrive, equal to the batch form.

    Feed it closed buckets (``bucket_counts_stream``): the watermark closes a series' buckets in time order, and
    logs later than that are not in any bucket.
    """
    use_rocksdb(buckets.sparkSession)
    return (buckets.select("tenant_id", "service", "bucket", "errors", "volume").groupBy("tenant_id", "service")
            .transformWithStateInPandas(
                statefulProcessor=ZScore(window_s, bucket_s), outputMode="Append", timeMode="None",
                outputStructType="tenant_id string, service string, bucket long, metric string, current_value double, "
                                 "baseline_mean double, baseline_std double, baseline_points long, z_score double"))


def cooldown_stream(candidates: DataFrame, *, cooldown_s: int = 60) -> DataFrame:
    use_rocksdb(candidates.sparkSession)
    kind = dict(candidates.dtypes)["id"]
    return (candidates.select("tenant_id", "service", "id", "ts").groupBy("tenant_id", "service")
            .transformWithStateInPandas(
                statefulProcessor=Cooldown(cooldown_s * 1_000_000), outputMode="Append", timeMode="None",
                outputStructType=f"tenant_id string, service string, id {kind}, ts timestamp"))


def correlate_stream(alerts: DataFrame, *, window_s: int = 60) -> DataFrame:
    use_rocksdb(alerts.sparkSession)
    return (alerts.select("tenant_id", "alert_id", "service", "severity", "created_at").groupBy("tenant_id")
            .transformWithStateInPandas(
                statefulProcessor=Correlator(window_s * 1_000_000), outputMode="Append", timeMode="None",
                outputStructType="incident_id string, tenant_id string, is_cascade boolean, at timestamp, "
                                 "alert_id string, service string, severity string, created_at timestamp"))


def novelty_stream(logs_vec: DataFrame, *, threshold: float = 0.7, max_size: int | None = None, evict: int = 1_000) -> DataFrame:
    """Keyed by series; with a ``max_size`` by tenant, as eviction counts all services of a tenant together."""
    use_rocksdb(logs_vec.sparkSession)
    return (logs_vec.select("tenant_id", "service", F.col("id").cast("long").alias("id"), "ts", "embedding")
            .groupBy("tenant_id", *(["service"] if max_size is None else []))
            .transformWithStateInPandas(
                statefulProcessor=Novelty(threshold, max_size, evict), outputMode="Append", timeMode="None",
                outputStructType="tenant_id string, service string, id long, ts timestamp, similarity double"))
