"""Anomaly detection: bucket counts, Z-scores, novelty, merging, cooldown and alert rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.scoring import distance_severity, severity_rank, stable_id, zscore_severity
from emberwatch.functions.text import iso, plain_number
from emberwatch.operators.ordered import attach, newest, running, with_chunk
from emberwatch.operators.vectors import nearest_exact, unit_rows
from emberwatch.session import shared_dir

ERROR_LEVELS = ("ERROR", "FATAL")
SERIES = ["tenant_id", "service"]

# Detector names on the wire.
WIRE_TYPES = {
    "error_rate_spike": "statistical",
    "volume_spike": "statistical",
    "new_error_pattern": "semantic",
    "combined": "combined",
}


def bucket_start(ts: Column, bucket_s: int) -> Column:
    """Epoch second at which the bucket of ``ts`` starts."""
    return (F.floor(F.unix_timestamp(ts) / F.lit(bucket_s)) * bucket_s).cast("long")


def bucket_counts(logs: DataFrame, *, bucket_s: int = 60) -> DataFrame:
    """Errors and volume per (tenant, service, bucket); buckets without logs do not appear."""
    return (logs.groupBy(*SERIES, bucket_start(F.col("ts"), bucket_s).alias("bucket"))
            .agg(F.count_if(F.col("level").isin(*ERROR_LEVELS)).alias("errors"),
                 F.count("*").alias("volume")))


def zscore(buckets: DataFrame, *, window_s: int = 3600, bucket_s: int = 60) -> DataFrame:
    """Z-score of each bucket against the earlier buckets of the last two windows, per metric.

    Both metrics share one shuffle and one sort. The error series has only buckets with errors.
    ``z_score`` is null for an empty or flat baseline.
    """
    past = (Window.partitionBy(*SERIES).orderBy("bucket").rangeBetween(-2 * window_s, -bucket_s))
    series = {"errors": F.when(F.col("errors") > 0, F.col("errors")), "volume": F.col("volume")}
    wide = buckets.withColumns({
        f"_{name}": F.struct(
            F.lit(name).alias("metric"), value.cast("double").alias("current_value"),
            F.avg(value).over(past).alias("baseline_mean"),
            F.stddev_pop(value).over(past).alias("baseline_std"),
            F.count(value).over(past).alias("baseline_points"))
        for name, value in series.items()})
    return (wide.select(*SERIES, "bucket", F.inline(F.array("_errors", "_volume")))
            .where(F.col("current_value").isNotNull())
            .withColumn("z_score", F.when(
                F.col("baseline_std") > 0,
                F.try_divide(F.col("current_value") - F.col("baseline_mean"), F.col("baseline_std")))))


def zscore_anomalies(scored: DataFrame, *, threshold: float = 3.0, min_points: int = 5) -> DataFrame:
    """Buckets strictly above the threshold with enough baseline, graded."""
    z = F.col("z_score")
    return (scored.where((F.col("baseline_points") >= min_points) & (z > threshold))
            .select(*SERIES, "bucket", "metric",
                    F.when(F.col("metric") == "errors", "error_rate_spike").otherwise("volume_spike")
                     .alias("anomaly_type"),
                    zscore_severity(z).alias("severity"),
                    F.least(F.lit(1.0), (z - threshold) / threshold).alias("confidence"),
                    "current_value", "baseline_points",
                    F.round("baseline_mean", 4).alias("baseline_mean"), F.round(z, 4).alias("z_score"),
                    F.lit(threshold).alias("threshold")))


def spike_priority(anomalies: DataFrame) -> DataFrame:
    """One result per bucket: an error spike hides a volume spike."""
    others = [c for c in anomalies.columns if c not in (*SERIES, "bucket")]
    first = F.min_by(F.struct(*others), F.when(F.col("metric") == "errors", 0).otherwise(1))
    return anomalies.groupBy(*SERIES, "bucket").agg(first.alias("r")).select(*SERIES, "bucket", "r.*")


def zscore_per_event(logs: DataFrame, *, window_s: int = 3600, bucket_s: int = 60,
                     threshold: float = 3.0, min_points: int = 5, slice_s: int = 1) -> DataFrame:
    """The event at which each anomalous bucket first crosses the threshold.

    Counts only grow inside a bucket, so the crossing event is the n-th one, with n known from the
    baseline; only events of crossing buckets are ranked, in slices of ``slice_s`` seconds.
    """
    scored = zscore(bucket_counts(logs, bucket_s=bucket_s), window_s=window_s, bucket_s=bucket_s)
    need = (scored.where((F.col("baseline_points") >= min_points) & (F.col("z_score") > threshold))
            .select(*SERIES, "bucket", "metric", "baseline_mean", "baseline_std"))
    events = (logs.select(*SERIES, "log_id", "ts", "level")
              .withColumn("bucket", bucket_start(F.col("ts"), bucket_s)))
    hits = (events.join(need, [*SERIES, "bucket"])
            .where((F.col("metric") == "volume") | F.col("level").isin(*ERROR_LEVELS)))
    ranked = running(with_chunk(hits, F.col("ts"), slice_s), [*SERIES, "bucket", "metric"],
                     ["ts", "log_id"], {"n": ("count", "log_id")})
    z = (F.col("n") - F.col("baseline_mean")) / F.col("baseline_std")
    before = (F.col("n") - 1 - F.col("baseline_mean")) / F.col("baseline_std")
    return (ranked.where((z > threshold) & ((F.col("n") == 1) | (before <= threshold)))
            .select(*SERIES, "bucket", "metric", "log_id", "ts", F.col("n").alias("count_at_crossing"),
                    F.round(z, 4).alias("z_score")))


def novelty_severity(df: DataFrame, *, distance: str = "distance") -> DataFrame:
    return df.withColumns({"severity": distance_severity(F.col(distance)), "confidence": F.col(distance)})


def novel_vs_baseline(queries: DataFrame, baseline: DataFrame, *, threshold: float = 0.7,
                      block_rows: int = 4096, cell_rows: int = 2048) -> DataFrame:
    """Queries whose best cosine against the frozen baseline of their (tenant, service) is below
    the threshold. A series without baseline is a cold start and yields nothing. A query that is found to be
    known in its nearest cells meets no other."""
    best = nearest_exact(queries, baseline, SERIES, k=1, block_rows=block_rows, cell_rows=cell_rows, enough=threshold)
    return (best.where(F.col("similarity") < threshold)
            .withColumn("distance", F.lit(1.0) - F.col("similarity")))


def _nearer(best: np.ndarray, near: np.ndarray, sims: np.ndarray, ids: np.ndarray | float) -> np.ndarray:
    """Id of the nearest stored row after new similarities: the larger one, at a tie the smaller id."""
    closer = np.isnan(best) | (sims > best) | ((sims == best) & (ids < near))
    return np.where(closer, ids, near)


def _greedy(threshold: float):
    """Leader clustering of one bounded block whose rows are already unlike all earlier leaders."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"], kind="stable").reset_index(drop=True)
        m = unit_rows(pdf["embedding"])
        best = pdf["best"].to_numpy(dtype=float, na_value=np.nan)
        near, ids = pdf["near"].to_numpy(dtype=float, na_value=np.nan), pdf["id"].to_numpy(dtype=float)
        leader = np.zeros(len(pdf), dtype=bool)
        for i in range(len(pdf)):
            if np.isnan(best[i]) or best[i] < threshold:
                leader[i] = True
                sims = np.round(m[i + 1:] @ m[i], 9)
                near[i + 1:] = _nearer(best[i + 1:], near[i + 1:], sims, ids[i])
                best[i + 1:] = np.fmax(best[i + 1:], sims)
        # A row decided "known" needs no further use; its best is the similarity when it arrived.
        return pdf.assign(best=best, near=pd.array(near).astype("Int64"), leader=leader)

    return run


def _prune(pdf: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
    if len(pdf) and len(leaders):
        leaders = leaders.sort_values("id", kind="stable")
        all_sims = np.round(unit_rows(pdf["embedding"]) @ unit_rows(leaders["embedding"]).T, 9)
        sims, ids = all_sims.max(axis=1), leaders["id"].to_numpy(dtype=float)[all_sims.argmax(axis=1)]
        best, near = (pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in ("best", "near"))
        pdf = pdf.assign(best=np.fmax(best, sims), near=pd.array(_nearer(best, near, sims, ids)).astype("Int64"))
    return pdf


def semantic_novelty(logs_vec: DataFrame, *, threshold: float = 0.7, block_rows: int = 1000) -> DataFrame:
    """Online novelty per (tenant, service), in arrival order (``ts``, ``id``).

    The first row of a series is stored silently; a later row is novel, and stored, if its best
    similarity to the stored rows is below the threshold. Columns in: tenant_id, service, id, ts,
    embedding. Exact, in rounds: the next ``block_rows`` undecided rows of every series are settled
    by a bounded fold; all remaining rows are then scored against the new stored rows in parallel
    (a hot series is cut into parts of about ``block_rows``) and known ones drop out.
    """
    shared_dir(logs_vec.sparkSession)
    plain = "tenant_id string, service string, id long, ts timestamp, embedding array<float>, best double, near long"
    cols = ["tenant_id", "service", "id", "ts", "embedding", "best", "near"]
    rest = logs_vec.select(*SERIES, F.col("id").cast("long").alias("id"), "ts",
                           F.col("embedding").cast("array<float>").alias("embedding"),
                           F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("near"))
    out: DataFrame | None = None
    while True:
        head = newest(rest, SERIES, ["ts", "id"], block_rows).drop("_rank")
        settled = (head.groupBy(*SERIES).applyInPandas(_greedy(threshold), plain + ", leader boolean")
                   .checkpoint())
        novel = (settled.where(F.col("leader") & F.col("best").isNotNull() & ~F.isnan("best"))
                 .select(*SERIES, "id", "ts", F.col("best").alias("similarity"), F.col("near").alias("nearest_id")))
        out = novel if out is None else out.unionByName(novel)
        # Every row up to the last one of the block is decided; later rows go to the next round.
        last = settled.groupBy(*SERIES).agg(F.max(F.struct("ts", "id")).alias("_last"))
        later = rest.join(last, SERIES).where(F.struct("ts", "id") > F.col("_last")).drop("_last")
        if later.isEmpty():
            break
        parts = (later.groupBy(*SERIES).agg(F.ceil(F.count("*") / block_rows).cast("long").alias("_parts")))
        salted = (later.join(parts, SERIES)
                  .withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("_parts"))
        spread = (settled.where("leader").join(parts, SERIES)
                  .select(*[F.col(c).alias(c) for c in (*SERIES, "id", "embedding")],
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_salt")))
        pruned = (salted.groupBy(*SERIES, "_salt").cogroup(spread.groupBy(*SERIES, "_salt"))
                  .applyInPandas(lambda a, b: _prune(a, b)[cols], plain))
        undecided = F.col("best").isNull() | F.isnan("best") | (F.col("best") < threshold)
        rest = pruned.where(undecided).checkpoint()
    return novelty_severity(out.withColumns({"distance": F.lit(1.0) - F.col("similarity"),
                                             "anomaly_type": F.lit("new_error_pattern")}))


def novelty_per_bucket(novel: DataFrame, logs: DataFrame, *, bucket_s: int = 60) -> DataFrame:
    """The most distant novel log of each (tenant, service, bucket), as ``merge_detectors`` takes it: with the message
    of the stored log it came nearest to. Ties go to the smaller id."""
    order = F.struct("distance", (-F.col("id")).alias("_i"))
    top = (novel.withColumn("bucket", bucket_start(F.col("ts"), bucket_s)).groupBy(*SERIES, "bucket")
           .agg(F.max_by(F.struct("id", "similarity", "distance", "nearest_id", "anomaly_type", "severity", "confidence"), order).alias("_t"))
           .select(*SERIES, "bucket", "_t.*"))
    said = logs.select(F.col("log_id").alias("nearest_id"), "tenant_id", F.col("message").alias("nearest_message"))
    return top.join(said, ["nearest_id", "tenant_id"], "left")


def evict_oldest(baseline: DataFrame, *, max_size: int, batch: int, chunk_s: int = 3600) -> DataFrame:
    """Rows that survive when every insert above ``max_size`` evicts the tenant's oldest ``batch`` rows.

    Rows arrive by (``ts``, ``id``). The first eviction comes with row ``max_size + 1``, the next ones after every
    ``batch`` rows, so a tenant of n rows has seen ``1 + floor((n - max_size - 1) / batch)`` of them. Places in the
    order come from running counts over time chunks, so no tenant is sorted in one task.
    """
    sizes = baseline.groupBy("tenant_id").agg(F.count("*").alias("_n"))
    gone = F.when(F.col("_n") > max_size, (1 + F.floor((F.col("_n") - max_size - 1) / batch)) * batch).otherwise(0)
    placed = running(with_chunk(baseline, F.col("ts"), chunk_s), ["tenant_id"], ["ts", "id"], {"_place": ("count", "id")})
    return placed.join(sizes, "tenant_id").where(F.col("_place") > gone).select(*baseline.columns)


def merge_detectors(stat: DataFrame, sem: DataFrame, keys: list[str]) -> DataFrame:
    """One result per key from both detectors; when both fired, 'combined' with the higher severity
    (tie: statistical) and the larger confidence."""
    left = stat.select(*keys, F.struct("anomaly_type", "severity", "confidence", "z_score",
                                       "current_value", "baseline_mean").alias("s"))
    right = sem.select(*keys, F.struct("anomaly_type", "severity", "confidence", "similarity",
                                       "nearest_message").alias("m"))
    return merged_columns(left.join(right, keys, "full"), keys)


def merged_columns(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Results of both detectors per key as structs ``s`` and ``m``, one of them null where the other fired alone, as one."""
    s, m = F.col("s"), F.col("m")
    both = s.isNotNull() & m.isNotNull()
    return (joined
            .select(*keys,
                    F.when(both, "combined").otherwise(F.coalesce(s.anomaly_type, m.anomaly_type))
                     .alias("anomaly_type"),
                    F.when(both & (severity_rank(m.severity) > severity_rank(s.severity)), m.severity)
                     .otherwise(F.coalesce(s.severity, m.severity)).alias("severity"),
                    F.greatest(s.confidence, m.confidence).alias("confidence"),
                    s.z_score.alias("z_score"), s.current_value.alias("current_value"),
                    s.baseline_mean.alias("baseline_mean"), m.similarity.alias("similarity"),
                    m.nearest_message.alias("nearest_message")))


def anomaly_description(merged: DataFrame, *, threshold: float = 0.7, preview: int | None = None) -> DataFrame:
    """Wire type and the sentence given to reviewers."""
    numbers = {n for n, t in merged.dtypes if t == "double"}

    def text(c: str) -> Column:
        return F.coalesce(plain_number(F.col(c)) if c in numbers else F.col(c).cast("string"), F.lit("?"))

    kind = F.col("anomaly_type")
    wire = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for pair in WIRE_TYPES.items() for x in pair]), kind), F.lit("statistical"))
    near = F.coalesce(F.col("nearest_message"), F.lit(""))
    # The words of the sentences that reviewers are given.
    described = (
        F.when(kind == "error_rate_spike", F.concat(
            F.lit("Error rate spike: Z-score="), text("z_score"), F.lit(", current="), text("current_value"),
            F.lit(" errors/bucket vs baseline mean="), text("baseline_mean")))
        .when(kind == "volume_spike", F.concat(
            F.lit("Log volume spike: Z-score="), text("z_score"), F.lit(", current="), text("current_value"),
            F.lit(" logs/bucket vs baseline mean="), text("baseline_mean")))
        .when(kind == "new_error_pattern", F.concat(
            F.lit("Novel error pattern detected: similarity="), text("similarity"),
            F.lit(f" below threshold={threshold}"),
            F.when(near != "", F.concat(F.lit(". Nearest known pattern: '"), near if preview is None else F.substring(near, 1, preview), F.lit("'")))
             .otherwise(F.lit(""))))
        .when(kind == "combined", F.concat(
            F.lit("Multiple anomaly signals: statistical Z-score="), text("z_score"),
            F.lit(", semantic similarity="), text("similarity")))
        .otherwise(F.concat(F.lit("Anomaly type '"), kind, F.lit("' at severity "), F.col("severity"))))
    return merged.withColumns({"wire_type": wire, "description": described})


def _us(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").to_numpy().astype("int64")


def _cooldown_map(cooldown_us: int, chunk_us: int):
    """Per chunk: which last accepted time results from each possible entry point."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(_us(pdf["ts"]))
        n, start = len(t), key[-1] * chunk_us
        nxt = np.searchsorted(t, t + cooldown_us)
        last = np.empty(n, dtype="int64")
        for i in range(n - 1, -1, -1):
            last[i] = t[i] if nxt[i] >= n else last[nxt[i]]
        m = min(int(np.searchsorted(t, start + cooldown_us)) + 1, n)
        entry, exit_ = t[:m], last[:m]
        keep = np.append(exit_[1:] != exit_[:-1], True)  # same result: keep the latest entry point
        return pd.DataFrame({"tenant_id": key[0], "service": key[1], "_chunk": key[-1],
                             "entry": entry[keep], "exit": exit_[keep]})

    return run


def _cooldown_carry(cooldown_us: int):
    """Fold the chunk maps of one series; rows are chunks, not events."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_chunk", "entry"])
        chunks, carries, last = [], [], None
        for chunk, part in pdf.groupby("_chunk", sort=True):
            chunks.append(chunk)
            carries.append(last)
            entry, exit_ = part["entry"].to_numpy(), part["exit"].to_numpy()
            i = 0 if last is None else int(np.searchsorted(entry, last + cooldown_us))
            if i < len(entry):
                last = int(exit_[i])
        return pd.DataFrame({"tenant_id": key[0], "service": key[1], "_chunk": chunks,
                             "carry": pd.array(carries, dtype="Int64")})

    return run


def _cooldown_walk(cooldown_us: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        t = _us(pdf["ts"])
        carry = pdf["carry"].iloc[0]
        at = -(1 << 62) if pd.isna(carry) else int(carry) + cooldown_us
        taken, i = [], int(np.searchsorted(t, at))
        while i < len(t):
            taken.append(i)
            i = int(np.searchsorted(t, t[i] + cooldown_us))
        return pdf.iloc[taken][["tenant_id", "service", "id", "ts"]]

    return run


def alert_cooldown(candidates: DataFrame, *, cooldown_s: int = 60, chunk_s: int | None = None) -> DataFrame:
    """At most one confirmed candidate per (tenant, service) per cooldown, greedily in time order.

    Columns in: tenant_id, service, id, ts; ties on time go to the smaller id. A gap of exactly the
    cooldown accepts. The greedy chain is cut into time chunks: each chunk is reduced to a map from
    entry point to last accepted time (a row per entry point within one cooldown of the chunk's start, at most), the
    maps are folded per series, and
    each chunk is then replayed from its true entry state.
    """
    chunk_s = chunk_s or max(60 * cooldown_s, 3600)
    cooldown_us, chunk_us = cooldown_s * 1_000_000, chunk_s * 1_000_000
    # One candidate per instant is enough: two at the same instant can never both be accepted.
    slim = with_chunk(candidates.groupBy(*SERIES, "ts").agg(F.min("id").alias("id")), F.col("ts"), chunk_s)
    maps = (slim.select(*SERIES, "_chunk", "ts").groupBy(*SERIES, "_chunk")
            .applyInPandas(_cooldown_map(cooldown_us, chunk_us),
                           "tenant_id string, service string, _chunk long, entry long, exit long"))
    carry = (maps.groupBy(*SERIES).applyInPandas(
        _cooldown_carry(cooldown_us), "tenant_id string, service string, _chunk long, carry long"))
    return (attach(slim, carry, SERIES).groupBy(*SERIES, "_chunk")
            .applyInPandas(_cooldown_walk(cooldown_us),
                           f"tenant_id string, service string, id {dict(candidates.dtypes)['id']}, ts timestamp"))


def recent_errors(logs: DataFrame, *, k: int) -> DataFrame:
    return newest(logs.where(F.col("level").isin(*ERROR_LEVELS)), SERIES,
                  [F.desc("ts"), F.desc("log_id")], k)


def is_yes(verdict: str) -> Column:
    return F.startswith(F.upper(F.trim(verdict)), F.lit("YES"))


def verdict_filter(candidates: DataFrame, verdicts: DataFrame, *, key: str = "alert_id") -> DataFrame:
    """Keep candidates whose verdict starts with YES; a missing verdict keeps the candidate."""
    return (candidates.join(verdicts.select(key, "verdict"), key, "left")
            .where(F.coalesce(is_yes("verdict"), F.lit(True))).drop("verdict"))


def alerts(described: DataFrame, *, time_col: str = "bucket") -> DataFrame:
    """Alert rows for accepted anomalies."""
    at = F.col(time_col).cast("timestamp") if time_col == "bucket" else F.col(time_col)
    return described.select(
        stable_id("al-", F.col("tenant_id"), F.col("service"), F.col(time_col).cast("string")).alias("alert_id"),
        *SERIES, F.col("wire_type").alias("anomaly_type"), "severity",
        F.round("confidence", 4).alias("confidence"), at.alias("created_at"),
        iso(at).alias("created_at_text"), "description", F.lit("open").alias("status"))
