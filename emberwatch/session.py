"""Session helpers: the few settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "emberwatch", master: str | None = None, **conf) -> SparkSession:
    """A session for local runs and tests; on a cluster pass none and use the submitted conf."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what the semantics depend on: UTC days and weeks, timestamps as instants. Where the cluster leaves Spark's default
    of 64 MB of shuffled (compressed) rows per task, a quarter: sorts and hash tables of a task take some twenty times that."""
    if spark.conf.get(ADVISORY) in ("64MB", "67108864b"):
        spark.conf.set(ADVISORY, "16MB")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Zone-less Parquet timestamps are UTC here; reading them as instants keeps filters pushable.
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's checkpoint folder. Only a local master gets a new one if unset."""
    known = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
        known = spark.sparkContext.getCheckpointDir()
    return known


def run_dir(spark: SparkSession) -> str:
    """Folder of this application below the shared one: all that its queries write on the way."""
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> bool:
    """Remove what this application's queries have written on the way, once their results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the run's folder and read again, for a result that several branches of a plan use."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
