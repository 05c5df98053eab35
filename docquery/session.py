"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. None of them sizes the cluster: executors, memory
# and shuffle partitions belong to the submitter.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches end at this size, so a worker's memory follows it and not the length of texts.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app_name: str = "docquery", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_conf(spark: SparkSession) -> SparkSession:
    """Bring a foreign session to the settings the operators assume."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, local mode makes one per application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL_DIRS:
            _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="docquery-")
        named = _LOCAL_DIRS[application]
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused, so a rerun cannot read half a write."""
    return f"{shared_dir(spark)}/docquery/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str, **options):
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, key: str):
    """Use all cores for heavy per-row work on a source that comes in fewer splits than cores.

    A source with enough splits, as any large one has, is returned as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
