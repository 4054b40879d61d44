"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "veritab", **conf) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``, and so should every session. Only a
    local-mode session that names none gets a temporary folder, removed when Python ends; a cluster
    without one is an error, because a folder on one machine is lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="veritab-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
    return _LOCAL_SCRATCH[app]


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the tasks of a shuffle.

    For rows of few bytes that cost much to work on: their files fill few tasks, and adaptive execution merges small partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the scratch folder."""
    return f"{scratch_root(spark)}/veritab/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of what was written.

    Cuts the plan, survives lost executors, and gives Catalyst real sizes, so
    that it broadcasts the result only when the written bytes are few.
    """
    return materialize_counted(df, name)[0]


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``materialize``, and the number of rows, counted while they are written."""
    out, seen = materialize_observed(df, name, n=F.count(F.lit(1)))
    return out, seen["n"]


def materialize_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, and aggregates of the rows, worked out while they are written."""
    path = scratch_path(df.sparkSession, name)
    written = Observation()
    df.observe(written, *[m.alias(k) for k, m in metrics.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), written.get
