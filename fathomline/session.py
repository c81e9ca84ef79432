"""Session helpers: building a session, shared scratch space, cut points."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine is tuned for."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fathomline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_workers_import(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package.

    A cluster gets the package with ``--py-files``; this only helps sessions
    whose workers start on the driver's file system.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


_TRACKED: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting (tests, a laptop) gets a folder of
    its own; on a cluster the setting is needed, as executors could not read
    each other's disks. What the application wrote is deleted when it ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_fathomline_scratch", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="fathomline-")
            spark._fathomline_scratch = base
    folder = f"{base.rstrip('/')}/fathomline/{spark.sparkContext.applicationId}"
    if getattr(spark, "_fathomline_folder", None) != folder:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        spark._fathomline_folder = folder
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _TRACKED:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside the block when it ends, after its results were read."""
    paths: list[str] = []
    _TRACKED.append(paths)
    try:
        yield
    finally:
        _TRACKED.remove(paths)
        for path in paths:
            drop_path(spark, path)


def materialize(df: DataFrame, label: str, path: str | None = None) -> tuple[DataFrame, int, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner
    true sizes. Returns the table, its row count and its path.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    counter = Observation()
    df.observe(counter, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(counter.get.get("n", 0)), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes above which no table is marked for broadcast.
BROADCAST_BYTES = 256 << 20


def checked_broadcast(df: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is small in rows and in bytes (both measured); beyond that the planner joins it by shuffle."""
    size = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
    measured = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if measured["n"] <= most_rows and measured["bytes"] <= most_bytes else df
