"""Working folder for intermediate tables.

On a cluster the folder is the shared one named by spark.checkpoint.dir. Only a
local session without that setting falls back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_held = threading.local()
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CODEC = "zstd"  # texts and nested rows take half of what the session's usual codec leaves of them


def work_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="diamondlap-")
    return _local[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name, removed again when the application ends."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    if getattr(_held, "paths", None) is not None:
        _held.paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Folders named by fresh_path() inside are removed at its end already, so what is returned from it must not read them."""
    outer, _held.paths = getattr(_held, "paths", None), []
    try:
        yield
    finally:
        paths, _held.paths = _held.paths, outer
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def save(df: DataFrame, path: str, mode: str = "errorifexists", by: Sequence[str] = (), **options: str) -> None:
    """Write df as Parquet. Its shuffles are removed once it is written, not when the driver happens to collect garbage."""
    spark = df.sparkSession
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.mode(mode).options(compression=CODEC, **options).partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once and read it back, so that several readers share the work
    and a lost executor costs no recomputation of what came before."""
    path = fresh_path(df.sparkSession, label)
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def joined_in_place(spark: SparkSession):
    """What is run inside joins two tables that are partitioned by some of the keys where they lie, instead of
    shuffling both by all keys."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage_by_game(df: DataFrame, label: str) -> DataFrame:
    """As stage(), for what is made of pitches that lie by game."""
    with joined_in_place(df.sparkSession):
        return stage(df, label)
