"""Folders for what a job writes for itself: checkpoints and files of one run."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that ``once`` filled, by application and key.
_FILLED: dict[tuple, str] = {}

#: Largest size in bytes that Catalyst may estimate for a side before it is no longer broadcast by hint.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, only where the optimizer's size estimate is under the limit; else the planner decides."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, local mode takes a folder of its own, as its
    tasks share the machine; on a cluster it is an error, since no folder of one machine will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files of a run, under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as files of the checkpoint folder: cut off from their lineage, and of a size that the planner knows."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def once(spark: SparkSession, key: tuple, make: Callable[[str], None]) -> str:
    """The folder that ``make`` fills, filled once for an application and key; anew if it is gone. No session is kept."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _FILLED or not exists(spark, _FILLED[key]):
        folder = scratch(spark, str(key[1]))
        make(folder)
        _FILLED[key] = folder
    return _FILLED[key]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    at, store = _at(spark, path)
    store.delete(at, True)


def commit(spark: SparkSession, folder: str, name: str, record: dict) -> None:
    """Write a small record under a name, whole or not at all. Readers see what it vouches for from then on."""
    at, store = _at(spark, f"{folder}/{name}.json")
    new, _ = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = store.create(new)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    if not store.rename(new, at):
        store.delete(new, False)
        raise RuntimeError(f"can't write {at}")


def committed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The records of a folder; none if nothing was ever written there."""
    return spark.read.schema(schema).json(folder) if exists(spark, folder) else spark.createDataFrame([], schema)
