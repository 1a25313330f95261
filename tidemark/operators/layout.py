"""Comparing layouts of one table."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sinks import time_range


def single_day(df: DataFrame, ts: str, region: str, value: str, day: str) -> DataFrame:
    """Q1: one day, by region."""
    next_day = f"date_add(DATE'{day}', 1)"
    rows = df.where(f"{ts} >= DATE'{day}' AND {ts} < {next_day}")
    return rows.groupBy(region).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"))


def one_region(df: DataFrame, ts: str, region: str, value: str, name: str) -> DataFrame:
    """Q2: one region, all time, by day."""
    return df.where(F.col(region) == name).groupBy(F.to_date(ts).alias("day")).agg(F.avg(value).alias("avg_value"), F.max(value).alias("max_value"))


def some_months(df: DataFrame, ts: str, region: str, value: str, names: list[str], start: str, end: str) -> DataFrame:
    """Q3: two regions over a range of time."""
    rows = time_range(df, ts, start, end).where(F.col(region).isin(*names))
    return rows.groupBy(region).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"))


def full_scan(df: DataFrame, region: str, value: str) -> DataFrame:
    """Q4: everything, by region."""
    return df.groupBy(region).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def timed(spark: SparkSession, runs: Mapping[tuple[str, str], Callable[[], DataFrame]]) -> DataFrame:
    """Seconds of each (query, layout), rows written nowhere."""
    rows = []
    for (query, layout), make in runs.items():
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        rows.append((query, layout, time.perf_counter() - began))
    return spark.createDataFrame(rows, "query string, layout string, seconds double")


def winners(times: DataFrame, first: str, second: str, margin: float = 1.1) -> DataFrame:
    """O2: which of two layouts is faster by more than ``margin``, for each query."""
    t = times.groupBy("query").pivot("layout", [first, second]).agg(F.min("seconds"))
    return t.withColumn("winner", F.when(F.col(first) * margin < F.col(second), first).when(F.col(second) * margin < F.col(first), second).otherwise("similar"))


def analyze(spark: SparkSession, table: str) -> None:
    """O3: statistics of the table and all its columns, for the optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def file_report(df: DataFrame) -> DataFrame:
    """Files, bytes and mean bytes of what a DataFrame reads, and folders that hold files; only metadata is read."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("bytes"), F.avg("file_size").alias("avg_bytes"), F.countDistinct(folder).alias("n_folders"))
