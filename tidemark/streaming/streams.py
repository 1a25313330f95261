"""Structured Streaming: file streams, watermarked joins, ticks, rollups, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions import columns as C
from tidemark.operators.clean import only_rows, project, stamp
from tidemark.operators.joins import small
from tidemark.operators.quality import expect_or_drop
from tidemark.sources import reports


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", max_files: int | None = None, **options) -> DataFrame:
    """Files of a folder as they come, ``max_files`` a batch at most."""
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def csv_stream(spark: SparkSession, path: str, schema: StructType | str, mapping: Mapping[str, tuple[str, str]], row_type: str | None = "ROW_TYPE") -> DataFrame:
    """A folder of CSV files; data rows only, times and numbers parsed, renamed. Columns bind by their position
    in ``schema``, whose names the header has to have."""
    rows = file_stream(spark, path, schema, "csv", header=True, enforceSchema=False)
    return project(only_rows(rows, "D", row_type) if row_type else rows, mapping)


def report_stream(spark: SparkSession, path: str, table: str, max_files: int = 10) -> DataFrame:
    """A folder of report ZIPs as a stream of a table's rows. A file that can't be read fails the batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return reports.scan(file_stream(spark, path, schema, "binaryFile", max_files, pathGlobFilter="*.zip"), table)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def bronze(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Ingest stamp, then the rules; a rule on the stamp keeps out what is older than it says."""
    return expect_or_drop(stamp(df), rules)


def watermarked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, delay: str = "2 minutes") -> DataFrame:
    """Inner join of two streams on their keys, the event time among them.

    Equal times bound the state: rows older than both watermarks are dropped from it, and late ones never join.
    """
    a = event_time(left, ts).withWatermark(ts, delay)
    b = event_time(right, ts).withWatermark(ts, delay)
    return a.join(b, list(keys))


def with_static(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream with a static table, read anew each batch; broadcast only if it is known to be small."""
    return stream.join(small(static), key, "left")


def half_hour_ticks(df: DataFrame, ts: str, delay: str = "2 hours", minutes: int = 30) -> DataFrame:
    """One row for each half hour that is seen. The slot itself carries the watermark, so its state is evicted."""
    slots = event_time(df, ts).where(F.minute(ts) % minutes == 0).select(F.date_trunc("minute", F.col(ts)).alias("refresh_slot"))
    return slots.withWatermark("refresh_slot", delay).dropDuplicates(["refresh_slot"])


def expand_observations(ticks: DataFrame, documents: DataFrame, slot: str, text: str, schema: str) -> DataFrame:
    """Ticks joined with documents of JSON lists by slot; a row an element, typed by ``schema``."""
    joined = ticks.join(documents, slot)
    return joined.select(slot, F.explode(F.from_json(text, f"array<struct<{schema}>>")).alias("o")).select(slot, "o.*")


def hourly_stream(df: DataFrame, ts: str, region: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """Hourly figures of a stream; an hour comes out once the watermark has passed its end."""
    w = event_time(df, ts).withWatermark(ts, delay).groupBy(F.window(ts, "1 hour").alias("w"), region)
    return w.agg(F.avg(value).alias("avg_value"), F.max(value).alias("max_value"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), region, "avg_value", "max_value", "n")


def append_table(df: DataFrame, table: str, checkpoint: str, interval: str | None = "5 minutes") -> StreamingQuery:
    """Append to a table; what was read is in the checkpoint. Without an interval: what is there now, then end."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.toTable(table)


def append_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same to Parquet files, until what is there has been read."""
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def poll_into_tables(df: DataFrame, targets: Mapping[str, Sequence[str]], checkpoint: str, key: Sequence[str], ts: str, interval: str | None = None) -> StreamingQuery:
    """Each batch goes to several tables, of some of the columns each, without rows that a table has already.

    A batch that is run again after a failure adds nothing twice. ``ts``, which is part of ``key``, bounds what is
    looked up: of a table only the rows in the batch's range of time are read.
    """
    if ts not in key:
        raise ValueError("the time has to be part of the key")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        low, high = batch.agg(F.min(ts), F.max(ts)).first()
        for table, names in targets.items():
            rows = batch.select(*names).dropDuplicates(list(key))
            if spark.catalog.tableExists(table):
                near = spark.table(table).where(F.col(ts).between(low, high)) if low is not None else spark.table(table).limit(0)
                rows = rows.join(near.select(*key), list(key), "left_anti")
            rows.write.mode("append").saveAsTable(table)
        batch.unpersist()

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def bronze_time(df: DataFrame, ts: str) -> DataFrame:
    """Text times of a bronze stream, parsed."""
    return df.withColumn(ts, C.parse_time(ts))
