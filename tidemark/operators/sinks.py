"""Alerts, metric lines and table writes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.operators.storage import small


def alerts(df: DataFrame, ts: str, region: str, price: str, demand: str, price_threshold: float = 300, demand_threshold: float = 10000) -> DataFrame:
    """A row for each threshold that is passed; one input row can give two. Zero is a value like any other."""
    found = F.array_compact(
        F.array(
            F.when(F.col(price) > price_threshold, F.struct(F.lit("PRICE_SPIKE").alias("type"), F.col(price).cast("double").alias("value"), F.lit(float(price_threshold)).alias("threshold"))),
            F.when(F.col(demand) > demand_threshold, F.struct(F.lit("HIGH_DEMAND").alias("type"), F.col(demand).cast("double").alias("value"), F.lit(float(demand_threshold)).alias("threshold"))),
        )
    )
    return df.select(F.col(ts).alias("ts"), F.col(region).alias("region"), F.explode(found).alias("a")).select("ts", "region", "a.*")


def metric_lines(df: DataFrame, ts: str, region: str, demand: str, prefix: str = "market") -> DataFrame:
    """One column ``line``: name, tag, value, nanoseconds. Rows without a time give no line."""
    nanos = F.unix_micros(F.col(ts).cast("timestamp")) * 1000
    return df.where(F.col(ts).isNotNull()).select(F.concat(F.lit(f"{prefix}_demand,region="), F.coalesce(region, F.lit("unknown")), F.lit(" value="), F.coalesce(F.col(demand), F.lit(0.0)).cast("string"), F.lit(" "), nanos.cast("string")).alias("line"))


EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int
    regions: tuple


def store_of(path: str):
    """The store of a path, through Arrow's file systems, and the path in it."""
    from pyarrow import fs

    path = re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _LineWriter:
    """Lines to files, in two phases.

    Each task writes a file of its own, under a name that no other has. The commit enters these files in a manifest, which
    appears under its name whole or not at all: that is the moment at which they count. What a task left that failed or ran
    twice is in no manifest. ``read_lines`` reads what the manifests have. A stream's manifest is named by its batch, so a
    batch that is committed again adds nothing; a folder belongs to one stream, as its checkpoint does.
    """

    def __init__(self, options: dict, overwrite: bool = False):
        self.options, self.overwrite = options, overwrite

    def lines(self, row: Row) -> Iterator[tuple[str, str]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = store_of(self.options["path"])
        n, regions, path = 0, set(), f"{folder}/part-{uuid.uuid4().hex}"
        store.create_dir(folder)
        with store.open_output_stream(path) as out:
            for row in iterator:
                for region, line in self.lines(row):
                    out.write(f"{line}\n".encode())
                    n += 1
                    regions.add(region)
        return _Written(path, n, tuple(sorted(map(str, regions))))

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int | None = None) -> None:
        store, _ = store_of(self.options["path"])
        for m in messages:
            if m is not None:
                store.delete_file(m.path)

    def _put(self, path: str, record: dict) -> None:
        store, _ = store_of(self.options["path"])
        new = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with store.open_output_stream(new) as out:
            out.write(json.dumps(record).encode())
        store.move(new, path)

    def _commit(self, messages: list[WriterCommitMessage | None], name: str) -> None:
        from pyarrow import fs

        store, folder = store_of(self.options["path"])
        done = [m for m in messages if m is not None]
        store.create_dir(f"{folder}/_manifest")
        before = [f.path for f in store.get_file_info(fs.FileSelector(f"{folder}/_manifest")) if f.base_name.endswith(".json")]
        if f"{folder}/_manifest/{name}.json" in before:
            self.abort(messages)
            return
        total = {"rows": sum(m.rows for m in done), "regions": sorted({r for m in done for r in m.regions})}
        self._put(f"{folder}/_manifest/{name}.json", {"files": [m.path.rpartition("/")[2] for m in done]} | total)
        for path in before if self.overwrite else []:
            store.delete_file(path)
        self._put(f"{folder}/_totals.json", total)


class _BatchWriter(_LineWriter, DataSourceWriter):
    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._commit(messages, f"run-{uuid.uuid4().hex}")


class _StreamWriter(_LineWriter, DataSourceStreamWriter):
    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._commit(messages, f"batch-{batchId:09d}")


class _Alerts:
    def lines(self, row: Row) -> Iterator[tuple[str, str]]:
        r = row.asDict()
        limits = (("PRICE_SPIKE", "price", float(self.options.get("price_threshold", 300))), ("HIGH_DEMAND", "demand", float(self.options.get("demand_threshold", 10000))))
        for kind, name, limit in limits:
            value = r.get(name)
            if value is not None and float(value) > limit:
                yield r.get("region"), json.dumps({"type": kind, "region": r.get("region"), "value": float(value), "threshold": limit, "timestamp": str(r.get("ts"))})


class _Metrics:
    def lines(self, row: Row) -> Iterator[tuple[str, str]]:
        r = row.asDict()
        if r.get("ts") is None:
            return  # a line without a time would get the time of its arrival
        moment = r["ts"] if r["ts"].tzinfo else r["ts"].astimezone()
        nanos = (moment - EPOCH) // timedelta(microseconds=1) * 1000
        yield r.get("region"), f"{self.options.get('prefix', 'market')}_demand,region={r.get('region') or 'unknown'} value={float(r.get('demand') or 0)} {nanos}"


class _AlertBatch(_Alerts, _BatchWriter):
    pass


class _AlertStream(_Alerts, _StreamWriter):
    pass


class _MetricBatch(_Metrics, _BatchWriter):
    pass


class _MetricStream(_Metrics, _StreamWriter):
    pass


class AlertSink(DataSource):
    """S1 as a sink: ``df.write`` or ``df.writeStream.format("market_alerts")`` over columns ts, region, price, demand, by name.

    The path has to lie in a store that all executors and the driver share and that Arrow reads, such as a mount.
    """

    batch, stream = _AlertBatch, _AlertStream

    @classmethod
    def name(cls) -> str:
        return "market_alerts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return self.batch(dict(self.options), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return self.stream(dict(self.options))


class MetricSink(AlertSink):
    """S2 as a sink: format ``market_metrics`` over columns ts, region, demand."""

    batch, stream = _MetricBatch, _MetricStream

    @classmethod
    def name(cls) -> str:
        return "market_metrics"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines (``value``) of all files that the manifests of a folder have."""
    files = spark.read.schema("files array<string>").json(f"{folder}/_manifest").select(F.explode("files").alias("_name"))
    lines = spark.read.option("pathGlobFilter", "part-*").text(folder).select("value", F.col("_metadata.file_name").alias("_name"))
    return lines.join(small(files), "_name", "left_semi").select("value")


def write_table(df: DataFrame, table: str, mode: str = "append", merge_schema: bool = False) -> None:
    """S3: append, overwrite or ignore. ``merge_schema`` adds columns the table lacks; a view of the name is dropped.

    Appended rows get the table's columns in its order; missing ones are null.
    """
    spark = df.sparkSession
    if spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType == "VIEW":
        spark.sql(f"DROP VIEW {table}")
    if mode == "append" and spark.catalog.tableExists(table):
        have = spark.table(table)
        new = [f for f in df.schema if f.name not in have.columns]
        if new and not merge_schema:
            raise ValueError(f"columns that {table} lacks: {[f.name for f in new]}")
        if new:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
        target = spark.table(table).schema
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])
    df.write.mode(mode).saveAsTable(table)


def export(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """S7."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def partitioned(df: DataFrame, ts: str) -> DataFrame:
    """Year and month columns to partition by."""
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def write_partitioned(df: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """Rows of a month are brought together first, so a month has few files; AQE splits a heavy one."""
    partitioned(df, ts).hint("rebalance", "year", "month").write.mode(mode).partitionBy("year", "month").parquet(path)


def write_clustered(df: DataFrame, path: str, keys: Sequence[str], files: int | None = None, mode: str = "overwrite") -> None:
    """Ranges of the keys to files, sorted inside, so that least and most of a row group skip most of it."""
    spread = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def time_range(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """The half-open time range, said of the partition columns too, so whole months are not read."""
    kind = df.schema[ts].dataType
    out = df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))
    if {"year", "month"} <= set(df.columns):
        first, last = (F.year(F.lit(x).cast("timestamp")) * 12 + F.month(F.lit(x).cast("timestamp")) for x in (start, end))
        months = F.col("year") * 12 + F.col("month")
        out = out.where((months >= first) & (months <= last))
    return out
