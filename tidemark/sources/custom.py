"""Report folders as Spark data sources in Python.

``spark.dataSource.register`` makes the formats known. They list a folder that all machines share. Where Spark
itself reads the store, ``tidemark.sources.reports`` is the wider way: its filters and columns reach the scan.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DoubleType, StructType, TimestampType

from tidemark.sources import schemas
from tidemark.sources.reports import members, records

#: Formats of times in reports (fixed values), as Python writes them.
_FORMATS = ("%Y/%m/%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y-%m-%dT%H:%M:%S")
_STAMP = re.compile(r"_(\d{8})(\d{4})?")


def _time(text: str | None) -> datetime | None:
    for f in _FORMATS:
        try:
            return datetime.strptime((text or "").strip().strip('"'), f).replace(tzinfo=timezone.utc)
        except ValueError:
            continue
    return None


def _number(text: str | None) -> float | None:
    try:
        return float((text or "").strip())
    except ValueError:
        return None


def _rows(path: str, table: str, regions: tuple[str, ...]) -> Iterator[tuple]:
    """Typed rows of a file; a file that can't be read fails the task."""
    schema, at, region = schemas.schema(table), schemas.event_time(table), schemas.region_column(table)
    with open(path, "rb") as file:
        content = file.read()
    for _, data in members(content):
        for r in records(data, schemas.record_type(table)):
            if regions and region and r.get(region) not in regions:
                continue
            row = tuple(_time(r.get(f.name)) if isinstance(f.dataType, TimestampType) else _number(r.get(f.name)) if isinstance(f.dataType, DoubleType) else r.get(f.name) for f in schema)
            if row[schema.fieldNames().index(at)] is not None:
                yield row


class _Files(InputPartition):
    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


def _listed(folder: str) -> list[str]:
    return sorted(f for f in os.listdir(folder) if f.lower().endswith(".zip"))


def _date(name: str) -> str | None:
    m = _STAMP.search(name)
    return m[1] if m else None


class _Options:
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file:")
        self.table = options.get("table", "DISPATCHREGIONSUM")
        self.regions = tuple(r for r in options.get("regions", "").split(",") if r)
        self.start = options.get("start_date", "").replace("-", "") or None
        self.end = options.get("end_date", "").replace("-", "") or None
        self.most = int(options.get("max_files", "10"))
        self.start_file = options.get("start_file")
        self.catch_up_hours = float(options.get("catch_up_hours", "24"))
        schemas.record_type(self.table)


class ReportReader(DataSourceReader):
    """A4, A5: a partition for each date, or for each file; rows as tuples, or as Arrow batches."""

    def __init__(self, options: dict, by_date: bool):
        self.o, self.by_date = _Options(options), by_date

    def partitions(self) -> list[InputPartition]:
        kept = []
        for name in _listed(self.o.folder):
            day = _date(name)
            if day is None or ((self.o.start is None or day >= self.o.start) and (self.o.end is None or day <= self.o.end)):
                kept.append((day, os.path.join(self.o.folder, name)))
        if not self.by_date:
            return [_Files((p,)) for _, p in kept] or [_Files(())]
        days: dict[str | None, list[str]] = {}
        for day, path in kept:
            days.setdefault(day, []).append(path)
        return [_Files(tuple(p)) for p in days.values()] or [_Files(())]

    def read(self, partition: InputPartition) -> Iterator:
        for path in partition.paths:
            if self.by_date:
                yield from _rows(path, self.o.table, self.o.regions)
            else:
                yield from self._batches(path)

    def _batches(self, path: str) -> Iterator[pa.RecordBatch]:
        schema = schemas.schema(self.o.table)
        kinds = [pa.timestamp("us", "UTC") if isinstance(f.dataType, TimestampType) else pa.float64() if isinstance(f.dataType, DoubleType) else pa.string() for f in schema]
        rows = _rows(path, self.o.table, self.o.regions)
        while part := list(itertools.islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], schema.fieldNames())


class ReportStreamReader(DataSourceStreamReader):
    """Files after the last one read, by name, at most ``max_files`` a batch, after a restart too.

    An offset is a file name. It starts at ``start_file``, or at the name that ``catch_up_hours`` before now would
    have. Spark asks a fresh reader for its newest offset before it tells where the stream stands, so the reader looks that
    up: with the option ``checkpoint``, the query's own checkpoint folder, in the offsets that Spark logs there, so the
    checkpoint alone brings a stream back, on any machine that sees the folder. Without it, in a note that it keeps in the
    folder ``state_path``, and a stream that has lost the note fails rather than read files twice. Files that are gone
    move nothing back. ``source`` is this stream's place among the sources of its query, from 0.
    """

    def __init__(self, options: dict):
        self.o = _Options(options)
        self.checkpoint, self.source = options.get("checkpoint", "").removeprefix("file:"), int(options.get("source", "0"))
        if not self.checkpoint and not options.get("state_path"):
            raise ValueError("a stream of reports needs the option checkpoint, its query's checkpoint folder, or state_path, a folder of its own")
        self.note = None if self.checkpoint else os.path.join(options["state_path"].removeprefix("file:"), "last_file.json")
        self.start, self.reached, self.fresh = None, None, False
        if self.note and os.path.exists(self.note):
            with open(self.note, encoding="utf-8") as noted:
                known = json.load(noted)
            self.start, self.reached = known["start"], known["last_file"]
            self.fresh = True  # Spark may not have logged the noted offset yet, so it is given out again

    def _logged(self) -> str | None:
        """The newest offset of this stream in the checkpoint: of the numbered files below ``offsets`` the last one has a
        version, a line about the batch, and a line for each source."""
        folder = os.path.join(self.checkpoint, "offsets")
        numbers = [int(n) for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
        if not numbers:
            return None
        with open(os.path.join(folder, str(max(numbers))), encoding="utf-8") as file:
            line = file.read().splitlines()[2 + self.source]
        return None if line == "-" else json.loads(line)["last_file"]

    def _reach(self, name: str) -> dict:
        self.reached = name
        if self.note:
            os.makedirs(os.path.dirname(self.note), exist_ok=True)
            with open(f"{self.note}.new", "w", encoding="utf-8") as out:
                json.dump({"start": self.start, "last_file": name}, out)
            os.replace(f"{self.note}.new", self.note)
        return {"last_file": name}

    def initialOffset(self) -> dict:
        if self.start is None:
            if self.o.start_file is not None:
                self.start = self.o.start_file
            else:
                since = datetime.now(timezone(timedelta(hours=10))) - timedelta(hours=self.o.catch_up_hours)
                names = [n for n in _listed(self.o.folder) if (m := _STAMP.search(n)) and m[1] + (m[2] or "0000") < since.strftime("%Y%m%d%H%M")]
                self.start = names[-1] if names else ""
            self.reached = self.start
        return {"last_file": self.start}

    def latestOffset(self) -> dict:
        """At most ``max_files`` beyond the offset reached; first after a restart from a note, the offset noted last."""
        if self.checkpoint and self.reached is None:
            self.start = self.reached = self._logged()
        self.initialOffset()
        if self.fresh:
            self.fresh = False
            return {"last_file": self.reached}
        ahead = [n for n in _listed(self.o.folder) if n > self.reached][: self.o.most]
        return self._reach(ahead[-1]) if ahead else {"last_file": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["last_file"] < start["last_file"]:
            raise RuntimeError(f"the stream stands at {start['last_file']}, beyond what {self.note or self.checkpoint} says")
        names = [n for n in _listed(self.o.folder) if start["last_file"] < n <= end["last_file"]]
        return [_Files((os.path.join(self.o.folder, n),)) for n in names] or [_Files(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            yield from _rows(path, self.o.table, self.o.regions)

    def commit(self, end: dict) -> None:
        pass


class ReportsByDate(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market_reports"

    def schema(self) -> StructType:
        return schemas.schema(self.options.get("table", "DISPATCHREGIONSUM"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReportReader(dict(self.options), by_date=True)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ReportStreamReader(dict(self.options))


class ReportsByFile(ReportsByDate):
    @classmethod
    def name(cls) -> str:
        return "market_reports_arrow"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReportReader(dict(self.options), by_date=False)


def register(spark: SparkSession) -> None:
    from tidemark.operators.sinks import AlertSink, MetricSink

    for source in (ReportsByDate, ReportsByFile, AlertSink, MetricSink):
        spark.dataSource.register(source)
