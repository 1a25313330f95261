"""Reports: ZIP files (one ZIP level inside), lines marked C, I and D, scanned as DataFrames.

An ``I`` line names the columns of the ``D`` lines of its record type that follow in the member. Files are read
with Spark's binary reader, so any store that Spark reads will do, and taken apart on the executors; the values
come out as text, bound by name, and Spark casts them. Regions that are not asked for are dropped there; dates that
are not asked for are never read.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.quality import partition_id
from tidemark.operators.storage import checkpoint, exists, remove, small
from tidemark.sources import schemas

#: Rows handed to Spark at once, rows of a report that is written at most (on average).
BATCH, FILE_ROWS = 20_000, 100_000


def members(content: bytes, name: str = "", depth: int = 1) -> Iterator[tuple[str, bytes]]:
    """CSV members of a ZIP, and those of ZIPs inside it, one level down."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            low = info.filename.lower()
            if low.endswith(".csv"):
                yield f"{name}{info.filename}", archive.read(info)
            elif low.endswith(".zip") and depth:
                yield from members(archive.read(info), f"{info.filename}!", depth - 1)


def records(content: bytes, kind: tuple[str, str] | None) -> Iterator[dict[str, str]]:
    """Rows of one record type (all rows of a plain CSV if ``kind`` is None), by column name."""
    lines = csv.reader(io.StringIO(content.decode("utf-8", "replace")))
    if kind is None:
        header = next(lines, [])
        yield from (dict(zip(header, row)) for row in lines if row)
        return
    header: list[str] = []
    for row in lines:
        if len(row) < 3 or row[0] not in ("I", "D") or (row[1], row[2]) != kind:
            continue
        if row[0] == "I":
            header = row[4:]
        elif header:
            yield dict(zip(header, row[4:]))


def file_date(name: Column) -> Column:
    """A3: the date that a file's name states in 8 or 12 digits or more; null if none."""
    digits = F.regexp_extract(name, r"_(\d{8})(?:\d{4,6})?(?:_|\.)", 1)
    return F.to_date(F.try_to_timestamp(F.when(digits != "", digits), F.lit("yyyyMMdd")))


def report_files(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, pattern: str = "*.zip") -> DataFrame:
    """The files whose date lies in [start, end], and those whose name states none.

    The condition stands on the file's name alone, so contents of other files are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(path)
    day = file_date(F.element_at(F.split("path", "/"), -1))
    if start is not None:
        files = files.where(day.isNull() | (day >= F.lit(start).cast("date")))
    if end is not None:
        files = files.where(day.isNull() | (day <= F.lit(end).cast("date")))
    return files


def report_slots(rows: DataFrame, ts: str, most: int = FILE_ROWS) -> DataFrame:
    """``rows`` with ``slot``, the hour and number of the report that each is written to: an hour of n rows is dealt to
    ceil(n / ``most``) reports, equal rows among them too, so none grows with the hour. Rows without a time have slots ``none_...``."""
    hour = F.coalesce(F.date_format(ts, "yyyyMMddHH'00'"), F.lit("none"))
    numbered = rows.withColumn("_hour", hour).withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    reports = rows.groupBy(hour.alias("_hour")).agg(F.ceil(F.count(F.lit(1)) / most).cast("bigint").alias("_reports"))
    number = F.format_string("%06d", F.pmod("_at", F.col("_reports")) + 1)
    return numbered.join(small(reports), "_hour").withColumn("slot", F.concat_ws("_", "_hour", number)).drop("_hour", "_at", "_reports")


def newest_files(files: DataFrame, n: int) -> DataFrame:
    """The n files that come last by name. Names only are sorted; contents follow by a semi-join on the path."""
    last = files.select("path").orderBy(F.desc(F.element_at(F.split("path", "/"), -1))).limit(n)
    return files.join(F.broadcast(last), "path", "left_semi")


def scan(files: DataFrame, table: str, plain: bool = False, regions: Sequence[str] = ()) -> DataFrame:
    """A1, A2: the rows of a table in these files, typed; ``_file`` and ``_member`` say where they are from.

    Rows of regions other than those named don't leave the parser, where the table has a region.
    """
    wanted, region = frozenset(regions), schemas.region_column(table)
    schema = schemas.schema(table)
    names = schema.fieldNames()
    kind = None if plain else schemas.record_type(table)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("_file", pa.string()), ("_member", pa.string()), *[(n, pa.string()) for n in names]])

        def pack(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(target))], schema=target)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list = []
                inside = members(content) if path.lower().endswith(".zip") else [(path.rsplit("/", 1)[-1], content)]
                for member, data in inside:
                    for r in records(data, kind):
                        if wanted and region and (r.get(region) or "").strip().strip('"') not in wanted:
                            continue
                        rows.append((path, member, *[r.get(n) for n in names]))
                        if len(rows) >= BATCH:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    text = files.select("path", "content").mapInArrow(parse, ", ".join(["_file string", "_member string", *[f"`{n}` string" for n in names]]))
    cast = {"timestamp": C.parse_time, "double": C.parse_double}
    typed = [cast.get(f.dataType.typeName(), C.clean_text)(f.name).alias(f.name) for f in schema]
    return text.select(*typed, "_file", "_member").where(F.col(schemas.event_time(table)).isNotNull())


def read_reports(spark: SparkSession, path: str, table: str, start: str | None = None, end: str | None = None, regions: Sequence[str] = (), plain: bool = False, pattern: str = "*.zip") -> DataFrame:
    """A table's rows in a range of dates, of some regions. A range without files is empty, not an error."""
    return scan(report_files(spark, path, start, end, pattern), table, plain, regions)


def work_list(spark: SparkSession, tables: Sequence[str], regions: Sequence[str], start: str, end: str) -> DataFrame:
    """One unit for each table, region and day, under an id of its own."""
    day = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    units = spark.range(1).select(F.explode(F.array(*map(F.lit, tables))).alias("table"), day).select("table", F.explode(F.array(*map(F.lit, regions))).alias("region"), "day")
    return units.select(partition_id("table", "region", "day").alias("partition_id"), "table", "region", "day")


def _unit(path: Column) -> Column:
    """What a file is extracted with: the date in its name, or the file itself where its name has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(file_date(name).cast("string"), F.concat(F.lit("undated-"), F.substring(F.md5(name.cast("binary")), 1, 12)))


def extract(spark: SparkSession, path: str, table: str, target: str, kind: str = "csv", pattern: str = "*.zip") -> None:
    """A10: a table's rows as files by the date of their report; what is done is skipped before a file is read.

    A manifest, ``<target>/_manifest``, has the name, size and time of every file that was extracted. Dates with a file that
    isn't in it as it is now, be it late or written anew, are extracted again, all their files together; a file
    without a date in its name is a unit of its own, under ``undated``. The manifest is written after the rows, from a listing made
    before them, so what a broken run left is overwritten by the next. Rows of a file that is gone stay until its date changes.
    """
    found, manifest = ["path", "length", "modificationTime"], f"{target}/_manifest"
    files = report_files(spark, path, pattern=pattern)
    listed = checkpoint(files.select(*found, _unit(F.col("path")).alias("unit")))
    schema = "path string, length bigint, modificationTime timestamp, unit string"
    known = spark.read.schema(schema).parquet(manifest) if exists(spark, manifest) else spark.createDataFrame([], schema)
    new = listed.join(known.select(*found), found, "left_anti").select("unit").distinct()
    todo = new.join(known.select("unit", F.lit(True).alias("before")).distinct(), "unit", "left").collect()  # days of reports, and files without one
    if not todo:
        return
    units = [r["unit"] for r in todo]
    for r in todo:
        if r["before"]:  # what it had is out of date, and it may have no rows now
            remove(spark, f"{target}/report_date={r['unit']}")
    rows = scan(files.where(_unit(F.col("path")).isin(units)), table)
    rows = rows.withColumn("report_date", _unit(F.col("_file"))).drop("_file", "_member")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True)
    writer.partitionBy("report_date").format(kind).save(target)
    listed.where(F.col("unit").isin(units)).join(known.select(*found), found, "left_anti").coalesce(1).write.mode("append").parquet(manifest)


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files, bytes and dates by folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = F.split("path", "/")
    return files.groupBy(F.element_at(parts, -2).alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"), F.min(file_date(F.element_at(parts, -1))).alias("first_date"), F.max(file_date(F.element_at(parts, -1))).alias("last_date"))
