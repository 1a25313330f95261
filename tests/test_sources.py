import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sinks, storage
from tidemark.sources import custom, json_sources, reports, schemas, synthetic, tables


def zipped(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, text)
    return out.getvalue()


def test_reports_of_a_hot_hour_are_bounded(spark):
    hot = spark.range(5000, numPartitions=3).select(F.lit("2024-01-01 12:30:00").cast("timestamp").alias("ts"), F.lit("a").alias("x"))
    rest = spark.range(3).select(F.lit("2024-01-01 13:00:00").cast("timestamp").alias("ts"), F.lit("b").alias("x"))
    none = spark.range(2).select(F.lit(None).cast("timestamp").alias("ts"), F.lit("c").alias("x"))
    out = reports.report_slots(hot.union(rest).union(none), "ts", most=500)
    assert out.columns == ["ts", "x", "slot"]
    slots = {r["slot"]: r["count"] for r in out.groupBy("slot").count().collect()}
    mine = {s: n for s, n in slots.items() if s.startswith("202401011200_")}
    assert set(mine) == {f"202401011200_{i:06d}" for i in range(1, 11)} and sum(mine.values()) == 5000 and max(mine.values()) < 650
    assert {s: n for s, n in slots.items() if s not in mine} == {"202401011300_000001": 3, "none_000001": 2}
    assert reports.report_slots(hot.limit(0), "ts").count() == 0


REGIONSUM = """C,MARKET,DISPATCH
I,DISPATCH,REGIONSUM,4,SETTLEMENTDATE,RUNNO,REGIONID,TOTALDEMAND,EXTRA
D,DISPATCH,REGIONSUM,4,"2024/01/01 12:05:00",1,NSW1,7500.5,x
D,DISPATCH,REGIONSUM,4,"2024/01/01 12:05:00",1,VIC1
D,DISPATCH,REGIONSUM,4,junk,1,QLD1,1
I,DISPATCH,PRICE,4,REGIONID,SETTLEMENTDATE,RRP
D,DISPATCH,PRICE,4,NSW1,2024/01/01 12:05:00,85.5
C,END OF REPORT,7
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "PUBLIC_X_20240101.zip").write_bytes(zipped("a.CSV", REGIONSUM))
    (tmp_path / "PUBLIC_X_202401020005_0001.zip").write_bytes(zipped("in.zip", zipped("b.csv", REGIONSUM.replace("2024/01/01", "2024/01/02"))))
    (tmp_path / "PUBLIC_X_odd.zip").write_bytes(zipped("readme.txt", "no csv"))
    return str(tmp_path)


def test_registry_of_schemas():
    assert len(schemas.tables()) == 12
    assert len(schemas.schema("BIDPEROFFER_D")) == 31 and len(schemas.schema("BIDDAYOFFER_D")) == 28 and len(schemas.schema("DISPATCH_REGION")) == 23
    assert schemas.record_type("DISPATCH_REGION") == ("DREGION", "")
    with pytest.raises(ValueError):
        schemas.schema("NOTHING")


def test_scan_binds_by_name_and_goes_one_zip_down(spark, folder):
    rows = reports.read_reports(spark, folder, "DISPATCHREGIONSUM").orderBy("SETTLEMENTDATE", "REGIONID").collect()
    assert [(str(r["SETTLEMENTDATE"]), r["REGIONID"], r["TOTALDEMAND"]) for r in rows] == [
        ("2024-01-01 12:05:00", "NSW1", 7500.5), ("2024-01-01 12:05:00", "VIC1", None), ("2024-01-02 12:05:00", "NSW1", 7500.5), ("2024-01-02 12:05:00", "VIC1", None),
    ]
    assert [r["RRP"] for r in reports.read_reports(spark, folder, "DISPATCHPRICE", regions=["NSW1"]).collect()] == [85.5, 85.5]


def test_dates_in_names_prune_files(spark, folder):
    names = lambda **k: {r["path"].rsplit("/", 1)[1] for r in reports.report_files(spark, folder, **k).select("path").collect()}
    assert names(start="2024-01-02", end="2024-01-03") == {"PUBLIC_X_202401020005_0001.zip", "PUBLIC_X_odd.zip"}
    assert reports.read_reports(spark, folder, "DISPATCHPRICE", start="2025-01-01").count() == 0
    newest = reports.newest_files(reports.report_files(spark, folder), 2)
    assert {r["path"].rsplit("/", 1)[1] for r in newest.select("path").collect()} == {"PUBLIC_X_202401020005_0001.zip", "PUBLIC_X_odd.zip"}


def test_plain_csv_member(spark, tmp_path):
    (tmp_path / "p.zip").write_bytes(zipped("a.csv", "SETTLEMENTDATE,REGIONID,RRP\n2024-01-01 00:05:00,SA1,12\n2024-01-01 00:10:00,SA1,-\n"))
    rows = reports.read_reports(spark, str(tmp_path), "DISPATCHPRICE", plain=True).orderBy("SETTLEMENTDATE").collect()
    assert [r["RRP"] for r in rows] == [12.0, None]


def test_extract_skips_dates_that_are_done(spark, folder, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("x") / "out")
    for _ in range(2):
        reports.extract(spark, folder, "DISPATCHPRICE", target)
        assert spark.read.option("header", True).csv(target).count() == 2


def test_extract_reads_no_file_of_a_date_that_is_done(spark, tmp_path):
    day = "I,DISPATCH,PRICE,4,SETTLEMENTDATE,REGIONID,RRP\nD,DISPATCH,PRICE,4,2024/01/0{} 00:05:00,NSW1,{}\n"
    target = str(tmp_path / "out")
    for i in (1, 2):
        (tmp_path / f"PUBLIC_X_2024010{i}_1.zip").write_bytes(zipped("a.csv", day.format(i, i)))
    reports.extract(spark, str(tmp_path), "DISPATCHPRICE", target)
    done = tmp_path / "PUBLIC_X_20240101_1.zip"
    size, times = done.stat().st_size, (done.stat().st_atime_ns, done.stat().st_mtime_ns)
    done.write_bytes(b"no longer a ZIP".ljust(size))
    os.utime(done, ns=times)  # a file of the same size and time counts as the same
    (tmp_path / "PUBLIC_X_20240103_1.zip").write_bytes(zipped("a.csv", day.format(3, 3)))
    # what a broken run has left of the third day
    spark.createDataFrame([("2024-01-03 00:05:00", "-1", "20240103")], "SETTLEMENTDATE string, RRP string, d string").drop("d").coalesce(1).write.option("header", True).csv(f"{target}/report_date=2024-01-03")
    reports.extract(spark, str(tmp_path), "DISPATCHPRICE", target)
    rows = spark.read.option("header", True).csv(target).collect()
    assert sorted((str(r["report_date"]), float(r["RRP"])) for r in rows) == [("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", 3.0)]


def test_extract_finds_late_and_changed_files(spark, tmp_path):
    line = "I,DISPATCH,PRICE,4,SETTLEMENTDATE,REGIONID,RRP\nD,DISPATCH,PRICE,4,2024/01/0{} 00:05:00,NSW1,{}\n"
    target = str(tmp_path / "out")

    def put(name, text):
        (tmp_path / name).write_bytes(zipped("a.csv", text))

    def extracted():
        reports.extract(spark, str(tmp_path), "DISPATCHPRICE", target)
        rows = spark.read.option("header", True).csv(target).collect()
        return sorted((str(r["report_date"])[:7], float(r["RRP"])) for r in rows)

    put("PUBLIC_X_20240101_1.zip", line.format(1, 1))
    put("PUBLIC_X_20240102_1.zip", line.format(2, 2))
    put("PUBLIC_X_odd.zip", line.format(1, 10))
    assert extracted() == [("2024-01", 1.0), ("2024-01", 2.0), ("undated", 10.0)]
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "report_date=2024-01-02").iterdir()}
    put("PUBLIC_X_20240101_2.zip", line.format(1, 3))  # late, for a date that is done
    put("PUBLIC_X_other.zip", line.format(1, 11))  # its rows have the date of another file without one
    assert extracted() == [("2024-01", 1.0), ("2024-01", 2.0), ("2024-01", 3.0), ("undated", 10.0), ("undated", 11.0)]
    assert first == {p: p.stat().st_mtime_ns for p in (tmp_path / "out" / "report_date=2024-01-02").iterdir()}
    put("PUBLIC_X_20240101_1.zip", "C,NOTHING IN IT ANY MORE\n")
    put("PUBLIC_X_20240102_1.zip", "C,NOTHING EITHER\n")
    assert extracted() == [("2024-01", 3.0), ("undated", 10.0), ("undated", 11.0)]
    assert extracted() == [("2024-01", 3.0), ("undated", 10.0), ("undated", 11.0)]


def test_inventory_and_work_list(spark, folder):
    row = reports.inventory(spark, folder, "*.zip").first()
    assert row["n_files"] == 3 and str(row["first_date"]) == "2024-01-01" and str(row["last_date"]) == "2024-01-02"
    units = reports.work_list(spark, ["A", "B"], ["R"], "2024-01-01", "2024-01-03")
    assert units.count() == 6 and units.select("partition_id").distinct().count() == 6


def test_custom_batch_sources(spark, folder):
    custom.register(spark)
    for kind, parts in (("market_reports", 3), ("market_reports_arrow", 3)):
        df = spark.read.format(kind).option("path", folder).option("table", "DISPATCHREGIONSUM").option("regions", "NSW1").load()
        assert df.rdd.getNumPartitions() == parts
        assert [(r["REGIONID"], r["TOTALDEMAND"]) for r in df.collect()] == [("NSW1", 7500.5)] * 2


def test_custom_stream_offsets(tmp_path):
    for i in range(1, 6):
        (tmp_path / f"PUBLIC_X_2024010112{i:02d}_{i}.zip").write_bytes(zipped("a.csv", REGIONSUM))
    first = "PUBLIC_X_202401011201_1.zip"
    reader = custom.ReportStreamReader({"path": str(tmp_path), "start_file": first, "max_files": "2", "state_path": str(tmp_path / "state")})
    start = reader.initialOffset()
    seen = []
    for _ in range(2):
        end = reader.latestOffset()
        seen += [p.paths[0].rsplit("_", 1)[1] for p in reader.partitions(start, end)]
        reader.commit(end)
        start = end
    assert seen == ["2.zip", "3.zip", "4.zip", "5.zip"]
    assert reader.latestOffset() == start
    empty = tmp_path / "empty"
    empty.mkdir()
    reader = custom.ReportStreamReader({"path": str(empty), "state_path": str(tmp_path / "other")})
    assert reader.initialOffset() == {"last_file": ""} and reader.latestOffset() == {"last_file": ""}


def test_custom_stream_after_a_restart(tmp_path):
    names = [f"PUBLIC_X_2024010112{i:02d}_{i}.zip" for i in range(30)]
    for n in names:
        (tmp_path / n).write_bytes(b"")
    options = {"path": str(tmp_path), "start_file": "", "max_files": "3", "state_path": str(tmp_path / "state")}
    reader = custom.ReportStreamReader(options)
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert [len(reader.partitions(start, end))] == [3]
    # the reader is lost before Spark logs its next offset, so the note is a batch ahead of the checkpoint
    ahead = reader.latestOffset()
    batches = []
    for _ in range(3):
        reader = custom.ReportStreamReader(options)
        for _ in range(2):
            new = reader.latestOffset()
            assert new["last_file"] >= end["last_file"]
            if new != end:
                batches.append([os.path.basename(p.paths[0]) for p in reader.partitions(end, new)])
            end = new
    assert ahead["last_file"] == names[5] and all(len(b) <= 3 for b in batches) and [n for b in batches for n in b] == names[3:15]
    for n in names[5:]:
        (tmp_path / n).unlink()
    reader = custom.ReportStreamReader(options)
    assert reader.latestOffset() == end and reader.latestOffset() == end
    (tmp_path / "PUBLIC_X_202401011300_99.zip").write_bytes(b"")
    assert reader.latestOffset() == {"last_file": "PUBLIC_X_202401011300_99.zip"}
    with pytest.raises(RuntimeError):  # the note is lost: the stream fails rather than go back
        lost = custom.ReportStreamReader(options | {"state_path": str(tmp_path / "lost")})
        lost.partitions(end, lost.latestOffset())
    with pytest.raises(ValueError):
        custom.ReportStreamReader({"path": str(tmp_path)})


def test_custom_stream_restarts_from_its_checkpoint_alone(spark, tmp_path):
    custom.register(spark)
    day = "I,DISPATCH,PRICE,4,SETTLEMENTDATE,REGIONID,RRP\nD,DISPATCH,PRICE,4,2024/01/01 00:{:02d}:00,NSW1,{}\n"
    reports_, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    reports_.mkdir()
    for low in (0, 5, 9):
        for i in range(low, low + 5):
            (reports_ / f"PUBLIC_X_2024010100{i:02d}_1.zip").write_bytes(zipped("a.csv", day.format(i, i)))
        if low == 9:
            (reports_ / "PUBLIC_X_202401010001_1.zip").unlink()  # read long ago
        df = spark.readStream.format("market_reports").options(path=str(reports_), table="DISPATCHPRICE", start_file="", max_files="2", checkpoint=state).load()
        q = df.writeStream.format("parquet").option("checkpointLocation", state).start(out)
        q.processAllAvailable()
        q.stop()
    assert sorted(r["RRP"] for r in spark.read.parquet(out).collect()) == [float(i) for i in range(14)]
    offsets = [json.loads((tmp_path / "state" / "offsets" / n).read_text().splitlines()[2])["last_file"] for n in sorted((x for x in os.listdir(f"{state}/offsets") if x.isdigit()), key=int)]
    names = sorted({*os.listdir(reports_), "PUBLIC_X_202401010001_1.zip"})
    ends = [names.index(o) for o in offsets]
    assert all(b - a <= 2 for a, b in zip([-1, *ends], ends))  # noqa: B905


def test_fresh_reader_goes_on_from_the_checkpoint(tmp_path):
    names = [f"PUBLIC_X_2024010112{i:02d}_{i}.zip" for i in range(9)]
    for n in names:
        (tmp_path / n).write_bytes(b"")
    (tmp_path / "state" / "offsets").mkdir(parents=True)
    options = {"path": str(tmp_path), "start_file": "", "max_files": "3", "checkpoint": f"file:{tmp_path}/state"}
    assert custom.ReportStreamReader(options).latestOffset() == {"last_file": names[2]}
    for number, last in ((9, names[1]), (10, names[4])):
        (tmp_path / "state" / "offsets" / str(number)).write_text(f'v1\n{{"batchWatermarkMs":0}}\n-\n{{"last_file": "{last}"}}')
    reader = custom.ReportStreamReader(options | {"source": "1"})
    end = reader.latestOffset()
    assert end == {"last_file": names[7]} and len(reader.partitions({"last_file": names[4]}, end)) == 3
    assert custom.ReportStreamReader(options).latestOffset() == {"last_file": names[2]}  # a source without an offset yet


def test_custom_stream_runs(spark, folder, tmp_path_factory):
    custom.register(spark)
    state = str(tmp_path_factory.mktemp("state"))
    df = spark.readStream.format("market_reports").option("path", folder).option("table", "DISPATCHPRICE").option("start_file", "").option("state_path", f"{state}-reader").load()
    q = df.writeStream.format("memory").queryName("custom_stream").option("checkpointLocation", state).trigger(once=True).start()
    q.awaitTermination()
    assert spark.table("custom_stream").count() == 2


def test_registry_json(spark, tmp_path):
    stations = [
        {"code": "S", "name": "Station", "location": {"state": "NSW", "lat": -1.0, "lng": 2.0}, "facilities": [{"code": "U1", "fueltech_id": "coal_black", "capacity_registered": 5.0, "status_id": "on"}, {"fueltech_id": "wind"}, {"code": "U2"}]},
        {"code": "T", "name": "T", "location": None, "facilities": [{"code": "U3", "fueltech_id": "fusion"}]},
    ]
    (tmp_path / "r.json").write_text(json.dumps(stations))
    rows = {r["DUID"]: r for r in json_sources.read_registry(spark, str(tmp_path)).collect()}
    assert {k: (v["fueltech"], v["fuel_category"], v["state"]) for k, v in rows.items()} == {"U1": ("coal_black", "coal", "NSW"), "U2": ("unknown", "unknown", "NSW"), "U3": ("fusion", "other", None)}
    assert [r["DUID"] for r in json_sources.read_registry(spark, str(tmp_path), state="NSW", fuel="coal").collect()] == ["U1"]


def test_weather_json(spark):
    text = json.dumps({"observations": {"data": [{"local_date_time_full": "20240101120000", "air_temp": 28.5, "rain_trace": "-", "wind_dir": "SW"}, {"local_date_time_full": "20240101123000", "air_temp": "", "wind_spd_kmh": 9}]}})
    df = json_sources.flatten_weather(spark.createDataFrame([("NSW1", text)], "region_id string, value string"))
    rows = df.orderBy("observation_time").collect()
    assert rows[0]["air_temp_c"] == 28.5 and rows[0]["rain_since_9am_mm"] is None and rows[1]["air_temp_c"] is None and rows[1]["wind_speed_kmh"] == 9.0
    assert str(json_sources.latest_weather(df).first()["observation_time"]) == "2024-01-01 12:30:00"


def test_synthetic_series(spark):
    a, b = (synthetic.region_series(spark, 10, regions=("A", "B")) for _ in range(2))
    assert a.count() == 20 and a.exceptAll(b).count() == 0


def test_sinks_write_files_and_totals(spark, tmp_path):
    custom.register(spark)
    df = spark.createDataFrame([("2024-01-01 00:00:00", "A", 500.0, 8000.0), ("2024-01-01 00:05:00", "B", 200.0, 6000.0), ("2024-01-01 00:10:00", "B", 50.0, 4000.0)], "ts string, region string, price double, demand double").withColumn("ts", F.col("ts").cast("timestamp"))
    out = str(tmp_path / "alerts")
    df.write.format("market_alerts").option("path", out).option("price_threshold", 100).option("demand_threshold", 5000).mode("append").save()
    assert json.loads((tmp_path / "alerts" / "_totals.json").read_text()) == {"rows": 4, "regions": ["A", "B"]}
    assert sinks.alerts(df, "ts", "region", "price", "demand", 100, 5000).count() == 4
    zero = df.withColumn("price", F.lit(0.0))
    assert sinks.alerts(zero, "ts", "region", "price", "demand", -100, 1e9).count() == 3
    df.write.format("market_metrics").option("path", str(tmp_path / "m")).mode("append").save()
    lines = [x for p in (tmp_path / "m").glob("part-*") for x in p.read_text().splitlines()]
    one = [("2024-01-01 00:00:00.000001", "A", 1.0), (None, "A", 2.0)]
    one = spark.createDataFrame(one, "ts string, region string, demand double").withColumn("ts", F.col("ts").cast("timestamp"))
    one.write.format("market_metrics").option("path", str(tmp_path / "n")).mode("append").save()
    assert [x for p in (tmp_path / "n").glob("part-*") for x in p.read_text().splitlines()] == ["market_demand,region=A value=1.0 1704067200000001000"] == [r["line"] for r in sinks.metric_lines(one, "ts", "region", "demand").collect()]
    assert sorted(lines)[0] == "market_demand,region=A value=8000.0 1704067200000000000"
    assert sorted(r["line"] for r in sinks.metric_lines(df, "ts", "region", "demand").collect()) == sorted(lines)


def test_sink_counts_what_its_manifests_have(spark, tmp_path):
    custom.register(spark)
    path = str(tmp_path / "alerts")
    rows = [("2024-01-01 00:00:00", r, 500.0, 1.0) for r in "ABCDEF"]
    df = spark.createDataFrame(rows, "ts string, region string, price double, demand double").repartition(3)
    read_ = lambda: sorted(json.loads(r["value"])["region"] for r in sinks.read_lines(spark, path).collect())
    write = lambda df, mode="append": df.write.format("market_alerts").option("path", f"file:{path}").mode(mode).save()
    write(df)
    (tmp_path / "alerts" / "part-left").write_text('{"region": "Z"}\n')  # of a task that failed
    assert read_() == list("ABCDEF")
    bad = df.withColumn("price", F.when(F.col("region") == "D", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="broken"):
        write(bad)
    assert read_() == list("ABCDEF")
    write(df.where("region < 'C'"))
    assert read_() == list("AABBCDEF")
    write(df.where("region = 'F'"), "overwrite")
    assert read_() == ["F"]


def test_stream_sink_commits_a_batch_once(tmp_path):
    from pyspark.sql import Row

    writer = sinks._MetricStream({"path": str(tmp_path)})
    row = Row(ts=sinks.EPOCH, region="A", demand=1.0)
    for batch in (0, 0, 1):
        writer.commit([writer.write(iter([row, row])), None], batch)
    manifests = [json.loads(p.read_text()) for p in sorted((tmp_path / "_manifest").glob("*.json"))]
    assert [m["rows"] for m in manifests] == [2, 2]
    assert {f for m in manifests for f in m["files"]} == {p.name for p in tmp_path.glob("part-*")}
    writer.abort([writer.write(iter([row]))], 2)
    assert len(list(tmp_path.glob("part-*"))) == 2


def test_folder_is_filled_once_and_again_if_it_is_gone(spark):
    made = []

    def fill(folder):
        made.append(folder)
        spark.range(3).write.parquet(folder)

    first = storage.once(spark, ("once", "a"), fill)
    assert storage.once(spark, ("once", "a"), fill) == first and storage.once(spark, ("once", "b"), fill) != first
    storage.remove(spark, first)
    again = storage.once(spark, ("once", "a"), fill)
    assert again != first and made[-1] == again and len(made) == 3 and spark.read.parquet(again).count() == 3
    with pytest.raises(ZeroDivisionError):
        storage.once(spark, ("once", "c"), lambda folder: 1 / 0)
    assert spark.read.parquet(storage.once(spark, ("once", "c"), fill)).count() == 3


def test_csv_binds_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rrp,region_id\n5.5,NSW1\njunk,VIC1\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), "region_id string, rrp double, missing int")
    assert [tuple(r) for r in df.collect()] == [("NSW1", 5.5, None), ("VIC1", None, None)]
    df.write.mode("overwrite").saveAsTable("csv_table")
    assert tables.read_table(spark, "csv_table").count() == 2
