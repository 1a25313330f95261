import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.streaming import ledgers, streams

SCHEMA = "ts timestamp, region string, value double"


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, "ts string, region string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/f{n}")


def run(spark, df, name, state):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def read(spark, folder, **k):
    return streams.file_stream(spark, f"{folder}/*", SCHEMA, **k)


def test_join_drops_late_rows_and_restarts(spark, tmp_path):
    a, b, state, out = (str(tmp_path / x) for x in ("a", "b", "state", "out"))
    put(spark, a, 1, [("2024-01-01 00:05:00", "A", 1.0), ("2024-01-01 00:10:00", "A", 2.0)])
    put(spark, b, 1, [("2024-01-01 00:05:00", "A", 10.0)])

    def once():
        left = read(spark, a).withColumnRenamed("value", "demand")
        right = read(spark, b).withColumnRenamed("value", "price")
        streams.append_files(streams.watermarked_join(left, right, ["ts", "region"], "ts"), out, state).awaitTermination()
        return sorted(r["price"] for r in spark.read.parquet(out).collect())

    assert once() == [10.0]
    put(spark, b, 2, [("2024-01-01 00:10:00", "A", 20.0), ("2024-01-01 02:00:00", "A", 30.0)])
    put(spark, a, 2, [("2024-01-01 02:00:00", "A", 3.0)])
    assert once() == [10.0, 20.0, 30.0]
    put(spark, a, 3, [("2024-01-01 00:20:00", "A", 9.0), ("2024-01-01 03:00:00", "A", 4.0)])
    put(spark, b, 3, [("2024-01-01 00:20:00", "A", 90.0), ("2024-01-01 03:00:00", "A", 40.0)])
    assert once() == [10.0, 20.0, 30.0, 40.0]


def test_ticks_are_distinct(spark, tmp_path):
    folder = str(tmp_path / "t")
    put(spark, folder, 1, [("2024-01-01 00:30:10", "A", 1.0), ("2024-01-01 00:30:40", "B", 1.0), ("2024-01-01 00:35:00", "A", 1.0)])
    put(spark, folder, 2, [("2024-01-01 00:30:59", "C", 1.0), ("2024-01-01 01:00:00", "A", 1.0)])
    out = run(spark, streams.half_hour_ticks(read(spark, folder, max_files=1), "ts"), "ticks", str(tmp_path / "s"))
    assert sorted(str(r[0]) for r in out.collect()) == ["2024-01-01 00:30:00", "2024-01-01 01:00:00"]


def test_hourly_waits_for_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "h")
    put(spark, folder, 1, [("2024-01-01 00:05:00", "A", 1.0), ("2024-01-01 00:50:00", "A", 3.0), ("2024-01-01 01:30:00", "A", 5.0)])
    out = run(spark, streams.hourly_stream(read(spark, folder), "ts", "region", "value"), "hourly", str(tmp_path / "s")).collect()
    assert [(str(r["hour"]), r["avg_value"], r["n"]) for r in out] == [("2024-01-01 00:00:00", 2.0, 2)]


def test_bronze_rules_and_tables(spark, tmp_path):
    folder = str(tmp_path / "b")
    put(spark, folder, 1, [("2024-01-01 00:05:00", "A", 1.0), ("2024-01-01 00:05:00", "A", 1.0), ("2024-01-01 00:10:00", "B", -1.0)])
    rules = {"positive": "value > 0", "fresh": "_ingested_at >= current_timestamp() - INTERVAL 1 DAY"}
    observed = quality.observe_rules(read(spark, folder), "rules", {"positive": "value > 0"})
    streams.append_table(streams.bronze(observed, rules), "bronze_stream", str(tmp_path / "s1"), None).awaitTermination()
    assert spark.table("bronze_stream").count() == 2
    for state in ("s2", "s3"):  # the second run has lost its checkpoint, and adds nothing
        streams.poll_into_tables(read(spark, folder), {"polled_a": ["ts", "region", "value"], "polled_b": ["ts", "region"]}, str(tmp_path / state), ["ts", "region"], "ts").awaitTermination()
    assert spark.table("polled_a").count() == 2 and spark.table("polled_b").count() == 2


def test_csv_and_report_streams(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("ROW_TYPE,SETTLEMENTDATE,RRP\nD,2024/01/01 00:05:00,5\nI,x,y\n")
    df = streams.csv_stream(spark, str(tmp_path / "csv"), "ROW_TYPE string, SETTLEMENTDATE string, RRP string", {"SETTLEMENTDATE": ("ts", "time"), "RRP": ("rrp", "double")})
    assert [r["rrp"] for r in run(spark, df, "csv_rows", str(tmp_path / "s1")).collect()] == [5.0]
    (tmp_path / "zip").mkdir()
    for i in (1, 2):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.csv", f"I,DISPATCH,PRICE,4,SETTLEMENTDATE,REGIONID,RRP\nD,DISPATCH,PRICE,4,2024/01/01 00:0{i}:00,NSW1,{i}\n")
        (tmp_path / "zip" / f"r{i}.zip").write_bytes(out.getvalue())
    got = run(spark, streams.report_stream(spark, str(tmp_path / "zip"), "DISPATCHPRICE", 1), "report_rows", str(tmp_path / "s2"))
    assert sorted(r["RRP"] for r in got.collect()) == [1.0, 2.0]


def test_observations_of_a_tick(spark, tmp_path):
    folder = str(tmp_path / "o")
    put(spark, folder, 1, [("2024-01-01 00:30:10", "A", 1.0)])
    docs = spark.createDataFrame([("2024-01-01 00:30:00", '[{"t": 1.5}, {"t": null}]')], "refresh_slot string, text string").withColumn("refresh_slot", F.col("refresh_slot").cast("timestamp"))
    out = run(spark, streams.expand_observations(streams.half_hour_ticks(read(spark, folder), "ts"), docs, "refresh_slot", "text", "t: double"), "obs", str(tmp_path / "s"))
    assert sorted(str(r["t"]) for r in out.collect()) == ["1.5", "None"]


# -- ledgers ------------------------------------------------------------------------------------------------
def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def figures(view, spark):
    return {(str(r["hour"]), r["region"]): (r["n"], r["avg_value"], r["std_value"], r["min_value"], r["max_value"]) for r in view.rows(spark).collect()}


def test_view_follows_late_rows_and_leaves_other_days(spark, tmp_path):
    folder, view = str(tmp_path / "in"), ledgers.HourlyView(str(tmp_path / "view"), "ts", ("region",), "value")

    def follow():
        view.follow(read(spark, folder), str(tmp_path / "state")).awaitTermination()

    put(spark, folder, 1, [("2024-01-02 00:05:00", "A", 1.0), ("2024-01-02 00:10:00", "A", 4.0), ("2024-01-02 00:10:00", None, 9.0), ("2024-01-03 07:00:00", "A", None), (None, "A", 5.0)])
    follow()
    before = files_of(tmp_path / "view")
    put(spark, folder, 2, [("2024-01-02 00:55:00", "A", 10.0), ("2024-01-02 00:20:00", None, 1.0), ("2024-01-01 23:59:59", "B", 2.0)])
    follow()
    after = files_of(tmp_path / "view")
    assert set(before.items()) <= set(after.items())
    assert {p.split("/")[1] for p in set(after) - set(before)} == {"day=2024-01-01", "day=2024-01-02"}
    assert figures(view, spark) == {
        ("2024-01-01 23:00:00", "B"): (1, 2.0, None, 2.0, 2.0),
        ("2024-01-02 00:00:00", "A"): (3, 5.0, pytest.approx(21**0.5), 1.0, 10.0),
        ("2024-01-02 00:00:00", None): (2, 5.0, pytest.approx(32**0.5), 1.0, 9.0),
        ("2024-01-03 07:00:00", "A"): (1, None, None, None, None),
    }
    follow()  # nothing new
    assert files_of(tmp_path / "view") == after
    rows = figures(view, spark)
    view.clean(spark)
    assert figures(view, spark) == rows and len(files_of(tmp_path / "view")) == 3


def test_view_after_a_batch_that_broke(spark, tmp_path, monkeypatch):
    view = ledgers.HourlyView(str(tmp_path / "view"), "ts", ("region",), "value")
    rows = lambda *r: spark.createDataFrame(r, "ts string, region string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    first, second = rows(("2024-01-01 00:05:00", "A", 1.0)), rows(("2024-01-01 00:10:00", "A", 3.0), ("2024-01-02 00:10:00", "A", 3.0))
    view.apply(first, "q-0")
    with monkeypatch.context() as broken:
        broken.setattr(ledgers, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            view.apply(second, "q-1")
    assert {k[0]: v[0] for k, v in figures(view, spark).items()} == {"2024-01-01 00:00:00": 1}
    for _ in range(2):
        view.apply(second, "q-1")
    view.apply(second.limit(0), "q-2")
    assert {k[0]: v[:2] for k, v in figures(view, spark).items()} == {"2024-01-01 00:00:00": (2, 2.0), "2024-01-02 00:00:00": (1, 3.0)}


def test_targets_show_whole_batches_only(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    targets = {"a": ["ts", "region", "value"], "b": ["ts", "region"]}
    read_all = lambda: [ledgers.read_target(spark, out, t, s).count() for t, s in (("a", SCHEMA), ("b", "ts timestamp, region string"))]
    assert read_all() == [0, 0]
    put(spark, folder, 1, [("2024-01-01 00:05:00", "A", 1.0), ("2024-01-01 00:05:00", "A", 1.0), ("2024-01-01 00:10:00", "B", -1.0)])
    ledgers.append_to_targets(read(spark, folder), out, targets, state, ["ts", "region"]).awaitTermination()
    assert read_all() == [2, 2]
    batch = spark.createDataFrame([(None, "C", 1.0)], SCHEMA)
    with pytest.raises(Exception):  # noqa: B017, PT011: the second target has a column that the batch lacks
        ledgers.write_batch(batch, "other-0", out, {"a": ["ts", "region", "value"], "b": ["nothing"]})
    assert read_all() == [2, 2]
    for _ in range(2):
        ledgers.write_batch(batch, "other-0", out, targets)
    assert read_all() == [3, 3]
    put(spark, folder, 2, [("2024-01-01 00:15:00", "A", 1.0)])
    ledgers.append_to_targets(read(spark, folder), out, targets, state, ["ts", "region"]).awaitTermination()
    assert read_all() == [4, 4]
