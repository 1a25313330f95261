"""Queries on events that the smallest tables don't have: equal times, odd prices, months of several files."""

import datetime

import pytest

from tests.test_queries import rows_of
from tidemark.plans import registry


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A table of events: (id, time, type, user, price, k); some share type and time, and the user or price differs."""

    def make(rows, files=1):
        folder = str(tmp_path_factory.mktemp("events"))
        df = spark.createDataFrame([(i, t, u, e, v, f'{{"k": {k}}}') for i, t, e, u, v, k in rows], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
        df.repartition(files).write.parquet(f"{folder}/events.parquet")
        return folder

    return make


def time(day, minute=0):
    return datetime.datetime(2024, 1, day) + datetime.timedelta(minutes=minute)


def agrees(spark, name, folder):
    """The query's rows, held against its SQL."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = registry.queries()[name](spark, folder)
    ran = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in ran.description]
    got = rows_of(df.select(*names).collect(), range(len(names)))
    assert got == rows_of(ran.fetchall(), range(len(names)))
    return got


def test_rules_hold_for_prices_of_zero_and_below(spark, events):
    prices = (0.0, -5.0, None, 10.0)
    assert len(agrees(spark, "rules_hold", events([(i, time(1, i), "view", 2, v, 1) for i, v in enumerate(prices)]))) == 4


def test_months_of_several_files_count_once(spark, events):
    folder = events([(i, time(1 + i % 25, i % 1440), "view", 2, float(i * 7919 % 1009), 1) for i in range(20000)], files=4)
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    kept = spark.conf.get(advisory)
    spark.conf.set(advisory, "16k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # as only what several tasks send is split
    try:
        assert agrees(spark, "file_sizes", folder)[0][0] == ("number", 1.0)
    finally:
        spark.conf.set(advisory, kept)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_and_folders_are_told_apart(spark, tmp_path):
    from tidemark.operators import layout

    spark.range(100).selectExpr("id", "id % 2 AS half").repartition(3).write.partitionBy("half").parquet(str(tmp_path / "t"))
    told = layout.file_report(spark.read.parquet(str(tmp_path / "t"))).first()
    assert (told["n_files"], told["n_folders"]) == (6, 2)


@pytest.fixture(scope="module")
def tied(events):
    """Pairs of events of one time and type, before and after the month's middle."""
    return events([(10 * day + i, time(day, day), "view" if i < 2 else "click", 2 + i, 40.0 + 7 * i + day, 30 + 10 * i) for day in (2, 9, 17, 20, 25, 28) for i in range(4)])


@pytest.mark.parametrize("name", ["forecast_vs_actual", "forecast_accuracy", "model_vs_published"])
def test_forecasts_of_events_of_one_time(spark, tied, name):
    assert agrees(spark, name, tied)


def test_layouts_join_by_event(spark, tied):
    assert agrees(spark, "layout_join", tied)


def test_late_events_of_one_time(spark, tied):
    assert len(agrees(spark, "stream_late", tied)) == 16


@pytest.mark.parametrize("n", [40, 400])
def test_tasks_of_time_frames_follow_the_rows(spark, events, monkeypatch, n):
    from tidemark.operators import windows

    monkeypatch.setattr(windows, "TASK_ROWS", 100)
    rows = registry.queries()["training_set"](spark, events([(i, time(1 + i % 25, i), "view", 2, 1.0 * i, 1) for i in range(n)]))
    assert rows.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, n // 20)  # three durations: a row comes five times
    assert rows.count() == n
