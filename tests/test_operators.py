import re
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import clean, features, joins, layout, metrics, models, percentiles, quality, ranking, rollups, sinks, windows
from tidemark.plans.medallion import market
from tidemark.sources import synthetic

BRONZE = [
    ("2025-06-01 10:05:00", "NSW1", "8111.25", "9000.0", "-310.0", "1"), ("2025-06-01 10:05:00", "VIC1", "4987.5", "5150.0", "75.25", "1"),
    ("2025-06-01 10:05:00", "QLD1", "6420.0", "7000.0", "-12.5", "1"), (None, "SA1", "1650.0", "1900.0", "44.0", "1"),
    ("2025-06-01 10:10:00", "NSW1", "8222.75", "9100.0", "-290.0", "2"), ("2025-06-01 10:10:00", "VIC1", "5012.5", "5200.0", "80.0", "2"),
    ("2025-06-01 10:05:00", "NOWHERE", "-7", "0", "0", "1"),
]
BRONZE_SCHEMA = ", ".join(f"{n} string" for n in clean.REGION_SUM)


@pytest.fixture(scope="module")
def bronze(spark):
    return spark.createDataFrame(BRONZE, BRONZE_SCHEMA)


def test_golden_chain(spark, bronze):
    silver = market.build("silver_demand", {"bronze_demand": bronze})
    assert silver.count() == 5
    hourly = {r["region_id"]: r for r in market.build("gold_hourly", {"bronze_demand": bronze}).collect()}
    assert {k: v["interval_count"] for k, v in hourly.items()} == {"NSW1": 2, "VIC1": 2, "QLD1": 1}
    assert hourly["NSW1"]["avg_demand"] == pytest.approx(8167.0) and hourly["NSW1"]["max_demand"] == 8222.75 and hourly["NSW1"]["min_demand"] == 8111.25
    first = silver.where("region_id = 'NSW1'").orderBy("settlement_date").first()
    assert first["demand_generation_ratio"] == pytest.approx(8111.25 / 9000)
    assert market.build("gold_hourly", {"bronze_demand": bronze.limit(0)}).count() == 0
    market.publish(spark, {"bronze_demand": bronze})
    assert spark.table("gold_daily").count() == 3


def test_casts_that_never_raise(spark):
    df = spark.createDataFrame([('"2024/01/01 12:05:00"', " 1.5 "), ("junk", "-"), ("", ""), (None, None)], "t string, x string")
    rows = df.select(C.parse_time("t").alias("t"), C.parse_double("x").alias("x")).collect()
    assert [str(r["t"]) for r in rows] == ["2024-01-01 12:05:00", "None", "None", "None"]
    assert [r["x"] for r in rows] == [1.5, None, None, None]


def test_region_filter_needs_the_column(spark):
    df = spark.createDataFrame([("A",)], "DUID string")
    assert clean.only_regions(df, ["NSW1"]).count() == 1


def test_dead_letters(spark):
    rows = [("t", "NSW1", "7000"), ("t", "VIC1", "5000"), (None, "QLD1", "6000"), ("t", "XX", "1"), ("t", "NSW1", "-500"), ("t", None, "1"), ("t", "NSW1", None), ("t", "NSW1", "abc")]
    df = spark.createDataFrame(rows, "SETTLEMENTDATE string, REGIONID string, TOTALDEMAND string")
    good, bad = quality.dead_letters(df, quality.demand_reasons(), ["SETTLEMENTDATE", "REGIONID", "TOTALDEMAND"])
    assert good.count() == 3
    assert sorted(r["_error_reason"] for r in bad.collect()) == ["INVALID_DEMAND"] * 3 + ["INVALID_REGION", "NULL_REGION"]


def test_expect_or_fail(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert quality.expect_or_fail(df, {"positive": "x > 0"}).count() == 2
    with pytest.raises(Exception, match="rule broken: small"):
        quality.expect_or_fail(df, {"small": "x < 2"}).collect()


def test_every_rule_set_resolves():
    assert all(quality.RULES[k] for k in quality.RULES) and len(quality.RULES) >= 15


def test_fault_tolerant_load_runs_once(spark, bronze):
    work = spark.createDataFrame([("a", "NSW1"), ("b", "VIC1")], "partition_id string, region string")
    read = lambda todo: bronze.join(todo, bronze.REGIONID == todo.region).drop("region")
    for _ in range(2):
        quality.fault_tolerant_load(work, read, quality.demand_reasons(), ["REGIONID", "TOTALDEMAND"], "ft_good", "ft_bad", "ft_done")
    assert spark.table("ft_good").count() == 4 and spark.table("ft_done").count() == 2 and spark.table("ft_bad").count() == 0


def test_fault_tolerant_load_may_break(spark, bronze, monkeypatch):
    work = spark.createDataFrame([("a", "NSW1"), ("b", "VIC1"), ("c", "NOWHERE")], "partition_id string, region string")
    asked = []

    def read(todo):
        asked.append(sorted(r["partition_id"] for r in todo.collect()))
        return bronze.join(todo, bronze.REGIONID == todo.region).drop("region")

    def load():
        quality.fault_tolerant_load(work, read, quality.demand_reasons(), ["REGIONID", "TOTALDEMAND"], "fb_good", "fb_bad", "fb_done")

    with monkeypatch.context() as broken:
        broken.setattr(quality, "mark_done", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            load()
    load()
    load()
    assert asked == [["a", "b", "c"], ["a", "b", "c"], []]
    assert spark.table("fb_good").count() == 4 and spark.table("fb_bad").count() == 1 and spark.table("fb_done").count() == 3


@pytest.mark.parametrize("step", ["first write", "second write", "mark", "view", None])
def test_corrected_rows_replace_those_of_a_load_that_broke(spark, monkeypatch, step):
    """Broken at any step, then corrected: each row is in one of the two tables, and row 2 no longer among the letters."""
    name = f"fc_{(step or 'none').replace(' ', '_')}"
    into = ({"NEGATIVE": "v < 0"}, ["id", "v"], f"{name}_good", f"{name}_bad", f"{name}_done")
    work = spark.createDataFrame([("a",), ("b",)], "partition_id string")
    made = lambda *rows: lambda todo: spark.createDataFrame(rows, "id int, v int, partition_id string").join(todo, "partition_id", "left_semi")
    old = made((1, 5, "a"), (2, -5, "a"), (3, -1, "b"))
    with monkeypatch.context() as broken:
        if step in ("first write", "second write"):
            write, left = quality.append_attempt, [int(step == "second write")]

            def fails(*args):
                if not left[0]:
                    raise ZeroDivisionError
                left[0] -= 1
                write(*args)

            broken.setattr(quality, "append_attempt", fails)
        elif step:
            broken.setattr(quality, "mark_done" if step == "mark" else "show_committed", lambda *_: 1 / 0)
        if step:
            with pytest.raises(ZeroDivisionError):
                quality.fault_tolerant_load(work, old, *into)
        else:
            quality.fault_tolerant_load(work, old, *into)
    rows = lambda: [sorted((r["id"], r["v"]) for r in spark.table(f"{name}_{t}").select("id", "v").collect()) for t in ("good", "bad")]
    new = made((1, 5, "a"), (2, 6, "a"), (3, 7, "b"))
    quality.fault_tolerant_load(work, new, *into)
    marked = step in ("view", None)  # then both units are done, and stay as they are
    assert rows() == ([[(1, 5)], [(2, -5), (3, -1)]] if marked else [[(1, 5), (2, 6), (3, 7)], []])
    quality.fault_tolerant_load(work.where("partition_id = 'b'"), made((3, 8, "b")), *into, again=True)
    assert rows() == ([[(1, 5), (3, 8)], [(2, -5)]] if marked else [[(1, 5), (2, 6), (3, 8)], []])


def test_table_writes(spark):
    a = spark.createDataFrame([(1,)], "x int")
    sinks.write_table(a, "w_table", "overwrite")
    sinks.write_table(spark.createDataFrame([(2, "b")], "x int, y string"), "w_table", merge_schema=True)
    assert sorted((r["x"], r["y"]) for r in spark.table("w_table").collect()) == [(1, None), (2, "b")]
    with pytest.raises(ValueError):
        sinks.write_table(spark.createDataFrame([(2, 1)], "x int, z int"), "w_table")
    spark.sql("CREATE OR REPLACE VIEW w_view AS SELECT 1 AS x")
    sinks.write_table(a, "w_view", "overwrite")
    assert quality.table_present(spark, "w_view") and spark.table("w_view").count() == 1


def test_layouts_prune(spark, tmp_path):
    df = synthetic.region_series(spark, 24 * 12 * 70)
    sinks.write_partitioned(df, str(tmp_path / "p"), "settlement_date")
    sinks.write_clustered(df, str(tmp_path / "c"), ["settlement_date", "region_id"], files=4)
    read = spark.read.parquet(str(tmp_path / "p"))
    q = layout.some_months(read, "settlement_date", "region_id", "rrp", ["NSW1", "VIC1"], "2024-02-01", "2024-02-03")
    plan = q._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan.replace("PartitionFilters: [((", "PartitionFilters: [isnotnull((") and "PushedFilters" in plan
    assert {r["n"] for r in q.collect()} == {576}
    assert layout.file_report(spark.read.parquet(str(tmp_path / "c"))).first()["n_files"] == 4
    times = layout.timed(spark, {("q4", "clustered"): lambda: layout.full_scan(read, "region_id", "rrp"), ("q4", "partitioned"): lambda: layout.full_scan(read, "region_id", "rrp")})
    assert layout.winners(times, "clustered", "partitioned").first()["winner"] in ("clustered", "partitioned", "similar")
    df.limit(5).write.mode("overwrite").saveAsTable("analysed")
    layout.analyze(spark, "analysed")


def test_as_of_boundary(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("b", 5, 3)], "k string, ts int, id int")
    right = spark.createDataFrame([("a", 10, "x"), ("a", 15, "y"), ("b", 5, "z")], "k string, ts int, v string")
    strict = {r["id"]: r["as_of_v"] for r in joins.as_of(left, right, "k", "ts", ["v"]).collect()}
    loose = {r["id"]: r["as_of_v"] for r in joins.as_of(left, right, "k", "ts", ["v"], include_current=True).collect()}
    assert strict == {1: None, 2: "y", 3: None} and loose == {1: "x", 2: "y", 3: "z"}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=30))
def test_windows_against_plain_python(spark, series):
    rows = [(k, i, None if v is None else float(v)) for i, (k, v) in enumerate(series)]
    df = spark.createDataFrame([(k, i * 40_000, v) for k, i, v in rows], "k string, ts int, v double").withColumn("id", F.col("ts"))
    made = windows.in_chunks(df, "k", "ts", lambda over: {"l": F.lag("v", 2).over(over), "m": windows.rolling("v", 3, over)}, 3, chunk_rows=4)
    filled = windows.fill(made.withColumn("w", F.col("v")), "k", "ts", {"v": "f", "w": "fb"}, both_ways=["w"])
    got = {r["ts"]: r for r in filled.collect()}
    assert len(got) == len(rows)
    for key in "ab":
        own = [(t, v) for k, t, v in rows if k == key]
        for i, (t, _) in enumerate(own):
            last = [v for _, v in own[max(0, i - 2) : i + 1]]
            known, later = [v for _, v in own[: i + 1] if v is not None], [v for _, v in own[i:] if v is not None]
            t *= 40_000  # two or three rows a bucket of time
            assert got[t]["l"] == (own[i - 2][1] if i >= 2 else None)
            assert got[t]["m"] == (pytest.approx(sum(last) / 3) if len(last) == 3 and None not in last else None)
            assert got[t]["f"] == (known[-1] if known else None)
            assert got[t]["fb"] == (known[-1] if known else later[0] if later else None)


def test_temporal_split_keeps_both_sides(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(2)], "k string, ts int")
    n = {(r["k"], r["is_train"]): r["count"] for r in windows.temporal_split(df, "k", "ts").groupBy("k", "is_train").count().collect()}
    assert n == {("a", True): 8, ("a", False): 2, ("b", True): 1, ("b", False): 1}


def test_long_means_are_put_together_from_short_frames(spark):
    values = [None if i in (7, 100) else 1000.0 + (i * 37) % 101 for i in range(400)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, ts int, v double")
    lengths = {f"m{n}": n for n in (1, 2, 7, 12, 23, 48, 288)}
    made = windows.in_chunks(df, "k", "ts", lambda over: {}, 288, chunk_rows=300, means={m: ("v", n) for m, n in lengths.items()}).collect()
    assert len(made) == 400 and set(made[0].asDict()) == {"k", "ts", "v", *lengths}
    for r in made:
        for m, n in lengths.items():
            last = values[max(0, r["ts"] + 1 - n) : r["ts"] + 1]
            assert r[m] == (pytest.approx(sum(last) / n, rel=1e-12) if len(last) == n and None not in last else None)


def test_no_frame_of_load_features_is_long(spark):
    """Spark goes over a frame for each row, so the work of a day's frame is 288 times that of the rows."""
    df = synthetic.region_series(spark, 10, regions=("A",))
    for made in (features.load_features(df), features.adaptive_features(synthetic.region_series(spark, 300, regions=("A",)))):
        assert "demand_rolling_1d_mean" in made.columns
        frames = re.findall(r"RowFrame, -([0-9]+), currentrow", made._jdf.queryExecution().optimizedPlan().toString())
        assert frames and max(map(int, frames)) < 20


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8, 1.0])
def test_temporal_split_is_that_of_one_numbering(spark, share):
    """Times none, one, or many to a bucket; the share ends within a bucket, at its end, and among rows without a time."""
    rows = [("a", i * 7_000, i) for i in range(60)] + [("b", 5, i) for i in range(9)] + [("c", None, i) for i in range(8)] + [("c", 3, 8), ("c", 200_000, 9)]
    rows += [(None, i, i) for i in range(4)] + [(None, None, 4), ("one", 1, 0), ("two", 1, 0), ("two", None, 1)]
    df = spark.createDataFrame(rows, "k string, ts int, id int")
    got = windows.temporal_split(df, "k", "ts", share, tie="id")
    assert got.columns == ["k", "ts", "id", "is_train"]
    expected = []
    for key in {k for k, _, _ in rows}:
        own = sorted((t is not None, t or 0, i) for k, t, i in rows if k == key)
        cut = max(1, min(len(own) - 1, int(len(own) * share)))
        expected += [(key, t if known else None, i, n < cut) for n, (known, t, i) in enumerate(own)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_features_are_worked_out_once_for_a_model(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(v):
        seen.add(1)
        return v

    df = synthetic.region_series(spark, 40, regions=("A", "B")).withColumn("x", F.udf(told, "double").asNondeterministic()("rrp")).where("x IS NOT NULL")
    _, later = models.train_regressor(df, ["x"], "total_demand_mw", "region_id", "settlement_date", trees=1, depth=1)
    assert later.count() == 16 and seen.value == 80
    labelled = df.withColumn("label", (F.minute("settlement_date") > 20).cast("int"))
    _, later = models.train_classifier(labelled, ["x"], "label", "region_id", "settlement_date", trees=1, depth=1)
    assert later.count() == 16 and seen.value == 160


@pytest.mark.parametrize(("limit", "pools"), [(1_000, [4]), (50, [2]), (10, [1])])
def test_fits_run_side_by_side_where_rows_are_few(spark, monkeypatch, limit, pools):
    """Side by side, fits keep all their rows in memory at once; results are the same however many they are."""
    made = []
    pool = models.ThreadPool
    monkeypatch.setattr(models, "ROWS_AT_ONCE", limit)
    monkeypatch.setattr(models, "ThreadPool", lambda n: made.append(n) or pool(n))
    df = spark.createDataFrame([(1_000_000 * i, float(i % 5), float(i % 3)) for i in range(24)], "t long, y double, x double").withColumn("ts", F.timestamp_micros("t"))
    found = models.search(df, {"x": models.Candidate(column="x")}, "y", "ts").collect()
    assert made == pools and [(r["fold"], r["n"]) for r in found] == [(1, 6), (2, 6), (3, 6)]


def test_a_fit_is_dealt_to_all_cores_and_does_not_depend_on_files(spark, monkeypatch):
    """All cores wait for the largest part at each level of each tree; thresholds come from a draw that parts and their order decide."""
    df = spark.range(15_000).selectExpr("if(id % 2 = 0, 'a', 'b') AS k", "timestamp_seconds(id * 60) AS ts", "cast(pmod(xxhash64(id), 1000003) AS double) AS x").withColumn("y", F.sqrt("x") + F.col("x") % 7)
    seen = []
    learner = models.GBTRegressor
    monkeypatch.setattr(models.GBTRegressor, "_fit", lambda self, rows, fit=learner._fit: seen.append(rows.rdd.glom().map(len).collect()) or fit(self, rows))
    thresholds = []
    for n in (1, 7):
        model, _ = models.train_regressor(df.repartition(n), ["x"], "y", "k", "ts", trees=2, depth=3)
        thresholds.append(re.findall(r"<= ([-0-9.E]+)", model.stages[-1].toDebugString))
    assert seen[0] == seen[1] and sum(seen[0]) == 12_000 and len(seen[0]) == 4 and max(seen[0]) < 3_300
    assert thresholds[0] == thresholds[1] and len(thresholds[0]) > 7
    monkeypatch.setattr(models, "FIT_ROWS", 1_000)
    assert models.dealt(df, ["ts", "k"]).rdd.getNumPartitions() == 16


def test_columns_of_the_time_are_made_only_where_asked_for(spark):
    df = synthetic.region_series(spark, 40, regions=("A", "B")).withColumn("demand_forecast_mw", F.col("total_demand_mw"))
    for out in (features.load_features(df, lag_steps=(1, 2), day_rows=24), features.price_features(df.withColumns({"available_generation_mw": F.col("total_demand_mw"), "net_interchange_mw": F.col("rrp")}))):
        plan = out.select("demand_lag_1")._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "demand_lag_1" in plan and "weekday(" not in plan
        assert {"hour_sin", "dow_cos", "is_weekend"} <= set(out.columns) and out.count() == out.dropna().count() > 0


def test_rows_are_sorted_by_a_number_first_and_no_key_stands_for_two(spark):
    rows = [(k, t, i) for i, (k, t) in enumerate((k, t) for k in (None, "", "-", "2D", ":", "-:") for t in (None, 0, 1, -1, 5_000, None))]
    df = spark.createDataFrame(rows, "k string, ts int, id int")
    got = {r["id"]: r["_at"] for r in windows.numbered(df, "k", "ts", "id").collect()}
    plain = df.withColumn("_at", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")) - 1)
    assert got == {r["id"]: r["_at"] for r in plain.collect()}
    plan = windows.numbered(df.withColumn("ts", F.timestamp_seconds("ts")), "k", "ts", "id", fills={"ts": "ts"})._jdf.queryExecution().executedPlan().toString()
    inside = re.findall(r"row_number\(\) windowspecdefinition\((\w+)", plan)
    assert inside and set(inside) == {"_place"}


def test_feature_properties(spark):
    df = synthetic.region_series(spark, 576, regions=("A", "B")).withColumn("demand_forecast_mw", F.col("total_demand_mw") + 10)
    out = features.load_features(df).persist()
    assert 200 < out.where("region_id = 'A'").count() < 576
    assert out.dropna().count() == out.count()
    assert out.where("abs(hour_sin) > 1 OR abs(dow_cos) > 1").count() == 0
    assert out.where("abs(published_forecast_error - 10) > 1e-9").count() == 0
    first = out.where("region_id = 'A'").orderBy("settlement_date").first()
    day_before = df.where("region_id = 'A'").orderBy("settlement_date").first()
    assert first["demand_lag_288"] == day_before["total_demand_mw"]
    price = features.price_features(df)
    assert price.where("abs(supply_margin_mw - (available_generation_mw - total_demand_mw)) > 1e-9").count() == 0
    assert "demand_lag_288" not in features.adaptive_features(df.where("settlement_date < '2024-01-01 12:00:00'")).columns


def test_models(spark):
    df = features.load_features(synthetic.region_series(spark, 200, regions=("A", "B")), lag_steps=(1, 2), day_rows=24).withColumn("label", (F.col("rrp") > 70).cast("int"))
    names = ["demand_lag_1", "hour_sin", "hour_cos"]
    model, later = models.train_regressor(df, names, "total_demand_mw", "region_id", "settlement_date", trees=3, depth=3)
    scores = models.regression_scores(later, "total_demand_mw")
    assert 0 < scores["mae"] <= scores["rmse"] < 4000
    assert sum(w for _, w in models.importances(model, names)) == pytest.approx(1)
    empty = models.score(df.limit(0), model, ["region_id"], "total_demand_mw", "demand", 1)
    assert empty.count() == 0 and "predicted_demand" in empty.columns
    board = models.leaderboard({"tree": later, "worse": later.withColumn("prediction", F.col("prediction") + 500)}, "prediction", "total_demand_mw").collect()
    assert [r["model"] for r in board] == ["tree", "worse"]
    _, predicted = models.train_classifier(df, names, "label", "region_id", "settlement_date", stratified=True, trees=2, depth=2)
    assert 0 <= models.classification_scores(predicted, "label")["auc"] <= 1


def test_metric_view_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        metrics.PRICE.query(spark.range(1), ["nothing"], ["avg_price"])


def test_bands_at_their_limits(spark):
    df = spark.createDataFrame([(99.0,), (100.0,), (300.0,), (1000.0,)], "p double")
    assert [r[0] for r in df.select(C.price_status("p")).collect()] == ["NORMAL", "ELEVATED", "HIGH", "CRITICAL"]
    C.register_python_scalar(spark, "twice", lambda x: x * 2, "double")
    assert spark.sql("SELECT twice(2.0D)").first()[0] == 4.0
    C.register_sql_functions(spark)
    assert spark.sql("SELECT market_stress_score(1000D, -1500D, 350D), demand_regime(9100D, 20D)").first()[:] == (100.0, "extreme_peak")


def test_small_side_is_measured(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    assert "broadcast" in joins.small(df)._jdf.queryExecution().toString()
    assert "broadcast" not in joins.small(df, limit=1)._jdf.queryExecution().toString()


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3)], "k string, ts int, id int")
    assert joins.latest(df, ["k"], [F.desc("ts"), F.desc("id")]).first()["id"] == 3
    assert joins.latest_by(df, ["k"], "ts", ["id"], "id").first()["id"] == 3
    assert ranking.best_group(df, ["k"], F.sum("id"), "s").first()["s"] == 6
    assert rollups.distinct_counts(df, "ts", approximate=True).first()[0] == 2


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_exact_percentiles_of_few_groups(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=1500).tolist(), "b": [1.0] * 700 + [2.0, None], "c": [3.0], None: rng.integers(0, 5, 300).astype(float).tolist()}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    shares = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in percentiles.exact_percentiles(df, "k", "v", shares, accuracy).collect()}
    for k, vs in groups.items():
        for n, s in shares.items():
            assert got[k][n] == pytest.approx(np.quantile([v for v in vs if v is not None], s))
    assert percentiles.exact_percentiles(df.limit(0), "k", "v", shares).count() == 0


def test_features_move_rows_twice_and_fill_across_an_hour_put_back(spark):
    df = synthetic.region_series(spark, 600, regions=("A", "B")).withColumn("id", F.monotonically_increasing_id())
    names = {"total_demand_mw", "rrp"} & set(df.columns)
    assert names == {"total_demand_mw", "rrp"}
    out = features.load_features(df.withColumn("air_temp_c", F.col("rrp")), tie="id")
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") <= 5 and plan.count("Window ") <= 3  # three of the exchanges have a row for each hour only
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = spark.range(6).selectExpr("'a' AS k", "timestamp_seconds(1729986000 + 1800 * id) AS ts", "id", "if(id % 3 = 0, id, null) AS v")  # 2024-10-27, around 03:00
        got = windows.fill(rows, "k", "ts", {"v": "f"}, "id").orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["f"] for r in got] == [0, 0, 0, 3, 3, 3]


def test_exact_percentiles_of_many_groups_one_of_them_hot(spark):
    import numpy as np

    n, groups = 60_000, 5000
    df = spark.range(n).selectExpr("if(id % 3 = 0, 7, pmod(xxhash64(id), 5000)) AS k", "cast(pmod(xxhash64(id, 1), 1000003) AS double) / 7 AS v")
    held = {}
    for r in df.collect():
        held.setdefault(r["k"], []).append(r["v"])
    got = {r["k"]: r for r in percentiles.exact_percentiles(df, "k", "v", {"p5": 0.05, "p95": 0.95}, 200).collect()}
    assert len(held[7]) > n / 3 and len(held) > 0.99 * groups and set(got) == set(held)
    for k, vs in held.items():
        assert (got[k]["p5"], got[k]["p95"]) == pytest.approx(tuple(np.quantile(vs, [0.05, 0.95])))


def test_chunks_equal_one_window(spark):
    df = synthetic.region_series(spark, 150, regions=("A", "B")).withColumn("id", F.monotonically_increasing_id())
    make = lambda over: {"l": F.lag("rrp", 12).over(over), "m": windows.rolling("rrp", 12, over)}
    plain = df.withColumns(make(Window.partitionBy("region_id").orderBy("settlement_date", "id"))).select("region_id", "settlement_date", "l", "m")
    cut = windows.in_chunks(df, "region_id", "settlement_date", make, 12, "id", chunk_rows=20, bucket="hour").select("region_id", "settlement_date", "l", "m")
    key = lambda r: (r["region_id"], r["settlement_date"])
    a, b = sorted(plain.collect(), key=key), sorted(cut.collect(), key=key)
    assert len(a) == len(b) == 300
    assert all(x["l"] == y["l"] and (x["m"] is None) == (y["m"] is None) and (x["m"] is None or abs(x["m"] - y["m"]) < 1e-9) for x, y in zip(a, b))
    assert windows.in_chunks(df, "region_id", "settlement_date", make, 12, "id", chunk_rows=5).count() == 300  # a chunk is as long as the look back


def test_rows_without_entity_or_time_stay(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), (None, 1, 7.0), (None, 2, 8.0), ("a", None, 9.0)], "k string, ts int, v double")
    made = windows.in_chunks(df, "k", "ts", lambda over: {"l": F.lag("v", 1).over(over)}, 2)
    assert sorted((str(r["k"]), str(r["ts"]), r["l"]) for r in made.collect()) == [("None", "1", None), ("None", "2", 7.0), ("a", "1", 9.0), ("a", "2", 5.0), ("a", "None", None)]
    assert windows.temporal_split(df, "k", "ts").count() == 5 and windows.fill(df, "k", "ts", {"v": "v"}).count() == 5
    stamped = df.withColumn("ts", F.timestamp_seconds("ts"))
    out = windows.trailing(stamped, "k", "ts", {"n": ("count", "v", "00:00:10"), "m": ("avg", "v", "00:00:10")})
    assert sorted((str(r["k"]), r["v"], r["n"], r["m"]) for r in out.collect()) == [("None", 7.0, 0, None), ("None", 8.0, 0, None), ("a", 5.0, 0, None), ("a", 6.0, 1, 5.0), ("a", 9.0, 0, None)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400), st.one_of(st.none(), st.integers(-9, 9))), min_size=1, max_size=40), st.booleans(), st.sampled_from([None, 10, 30]))
def test_trailing_against_plain_python(spark, series, current, bucket):
    rows = [(i, k, t, None if v is None else v + 0.1) for i, (k, t, v) in enumerate(series)]
    df = spark.createDataFrame(rows, "id int, k string, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    measures = {f"{f}_{d[6:]}_{d[3:5]}": (f, "v", d) for f in ("count", "sum", "avg", "stddev_pop", "min", "max") for d in ("00:00:30", "00:01:30")}
    got = {r["id"]: r for r in windows.trailing(df, "k", "ts", measures, current, bucket).collect()}
    assert len(got) == len(rows)
    for i, k, t, _ in rows:
        for name, (f, _, d) in measures.items():
            own = [v for _, j, u, v in rows if j == k and v is not None and t - windows.seconds(d) <= u and (u <= t if current else u < t)]
            want = len(own) if f == "count" else None if not own else {"sum": sum(own), "avg": statistics.fmean(own), "stddev_pop": statistics.pstdev(own), "min": min(own), "max": max(own)}[f]
            assert got[i][name] == (want if want is None else pytest.approx(want, abs=1e-9))


def test_no_stage_has_as_few_tasks_as_entities(spark):
    df = synthetic.region_series(spark, 300, regions=("A",)).withColumn("air_temp_c", F.lit(1.0))
    for out in (features.load_features(df), features.price_features(df), features.minimal_features(df, "rrp"), features.training_set(df), windows.temporal_split(df, "region_id", "settlement_date"), joins.as_of(df, df, "region_id", "settlement_date", ["rrp"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windowed = re.findall(r"Window \[.*?\], \[(.*?)\]", plan)
        # a window over the entity alone is over days or buckets: below it stands the aggregate that makes them
        for keys in windowed:
            assert "," in keys or re.search(r"_e#|_lk#|_key#", keys), keys


def test_stratified_split_is_the_same_on_any_partitions(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 7 = 0, 1, if(id % 50 = 1, null, 0)) AS y")
    splits = [{r["id"]: r["is_train"] for r in models.stratified_split(df.repartition(n), "y", ["id"], 0.75).collect()} for n in (1, 5)]
    assert splits[0] == splits[1] and len(splits[0]) == 1000
    counts = {r["y"]: (r["n"], r["t"]) for r in models.stratified_split(df, "y", ["id"], 0.75).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_train").cast("int")).alias("t")).collect()}
    assert all(t == int(n * 0.75 + 0.5) for n, t in counts.values()) and set(counts) == {0, 1, None}
    other = {r["id"]: r["is_train"] for r in models.stratified_split(df, "y", ["id"], 0.75, seed=8).collect()}
    assert other != splits[0]
    same = spark.range(40).selectExpr("1 AS id", "0 AS y")  # one key for all rows
    assert models.stratified_split(same, "y", ["id"], 0.5).where("is_train").count() == 20
    assert models.stratified_split(df.limit(0), "y", ["id"]).count() == 0


def test_search_trains_before_and_tests_after_each_origin(spark):
    df = spark.range(400).selectExpr("id", "timestamp_seconds(1704067200 + 300 * id) AS ts", "id % 4 AS k", "cast(id % 4 * 10 AS double) AS y", "cast(id % 4 * 10 + 1 AS double) AS off", "cast(id % 4 AS double) AS x")
    candidates = {"off": models.Candidate(column="off"), "mean": models.Candidate(keys=["k"]), "trees": models.Candidate(features=["x"], options={"trees": 3, "depth": 2})}
    rows = {(r["model"], r["fold"]): r for r in models.search(df, candidates, "y", "ts", 4).collect()}
    assert len(rows) == 12 and all(r["n"] == 80 for r in rows.values())
    assert all(rows["off", i]["mae"] == 1 and rows["mean", i]["mae"] == 0 and rows["trees", i]["mae"] < 0.5 for i in range(1, 5))
    new = models.Candidate(keys=["id"]).predict(df.where("id < 4"), df.where("id >= 4"), "y")  # keys never seen: the mean of all
    assert {r["prediction"] for r in new.collect()} == {15.0}
    assert models.search(df.limit(0), candidates, "y", "ts").count() == 0
    assert models.search(df.limit(1), candidates, "y", "ts").count() == 0
