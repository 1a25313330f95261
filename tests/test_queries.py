"""Every registered query of the library against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from tests.conftest import SMALL
from tidemark.operators import features, models
from tidemark.plans import registry

LARGER = SMALL.replace("0.001", "0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    def views(folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return {folder: views(folder) for folder in (SMALL, LARGER)}


def plain(v):
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return ("number", float(v) + 0.0)
    return (type(v).__name__, str(v))


def rows_of(rows, order):
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    folder = LARGER if name == "scored_rows" else SMALL  # the smallest tables have no history of a day's rows
    df = registry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    ran = duck[folder].execute(registry.oracle_sql()[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == columns
    expected = rows_of(ran.fetchall(), [names.index(c) for c in columns])
    assert rows_of(df.select(*columns).collect(), range(len(columns))) == expected


def test_approximate_percentile_is_near_the_exact_one(spark):
    exact = {r["region_id"]: r["p95"] for r in registry.queries()["percentiles"](spark, SMALL).collect()}
    for r in registry.queries()["approx_p95"](spark, SMALL).collect():
        assert abs(r["p95"] - exact[r["region_id"]]) < 0.1 * exact[r["region_id"]]


def test_model_queries_give_rows(spark):
    scored = registry.queries()["train_score"](spark, SMALL)
    assert {"predicted_demand", "forecast_error_demand", "model_version"} <= set(scored.columns)
    assert scored.count() > 0
    spikes = registry.queries()["spike_classifier"](spark, SMALL).collect()
    assert spikes and {r["predicted"] for r in spikes} <= {0, 1}
    ranked = registry.queries()["model_importances"](spark, SMALL).collect()
    weights = [r["importance"] for r in ranked]
    assert [r["place"] for r in ranked] == list(range(1, len(ranked) + 1)) and weights == sorted(weights, reverse=True)
    assert sum(weights) == pytest.approx(1) and "hour_sin" in {r["feature"] for r in ranked}


def test_model_queries_take_the_operators_parameters(spark, monkeypatch):
    fitted = {}

    def kept(name, train):
        def run(rows, inputs, *args, **options):
            model, later = train(rows, inputs, *args, **options)
            fitted[name] = (model.stages[-1], inputs)
            return model, later

        return run

    for name in ("train_regressor", "train_classifier"):
        monkeypatch.setattr(models, name, kept(name, getattr(models, name)))
    scored = registry.queries()["train_score"](spark, SMALL.replace("0.001", "0.01"))
    assert scored.count() > 0
    registry.queries()["spike_classifier"](spark, SMALL)
    forest, inputs = fitted["train_regressor"]
    assert (forest.getNumTrees, forest.getOrDefault("maxDepth")) == (20, 5)
    assert {f"demand_lag_{k}" for k in features.LOAD_LAGS} | {"demand_rolling_1d_mean"} <= set(inputs)
    forest, _ = fitted["train_classifier"]
    assert (forest.getNumTrees, forest.getOrDefault("maxDepth")) == (15, 4)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["hour", "region_id", "avg_demand", "max_demand", "min_demand", "interval_count", "avg_ratio"]
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
