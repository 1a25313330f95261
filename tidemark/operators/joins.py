"""Joins (J1-J10): equi, latest-row, aggregate joined back, dimensions, point in time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import columns as C
from tidemark.operators.percentiles import exact_percentiles
from tidemark.operators.storage import small

def curated(prices: DataFrame, demand: DataFrame, keys: Sequence[str], regions: Sequence[str], region: str, required: Sequence[str]) -> DataFrame:
    """Inner join on the keys, filters on either side first so that they reach the scans."""
    left = prices.where(F.col(region).isin(*regions))
    right = demand.where(F.col(region).isin(*regions))
    joined = left.join(right, list(keys))
    for name in required:
        joined = joined.where(F.col(name).isNotNull())
    return joined


def with_static(rows: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Left join with a dimension; works for streams. It is broadcast only if known to be small."""
    return rows.join(small(static), key, "left")


def left_keyed(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J4."""
    return left.join(right, list(keys), "left")


def latest(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The first row of each key. Ties are broken by the further columns given."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_by(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], tie: str | None = None) -> DataFrame:
    """The same by one aggregation, which sums up before it shuffles."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    newest = F.max_by(F.struct(ts, *values), order).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def forecast_vs_actual(forecasts: DataFrame, actuals: DataFrame, run: str, interval: str, region: str, pairs: Mapping[str, tuple[str, str, str, int]], intervention: str | None = "INTERVENTION", also: Sequence[str] = ()) -> DataFrame:
    """W1 + J5: the latest run of each interval against what happened. Runs are summed up before they are shuffled.

    ``actuals`` has the columns ``interval`` and ``region`` under the same names; where several of its rows may share both,
    ``also`` names further columns of both sides that tell them apart, or each would meet the others' runs. ``pairs`` maps the name of an
    error to (forecast column, actual column, suffix, digits); the columns come out as ``forecast_<suffix>`` and
    ``actual_<suffix>``.
    """
    if intervention:
        forecasts = forecasts.where(F.col(intervention) == "0")
    kept = F.struct(run, *[F.col(p).alias(f"forecast_{s}") for p, _, s, _ in pairs.values()])
    keys = [interval, region, *also]
    f = forecasts.groupBy(*keys).agg(F.max_by(kept, F.struct(run)).alias("_newest")).select(*keys, "_newest.*")
    a = actuals.select(*keys, *[F.col(q).alias(f"actual_{s}") for _, q, s, _ in pairs.values()])
    joined = f.join(a, keys)
    errors = [F.round(F.col(f"forecast_{s}") - F.col(f"actual_{s}"), digits).alias(name) for name, (_, _, s, digits) in pairs.items()]
    return joined.select(*keys, F.col(run).alias("forecast_run_time"), C.minutes_between(interval, run).alias("lead_time_minutes"), *[c for _, _, s, _ in pairs.values() for c in (f"forecast_{s}", f"actual_{s}")], *errors)


def above_group_percentile(df: DataFrame, key: str, value: str, share: float = 0.95, name: str = "p95") -> DataFrame:
    """Rows above the percentile of their group."""
    return df.join(exact_percentiles(df, key, value, {name: share}), key).where(F.col(value) > F.col(name))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, values: Sequence[str], include_current: bool = False, bucket: str = "day") -> DataFrame:
    """Each left row with the last right row of its key before its time (or up to it).

    Both sides are put into one sorted sequence for each key and bucket of time; the last right row seen so far is
    carried along, and from bucket to bucket: a window over a key holds one row a bucket. One shuffle of the rows, no
    range join. Right rows at the same time come before the left row only if ``include_current``. Left rows without
    a key or time find nothing.
    """
    carried = F.struct(F.col(ts).alias("ts"), *values)
    kind = right.select(carried.alias("c")).schema["c"].dataType
    rows = left.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct("*").alias("_left"), F.lit(None).cast(kind).alias("_right"))
    facts = right.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.lit(0 if include_current else 2).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), carried.alias("_right"))
    both = rows.unionByName(facts)
    both = both.withColumn("_b", C.time_bucket(both, "_ts", bucket))
    last = both.groupBy(F.col("_k").alias("_lk"), F.col("_b").alias("_lb")).agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.col("_ts"))).alias("_last"))
    earlier = Window.partitionBy("_lk").orderBy("_lb").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("_lk", "_lb", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy("_k", "_b").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.join(before, F.col("_k").eqNullSafe(F.col("_lk")) & F.col("_b").eqNullSafe(F.col("_lb")))
    seen = met.withColumn("_found", F.coalesce(F.last("_right", ignorenulls=True).over(inside), "_before")).where(F.col("_left").isNotNull())
    found = F.when(F.col("_k").isNotNull() & F.col("_ts").isNotNull(), F.col("_found"))
    return seen.select("_left", found.alias("_found")).select("_left.*", F.col("_found.ts").alias("as_of_time"), *[F.col(f"_found.{v}").alias(f"as_of_{v}") for v in values])


def with_errors(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """Predictions with what happened, the error, its size and its share."""
    joined = predictions.join(actuals, list(keys))
    error = F.col(predicted) - F.col(actual)
    return joined.withColumns({"error": error, "abs_error": F.abs(error), "pct_error": F.try_divide(F.abs(error), F.abs(F.col(actual))) * 100})


def best_available(model: DataFrame, published: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The model's prediction, else the published one; the source is tagged."""
    m = model.select(*keys, F.col(value).alias("_model"))
    p = published.select(*keys, F.col(value).alias("_published"))
    both = m.join(p, list(keys), "full")
    return both.where(F.coalesce("_model", "_published").isNotNull()).select(*keys, F.coalesce("_model", "_published").alias(value), F.when(F.col("_model").isNotNull(), "MODEL").otherwise("FALLBACK").alias("source"))
