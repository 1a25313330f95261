"""Aggregations (G1-G35): one grouped rollup, and the market's standard ones built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import above_group_percentile
from tidemark.operators.percentiles import exact_percentiles


def period(ts: str, unit: str = "hour") -> Column:
    """Start of the hour or day, in the type of a time without zone."""
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def rounded(c: Column, digits: int | None) -> Column:
    """For display; None leaves the value as it is."""
    return c if digits is None else F.round(c, digits)


def rollup_by(df: DataFrame, keys: Mapping[str, Column], measures: Mapping[str, Column]) -> DataFrame:
    """Group by named expressions and compute named measures: partial sums before the shuffle."""
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[c.alias(n) for n, c in measures.items()])


def demand_rollup(df: DataFrame, ts: str, region: str, demand: str, ratio: str, unit: str = "hour") -> DataFrame:
    """G1."""
    d = F.col(demand)
    return rollup_by(df, {unit: period(ts, unit), region: F.col(region)}, {"avg_demand": F.avg(d), "max_demand": F.max(d), "min_demand": F.min(d), "interval_count": F.count(F.lit(1)), "avg_ratio": F.avg(ratio)})


def daily_rollup(df: DataFrame, ts: str, region: str, demand: str, interchange: str) -> DataFrame:
    """G2 + B13: with the flag of net exporters, decided after the aggregation."""
    d = F.col(demand)
    out = rollup_by(df, {"day": F.to_date(ts), region: F.col(region)}, {"avg_demand": F.avg(d), "peak_demand": F.max(d), "min_demand": F.min(d), "avg_interchange": F.avg(interchange), "interval_count": F.count(F.lit(1))})
    return out.withColumn("is_net_exporter", F.col("avg_interchange") < 0)


def market_totals(df: DataFrame, ts: str, demand: str, generation: str) -> DataFrame:
    """All regions together, by hour."""
    return rollup_by(df, {"hour": period(ts)}, {"total_demand": F.sum(demand), "total_generation": F.sum(generation), "interval_count": F.count(F.lit(1))})


def demand_price_hourly(df: DataFrame, ts: str, region: str, demand: str, price: str, generation: str, interchange: str) -> DataFrame:
    """G4."""
    m = {"avg_demand_mw": F.avg(demand), "peak_demand_mw": F.max(demand), "min_demand_mw": F.min(demand), "avg_price": F.avg(price), "max_price": F.max(price), "min_price": F.min(price), "avg_generation_mw": F.avg(generation), "avg_interchange_mw": F.avg(interchange), "interval_count": F.count(F.lit(1))}
    return rollup_by(df, {"hour": period(ts), region: F.col(region)}, m)


def price_stats(df: DataFrame, ts: str, region: str, price: str, demand: str, unit: str = "hour") -> DataFrame:
    """Price by hour or day, with sample deviation."""
    m = {"avg_rrp": F.avg(price), "min_rrp": F.min(price), "max_rrp": F.max(price), "std_rrp": F.stddev(price), "avg_demand_mw": F.avg(demand), "peak_demand_mw": F.max(demand), "interval_count": F.count(F.lit(1))}
    return rollup_by(df, {unit: period(ts, unit), region: F.col(region)}, m)


def unit_hourly(df: DataFrame, ts: str, unit: str, value: str) -> DataFrame:
    """Output of each unit; ``total_mw`` sums power, energy is a twelfth of it."""
    return rollup_by(df, {"hour": period(ts), unit: F.col(unit)}, {"avg_mw": F.avg(value), "max_mw": F.max(value), "total_mw": F.sum(value), "energy_mwh": F.sum(value) / 12})


def supply_stack(df: DataFrame, at: Mapping[str, Column], value: str) -> DataFrame:
    """Output, running and idle units, and the largest unit of each interval."""
    v = F.col(value)
    return rollup_by(df, at, {"total_generation_mw": F.sum(F.when(v > 0, v).otherwise(0.0)), "active_unit_count": F.count(F.when(v > 0, 1)), "offline_unit_count": F.count(F.when((v <= 0) | v.isNull(), 1)), "largest_unit_mw": F.max(v), "total_duid_count": F.count(F.lit(1))})


def utilisation(df: DataFrame, keys: Mapping[str, Column], flow: str, losses: str, imports: str, exports: str) -> DataFrame:
    """Flows, losses and limits, and the share of the larger limit that is used."""
    limit = F.greatest(F.abs(F.col(imports)), F.abs(F.col(exports)), F.lit(1.0))
    m = {"avg_flow_mw": F.avg(flow), "max_flow_mw": F.max(flow), "min_flow_mw": F.min(flow), "avg_losses_mw": F.avg(losses), "avg_import_limit": F.avg(imports), "avg_export_limit": F.avg(exports), "avg_utilisation_pct": F.avg(F.abs(F.col(flow)) / limit * 100), "interval_count": F.count(F.lit(1))}
    return rollup_by(df, keys, m)


def forecast_accuracy(df: DataFrame, ts: str, region: str) -> DataFrame:
    """Over rows with demand_error_mw, price_error, actual_demand_mw and lead_time_minutes."""
    e, p = F.col("demand_error_mw"), F.col("price_error")
    m = {"demand_mae_mw": F.avg(F.abs(e)), "demand_bias_mw": F.avg(e), "demand_mape_pct": F.avg(F.try_divide(F.abs(e), F.col("actual_demand_mw")) * 100), "price_mae": F.avg(F.abs(p)), "price_bias": F.avg(p), "avg_lead_minutes": F.avg("lead_time_minutes"), "interval_count": F.count(F.lit(1))}
    return rollup_by(df, {"hour": period(ts), region: F.col(region)}, m)


def last_in_hour(df: DataFrame, ts: str, region: str, values: Sequence[str], tie: str | None = None) -> DataFrame:
    """The newest values of each hour, decided by time and not by the order of rows."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return rollup_by(df, {"hour": period(ts), region: F.col(region)}, {v: F.max_by(v, order) for v in values})


def summary(df: DataFrame, keys: Mapping[str, Column], price: str, demand: str, digits: int | None = 2) -> DataFrame:
    """Rounded price and demand figures for any keys."""
    m = {"avg_price": rounded(F.avg(price), digits), "max_price": rounded(F.max(price), digits), "min_price": rounded(F.min(price), digits), "avg_demand": rounded(F.avg(demand), digits), "n": F.count(F.lit(1))}
    return rollup_by(df, keys, m)


def spikes(df: DataFrame, region: str, price: str, threshold: float = 300, digits: int | None = 2) -> DataFrame:
    """G16."""
    high = df.where(F.col(price) > threshold)
    return rollup_by(high, {region: F.col(region)}, {"spike_count": F.count(F.lit(1)), "avg_spike": rounded(F.avg(price), digits), "max_spike": F.max(price)})


def volatility(df: DataFrame, region: str, price: str, digits: int | None = 2) -> DataFrame:
    """G17."""
    return rollup_by(df, {region: F.col(region)}, {"volatility": rounded(F.stddev(price), digits), "price_range": rounded(F.max(price) - F.min(price), digits), "avg_price": rounded(F.avg(price), digits)})


def kpis(df: DataFrame, price: str, demand: str, threshold: float = 300, digits: int | None = 2) -> DataFrame:
    """One row."""
    return df.agg(rounded(F.avg(price), digits).alias("avg_price"), F.max(price).alias("max_price"), rounded(F.avg(demand), digits).alias("avg_demand"), F.count(F.when(F.col(price) > threshold, 1)).alias("spike_count"))


def percentiles(df: DataFrame, keys: Mapping[str, Column], value: str, shares: Mapping[str, float], exact: bool = True) -> DataFrame:
    """Exact percentiles of many small groups, or approximate ones in bounded memory.

    For few large groups see ``tidemark.operators.percentiles``.
    """
    if exact:
        return rollup_by(df, keys, {n: F.percentile(value, F.lit(s)) for n, s in shares.items()})
    return rollup_by(df, keys, {n: F.percentile_approx(value, s, 10_000) for n, s in shares.items()})


def spike_summary(df: DataFrame, region: str, value: str, peak: Column, share: float = 0.95) -> DataFrame:
    """Rows above their region's percentile, by region and peak."""
    high = above_group_percentile(df, region, value, share)
    return rollup_by(high, {region: F.col(region), "is_peak": peak}, {"spike_count": F.count(F.lit(1)), "avg_spike": F.avg(value), "max_spike": F.max(value)})


def error_metrics(df: DataFrame, predicted: str, actual: str, keys: Sequence[str] = (), floor: float = 0.01) -> DataFrame:
    """MAE, RMSE, MAPE with the divisor held at ``floor`` at least, bias."""
    e = F.col(predicted) - F.col(actual)
    share = F.abs(e) / F.greatest(F.abs(F.col(actual)), F.lit(floor)) * 100
    return df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(share).alias("mape"), F.avg(e).alias("bias"), F.count(F.lit(1)).alias("n"))


def drift(df: DataFrame, ts: str, value: str, unit: str = "day") -> DataFrame:
    """Mean and spread of predictions by period."""
    return rollup_by(df, {unit: period(ts, unit)}, {"avg_value": F.avg(value), "std_value": F.stddev(value), "n": F.count(F.lit(1))})


def capacity(df: DataFrame, key: str, value: str, null: str = "Unknown") -> DataFrame:
    """Sums with null as 0 under a name for null keys, largest first."""
    out = rollup_by(df, {key: F.coalesce(F.col(key), F.lit(null))}, {"capacity": F.sum(F.coalesce(F.col(value), F.lit(0.0))), "n": F.count(F.lit(1))})
    return out.orderBy(F.desc("capacity"), key)


def distinct_counts(df: DataFrame, *names: str, approximate: bool = False) -> DataFrame:
    """G21."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(n).alias(f"n_{n}") for n in names])


def column_profile(df: DataFrame, *names: str) -> DataFrame:
    """Count, mean, deviation, least and most of each column, one row a column; one pass."""
    cells = df.agg(*[c for n in names for c in (F.count(n).alias(f"{n}_c"), F.avg(n).alias(f"{n}_a"), F.stddev(n).alias(f"{n}_s"), F.min(n).cast("double").alias(f"{n}_l"), F.max(n).cast("double").alias(f"{n}_h"))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"{n}_c").alias("n"), F.col(f"{n}_a").alias("mean"), F.col(f"{n}_s").alias("std"), F.col(f"{n}_l").alias("least"), F.col(f"{n}_h").alias("most")) for n in names])).alias("r")
    return cells.select(each).select("r.*")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Bins of equal width; what lies outside goes to bin 0 or bins + 1."""
    v = df.where(F.col(value).isNotNull())
    return rollup_by(v, {"bin": F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))}, {"n": F.count(F.lit(1))})


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and the fences 1.5 ranges beyond them."""
    q = exact_percentiles(df, key, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    iqr = F.col("q3") - F.col("q1")
    return q.join(ends, key).select(key, "q1", "median", "q3", (F.col("q1") - 1.5 * iqr).alias("low_fence"), (F.col("q3") + 1.5 * iqr).alias("high_fence"), "least", "most")


def class_counts(df: DataFrame, label: Column, name: str = "label") -> DataFrame:
    """G31."""
    return rollup_by(df, {name: label}, {"n": F.count(F.lit(1))})


def energy(df: DataFrame, keys: Mapping[str, Column], power: str, per_hour: int = 12) -> DataFrame:
    """Energy of intervals, ``per_hour`` to the hour."""
    return rollup_by(df, keys, {"total_mwh": F.sum(power) / per_hour, "n": F.count(F.lit(1))})


def verification(df: DataFrame, ts: str, price: str, demand: str, digits: int | None = 2) -> DataFrame:
    """G33."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(F.to_date(ts)).alias("min_date"), F.max(F.to_date(ts)).alias("max_date"), rounded(F.avg(price), digits).alias("avg_price"), rounded(F.avg(demand), digits).alias("avg_demand"))


def multi_aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[tuple[str, str]]) -> DataFrame:
    """A list of (function, column), so one column may take several functions."""
    return df.groupBy(*keys).agg(*[getattr(F, f)(c).alias(f"{f}_{c}") for f, c in measures])


def freshness(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Newest time over several tables; each is reduced to one row before they meet."""
    newest = [df.agg(F.max(ts).cast("timestamp_ntz").alias("newest")) for df, ts in tables]
    out = newest[0]
    for one in newest[1:]:
        out = out.union(one)
    return out.agg(F.max("newest").alias("newest"), F.count(F.lit(1)).alias("n_tables"))


def coverage(df: DataFrame, hour: str, *measures: str) -> DataFrame:
    """Hours covered, and the mean of each measure."""
    return df.agg(F.countDistinct(hour).alias("hours"), *[F.avg(m).alias(f"mean_{m}") for m in measures])
