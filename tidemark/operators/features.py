"""Feature sets for load and price models (L1-L6), by entity; nothing crosses from one entity to another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.operators import windows as W

LOAD_LAGS = (1, 2, 3, 6, 12, 48, 288)
PRICE_LAGS = (1, 2, 3, 6, 12)
WEATHER = ("air_temp_c", "apparent_temp_c", "rel_humidity_pct", "wind_speed_kmh")
HOUR, DAY = 12, 288


def time_features(ts: str, month: bool = True) -> dict[str, Column]:
    """Calendar columns, and hour and day of week around the circle."""
    names = C.calendar(ts)
    out = {k: v for k, v in names.items() if month or k != "month"}
    return out | C.cyclical("hour", names["hour"], 24) | C.cyclical("dow", names["day_of_week"], 7)


def _fills(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    return {n: n for n in names if n in df.columns}


def _complete(df: DataFrame, times: Mapping[str, Column]) -> DataFrame:
    """Rows without a null. Columns made from the time are null only where it is, so they aren't worked out to see that."""
    return df.dropna(subset=[c for c in df.columns if c not in times])


def load_features(df: DataFrame, entity: str = "region_id", ts: str = "settlement_date", lag_steps: Sequence[int] = LOAD_LAGS, day_rows: int = DAY, drop: bool = True, tie: str | None = None) -> DataFrame:
    """L1: demand lags, rolling figures, price, weather carried forward, error of the published forecast.

    With ``drop`` incomplete rows go, as a model can't use them.
    """

    def make(over):
        return W.lags("total_demand_mw", lag_steps, over, "demand") | {
            "demand_rolling_1h_mean": W.rolling("total_demand_mw", HOUR, over),
            "demand_rolling_1h_std": W.rolling("total_demand_mw", HOUR, over, "stddev"),
            "rrp_lag_1": F.lag("rrp", 1).over(over),
            "rrp_rolling_1h_mean": W.rolling("rrp", HOUR, over),
        }

    out = W.in_chunks(df, entity, ts, make, max(*lag_steps, day_rows, HOUR), tie, fills=_fills(df, WEATHER), means={"demand_rolling_1d_mean": ("total_demand_mw", day_rows)}).withColumns(times := time_features(ts))
    if "demand_forecast_mw" in df.columns:
        out = out.withColumn("published_forecast_error", F.col("demand_forecast_mw") - F.col("total_demand_mw"))
    return _complete(out, times) if drop else out


def price_features(df: DataFrame, entity: str = "region_id", ts: str = "settlement_date", drop: bool = True, tie: str | None = None) -> DataFrame:
    """L2: supply margin and its history, demand, generation, interchange, price momentum."""

    def make(over):
        added = W.lags("total_demand_mw", (1, 12), over, "demand") | {
            "demand_rolling_1h_mean": W.rolling("total_demand_mw", HOUR, over),
            "gen_lag_1": F.lag("available_generation_mw", 1).over(over),
            "margin_lag_1": F.lag("supply_margin_mw", 1).over(over),
            "margin_rolling_1h_mean": W.rolling("supply_margin_mw", HOUR, over),
            "margin_rolling_1h_min": W.rolling("supply_margin_mw", HOUR, over, "min"),
            "interchange_lag_1": F.lag("net_interchange_mw", 1).over(over),
            "interchange_rolling_1h": W.rolling("net_interchange_mw", HOUR, over),
        }
        added |= W.lags("rrp", PRICE_LAGS, over, "rrp")
        return added | {"rrp_rolling_1h_mean": W.rolling("rrp", HOUR, over), "rrp_rolling_1h_std": W.rolling("rrp", HOUR, over, "stddev"), "rrp_rolling_1h_max": W.rolling("rrp", HOUR, over, "max")}

    rows = df.withColumn("supply_margin_mw", F.col("available_generation_mw") - F.col("total_demand_mw"))
    if "demand_forecast_mw" in df.columns:
        rows = rows.withColumn("demand_forecast_error", F.col("demand_forecast_mw") - F.col("total_demand_mw"))
    out = W.in_chunks(rows, entity, ts, make, max(*PRICE_LAGS, HOUR), tie, fills=_fills(rows, ("air_temp_c", "wind_speed_kmh"))).withColumns(times := time_features(ts, month=False))
    return _complete(out, times) if drop else out


def minimal_features(df: DataFrame, target: str, entity: str = "region_id", ts: str = "settlement_date", tie: str | None = None) -> DataFrame:
    """L3: calendar, one lag, one rolling mean, gaps filled both ways."""
    lag = f"{target}_lag_1"
    first = W.in_chunks(df, entity, ts, lambda over: {lag: F.lag(target, 1).over(over), f"{target}_rolling_12": F.avg(target).over(over.rowsBetween(-11, 0))}, 12, tie)
    return W.fill(first, entity, ts, {lag: lag}, tie, [lag]).withColumns(C.calendar(ts))


def simple_features(df: DataFrame, target: str, entity: str = "region_id", ts: str = "settlement_date", steps: Sequence[int] = (1, 2, 3, 6, 12, 24, 48), tie: str | None = None) -> DataFrame:
    """L4: lags, rolling mean over 12 rows, month around the circle."""
    made = W.in_chunks(df, entity, ts, lambda over: W.lags(target, steps, over, target) | {f"{target}_rolling_mean_12": W.rolling(target, 12, over)}, max(*steps, 12), tie)
    return made.withColumns(C.cyclical("month", F.month(ts), 12))


def adaptive_features(df: DataFrame, entity: str = "region_id", ts: str = "settlement_date", tie: str | None = None) -> DataFrame:
    """L1 + W12: only the lags and rolling means that every entity's history allows."""
    allowed = W.affordable(df, entity, sorted({*LOAD_LAGS, HOUR, DAY}))
    means = {f"demand_rolling_{name}_mean": ("total_demand_mw", n) for n, name in ((HOUR, "1h"), (DAY, "1d")) if n in allowed}

    def make(over):
        return W.lags("total_demand_mw", [k for k in LOAD_LAGS if k in allowed], over, "demand")

    made = W.in_chunks(df, entity, ts, make, max(allowed, default=1), tie, means=means) if allowed else df
    return made.withColumns(time_features(ts))


#: The declared features (function, column, duration).
TRAINING_FEATURES: Mapping[str, tuple[str, str, str]] = {
    "demand_avg_1h": ("avg", "total_demand_mw", "01:00:00"),
    "demand_max_1h": ("max", "total_demand_mw", "01:00:00"),
    "demand_avg_24h": ("avg", "total_demand_mw", "24:00:00"),
    "demand_max_24h": ("max", "total_demand_mw", "24:00:00"),
    "rrp_avg_1h": ("avg", "rrp", "01:00:00"),
    "rrp_max_1h": ("max", "rrp", "01:00:00"),
    "rrp_avg_6h": ("avg", "rrp", "06:00:00"),
    "rrp_std_6h": ("stddev_pop", "rrp", "06:00:00"),
    "rrp_max_24h": ("max", "rrp", "24:00:00"),
    "generation_avg_1h": ("avg", "available_generation_mw", "01:00:00"),
    "generation_min_6h": ("min", "available_generation_mw", "06:00:00"),
    "interchange_avg_1h": ("avg", "net_interchange_mw", "01:00:00"),
    "demand_std_24h": ("stddev_pop", "total_demand_mw", "24:00:00"),
    "interval_count_1h": ("count", "total_demand_mw", "01:00:00"),
}


def labelled(df: DataFrame, threshold: float = 300) -> DataFrame:
    return df.withColumn("is_spike", F.when(F.col("rrp") > threshold, 1).otherwise(0))


def training_set(df: DataFrame, threshold: float = 300, entity: str = "region_id", ts: str = "settlement_date") -> DataFrame:
    """Labels and features as of just before each row."""
    return W.trailing(labelled(df, threshold), entity, ts, TRAINING_FEATURES)


def scoring_set(new: DataFrame, history: DataFrame, entity: str = "region_id", ts: str = "settlement_date", measures: Mapping[str, tuple[str, str, str]] = TRAINING_FEATURES) -> DataFrame:
    """New rows with the declared features as of just before each, from the history and the new rows before it.

    Only as much of the history is read as the longest frame reaches back from the first new row.
    """
    reach = max(W.seconds(d) for _, _, d in measures.values())
    first = new.agg(F.min(ts)).first()[0]
    columns = list(dict.fromkeys([entity, ts, *[c for _, c, _ in measures.values()]]))
    if first is None:
        past = history.limit(0)
    else:
        past = history.where((F.col(ts) >= F.lit(first) - F.make_dt_interval(secs=F.lit(reach))) & (F.col(ts) < F.lit(first)))
    rows = past.select(*columns, F.lit(None).cast(T.StructType(new.schema.fields)).alias("_new")).unionByName(new.select(*columns, F.struct("*").alias("_new")))
    return W.trailing(rows, entity, ts, measures).where(F.col("_new").isNotNull()).select("_new.*", *measures)


def save_features(df: DataFrame, table: str, mode: str = "overwrite") -> None:
    """L6."""
    df.write.mode(mode).saveAsTable(table)


def calendar_table(days: DataFrame, day: str) -> DataFrame:
    """Features of each date."""
    return days.select(F.to_date(day).alias("date")).distinct().withColumns({"day_of_week": F.weekday("date"), "month": F.month("date"), "is_weekend": F.weekday("date").isin(5, 6).cast("int")})
