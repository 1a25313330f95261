"""Column builders: casts that never raise, calendar and cyclical columns, bands, mappings, SQL functions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

ColumnOrName = Column | str

#: Formats in which reports write times (fixed values).
TIME_FORMATS = ("yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss")

#: Fuel technologies of each category (fixed values).
FUEL_CATEGORIES = {
    "coal": ["coal_black", "coal_brown"],
    "gas": ["gas_ccgt", "gas_ocgt", "gas_steam", "gas_recip", "gas_wcmg"],
    "hydro": ["hydro"],
    "wind": ["wind"],
    "solar": ["solar_utility", "solar_rooftop"],
    "battery": ["battery_charging", "battery_discharging"],
    "other": ["bioenergy_biogas", "bioenergy_biomass", "distillate", "pumps"],
}


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: ColumnOrName) -> Column:
    """Trimmed, without quotes around."""
    return F.trim(F.regexp_replace(F.trim(col(c)), r'^"+|"+$', ""))


def parse_time(c: ColumnOrName, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """B2: the first format that fits, else null."""
    text = clean_text(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_double(c: ColumnOrName) -> Column:
    """Null for empty, "-" and anything that isn't a number."""
    text = clean_text(c)
    return F.when(~text.isin("", "-"), text).try_cast("double")


def ratio(top: ColumnOrName, bottom: ColumnOrName) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(col(top), col(bottom))


def peak_flag(ts: ColumnOrName, first: int = 17, last: int = 20) -> Column:
    """Hours ``first`` to ``last``, both included."""
    return F.hour(col(ts)).between(first, last)


def peak_label(ts: ColumnOrName, first: int = 17, last: int = 20) -> Column:
    return F.when(peak_flag(ts, first, last), "Peak").otherwise("Off-Peak")


def local_time(ts: ColumnOrName, zone: str = "+10:00") -> Column:
    """Display time of an instant kept in UTC."""
    return F.from_utc_timestamp(col(ts), zone)


def lookup(c: ColumnOrName, pairs: Mapping[str, str], default: str, null: str) -> Column:
    """map values, with one default for unknown values and one for null or empty ones."""
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    key = col(c)
    return F.when(key.isNull() | (key == ""), null).otherwise(F.coalesce(F.element_at(table, key), F.lit(default)))


def fuel_category(c: ColumnOrName) -> Column:
    """B20."""
    pairs = {tech: category for category, techs in FUEL_CATEGORIES.items() for tech in techs}
    return lookup(c, pairs, "other", "unknown")


def band(c: ColumnOrName, limits: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the highest limit reached; the last name below all of them. Limits fall."""
    value, result = col(c), None
    for limit, name in zip(limits, names, strict=False):
        result = F.when(value >= limit, name) if result is None else result.when(value >= limit, name)
    return result.otherwise(names[-1])


def price_status(c: ColumnOrName, warning: float = 100, alert: float = 300, critical: float = 1000) -> Column:
    """B21."""
    return band(c, (critical, alert, warning), ("CRITICAL", "HIGH", "ELEVATED", "NORMAL"))


def clip(c: ColumnOrName, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def calendar(ts: ColumnOrName) -> dict[str, Column]:
    """Hour, day of week (Monday is 0), month, weekend."""
    t = col(ts)
    return {"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "is_weekend": F.weekday(t).isin(5, 6).cast("int")}


def cyclical(name: str, value: Column, period: int) -> dict[str, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def minutes_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return F.round((F.unix_timestamp(col(later).cast("timestamp")) - F.unix_timestamp(col(earlier).cast("timestamp"))) / 60)


# The limits and names in the next four functions are fixed values, as are those of SQL_FUNCTIONS.


def demand_regime(demand: ColumnOrName, temperature: ColumnOrName) -> Column:
    d, t = col(demand), col(temperature)
    return F.when(d >= 9000, "extreme_peak").when(d >= 7500, "peak").when(t >= 35, "weather_driven_risk").when(d <= 4500, "off_peak").otherwise("normal")


def forecast_error_band(actual: ColumnOrName, predicted: ColumnOrName) -> Column:
    e = F.abs(col(predicted) - col(actual))
    return F.when(e < 50, "excellent").when(e < 150, "acceptable").when(e < 300, "watch").otherwise("intervene")


def price_spike_band(price: ColumnOrName) -> Column:
    p = col(price)
    return F.when(p >= 1000, "critical_spike").when(p >= 300, "high_spike").when(p <= -100, "negative_price_event").otherwise("normal")


def market_stress_score(margin: ColumnOrName, interchange: ColumnOrName, price: ColumnOrName) -> Column:
    m, x, p = col(margin), col(interchange), col(price)
    points = F.when(m <= 2000, 50.0).otherwise(10.0) + F.when(F.abs(x) >= 1000, 20.0).otherwise(5.0) + F.when(p >= 300, 30.0).when(p >= 150, 15.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), points))


#: U2 in SQL: signature, result type and body.
SQL_FUNCTIONS = {
    "demand_regime(d DOUBLE, t DOUBLE)": ("STRING", "CASE WHEN d >= 9000 THEN 'extreme_peak' WHEN d >= 7500 THEN 'peak' WHEN t >= 35 THEN 'weather_driven_risk' WHEN d <= 4500 THEN 'off_peak' ELSE 'normal' END"),
    "forecast_error_band(a DOUBLE, p DOUBLE)": ("STRING", "CASE WHEN abs(p - a) < 50 THEN 'excellent' WHEN abs(p - a) < 150 THEN 'acceptable' WHEN abs(p - a) < 300 THEN 'watch' ELSE 'intervene' END"),
    "price_spike_band(p DOUBLE)": ("STRING", "CASE WHEN p >= 1000 THEN 'critical_spike' WHEN p >= 300 THEN 'high_spike' WHEN p <= -100 THEN 'negative_price_event' ELSE 'normal' END"),
    "market_stress_score(m DOUBLE, x DOUBLE, p DOUBLE)": ("DOUBLE", "greatest(0D, least(100D, CASE WHEN m <= 2000 THEN 50D ELSE 10D END + CASE WHEN abs(x) >= 1000 THEN 20D ELSE 5D END + CASE WHEN p >= 300 THEN 30D WHEN p >= 150 THEN 15D ELSE 0D END))"),
}


def register_sql_functions(spark: SparkSession) -> None:
    """The same functions for SQL users of the session."""
    for signature, (result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")


#: Steps of a bucket of a time that is a number.
NUMBERS = 100_000


def time_bucket(df: DataFrame, ts: str, bucket: str = "day") -> Column:
    """The day (hour, ...) of a time; times that are numbers are cut into ranges of ``NUMBERS``."""
    if isinstance(df.schema[ts].dataType, NumericType):
        return F.floor(F.col(ts) / NUMBERS)
    return F.date_trunc(bucket, F.col(ts))


def register_python_scalar(spark: SparkSession, name: str, function, result: str) -> None:
    """A Python scalar function for SQL. Arrow moves its batches; an expression is faster where one exists."""
    spark.udf.register(name, F.udf(function, result, useArrow=True))
