"""Projection, casts, filters and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C

#: Silver names and types of a bronze table of region sums (text in, typed out).
REGION_SUM = {
    "SETTLEMENTDATE": ("settlement_date", "time"),
    "REGIONID": ("region_id", "text"),
    "TOTALDEMAND": ("total_demand_mw", "double"),
    "AVAILABLEGENERATION": ("available_generation_mw", "double"),
    "NETINTERCHANGE": ("net_interchange_mw", "double"),
    "DISPATCHINTERVAL": ("dispatch_interval", "text"),
}


def project(df: DataFrame, mapping: Mapping[str, tuple[str, str]]) -> DataFrame:
    """B1: cast and rename by ``{column: (new name, time | text | double | any Spark type)}``."""

    def cast(name: str, kind: str) -> Column:
        if kind == "time":
            return C.parse_time(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name)
        if kind == "text":
            return F.col(name).cast("string")
        if kind == "double" and isinstance(df.schema[name].dataType, T.StringType):
            return C.parse_double(name)
        return F.col(name).try_cast(kind)

    return df.select(*[cast(name, kind).alias(new) for name, (new, kind) in mapping.items()])


def require_time(df: DataFrame, ts: str) -> DataFrame:
    """Rows whose event time is missing go."""
    return df.where(F.col(ts).isNotNull())


def only_regions(df: DataFrame, regions: Sequence[str], region: str = "REGIONID") -> DataFrame:
    """A table without the region column is left as it is."""
    return df.where(F.col(region).isin(*regions)) if region in df.columns and regions else df


def only_rows(df: DataFrame, kind: str = "D", column: str = "ROW_TYPE") -> DataFrame:
    """B6."""
    return df.where(F.col(column) == kind)


def stamp(df: DataFrame, name: str = "_ingested_at") -> DataFrame:
    """B7."""
    return df.withColumn(name, F.current_timestamp())


def recent(df: DataFrame, ts: str, as_of: datetime | str, interval: str) -> DataFrame:
    """The rows of the last ``interval`` (such as ``7 DAYS``) before a stated time; the bound reaches the scan."""
    return df.where(F.col(ts) >= F.lit(str(as_of)).cast(df.schema[ts].dataType) - F.expr(f"INTERVAL {interval}"))


def between(df: DataFrame, ts: str, start: datetime | str, end: datetime | str) -> DataFrame:
    """Half-open range of times."""
    kind = df.schema[ts].dataType
    return df.where((F.col(ts) >= F.lit(str(start)).cast(kind)) & (F.col(ts) < F.lit(str(end)).cast(kind)))


def fill(df: DataFrame, value: float, *names: str) -> DataFrame:
    """Null becomes ``value`` under the same name."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(value)) for n in names})


def margin(available: str, demand: str) -> Column:
    """B14."""
    return F.col(available) - F.col(demand)


def label_above(value: str, threshold: float) -> Column:
    """1 above the threshold, else 0; null counts as 0."""
    return F.when(F.col(value) > threshold, 1).otherwise(0)


def piecewise_price(demand: str) -> Column:
    """A price made up from demand, in three pieces."""
    d = F.col(demand)
    return F.when(d > 9000, 300 + (d - 9000) * 0.5).when(d > 7000, 100 + (d - 7000) * 0.1).otherwise(50 + d * 0.005)


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    """B17."""
    return df.select(*keys).distinct()


def shape_like(df: DataFrame, renamed: Mapping[str, str], constants: Mapping[str, object]) -> DataFrame:
    """Renamed columns and constants, to stand in for another result."""
    return df.select(*[F.col(a).alias(b) for a, b in renamed.items()], *[F.lit(v).alias(k) for k, v in constants.items()])


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in without]


def align(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exactly these columns as doubles, in this order; missing ones and nulls are 0."""
    have = set(df.columns)
    return df.select(*keys, *[(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)).alias(n) for n in names])
