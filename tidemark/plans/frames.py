"""The driver's tables in the roles of market tables, in Spark and in SQL, and the register of queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.storage import scratch  # noqa: F401  (queries take it from here)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Events as market intervals: one row an interval and region, with price, demand, generation, interchange, weather.
MARKET_SQL = """m AS (
  SELECT event_id, ts AS settlement_date, event_type AS region_id, user_id, value AS rrp,
         5000 + 40 * k AS total_demand_mw, 5500 + 40 * k + 10 * (user_id % 100) AS available_generation_mw,
         20 * k - 1000 AS net_interchange_mw, 5000 + 40 * k + 10 * (event_id % 7 - 3) AS demand_forecast_mw,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE k / 2 END AS air_temp_c
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_market(table(spark, sf_dir, "events"))


def as_market(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        "event_id", F.col("ts").alias("settlement_date"), F.col("event_type").alias("region_id"), "user_id", F.col("value").alias("rrp"),
        (5000 + 40 * k).alias("total_demand_mw"), (5500 + 40 * k + 10 * (F.col("user_id") % 100)).alias("available_generation_mw"),
        (20 * k - 1000).alias("net_interchange_mw"), (5000 + 40 * k + 10 * (F.col("event_id") % 7 - 3)).alias("demand_forecast_mw"),
        F.when(F.col("event_id") % 10 != 0, k / 2).alias("air_temp_c"),
    )


def query(sql: str | None = None, rounded: Sequence[str] = (), ints: Sequence[str] = ()):
    """Register a query under its name, with its SQL. ``rounded``: columns held to eight digits on both sides, as sums
    of doubles depend on their order. ``ints``: columns cast to bigint."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            changed = {c: F.round(F.col(c), 8) for c in rounded} | {c: F.col(c).cast("bigint") for c in ints}
            return df.withColumns(changed) if changed else df

        QUERIES[f.__name__] = run
        if sql is not None:
            text = sql.replace("{m}", f"WITH {MARKET_SQL}").replace("{m,}", f"WITH {MARKET_SQL},")
            same = [f'round("{c}", 8) AS "{c}"' for c in rounded] + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints]
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(same)}) FROM ({text})" if same else text
        return f

    return keep
