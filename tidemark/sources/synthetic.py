"""Made-up series of any length, for demonstrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.schemas import REGIONS


def region_series(spark: SparkSession, rows: int, start: str = "2024-01-01 00:05:00", regions: Sequence[str] = REGIONS, minutes: int = 5, seed: int = 1) -> DataFrame:
    """``rows`` intervals of every region; the same seed gives the same rows."""
    grid = spark.range(rows).select("id", F.explode(F.array(*map(F.lit, regions))).alias("region_id"))
    ts = (F.lit(start).cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * minutes).cast("int"))).alias("settlement_date")
    draw = F.pmod(F.xxhash64("id", "region_id", F.lit(seed)), F.lit(10_000)) / 10_000
    demand = 5000 + 2000 * F.sin(F.col("id") * (6.283185307179586 * minutes / 1440)) + 500 * draw
    return grid.select(ts, "region_id", demand.alias("total_demand_mw"), (demand * 1.15).alias("available_generation_mw"), (draw * 400 - 200).alias("net_interchange_mw"), (40 + 60 * draw).alias("rrp"))
