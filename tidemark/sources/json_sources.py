"""Nested JSON: the registry of generators and weather observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.joins import latest_by

STATIONS = "array<struct<code: string, name: string, location: struct<state: string, lat: double, lng: double>, facilities: array<struct<code: string, fueltech_id: string, capacity_registered: double, status_id: string>>>>"
OBSERVATIONS = "observations struct<data: array<struct<local_date_time_full: string, air_temp: string, apparent_t: string, rel_hum: string, wind_spd_kmh: string, wind_dir: string, cloud_oktas: string, rain_trace: string, name: string>>>"


def flatten_registry(df: DataFrame, text: str = "value") -> DataFrame:
    """One row a unit from JSON lists of stations; units without a code are skipped."""
    station = df.select(F.explode(F.from_json(text, STATIONS)).alias("s"))
    unit = station.select("s.code", "s.name", "s.location", F.explode("s.facilities").alias("f")).where(F.col("f.code").isNotNull() & (F.col("f.code") != ""))
    fuel = F.col("f.fueltech_id")
    return unit.select(
        F.col("f.code").alias("DUID"), F.col("code").alias("station_code"), F.col("name").alias("station_name"), F.col("location.state").alias("state"),
        F.coalesce(fuel, F.lit("unknown")).alias("fueltech"), C.fuel_category(fuel).alias("fuel_category"), F.col("f.capacity_registered").alias("capacity_mw"),
        F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"), F.col("f.status_id").alias("status"),
    )


def read_registry(spark: SparkSession, path: str, state: str | None = None, fuel: str | None = None) -> DataFrame:
    """From files that hold one list each; the options are filters like any other."""
    out = flatten_registry(spark.read.text(path, wholetext=True))
    out = out.where(F.col("state") == state) if state else out
    return out.where(F.col("fuel_category") == fuel) if fuel else out


def flatten_weather(df: DataFrame, text: str = "value", region: Column | str = "region_id") -> DataFrame:
    """One row an observation; "-" and "" are null."""
    o = df.select((F.col(region) if isinstance(region, str) else region).alias("region_id"), F.explode(F.from_json(text, OBSERVATIONS)["observations"]["data"]).alias("o"))
    numbers = {"air_temp_c": "air_temp", "apparent_temp_c": "apparent_t", "rel_humidity_pct": "rel_hum", "wind_speed_kmh": "wind_spd_kmh", "cloud_oktas": "cloud_oktas", "rain_since_9am_mm": "rain_trace"}
    words = {"wind_dir": "wind_dir", "station_name": "name"}
    return o.select(
        "region_id", F.try_to_timestamp("o.local_date_time_full", F.lit("yyyyMMddHHmmss")).alias("observation_time"),
        *[C.parse_double(f"o.{v}").alias(k) for k, v in numbers.items()], *[F.col(f"o.{v}").alias(k) for k, v in words.items()],
    )


def latest_weather(df: DataFrame) -> DataFrame:
    """A15."""
    return latest_by(df, ["region_id"], "observation_time", [c for c in df.columns if c not in ("region_id", "observation_time")])
