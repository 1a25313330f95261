"""Named rules, dead letters, checkpointed loads (Q1-Q8)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.storage import checkpoint
from tidemark.sources.schemas import REGIONS

_REGION = f"region_id IN ({', '.join(repr(r) for r in REGIONS)})"
_FRESH = "_ingested_at >= current_timestamp() - INTERVAL 1 DAY"

#: Rule sets by stage (fixed bounds).
RULES: dict[str, dict[str, str]] = {
    "silver": {"valid_region": _REGION, "valid_demand": "total_demand_mw > 0 AND total_demand_mw < 20000", "valid_time": "settlement_date IS NOT NULL"},
    "unit_generation": {"valid_value": "scada_value >= 0"},
    "bronze_dispatch": {"valid_region": _REGION.replace("region_id", "REGIONID"), "valid_time": "SETTLEMENTDATE IS NOT NULL", "valid_intervention": "INTERVENTION IN ('0', '1')", "valid_demand": "TOTALDEMAND >= 0 AND TOTALDEMAND < 25000", "valid_generation": "AVAILABLEGENERATION >= 0 AND AVAILABLEGENERATION < 80000", "fresh": _FRESH},
    "bronze_price": {"valid_region": _REGION.replace("region_id", "REGIONID"), "valid_time": "SETTLEMENTDATE IS NOT NULL", "valid_intervention": "INTERVENTION IN ('0', '1')", "valid_price": "RRP BETWEEN -1500 AND 25000", "fresh": _FRESH},
    "bronze_forecast": {"valid_region": _REGION.replace("region_id", "REGIONID"), "valid_run": "RUN_DATETIME IS NOT NULL AND INTERVAL_DATETIME IS NOT NULL", "valid_order": "INTERVAL_DATETIME >= RUN_DATETIME", "valid_intervention": "INTERVENTION IN ('0', '1')", "valid_demand": "TOTALDEMAND >= 0 AND TOTALDEMAND < 25000", "valid_price": "RRP BETWEEN -1500 AND 25000", "fresh": _FRESH},
    "bronze_unit": {"valid_time": "SETTLEMENTDATE IS NOT NULL", "valid_unit": "DUID IS NOT NULL AND length(DUID) > 0", "valid_value": "abs(SCADAVALUE) <= 5000", "fresh": _FRESH},
    "bronze_interconnector": {"valid_time": "SETTLEMENTDATE IS NOT NULL", "valid_id": "INTERCONNECTORID IS NOT NULL AND length(INTERCONNECTORID) > 0", "valid_flow": "abs(MWFLOW) <= 15000", "valid_intervention": "INTERVENTION IN ('0', '1')", "fresh": _FRESH},
    "bronze_rooftop": {"valid_region": "REGIONID IS NOT NULL", "valid_time": "INTERVAL_DATETIME IS NOT NULL", "valid_power": "POWER >= 0 AND POWER < 15000", "fresh": _FRESH},
    "bronze_weather": {"valid_region": _REGION, "valid_time": "observation_time IS NOT NULL", "valid_temperature": "air_temp_c IS NULL OR air_temp_c BETWEEN -20 AND 60", "valid_humidity": "rel_humidity_pct IS NULL OR rel_humidity_pct BETWEEN 0 AND 100"},
    "silver_demand_weather": {"valid_region": _REGION, "valid_time": "settlement_date IS NOT NULL", "valid_demand": "total_demand_mw >= 0 AND total_demand_mw < 25000", "valid_generation": "available_generation_mw >= 0 AND available_generation_mw < 80000", "valid_price": "rrp BETWEEN -1500 AND 25000"},
    "silver_forecast": {"valid_region": _REGION, "valid_time": "settlement_date IS NOT NULL", "valid_lead": "lead_time_minutes BETWEEN 0 AND 180", "valid_demand": "actual_demand_mw >= 0 AND actual_demand_mw < 25000"},
    "silver_supply": {"valid_time": "SETTLEMENTDATE IS NOT NULL", "valid_total": "total_generation_mw >= 0", "valid_units": "total_duid_count > 0"},
    "gold_demand": {"valid_region": _REGION, "valid_hour": "hour IS NOT NULL", "valid_count": "interval_count BETWEEN 1 AND 12", "valid_demand": "avg_demand_mw >= 0 AND avg_demand_mw < 25000"},
    "gold_price": {"valid_region": _REGION, "valid_hour": "hour IS NOT NULL", "valid_count": "interval_count BETWEEN 1 AND 12", "valid_price": "avg_rrp BETWEEN -1500 AND 25000"},
    "gold_accuracy": {"valid_region": _REGION, "valid_hour": "hour IS NOT NULL", "valid_count": "interval_count BETWEEN 1 AND 12", "valid_mape": "demand_mape_pct IS NULL OR demand_mape_pct BETWEEN 0 AND 500"},
    "gold_interconnector": {"valid_id": "INTERCONNECTORID IS NOT NULL", "valid_hour": "hour IS NOT NULL", "valid_count": "interval_count BETWEEN 1 AND 12", "valid_utilisation": "avg_utilisation_pct >= 0"},
}


def _true(rule: str) -> Column:
    """A rule that is null counts as broken."""
    return F.coalesce(F.expr(rule), F.lit(False))


def expect_or_drop(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Q1: rows that break any rule go."""
    return df.where(reduce(lambda a, b: a & b, map(_true, rules.values()))) if rules else df


def expect_or_fail(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Q2: a row that breaks a rule fails the query with the rule's name. No column is added."""
    broken = F.coalesce(*[F.when(~_true(r), F.raise_error(F.lit(f"rule broken: {n}")).cast("boolean")) for n, r in rules.items()], F.lit(True))
    return df.where(broken)


def quality_counts(df: DataFrame, counters: Mapping[str, str]) -> DataFrame:
    """Q3: one row, with the total and how many rows meet each condition."""
    return df.agg(F.count(F.lit(1)).alias("total_records"), *[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in counters.items()])


def rule_report(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Q4: one row a rule, with rows passed, failed, and dropped by any rule; one pass over the data."""
    every = reduce(lambda a, b: a & b, map(_true, rules.values()))
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~every, 1)).alias("dropped"), *[F.count(F.when(_true(r), 1)).alias(f"p{i}") for i, r in enumerate(rules.values())])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"p{i}").alias("passed")) for i, name in enumerate(rules)])).alias("r")
    return sums.select("n", "dropped", each).select("r.rule", "r.passed", (F.col("n") - F.col("r.passed")).alias("failed"), F.col("dropped").alias("dropped_rows"))


def observe_rules(df: DataFrame, name: str, rules: Mapping[str, str]) -> DataFrame:
    """Q4 for streams: the same counts as metrics of each micro-batch."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(~_true(r), 1)).alias(n) for n, r in rules.items()])


def dead_letters(df: DataFrame, reasons: Mapping[str, str], original: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Q5: (good, bad). ``reasons`` maps a code to the condition under which a row is bad, the first one wins.

    A condition that is null does not hold. Bad rows have the code, the time, and their columns as JSON.
    """
    code = F.coalesce(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in reasons.items()])
    marked = df.withColumn("_error_reason", code)
    bad = marked.where(F.col("_error_reason").isNotNull()).withColumns({"_error_timestamp": F.current_timestamp(), "_original_data": F.to_json(F.struct(*original))})
    return marked.where(F.col("_error_reason").isNull()).drop("_error_reason"), bad


def demand_reasons(region: str = "REGIONID", demand: str = "TOTALDEMAND", regions: Sequence[str] = REGIONS) -> dict[str, str]:
    """Reason codes for text rows of region demand; a demand that is null or no number is bad too."""
    names = ", ".join(repr(r) for r in regions)
    return {
        "NULL_REGION": f"{region} IS NULL",
        "INVALID_REGION": f"{region} NOT IN ({names})",
        "INVALID_DEMAND": f"try_cast({demand} AS DOUBLE) IS NULL OR try_cast({demand} AS DOUBLE) <= 0",
    }


def partition_id(*parts: str | Column) -> Column:
    """Twelve hex digits that stand for a unit of work."""
    return F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])), 1, 12)


def pending(work: DataFrame, done: DataFrame, key: str = "partition_id") -> DataFrame:
    """Q6: the units that aren't done."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def mark_done(units: DataFrame, table: str) -> None:
    """Q6: append the units to the table of those done."""
    units.withColumn("completed_at", F.current_timestamp()).write.mode("append").saveAsTable(table)


def completed(spark: SparkSession, table: str, schema: str) -> DataFrame:
    return spark.table(table) if spark.catalog.tableExists(table) else spark.createDataFrame([], schema)


def append_attempt(df: DataFrame, table: str, generation: str, unit: str = "partition_id") -> None:
    """Append rows to a table partitioned by their unit, under the generation of the attempt that made them."""
    rows, spark = df.withColumn("generation", F.lit(generation)), df.sparkSession
    if spark.catalog.tableExists(table):
        rows.select(*spark.table(table).columns).write.insertInto(table)
    else:
        rows.write.partitionBy(unit).saveAsTable(table)


def show_committed(spark: SparkSession, name: str, attempts: str, done: str, unit: str = "partition_id") -> None:
    """A view of the rows of each unit's newest generation that was marked done; other attempts don't show."""
    columns = ", ".join(f"a.`{c}`" for c in spark.table(attempts).columns if c != "generation")
    spark.sql(f"""CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM {attempts} a LEFT SEMI JOIN
      (SELECT {unit}, max(generation) AS generation FROM {done} GROUP BY {unit}) d ON a.{unit} = d.{unit} AND a.generation = d.generation""")


def attempt_load(work: DataFrame, read: Callable[[DataFrame], DataFrame], reasons: Mapping[str, str], original: Sequence[str], target: str, letters: str, done: str, again: bool = False) -> DataFrame:
    """Q7, all but the mark: what isn't done is read once, split and written as a new generation. The units, with it."""
    spark = work.sparkSession
    generation = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    todo = checkpoint(work if again else pending(work, completed(spark, done, "partition_id string")))
    good, bad = dead_letters(checkpoint(read(todo)), reasons, original)
    append_attempt(good, f"{target}_attempts", generation)
    append_attempt(bad, f"{letters}_attempts", generation)
    return todo.withColumn("generation", F.lit(generation))


def fault_tolerant_load(work: DataFrame, read: Callable[[DataFrame], DataFrame], reasons: Mapping[str, str], original: Sequence[str], target: str, letters: str, done: str, again: bool = False) -> None:
    """Q7: skip what is done, read the rest once, split off dead letters, write both, then mark the units done.

    What ``read`` gives has the units' ``partition_id``. Each attempt writes under a generation of its own, and ``done``
    says which generation of a unit holds: ``target`` and ``letters`` are views of those rows. So whatever a run
    left that broke anywhere before the mark never shows, whether or not the rows changed until it is repeated; a
    unit whose rows all went the other way since shows them there only. ``again`` loads units that are done too: their
    new generation takes the place of the old one as a whole once it is marked. The mark is written by one task.
    """
    spark = work.sparkSession
    mark_done(attempt_load(work, read, reasons, original, target, letters, done, again).coalesce(1), done)
    for name in (target, letters):
        show_committed(spark, name, f"{name}_attempts", done)


def profile_table(df: DataFrame, ts: str, key: str, value: str) -> DataFrame:
    """Q8: rows, time range, distinct keys, mean."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("min_time"), F.max(ts).alias("max_time"), F.countDistinct(key).alias("n_keys"), F.avg(value).alias("avg_value"))


def table_present(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
