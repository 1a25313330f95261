"""Queries over cleaned intervals: rules, rollups, joins, reports, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import clean, joins, layout, metrics, models, quality, ranking, rollups, sinks, storage
from tidemark.operators.percentiles import exact_percentiles
from tidemark.plans.frames import market, query, table
from tidemark.sources import reports

TS, REGION, DEMAND, GENERATION, PRICE, INTERCHANGE = "settlement_date", "region_id", "total_demand_mw", "available_generation_mw", "rrp", "net_interchange_mw"
HOUR = "CAST(date_trunc('hour', settlement_date) AS TIMESTAMP)"
DAY = "CAST(date_trunc('day', settlement_date) AS TIMESTAMP)"
AS_OF = "2024-01-31 00:00:00"
EVENT_RULES = {"known_type": "region_id IN ('click', 'view', 'purchase')", "demand_range": "total_demand_mw > 5200 AND total_demand_mw < 8800", "time": "settlement_date IS NOT NULL", "price": "rrp >= 1"}
EVENT_RULES_SQL = " AND ".join(f"({r})" for r in EVENT_RULES.values())


# -- projection, rules, dead letters ----------------------------------------------------------------------
@query("""{m} SELECT settlement_date, region_id, total_demand_mw, available_generation_mw, total_demand_mw / available_generation_mw AS ratio,
  hour(settlement_date) BETWEEN 17 AND 20 AS is_peak, CASE WHEN hour(settlement_date) BETWEEN 17 AND 20 THEN 'Peak' ELSE 'Off-Peak' END AS period FROM m""", rounded=["ratio"])  # fmt: skip
def silver_clean(spark, d):
    """Values that come as text, some of them quoted."""
    text = market(spark, d).select(F.col(TS).alias("SETTLEMENTDATE"), F.col(REGION).alias("REGIONID"), F.concat(F.lit('"'), F.col(DEMAND).cast("string"), F.lit('"')).alias("TOTALDEMAND"), F.col(GENERATION).cast("string").alias("AVAILABLEGENERATION"))
    out = clean.project(text, {k: v for k, v in clean.REGION_SUM.items() if k in text.columns})
    return out.withColumns({"ratio": C.ratio(DEMAND, GENERATION), "is_peak": C.peak_flag(TS), "period": C.peak_label(TS)})


@query(f"{{m}} SELECT event_id, region_id, total_demand_mw, rrp FROM m WHERE {EVENT_RULES_SQL}")
def quality_drop(spark, d):
    return quality.expect_or_drop(market(spark, d), EVENT_RULES).select("event_id", REGION, DEMAND, PRICE)


@query("{m} SELECT count(*) AS total_records, count(CASE WHEN air_temp_c IS NULL THEN 1 END) AS null_temperature, count(CASE WHEN net_interchange_mw < 0 THEN 1 END) AS negative_interchange, count(CASE WHEN rrp > 100 THEN 1 END) AS high_price FROM m")
def quality_counts(spark, d):
    return quality.quality_counts(market(spark, d), {"null_temperature": "air_temp_c IS NULL", "negative_interchange": "net_interchange_mw < 0", "high_price": "rrp > 100"})


@query(
    "{m} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(CASE WHEN {r} THEN 1 END) AS passed, count(*) - count(CASE WHEN {r} THEN 1 END) AS failed, count(*) - count(CASE WHEN {EVENT_RULES_SQL} THEN 1 END) AS dropped_rows FROM m"
        for n, r in EVENT_RULES.items()
    )
)
def rule_report(spark, d):
    return quality.rule_report(market(spark, d), EVENT_RULES)


def _letters(spark, d):
    text = market(spark, d).select("event_id", F.when(F.col("event_id") % 11 != 0, F.col(REGION)).alias("REGIONID"), F.when(F.col("event_id") % 13 == 0, "abc").when(F.col("event_id") % 17 == 0, "-500").when(F.col("event_id") % 19 != 0, F.col(DEMAND).cast("string")).alias("TOTALDEMAND"))
    return quality.dead_letters(text, quality.demand_reasons(regions=("click", "view", "purchase", "signup")), ["REGIONID", "TOTALDEMAND"])


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS REGIONID,
    CASE WHEN event_id % 13 = 0 THEN 'abc' WHEN event_id % 17 = 0 THEN '-500' WHEN event_id % 19 <> 0 THEN '6000' END AS TOTALDEMAND FROM events),
  r AS (SELECT *, CASE WHEN REGIONID IS NULL THEN 'NULL_REGION' WHEN REGIONID NOT IN ('click', 'view', 'purchase', 'signup') THEN 'INVALID_REGION'
    WHEN try_cast(TOTALDEMAND AS DOUBLE) IS NULL OR try_cast(TOTALDEMAND AS DOUBLE) <= 0 THEN 'INVALID_DEMAND' END AS reason FROM t)
  SELECT event_id, coalesce(reason, 'GOOD') AS outcome FROM r""")  # fmt: skip
def dlq_split(spark, d):
    """Q5: every row is on one side."""
    good, bad = _letters(spark, d)
    return good.select("event_id", F.lit("GOOD").alias("outcome")).unionByName(bad.select("event_id", F.col("_error_reason").alias("outcome")))


@query("""WITH w AS (SELECT DISTINCT CAST(ts AS DATE) AS day, event_type AS region FROM events),
  k AS (SELECT substr(md5(concat_ws(':', region, CAST(day AS VARCHAR))), 1, 12) AS partition_id, region, day FROM w)
  SELECT partition_id, region, day FROM k WHERE NOT (day < DATE '2024-01-08' AND region <> 'view')""")  # fmt: skip
def pending_partitions(spark, d):
    """Q6: days and types less those done."""
    work = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("region")).distinct().select(quality.partition_id("region", "day").alias("partition_id"), "region", "day")
    return quality.pending(work, work.where("day < DATE'2024-01-08' AND region <> 'view'"))


@query(f"""{{m,}} days AS (SELECT DISTINCT CAST(settlement_date AS DATE) AS day FROM m), regions AS (SELECT DISTINCT region_id FROM m)
  SELECT substr(md5(concat_ws(':', 'DISPATCHPRICE', region_id, CAST(day AS VARCHAR))), 1, 12) AS partition_id, 'DISPATCHPRICE' AS "table", region_id AS region, day FROM days, regions""")
def work_list(spark, d):
    """The days and regions that the data have."""
    found = market(spark, d).agg(F.collect_set(F.to_date(TS)).alias("days"), F.collect_set(REGION).alias("regions"))
    units = found.select(F.lit("DISPATCHPRICE").alias("table"), F.explode("days").alias("day"), "regions").select("table", "day", F.explode("regions").alias("region"))
    return units.select(quality.partition_id("table", "region", "day").alias("partition_id"), "table", "region", "day")


# -- rollups ------------------------------------------------------------------------------------------------
@query(f"{{m}} SELECT {HOUR} AS hour, region_id, avg(total_demand_mw) AS avg_demand, max(total_demand_mw) AS max_demand, min(total_demand_mw) AS min_demand, count(*) AS interval_count, avg(total_demand_mw / available_generation_mw) AS avg_ratio FROM m GROUP BY 1, 2", rounded=["avg_demand", "avg_ratio"])
def hourly_rollup(spark, d):
    """The flagship: cleaned, held to the rules, rolled up by hour and region."""
    m = market(spark, d).withColumn("ratio", C.ratio(DEMAND, GENERATION))
    kept = quality.expect_or_drop(clean.require_time(m, TS), {"valid_demand": "total_demand_mw > 0 AND total_demand_mw < 20000", "valid_region": "region_id IS NOT NULL"})
    return rollups.demand_rollup(kept, TS, REGION, DEMAND, "ratio")


@query("{m} SELECT CAST(settlement_date AS DATE) AS day, region_id, avg(total_demand_mw) AS avg_demand, max(total_demand_mw) AS peak_demand, min(total_demand_mw) AS min_demand, avg(net_interchange_mw) AS avg_interchange, count(*) AS interval_count, avg(net_interchange_mw) < 0 AS is_net_exporter FROM m GROUP BY 1, 2", rounded=["avg_demand", "avg_interchange"])
def daily_rollup(spark, d):
    return rollups.daily_rollup(market(spark, d), TS, REGION, DEMAND, INTERCHANGE)


@query(f"{{m}} SELECT {HOUR} AS hour, sum(total_demand_mw) AS total_demand, sum(available_generation_mw) AS total_generation, count(*) AS interval_count FROM m GROUP BY 1")
def market_totals(spark, d):
    return rollups.market_totals(market(spark, d), TS, DEMAND, GENERATION)


@query(f"{{m}} SELECT {HOUR} AS hour, region_id, avg(total_demand_mw) AS avg_demand_mw, max(total_demand_mw) AS peak_demand_mw, min(total_demand_mw) AS min_demand_mw, avg(rrp) AS avg_price, max(rrp) AS max_price, min(rrp) AS min_price, avg(available_generation_mw) AS avg_generation_mw, avg(net_interchange_mw) AS avg_interchange_mw, count(*) AS interval_count FROM m GROUP BY 1, 2", rounded=["avg_demand_mw", "avg_price", "avg_generation_mw", "avg_interchange_mw"])
def demand_price_hourly(spark, d):
    return rollups.demand_price_hourly(market(spark, d), TS, REGION, DEMAND, PRICE, GENERATION, INTERCHANGE)


def _price_sql(unit, name):
    return f"{{m}} SELECT CAST(date_trunc('{unit}', settlement_date) AS TIMESTAMP) AS {name}, region_id, avg(rrp) AS avg_rrp, min(rrp) AS min_rrp, max(rrp) AS max_rrp, stddev(rrp) AS std_rrp, avg(total_demand_mw) AS avg_demand_mw, max(total_demand_mw) AS peak_demand_mw, count(*) AS interval_count FROM m GROUP BY 1, 2"


@query(_price_sql("hour", "hour"), rounded=["avg_rrp", "std_rrp", "avg_demand_mw"])
def hourly_price_stats(spark, d):
    return rollups.price_stats(market(spark, d), TS, REGION, PRICE, DEMAND)


@query(_price_sql("day", "day"), rounded=["avg_rrp", "std_rrp", "avg_demand_mw"])
def daily_price_summary(spark, d):
    return rollups.price_stats(market(spark, d), TS, REGION, PRICE, DEMAND, "day")


@query(f"{{m}} SELECT {HOUR} AS hour, user_id, avg(rrp) AS avg_mw, max(rrp) AS max_mw, sum(rrp) AS total_mw, sum(rrp) / 12 AS energy_mwh FROM m GROUP BY 1, 2", rounded=["avg_mw", "total_mw", "energy_mwh"])
def unit_hourly(spark, d):
    return rollups.unit_hourly(market(spark, d), TS, "user_id", PRICE)


@query(f"{{m}} SELECT {HOUR} AS hour, sum(CASE WHEN net_interchange_mw > 0 THEN net_interchange_mw ELSE 0 END) AS total_generation_mw, count(CASE WHEN net_interchange_mw > 0 THEN 1 END) AS active_unit_count, count(CASE WHEN net_interchange_mw <= 0 OR net_interchange_mw IS NULL THEN 1 END) AS offline_unit_count, max(net_interchange_mw) AS largest_unit_mw, count(*) AS total_duid_count FROM m GROUP BY 1")
def supply_stack(spark, d):
    return rollups.supply_stack(market(spark, d), {"hour": rollups.period(TS)}, INTERCHANGE)


@query("""SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS day, l_returnflag, avg(l_quantity) AS avg_flow_mw, max(l_quantity) AS max_flow_mw, min(l_quantity) AS min_flow_mw,
  avg(l_tax) AS avg_losses_mw, avg(l_discount * 100) AS avg_import_limit, avg(l_extendedprice) AS avg_export_limit,
  avg(abs(l_quantity) / greatest(abs(l_discount * 100), abs(l_extendedprice), 1.0) * 100) AS avg_utilisation_pct, count(*) AS interval_count FROM lineitem GROUP BY 1, 2""", rounded=["avg_flow_mw", "avg_losses_mw", "avg_import_limit", "avg_export_limit", "avg_utilisation_pct"])  # fmt: skip
def utilisation_hourly(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"imports": F.col("l_discount") * 100, "exports": F.col("l_extendedprice")})
    return rollups.utilisation(rows, {"day": rollups.period("l_shipdate", "day"), "l_returnflag": F.col("l_returnflag")}, "l_quantity", "l_tax", "imports", "exports")




@query("{m} SELECT region_id, avg(rrp) AS avg_price, max(rrp) AS max_price, min(rrp) AS min_price, avg(total_demand_mw) AS avg_demand, count(*) AS n FROM m WHERE settlement_date >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS GROUP BY 1 ORDER BY avg_price DESC", rounded=["avg_price", "avg_demand"])
def regional_summary(spark, d):
    rows = clean.recent(market(spark, d), TS, AS_OF, "7 DAYS")
    return rollups.summary(rows, {REGION: F.col(REGION)}, PRICE, DEMAND, None).orderBy(F.desc("avg_price"))


def _summary_sql(keys, where="TRUE"):
    return f"{{m}} SELECT {keys}, avg(rrp) AS avg_price, max(rrp) AS max_price, min(rrp) AS min_price, avg(total_demand_mw) AS avg_demand, count(*) AS n FROM m WHERE {where} GROUP BY ALL"


@query(_summary_sql("CAST(settlement_date AS DATE) AS day, region_id"), rounded=["avg_price", "avg_demand"])
def daily_trend(spark, d):
    return rollups.summary(market(spark, d), {"day": F.to_date(TS), REGION: F.col(REGION)}, PRICE, DEMAND, None)


@query(_summary_sql("hour(settlement_date) BETWEEN 17 AND 20 AS is_peak, region_id"), rounded=["avg_price", "avg_demand"])
def peak_offpeak(spark, d):
    return rollups.summary(market(spark, d), {"is_peak": C.peak_flag(TS), REGION: F.col(REGION)}, PRICE, DEMAND, None)


@query(_summary_sql("hour(settlement_date) AS hour_of_day"), rounded=["avg_price", "avg_demand"], ints=["hour_of_day"])
def hour_pattern(spark, d):
    return rollups.summary(market(spark, d), {"hour_of_day": F.hour(TS)}, PRICE, DEMAND, None)


@query(_summary_sql("CAST(settlement_date AS DATE) AS day, region_id", "region_id IN ('click', 'view')"), rounded=["avg_price", "avg_demand"])
def two_region_daily(spark, d):
    return rollups.summary(clean.only_regions(market(spark, d), ("click", "view"), REGION), {"day": F.to_date(TS), REGION: F.col(REGION)}, PRICE, DEMAND, None)


@query("{m} SELECT region_id, count(*) AS spike_count, avg(rrp) AS avg_spike, max(rrp) AS max_spike FROM m WHERE rrp > 150 GROUP BY 1", rounded=["avg_spike"])
def spike_analysis(spark, d):
    return rollups.spikes(market(spark, d), REGION, PRICE, 150, None)


@query("{m} SELECT region_id, stddev(rrp) AS volatility, max(rrp) - min(rrp) AS price_range, avg(rrp) AS avg_price FROM m GROUP BY 1", rounded=["volatility", "price_range", "avg_price"])
def volatility_rank(spark, d):
    return rollups.volatility(market(spark, d), REGION, PRICE, None).orderBy(F.desc("volatility"))


@query("{m} SELECT avg(rrp) AS avg_price, max(rrp) AS max_price, avg(total_demand_mw) AS avg_demand, count(CASE WHEN rrp > 150 THEN 1 END) AS spike_count FROM m", rounded=["avg_price", "avg_demand"])
def kpis(spark, d):
    return rollups.kpis(market(spark, d), PRICE, DEMAND, 150, None)


@query("{m} SELECT region_id, quantile_cont(rrp, 0.5) AS p50, quantile_cont(rrp, 0.95) AS p95, quantile_cont(rrp, 0.99) AS p99 FROM m GROUP BY 1", rounded=["p50", "p95", "p99"])
def percentiles(spark, d):
    return exact_percentiles(market(spark, d), REGION, PRICE, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"{{m}} SELECT {HOUR} AS hour, region_id, quantile_cont(rrp, 0.95) AS p95 FROM m GROUP BY 1, 2", rounded=["p95"])
def hourly_p95(spark, d):
    return rollups.percentiles(market(spark, d), {"hour": rollups.period(TS), REGION: F.col(REGION)}, PRICE, {"p95": 0.95})


@query()
def approx_p95(spark, d):
    """Approximate, so there is no SQL to compare; a test holds it near the exact value."""
    return rollups.percentiles(market(spark, d), {REGION: F.col(REGION)}, PRICE, {"p95": 0.95}, exact=False)


@query("{m} SELECT event_id, region_id, rrp, p95 FROM m JOIN (SELECT region_id, quantile_cont(rrp, 0.95) AS p95 FROM m GROUP BY 1) USING (region_id) WHERE rrp > p95", rounded=["p95"])
def spikes_over_p95(spark, d):
    return joins.above_group_percentile(market(spark, d).select("event_id", REGION, PRICE), REGION, PRICE)


@query("{m} SELECT region_id, hour(settlement_date) BETWEEN 17 AND 20 AS is_peak, count(*) AS spike_count, avg(rrp) AS avg_spike, max(rrp) AS max_spike FROM m JOIN (SELECT region_id, quantile_cont(rrp, 0.95) AS p95 FROM m GROUP BY 1) USING (region_id) WHERE rrp > p95 GROUP BY 1, 2", rounded=["avg_spike"])
def spike_summary(spark, d):
    return rollups.spike_summary(market(spark, d), REGION, PRICE, C.peak_flag(TS))


@query("""{m} SELECT 'rrp' AS "column", count(rrp) AS n, avg(rrp) AS mean, stddev(rrp) AS std, min(rrp) AS least, max(rrp) AS most FROM m
  UNION ALL SELECT 'air_temp_c', count(air_temp_c), avg(air_temp_c), stddev(air_temp_c), min(air_temp_c), max(air_temp_c) FROM m""", rounded=["mean", "std"])  # fmt: skip
def profile(spark, d):
    return rollups.column_profile(market(spark, d), PRICE, "air_temp_c")


@query("{m} SELECT count(DISTINCT region_id) AS n_region_id, count(DISTINCT user_id) AS n_user_id FROM m")
def distinct_counts(spark, d):
    return rollups.distinct_counts(market(spark, d), REGION, "user_id")


@query("{m} SELECT CAST(settlement_date AS DATE) AS day, region_id, sum(total_demand_mw) / 12 AS total_mwh, count(*) AS n FROM m GROUP BY 1, 2", rounded=["total_mwh"])
def energy(spark, d):
    return rollups.energy(market(spark, d), {"day": F.to_date(TS), REGION: F.col(REGION)}, DEMAND)


@query("{m} SELECT count(*) AS row_count, min(CAST(settlement_date AS DATE)) AS min_date, max(CAST(settlement_date AS DATE)) AS max_date, avg(rrp) AS avg_price, avg(total_demand_mw) AS avg_demand FROM m", rounded=["avg_price", "avg_demand"])
def verification(spark, d):
    return rollups.verification(market(spark, d), TS, PRICE, DEMAND, None)


@query("SELECT greatest((SELECT max(ts) FROM events), (SELECT max(o_orderdate) FROM orders)) AS newest, CAST(2 AS BIGINT) AS n_tables")
def freshness(spark, d):
    return rollups.freshness((table(spark, d, "events"), "ts"), (table(spark, d, "orders"), "o_orderdate"))


@query(f"{{m}} SELECT count(DISTINCT {HOUR}) AS hours, avg(rrp) AS mean_rrp, avg(total_demand_mw) AS mean_total_demand_mw FROM m", rounded=["mean_rrp", "mean_total_demand_mw"])
def hour_coverage(spark, d):
    return rollups.coverage(market(spark, d).withColumn("hour", rollups.period(TS)), "hour", PRICE, DEMAND)


@query("""{m,} e AS (SELECT demand_forecast_mw - total_demand_mw + rrp / 10 AS e FROM m)
  SELECT CASE WHEN e < -50 THEN 0 WHEN e >= 50 THEN 51 ELSE floor((e + 50) / 2) + 1 END AS bin, count(*) AS n FROM e GROUP BY 1""", ints=["bin"])  # fmt: skip
def error_histogram(spark, d):
    e = market(spark, d).select((F.col("demand_forecast_mw") - F.col(DEMAND) + F.col(PRICE) / 10).alias("e"))
    return rollups.histogram(e, "e", -50, 50, 50)


@query("""{m,} q AS (SELECT region_id, quantile_cont(rrp, 0.25) AS q1, quantile_cont(rrp, 0.5) AS median, quantile_cont(rrp, 0.75) AS q3, min(rrp) AS least, max(rrp) AS most FROM m GROUP BY 1)
  SELECT region_id, q1, median, q3, q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence, least, most FROM q""", rounded=["q1", "median", "q3", "low_fence", "high_fence"])  # fmt: skip
def box_stats(spark, d):
    return rollups.box_stats(market(spark, d), REGION, PRICE)


@query("SELECT coalesce(n_name, 'Unknown') AS n_name, sum(coalesce(s_acctbal, 0)) AS capacity, count(*) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey + 5 GROUP BY 1", rounded=["capacity"])
def capacity_by_dim(spark, d):
    """G26. The keys of the nations are shifted, so some suppliers have none."""
    nation = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey") + 5)
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return rollups.capacity(joins.with_static(s, nation, "n_nationkey"), "n_name", "s_acctbal")


_FUELS = ["coal_black", "gas_ccgt", "hydro", "wind", "solar_rooftop", "pumps", "fusion", ""]
_FUEL_CASE = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(["coal", "gas", "hydro", "wind", "solar", "other", "other", "unknown"]))


@query(f"SELECT p_partkey, CASE p_partkey % 9 {_FUEL_CASE} ELSE 'unknown' END AS fuel_category FROM part")
def fuel_map(spark, d):
    tech = F.element_at(F.array(*map(F.lit, [*_FUELS, None])), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", C.fuel_category(tech).alias("fuel_category"))


@query("{m} SELECT CASE WHEN rrp > 100 THEN 1 ELSE 0 END AS label, count(*) AS n FROM m GROUP BY 1", ints=["label"])
def label_balance(spark, d):
    return rollups.class_counts(market(spark, d), clean.label_above(PRICE, 100))


@query("{m} SELECT region_id, avg(rrp) AS avg_rrp, max(rrp) AS max_rrp, min(rrp) AS min_rrp, avg(total_demand_mw) AS avg_total_demand_mw FROM m GROUP BY 1", rounded=["avg_rrp", "avg_total_demand_mw"])
def multi_agg(spark, d):
    return rollups.multi_aggregate(market(spark, d), [REGION], [("avg", PRICE), ("max", PRICE), ("min", PRICE), ("avg", DEMAND)])


@query(f"{{m}} SELECT {HOUR} AS hour, region_id, count(*) AS n, max(rrp) AS top_price FROM m GROUP BY ALL")
def group_by_all(spark, d):
    """G27."""
    return spark.sql("SELECT CAST(date_trunc('HOUR', settlement_date) AS TIMESTAMP_NTZ) AS hour, region_id, count(*) AS n, max(rrp) AS top_price FROM {m} GROUP BY ALL", m=market(spark, d))


@query("{m} SELECT count(*) AS row_count, min(settlement_date) AS min_time, max(settlement_date) AS max_time, count(DISTINCT region_id) AS n_keys, avg(rrp) AS avg_value FROM m", rounded=["avg_value"])
def table_profile(spark, d):
    return quality.profile_table(market(spark, d), TS, REGION, PRICE)


# -- joins --------------------------------------------------------------------------------------------------
@query("""{m} SELECT a.settlement_date, a.region_id, a.rrp, b.total_demand_mw, CAST(a.settlement_date AS DATE) AS date, hour(a.settlement_date) BETWEEN 17 AND 20 AS is_peak
  FROM m a JOIN m b ON a.settlement_date = b.settlement_date AND a.region_id = b.region_id WHERE a.region_id IN ('click', 'view', 'error')""")  # fmt: skip
def curated_join(spark, d):
    """Price and demand from two tables, kept where both have the interval."""
    m = market(spark, d)
    prices, demand = m.select(TS, REGION, PRICE), m.select(TS, REGION, DEMAND)
    joined = joins.curated(prices, demand, [TS, REGION], ("click", "view", "error"), REGION, [PRICE, DEMAND])
    return joined.withColumns({"date": F.to_date(TS), "is_peak": C.peak_flag(TS)})


def _weather(spark, d):
    """All events as observations 90 minutes later, so that some hours have none."""
    return market(spark, d).select("event_id", (F.col(TS) + F.expr("INTERVAL 90 MINUTES")).alias(TS), REGION, "air_temp_c", (F.col(PRICE) / 10).alias("wind_speed_kmh"))


_WEATHER_SQL = "w AS (SELECT event_id, settlement_date + INTERVAL 90 MINUTES AS settlement_date, region_id, air_temp_c, rrp / 10 AS wind_speed_kmh FROM m)"


@query(f"""{{m,}} {_WEATHER_SQL}, h AS (SELECT {HOUR} AS hour, region_id, avg(total_demand_mw) AS avg_demand, count(*) AS n FROM m GROUP BY 1, 2),
  l AS (SELECT {HOUR} AS hour, region_id, arg_max(wind_speed_kmh, settlement_date) AS wind_speed_kmh FROM w GROUP BY 1, 2)
  SELECT hour, region_id, avg_demand, n, wind_speed_kmh FROM h LEFT JOIN l USING (hour, region_id)""", rounded=["avg_demand", "wind_speed_kmh"])  # fmt: skip
def demand_weather_left(spark, d):
    """J4."""
    m = market(spark, d)
    hourly = rollups.rollup_by(m, {"hour": rollups.period(TS), REGION: F.col(REGION)}, {"avg_demand": F.avg(DEMAND), "n": F.count(F.lit(1))})
    return joins.left_keyed(hourly, rollups.last_in_hour(_weather(spark, d), TS, REGION, ["wind_speed_kmh"], "event_id"), ["hour", REGION])


@query(f"{{m,}} {_WEATHER_SQL} SELECT {HOUR} AS hour, region_id, arg_max(wind_speed_kmh, settlement_date) AS wind_speed_kmh FROM w GROUP BY 1, 2", rounded=["wind_speed_kmh"])
def weather_last_in_hour(spark, d):
    """G11."""
    return rollups.last_in_hour(_weather(spark, d), TS, REGION, ["wind_speed_kmh"], "event_id")


def _forecasts(spark, d):
    """Three runs before each interval, the newer the closer to it; some flagged as interventions."""
    m = market(spark, d)
    run = F.explode(F.array(*[F.struct(F.lit(x).alias("ahead"), F.lit(o).alias("off")) for x, o in ((15, 30.0), (10, 20.0), (5, 10.0))])).alias("r")
    runs = m.select("event_id", TS, REGION, DEMAND, PRICE, "user_id", run)
    return runs.select("event_id", F.col(TS), F.col(REGION), (F.col(TS) - F.make_dt_interval(mins=F.col("r.ahead"))).alias("run_time"), (F.col(DEMAND) + F.col("r.off")).alias("f_demand"), (F.col(PRICE) + F.col("r.off") / 10).alias("f_price"), F.when((F.col("user_id") % 2 == 1) & (F.col("r.ahead") == 5), "1").otherwise("0").alias("INTERVENTION"))


def _scored(spark, d):
    pairs = {"demand_error_mw": ("f_demand", DEMAND, "demand_mw", 1), "price_error": ("f_price", PRICE, "rrp", 2)}
    scored = joins.forecast_vs_actual(_forecasts(spark, d), market(spark, d), "run_time", TS, REGION, pairs, also=["event_id"])
    return scored.drop("event_id")  # events may share time and type


_SCORED_SQL = """f AS (SELECT settlement_date, region_id, total_demand_mw, rrp, CASE WHEN user_id % 2 = 1 THEN 10 ELSE 5 END AS ahead, CASE WHEN user_id % 2 = 1 THEN 20.0 ELSE 10.0 END AS off FROM m),
  s AS (SELECT settlement_date, region_id, settlement_date - to_minutes(ahead) AS forecast_run_time, CAST(ahead AS DOUBLE) AS lead_time_minutes, total_demand_mw + off AS forecast_demand_mw, total_demand_mw AS actual_demand_mw, rrp + off / 10 AS forecast_rrp, rrp AS actual_rrp,
    round(total_demand_mw + off - total_demand_mw, 1) AS demand_error_mw, round(rrp + off / 10 - rrp, 2) AS price_error FROM f)"""


@query(f"{{m,}} {_SCORED_SQL} SELECT * FROM s", rounded=["forecast_rrp"])
def forecast_vs_actual(spark, d):
    """The newest run that is no intervention."""
    return _scored(spark, d)


@query(f"""{{m,}} {_SCORED_SQL} SELECT {HOUR} AS hour, region_id, avg(abs(demand_error_mw)) AS demand_mae_mw, avg(demand_error_mw) AS demand_bias_mw, avg(abs(demand_error_mw) / nullif(actual_demand_mw, 0) * 100) AS demand_mape_pct,
  avg(abs(price_error)) AS price_mae, avg(price_error) AS price_bias, avg(lead_time_minutes) AS avg_lead_minutes, count(*) AS interval_count FROM s GROUP BY 1, 2""", rounded=["demand_mae_mw", "demand_bias_mw", "demand_mape_pct", "price_mae", "price_bias", "avg_lead_minutes"])  # fmt: skip
def forecast_accuracy(spark, d):
    return rollups.forecast_accuracy(_scored(spark, d), TS, REGION)


@query("SELECT l_orderkey, l_linenumber, l_suppkey, s_name, n_name FROM lineitem LEFT JOIN (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON l_suppkey = s_suppkey + 1", ints=["l_linenumber"])
def dim_enrich(spark, d):
    """J7. The keys of the suppliers are shifted, so some lines have none."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    dim = s.select((F.col("s_suppkey") + 1).alias("l_suppkey"), "s_name", "n_name")
    return joins.with_static(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), dim, "l_suppkey")


@query("{m} SELECT region_id, arg_max(settlement_date, settlement_date) AS settlement_date, arg_max(rrp, settlement_date) AS rrp, arg_max(total_demand_mw, settlement_date) AS total_demand_mw FROM m GROUP BY 1")
def latest_per_region(spark, d):
    """W2-W4."""
    return joins.latest_by(market(spark, d), [REGION], TS, [PRICE, DEMAND], "event_id")


@query(f"""{{m,}} a AS (SELECT {HOUR} AS hour, region_id, max(total_demand_mw) + 25 AS p FROM m GROUP BY 1, 2), b AS (SELECT hour + INTERVAL 3 HOURS AS hour, region_id, p + 15 AS p FROM a)
  SELECT hour, region_id, coalesce(a.p, b.p) AS prediction, CASE WHEN a.p IS NOT NULL THEN 'MODEL' ELSE 'FALLBACK' END AS source FROM a FULL JOIN b USING (hour, region_id)""")  # fmt: skip
def best_available_forecast(spark, d):
    """The model's hours, and published ones of three hours before."""
    model = rollups.rollup_by(market(spark, d), {"hour": rollups.period(TS), REGION: F.col(REGION)}, {"prediction": F.max(DEMAND) + 25})
    published = model.select((F.col("hour") + F.expr("INTERVAL 3 HOURS")).alias("hour"), REGION, (F.col("prediction") + 15).alias("prediction"))
    return joins.best_available(model, published, ["hour", REGION], "prediction")


@query("""{m,} p AS (SELECT region_id, total_demand_mw + 10 * (user_id % 9 - 4) AS predicted, total_demand_mw AS actual FROM m)
  SELECT region_id, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(predicted - actual) / greatest(abs(actual), 0.01) * 100) AS mape, avg(predicted - actual) AS bias, count(*) AS n FROM p GROUP BY 1""", rounded=["mae", "rmse", "mape", "bias"])  # fmt: skip
def error_metrics(spark, d):
    """J10, G24."""
    m = market(spark, d)
    predictions = m.select("event_id", REGION, (F.col(DEMAND) + 10 * (F.col("user_id") % 9 - 4)).alias("predicted"))
    actuals = m.select("event_id", REGION, F.col(DEMAND).alias("actual"))
    return rollups.error_metrics(joins.with_errors(predictions, actuals, ["event_id", REGION], "predicted", "actual"), "predicted", "actual", [REGION])


@query(f"{{m}} SELECT {DAY} AS day, avg(demand_forecast_mw) AS avg_value, stddev(demand_forecast_mw) AS std_value, count(*) AS n FROM m GROUP BY 1", rounded=["avg_value", "std_value"])
def drift_daily(spark, d):
    """G25."""
    return rollups.drift(market(spark, d), TS, "demand_forecast_mw")


@query(f"""{{m,}} {_SCORED_SQL}, p AS (SELECT *, forecast_demand_mw - CASE WHEN actual_demand_mw > 7000 THEN 15 ELSE 5 END AS model FROM s)
  SELECT avg(abs(model - actual_demand_mw)) AS model_mae, avg(abs(forecast_demand_mw - actual_demand_mw)) AS published_mae,
  (avg(abs(forecast_demand_mw - actual_demand_mw)) - avg(abs(model - actual_demand_mw))) / avg(abs(forecast_demand_mw - actual_demand_mw)) * 100 AS improvement_pct,
  count(CASE WHEN abs(model - actual_demand_mw) < abs(forecast_demand_mw - actual_demand_mw) THEN 1 END) AS n_better, count(*) AS n FROM p""", rounded=["model_mae", "published_mae", "improvement_pct"])  # fmt: skip
def model_vs_published(spark, d):
    """L11."""
    s = _scored(spark, d).withColumn("model", F.col("forecast_demand_mw") - F.when(F.col("actual_demand_mw") > 7000, 15).otherwise(5))
    return models.against_published(s, "model", "forecast_demand_mw", "actual_demand_mw")


# -- metric layer and functions -----------------------------------------------------------------------------
@query("""{m} SELECT region_id, hour(settlement_date) AS hour_of_day, strftime(settlement_date, '%A') AS day_of_week, avg(rrp) AS avg_price, stddev(rrp) AS price_volatility, max(rrp) AS peak_price, sum(total_demand_mw) / 12 AS total_demand_mwh, count(*) AS interval_count, max(rrp) - min(rrp) AS price_range
  FROM m WHERE hour(settlement_date) BETWEEN 17 AND 20 GROUP BY 1, 2, 3""", rounded=["avg_price", "price_volatility", "total_demand_mwh", "price_range"], ints=["hour_of_day"])  # fmt: skip
def metric_price(spark, d):
    """M1, M2."""
    source = market(spark, d).select(F.col(TS).alias("interval_start"), REGION, PRICE, F.col(DEMAND).alias("demand_mw"))
    return metrics.PRICE.query(source, ["region_id", "hour_of_day", "day_of_week"], ["avg_price", "price_volatility", "peak_price", "total_demand_mwh", "interval_count", "price_range"], "is_peak")


_REGIME = "CASE WHEN total_demand_mw >= 9000 THEN 'extreme_peak' WHEN total_demand_mw >= 7500 THEN 'peak' WHEN air_temp_c >= 35 THEN 'weather_driven_risk' WHEN total_demand_mw <= 4500 THEN 'off_peak' ELSE 'normal' END"
_BAND = "CASE WHEN rrp >= 1000 THEN 'critical_spike' WHEN rrp >= 300 THEN 'high_spike' WHEN rrp <= -100 THEN 'negative_price_event' ELSE 'normal' END"
_STRESS = "greatest(0, least(100, CASE WHEN available_generation_mw - total_demand_mw <= 2000 THEN 50 ELSE 10 END + CASE WHEN abs(net_interchange_mw) >= 1000 THEN 20 ELSE 5 END + CASE WHEN rrp >= 300 THEN 30 WHEN rrp >= 150 THEN 15 ELSE 0 END))"


@query(f"{{m}} SELECT {HOUR} AS event_hour, region_id, {_REGIME} AS demand_regime, count(*) AS interval_count, avg(total_demand_mw) AS avg_demand_mw, max(total_demand_mw) AS peak_demand_mw, avg(air_temp_c) AS avg_temp_c FROM m GROUP BY 1, 2, 3", rounded=["avg_demand_mw", "avg_temp_c"])
def metric_demand_ops(spark, d):
    C.register_sql_functions(spark)
    view = metrics.DEMAND_OPERATIONS
    return view.query(market(spark, d), list(view.dimensions), list(view.measures))


@query(f"{{m}} SELECT {HOUR} AS event_hour, region_id, {_BAND} AS price_spike_band, count(*) AS interval_count, avg(rrp) AS avg_rrp, max(rrp) AS max_rrp, avg({_STRESS}) AS avg_market_stress_score FROM m GROUP BY 1, 2, 3", rounded=["avg_rrp", "avg_market_stress_score"])
def metric_price_ops(spark, d):
    C.register_sql_functions(spark)
    view = metrics.PRICE_OPERATIONS
    return view.query(market(spark, d), list(view.dimensions), list(view.measures))


@query(f"{{m}} SELECT event_id, CAST({_STRESS} AS DOUBLE) AS stress FROM m")
def stress_score(spark, d):
    return market(spark, d).select("event_id", C.market_stress_score(clean.margin(GENERATION, DEMAND), INTERCHANGE, PRICE).alias("stress"))


@query(f"""{{m}} SELECT event_id, CASE WHEN rrp >= 1000 THEN 'CRITICAL' WHEN rrp >= 300 THEN 'HIGH' WHEN rrp >= 100 THEN 'ELEVATED' ELSE 'NORMAL' END AS status, {_REGIME} AS regime, {_BAND} AS spike_band,
  CASE WHEN abs(demand_forecast_mw - total_demand_mw + rrp) < 50 THEN 'excellent' WHEN abs(demand_forecast_mw - total_demand_mw + rrp) < 150 THEN 'acceptable' WHEN abs(demand_forecast_mw - total_demand_mw + rrp) < 300 THEN 'watch' ELSE 'intervene' END AS error_band FROM m""")  # fmt: skip
def bands(spark, d):
    """U2, B21."""
    return market(spark, d).select("event_id", C.price_status(PRICE).alias("status"), C.demand_regime(DEMAND, "air_temp_c").alias("regime"), C.price_spike_band(PRICE).alias("spike_band"), C.forecast_error_band(F.col(DEMAND), F.col("demand_forecast_mw") + F.col(PRICE)).alias("error_band"))


# -- top-k --------------------------------------------------------------------------------------------------
@query("{m} SELECT settlement_date, total_demand_mw, rrp FROM m WHERE region_id = 'click' ORDER BY total_demand_mw DESC, event_id LIMIT 5")
def top_peaks(spark, d):
    return ranking.top(market(spark, d), [F.desc(DEMAND), F.asc("event_id")], 5, F.col(REGION) == "click").select(TS, DEMAND, PRICE)


@query("{m} SELECT event_id, region_id, rrp FROM m WHERE rrp > 100 ORDER BY rrp DESC, event_id LIMIT 20")
def top_spikes(spark, d):
    return ranking.top(market(spark, d), [F.desc(PRICE), F.asc("event_id")], 20, F.col(PRICE) > 100).select("event_id", REGION, PRICE)


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 500", ints=["l_linenumber"])
def latest_n(spark, d):
    return ranking.top(table(spark, d, "lineitem"), [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")], 500).select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("{m} SELECT CAST(settlement_date AS DATE) AS day, sum(total_demand_mw) AS total_demand FROM m GROUP BY 1 ORDER BY total_demand DESC, day LIMIT 1")
def best_group(spark, d):
    return ranking.best_group(market(spark, d), [F.to_date(TS).alias("day")], F.sum(DEMAND), "total_demand")


@query(f"{{m,}} h AS (SELECT {HOUR} AS hour, region_id, avg(rrp) AS avg_rrp FROM m GROUP BY 1, 2) SELECT * FROM h WHERE hour = (SELECT max(hour) FROM h)", rounded=["avg_rrp"])
def latest_hour_ranked(spark, d):
    """T5."""
    h = rollups.rollup_by(market(spark, d), {"hour": rollups.period(TS), REGION: F.col(REGION)}, {"avg_rrp": F.avg(PRICE)})
    return ranking.ranked_at_latest(h, "hour", [F.desc("avg_rrp"), F.asc(REGION)])


# -- sinks and layouts --------------------------------------------------------------------------------------
@query("""{m} SELECT settlement_date AS ts, region_id AS region, 'PRICE_SPIKE' AS type, rrp AS value, CAST(150 AS DOUBLE) AS threshold FROM m WHERE rrp > 150
  UNION ALL SELECT settlement_date, region_id, 'HIGH_DEMAND', total_demand_mw, CAST(8500 AS DOUBLE) FROM m WHERE total_demand_mw > 8500""")  # fmt: skip
def alerts(spark, d):
    return sinks.alerts(market(spark, d), TS, REGION, PRICE, DEMAND, 150, 8500)


@query("{m} SELECT 'market_demand,region=' || region_id || ' value=' || CAST(total_demand_mw AS VARCHAR) || ' ' || CAST(epoch_us(settlement_date) * 1000 AS VARCHAR) AS line FROM m")
def line_protocol(spark, d):
    return sinks.metric_lines(market(spark, d), TS, REGION, DEMAND)


def _layouts(spark, d):
    """Both layouts of the events, written once for a session."""

    def write(folder):
        m = market(spark, d).select("event_id", TS, REGION, PRICE, DEMAND)
        sinks.write_partitioned(m, f"{folder}/partitioned", TS)
        sinks.write_clustered(m, f"{folder}/clustered", [TS, REGION])

    folder = storage.once(spark, ("layout", d), write)
    return spark.read.parquet(f"{folder}/partitioned"), spark.read.parquet(f"{folder}/clustered")


@query("{m} SELECT region_id, count(*) AS n, avg(rrp) AS avg_value, max(rrp) AS max_value FROM m WHERE settlement_date >= DATE '2024-01-15' AND settlement_date < DATE '2024-01-16' GROUP BY 1", rounded=["avg_value"])
def layout_q1(spark, d):
    return layout.single_day(_layouts(spark, d)[1], TS, REGION, PRICE, "2024-01-15")


@query("{m} SELECT CAST(settlement_date AS DATE) AS day, avg(rrp) AS avg_value, max(rrp) AS max_value FROM m WHERE region_id = 'view' GROUP BY 1", rounded=["avg_value"])
def layout_q2(spark, d):
    return layout.one_region(_layouts(spark, d)[1], TS, REGION, PRICE, "view")


@query("{m} SELECT region_id, count(*) AS n, avg(rrp) AS avg_value FROM m WHERE settlement_date >= TIMESTAMP '2024-01-10' AND settlement_date < TIMESTAMP '2024-01-20' AND region_id IN ('view', 'click') GROUP BY 1", rounded=["avg_value"])
def layout_q3(spark, d):
    return layout.some_months(_layouts(spark, d)[0], TS, REGION, PRICE, ["view", "click"], "2024-01-10", "2024-01-20")


@query("{m} SELECT region_id, count(*) AS n, avg(rrp) AS avg_value, min(rrp) AS min_value, max(rrp) AS max_value FROM m GROUP BY 1", rounded=["avg_value"])
def layout_q4(spark, d):
    return layout.full_scan(_layouts(spark, d)[0], REGION, PRICE)


@query("{m} SELECT region_id, count(*) AS n, sum(total_demand_mw) AS total FROM m GROUP BY 1")
def layout_join(spark, d):
    """One layout joined with the other, row by row; events may share time and type."""
    a, b = _layouts(spark, d)
    both = a.select("event_id", TS, REGION, DEMAND).join(b.select("event_id", TS, REGION, PRICE), ["event_id", TS, REGION])
    return both.groupBy(REGION).agg(F.count(F.lit(1)).alias("n"), F.sum(DEMAND).alias("total"))


# -- scalars ------------------------------------------------------------------------------------------------
@query("{m} SELECT event_id, rrp FROM m WHERE settlement_date >= TIMESTAMP '2024-01-31' - INTERVAL 3 DAYS")
def recent_window(spark, d):
    """B10."""
    return clean.recent(market(spark, d), TS, AS_OF, "3 DAYS").select("event_id", PRICE)


@query("""{m} SELECT event_id, coalesce(air_temp_c, 0) AS air_temp_c, available_generation_mw - total_demand_mw AS margin, CASE WHEN total_demand_mw > 9000 THEN 300 + (total_demand_mw - 9000) * 0.5 WHEN total_demand_mw > 7000 THEN 100 + (total_demand_mw - 7000) * 0.1 ELSE 50 + total_demand_mw * 0.005 END AS made_price,
  CASE WHEN rrp > 100 THEN 1 ELSE 0 END AS is_spike FROM m WHERE settlement_date >= TIMESTAMP '2024-01-05' AND settlement_date < TIMESTAMP '2024-01-25'""", rounded=["made_price"], ints=["is_spike"])  # fmt: skip
def derived_columns(spark, d):
    """B11, B12, B14-B16."""
    rows = clean.fill(clean.between(market(spark, d), TS, "2024-01-05", "2024-01-25"), 0.0, "air_temp_c")
    return rows.select("event_id", "air_temp_c", clean.margin(GENERATION, DEMAND).alias("margin"), clean.piecewise_price(DEMAND).alias("made_price"), clean.label_above(PRICE, 100).alias("is_spike"))


@query("{m} SELECT event_id, total_demand_mw AS prediction, 'published' AS origin, rrp, coalesce(air_temp_c, 0) AS air_temp_c, CAST(0 AS DOUBLE) AS missing_feature FROM m")
def model_inputs(spark, d):
    """Renamed and constant columns, aligned to what a model wants."""
    m = market(spark, d)
    shaped = clean.shape_like(m, {"event_id": "event_id", DEMAND: "prediction", PRICE: PRICE, "air_temp_c": "air_temp_c"}, {"origin": "published"})
    return clean.align(shaped, [PRICE, "air_temp_c", "missing_feature"], ["event_id", "prediction", "origin"])


@query("SELECT event_id, ts + INTERVAL 10 HOURS AS local_ts FROM events")
def local_time(spark, d):
    """B19."""
    return table(spark, d, "events").select("event_id", C.local_time(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("local_ts"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 2 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS parsed FROM events")
def parsed_times(spark, d):
    """Times in four formats, quoted, and junk; each data line has a header line before it, which goes."""
    i, ts = F.col("event_id") % 6, F.col("ts")
    text = F.when(i == 0, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).when(i == 1, F.concat(F.lit('"'), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit('"'))).when(i == 2, F.date_format(ts, "yyyy/MM/dd HH:mm")).when(i == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(i == 4, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).otherwise("no time")
    rows = table(spark, d, "events").select("event_id", text.alias("text"), F.explode(F.array(F.lit("I"), F.lit("D"))).alias("ROW_TYPE"))
    return clean.only_rows(rows).select("event_id", C.parse_time("text").cast("timestamp_ntz").alias("parsed"))


@query("""SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS dd, CAST(ts AS DATE) AS day, hour(ts) AS hh, minute(ts) % 30 AS half, year(ts) AS y, month(ts) AS mo, day(ts) AS dom, dayofweek(ts) + 1 AS dow, isodow(ts) - 1 AS weekday, strftime(ts, '%A') AS name, strftime(ts, '%Y-%m') AS ym,
  date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) AS minutes FROM events""", ints=["hh", "half", "y", "mo", "dom", "dow", "weekday", "minutes"])  # fmt: skip
def date_parts(spark, d):
    """F1."""
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", rollups.period("ts").alias("h"), rollups.period("ts", "day").alias("dd"), F.to_date(ts).alias("day"), F.hour(ts).alias("hh"), (F.minute(ts) % 30).alias("half"), F.year(ts).alias("y"), F.month(ts).alias("mo"), F.dayofmonth(ts).alias("dom"),
        F.dayofweek(ts).alias("dow"), F.weekday(ts).alias("weekday"), F.date_format(ts, "EEEE").alias("name"), F.date_format(ts, "yyyy-MM").alias("ym"), F.timestamp_diff("MINUTE", F.lit("2024-01-01").cast("timestamp"), F.date_trunc("minute", ts)).alias("minutes"),
    )


@query("{m} SELECT event_id, abs(net_interchange_mw) AS a, round(rrp, 1) AS r, greatest(rrp, 20) AS g, least(rrp, 20) AS l, sin(hour(settlement_date) * 2 * pi() / 24) AS s, cos(hour(settlement_date) * 2 * pi() / 24) AS c, sqrt(rrp) AS q, least(greatest(rrp, 10), 50) AS clipped FROM m", rounded=["s", "c", "q"])
def math_scalars(spark, d):
    """F2."""
    circle = C.cyclical("h", F.hour(TS), 24)
    return market(spark, d).select("event_id", F.abs(INTERCHANGE).alias("a"), F.round(PRICE, 1).alias("r"), F.greatest(PRICE, F.lit(20.0)).alias("g"), F.least(PRICE, F.lit(20.0)).alias("l"), circle["h_sin"].alias("s"), circle["h_cos"].alias("c"), F.sqrt(PRICE).alias("q"), C.clip(PRICE, 10.0, 50.0).alias("clipped"))


@query("SELECT p_partkey, upper(p_name) AS up, trim(p_name) AS t, regexp_extract(p_brand, '#(\\d+)', 1) AS number, split_part(p_name, ' ', 1) AS first, substr(md5(p_name), 1, 12) AS digest, p_name || ':' || CAST(p_size AS VARCHAR) AS joined FROM part")
def string_scalars(spark, d):
    """F3."""
    quoted = F.concat(F.lit(' "'), F.col("p_name"), F.lit('" '))
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), C.clean_text(quoted).alias("t"), F.regexp_extract("p_brand", r"#(\d+)", 1).alias("number"), F.split("p_name", " ")[0].alias("first"), quality.partition_id("p_name").alias("digest"), F.format_string("%s:%d", "p_name", "p_size").alias("joined"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id AS back FROM events")
def json_scalars(spark, d):
    """a list of objects is parsed and exploded, and an object written and read again."""
    e = table(spark, d, "events").select("event_id", "user_id", F.explode(F.from_json(F.concat(F.lit("["), F.col("props"), F.lit("]")), "array<struct<k: bigint>>")).alias("o"))
    return e.select("event_id", F.col("o.k").alias("k"), F.from_json(F.to_json(F.struct("user_id")), "user_id bigint")["user_id"].alias("back"))


@query("{m} SELECT event_id, CASE WHEN air_temp_c IS NULL THEN 'none' WHEN air_temp_c < 10 THEN 'cold' WHEN air_temp_c < 30 THEN 'mild' ELSE 'hot' END AS heat, coalesce(air_temp_c, rrp) AS first_known FROM m")
def case_scalars(spark, d):
    """F5."""
    t = F.col("air_temp_c")
    return market(spark, d).select("event_id", F.when(t.isNull(), "none").when(t < 10, "cold").when(t < 30, "mild").otherwise("hot").alias("heat"), F.coalesce(t, F.col(PRICE)).alias("first_known"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'light' WHEN 'view' THEN 'light' WHEN 'purchase' THEN 'heavy' ELSE 'other' END AS class FROM events")
def map_lookup(spark, d):
    """F6."""
    return table(spark, d, "events").select("event_id", C.lookup("event_type", {"click": "light", "view": "light", "purchase": "heavy"}, "other", "unknown").alias("class"))


# -- scans --------------------------------------------------------------------------------------------------
@query("SELECT date_trunc('second', ts) AS settlement_date, event_type AS region_id, value AS rrp FROM events")
def report_scan(spark, d):
    """A1: each hour's events as reports of two record types inside a ZIP inside a ZIP, read back."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        lines = ["C,REPORT", "I,DISPATCH,REGIONSUM,4,SETTLEMENTDATE,REGIONID", "I,DISPATCH,PRICE,4,REGIONID,UNUSED,SETTLEMENTDATE,RRP"]
        for ts, region, value in zip(pdf["ts"], pdf["event_type"], pdf["value"], strict=True):
            lines.append(f'D,DISPATCH,PRICE,4,{region},x,"{ts:%Y/%m/%d %H:%M:%S}",{value!r}')
            lines.append(f'D,DISPATCH,REGIONSUM,4,"{ts:%Y/%m/%d %H:%M:%S}",{region}')
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("part.CSV", "\n".join([*lines, "C,END OF REPORT"]))
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("part.zip", inner.getvalue())
        return pd.DataFrame({"path": [f"PUBLIC_{pdf['slot'].iloc[0]}.zip"], "content": [outer.getvalue()]})

    files = reports.report_slots(table(spark, d, "events").select("ts", "event_type", "value"), "ts").groupBy("slot").applyInPandas(pack, "path string, content binary")
    return reports.scan(files, "DISPATCHPRICE").select(F.col("SETTLEMENTDATE").cast("timestamp_ntz").alias(TS), F.col("REGIONID").alias(REGION), F.col("RRP").alias(PRICE))


@query("SELECT 'U' || s_suppkey AS duid, s_name AS station_name, n_name AS state, CASE s_suppkey % 9 " + _FUEL_CASE + " ELSE 'unknown' END AS fuel_category, s_acctbal AS capacity_mw FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def registry_flatten(spark, d):
    """Each supplier as a station of a unit, and of one without a code, which goes."""
    from tidemark.sources.json_sources import flatten_registry

    tech = F.element_at(F.array(*map(F.lit, [*_FUELS, None])), (F.col("s_suppkey") % 9 + 1).cast("int"))
    unit = lambda code: F.struct(code.cast("string").alias("code"), tech.alias("fueltech_id"), F.col("s_acctbal").alias("capacity_registered"), F.lit("on").alias("status_id"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = s.select(F.to_json(F.array(F.struct(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name"), F.struct(F.col("n_name").alias("state")).alias("location"), F.array(unit(F.concat(F.lit("U"), "s_suppkey")), unit(F.lit(None))).alias("facilities")))).alias("value"))
    return flatten_registry(text).select(F.col("DUID").alias("duid"), "station_name", "state", "fuel_category", "capacity_mw")


def weather_documents(df):
    """Events as weather documents of one observation each."""
    o = F.struct(F.date_format("ts", "yyyyMMddHHmmss").alias("local_date_time_full"), F.when(F.col("event_id") % 5 == 0, "-").otherwise(F.col("value").cast("string")).alias("air_temp"), F.lit("").alias("rain_trace"), F.lit("SW").alias("wind_dir"), F.lit("s").alias("name"))
    return df.select("event_id", "ts", F.col("event_type").alias("region_id"), F.to_json(F.struct(F.struct(F.array(o).alias("data")).alias("observations"))).alias("value"))


@query("SELECT event_type AS region_id, date_trunc('second', ts) AS observation_time, CASE WHEN event_id % 5 <> 0 THEN value END AS air_temp_c, CAST(NULL AS DOUBLE) AS rain_since_9am_mm, 'SW' AS wind_dir FROM events")
def weather_flatten(spark, d):
    """A14."""
    from tidemark.sources.json_sources import flatten_weather

    out = flatten_weather(weather_documents(table(spark, d, "events")))
    return out.select("region_id", F.col("observation_time").cast("timestamp_ntz").alias("observation_time"), "air_temp_c", "rain_since_9am_mm", "wind_dir")


