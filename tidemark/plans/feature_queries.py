"""Queries over windows, features, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, joins, models, windows
from tidemark.plans.frames import as_market, market, query, scratch, table
from tidemark.plans.market_queries import DEMAND, HOUR, PRICE, REGION, TS
from tidemark.streaming import streams

OVER = "(PARTITION BY region_id ORDER BY settlement_date, event_id)"


def _frame(n):
    return f"(PARTITION BY region_id ORDER BY settlement_date, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(f, c, n):
    return f"CASE WHEN count({c}) OVER {_frame(n)} = {n} THEN {f}({c}) OVER {_frame(n)} END"


def _lag(c, k):
    return f"lag({c}, {k}) OVER {OVER}"


@query("{m} SELECT event_id, " + ", ".join(f"{_lag('total_demand_mw', k)} AS demand_lag_{k}" for k in (1, 2, 3, 6, 12, 48, 288)) + " FROM m")
def lag_features(spark, d):
    make = lambda over: windows.lags(DEMAND, features.LOAD_LAGS, over, "demand")
    return windows.in_chunks(market(spark, d), REGION, TS, make, max(features.LOAD_LAGS), "event_id").select("event_id", *[f"demand_lag_{k}" for k in features.LOAD_LAGS])


_ROLLING_SQL = f"{{m}} SELECT event_id, {_roll('avg', 'rrp', 12)} AS mean_12, {_roll('stddev', 'rrp', 12)} AS std_12, {_roll('min', 'rrp', 12)} AS min_12, {_roll('max', 'rrp', 12)} AS max_12, {_roll('avg', 'air_temp_c', 12)} AS temp_12 FROM m"
_ROLLING = {"mean_12": ("avg", PRICE), "std_12": ("stddev", PRICE), "min_12": ("min", PRICE), "max_12": ("max", PRICE), "temp_12": ("avg", "air_temp_c")}


def _rolled(over):
    return {n: windows.rolling(c, 12, over, f) for n, (f, c) in _ROLLING.items()}


@query(_ROLLING_SQL, rounded=["mean_12", "std_12", "temp_12"])
def rolling_features(spark, d):
    return windows.in_chunks(market(spark, d), REGION, TS, _rolled, 11, "event_id").select("event_id", *_ROLLING)


@query(_ROLLING_SQL, rounded=["mean_12", "std_12", "temp_12"])
def rolling_features_chunked(spark, d):
    """W6 in short chunks, numbered by hours."""
    return windows.in_chunks(market(spark, d), REGION, TS, _rolled, 11, "event_id", chunk_rows=500, bucket="hour").select("event_id", *_ROLLING)


@query(f"""{{m,}} f AS (SELECT event_id, region_id, settlement_date, air_temp_c, last_value(air_temp_c IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY settlement_date, event_id ROWS UNBOUNDED PRECEDING) AS ff FROM m)
  SELECT event_id, ff AS filled, coalesce(ff, first_value(air_temp_c IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY settlement_date, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled_both FROM f""")  # fmt: skip
def ffill(spark, d):
    """W7."""
    rows = market(spark, d).select("event_id", REGION, TS, "air_temp_c", F.col("air_temp_c").alias("air"))
    return windows.fill(rows, REGION, TS, {"air_temp_c": "filled", "air": "filled_both"}, "event_id", ["air"]).select("event_id", "filled", "filled_both")


def _range(f, c, interval):
    return f"{f}({c}) OVER (PARTITION BY region_id ORDER BY settlement_date RANGE BETWEEN INTERVAL {interval} PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


_RANGE_SQL = "{m} SELECT event_id, " + ", ".join(f"{_range(f, 'rrp', i)} AS {n}" for n, f, i in (("avg_1h", "avg", "1 HOUR"), ("max_6h", "max", "6 HOUR"), ("std_24h", "stddev_pop", "24 HOUR"), ("n_24h", "count", "24 HOUR"))) + " FROM m"
_RANGES = {"avg_1h": ("avg", PRICE, "01:00:00"), "max_6h": ("max", PRICE, "06:00:00"), "std_24h": ("stddev_pop", PRICE, "24:00:00"), "n_24h": ("count", PRICE, "24:00:00")}


@query(_RANGE_SQL, rounded=["avg_1h", "std_24h"])
def range_features(spark, d):
    """W8."""
    return windows.trailing(market(spark, d), REGION, TS, _RANGES).select("event_id", *_RANGES)


@query(_RANGE_SQL, rounded=["avg_1h", "std_24h"])
def range_features_bucketed(spark, d):
    """W8 put together from buckets of ten minutes."""
    return windows.trailing(market(spark, d), REGION, TS, _RANGES, bucket_seconds=600).select("event_id", *_RANGES)


@query(f"{{m,}} h AS (SELECT {HOUR} AS window_start, region_id, avg(rrp) AS window_avg, count(rrp) AS window_n FROM m GROUP BY 1, 2) SELECT event_id, h.* FROM m JOIN h ON m.region_id = h.region_id AND {HOUR} = h.window_start", rounded=["window_avg"])
def tumbling_feature(spark, d):
    """W9."""
    return windows.tumbling(market(spark, d), REGION, TS, PRICE).select("event_id", REGION, "window_start", "window_avg", "window_n")


@query("""{m,} s AS (SELECT region_id, rrp, time_bucket(INTERVAL 30 MINUTES, settlement_date, TIMESTAMP '2024-01-01') - INTERVAL 30 MINUTES * i AS window_start FROM m, (SELECT unnest([0, 1]) AS i))
  SELECT region_id, window_start, avg(rrp) AS window_avg, count(*) AS window_n FROM s GROUP BY 1, 2""", rounded=["window_avg"])  # fmt: skip
def sliding_agg(spark, d):
    """W10."""
    return windows.sliding(market(spark, d), REGION, TS, PRICE, "1 hour", "30 minutes")


@query(f"""{{m,}} l AS (SELECT event_id, region_id, settlement_date FROM m), f AS (SELECT region_id, settlement_date + INTERVAL 1 HOUR AS settlement_date, rrp FROM m)
  SELECT l.event_id, f.settlement_date AS as_of_time, f.rrp AS as_of_rrp FROM l ASOF LEFT JOIN f ON l.region_id = f.region_id AND l.settlement_date > f.settlement_date""")
def asof_other_table(spark, d):
    """Strictly before. The facts come an hour late."""
    m = market(spark, d)
    labels, facts = m.select("event_id", REGION, TS), m.select(REGION, (F.col(TS) + F.expr("INTERVAL 1 HOUR")).alias(TS), PRICE)
    return joins.as_of(labels, facts, REGION, TS, [PRICE]).select("event_id", "as_of_time", "as_of_rrp")


@query("""{m,} l AS (SELECT event_id, region_id, settlement_date FROM m), f AS (SELECT region_id, settlement_date + INTERVAL 1 DAY AS settlement_date, rrp FROM m)
  SELECT l.event_id, f.settlement_date AS as_of_time, f.rrp AS as_of_rrp FROM l ASOF LEFT JOIN f ON l.region_id = f.region_id AND l.settlement_date >= f.settlement_date""")  # fmt: skip
def pit_join(spark, d):
    """Up to and including the row's own time. The facts come a day late."""
    m = market(spark, d)
    return joins.as_of(m.select("event_id", REGION, TS), m.select(REGION, (F.col(TS) + F.expr("INTERVAL 1 DAY")).alias(TS), PRICE), REGION, TS, [PRICE], include_current=True).select("event_id", "as_of_time", "as_of_rrp")


@query("""{m,} n AS (SELECT event_id, row_number() OVER (PARTITION BY region_id ORDER BY settlement_date, event_id) AS rn, count(*) OVER (PARTITION BY region_id) AS n FROM m)
  SELECT event_id, rn <= greatest(1, least(n - 1, floor(n * CAST(0.8 AS DOUBLE)))) AS is_train FROM n""")  # fmt: skip
def temporal_split(spark, d):
    """W11."""
    return windows.temporal_split(market(spark, d), REGION, TS, tie="event_id").select("event_id", "is_train")


_LOAD = [f"demand_lag_{k}" for k in features.LOAD_LAGS] + ["demand_rolling_1h_mean", "demand_rolling_1h_std", "demand_rolling_1d_mean", "rrp_rolling_1h_mean", "hour_sin", "dow_cos", "published_forecast_error", "air_temp_c"]


@query(f"""{{m,}} x AS (SELECT event_id, {', '.join(f"{_lag('total_demand_mw', k)} AS demand_lag_{k}" for k in features.LOAD_LAGS)}, {_roll('avg', 'total_demand_mw', 12)} AS demand_rolling_1h_mean, {_roll('stddev', 'total_demand_mw', 12)} AS demand_rolling_1h_std,
  {_roll('avg', 'total_demand_mw', features.DAY)} AS demand_rolling_1d_mean, {_roll('avg', 'rrp', 12)} AS rrp_rolling_1h_mean, sin(hour(settlement_date) * 2 * pi() / 24) AS hour_sin, cos((isodow(settlement_date) - 1) * 2 * pi() / 7) AS dow_cos,
  demand_forecast_mw - total_demand_mw AS published_forecast_error, last_value(air_temp_c IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY settlement_date, event_id ROWS UNBOUNDED PRECEDING) AS air_temp_c FROM m)
  SELECT * FROM x WHERE demand_lag_288 IS NOT NULL AND demand_rolling_1d_mean IS NOT NULL AND air_temp_c IS NOT NULL""", rounded=[c for c in _LOAD if "roll" in c or "sin" in c or "cos" in c])  # fmt: skip
def load_features(spark, d):
    """L1."""
    return features.load_features(market(spark, d), tie="event_id").select("event_id", *_LOAD)


_PRICE = ["supply_margin_mw", "demand_lag_12", "demand_rolling_1h_mean", "gen_lag_1", "margin_lag_1", "margin_rolling_1h_mean", "margin_rolling_1h_min", "interchange_lag_1", "interchange_rolling_1h", "rrp_lag_6", "rrp_rolling_1h_mean", "rrp_rolling_1h_std", "rrp_rolling_1h_max", "demand_forecast_error"]
_GAP = "(available_generation_mw - total_demand_mw)"


@query(f"""{{m,}} x AS (SELECT event_id, {_GAP} AS supply_margin_mw, {_lag('total_demand_mw', 12)} AS demand_lag_12, {_roll('avg', 'total_demand_mw', 12)} AS demand_rolling_1h_mean, {_lag('available_generation_mw', 1)} AS gen_lag_1, {_lag(_GAP, 1)} AS margin_lag_1,
  {_roll('avg', _GAP, 12)} AS margin_rolling_1h_mean, {_roll('min', _GAP, 12)} AS margin_rolling_1h_min, {_lag('net_interchange_mw', 1)} AS interchange_lag_1, {_roll('avg', 'net_interchange_mw', 12)} AS interchange_rolling_1h, {_lag('rrp', 6)} AS rrp_lag_6,
  {_roll('avg', 'rrp', 12)} AS rrp_rolling_1h_mean, {_roll('stddev', 'rrp', 12)} AS rrp_rolling_1h_std, {_roll('max', 'rrp', 12)} AS rrp_rolling_1h_max, demand_forecast_mw - total_demand_mw AS demand_forecast_error,
  last_value(air_temp_c IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY settlement_date, event_id ROWS UNBOUNDED PRECEDING) AS t FROM m)
  SELECT * EXCLUDE (t) FROM x WHERE demand_lag_12 IS NOT NULL AND rrp_rolling_1h_mean IS NOT NULL AND t IS NOT NULL""", rounded=[c for c in _PRICE if "roll" in c])  # fmt: skip
def price_features(spark, d):
    """L2."""
    return features.price_features(market(spark, d), tie="event_id").select("event_id", *_PRICE)


@query(f"""{{m,}} x AS (SELECT event_id, region_id, settlement_date, {_lag('rrp', 1)} AS l, avg(rrp) OVER {_frame(12)} AS rrp_rolling_12, hour(settlement_date) AS hour, isodow(settlement_date) - 1 AS day_of_week, CASE WHEN isodow(settlement_date) > 5 THEN 1 ELSE 0 END AS is_weekend FROM m)
  SELECT event_id, coalesce(l, first_value(l IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY settlement_date, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rrp_lag_1, rrp_rolling_12, hour, day_of_week, is_weekend FROM x""", rounded=["rrp_rolling_12"], ints=["hour", "day_of_week", "is_weekend"])  # fmt: skip
def minimal_features(spark, d):
    """L3."""
    return features.minimal_features(market(spark, d), PRICE, tie="event_id").select("event_id", "rrp_lag_1", "rrp_rolling_12", "hour", "day_of_week", "is_weekend")


@query(f"{{m}} SELECT event_id, {_lag('rrp', 24)} AS rrp_lag_24, {_roll('avg', 'rrp', 12)} AS rrp_rolling_mean_12, sin(month(settlement_date) * 2 * pi() / 12) AS month_sin, cos(month(settlement_date) * 2 * pi() / 12) AS month_cos FROM m", rounded=["rrp_rolling_mean_12", "month_sin", "month_cos"])
def simple_features(spark, d):
    """L4."""
    return features.simple_features(market(spark, d), PRICE, tie="event_id").select("event_id", "rrp_lag_24", "rrp_rolling_mean_12", "month_sin", "month_cos")


@query(f"{{m}} SELECT event_id, {_lag('total_demand_mw', 48)} AS demand_lag_48, {_roll('avg', 'total_demand_mw', 12)} AS demand_rolling_1h_mean FROM m", rounded=["demand_rolling_1h_mean"])
def adaptive_features(spark, d):
    """The lags that every type's history allows; 48 is one of them at every size of the tables."""
    return features.adaptive_features(market(spark, d), tie="event_id").select("event_id", "demand_lag_48", "demand_rolling_1h_mean")


_TRAINING_SQL = ", ".join(
    f"{_range(f, c, {'01:00:00': '1 HOUR', '06:00:00': '6 HOUR', '24:00:00': '24 HOUR'}[w])} AS {n}" for n, (f, c, w) in features.TRAINING_FEATURES.items()
)


@query(f"{{m}} SELECT event_id, CASE WHEN rrp > 100 THEN 1 ELSE 0 END AS is_spike, {_TRAINING_SQL} FROM m", rounded=[n for n, (f, _, _) in features.TRAINING_FEATURES.items() if f in ("avg", "stddev_pop")], ints=["is_spike"])
def training_set(spark, d):
    """L5."""
    return features.training_set(market(spark, d), 100).select("event_id", "is_spike", *features.TRAINING_FEATURES)


# -- models -------------------------------------------------------------------------------------------------
_INPUTS = ["demand_rolling_1h_mean", "demand_rolling_1d_mean", "hour_sin", "hour_cos", "rrp_lag_1"]


def _trained(spark, d):
    """A model of the earlier part of each type, what it says of the later part, and its inputs. Lags
    and day are those of L1; where no type has so many rows, as on the smallest tables, the longest lag that there is
    stands for them."""
    m = market(spark, d)
    longest = windows.history(m, REGION).agg(F.max("n")).first()[0] or 0
    lags = [k for k in features.LOAD_LAGS if k < longest]
    rows = features.load_features(m, lag_steps=lags, day_rows=min(features.DAY, max(lags, default=1)), tie="event_id")
    names = [f"demand_lag_{k}" for k in lags] + _INPUTS
    return *models.train_regressor(rows.select(TS, REGION, DEMAND, *names), names, DEMAND, REGION, TS), names


@query()
def train_score(spark, d):
    """Trained on the earlier part of each type, scored on the later."""
    model, later, _ = _trained(spark, d)
    return models.score(later.drop("features", "prediction"), model, [TS, REGION], DEMAND, "demand", 1)


@query()
def model_importances(spark, d):
    """The inputs of L7's model by their importance in its trees, which add up to one."""
    model, _, names = _trained(spark, d)
    ranked = [(n + 1, name, weight) for n, (name, weight) in enumerate(models.importances(model, names))]
    return spark.createDataFrame(ranked, "place int, feature string, importance double")


@query()
def spike_classifier(spark, d):
    """L8."""
    rows = features.training_set(market(spark, d), 60)
    names = ["demand_avg_1h", "rrp_avg_1h", "rrp_avg_6h", "rrp_std_6h", "rrp_max_24h"]
    _, later = models.train_classifier(rows, names, "is_spike", REGION, TS)
    return later.select("event_id", "is_spike", F.col("prediction").cast("int").alias("predicted"))


# -- streams: the events' file replayed until its end ----------------------------------------------------------
def _replay(spark, d):
    # a pattern, as a stream takes a folder or a pattern, and the table may be a single file
    return as_market(streams.file_stream(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema))


def _played(spark, df, name):
    folder = scratch(spark, name)
    done = streams.append_files(df, f"{folder}/out", f"{folder}/state")
    done.awaitTermination()
    if done.exception() is not None:
        raise done.exception()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("{m} SELECT a.settlement_date, a.region_id, a.total_demand_mw, b.rrp FROM m a JOIN m b ON a.settlement_date = b.settlement_date AND a.region_id = b.region_id")
def stream_join(spark, d):
    """X1, J2."""
    m = _replay(spark, d)
    joined = streams.watermarked_join(m.select(TS, REGION, DEMAND), m.select(TS, REGION, PRICE), [TS, REGION], TS)
    return _ntz(_played(spark, joined.select(TS, REGION, DEMAND, PRICE), "stream-join"), TS)


@query("SELECT DISTINCT date_trunc('minute', ts) AS refresh_slot FROM events WHERE minute(ts) % 30 = 0")
def stream_ticks(spark, d):
    """X2."""
    return _ntz(_played(spark, streams.half_hour_ticks(_replay(spark, d), TS), "stream-ticks"), "refresh_slot")


@query(f"{{m}} SELECT {HOUR} AS hour, region_id, avg(rrp) AS avg_value, max(rrp) AS max_value, count(*) AS n FROM m GROUP BY 1, 2 HAVING {HOUR} + INTERVAL 1 HOUR <= (SELECT max(settlement_date) FROM m) - INTERVAL 10 MINUTES", rounded=["avg_value"])
def stream_hourly(spark, d):
    """Hours that the watermark has passed."""
    return _ntz(_played(spark, streams.hourly_stream(_replay(spark, d), TS, REGION, PRICE), "stream-hourly"), "hour")


@query("{m,} w AS (SELECT region_id, arg_max(rrp, settlement_date) AS last_rrp FROM m GROUP BY 1) SELECT event_id, m.region_id, total_demand_mw, last_rrp FROM m LEFT JOIN w USING (region_id)")
def stream_static_join(spark, d):
    """J3."""
    static = joins.latest_by(market(spark, d), [REGION], TS, [F.col(PRICE).alias("last_rrp")], "event_id").drop(TS)
    return _played(spark, streams.with_static(_replay(spark, d).select("event_id", REGION, DEMAND), static, REGION), "stream-static")


@query("""WITH t AS (SELECT DISTINCT date_trunc('minute', ts) AS refresh_slot FROM events WHERE minute(ts) % 30 = 0)
  SELECT refresh_slot, event_type AS region_id, value AS air_temp_c FROM t JOIN events ON date_trunc('minute', ts) = refresh_slot""")  # fmt: skip
def stream_weather(spark, d):
    """Ticks of a stream meet the documents of their slot, whose observations become rows."""
    e = table(spark, d, "events")
    documents = e.select(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("refresh_slot"), F.to_json(F.array(F.struct(F.col("event_type").alias("region_id"), F.col("value").alias("air_temp_c")))).alias("text"))
    out = streams.expand_observations(streams.half_hour_ticks(_replay(spark, d), TS), documents, "refresh_slot", "text", "region_id: string, air_temp_c: double")
    return _ntz(_played(spark, out, "stream-weather"), "refresh_slot")


