"""Window features (W1-W12): lags, rolling and range frames, fills, temporal splits.

Entities may be few and their histories long, so no window here is over an entity alone. Row frames run over chunks of
an entity's rows, numbered by counting hours first; time frames are put together from whole buckets of time and the parts
of two; fills carry one value from hour to hour. What is windowed over an entity is a row for each hour or bucket only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions import columns as C
from tidemark.operators.storage import small, written

#: Rows of an entity that one task sees at once; the time whose rows are numbered together.
CHUNK_ROWS, BUCKET = 20_000, "hour"

#: Rows that a task of ``trailing`` sorts, on average: a row of running figures takes about a kilobyte there.
TASK_ROWS = 200_000


def tasks(df: DataFrame, rows_each: int = TASK_ROWS) -> int:
    """How many tasks the rows are dealt to, so that a task's memory doesn't grow with the table; one a core at least (one
    number comes to the driver)."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_each))


def lags(value: Column | str, steps: Iterable[int], over: WindowSpec, name: str) -> dict[str, Column]:
    """W5."""
    return {f"{name}_lag_{k}": F.lag(value, k).over(over) for k in steps}


def rolling(value: Column | str, n: int, over: WindowSpec, function: str = "avg") -> Column:
    """Over the last ``n`` rows; null until all of them have a value."""
    v = F.col(value) if isinstance(value, str) else value
    frame = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(v).over(frame) == n, getattr(F, function)(v).over(frame))


def _rolling_means(df: DataFrame, means: Mapping[str, tuple[str, int]], over: WindowSpec) -> DataFrame:
    """W6 for long frames: the mean of the last ``n`` rows, {name: (column, n)}, as a double; null until all of them have a value.

    Spark goes over a whole frame for each row. Here a frame is put together from sums of short ones, which lie one after
    another: 18 sums of 16 rows for 288. Nothing is taken off a running sum, so no digits are lost.
    """
    sums, made = {}, {}
    for i, (name, (c, n)) in enumerate(means.items()):
        value, part = F.col(c), math.isqrt(n)
        if not isinstance(df.schema[c].dataType, T.DoubleType):  # even an idle cast would part this window from the one before it
            value = value.cast("double")
        sums[f"_sum{i}"] = rolling(value, part, over, "sum")
        parts = [F.lag(f"_sum{i}", k).over(over) for k in range(0, n - part + 1, part)]
        if n % part:  # the oldest rows
            sums[f"_rest{i}"] = rolling(value, n % part, over, "sum")
            parts.append(F.lag(f"_rest{i}", n - n % part).over(over))
        made[name] = sum(parts[1:], parts[0]) / F.lit(float(n))
    return df.withColumns(sums).withColumns(made).drop(*sums) if means else df


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    both = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)]
    return both[0] & both[1] if len(both) == 2 else both[0]


def numbered(df: DataFrame, entity: str, ts: str, tie: str | None = None, bucket: str = BUCKET, fills: Mapping[str, str] | None = None, both_ways: Sequence[str] = ()) -> DataFrame:
    """Rows with ``_at``, their place among their entity's rows by time from 0, and ``_total``, how many it has.

    Rows of a bucket of time are numbered there; what lies before it comes from the counts of buckets. ``fills`` maps columns to
    their filled forms (see ``fill``), which are worked out in the same buckets. Two keys without nulls stand for bucket and
    entity, so the rows are dealt once for both and for what they get from other buckets. The bucket is a number and comes first,
    as rows are sorted by it then: texts that begin alike would have to be compared to their ends.
    """
    names = dict(fills or {})
    when = C.time_bucket(df, ts, bucket)
    place = when if isinstance(df.schema[ts].dataType, T.NumericType) else F.unix_micros(when)
    of = F.coalesce(F.hex(F.encode(F.col(entity).cast("string"), "UTF-8")), F.lit("-"))
    keys = ["_place", "_key"]
    rows = df.withColumns({"_place": F.coalesce(place, F.lit(0)), "_key": F.when(place.isNull(), F.concat(of, F.lit(":"))).otherwise(of)})
    order = [F.col(ts), *([F.col(tie)] if tie else [])]
    known = {c: F.when(F.col(c).isNotNull(), F.struct(*order)) for c in names}
    found = [F.count(F.lit(1)).alias("_n"), *[F.max_by(F.col(c), known[c]).alias(f"_last{i}") for i, c in enumerate(names)], *[F.min_by(F.col(c), known[c]).alias(f"_first{i}") for i, c in enumerate(names) if c in both_ways]]
    counts = rows.groupBy(*keys, F.col(entity).alias("_e"), C.time_bucket(df, ts, bucket).alias("_b")).agg(*found)
    over = Window.partitionBy("_e").orderBy("_b")
    whole, earlier, later = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    others = [F.last(f"_last{i}", ignorenulls=True).over(earlier).alias(f"_last{i}") for i in range(len(names))] + [F.first(f"_first{i}", ignorenulls=True).over(later).alias(f"_first{i}") for i, c in enumerate(names) if c in both_ways]
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"), *others)
    inside = Window.partitionBy(*keys).orderBy(*order)
    made = {"_rn": F.row_number().over(inside)}
    for i, c in enumerate(names):
        made[f"_l{i}"] = F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        if c in both_ways:
            made[f"_f{i}"] = F.first(c, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    placed = rows.withColumns(made).join(offsets, keys).withColumn("_at", F.col("_before") + F.col("_rn") - 1)
    filled = {name: F.coalesce(*[F.col(f"{x}{i}") for x in ("_l", "_last", *(("_f", "_first") if c in both_ways else ()))]) for i, (c, name) in enumerate(names.items())}
    return placed.withColumns(filled).drop(*keys, "_rn", "_before", *[f"{x}{i}" for i in range(len(names)) for x in ("_l", "_last", "_f", "_first")])


def in_chunks(df: DataFrame, entity: str, ts: str, make: Callable[[WindowSpec], Mapping[str, Column]], lookback: int, tie: str | None = None, chunk_rows: int = CHUNK_ROWS, bucket: str = BUCKET, fills: Mapping[str, str] | None = None, means: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
    """Columns of a window that looks back ``lookback`` rows at most; with ``fills``, W7 in the same dealing of the rows;
    with ``means``, {name: (column, rows)}, means over long frames, whose work doesn't grow with their length as ``rolling`` does.

    Rows of an entity are cut into chunks of equal length. The last rows of a chunk are copied to the next one, where
    they are seen but not given back. So a task holds a chunk, and the result is that of one window over the entity.
    What ``make`` says of a column that is filled, it says of the filled one.
    """
    chunk_rows = max(chunk_rows, lookback)
    placed = numbered(df, entity, ts, tie, bucket, fills).drop("_total").withColumn("_own", F.floor(F.col("_at") / chunk_rows))
    tail = F.col("_at") % chunk_rows >= chunk_rows - lookback
    dealt = placed.withColumn("_chunk", F.explode(F.when(tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    over = Window.partitionBy(entity, "_chunk").orderBy("_at")
    made = _rolling_means(dealt.withColumns(dict(make(over))), means or {}, over)
    return made.where("_own = _chunk").drop("_at", "_own", "_chunk")


def fill(df: DataFrame, entity: str, ts: str, names: Mapping[str, str], tie: str | None = None, both_ways: Sequence[str] = (), bucket: str = BUCKET) -> DataFrame:
    """``names`` maps a column to its filled form: the last value so far; for those in ``both_ways``, what comes
    before the first value takes that.

    The last (and first) value of each bucket of time of an entity is carried to the buckets after (and before);
    within a bucket the rows' own values come first.
    """
    return numbered(df, entity, ts, tie, bucket, names, both_ways).drop("_at", "_total")


def seconds(duration: str) -> int:
    """Of 'hours:minutes:seconds'."""
    h, m, s = map(int, duration.split(":"))
    return 3600 * h + 60 * m + s


#: What each function of a time frame needs to know of a part of it.
_NEEDS = {"count": ("n",), "sum": ("n", "mean"), "avg": ("n", "mean"), "stddev_pop": ("n", "mean", "m2"), "min": ("mn",), "max": ("mx",)}


def _part(value: str, need: Sequence[str], over: WindowSpec | None = None) -> list[Column]:
    """Count, mean, sum of squares about it, least and most of a part."""
    made = {"n": F.count(value), "mean": F.avg(value), "v": F.var_pop(value), "mn": F.min(value), "mx": F.max(value)}
    if over is not None:
        made = {k: c.over(over) for k, c in made.items()}
    made["m2"] = made["v"] * made["n"]
    return [made[k].alias(k) for k in need]


def _summed(parts: Column, need: Sequence[str]) -> Column:
    """A list of parts as one part."""
    n = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + p["n"]) if "n" in need else F.lit(0)

    def made(mean: Column) -> Column:
        squares = F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.coalesce(p["m2"] + p["n"] * F.pow(p["mean"] - mean, 2), F.lit(0.0))) if "m2" in need else None
        each = {"n": n, "mean": mean, "m2": squares, "mn": F.array_min(F.transform(parts, lambda p: p["mn"])) if "mn" in need else None, "mx": F.array_max(F.transform(parts, lambda p: p["mx"])) if "mx" in need else None}
        return F.struct(*[each[x].alias(x) for x in need])

    if "mean" not in need:
        return made(F.lit(None))
    mean = F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.coalesce(p["n"] * p["mean"], F.lit(0.0))) / F.nullif(n, F.lit(0))
    return F.transform(F.array(mean), made)[0]


def _together(parts: list[Column], function: str) -> Column:
    """A measure of parts that lie apart; sums of squares are put together about the common mean."""
    if function in ("min", "max"):
        values = [p["mn" if function == "min" else "mx"] for p in parts]
        return F.least(*values) if function == "min" else F.greatest(*values)
    counts = [F.coalesce(p["n"], F.lit(0)) for p in parts]
    n = sum(counts[1:], counts[0])
    if function == "count":
        return n
    sums = [F.coalesce(p["mean"], F.lit(0.0)) * c for p, c in zip(parts, counts)]
    total = sum(sums[1:], sums[0])
    if function == "sum":
        return F.when(n > 0, total)
    if function == "avg":
        return F.when(n > 0, total / n)
    mean = total / n
    squares = [F.coalesce(p["m2"] + c * F.pow(p["mean"] - mean, 2), F.lit(0.0)) for p, c in zip(parts, counts)]
    return F.when(n > 0, F.sqrt(sum(squares[1:], squares[0]) / n))


def trailing(df: DataFrame, entity: str, ts: str, measures: Mapping[str, tuple[str, str, str]], include_current: bool = False, bucket_seconds: int | None = None) -> DataFrame:
    """Measures over the time before each row, ``{name: (function, column, 'hours:minutes:seconds')}``.

    A row sees what lies in [t - duration, t): nothing of its own time, unless ``include_current``. Functions are
    count, sum, avg, stddev_pop, min and max. Rows without an entity or time have nulls (a count of none).

    Time is cut into buckets that divide every duration, so a frame is the end of one bucket, whole buckets, and the
    beginning of another. Beginnings and ends are running figures within a bucket, found at the row's time and at the
    time a duration before it; whole buckets are summed over one row each. The work is that of the rows, however long
    the frames are, and a task holds a bucket of an entity. Rows are counted first and dealt to as many tasks as they need.
    """
    lengths = sorted({seconds(d) for _, _, d in measures.values()})
    width = bucket_seconds or math.gcd(*lengths)
    if any(d % width for d in lengths):
        raise ValueError("a bucket has to divide every duration")
    columns = list(dict.fromkeys(c for _, c, _ in measures.values()))
    need = {c: list(dict.fromkeys(x for f, col, _ in measures.values() if col == c for x in _NEEDS[f])) for c in columns}
    micros, span = 1_000_000, width * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull()).select(F.col(entity).alias("_e"), at.alias("_t"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    values = [f"_v{i}" for i in range(len(columns))]
    times = rows.select("_e", "_t").distinct()
    # one row a bucket, and for each duration the whole buckets before it
    whole = rows.groupBy("_e", F.floor(F.col("_t") / span).alias("_b")).agg(*[F.struct(*_part(v, need[c])).alias(v) for v, c in zip(values, columns)])

    reach = {i: [d for d in lengths if d > width and any(col == c and seconds(x) == d for _, col, x in measures.values())] for i, c in enumerate(columns)}
    lists = [(i, d, f"_m{i}_{d}") for i in reach for d in reach[i]]
    back = {d: Window.partitionBy("_e").orderBy("_b").rangeBetween(-(d // width - 1), -1) for d in lengths if d > width}
    middle = whole.select(F.col("_e").alias("_me"), F.col("_b").alias("_mb"), *[F.collect_list(values[i]).over(back[d]).alias(m) for i, d, m in lists])
    middle = middle.select("_me", "_mb", *[_summed(F.col(m), need[columns[i]]).alias(m) for i, d, m in lists])
    # rows, and each time with the times that its frames begin at, meet in their buckets
    asked = times.select("_e", F.col("_t").alias("_origin"), F.explode(F.array(*[F.lit(d).cast("bigint") for d in (0, *lengths)])).alias("_d"))
    asked = asked.select("_e", (F.col("_origin") - F.col("_d") * micros).alias("_t"), "_origin", "_d")
    parts = tasks(df, TASK_ROWS // (len(lengths) + 2))  # a row comes once, its time once and once for each duration
    met = rows.unionByName(asked, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / span)).repartition(parts, "_e", "_b")
    since = Window.partitionBy("_e", "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0 if include_current else -1)
    until = Window.partitionBy("_e", "_b").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0)
    running = met.select("_e", "_b", "_t", "_origin", "_d", *[F.struct(*_part(v, need[c], since)).alias(f"_s{i}") for i, (v, c) in enumerate(zip(values, columns))], *[F.struct(*_part(v, need[c], until)).alias(f"_u{i}") for i, (v, c) in enumerate(zip(values, columns))])
    found = running.where(F.col("_origin").isNotNull()).join(middle, _same(["_e", "_b"], ["_me", "_mb"]), "left")
    own, asked_of = F.col("_d") == 0, sorted({(columns.index(c), seconds(d)) for _, c, d in measures.values()})
    gathered = found.repartition(parts, "_e", "_origin").groupBy("_e", "_origin").agg(
        *[F.max_by(f"_s{i}", F.when(own, 1)).alias(f"_s{i}") for i in range(len(columns))],
        *[F.max_by(m, F.when(own, 1)).alias(m) for _, _, m in lists],
        *[F.max_by(f"_u{i}", F.when(F.col("_d") == d, 1)).alias(f"_u{i}_{d}") for i, d in asked_of],
    )
    figures = []
    for name, (f, c, d) in measures.items():
        i, d = columns.index(c), seconds(d)
        figures.append(_together([F.col(x) for x in (f"_u{i}_{d}", *([f"_m{i}_{d}"] if d > width else []), f"_s{i}")], f).alias(name))
    results = gathered.select(F.col("_e").alias("_re"), F.col("_origin").alias("_rt"), *figures)
    out = df.withColumn("_t", at).repartition(parts, entity, "_t").join(results, (F.col(entity) == F.col("_re")) & (F.col("_t") == F.col("_rt")), "left").drop("_t", "_re", "_rt")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n, (f, _, _) in measures.items() if f == "count"})


def tumbling(df: DataFrame, entity: str, ts: str, value: str, duration: str = "1 hour") -> DataFrame:
    """Rows with the figures of the fixed window they fall into."""
    w = F.window(F.col(ts).cast("timestamp"), duration)["start"].cast("timestamp_ntz")
    keyed = df.withColumn("window_start", w)
    sums = keyed.groupBy(entity, "window_start").agg(F.avg(value).alias("window_avg"), F.count(value).alias("window_n"))
    return keyed.join(sums, [entity, "window_start"])


def sliding(df: DataFrame, entity: str, ts: str, value: str, duration: str, slide: str) -> DataFrame:
    """W10."""
    w = F.window(F.col(ts).cast("timestamp"), duration, slide)
    out = df.groupBy(entity, w.alias("w")).agg(F.avg(value).alias("window_avg"), F.count(F.lit(1)).alias("window_n"))
    return out.select(entity, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "window_avg", "window_n")


def temporal_split(df: DataFrame, entity: str, ts: str, share: float = 0.8, tie: str | None = None, bucket: str = BUCKET) -> DataFrame:
    """The first ``share`` of each entity's rows train, the rest test; both have a row where there are two.

    Rows are counted by buckets of time. Only in the bucket where an entity's share ends are they put in order, and those
    are written, so that the split is the same whenever it is read; all others stay where they lie. ``df`` is read
    for the counts and again for the rows, so one that is dear to work out is written first.
    """
    rows = df.withColumn("_b", C.time_bucket(df, ts, bucket))
    counts = rows.groupBy(F.col(entity).alias("_e"), F.col("_b").alias("_end")).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy("_e")
    total = F.sum("_n").over(over)
    cut = F.greatest(F.lit(1), F.least(total - 1, F.floor(total * F.lit(share))))
    placed = counts.select("_e", "_end", "_n", (cut - F.sum("_n").over(over.orderBy("_end")) + F.col("_n")).alias("_take"))  # of a bucket: how many train
    ends = small(written(placed.where("_take BETWEEN 1 AND _n").withColumn("_whole", F.expr("_take = _n")).drop("_n"), "ends"))  # one bucket of an entity
    met = rows.join(ends, F.col(entity).eqNullSafe(F.col("_e")))
    at_end = F.col("_b").eqNullSafe(F.col("_end"))
    earlier = F.coalesce(F.col("_b") < F.col("_end"), F.col("_b").isNull())  # no time comes first
    order = Window.partitionBy("_e").orderBy(ts, *([tie] if tie else []))
    names = [*df.columns, "is_train"]
    clear = met.where(~at_end | F.col("_whole")).withColumn("is_train", at_end | earlier).select(*names)
    parted = met.where(at_end & ~F.col("_whole")).withColumn("is_train", F.row_number().over(order) <= F.col("_take")).select(*names)
    return clear.unionByName(written(parted, "split"))


def history(df: DataFrame, entity: str) -> DataFrame:
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))


def affordable(df: DataFrame, entity: str, steps: Sequence[int]) -> list[int]:
    """The steps that the shortest history allows (one number comes to the driver)."""
    least = history(df, entity).agg(F.min("n")).first()[0] or 0
    return [k for k in steps if k < least]
