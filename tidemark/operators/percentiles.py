"""Exact percentiles (G19) that hold for any number of groups of any size.

An approximate pass brackets each percentile of each group between two values. As long as a bracket holds many rows,
another pass counts them and narrows it. Then a pass counts what lies below each bracket and each distinct value within,
and the exact order statistics are read off those counts. Brackets are a table, written once a round and joined to the rows: broadcast if
its size is known to be small, else by key, where Spark splits a large group. No task holds a group, and
nothing of them comes to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.storage import small, written

#: Brackets are wide by 4 / ACCURACY of a group; of up to ACCURACY rows they need not be narrower.
ACCURACY = 10_000
#: A bracket is cut into so many parts of about as many rows.
PARTS = 100


def _brackets(rows: DataFrame, shares: Mapping[str, float], accuracy: int) -> DataFrame:
    """k, name, rank, part, low, high, held: where the order statistics of rank and rank + 1 lie, and some bound of the
    rows there. Small groups are taken as a whole."""
    ends = [min(max(s + d * 2 / accuracy, 0.0), 1.0) for s in shares.values() for d in (-1, 1)]
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, accuracy).alias("q"))
    whole = F.col("n") <= accuracy
    each = []
    for i, (name, share) in enumerate(shares.items()):
        at = F.lit(share) * (F.col("n") - 1)
        low, high = F.when(whole, F.lit(float("-inf"))).otherwise(F.col("q")[2 * i]), F.when(whole, F.lit(float("inf"))).otherwise(F.col("q")[2 * i + 1])
        each.append(F.struct(F.lit(name).alias("name"), F.floor(at).cast("bigint").alias("rank"), (at - F.floor(at)).alias("part"), low.alias("low"), high.alias("high")))
    held = F.when(whole, F.col("n")).otherwise(F.ceil(F.col("n") * 4 / accuracy)).cast("bigint").alias("held")
    return groups.select("k", held, F.explode(F.array(*each)).alias("b")).select("k", "b.*", "held")


def _met(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Rows with each bracket of their group, up to its end; ``v`` is null where a row lies below it."""
    b = small(brackets)
    met = rows.join(b, rows.k.eqNullSafe(b.k)).where("v <= high")
    return met.select(b.k, "name", "rank", "part", "low", "high", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v"))


def _narrowed(rows: DataFrame, brackets: DataFrame, accuracy: int) -> DataFrame:
    """Brackets with few rows stay; others are cut at the approximate percentiles of their own rows."""
    most = F.col("held") <= accuracy
    cuts = F.percentile_approx("v", [i / PARTS for i in range(PARTS + 1)], accuracy).alias("cuts")
    counts = _met(rows, brackets.where(~most)).groupBy("k", "name", "rank", "part", "low", "high").agg(F.count("v").alias("held"), (F.count(F.lit(1)) - F.count("v")).alias("below"), cuts)

    def cut(ahead: int, wider: float, round_: str) -> Column:
        share = (F.col("rank") + ahead - F.col("below")) / F.col("held") + wider
        return F.element_at("cuts", F.least(F.greatest(getattr(F, round_)(share * PARTS).cast("int"), F.lit(0)), F.lit(PARTS)) + 1)

    low, high = F.greatest("low", cut(0, -2 / accuracy, "floor")), F.least("high", cut(1, 2 / accuracy, "ceil"))
    new = counts.select("k", "name", "rank", "part", low.alias("l"), high.alias("h"), "held", ((low <= F.col("low")) & (high >= F.col("high"))).alias("same"))
    # a bracket that can't be narrowed, such as one of equal values, is done; what one holds now is known after the next count
    return brackets.where(most).unionByName(new.select("k", "name", "rank", "part", F.col("l").alias("low"), F.col("h").alias("high"), F.when(F.col("same") | (F.col("l") == F.col("h")) | (F.col("held") <= accuracy), 0).otherwise(F.col("held")).cast("bigint").alias("held")))


def exact_percentiles(df: DataFrame, key: str, value: str, shares: Mapping[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """``key`` and one column for each name: the value at that share, interpolated between neighbours.

    Null values don't count; a null key is a group; a group without values has no row.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    brackets = written(_brackets(rows, shares, accuracy), "brackets")
    while not brackets.where(F.col("held") > accuracy).isEmpty():
        brackets = written(_narrowed(rows, brackets, accuracy), "brackets")
    # one row for what lies below a bracket, and one for each distinct value in it
    counts = _met(rows, brackets).groupBy("k", "name", "rank", "part", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("k", "name").orderBy(F.col("v").asc_nulls_first()))
    placed = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("c"))
    at = [F.max(F.when((F.col("before") <= F.col("rank") + d) & (F.col("rank") + d < F.col("upto")), F.col("v"))).alias(f"v{d}") for d in (0, 1)]
    values = placed.groupBy("k", "name", "part").agg(*at).withColumn("p", F.col("v0") + F.col("part") * (F.coalesce("v1", "v0") - F.col("v0")))
    return values.groupBy(F.col("k").alias(key)).agg(*[F.max(F.when(F.col("name") == n, F.col("p"))).alias(n) for n in shares])
