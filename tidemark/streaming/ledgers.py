"""Streams into files that readers see by whole batches.

A batch first writes its rows under a name of its own and is then entered in a ledger, a folder of small records that are
written whole or not at all. Readers take only what the ledger has. So a batch that broke half-way, or that Spark runs
again, shows nothing twice, and no target is searched for rows that it may have already. One query writes to a
target at a time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.joins import small
from tidemark.operators.storage import checkpoint, commit, committed, exists, remove


def batch_name(batch: DataFrame, number: int) -> str:
    """The query's id, which is in its checkpoint, and the batch's number."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("not inside a batch of a streaming query")
    return f"{query}-{number:09d}"


def _started(writer, at: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", at)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


# -- several tables at once -----------------------------------------------------------------------------------
def write_batch(batch: DataFrame, name: str, folder: str, targets: Mapping[str, Sequence[str]], key: Sequence[str] = ()) -> None:
    """A batch into all its targets, of some of its columns each, once per ``key``; visible in all of them at once."""
    spark = batch.sparkSession
    if exists(spark, f"{folder}/_ledger/{name}.json"):
        return
    batch = batch.persist()
    for target, names in targets.items():
        rows = batch.select(*names)
        (rows.dropDuplicates(list(key)) if key else rows).write.mode("overwrite").parquet(f"{folder}/{target}/batch={name}")
    batch.unpersist()
    commit(spark, f"{folder}/_ledger", name, {"batch": name})


def append_to_targets(df: DataFrame, folder: str, targets: Mapping[str, Sequence[str]], at: str, key: Sequence[str] = (), interval: str | None = None) -> StreamingQuery:
    """Each batch goes to several targets below ``folder``. A batch that is repeated, also one that broke between two
    targets, adds nothing twice. Without an interval: what is there now, then end."""
    return _started(df.writeStream.foreachBatch(lambda batch, n: write_batch(batch, batch_name(batch, n), folder, targets, key)), at, interval)


def read_target(spark: SparkSession, folder: str, target: str, schema: str) -> DataFrame:
    """The rows of a target that the ledger vouches for; ``schema`` holds its columns."""
    if not exists(spark, f"{folder}/{target}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch string").parquet(f"{folder}/{target}")
    return rows.join(small(committed(spark, f"{folder}/_ledger", "batch string")), "batch", "left_semi").drop("batch")


# -- a view that follows its stream ---------------------------------------------------------------------------
@dataclass(frozen=True)
class HourlyView:
    """Hourly figures of all rows that a stream has brought, open hours and late rows among them.

    What is kept of an hour and its keys can be merged: rows, values, their mean, the sum of squares about it, least,
    most. A batch is summed up, merged with what is kept of the days that it touches, and written as a new version of
    these days; the files of other days stay as they are. The ledger says which version of a day holds. A null value
    counts as a row only; a row without a time is in no hour and is left out; null keys are keys.
    """

    folder: str
    ts: str
    keys: tuple[str, ...]
    value: str

    def _partial(self, rows: DataFrame) -> DataFrame:
        v = F.col(self.value).cast("double")
        rows = rows.where(F.col(self.ts).isNotNull()).withColumn("_hour", F.date_trunc("hour", F.col(self.ts)))
        summed = rows.groupBy(F.to_date("_hour").alias("day"), F.col("_hour").alias("hour"), *self.keys).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most")
        )
        return summed.withColumn("part", F.lit(1))

    def _merged(self, parts: DataFrame) -> DataFrame:
        """Of each hour two parts at most: what is kept (0) and what has come (1)."""
        both = parts.groupBy("day", "hour", *self.keys).agg(F.sort_array(F.collect_list(F.struct("part", "n_rows", "n", "mean", "squares", "least", "most"))).alias("p"))
        a, b = F.col("p")[0], F.try_element_at("p", F.lit(2))
        n = a["n"] + F.coalesce(b["n"], F.lit(0))
        apart = b["mean"] - a["mean"]
        two = (a["n"] > 0) & (b["n"] > 0)
        return both.select(
            "day", "hour", *self.keys, (a["n_rows"] + F.coalesce(b["n_rows"], F.lit(0))).alias("n_rows"), n.alias("n"),
            F.when(two, a["mean"] + apart * b["n"] / n).otherwise(F.coalesce(a["mean"], b["mean"])).alias("mean"),
            F.when(two, a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / n).otherwise(F.coalesce(a["squares"], b["squares"])).alias("squares"),
            F.least(a["least"], b["least"]).alias("least"), F.greatest(a["most"], b["most"]).alias("most"),
        )

    def _holds(self, spark: SparkSession) -> DataFrame:
        ledger = committed(spark, f"{self.folder}/_ledger", "version bigint, days array<date>")
        return ledger.select("version", F.explode("days").alias("day")).groupBy("day").agg(F.max("version").alias("version"))

    def _versions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/days").withColumns({"version": F.col("version").cast("bigint"), "day": F.col("day").cast("date")})

    def _kept(self, spark: SparkSession) -> DataFrame | None:
        """The versions that hold, with ``day`` and ``version``."""
        if not exists(spark, f"{self.folder}/days"):
            return None
        return self._versions(spark).join(small(self._holds(spark)), ["day", "version"], "left_semi")

    def clean(self, spark: SparkSession) -> None:
        """Delete the versions that no longer hold; not while a batch is brought in or the view is read."""
        old = self._versions(spark).select("day", "version").distinct().join(self._holds(spark), ["day", "version"], "left_anti")
        for day, version in old.toLocalIterator():
            remove(spark, f"{self.folder}/days/day={day}/version={version}")

    def apply(self, batch: DataFrame, name: str) -> None:
        """Bring the view up to date with a batch; one that the ledger has already changes nothing."""
        spark = batch.sparkSession
        if exists(spark, f"{self.folder}/_ledger/{name}.json"):
            return
        come = checkpoint(self._partial(batch))
        days = [r[0] for r in come.select("day").distinct().collect()]  # the days of one batch
        version = (committed(spark, f"{self.folder}/_ledger", "version bigint").agg(F.max("version")).first()[0] or 0) + 1
        if days:
            kept = self._kept(spark)
            parts = come if kept is None else come.unionByName(kept.where(F.col("day").isin(days)).drop("version").withColumn("part", F.lit(0)))
            merged = self._merged(parts).withColumn("version", F.lit(version)).repartition("day")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "version").parquet(f"{self.folder}/days")
        commit(spark, f"{self.folder}/_ledger", name, {"version": version, "days": [str(d) for d in days]})

    def follow(self, df: DataFrame, at: str, interval: str | None = None) -> StreamingQuery:
        """Keep the view up to date with a stream. Without an interval: with what is there now, then end."""
        return _started(df.writeStream.foreachBatch(lambda batch, n: self.apply(batch, batch_name(batch, n))), at, interval)

    def rows(self, spark: SparkSession) -> DataFrame:
        """hour, keys, avg_value, std_value (of a sample), min_value, max_value, n (rows)."""
        kept = self._kept(spark)
        if kept is None:
            raise ValueError(f"nothing has come to {self.folder} yet")
        std = F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("std_value")
        return kept.select("hour", *self.keys, F.col("mean").alias("avg_value"), std, F.col("least").alias("min_value"), F.col("most").alias("max_value"), F.col("n_rows").alias("n"))
