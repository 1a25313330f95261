"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put into blocks of equal size, in an order that a hash decides. Weights are whole
parts of their sum, which is about 10**9, so a weight w is an exact fraction. Block k of a source may run from
slot floor((k - 1) / w) on and has to run by slot ceil(k / w). In every slot the released block with the earliest
deadline runs. As the weights add up to one, no deadline is missed, and in every prefix no source is a whole block
away from its share. A source that has run out leaves its slots empty; the others keep their windows. Nothing is
dropped and nothing repeated.

The schedule is made over blocks, not over rows: a block has ``BLOCK_ROWS`` rows or as many more as bring all rows
into ``SLOTS`` blocks, so there are SLOTS + sources of them at most at any size of the table. One row makes it, as
each slot depends on the one before it; its work grows with the slots, and with the sources once in an epoch (see the
README for times). The rows themselves are numbered in parallel, within hash ranges of a source, after the ranges have been counted, so
a source, or one doc_id, or rows without one, may hold any share of them; they meet their block's slot in a broadcast of that bounded schedule.

DataFrame functions only. A null source is a source of its own. Rows repeated with the same doc_id take a place
each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.storage import small, written

#: Rows of a block at least, blocks of a schedule at most (beside one for each source), hex digits of a hash range.
BLOCK_ROWS, SLOTS, RANGE_DIGITS = 8, 32_768, 3
TEMPERATURE = 0.7
#: Parts that the weights are rounded to.
PARTS = 1_000_000_000
ADDED = ("_block", "_release", "_deadline", "_slot", "_position", "_in_proportion")

#: Slots of an epoch; rows that are numbered together at most, but for rows of one hash that one task reads.
EPOCH, HEAVY = 128, 200_000

# The schedule is made epoch by epoch. An epoch begins at the first slot for which a job is released. As it runs no
# more than EPOCH jobs, of those released by then only the EPOCH with the earliest deadlines can have their turn; with
# those that are released within it they are all that its steps have to look at. In a step the released job with the
# earliest deadline (then the first source) runs, and the source's next job takes its place, if it has one.
_JOB = "named_struct('deadline', ((x.k + 1) * whole + x.part - 1) div x.part, 'i', x.i, 'release', (x.k * whole) div x.part, 'k', x.k + 1, 'part', x.part, 'blocks', x.blocks)"
_NONE = "array_repeat(named_struct('i', 0, 'k', 0L, 'slot', 0L), 0)"
_STEP = f"""
  transform(array(greatest(a.t, coalesce(array_min(transform(a.next, x -> x.release)), t0 + {EPOCH}))), t -> if(t >= t0 + {EPOCH}, a,
    transform(array(array_min(filter(a.next, x -> x.release <= t))), p -> named_struct(
      't', t + 1,
      'next', filter(transform(a.next, x -> if(x.i = p.i, {_JOB}, x)), x -> x.k <= x.blocks),
      'run', concat(a.run, array(named_struct('i', p.i, 'k', p.k, 'slot', t)))))[0]))[0]"""
_EPOCH = f"""
  transform(array(greatest(e.t, array_min(transform(e.next, x -> x.release)))), t0 ->
    transform(array(sort_array(filter(e.next, x -> x.release <= t0))), ready ->
      transform(array(aggregate(sequence(1, {EPOCH}),
        named_struct('t', t0, 'next', concat(slice(ready, 1, {EPOCH}), filter(e.next, x -> x.release > t0 and x.release < t0 + {EPOCH})), 'run', {_NONE}),
        (a, _) -> {_STEP})), r ->
      named_struct('t', r.t, 'next', concat(r.next, slice(ready, {EPOCH + 1}, size(ready)), filter(e.next, x -> x.release >= t0 + {EPOCH})), 'run', concat(e.run, r.run)))[0])[0])[0]"""
# There are no more epochs than blocks, and mostly far fewer: they are counted in two loops, so that few turns are idle.
_TURNS = "sequence(1, cast(ceil(sqrt(total)) as int))"
_RUN = f"""
  aggregate({_TURNS}, named_struct('t', 0L, 'next', jobs, 'run', {_NONE}), (o, _) -> if(size(o.next) = 0, o,
    transform(array(aggregate({_TURNS}, named_struct('t', o.t, 'next', o.next, 'run', {_NONE}), (e, _) -> if(size(e.next) = 0, e, {_EPOCH}))), b ->
      named_struct('t', b.t, 'next', b.next, 'run', concat(o.run, b.run)))[0])).run"""


def weighed(sizes: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, slots: int = SLOTS) -> DataFrame:
    """source, i, n, part, whole, block_rows, blocks, full: each source's share, part / whole, and its blocks.

    Without ``weights`` a source weighs its count to the power ``temperature``; sources that ``weights`` leaves
    out weigh as much as the least of those named. No part is less than one.
    """
    if weights:
        given = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w))])
        weight: Column = F.coalesce(F.element_at(given, F.col("source")), F.lit(float(min(weights.values()))))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    listed = sizes.groupBy().agg(F.sort_array(F.collect_list(F.struct("source", "n", weight.alias("w")))).alias("q"), F.sum("n").alias("rows"))
    # added up in the order of the sources, so that a task that runs again can't round a weight the other way
    listed = listed.withColumn("sum_w", F.aggregate("q", F.lit(0.0), lambda total, x: total + x["w"]))
    each = listed.where("rows > 0").select("rows", "sum_w", F.posexplode("q").alias("i", "x"))
    parts = each.select("rows", "x.source", "x.n", "i", F.greatest(F.lit(1), F.round(F.col("x.w") / F.col("sum_w") * PARTS)).cast("bigint").alias("part"))
    whole = parts.groupBy("rows").agg(F.sum("part").alias("whole"))
    rows = F.greatest(F.lit(block_rows), F.ceil(F.col("rows") / F.lit(slots))).cast("bigint")
    shared = parts.join(whole, "rows").withColumn("block_rows", rows)
    return shared.select("source", "i", "n", "part", "whole", "block_rows", F.ceil(F.col("n") / F.col("block_rows")).cast("bigint").alias("blocks"), F.floor(F.col("n") / F.col("block_rows")).cast("bigint").alias("full"))


def schedule(shares: DataFrame) -> DataFrame:
    """i, k, slot, horizon: where each block runs, and the slot up to which every source had a full block to give."""
    one = shares.groupBy("whole").agg(
        F.sort_array(F.collect_list(F.struct(
            F.expr("(whole + part - 1) div part").alias("deadline"), "i", F.lit(0).cast("bigint").alias("release"), F.lit(1).cast("bigint").alias("k"), "part", "blocks"
        ))).alias("jobs"),
        F.sum("blocks").alias("total"),
        F.min(F.expr("(full * whole) div part")).alias("horizon"),
    )
    return one.select("horizon", F.expr(f"explode({_RUN})").alias("job")).select("job.i", "job.k", "job.slot", "horizon")


def _ranged(rows: DataFrame, heavy: int) -> DataFrame:
    """``_range``: the beginning of the hash that a source's rows are numbered by. Where more than ``heavy`` rows share one, it is
    longer; where so many have one hash, as rows of one doc_id have, it ends in the partition that a row was read
    in: the order among such rows is free. Ranges are in the order of hashes."""
    rows = rows.withColumn("_range", F.substring("_hash", 1, RANGE_DIGITS))
    for finer in (F.substring("_hash", 1, 3 * RANGE_DIGITS), F.concat("_hash", F.lpad(F.col("_read").cast("string"), 10, "0"))):
        full = rows.groupBy(F.col("_source").alias("_s"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy)
        full = written(full.select("_s", "_r"), "ranges")  # a row for each ``heavy`` rows of the table at most
        if full.isEmpty():
            break
        met = rows.join(small(full), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")), "left")
        rows = met.withColumn("_range", F.when(F.col("_r").isNotNull(), finer).otherwise(F.col("_range"))).drop("_s", "_r")
    return rows


def _placed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, block_rows: int = BLOCK_ROWS, slots: int = SLOTS, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", heavy: int = HEAVY) -> DataFrame:
    """Each row as the struct ``_row``, with its place in the schedule."""
    # the row travels as one struct, so its columns never meet the names used here
    picked = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.spark_partition_id().alias("_read"))
    rows = _ranged(picked.withColumn("_hash", F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.lit(str(seed))).cast("binary"))), heavy)
    # one key without nulls for source and range, so that numbering and the join share an exchange of the rows
    rows = rows.withColumn("_bucket", F.concat(F.coalesce(F.hex("_source"), F.lit("-")), F.lit(":"), "_range"))
    counts = rows.groupBy("_bucket", "_source", "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counts.groupBy(F.col("_source").alias("source")).agg(F.sum("_n").alias("n"))
    shares = weighed(sizes, weights, temperature, block_rows, slots)
    plan = schedule(shares).select(F.col("i").alias("_i"), (F.col("k") - 1).alias("_block"), F.col("slot").alias("_slot"), F.col("horizon").alias("_horizon"))
    # what a row has to know stands with its bucket: the rows before it, and its source's share
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = shares.select(F.col("source").alias("_s"), F.col("i").alias("_i"), F.col("part").alias("_part"), F.col("whole").alias("_whole"), F.col("block_rows").alias("_per"))
    offsets = offsets.join(own, F.col("_source").eqNullSafe(F.col("_s"))).select("_bucket", "_before", "_i", "_part", "_whole", "_per")
    numbered = rows.select("_row", "_id", "_hash", "_bucket").withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", "_id")))
    joined = numbered.join(offsets, "_bucket").withColumn("_number", F.col("_before") + F.col("_rn") - 1).withColumn("_block", F.expr("_number div _per"))
    # SLOTS and a row for each source at most
    met = joined.join(F.broadcast(plan), ["_i", "_block"])
    return met.select(
        "_row", "_block", F.expr("(_block * _whole) div _part").alias("_release"), F.expr("((_block + 1) * _whole + _part - 1) div _part").alias("_deadline"),
        "_slot", F.expr("_slot * _per + _number % _per").alias("_position"), (F.col("_slot") < F.col("_horizon")).alias("_in_proportion"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs`` with ``_block, _release, _deadline, _slot, _position, _in_proportion`` added.

    ``_position`` orders the mix. ``_in_proportion`` holds up to the slot in which the first source would release a
    block that it can't fill. Columns of the same names in ``docs`` are replaced. Without ``weights`` by source,
    ``temperature`` decides; further options: ``block_rows``, ``slots``, ``seed``, ``id_col``, ``source_col`` and ``heavy``.
    """
    return _placed(docs, weights, **options).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, all of them once and as they were, in the order of the mix; ``written_position`` reads it back."""
    return _placed(docs, **options).orderBy("_position").select("_row.*")


def written_position(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs``, read from files that hold a sorted result, with each row's place in it as ``name``, from 0 without gaps.

    Spark gives the files of a sorted result numbers in its order, but reads them in any. The place is the row's in
    its file, beyond those of the files before: one count for each file is broadcast.
    """
    at = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    counts = at.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    file = F.element_at(F.split("_file", "/"), -1)
    number = F.regexp_extract(file, r"^part-([0-9]+)", 1).try_cast("bigint")  # beyond 99,999 names no longer sort as numbers do
    earlier = Window.partitionBy(F.lit(0)).orderBy(number, file).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return at.join(F.broadcast(starts), "_file").select(*docs.columns, (F.col("_start") + F.col("_at")).alias(name))
