"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling hash of its bytes says so, so equal texts have equal chunks wherever they lie.
Chunks are deduplicated to identifiers: a short hash, verified against the SHA-256 of the chunk; where one
short hash stands for different chunks, the long digest takes its place. Two texts are equal if their ordered
lists of identifiers are. Only hashes are shuffled: a long text is read once, in the task that holds it, and
never moved.

Null counts as empty; empty texts have the empty recipe and equal each other. Among rows repeated with the
same doc_id and text, one is kept. Rows without doc_id group like others; they stay only if their whole group
has none. Columns other than the two named are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, checkpoint, fresh

#: Smallest and largest chunk in bytes; a cut falls on one position in 2**CUT_BITS of those that may be cut.
SMALLEST, LARGEST, CUT_BITS = 256, 16384, 10
#: Keys of repeated rows up to which they are broadcast (some 90 bytes each).
BROADCAST_KEYS = 100_000
_MIX = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places after which the content asks for a cut: the rolling hash of 16 bytes has CUT_BITS high zeros."""
    h = _MIX[data]
    for shift in (1, 2, 4, 8):
        moved = h.copy()
        moved[shift:] += h[:-shift] << np.uint32(shift)
        h = moved
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(places: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the text at start..end of the buffer that ``places`` belongs to."""
    ends, last = [], start
    low, high = np.searchsorted(places, [start + 16, end])
    for place in places[low:high].tolist():
        while place - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if place - last >= SMALLEST:
            ends.append(place)
            last = place
    while end - last > LARGEST:
        last += LARGEST
        ends.append(last)
    if end > last:
        ends.append(end)
    return ends


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        base, stop = int(offsets[0]), int(offsets[-1])
        view = memoryview(text.buffers()[2])[base:stop] if stop > base else memoryview(b"")
        places = cut_places(np.frombuffer(view, np.uint8)) if stop > base else np.empty(0, np.int64)
        bounds = (offsets - base).tolist()
        digests, chunks = [], []
        for a, b in zip(bounds, bounds[1:]):
            digests.append(hashlib.sha256(view[a:b]).hexdigest())
            ends = chunk_ends(places, a, b)
            chunks.append(
                [
                    {"short": xxhash.xxh64_intdigest(part := view[x:y]) - (1 << 63), "digest": hashlib.sha256(part).digest(), "bytes": y - x}
                    for x, y in zip([a, *ends], ends)
                ]
            )
        kind = pa.list_(pa.struct([("short", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(chunks, kind)], ["doc_id", "text_sha256", "chunks"])


def chunk_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the digest of the whole text, and its chunks in order: short hash, SHA-256 and length of each."""
    arrow_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return picked.mapInArrow(_chunked, "doc_id bigint, text_sha256 string, chunks array<struct<short: bigint, digest: binary, bytes: int>>")


def ambiguous_hashes(chunked: DataFrame) -> DataFrame:
    """Short hashes that stand for more than one chunk (next to none). Partial sums first, so no hot chunk gathers."""
    each = chunked.select(F.explode("chunks").alias("c")).select("c.*")
    spread = each.groupBy("short").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.min("bytes").alias("shortest"), F.max("bytes").alias("longest"))
    return spread.where((F.col("least") != F.col("most")) | (F.col("shortest") != F.col("longest"))).select("short")


def recipes(chunked: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and the ordered list of verified chunk identifiers.

    A document without an ambiguous chunk, that is nearly every one, keeps its list of short hashes as it is;
    the others get the long digests of the ambiguous chunks in their place.
    """
    plain = F.transform("chunks", lambda c: F.hex(c["short"]))
    bad = checkpoint(ambiguous_hashes(chunked))
    if bad.isEmpty():
        return chunked.select("doc_id", "text_sha256", plain.alias("recipe"))
    marked = (
        chunked.select("doc_id", "text_sha256", F.posexplode("chunks").alias("place", "c"))
        .select("doc_id", "text_sha256", "c.short")
        .join(bad, "short", "left_semi")
        .groupBy("doc_id", "text_sha256")
        .agg(F.collect_set("short").alias("bad"))
    )
    joined = chunked.join(marked, ["doc_id", "text_sha256"], "left")
    verified = F.transform("chunks", lambda c: F.when(F.array_contains("bad", c["short"]), F.hex(c["digest"])).otherwise(F.hex(c["short"])))
    return joined.select("doc_id", "text_sha256", F.when(F.col("bad").isNull(), plain).otherwise(verified).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, and copies, the
    rows that share both id and text.

    Of equal texts the row with the largest doc_id stays. A group may hold any share of the rows: it is
    summed before it is shuffled, and joined back on a key that Spark may split.
    """
    chunked = checkpoint(chunk_texts(docs, id_col, text_col))
    rows = recipes(chunked)
    # structs as keys: the join below then deals both sides anew by recipe, in exchanges that Spark may split
    counted = rows.groupBy(F.struct("recipe", "doc_id", "text_sha256").alias("row")).agg(F.count(F.lit(1)).alias("copies")).select("row.*", "copies")
    groups = rows.groupBy(F.struct("recipe").alias("key")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("key.recipe", "keep_id", "group_size")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    return (
        counted.join(groups, "recipe")
        .select("doc_id", "keep_id", "group_size", "text_sha256", F.size("recipe").cast("bigint").alias("n_chunks"), "copies", copy)
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chunks", "copies")
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    A text is shuffled once, to meet the keys that stay. Rows repeated with the same id and text, of which one stays,
    are told apart beforehand: where there are any, theirs are brought to one in each partition before the shuffle
    that leaves one in all, so a row that a third of all rows repeat gathers nowhere.
    """
    name = fresh(docs, "stay_key")

    def key(digest):
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest).alias(name)

    stay = checkpoint(exact_duplicates(docs).where("kept").groupBy(key(F.col("text_sha256"))).agg(F.max("copies").alias("copies")))
    again = stay.where("copies > 1").select(name)
    keyed = docs.select("*", key(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    kept = keyed.join(stay.where("copies = 1").select(name), name, "left_semi")
    n = again.count()
    if n:
        repeated = keyed.join(F.broadcast(again) if n <= BROADCAST_KEYS else again, name, "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates([name]))
    return kept.select(docs.columns)
