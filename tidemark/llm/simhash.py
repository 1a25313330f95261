"""Near duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints take 64 bits from the word shingles of each whole text. To find all pairs at ``distance`` or
fewer differing bits, the bits are arranged into partitions, each with a threshold of its own; if the
thresholds add up to distance - partitions + 1, two fingerprints that close agree in at least one partition
up to its threshold. Correlated bits are put into the same partition, so that the partitions tell as much as
they can, and the number of partitions and their thresholds come from dynamic programming over the candidate
counts estimated from the counts of each partition's values. Fingerprints are probed by partition value,
candidates verified on all 64 bits, and what links is joined up to components.

Equal fingerprints are one node, however many documents share them. The members of a partition value are
verified in blocks, and each block returns no more links than it has members (a spanning forest), so a large
group costs neither a task of its own nor all its pairs.

Null and empty texts have fingerprint zero and link like any other. Rows without doc_id get the component of
their fingerprint, which ignores them; it is null if no row has an id. Repeated rows are given repeatedly. Texts of any length
are read whole; an empty table gives an empty result. Of columns only the two named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, keep_ids, map_texts
from tidemark.llm.components import connected_components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Members of a partition value that are verified together; larger values are dealt out as pairs of blocks.
BLOCK = 2048
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is one if it is set in over half of the shingles' hashes, repeats included."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    ends = list(accumulate(len(w) + 1 for w in words))
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(line, SEED)], np.uint64)
    else:
        starts = [0, *ends]
        hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
    # eight counters of eight bits in each word: up to 255 hashes are added at once
    counts = np.zeros(BITS, np.int64)
    lanes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    for low in range(0, len(lanes), 255):
        counts += lanes[low : low + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer."""

    def rows(ids: list, texts: list) -> list:
        return [ids, np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, rows, "doc_id bigint, fp bigint", id_col, text_col)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlations(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """Absolute correlations of the bits over all fingerprints, from 64 x 64 counts summed in the tasks, and their number."""

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for frame in frames:
            b = _bits(frame["fp"].to_numpy(np.int64)).astype(np.float32)
            total += b.T @ b
            n += len(b)
        if n:
            yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})

    cells = np.zeros(BITS * BITS + 1)
    for cell, n in nodes.select("fp").mapInPandas(counts, "cell int, n double").groupBy("cell").agg(F.sum("n")).collect():
        cells[cell] = n
    n = max(cells[-1], 1.0)
    both = cells[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread)), int(cells[-1])


def arrange(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits grouped into ``parts`` of nearly equal width, the most correlated ones together."""
    left, found = set(range(BITS)), []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        first = max(left, key=lambda i: (sum(correlation[i, j] for j in left), -i))
        group = [first]
        left.remove(first)
        while len(group) < width:
            nearest = max(left, key=lambda i: (sum(correlation[i, j] for j in group), -i))
            group.append(nearest)
            left.remove(nearest)
        found.append(sorted(group))
    return found


def _project(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each value, packed."""
    v, out = values.view(np.uint64), np.zeros(len(values), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((v >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out.view(np.int64)


def probes(width: int, threshold: int) -> list[int]:
    """Masks of up to ``threshold`` bits in a partition of so many bits."""
    masks = [0]
    if threshold >= 1:
        masks += [1 << i for i in range(width)]
    if threshold >= 2:
        masks += [1 << i | 1 << j for i in range(width) for j in range(i)]
    if threshold >= 3:
        masks += [1 << i | 1 << j | 1 << k for i in range(width) for j in range(i) for k in range(j)]
    return masks


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds (-1 leaves a partition out) that add up to ``total`` at the least cost: costs[p][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for t, c in enumerate(row, start=-1):
                if so_far + t not in step or cost + c < step[so_far + t][0]:
                    step[so_far + t] = (cost + c, [*chosen, t])
        best = step
    return best[total][1]


def plan_partitions(nodes: DataFrame, distance: int = DISTANCE, ways: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, chosen over all fingerprints.

    The estimate for a partition: each probe mask costs a row a fingerprint, and leads to the mean count of
    fingerprints that share a value (the sum of squared counts), as neighbouring values are counted alike.
    """
    correlation, n = bit_correlations(nodes)
    arranged = {m: arrange(correlation, m) for m in ways}
    flat = [(m, p, bits) for m in ways for p, bits in enumerate(arranged[m])]

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64)
            for k, (_, _, bits) in enumerate(flat):
                value, count = np.unique(_project(fp, bits), return_counts=True)
                yield pd.DataFrame({"k": k, "value": value, "n": count})

    shared = nodes.select("fp").mapInPandas(keys, "k int, value bigint, n bigint").groupBy("k", "value").agg(F.sum("n").alias("n"))
    squares = {k: s for k, s in shared.groupBy("k").agg(F.sum(F.col("n").cast("double") * F.col("n"))).collect()}
    chosen, least = [], float("inf")
    for m in ways:
        costs = []
        for k, (ways_of, _, bits) in enumerate(flat):
            if ways_of == m:
                pairs = squares.get(k, 0.0)
                costs.append([0.0] + [len(probes(len(bits), t)) * (n * 8.0 + pairs * 0.02) for t in range(3)])
        thresholds = allocate(costs, distance - m + 1)
        cost = sum(c[t + 1] for c, t in zip(costs, thresholds, strict=True))
        if cost < least:
            least, chosen = cost, [(bits, t) for bits, t in zip(arranged[m], thresholds, strict=True) if t >= 0]
    return chosen


def _forest(fp: np.ndarray, own: np.ndarray, other: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between members ``own`` and ``other`` (places in fp), met in slices."""
    fp = fp.view(np.uint64)  # the count of a negative number is that of its size
    up = list(range(len(fp)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for low in range(0, len(own), 256):
        part = own[low : low + 256]
        far = np.bitwise_count(fp[part][:, None] ^ fp[other][None, :])
        rows, cols = np.nonzero(far <= distance)
        keep = part[rows] != other[cols]
        for i, j in zip(part[rows[keep]].tolist(), other[cols[keep]].tolist()):
            a, b = root(i), root(j)
            if a != b:
                up[a] = b
                yield i, j


def links(nodes: DataFrame, plan: list[tuple[list[int], int]], distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges a, b between fingerprints, enough to connect all that link."""

    def signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64)
            for p, (bits, threshold) in enumerate(plan):
                value = _project(fp, bits)
                for mask in probes(len(bits), threshold):
                    yield pd.DataFrame({"part": p, "value": value ^ mask, "fp": fp, "probe": mask != 0})

    emitted = nodes.select("fp").mapInPandas(signatures, "part int, value bigint, fp bigint, probe boolean")
    # values that only one fingerprint, or only probes, have cannot hold a link
    sizes = emitted.groupBy("part", "value").agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("probe"), 0).otherwise(1)).alias("stored"))
    useful = sizes.where("size > 1 and stored > 0").select("part", "value", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    slot = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks"))).cast("int")
    dealt = emitted.join(useful, ["part", "value"]).select("part", "value", "fp", "probe", "blocks", slot.alias("slot"))
    # a value of many blocks is met as pairs of blocks: each row goes to every pair its own block is in
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("slot")).alias("x"), F.greatest(x, F.col("slot")).alias("y")))
    met = dealt.select("part", "value", "fp", "probe", "slot", F.explode(pairs).alias("pair")).select("part", "value", "pair.x", "pair.y", "slot", "fp", "probe")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; a group is whole once the next one begins."""
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            table = pd.concat(held, ignore_index=True) if len(held) > 1 else frame
            key = table[["part", "value", "x", "y"]].to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if not len(change):
                held = [table]
                continue
            held = [table.iloc[change[-1] :]]
            yield from found(table.iloc[: change[-1]], [0, *change.tolist()])
        if held:
            table = pd.concat(held, ignore_index=True)
            yield from found(table, [0, len(table)])

    def found(table: pd.DataFrame, bounds: list[int]) -> Iterator[pd.DataFrame]:
        fp, probe = table["fp"].to_numpy(np.int64), table["probe"].to_numpy(bool)
        slot, x, y = table["slot"].to_numpy(), table["x"].to_numpy(), table["y"].to_numpy()
        a, b = [], []
        for low, high in zip(bounds, bounds[1:]):
            if high - low < 2:
                continue
            values, stored = fp[low:high], ~probe[low:high]
            if x[low] == y[low]:
                meetings = [(np.arange(high - low), np.flatnonzero(stored))]
            else:
                first = slot[low:high] == x[low]
                meetings = [(np.flatnonzero(first), np.flatnonzero(~first & stored))]
                if not stored.all():
                    meetings.append((np.flatnonzero(~first), np.flatnonzero(first & stored)))
            for own, other in meetings:
                for i, j in _forest(values, own, other, distance):
                    if values[i] != values[j]:
                        a.append(values[i])
                        b.append(values[j])
        if a:
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    group = ["part", "value", "x", "y"]
    spread = met.repartition(*group).sortWithinPartitions(*group)
    return spread.mapInPandas(verify, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach."""
    marked = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    edges = links(nodes, plan_partitions(nodes, distance), distance)
    roots = connected_components(edges)
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the smallest doc_id."""
    return keep_ids(docs, near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))
