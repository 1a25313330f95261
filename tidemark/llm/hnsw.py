"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Vectors are dealt to shards by the nearest of some centroids, fitted to a bounded sample; a shard's graph is kept as
flat arrays of neighbours, one array a level, and is built by insertion: every node is searched for in the graph so
far, level by level from the top, and linked to what is found, pruned to directions that differ; the links lead back
too. Queries go to the shards nearest to them, are searched there in lockstep, a beam each, and the shards' results
are merged. How many shards a query has to see depends on how the vectors lie, so it is measured: a sample of the
queries is answered by brute force over all vectors, and as many shards are taken as hold ``COVER`` of the answers.

Each vector is shuffled once to its shard, each query once for each shard it sees. A graph is written where it was
built, as a file of its own in the checkpoint folder, and tasks open it there for up to ``BLOCK`` queries at a time, so
graphs are never shuffled, however many queries there are. Tasks reach the folder through Arrow's file systems. A cell of more than ``SHARD_ROWS`` vectors is several shards, all of which its queries see.
Vectors that lie about centroids need few shards at any number of them; vectors without any such order need most.

Equal vectors are one node with the smallest ids of its copies, as many as a result can show, so a vector that
a third of all rows share costs no more than another. Vectors that are null, zero, or hold null or non-finite
components take no part. Rows repeated with the same id count once for each. Vectors meet only vectors of the
same length. Of neighbours that are equally near the smaller id comes first. An empty table gives an empty result; of columns
only those named are read, so others may have any name.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs, parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import arrow_batches, checkpoint, scratch
from tidemark.operators.storage import small, written

#: Vectors of a shard at most (on average), least and most cells, queries that are searched together in a shard.
SHARD_ROWS, LEAST_CELLS, MOST_CELLS, BLOCK = 8192, 12, 1024, 4096
#: Vectors (on average) that the centroids are fitted to, rounds of fitting, queries that are answered by brute force,
#: and the share of their answers that the shards a query sees have to hold.
SAMPLE_ROWS, ROUNDS, PROBED, COVER = 16_384, 10, 256, 0.98
#: Links of a node a level (as many again come back to it on the lowest), pool they are pruned from, beam width.
LINKS, POOL, BEAM = 16, 64, 128
#: Nodes from which a search of the lower levels begins, first nodes of a level, nodes inserted together.
ENTRIES, FIRST, BATCH = 32, 256, 512


def _diverse(unit: np.ndarray, me: np.ndarray, pool: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 where there is none) up to ``links``: those that are nearer to the
    row's own vector than to any chosen before; what that leaves free goes to the best that were passed over."""
    m, width = pool.shape
    chosen = np.full((m, links), -1, np.int32)
    count = np.zeros(m, np.int64)
    taken = np.zeros((m, width), bool)
    there = pool >= 0
    close = np.einsum("mpd,md->mp", unit[pool], me)
    nearest = np.full((m, width), -np.inf, np.float32)  # of each candidate to those chosen so far
    every = np.arange(m)
    for p in range(width):
        take = there[:, p] & (count < links) & (nearest[:, p] < close[:, p])
        at = every[take]
        if not len(at):
            continue
        chosen[at, count[at]] = pool[at, p]
        count[at] += 1
        taken[at, p] = True
        if p + 1 < width:
            near = np.einsum("mpd,md->mp", unit[pool[at, p + 1 :]], unit[pool[at, p]])
            nearest[at, p + 1 :] = np.maximum(nearest[at, p + 1 :], near)
    left = there & ~taken
    place = count[:, None] + np.cumsum(left, axis=1) - 1
    rows, cols = np.nonzero(left & (place < links))
    chosen[rows, place[rows, cols]] = pool[rows, cols]
    return chosen


def _beam(vectors: np.ndarray, table: np.ndarray, queries: np.ndarray, begin: np.ndarray, beam: int, stride: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search over ``table`` of all queries in lockstep: places and products, best first, -1 where fewer.

    ``begin`` holds each query's first places. In a step each query opens its ``stride`` best that are not open yet;
    it ends when the whole beam has been opened.
    """
    n, q = len(table), len(queries)
    beam = min(beam, n)
    seen = np.zeros((q, n + 1), bool)  # the last column stands for -1
    ids, score, open_ = np.full((q, beam), -1, np.int32), np.full((q, beam), -np.inf, np.float32), np.zeros((q, beam), bool)
    live, around = np.arange(q), begin.astype(np.int32)
    while True:
        around = np.sort(around, axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
        around = np.where(seen[live[:, None], around], -1, around)
        seen[live[:, None], around] = True
        seen[:, -1] = False
        near = np.einsum("qmd,qd->qm", vectors[around], queries[live])
        near[around < 0] = -np.inf
        all_ids = np.concatenate([ids[live], around], axis=1)
        all_score = np.concatenate([score[live], near], axis=1)
        all_open = np.concatenate([open_[live], around >= 0], axis=1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam] if all_ids.shape[1] > beam else np.broadcast_to(np.arange(all_ids.shape[1]), all_ids.shape)[:, :beam]
        ids[live], score[live], open_[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_score, best, 1), np.take_along_axis(all_open, best, 1)
        going = open_[live].any(axis=1)
        live = live[going]
        if not len(live):
            break
        rank = np.where(open_[live], score[live], -np.inf)
        step = min(stride, beam)
        pick = np.argpartition(-rank, step - 1, axis=1)[:, :step]
        is_open = np.take_along_axis(open_[live], pick, 1)
        open_[live[:, None], pick] = False
        around = np.where(is_open[:, :, None], table[np.where(is_open, ids[live[:, None], pick], 0)], -1).reshape(len(live), -1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _best(products: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of each row, in no order."""
    return np.argpartition(-products, k - 1, axis=1)[:, :k] if products.shape[1] > k else np.broadcast_to(np.arange(products.shape[1]), products.shape)


def _link_back(unit: np.ndarray, table: np.ndarray, low: int, chosen: np.ndarray) -> None:
    """Links from those chosen to the nodes low, low + 1, ... that chose them; a full row is pruned anew."""
    width = table.shape[1]
    rows, cols = np.nonzero(chosen >= 0)
    to, new = chosen[rows, cols], (low + rows).astype(np.int32)
    near = np.einsum("nd,nd->n", unit[to], unit[new])
    order = np.lexsort((-near, to))
    to, new = to[order], new[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
    keep = rank < width  # the nearest of those that come at once
    to, new, rank = to[keep], new[keep], rank[keep]
    nodes = np.unique(to)
    row = np.searchsorted(nodes, to)
    both = np.full((len(nodes), 2 * width), -1, np.int32)
    both[:, :width] = table[nodes]
    both[row, width + rank] = new
    for at in range(0, len(nodes), 1024):
        part, own = both[at : at + 1024], nodes[at : at + 1024]
        close = np.einsum("mpd,md->mp", unit[part], unit[own])
        close[part < 0] = -np.inf
        part = np.take_along_axis(part, np.argsort(-close, axis=1, kind="stable"), 1)
        full = part[:, width] >= 0 if part.shape[1] > width else np.zeros(len(part), bool)
        table[own[~full]] = part[~full, :width]
        if full.any():
            table[own[full]] = _diverse(unit, unit[own[full]], part[full], width)


def _insert(vectors: np.ndarray, unit: np.ndarray, begin: np.ndarray, links: int, width: int) -> np.ndarray:
    """One level's table of neighbours, its nodes inserted in order, in batches no larger than what stands already.

    A node is searched for in the graph so far, from the places that the level above gives (``begin``) and from the
    nearest of the first nodes; what is found, and its batch, are pruned to its links, which also lead back.
    """
    n = len(vectors)
    table = np.full((n, width), -1, np.int32)
    low, first = 0, min(n, FIRST)
    while low < n:
        high = min(n, low + min(max(low, first), BATCH))
        mine = vectors[low:high]
        inside = mine @ mine.T
        inside[np.arange(high - low), np.arange(high - low)] = -np.inf
        near = _best(inside, min(POOL, high - low))
        pool, score = (near + low).astype(np.int32), np.take_along_axis(inside, near, 1)
        if low:
            start = _best(mine @ vectors[:first].T, 8).astype(np.int32)
            given = begin[low:high]
            ids, found = _beam(vectors[:low], table[:low], mine, np.concatenate([start, np.where(given < low, given, -1)], axis=1), POOL)
            pool, score = np.concatenate([pool, ids], axis=1), np.concatenate([score, found], axis=1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :POOL]
        pool, score = np.take_along_axis(pool, order, 1), np.take_along_axis(score, order, 1)
        chosen = _diverse(unit, unit[low:high], np.where(score == -np.inf, -1, pool), links)
        table[low:high, :links] = chosen
        _link_back(unit, table, low, chosen)
        low = high
    return table


def _parts(table: np.ndarray) -> np.ndarray:
    """For each node the smallest node that it is linked with, over any number of links in either direction."""
    a, rank = np.nonzero(table >= 0)
    b = table[a, rank]
    part = np.arange(len(table))
    while True:
        new = part.copy()
        np.minimum.at(new, a, part[b])
        np.minimum.at(new, b, part[a])
        new = new[new]
        if (new == part).all():
            return part
        part = new


def _join_parts(vectors: np.ndarray, table: np.ndarray) -> None:
    """Link parts of the graph that nothing leads between, each by its first node to the nearest first nodes outside."""
    while len(firsts := np.unique(part := _parts(table))) > 1:
        some = np.union1d(firsts, np.arange(min(len(table), FIRST)))
        for a in firsts[1:].tolist():
            others = some[part[some] != a]
            b = int(others[np.argmax(vectors[others] @ vectors[a])])
            for x, y in ((a, b), (b, a)):
                free = np.flatnonzero(table[x] < 0)
                table[x, free[0] if len(free) else -1] = y


def build_graph(vectors: np.ndarray, links: int = LINKS, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order in which vectors are to be kept, and the levels' tables of neighbours from the lowest up.

    Each vector draws a height; they are kept tallest first, so a level's nodes are the first of them. Levels are
    built from the top: on each, every node is inserted by a search that begins where the level above has led it.
    """
    n = len(vectors)
    height = np.random.default_rng(seed).geometric(1 - 1 / links, n) - 1
    order = np.argsort(-height, kind="stable")
    vectors = vectors[order]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    sizes = [int((height >= level).sum()) for level in range(int(height.max(initial=0)) + 1)]
    tables: list[np.ndarray] = []
    for level, size in reversed(list(enumerate(sizes))):
        begin = np.concatenate([_descend(vectors, tables, vectors[at : at + BATCH], 8)[0] for at in range(0, size, BATCH)]) if tables else np.empty((size, 0), np.int32)
        table = _insert(vectors[:size], unit[:size], begin, links, links * (2 if level == 0 else 1))
        _join_parts(vectors[:size], table)
        tables.insert(0, table)
    return order, tables


def _descend(vectors: np.ndarray, tables: list[np.ndarray], queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Search from the top level down, each level beginning where the one above ended; places and products."""
    top = min(len(tables[-1]), FIRST)
    found = _best(queries @ vectors[:top].T, ENTRIES).astype(np.int32)
    for level in range(len(tables) - 1, -1, -1):
        found, score = _beam(vectors[: len(tables[level])], tables[level], queries, found, beam if level == 0 else ENTRIES)
    return found, score


def search_graph(vectors: np.ndarray, tables: list[np.ndarray], queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """Places of up to ``k`` nearest for each query, best first, -1 where there are fewer."""
    found, score = _descend(vectors, tables, queries, max(beam, k))
    return np.where(score == -np.inf, -1, found)[:, :k]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & some).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Each distinct vector with the smallest k + 1 ids of its copies."""
    w = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Directions in single precision; a vector too long or short for that is brought to size first."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _single(vectors: np.ndarray, axis: int | None = None) -> np.ndarray:
    """In single precision, scaled together (or each by itself along ``axis``) so that the largest component is one:
    the order of products stays as it is."""
    return (vectors / np.abs(vectors).max(axis=axis, keepdims=True)).astype(np.float32)


def centroids(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Mean directions of ``cells`` groups of the sample."""
    unit = np.unique(_unit(sample), axis=0)
    c = unit[np.random.default_rng(seed).permutation(len(unit))[:cells]]
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(unit[at : at + 4096] @ c.T, axis=1) for at in range(0, len(unit), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def _by_length(vectors: pd.Series, answer: Callable[[int, np.ndarray], list]) -> pd.Series:
    """``answer(length, directions)`` for vectors of one length at a time, put back in their order."""
    out = pd.Series([None] * len(vectors), dtype=object)
    lengths = vectors.map(len)
    for d in lengths.unique():
        at = np.flatnonzero(lengths == d)
        for i, x in zip(at, answer(int(d), _unit(np.stack(vectors.iloc[at].to_list())))):
            out.iat[i] = x
    return out


def cell_of(router: dict[int, np.ndarray], v: str = "v") -> Column:
    """The cell of each vector: its nearest centroid, of those for its length."""

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        return _by_length(vectors, lambda d, u: np.argmax(u @ router[d].T, axis=1).tolist() if d in router else [0] * len(u)).astype("int32")

    return cell(v)


def ranked(router: dict[int, np.ndarray], d: int, unit: np.ndarray) -> np.ndarray:
    """Cells from the nearest to the furthest."""
    return np.argsort(-(unit @ router[d].T), axis=1, kind="stable") if d in router else np.zeros((len(unit), 1), np.int64)


def cells_of(router: dict[int, np.ndarray], probes: dict[int, int], v: str = "v") -> Column:
    """The cells that each query sees."""

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        return _by_length(vectors, lambda d, u: ranked(router, d, u)[:, : probes.get(d)].tolist())

    return cells(v)


def fit_router(rows: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors, from ``sample_rows`` vectors on average."""
    counts = {d: n for d, n in rows.groupBy(F.size("v")).count().collect()}
    part = min(1.0, sample_rows / max(sum(counts.values()), 1))
    picked = rows.where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1_000_000)) < int(part * 1_000_000)).select("v").distinct()
    by_length: dict[int, list] = {}
    for (v,) in picked.collect():
        by_length.setdefault(len(v), []).append(v)
    return {d: centroids(np.array(vs, np.float64), cells or min(MOST_CELLS, max(LEAST_CELLS, -(-counts[d] // SHARD_ROWS)))) for d, vs in by_length.items()}


def shards_to_see(placed: DataFrame, query_vectors: DataFrame, router: dict[int, np.ndarray], k: int, cover: float = COVER) -> dict[int, int]:
    """For each length, how many cells hold ``cover`` of the answers of ``PROBED`` queries, found by brute force."""
    some = query_vectors.orderBy(F.xxhash64("asked_id"), "asked_id").limit(PROBED).collect()
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["v"]) for r in some}:
        mine = [r for r in some if len(r["v"]) == d]
        by_length[d] = np.array([r["asked_id"] for r in mine]), np.array([r["v"] for r in mine], np.float64)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of each query within a task."""
        held = pd.DataFrame({"asked_id": np.empty(0, np.int64), "cell": np.empty(0, np.int32), "score": np.empty(0)})
        for frame in frames:
            lengths = frame["v"].map(len)
            for d, (ids, q) in by_length.items():
                mine = frame[lengths == d]
                if len(mine):
                    product = q @ np.stack(mine["v"].to_list()).T
                    # the query itself, where no other row shares its vector
                    first, alone = mine["first_id"].to_numpy(), mine["copies"].to_numpy() == 1
                    product[(ids[:, None] == first[None, :]) & alone[None, :]] = -np.inf
                    at = _best(product, k)
                    score = np.take_along_axis(product, at, 1)
                    new = pd.DataFrame({"asked_id": np.repeat(ids, at.shape[1]), "cell": mine["cell"].to_numpy()[at].ravel(), "score": score.ravel()})
                    both = pd.concat([held, new[new["score"] > -np.inf]]).sort_values(["asked_id", "score"], ascending=[True, False])
                    held = both.groupby("asked_id", sort=False).head(k)
        yield held

    each = placed.select("v", "cell", F.element_at("ids", 1).alias("first_id"), F.size("ids").alias("copies")).mapInPandas(best, "asked_id bigint, cell int, score double")
    order = Window.partitionBy("asked_id").orderBy(F.desc("score"), "cell")
    answers = each.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("asked_id", "cell").collect()
    found: dict[int, list[int]] = {}
    for r in answers:
        found.setdefault(r["asked_id"], []).append(r["cell"])
    probes = {}
    for d, (ids, q) in by_length.items():
        order_of = np.argsort(ranked(router, d, _unit(q)), axis=1)
        ranks = np.array([order_of[i, c] for i, a in enumerate(ids.tolist()) for c in found.get(a, [])])
        if len(ranks):
            probes[d] = int(np.sort(ranks)[min(len(ranks), math.ceil(len(ranks) * cover)) - 1]) + 1
    return probes


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def shard_graphs(dealt: DataFrame, links: int = LINKS) -> DataFrame:
    """One row a shard (dim, cell, sub): its graph, flat arrays packed."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(frame["v"].to_list()).astype(np.float64)
        order, tables = build_graph(_single(vectors), links)
        ids = [frame["ids"].iat[i] for i in order.tolist()]
        packed = _pack(vectors=vectors[order], ids=np.concatenate(ids), ends=np.array([len(x) for x in ids], np.int64).cumsum(), **{f"level{i}": t for i, t in enumerate(tables)})
        return pd.DataFrame({"dim": [vectors.shape[1]], "cell": [frame["cell"].iat[0]], "sub": [frame["sub"].iat[0]], "graph": [packed]})

    return dealt.groupBy("dim", "cell", "sub").applyInPandas(build, "dim int, cell int, sub int, graph binary")


def written_graphs(graphs: DataFrame) -> DataFrame:
    """dim, cell, sub, path: each shard's graph as a file of its own, of one row. The table itself holds names only."""
    folder = scratch(graphs.sparkSession, "graphs")
    graphs.write.partitionBy("dim", "cell", "sub").parquet(folder)
    schema = "graph binary, dim int, cell int, sub int"
    return written(graphs.sparkSession.read.schema(schema).parquet(folder).select("dim", "cell", "sub", F.col("_metadata.file_path").alias("path")), "shards")


@lru_cache(maxsize=1)
def opened_graph(path: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Tables of neighbours, vectors, ids and their ends, of a shard's file. A task that meets a shard's blocks of
    queries one after the other opens it once."""
    path = re.sub("^file:/*", "/", path)
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(at) as file:
        graph = parquet.ParquetFile(file).read(columns=["graph"]).column(0)[0].as_py()
    with np.load(io.BytesIO(graph)) as packed:
        tables = [packed[f"level{i}"] for i in range(sum(name.startswith("level") for name in packed.files))]
        return tables, packed["vectors"], packed["ids"], packed["ends"]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, cells: int | None = None, beam: int = BEAM, cover: float = COVER, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by inner product of every row whose id is divisible by ``every``."""
    arrow_batches(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    router = fit_router(rows, cells)
    placed = checkpoint(distinct_vectors(rows, k).select("v", "ids", F.size("v").alias("dim"), cell_of(router).alias("cell")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    query_vectors = checkpoint(asked.groupBy("v").agg(F.min("vec_id").alias("asked_id")))
    probes = shards_to_see(placed, query_vectors, router, k, cover)
    # MOST_CELLS rows at most for each length of vectors
    splits = F.broadcast(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("subs")))
    sub = F.pmod(F.xxhash64("v"), F.col("subs")).cast("int").alias("sub")
    graphs = written_graphs(shard_graphs(placed.join(splits, ["dim", "cell"]).select("dim", "cell", sub, "v", "ids")))
    routed = query_vectors.select("asked_id", "v", F.size("v").alias("dim"), F.explode(cells_of(router, probes)).alias("cell"))
    blocks = F.broadcast(routed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    # a row for each shard, all of a cell's for each of its queries
    dealt = routed.join(blocks, ["dim", "cell"]).join(small(graphs), ["dim", "cell"]).select(
        "asked_id", "v", "path", F.pmod(F.xxhash64("asked_id"), F.col("blocks")).cast("int").alias("block")
    )

    def search(right: pd.DataFrame) -> pd.DataFrame:
        tables, exact, ids, ends = opened_graph(right["path"].iat[0])
        starts = np.concatenate([[0], ends[:-1]])
        coarse = _single(exact)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low in range(0, len(right), 256):
            part = right.iloc[low : low + 256]
            q = np.stack(part["v"].to_list()).astype(np.float64)
            found = search_graph(coarse, tables, _single(q, axis=1), k + 1, beam)
            score = np.einsum("qkd,qd->qk", exact[found], q)
            for query, places, scores in zip(part["asked_id"].tolist(), found, score, strict=True):
                ok = places >= 0
                places, scores = places[ok], scores[ok]
                count = ends[places] - starts[places]
                members = np.concatenate([ids[starts[p] : ends[p]] for p in places.tolist()])
                scores = np.repeat(scores, count)
                best = np.lexsort((members, -scores))[: k + 1]
                out.append((np.full(len(best), query), members[best], scores[best]))
        return pd.DataFrame({"asked_id": np.concatenate([x[0] for x in out]), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    found = dealt.groupBy("path", "block").applyInPandas(search, "asked_id bigint, vec_id bigint, score double")
    # a list for each distinct query vector holds (k + 1) entries for each shard it saw, before it is cut
    merged = found.groupBy("asked_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("found"))
    merged = merged.select("asked_id", F.slice("found", 1, k + 1).alias("found")).join(query_vectors, "asked_id").select("v", "found")
    answers = asked.join(merged, "v").select(F.col("vec_id").alias("query_id"), "found")
    own = answers.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("place", "hit")).select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")
