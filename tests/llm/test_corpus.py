"""Duplicates, mixing, neighbours, classifiers and the pipeline against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixtures as X
from tidemark.llm import bpe_codec, chunk_dedup, components, hnsw, pfair, queries, simhash, site_quality, toxic_segments


# -- SimHash ------------------------------------------------------------------------------------------------
def plain_fingerprint(text, k=3):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps: list[tuple[int, int]], distance=3):
    """Smallest id reachable, for (id, fingerprint) rows."""
    values = sorted({f for _, f in fps})
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    arr = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= distance).tolist():
            up[root(v)] = root(values[j])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [(i, f, least.get(root(f))) for i, f in fps]


def test_near_duplicates_equal_brute_force(spark):
    for docs in (X.documents(spark), X.odd(spark), X.clashing(spark)):
        rows = [(r["doc_id"], plain_fingerprint(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
        want = sorted(((str(i), f"{f:016x}", c) for i, f, c in plain_components(rows)))
        assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(X.nothing(spark)).count() == 0


@pytest.mark.parametrize("ways", [(2,), (3,), (4,), (5,)])
@pytest.mark.parametrize("block", [7, 2048])
def test_links_lose_nothing(spark, ways, block):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = []
    for c in centres.tolist():
        for _ in range(25):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            values.append(int(c) ^ sum(1 << int(b) for b in flips))
    values = sorted(set(values))
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp bigint")
    plan = simhash.plan_partitions(nodes, 3, ways)
    assert sum(t for _, t in plan) - (max(ways) - len(plan)) == 3 - ways[0] + 1
    edges = simhash.links(nodes, plan, 3, block)
    roots = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    got = defaultdict(set)
    for v in values:
        s = int(np.uint64(v).astype(np.int64))
        got[roots.get(s, s)].add(v)
    want = defaultdict(set)
    for i, _, c in plain_components([(v, v) for v in values]):
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_by_dynamic_programming():
    costs = [[0.0, 1.0, 9.0], [0.0, 5.0, 6.0], [0.0, 1.0, 9.0]]
    best = simhash.allocate(costs, 0)
    assert sum(best) == 0
    every = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a + b + c == 0]
    assert sum(costs[i][t + 1] for i, t in enumerate(best)) == min(sum(costs[i][t + 1] for i, t in enumerate(x)) for x in every)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and all(got[100 + i] == 100 for i in range(1, 50))
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- exact duplicates -----------------------------------------------------------------------------------------
def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    out, seen = [], set()
    for i, t in sorted(rows, key=str):
        t = t or ""
        kept = i == keep[t] and (i, t) not in seen
        seen.add((i, t))
        out.append((str(i), keep[t], len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_exact_duplicates_equal_brute_force(spark):
    for docs in (X.documents(spark), X.odd(spark), X.clashing(spark)):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = chunk_dedup.exact_duplicates(docs).collect()
        assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == plain_groups(rows)
        left = chunk_dedup.drop_duplicates(docs)
        assert left.columns == docs.columns
        assert left.count() == len({t or "" for _, t in rows}) == left.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert chunk_dedup.exact_duplicates(X.nothing(spark)).count() == 0
    hot = spark.createDataFrame([(7, "the same row", "x")] * 500 + [(8, "the same row", "y"), (9, "another", "z")], "doc_id bigint, text string, source string").repartition(8)
    assert sorted((r["doc_id"], r["source"]) for r in chunk_dedup.drop_duplicates(hot).collect()) == [(8, "y"), (9, "z")]
    hot = hot.where("doc_id <> 8")
    assert sorted((r["doc_id"], r["source"]) for r in chunk_dedup.drop_duplicates(hot).collect()) == [(7, "x"), (9, "z")]
    assert chunk_dedup.drop_duplicates(X.nothing(spark)).count() == 0


def test_chunks_are_defined_by_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 60_000, dtype=np.uint8)
    shifted = np.concatenate([rng.integers(97, 123, 333, dtype=np.uint8), body])

    def chunks(data):
        ends = chunk_dedup.chunk_ends(chunk_dedup.cut_places(data), 0, len(data))
        assert ends[-1] == len(data) and all(0 < b - a <= chunk_dedup.LARGEST for a, b in zip([0, *ends], ends))
        return [bytes(data[a:b]) for a, b in zip([0, *ends], ends)]

    a, b = chunks(body), chunks(shifted)
    assert b"".join(a) == bytes(body) and len(set(a) & set(b)) > 0.8 * len(a)


def test_colliding_short_hashes_are_told_apart(spark):
    chunk = lambda short, digest: {"short": short, "digest": digest, "bytes": 3}
    rows = [(1, "s1", [chunk(5, b"a"), chunk(6, b"x")]), (2, "s2", [chunk(5, b"b"), chunk(6, b"x")]), (3, "s1", [chunk(5, b"a"), chunk(6, b"x")])]
    df = spark.createDataFrame(rows, "doc_id bigint, text_sha256 string, chunks array<struct<short: bigint, digest: binary, bytes: int>>")
    got = {r["doc_id"]: tuple(r["recipe"]) for r in chunk_dedup.recipes(df).collect()}
    assert got[1] == got[3] != got[2] and len(got[1]) == 2


# -- mixing ---------------------------------------------------------------------------------------------------
def plain_schedule(parts, blocks):
    """Earliest deadline first among the released, slot by slot, by exact fractions: (source, k, slot)."""
    w = [Fraction(p, sum(parts)) for p in parts]
    done, run, t = [0] * len(parts), [], 0
    while any(d < b for d, b in zip(done, blocks)):
        ready = [(math.ceil((done[i] + 1) / w[i]), i) for i in range(len(w)) if done[i] < blocks[i] and math.floor(done[i] / w[i]) <= t]
        if ready:
            deadline, i = min(ready)
            assert t < deadline
            done[i] += 1
            run.append((i, done[i], t))
        t += 1
    return run


@pytest.mark.parametrize("sizes", [[("a", 500), ("b", 90), ("c", 33), (None, 7), ("d", 1)], [("a", 8)], [(f"s{i}", 1 + i * i) for i in range(40)]])
def test_schedule_equals_the_plain_one(spark, sizes):
    shares = pfair.weighed(spark.createDataFrame(sizes, "source string, n bigint"), block_rows=3)
    own = sorted(shares.collect(), key=lambda r: r["i"])
    assert [r["source"] for r in own] == sorted((s for s, _ in sizes), key=lambda s: (s is not None, s or ""))
    assert all(r["part"] == round(r["n"] ** 0.7 / sum(n**0.7 for _, n in sizes) * pfair.PARTS) and r["blocks"] == -(-r["n"] // 3) for r in own)
    got = sorted(((r["i"], r["k"], r["slot"]) for r in pfair.schedule(shares).collect()), key=lambda x: x[2])
    assert got == plain_schedule([r["part"] for r in own], [r["blocks"] for r in own])


def test_less_than_a_block_from_the_weights_as_given(spark):
    weights = {"a": 0.66626, "b": 0.33334, "c": 0.0004}
    sizes = spark.createDataFrame([("a", 20_000), ("b", 10_008), ("c", 12)], "source string, n bigint")
    shares = pfair.weighed(sizes, weights, block_rows=1)
    name = {r["i"]: r["source"] for r in shares.collect()}
    jobs = pfair.schedule(shares).orderBy("slot").collect()
    count, held = Counter(), jobs[0]["horizon"]
    assert held > 29_000
    for t, r in enumerate(jobs[:held], 1):
        assert r["slot"] == t - 1
        count[name[r["i"]]] += 1
        assert all(abs(count[s] - w * t) < 1 for s, w in weights.items())


def test_mix_keeps_every_row_and_its_proportions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    weights = {"hot": 0.5, "s0": 0.2, "s1": 0.1, "s2": 0.1, "s3": 0.05}
    rows = pfair.mix(docs, weights, block_rows=4).orderBy("_position").collect()
    assert len(rows) == 3000 and len({r["_position"] for r in rows}) == 3000
    assert all(r["_release"] <= r["_slot"] < r["_deadline"] for r in rows)
    share = {r["source"]: Fraction(r["part"], r["whole"]) for r in pfair.weighed(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), weights).collect()}
    assert share["hot"] / share["s0"] == pytest.approx(2.5, abs=1e-6) and share[None] == share["s3"]
    blocks = defaultdict(set)
    for r in rows:
        if r["_in_proportion"]:
            blocks[r["_slot"]].add(r["source"])
    assert sorted(blocks) == list(range(len(blocks))) and len(blocks) > 100
    count = Counter()
    for t in range(len(blocks)):
        (source,) = blocks[t]
        count[source] += 1
        assert all(abs(count[s] - share[s] * (t + 1)) < 1 for s in share)


def test_large_tables_have_larger_blocks(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    rows = pfair.mix(docs, slots=20, block_rows=8).collect()
    assert len({r["_slot"] for r in rows}) <= 23 and len({r["_position"] for r in rows}) == 1000
    assert max(Counter(r["_slot"] for r in rows).values()) == 50


def test_order_of_the_mix_is_read_back(spark, tmp_path):
    docs = X.documents(spark)
    path = str(tmp_path / "mixed")
    pfair.mixed_documents(docs).write.option("maxRecordsPerFile", 17).parquet(path)
    want = [r["doc_id"] for r in pfair.mix(docs).orderBy("_position").collect()]
    got = pfair.written_position(spark.read.parquet(path), "place").orderBy("place").collect()
    assert [r["doc_id"] for r in got] == want and [r["place"] for r in got] == list(range(len(want)))


def test_mix_of_odd_rows(spark):
    for docs in (X.odd(spark), X.clashing(spark)):
        out = pfair.mixed_documents(docs)
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty() and out.count() == docs.count()
    assert pfair.mix(X.nothing(spark)).count() == 0
    plan = queries.op8_mixing(spark, X.SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


# -- nearest neighbours ---------------------------------------------------------------------------------------
def plain_nearest(ids, v, k, every):
    out = {}
    for a, i in enumerate(ids):
        if i % every == 0:
            s = np.array([math.fsum(x * y for x, y in zip(v[a], w)) for w in v])
            order = sorted((b for b in range(len(ids)) if ids[b] != i), key=lambda b: (-s[b], ids[b]))[:k]
            out[i] = [(ids[b], s[b]) for b in order]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet(f"{X.SMALL}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    want = plain_nearest([r["vec_id"] for r in rows], [[float(x) for x in r["embedding"]] for r in rows], 20, 20)
    got = defaultdict(list)
    for r in queries.op9_nearest(spark, X.SMALL).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        exact = dict(plain_nearest([r["vec_id"] for r in rows], [list(map(float, r["embedding"])) for r in rows], 10**6, 10**9).get(q, [])) or None
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == 20
        assert exact is None or all(abs(exact[i] - s) < 1e-12 for i, s in found)


def test_vectors_that_take_no_part_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(0, 90)] + [(100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [1.0, None]), (180, [inf, 1.0]), (200, [])]
    rows += [(300 + i, [5.0, 5.0]) for i in range(100)] + [(500, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit(1)).withColumn("shard", F.lit("x"))
    got = defaultdict(list)
    for r in hnsw.nearest(df, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    good = [(i, v) for i, v in rows if v and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = plain_nearest([i for i, _ in good], [v for _, v in good], 5, 20)
    assert dict(got) == {q: [i for i, _ in found] for q, found in want.items()}
    assert hnsw.nearest(df.limit(0)).count() == 0


def test_graphs_stay_where_they_were_built(spark):
    n = 2_000
    v, _ = clusters(n, 8, 20, 0.4, seed=4)
    df = spark.createDataFrame(list(zip(range(n), v.astype(float).tolist())), "vec_id bigint, embedding array<double>")
    rows = hnsw.usable(df, "vec_id", "embedding")
    dealt = hnsw.distinct_vectors(rows, 5).select("v", "ids", F.size("v").alias("dim"), F.lit(0).alias("cell"), F.pmod(F.xxhash64("v"), F.lit(3)).cast("int").alias("sub"))
    shards = hnsw.written_graphs(hnsw.shard_graphs(dealt)).collect()
    assert sorted((r["dim"], r["cell"], r["sub"]) for r in shards) == [(8, 0, 0), (8, 0, 1), (8, 0, 2)]
    ids = [i for r in shards for i in hnsw.opened_graph(r["path"])[2].tolist()]
    assert sorted(ids) == list(range(n))
    block, hnsw.BLOCK = hnsw.BLOCK, 7  # many blocks of queries a shard change nothing
    try:
        many = sorted(map(tuple, hnsw.nearest(df, k=5).collect()))
    finally:
        hnsw.BLOCK = block
    found = hnsw.nearest(df, k=5)
    assert sorted(map(tuple, found.collect())) == many and len(many) == 5 * n // 20
    plan = found._jdf.queryExecution().toString()
    assert "graph" not in plan.replace("graphs-", "")  # no graph moves with the queries


@pytest.mark.parametrize("size", [1e-100, 1e150])
def test_vectors_beyond_single_precision(spark, size):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 6)) * size
    df = spark.createDataFrame(list(zip(range(200), v.tolist())), "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in hnsw.nearest(df, k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = plain_nearest(list(range(200)), (v / size).tolist(), 5, 20)
    assert sum(len({i for i, _ in want[q]} & set(got[q])) for q in want) >= 0.9 * 5 * len(want)


def clusters(n, d, groups, spread, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    v = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32), rng


@pytest.mark.parametrize(("n", "groups", "spread"), [(3000, 40, 0.4), (hnsw.SHARD_ROWS, 200, 0.06), (hnsw.SHARD_ROWS, 1, 9.0), (1, 1, 1.0), (2, 1, 1.0), (300, 3, 0.0)])
def test_graph_by_insertion(n, groups, spread):
    v, rng = clusters(n, 32, groups, spread)
    v = np.unique(v, axis=0)
    n = len(v)
    order, tables = hnsw.build_graph(v)
    assert sorted(order.tolist()) == list(range(n)) and tables[0].shape == (n, 2 * hnsw.LINKS)
    assert all((t < len(t)).all() and len(set(hnsw._parts(t).tolist())) == 1 for t in tables)
    assert all(len(a) >= len(b) for a, b in zip(tables, tables[1:]))
    q = v[rng.choice(n, min(n, 256), replace=False)]
    found = hnsw.search_graph(v[order], tables, q, 21)
    got = np.where(found >= 0, order[found], -1)
    true = np.argsort(-(q @ v.T), axis=1)[:, :21]
    recall = [len(set(a) & set(b)) / len(b) for a, b in zip(got.tolist(), true.tolist(), strict=True)]
    assert np.mean(recall) > 0.95 and min(recall) > 0.6


def test_insertion_takes_less_than_all_pairs():
    v, _ = clusters(4000, 16, 30, 0.5)
    seen = 0

    before = hnsw._beam

    def counted(vectors, table, queries, begin, beam, stride=4):
        nonlocal seen
        seen += len(queries)
        return before(vectors, table, queries, begin, beam, stride)

    hnsw._beam = counted
    try:
        hnsw.build_graph(v)
    finally:
        hnsw._beam = before
    assert seen >= 4000 - hnsw.FIRST  # every node but the first batch is searched for


def test_recall_of_fifty_thousand_vectors_that_see_few_shards(spark):
    n = 51_200
    v, _ = clusters(n, 24, 300, 0.5, seed=8)
    df = spark.createDataFrame(list(zip(range(n), v.astype(float).tolist())), "vec_id bigint, embedding array<double>")
    placed, seen = hnsw.shards_to_see, {}

    def noted(*args):
        seen.update(placed(*args))
        return seen

    hnsw.shards_to_see = noted
    try:
        got = hnsw.nearest(df, every=100).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect()
    finally:
        hnsw.shards_to_see = placed
    assert len(got) == 512 and seen[24] < hnsw.LEAST_CELLS / 2  # some thousand vectors a shard, and most shards are left alone
    hits = 0
    for r in got:
        s = v @ v[r["query_id"]]
        s[r["query_id"]] = -np.inf
        hits += len(set(np.argpartition(-s, 20)[:20].tolist()) & set(r["found"]))
    assert hits >= 0.95 * 20 * len(got)


# -- toxicity -------------------------------------------------------------------------------------------------
def plain_segments(scores):
    """All maximal scoring segments by their definition: the best segment, then the same on either side of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    s, _, _, i, j = best
    return [*plain_segments(scores[:i]), (i, j, s), *[(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]]


def test_segments_equal_their_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(0, 14))
        hits = [(i, float(rng.integers(-3, 6)) + 0.37) for i in range(n) if rng.random() < 0.5]
        weights = dict(hits)
        scores = [weights.get(i, -0.9) for i in range(n)]
        got = sorted((a, b, round(s, 6)) for a, b, s in toxic_segments.segments(hits, n, 0.9))
        assert got == sorted((a, b, round(s, 6)) for a, b, s in plain_segments(scores))


def test_segments_take_time_in_proportion_to_hits():
    rng = np.random.default_rng(5)

    def lines(n, gap):
        hits = [(i * gap, 3.0 + w) for i, w in enumerate(rng.random(n).tolist())]
        found, run = X.lines_run(lambda: toxic_segments.segments(hits, n * gap))
        assert (len(found) == n) == (gap == 300)
        return run

    for gap in (10, 300):
        assert lines(20_000, gap) < 2.2 * lines(10_000, gap)


def toxic_corpus(spark, n=1200):
    rng = np.random.default_rng(1)
    clean, bad = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)], ["vile", "rotten", "nasty", "awful"]
    rows, marks = [], []
    for i in range(n):
        words = rng.choice(clean, 80).tolist()
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(int(rng.integers(30, 40)), str(rng.choice(bad)))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), X.labels(spark, marks)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus(spark)
    rows = toxic_segments.toxicity(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) == (r["score"] >= 0.7) for r in held)
    assert all(bool(r["passages"]) == (r["doc_id"] % 5 == 0) for r in held)


def test_toxicity_of_the_given_rows_comes_from_segments(spark):
    folder = X.SMALL.replace("0.001", "0.1")
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxic_segments.toxicity(docs, marks).where("held_out").join(marks, "doc_id").where("toxic is not null").select("predicted", "toxic", "passages", "score").collect()
    found = [r for r in rows if r["predicted"]]
    assert sum(r["toxic"] for r in found) >= 130 and sum(1 - r["toxic"] for r in found) <= 2
    assert all(r["passages"] for r in found)  # nothing is toxic without a significant segment


def test_evidence_knows_of_segments_only():
    # the listed tokens of a text that no segment holds, and their number, don't enter its score
    model = toxic_segments.Model({"vile": 3.0, "mild": -2.0}, 1.0, 0.01, (-3.0, 1.0, 1.0, 1.0))
    text = "vile " * 3 + "plain " * 400
    assert toxic_segments.score_text(text, model) == toxic_segments.score_text(text.replace("plain", "mild"), model)
    assert toxic_segments.evidence([], 10, 1.0, 0.01) == [1.0, 0.0, 0.0, 0.0]


def plain_toxicity(rows, marks):
    """Weights, tail, scores and passages by plain loops over (doc_id, text) rows and {doc_id: label}."""
    learned = {}
    for i, text in rows:
        if i in marks and zlib.crc32(str(i).encode()) % 3 != 1:
            learned[text] = max(learned.get(text, 0), marks[i])
    n1, n0 = sum(learned.values()), len(learned) - sum(learned.values())
    toxic, both = Counter(), Counter()
    for text, y in learned.items():
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        for t in words | {w[:n] + "*" for w in words for n in (7, 5) if len(w) > n}:
            both[t] += 1
            toxic[t] += y
    weights = {}
    for t in both:
        a, b = toxic[t], both[t] - toxic[t]
        prior = 500.0 * both[t] / (n0 + n1) / 10
        if a >= 8 and a < n1 + 50:
            w = math.log((a + prior) / (n1 + 50 - a)) - math.log((b + prior) / (n0 + 50 - b))
            if w >= 1 and w / math.sqrt(1 / (a + prior) + 1 / (b + prior)) >= 3:
                weights[t] = w

    def weight(w):
        return next((weights[t] for t in [w] + [w[:n] + "*" for n in (7, 5) if len(w) > n] if t in weights), None)

    def scanned(text):
        found = [weight(w) for w in re.findall(r"[^\W\d_]+", text.lower())]
        return found, plain_segments([-0.03 if w is None else w for w in found]) if any(found) else []

    best = [(max((s for _, _, s in scanned(t)[1]), default=0.0), len(scanned(t)[0])) for t, y in learned.items() if y == 0]
    tail = [s for s, _ in best if s > 0]
    low = min(tail, default=0.0)
    spread = sum(tail) / len(tail) - low if tail else 1.0
    rate = 1 / spread if spread > 1e-9 else 1 / low
    k = max(len(tail), 1) / max(sum(n for _, n in best), 1) * math.exp(min(rate * low, 50.0))

    def evidence(text):
        found, parts = scanned(text)
        n = len(found)
        rare = [(-math.log10(max(1 - math.exp(-k * max(n, 1) * math.exp(-rate * s)), 1e-300)), a, b) for a, b, s in parts]
        strong = [(r, a, b) for r, a, b in rare if r >= -math.log10(0.05)]
        x = [1, math.sqrt(min(max((r for r, _, _ in rare), default=0), 30)), math.log1p(sum(r for r, _, _ in strong)), math.log1p(sum(b - a for _, a, b in strong))]
        return x, [(a, b) for _, a, b in strong]

    x = np.array([evidence(t)[0] for t in learned])
    y = np.array([float(v) for v in learned.values()])
    return weights, rate, k, x, y, evidence


def test_toxicity_equals_brute_force(spark):
    docs, labels = toxic_corpus(spark, 420)
    rows, marks = [(r["doc_id"], r["text"]) for r in docs.collect()], {r["doc_id"]: r["toxic"] for r in labels.collect()}
    # clean texts with a toxic word each, for the tail; a text under both labels
    rows += [(2000 + i, f"{t} vile") for i, (_, t) in enumerate(rows[1:60:5])] + [(3000, rows[0][1])]
    marks |= {2000 + i: 0 for i in range(12)} | {3000: 0}
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), X.labels(spark, [(i, 1, y) for i, y in marks.items()])
    model = toxic_segments.train(docs, labels)
    weights, rate, k, x, y, evidence = plain_toxicity(rows, marks)
    assert model.weights == pytest.approx(weights) and len(weights) >= 4
    assert (model.rate, model.k) == pytest.approx((rate, k))
    # the coefficients are those at which the penalised likelihood has no slope
    w = np.array(model.coefficients)
    penalty = np.array([1e-6] + [1.0] * (x.shape[1] - 1))
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))) - penalty * w).max() < 1e-3
    for r in toxic_segments.toxicity(docs, labels, model).collect():
        e, strong = evidence(dict(rows)[r["doc_id"]])
        score = 1 / (1 + math.exp(-max(min(float(np.dot(e, w)), 30), -30)))
        assert r["score"] == pytest.approx(score, rel=1e-6) and r["predicted"] == int(r["score"] >= 0.7)
        assert sorted(r["passages"].split(",")) == (sorted(f"{a}:{b}" for a, b in strong) or [""])


def test_toxicity_learns_from_no_held_out_label(spark):
    docs, labels = toxic_corpus(spark, 300)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxic_segments.train(docs, labels) == toxic_segments.train(docs, flipped)


def test_toxicity_of_odd_rows(spark):
    docs, labels = toxic_corpus(spark, 300)
    model = toxic_segments.train(docs, labels)
    for odd in (X.odd(spark), X.clashing(spark)):
        rows = toxic_segments.toxicity(odd, labels, model).collect()
        assert len(rows) == len(X.ODD) and all(0 <= r["score"] < 0.7 for r in rows)
    assert toxic_segments.toxicity(X.nothing(spark), labels).count() == 0
    assert all(r["score"] == 0.5 for r in toxic_segments.toxicity(X.odd(spark), X.labels(spark)).collect())


def test_rows_of_one_id_are_numbered_apart(spark):
    """Half of the rows have one doc_id, a quarter has none; no task numbers more than a partition's share of them."""
    docs = spark.range(0, 4000, 1, 8).selectExpr("if(id % 2 = 0, 7, if(id % 4 = 1, null, id)) AS doc_id", "if(id % 10 < 7, 'a', null) AS source", "id AS row")
    mixed = pfair.mix(docs, heavy=100).collect()
    assert sorted(r["_position"] for r in mixed) == sorted(r["_position"] for r in pfair.mix(docs).collect())
    assert sorted(r["row"] for r in mixed) == list(range(4000)) and len({r["_position"] for r in mixed}) == 4000
    picked = docs.selectExpr("doc_id AS _id", "source AS _source", "spark_partition_id() AS _read", "md5(cast(coalesce(cast(doc_id AS string), '') AS binary)) AS _hash")
    held = pfair._ranged(picked, 100).groupBy("_source", "_range").count().collect()
    assert max(r["count"] for r in held) <= 4000 / 8 and len({r["_range"] for r in held}) > 100
    plain = {(r["doc_id"], r["source"]): r["_position"] for r in mixed if r["doc_id"] not in (7, None)}
    fine = {(r["doc_id"], r["source"]): r["_position"] for r in pfair.mix(docs.where("doc_id <> 7"), heavy=1).collect()}
    whole = {(r["doc_id"], r["source"]): r["_position"] for r in pfair.mix(docs.where("doc_id <> 7")).collect()}
    assert fine == whole and len(plain) == len(fine)  # finer ranges keep the order of the hashes


# -- quality --------------------------------------------------------------------------------------------------
def plain_quality(rows, model):
    """(evidence, host posterior, path posterior, score) of rows (text, host, path), by plain sums."""
    es = [float(site_quality.probabilities([t or ""], model)[0]) for t, _, _ in rows]
    mean, n = sum(es) / len(es), len(es)
    by_host, by_path = defaultdict(list), defaultdict(list)
    for e, (_, h, p) in zip(es, rows):
        by_host[h].append(e)
        by_path[h, p].append(e)
    avg = {k: sum(g) / len(g) for k, g in [*by_host.items(), *by_path.items()]}
    inside = sum((e - avg[k]) ** 2 for k, g in by_path.items() for e in g) / (n - len(by_path)) if n > len(by_path) else 0.0

    def shrink(groups, parent, sizes):
        parents = {parent(k) for k in groups}
        spread = sum(len(g) * (avg[k] - (mean if parent(k) is None else avg[parent(k)[0]])) ** 2 for k, g in groups.items())
        lost = sum(len(g) ** 2 / sizes[parent(k)] for k, g in groups.items())
        if len(groups) <= len(parents) or n <= lost:
            return math.inf
        between = (spread - (len(groups) - len(parents)) * inside) / (n - lost)
        return inside / between if between > 0 else math.inf

    def post(e, g, k, prior):
        """Of the other documents of a site."""
        return prior if math.isinf(k) or len(g) - 1 + k == 0 else (sum(g) - e + k * prior) / (len(g) - 1 + k)

    ks = shrink(by_host, lambda h: None, {None: n})
    kp = shrink(by_path, lambda k: (k[0],), {(h,): len(g) for h, g in by_host.items()})

    def logit(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    found = []
    for e, (_, h, p) in zip(es, rows):
        host = post(e, by_host[h], ks, mean)
        path = post(e, by_path[h, p], kp, host)
        found.append((e, host, path, 1 / (1 + math.exp(-(logit(e) + logit(path) - logit(mean))))))
    return found


def test_quality_accuracy_and_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    even = site_quality.train(docs, labels.where("doc_id % 2 = 0"))
    # one source of bad texts only, and one of good ones, so that sites differ
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    bad = F.col("doc_id").isin([i for i, q in truth.items() if q == 0][:60])
    docs = docs.withColumn("source", F.when(bad, "rotten").otherwise(F.col("source")))
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = {r["doc_id"]: r for r in site_quality.quality(docs, labels, model=even).collect()}
    assert set(out) == set(rows)
    want = dict(zip(rows, plain_quality([(r["text"], r["source"], r["lang"]) for r in rows.values()], even)))
    for i, (e, h, p, s) in want.items():
        r = out[i]
        assert (r["evidence"], r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx((e, h, p, s), rel=1e-6)
        assert r["keep"] == (r["score"] >= 0.35)
    assert max(r["path_posterior"] for r in out.values() if r["host"] == "rotten") < 0.5 * min(r["path_posterior"] for r in out.values() if r["host"] != "rotten")
    held = [(out[i]["keep"], q) for i, q in truth.items() if i % 2 and i in out]
    assert sum(k == bool(q) for k, q in held) > 0.93 * len(held)
    assert sum(k for k, q in held if q) > 0.98 * sum(q for _, q in held)
    kept = site_quality.keep_good(docs, labels, model=even)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in out.items() if r["keep"])
    assert "SortMergeJoin" not in kept._jdf.queryExecution().toString()


def test_a_document_alone_at_its_site_says_nothing_twice(spark):
    docs, labels = X.documents(spark), spark.read.parquet(f"{X.SMALL}/labels.parquet")
    model = site_quality.train(docs, labels)
    alone = docs.withColumn("source", F.when(F.col("doc_id") == 5, "alone").otherwise(F.col("source")))
    out = {r["doc_id"]: r for r in site_quality.quality(alone, labels, model=model).collect()}
    mean = sum(r["evidence"] for r in out.values()) / len(out)
    assert out[5]["host_posterior"] == pytest.approx(mean) and out[5]["score"] == pytest.approx(out[5]["evidence"], abs=1e-5)


def test_sites_that_do_not_differ_are_pooled(spark):
    seen = spark.createDataFrame([(f"h{i % 5}", f"p{i % 2}", 0.2 + 0.1 * (i // 10 % 5)) for i in range(1000)], "host string, path string, evidence double")
    posteriors, overall, n = site_quality.site_posteriors(seen)
    rows = posteriors.collect()
    assert n == len(rows) == 10
    assert all(r["host_posterior"] == pytest.approx(overall) and r["path_posterior"] == pytest.approx(overall) for r in rows)


def test_quality_of_odd_rows(spark):
    for docs in (X.odd(spark), X.clashing(spark)):
        assert site_quality.quality(docs, X.labels(spark)).where("keep").count() == docs.count()
        kept = site_quality.keep_good(docs, X.labels(spark))
        assert kept.columns == docs.columns and kept.count() == docs.count()
    assert site_quality.quality(X.nothing(spark), X.labels(spark, [(1, 1, 0)])).count() == 0


# -- pipeline -------------------------------------------------------------------------------------------------
def test_pipeline_equals_brute_force(spark):
    docs = X.documents(spark)
    labels = spark.read.parquet(f"{X.SMALL}/labels.parquet")
    all_rows = docs.collect()
    judged = plain_quality([(r["text"], r["source"], r["lang"]) for r in all_rows], site_quality.train(docs, labels))
    rows = {r["doc_id"]: r["text"] or "" for r, (*_, score) in zip(all_rows, judged) if score >= site_quality.KEEP}
    assert len(rows) < len(all_rows)
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for t, i in last.items()}
    component = {i: c for i, _, c in plain_components([(i, plain_fingerprint(t)) for i, t in rows.items()])}
    rows = {i: t for i, t in rows.items() if component[i] == i}
    # the mix by hand: rows of a source by hash, in blocks of eight, in the slots of the plain schedule
    source = {r["doc_id"]: r["source"] for r in all_rows}
    by_source = defaultdict(list)
    for i in sorted(rows, key=lambda i: (hashlib.md5(f"{i}:17".encode()).hexdigest(), i)):
        by_source[source[i]].append(i)
    names = sorted(by_source)
    w = [len(by_source[s]) ** 0.7 for s in names]
    parts = [max(1, round(x / sum(w) * pfair.PARTS)) for x in w]
    order = []
    for s, k, _ in plain_schedule(parts, [-(-len(by_source[s]) // 8) for s in names]):
        order += by_source[names[s]][8 * (k - 1) : 8 * k]
    path, pattern = bpe_codec.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_codec.read_ranks(path), special_tokens={})
    got = corpus_pipeline.run(spark, X.SMALL).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(rows))) and [r["doc_id"] for r in got] == order
    for r in got:
        assert r["ids"] == library.encode_ordinary(rows[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_stages_bear_odd_rows(spark, tmp_path):
    X.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for n, docs in enumerate((X.odd(spark), X.clashing(spark), X.nothing(spark))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            assert k < len(corpus_pipeline.STAGES) - 1 or docs.inputFiles()
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
            assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
