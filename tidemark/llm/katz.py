"""Language model scores by Katz backoff.

A token's probability after its context is its count discounted by Good-Turing, if the n-gram was seen; otherwise
the probability after the context without its first word, times the context's backoff weight: what the discounts left,
divided by what the shorter context gives to all tokens that were not seen after this one. So the probabilities of all known
tokens and of one unknown token add up to one after every context. Discounts apply to counts up to ``DISCOUNTED``; where
an estimate is undefined or not between 0 and 1, the discount of a count r is (r - 1/2) / r; a context without such
counts counts one occurrence more, which is left for what was not seen. What is left of single words goes to the unknown token.

Texts are split into blocks of some ``BLOCK_TOKENS`` tokens, a long text into pieces that know the words before them. A block
is one row: its words once each, its tokens as numbers. Order by order every block asks for its n-grams: it
sends each one, with its count in the block, to a bucket, which adds up the counts of all blocks and answers. An
n-gram is the number of its context, from the order below, and that of its last word. A bucket holds some ``BUCKET_KEYS`` asked n-grams,
those of a context together, as it gives the sums behind backoff weights too; a context of more than ``HOT`` occurrences is split over
several buckets by the last word, and a block asks all of them. Answers are tables in the checkpoint folder, partitioned by
bucket. So counts are summed up before they move, a frequent n-gram moves once a block, and no task holds more
than a block or a bucket.

Null and empty texts have the end token only. Texts of any length are scored whole. Rows with a null doc_id are scored
but not learned from; rows with a repeated doc_id are documents of their own and all learned from; equal texts get equal
scores. Of columns only those named are read, so others may have any name. An empty table gives an empty result; with nothing to
learn from, the unknown token has probability one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import PIECE, arrow_batches, remove, scratch, word_pieces

#: Words of an n-gram in the registered query; counts up to which Good-Turing discounts.
ORDER, DISCOUNTED = 2, 5
#: Tokens of a block, n-grams asked of a bucket, occurrences of a context that one bucket holds.
BLOCK_TOKENS, BUCKET_KEYS, HOT = 1 << 20, 1 << 20, 1 << 18
#: Tokens that are no words, as words have no white space; the first two numbers of every block's words.
BEGIN, END = b"\t", b"\n"
#: Bits of a row's number: a task's blocks and a block's texts. The rest is the task's.
BLOCK_BITS, TEXT_BITS = 18, 22
BLOCKS = "block bigint, tokens bigint, kinds bigint, begins bigint, body binary"
MESSAGES = "block bigint, level int, bucket int, body binary, sums array<bigint>"
SCORES = "line bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


# -- packing ------------------------------------------------------------------------------------------------
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; the first bytes of all numbers stand together, then the second ones, and so on."""
    import zstandard

    parts = []
    for a in arrays:
        parts += [struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)), np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(body: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, arrays = zstandard.decompress(body), 0, []
    planes_of = np.frombuffer(raw, np.uint8)
    while at < len(raw):
        kind, n = struct.unpack_from("<2sq", raw, at)
        size = np.dtype(kind.decode()).itemsize
        planes = planes_of[at + 10 : at + 10 + n * size].reshape(size, n)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind.decode()))
        at += 10 + n * size
    return arrays


def _bytes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(bytearray(b" ".join(words)), np.uint8)


def _bucket(keys: np.ndarray) -> np.ndarray:
    """A number of 31 bits for each key."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# -- blocks -------------------------------------------------------------------------------------------------
class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """Pieces of texts as they come, and the row that they make."""

    def __init__(self, name: int):
        self.name, self.numbers, self.texts, self.begins, self.size = name, _Numbers({BEGIN: 0, END: 1}), 0, 0, 0
        self.lines: list[int] = []
        self.ids: list[int] = []
        self.flags: list[int] = []
        self.sizes: list[int] = []
        self.leads: list[int] = []
        self.tokens: list[np.ndarray] = []

    def add(self, line: int, doc_id: int | None, flags: int, lead: list[bytes], words: list[bytes]) -> None:
        self.lines.append(line)
        self.ids.append(0 if doc_id is None else doc_id)
        self.flags.append(flags)
        self.sizes.append(len(lead) + len(words))
        self.leads.append(len(lead))
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, lead + words), np.int32, len(lead) + len(words)))
        self.size += len(words)

    def row(self) -> tuple:
        arrays = [np.array(x, np.int64) for x in (self.lines, self.ids, self.flags, self.sizes, self.leads)]
        return self.name, self.size, len(self.numbers), self.begins, pack(*arrays, np.concatenate(self.tokens), _bytes(list(self.numbers)[2:]))


def _blocks(docs: DataFrame, order: int, sizes: Sizes) -> DataFrame:
    """The texts of _id, _text, _held, _learn (0 or 1) as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("kinds", pa.int64()), ("begins", pa.int64()), ("body", pa.binary())])
        block = _Block(TaskContext.get().partitionId() << BLOCK_BITS)
        for batch in batches:
            for doc_id, text, held, learn in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                line = block.name << TEXT_BITS | block.texts
                block.texts += 1
                block.begins += learn
                flags = held | learn << 1 | (doc_id is None) << 2
                lead, words = [BEGIN], []
                for more in word_pieces(text, sizes.piece):
                    if words:
                        block.add(line, doc_id, flags, lead, words)
                        lead = (lead + words)[1 - order :] if order > 1 else []
                        if block.size >= sizes.block_tokens:
                            yield _table([block.row()], schema).to_batches()[0]
                            block = _Block(block.name + 1)
                    words = [w.lower() for w in more]
                block.add(line, doc_id, flags, lead, [*words, END])
                if block.size >= sizes.block_tokens:
                    yield _table([block.row()], schema).to_batches()[0]
                    block = _Block(block.name + 1)
        if block.size:
            yield _table([block.row()], schema).to_batches()[0]

    return docs.mapInArrow(run, BLOCKS)


# -- the model ----------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Sizes:
    """How the work is cut; results don't depend on it."""

    block_tokens: int = BLOCK_TOKENS
    bucket_keys: int = BUCKET_KEYS
    hot: int = HOT
    piece: int = PIECE


@dataclass(frozen=True)
class Order:
    """What is known of all n-grams of one order: how many stand once, twice, ... and the discounts by count."""

    buckets: int
    of_count: tuple[int, ...]  # n_1 to n_(DISCOUNTED + 1)
    kinds: int
    total: int

    @property
    def discounts(self) -> np.ndarray:
        n, k = self.of_count, DISCOUNTED
        found = []
        for r in range(1, k + 1):
            d = -1.0
            if n[0] and n[r - 1]:
                most = (k + 1) * n[k] / n[0]
                d = ((r + 1) * n[r] / n[r - 1] / r - most) / (1 - most) if most < 1 else -1.0
            found.append(d if 0 < d < 1 else (r - 0.5) / r)
        return np.array(found)


def discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    by_count = np.concatenate(([0.0], discounts, [1.0]))
    return counts * by_count[np.minimum(counts, DISCOUNTED + 1)]


def left_over(of_count: np.ndarray, total: np.ndarray, discounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By context: what its counts are divided by, and the share that the discounts leave. ``of_count`` has a column for each count."""
    plain = of_count.sum(1) == 0
    whole = total + plain
    left = of_count @ ((1 - discounts) * np.arange(1, DISCOUNTED + 1)) + plain
    return whole, left / whole




class Replay:
    """A block with what it was answered so far: for each token the probability by the highest order answered, and the
    number and the count of the n-gram that it ends (-1 and 0 where there is none)."""

    def __init__(self, body: bytes, orders: list[Order], answers: dict[tuple[int, int], bytes], begins: int, sizes: Sizes):
        self.lines, self.ids, self.flags, self.sizes, self.leads, self.tokens, words = unpack(body)
        self.words = [BEGIN, END, *words.tobytes().split()]
        starts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(self.tokens)) - np.repeat(starts, self.sizes)
        self.first = place == 0
        self.scored = place >= np.repeat(self.leads, self.sizes)
        self.learned = self.scored & np.repeat(self.flags >> 1 & 1 == 1, self.sizes)
        self.orders, self.begins, self.hot = orders, begins, sizes.hot
        for level in range(1, len(orders) + 1):
            own = [unpack(answers[level, b]) for b in range(orders[level - 1].buckets) if (level, b) in answers]
            merged = [np.concatenate(x) for x in zip(*own, strict=True)]
            if level == 1:
                self._words(orders[0], *merged)
            elif merged:
                self._ngrams(orders[level - 1], *merged)
            else:  # no token has a context that was seen
                self.ngram, self.count = np.full(len(self.tokens), -1), np.zeros(len(self.tokens), np.int64)

    def word_asks(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """By bucket, the numbers of the words that it is asked for."""
        import zlib

        at = np.fromiter(map(zlib.crc32, self.words[1:]), np.int64, len(self.words) - 1) % buckets
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        return [(int(at[own[0]]), own + 1) for own in np.split(order, cuts[1:])]

    def _words(self, order: Order, counts: np.ndarray, numbers: np.ndarray) -> None:
        asked = np.concatenate([own for _, own in self.word_asks(order.buckets)])
        self.word_count, self.word = np.zeros(len(self.words), np.int64), np.full(len(self.words), -1)
        self.word_count[asked], self.word[asked] = counts, numbers
        whole, left = left_over(np.array([order.of_count[:DISCOUNTED]]), np.array([order.total]), order.discounts)
        each = np.where(self.word_count > 0, discounted(self.word_count, order.discounts) / whole[0], left[0])
        self.word[0], context = 0, self.word_count.copy()
        context[0] = self.begins
        self.known = self.word_count[self.tokens] > 0
        self.p, self.ngram, self.count = each[self.tokens], self.word[self.tokens], context[self.tokens]

    def asks(self, buckets: int) -> dict:
        """The n-grams of the next order: contexts and n-grams, once each, as their buckets get them."""
        before = np.concatenate(([-1], self.ngram[:-1]))
        context = np.where(self.first, -1, before)
        at = np.flatnonzero(context >= 0)  # tokens after a context that was seen
        contexts, of = np.unique(context[at], return_inverse=True)
        seen = np.zeros(len(contexts), np.int64)
        seen[of] = self.count[at - 1]
        parts = np.minimum(-(-np.maximum(seen, 1) // self.hot), buckets)
        known = self.word[self.tokens[at]] >= 0
        pairs, pair = np.unique(of[known] * len(self.words) + self.tokens[at[known]], return_inverse=True)
        pair_context, pair_word = pairs // len(self.words), self.word[pairs % len(self.words)]
        low = np.zeros(len(pairs))
        low[pair] = self.p[at[known]]
        home = _bucket(contexts)
        pair_bucket = (home[pair_context] + _bucket(pair_word) % parts[pair_context]) % buckets
        # each context is asked for in each of its buckets
        spread = np.repeat(np.arange(len(contexts)), parts)
        nth = np.arange(len(spread)) - np.repeat(np.cumsum(parts) - parts, parts)
        context_bucket = (home[spread] + nth) % buckets
        by_context, by_pair = np.lexsort((spread, context_bucket)), np.argsort(pair_bucket, kind="stable")
        return {
            "at": at, "of": of, "known": known, "pair": pair, "contexts": contexts, "low": low, "weight": np.bincount(pair, self.learned[at[known]], len(pairs)).astype(np.int64),
            "pair_context": pair_context, "pair_word": pair_word, "pair_bucket": pair_bucket, "context_bucket": context_bucket, "spread": spread, "by_context": by_context, "by_pair": by_pair,
        }

    def messages(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """For each bucket: its contexts, how many n-grams each has, and their words, counts and lower probabilities."""
        a = self.asks(buckets)
        places = a["pair_context"][a["by_pair"]]
        context_at, pair_at = a["context_bucket"][a["by_context"]], a["pair_bucket"][a["by_pair"]]
        for b in np.unique(context_at):
            contexts = a["spread"][a["by_context"][slice(*np.searchsorted(context_at, (b, b + 1)))]]
            cut = slice(*np.searchsorted(pair_at, (b, b + 1)))
            own = a["by_pair"][cut]
            each = np.bincount(np.searchsorted(contexts, places[cut]), minlength=len(contexts))
            lows, low = np.unique(a["low"][own], return_inverse=True)
            yield int(b), pack(np.diff(a["contexts"][contexts], prepend=0), each.astype(np.int32), a["pair_word"][own], a["weight"][own].astype(np.int32), np.diff(lows.view(np.int64), prepend=0), low.astype(np.int32))

    def _ngrams(self, order: Order, of_count: np.ndarray, more: np.ndarray, lower: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> None:
        a = self.asks(order.buckets)
        spread, n = a["spread"][a["by_context"]], len(a["contexts"])
        table = np.stack([np.bincount(spread, x, n) for x in of_count.reshape(-1, DISCOUNTED).T], 1) if len(spread) else np.zeros((0, DISCOUNTED))
        total = table @ np.arange(1, DISCOUNTED + 1) + np.bincount(spread, more, n)
        whole, left = left_over(table, total, order.discounts)
        backoff = np.where(total > 0, left / (1 - np.bincount(spread, lower, n)), 1.0)
        count, number = np.zeros(len(counts), np.int64), np.full(len(counts), -1)
        count[a["by_pair"]] = counts
        if len(numbers):
            number[a["by_pair"]] = numbers
        at, of = a["at"], a["of"]
        found = np.zeros(len(at), np.int64)
        found[a["known"]] = count[a["pair"]]
        name = np.full(len(at), -1)
        name[a["known"]] = np.where(count > 0, number, -1)[a["pair"]]
        p = np.where(found > 0, discounted(found, order.discounts) / whole[of], backoff[of] * self.p[at])
        self.p[at] = p
        self.ngram, self.count = np.full(len(self.tokens), -1), np.zeros(len(self.tokens), np.int64)
        self.ngram[at], self.count[at] = name, found

    def scores(self) -> list[np.ndarray]:
        """For each piece: its line, id, flags, tokens, known tokens, base and score."""
        order = self.orders[0]
        base = np.log10((self.word_count[self.tokens] + 0.5) / (order.total + 0.5 * (order.kinds + 1)))
        starts = np.cumsum(self.sizes) - self.sizes
        add = lambda x: np.add.reduceat(np.where(self.scored, x, 0), starts)
        return [self.lines, self.ids, self.flags, add(1), add(self.known), add(base), add(np.log10(self.p))]


# -- buckets ------------------------------------------------------------------------------------------------
def _sums(totals: np.ndarray) -> list[int]:
    """n_1 to n_(DISCOUNTED + 1), kinds and the sum of the counts of a bucket."""
    return [*(int(np.count_nonzero(totals == r)) for r in range(1, DISCOUNTED + 2)), int(np.count_nonzero(totals)), int(totals.sum())]


def _count_words(bodies: list[bytes], bucket: int, buckets: int, last: bool) -> tuple[list[bytes], list[int]]:
    asked = [unpack(x) for x in bodies]
    lists = [pa.array([END if w == b"" else w for w in words.tobytes().split(b" ")], pa.binary()) for words, _ in asked]
    coded = pa.chunked_array(lists).combine_chunks().dictionary_encode()
    of = coded.indices.to_numpy()
    totals = np.bincount(of, np.concatenate([w for _, w in asked]), len(coded.dictionary)).astype(np.int64)
    rank = np.empty(len(totals), np.int64)
    rank[np.argsort(-totals, kind="stable")] = np.arange(len(totals))  # frequent words get small numbers, which pack better
    numbers = np.where(totals > 0, 1 + bucket + buckets * rank, -1)
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return [pack(t.astype(np.int64), n) for t, n in zip(np.split(totals[of], cuts), np.split(numbers[of], cuts), strict=True)], _sums(totals)


def _count_ngrams(bodies: list[bytes], bucket: int, buckets: int, last: bool) -> tuple[list[bytes], list[int]]:
    """The last order's n-grams are no contexts, so they get no numbers."""
    asked = [unpack(x) for x in bodies]
    contexts = [np.cumsum(x[0]) for x in asked]
    kinds, of = np.unique(np.concatenate(contexts), return_inverse=True)
    words, word = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
    context = np.repeat(of, np.concatenate([x[1] for x in asked]))
    pairs, pair = np.unique(context * max(len(words), 1) + word, return_inverse=True)
    totals = np.bincount(pair, np.concatenate([x[3] for x in asked]), len(pairs)).astype(np.int64)
    low = np.zeros(len(pairs))
    low[pair] = np.concatenate([np.cumsum(x[4]).view(np.float64)[x[5]] for x in asked])
    owner, n = pairs // max(len(words), 1), len(kinds)
    of_count = np.stack([np.bincount(owner[totals == r], minlength=n) for r in range(1, DISCOUNTED + 1)], 1).astype(np.int32)
    often = totals > DISCOUNTED
    more = np.bincount(owner[often], totals[often], n).astype(np.int64)
    lower = np.bincount(owner[totals > 0], low[totals > 0], n)
    numbers = np.where(totals > 0, bucket + buckets * np.arange(len(totals)), -1)
    answers, c, p = [], 0, 0
    for x in asked:
        own, mine = of[c : c + len(x[0])], pair[p : p + len(x[2])]
        c, p = c + len(x[0]), p + len(x[2])
        answers.append(pack(of_count[own].reshape(-1), more[own], lower[own], totals[mine].astype(np.int32), numbers[mine[:0] if last else mine]))
    return answers, _sums(totals)


# -- jobs ---------------------------------------------------------------------------------------------------
def _asked(asks: DataFrame, level: int, buckets: int, last: bool) -> DataFrame:
    """The answers to messages: one for each, and one row of a bucket's sums."""
    count = _count_words if level == 1 else _count_ngrams

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        answers, sums = count(group["body"].to_pylist(), bucket, buckets, last)
        rows = [(b, level, bucket, body, None) for b, body in zip(group["block"].to_pylist(), answers, strict=True)]
        return _table([*rows, (-1, level, bucket, None, sums)], _messages())

    return asks.groupBy("bucket").applyInArrow(run, MESSAGES)


def _messages() -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary()), ("sums", pa.list_(pa.int64()))])


def _replay(blocks: pa.Table, answers: pa.Table, orders: list[Order], begins: int, sizes: Sizes) -> Replay:
    got = {(k, b): body for k, b, body in zip(*(answers[c].to_pylist() for c in ("level", "bucket", "body")), strict=True)}
    return Replay(blocks["body"][0].as_py(), orders, got, begins, sizes)


def score(docs: DataFrame, held_out: Column, order: int = ORDER, sizes: Sizes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    The model learns from the rows for which ``held_out`` is false; null counts as neither held out nor learned from.
    """
    spark, sizes = docs.sparkSession, sizes or Sizes()
    arrow_batches(spark)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    picked = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), flag(held_out).alias("_held"), flag(~held_out).alias("_learn"))
    folder = scratch(spark, "katz")
    _blocks(picked, order, sizes).write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    tokens, kinds, begins = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds", "begins")]).first()
    orders: list[Order] = []
    answers = spark.createDataFrame([], MESSAGES)
    for level in range(1, order + 1):
        buckets = max(1, -(-(kinds if level == 1 else tokens) // sizes.bucket_keys))
        _asked(_asks(blocks, answers, level, buckets, list(orders), begins, sizes), level, buckets, level == order).write.parquet(f"{folder}/answers-{level}")
        found = spark.read.schema(MESSAGES).parquet(*[f"{folder}/answers-{k}" for k in range(1, level + 1)])
        sums = found.where((F.col("block") == -1) & (F.col("level") == level)).agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(DISCOUNTED + 3)]).first()
        orders.append(Order(buckets, tuple(sums[: DISCOUNTED + 1]), sums[-2], sums[-1]))
        answers = found.where("block >= 0").select("block", "level", "bucket", "body")
    return _scored(spark, folder, blocks, answers, orders, begins, sizes)


def _asks(blocks: DataFrame, answers: DataFrame, level: int, buckets: int, orders: list[Order], begins: int, sizes: Sizes) -> DataFrame:
    if level == 1:

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    block = Replay(body, [], {}, begins, sizes)
                    weight = np.bincount(block.tokens, block.learned, len(block.words)).astype(np.int64)
                    rows = [(name, 1, b, pack(_bytes([b"" if w == END else w for w in map(block.words.__getitem__, own.tolist())]), weight[own]), None) for b, own in block.word_asks(buckets)]
                    yield _table(rows, _messages()).combine_chunks().to_batches()[0]

        return blocks.select("block", "body").mapInArrow(ask, MESSAGES)

    def ask_more(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _replay(left, right, orders, begins, sizes)
        name = left["block"][0].as_py()
        return _table([(name, level, b, body, None) for b, body in block.messages(buckets)], _messages())

    return blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask_more, MESSAGES)


def _scored(spark: SparkSession, folder: str, blocks: DataFrame, answers: DataFrame, orders: list[Order], begins: int, sizes: Sizes) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lines, ids, flags, n, known, base, total = _replay(left, right, orders, begins, sizes).scores()
        columns = [pa.array(lines), pa.array(ids, mask=flags >> 2 & 1 == 1), pa.array(flags & 1 == 1), pa.array(n), pa.array(known), pa.array(base), pa.array(total)]
        return pa.Table.from_arrays(columns, ["line", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    pieces = blocks.select("block", "body").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES)
    whole = pieces.groupBy("line", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    out = scratch(spark, "katz-scores")
    whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(orders[0].total).cast("bigint").alias("train_tokens"), "base_score", "score").write.parquet(out)
    remove(spark, folder)
    return spark.read.parquet(out)
