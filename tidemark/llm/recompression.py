"""Periodic runs of words by recompression.

The words of many texts are numbered and laid end to end, each text closed by a symbol of its own. Recompression
makes a grammar of that sequence: a level of blocks turns every stretch of one repeated symbol into one symbol, a
level of pairs splits the alphabet in two and joins each left symbol with the right one that follows it, and so on until
one symbol is left. Which symbols are joined depends on these symbols alone, so equal stretches of words are
compressed alike but for a symbol or a stretch at their ends. How far two places agree (an LCE query) is therefore
read off the grammar: one symbol a level on the way up, as long as symbols are equal, one a level on the way down.
Levels shrink by a constant factor, so the grammar takes linear time and room; all queries of a round are
answered together in numpy.

A run of period q and length of at least max(LEAST_LENGTH, LEAST_POWER * q) has length - q words in a row that equal
the word q places on. So it holds a point of the grid of that spacing, and the pairs (i, i + q) over all grids, a harmonic
sum, are the candidates. Those whose words differ are none; for the others LCE queries forward and backward give the
exact extent. An extent found for several periods is a run of the smallest, as the others are its multiples.

Null and empty texts have no words and no runs. Texts of any length are read whole: their words are numbered in
pieces, so only the numbers and the different words are held. Rows with a null or a repeated doc_id are rows like
others; of columns only the two named are read, so others may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, word_pieces

#: A run's least length in words and in periods.
LEAST_LENGTH, LEAST_POWER = 24, 3
#: Candidate pairs looked at together, words of texts that share a grammar.
PAIRS_AT_ONCE, GRAMMAR_WORDS = 1 << 20, 1 << 19
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


# -- grammar ------------------------------------------------------------------------------------------------
def _named(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """A number from ``first`` on for each different key; the next free number."""
    kinds, names = np.unique(keys, return_inverse=True)
    return names.astype(np.int64) + first, first + len(kinds)


def _is_left(symbols: np.ndarray, level: int) -> np.ndarray:
    """The side of the alphabet that a symbol is on at a level: a bit of a multiplicative hash."""
    mixed = (symbols.astype(np.uint64) + np.uint64(level * 7919 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(61)) & np.uint64(1) == 1


class Grammar:
    """Levels of symbols over a sequence; ``lce`` answers how far two places agree, forward or backward.

    ``symbols[h]`` is level h; a symbol's parent in level h + 1 is ``parent[h]``, the first of its children ``child[h + 1]``. The
    sequence has to begin and end with symbols that are found nowhere else.
    """

    def __init__(self, sequence: np.ndarray):
        self.symbols, self.parent, self.child = [sequence.astype(np.int64)], [], [np.zeros(0, np.int32)]
        names = int(sequence.max()) + 1
        while len(self.symbols[-1]) > 1:
            level, s = len(self.parent), self.symbols[-1]
            if level % 2:  # pairs
                left = _is_left(s, level)
                joined = np.concatenate(([False], left[:-1] & ~left[1:]))
            else:  # blocks
                joined = np.concatenate(([False], s[1:] == s[:-1]))
            starts = np.flatnonzero(~joined)
            sizes = np.diff(np.append(starts, len(s)))
            new = s[starts]
            longer = np.flatnonzero(sizes > 1)
            if len(longer):
                second = s[starts[longer] + 1] if level % 2 else sizes[longer]
                low = int(second.max()) + 1
                if (int(new.max()) + 1) * low < 1 << 62:
                    keys = new[longer] * low + second
                else:
                    keys = np.unique(new[longer], return_inverse=True)[1].astype(np.int64) * low + second
                new[longer], names = _named(keys, names)
            self.parent.append((np.cumsum(~joined) - 1).astype(np.int32))
            self.child.append(np.append(starts, len(s)).astype(np.int32))
            self.symbols.append(new)

    def _left_in_block(self, level: int, at: np.ndarray, forward: bool) -> np.ndarray:
        """Symbols of the block from ``at`` on, itself included, in the direction of reading."""
        block = self.parent[level][at]
        return self.child[level + 1][block + 1] - at if forward else at - self.child[level + 1][block] + 1

    def _at_edge(self, level: int, at: np.ndarray, forward: bool) -> np.ndarray:
        block = self.parent[level][at]
        return self.child[level + 1][block] == at if forward else self.child[level + 1][block + 1] - 1 == at

    def _over_equal(self, level: int, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols agree within the blocks of a and b, which begin with the same symbol."""
        if level % 2:
            return np.ones(len(a), np.int32)
        return np.minimum(self._left_in_block(level, a, forward), self._left_in_block(level, b, forward))

    def lce(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """Words that agree from i and j on (with i < j); backward: those that end at i and j."""
        step = 1 if forward else -1
        a, b, of = i.astype(np.int32), j.astype(np.int32), np.arange(len(i))
        differ: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by level: where two symbols differ
        for level, symbols in enumerate(self.symbols):
            same = symbols[a] == symbols[b]
            out = [(of[~same], a[~same], b[~same])]
            a, b, of = a[same], b[same], of[same]
            if len(a) and level < len(self.parent):
                inside = np.flatnonzero(~(self._at_edge(level, a, forward) & self._at_edge(level, b, forward)))
                if len(inside):
                    x, y = a[inside], b[inside]
                    count = self._over_equal(level, x, y, forward)
                    # blocks of one symbol that are left at different lengths: what follows the shorter one differs
                    even = np.ones(len(x), bool) if level % 2 else self._left_in_block(level, x, forward) == self._left_in_block(level, y, forward)
                    a[inside], b[inside] = x + step * count, y + step * count
                    on = np.ones(len(a), bool)
                    on[inside] = even
                    out.append((of[~on], a[~on], b[~on]))
                    a, b, of = a[on], b[on], of[on]
                a, b = self.parent[level][a], self.parent[level][b]
            differ.append(tuple(np.concatenate(x) for x in zip(*out, strict=True)))
            if not len(a):
                break
        of, a, b = differ.pop()
        while differ:
            level = len(differ) - 1
            first, last = self.child[level + 1], self.child[level + 1]
            a, b = (first[a], first[b]) if forward else (last[a + 1] - 1, last[b + 1] - 1)
            same = np.flatnonzero(self.symbols[level][a] == self.symbols[level][b])
            if len(same):
                count = step * self._over_equal(level, a[same], b[same], forward)
                a[same] += count
                b[same] += count
            of, a, b = (np.concatenate(x) for x in zip((of, a, b), differ.pop(), strict=True))
        found = np.empty(len(i), np.int64)
        found[of] = np.abs(a - i[of])
        return found


# -- runs ---------------------------------------------------------------------------------------------------
def _grids(offsets: np.ndarray, sizes: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q) of the harmonic grids, some PAIRS_AT_ONCE at a time. Texts stand in the order of their sizes, so those that are
    long enough for a period are the last ones."""
    top = int(sizes[-1]) // LEAST_POWER
    low = 1
    while low <= top:
        periods = np.arange(low, min(top, low + (1 << 16) - 1) + 1, dtype=np.int64)
        spacing = np.maximum(LEAST_LENGTH - periods, (LEAST_POWER - 1) * periods)
        begins = offsets[np.searchsorted(sizes, np.maximum(LEAST_LENGTH, LEAST_POWER * periods))]
        points = -(-(end - begins) // spacing)
        held = np.cumsum(points)
        last = max(1, int(np.searchsorted(held, PAIRS_AT_ONCE, "right")))
        periods, spacing, begins, points = (x[:last] for x in (periods, spacing, begins, points))
        q = np.repeat(periods, points)
        number = np.arange(len(q)) - np.repeat(np.cumsum(points) - points, points)
        for at in range(0, len(q), PAIRS_AT_ONCE):  # the points of one period may be more
            cut = slice(at, at + PAIRS_AT_ONCE)
            yield np.repeat(begins, points)[cut] + number[cut] * np.repeat(spacing, points)[cut], q[cut]
        low += last


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, given as numbers of its words (equal numbers for equal words within all texts), its runs as
    rows of start, length and period, in the order of starts and periods."""
    none = np.zeros((0, 3), np.int64)
    found: list[np.ndarray] = [none] * len(texts)
    order = [k for k in sorted(range(len(texts)), key=lambda k: len(texts[k])) if len(texts[k]) >= LEAST_LENGTH]
    if not order:
        return found
    sizes = np.array([len(texts[k]) for k in order])
    free = max(int(texts[k].max()) for k in order) + 1
    parts = [np.array([free])]
    for place, k in enumerate(order):
        parts += [texts[k], np.array([free + place + 1])]
    sequence = np.concatenate(parts)
    offsets = np.cumsum(sizes + 1) - sizes
    of_text = np.repeat(np.arange(len(order)), sizes + 1)
    grammar = Grammar(sequence)
    extents = [none]
    for i, q in _grids(offsets, sizes, len(sequence)):
        inside = i + q < len(sequence)
        i, q = i[inside], q[inside]
        like = sequence[i] == sequence[i + q]
        i, q = i[like], q[like]
        ahead = grammar.lce(i, i + q)
        back = grammar.lce(i, i + q, forward=False)
        enough = ahead + back - 1 + q >= np.maximum(LEAST_LENGTH, LEAST_POWER * q)
        i, q, ahead, back = (x[enough] for x in (i, q, ahead, back))
        start = i - back + 1
        extents.append(np.unique(np.stack([start, i + q + ahead - start, q], 1), axis=0))
    rows = np.concatenate(extents)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))) if len(rows) else np.zeros(0, bool)
    rows = rows[smallest]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = of_text[rows[:, 0] - 1]
    for place in np.unique(owner):
        own = rows[owner == place]
        own[:, 0] -= offsets[place]
        found[order[place]] = own
    return found


# -- texts --------------------------------------------------------------------------------------------------
class Words:
    """Words and their numbers, shared by the texts of one grammar."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.listed: list[bytes] = []

    def of(self, text: str) -> np.ndarray:
        parts = []
        for words in word_pieces(text):
            for word in dict.fromkeys(words):
                if word not in self.numbers:
                    self.numbers[word] = len(self.listed)
                    self.listed.append(word)
            parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def text(self, numbers: np.ndarray) -> str:
        return b" ".join(map(self.listed.__getitem__, numbers.tolist())).decode()


def kept_words(numbers: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Without the words that a run repeats: of each run only its first period stays, unless another run drops it."""
    if not len(runs):
        return numbers
    dropped = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    return numbers[np.cumsum(dropped)[:-1] == 0]


def periodic_runs(docs: DataFrame, alter: Callable[[int | None, np.ndarray], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words) and the text with every run collapsed to its first period.

    ``alter(doc_id, numbers)`` may replace the word numbers of a text before it is searched.
    """
    arrow_batches(docs.sparkSession)
    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema

    def shared(ids: list, texts: list) -> Iterator[tuple[list, list, Words]]:
        """Texts in groups of some GRAMMAR_WORDS words."""
        names, numbers, words, held = [], [], Words(), 0
        for name, text in zip(ids, texts, strict=True):
            own = words.of(text)
            names.append(name)
            numbers.append(own if alter is None else alter(name, own))
            held += len(own)
            if held >= GRAMMAR_WORDS:
                yield names, numbers, words
                names, numbers, words, held = [], [], Words(), 0
        if names:
            yield names, numbers, words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for names, numbers, words in shared(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = runs_of(numbers)
                counts = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                flat = np.concatenate(found)
                runs = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
                columns = [pa.array(names, pa.int64()), pa.array([len(x) for x in numbers], pa.int64()), runs, pa.array([words.text(kept_words(x, r)) for x, r in zip(numbers, found, strict=True)])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    picked = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return picked.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """n_runs, the run of the greatest exact power (ties: smallest start, then period) and digests of runs and text."""

    def stronger(best: Column, x: Column) -> Column:
        # runs come in the order of starts and periods, so only a greater power replaces the best
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    kind = "struct<start: bigint, length: bigint, period: bigint>"
    best = F.aggregate("runs", F.lit(None).cast(kind), stronger)
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string"))), "\n")
    listing = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listing.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def planted_period(doc_id: int | None, numbers: np.ndarray) -> np.ndarray:
    """What the registered query does to every tenth document: from a place on, its words repeat with a period."""
    import zlib

    n = len(numbers)
    if doc_id is None or not n:
        return numbers
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return numbers
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([numbers[:a], numbers[a + np.arange(n - a) % period]])
