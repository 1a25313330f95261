"""Spelling variants of words by pivotal grams.

Two words are near if they differ by one inserted, deleted or replaced code point. The bigrams of a word, ordered by how
many words have them (then by their letters and their places), begin with its rarest ones: the first three are its
prefix. Dynamic programming chooses two of the prefix that don't overlap and that are rarest together: its
pivots. An edit of one code point breaks one pivot at most. So of two near words, the one whose prefix ends earlier in
that order has a pivot that stands in the other's prefix, one place off at most (of bigrams equal to the last one of
a prefix, the next place belongs to it too). The edit lies after the first pivot, which then stands at the same place in
both words, or before the second one, which is moved by the difference of lengths. On the pivot's other side
the words agree to the end, and on the edit's side in one of its halves. So pivots are looked up in an index of prefixes by
equality of the place, the other word's length and the letters that have to agree, and candidates are verified by
their distance. Nothing is cut off: a frequent key is split like any skewed join.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that is at least
``RATIO`` times its own. As counts double from form to form, chains are short; roots are found by pointer jumping.

Null and empty texts have no words. Texts of any length are read whole, in pieces that end between words. Rows with a repeated doc_id are rows like others; a
null doc_id changes no word. Of columns only the two named are read, so others may have any name; an
empty table, or one without near words, gives an empty result or words without forms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, checkpoint

#: Words counted: code points and occurrences at least; how much more frequent a form is than its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Bigrams of a prefix for one edit, and pivots of a word.
PREFIX, PIVOTS = 3, 2
#: Different words that a task holds before it passes their counts on; characters looked at together.
HELD, PIECE = 200_000, 1 << 20
RUN = re.compile("[A-Za-zÀ-ÿ]+")


# -- words --------------------------------------------------------------------------------------------------
def _runs(text: str) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and RUN.match(text, end):
            end += 1
        yield RUN.findall(text, at, end)
        at = end


def deleted_letter(doc_id: int | None, word: str) -> str:
    """What the registered query does to every 97th word of a document: one of its letters goes."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % 97 else word[:at] + word[at + 1 :]


def words_of(doc_id: int | None, text: str, alter: Callable[[int | None, str], str] | None = None) -> Counter:
    """Words of a text and how often they stand in it; only A to Z are lower-cased."""
    found: Counter = Counter()
    for runs in _runs(text):
        for run, n in Counter(runs).items():
            word = run.encode().lower().decode()
            found[word if alter is None else alter(doc_id, word)] += n
    return found


def vocabulary(docs: DataFrame, alter: Callable[[int | None, str], str] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: all words of the texts that are long and frequent enough. Tasks count before they shuffle."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in words_of(name, text, alter).items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield counted()
        if held:
            yield counted()

    picked = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    counts = picked.mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- pivots -------------------------------------------------------------------------------------------------
def prefix_of(ranks: list[int]) -> tuple[list[int], int, int]:
    """Places of a word's prefix, given the ranks of its bigrams in the order of places, and where it ends: rank, place."""
    order = sorted(range(len(ranks)), key=lambda p: (ranks[p], p))[:PREFIX]
    rank, place = ranks[order[-1]], order[-1]
    if place + 1 < len(ranks) and ranks[place + 1] == rank:
        return [*order, place + 1], rank, place
    return order, rank, place


def pivots_of(places: list[int], cost: Callable[[int], int]) -> list[int]:
    """The PIVOTS places, no two of which overlap, of least cost together. best[k] is the cheapest choice of k among
    the places so far, before[k] that among those that the next place doesn't overlap."""
    places = sorted(places)
    states: list[list[tuple[int, list[int]] | None]] = [[(0, []), *[None] * PIVOTS]]  # after each place
    for i, place in enumerate(places):
        free = i
        while free and places[free - 1] > place - 2:
            free -= 1
        row = list(states[-1])
        for k in range(1, PIVOTS + 1):
            if (before := states[free][k - 1]) is not None:
                with_it = (before[0] + cost(place), [*before[1], place])
                if row[k] is None or with_it[0] < row[k][0]:
                    row[k] = with_it
        states.append(row)
    return states[-1][PIVOTS][1]


def _pivoted(words: DataFrame) -> DataFrame:
    """word, n, prefix and pivots (places), last: the end of the prefix as one number."""
    grams = words.select(F.explode(F.array_distinct(F.expr("transform(sequence(1, length(word) - 1), p -> substring(word, p, 2))"))).alias("gram"))
    # as many rows as pairs of letters: 90 * 90 with this alphabet, so the driver holds them
    counted = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {g: i for i, g in enumerate(sorted(counted, key=lambda g: (counted[g], g)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, pivots, last = [], [], []
            for word in batch.column(0).to_pylist():
                own = [word[p : p + 2] for p in range(len(word) - 1)]
                ranks = [rank[g] for g in own]
                places, end, place = prefix_of(ranks)
                prefixes.append(places)
                pivots.append(pivots_of(places[:PREFIX], lambda p, own=own: counted[own[p]]))
                last.append((end << 32) + place)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prefixes, pa.list_(pa.int32())), pa.array(pivots, pa.list_(pa.int32())), pa.array(last, pa.int64())], ["word", "n", "prefix", "pivots", "last"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, prefix array<int>, pivots array<int>, last bigint")


def _after(d: str) -> str:
    """SQL of the keys of a word whose edit lies after the bigram at p; the other word is d longer. What follows the bigram is
    cut in the middle of the longer word's: the edit lies in one half, so the beginning and the other half agree."""
    half = f"shiftright(length(word) + {d} - p - 2, 1)"
    return f"array(concat('a', length(word) + {d}, ' ', left(word, p + 2 + {half})), concat('b', length(word) + {d}, ' ', left(word, p + 2), ' ', right(word, length(word) + {d} - p - 2 - {half})))"


def _before(d: str) -> str:
    """As ``_after``, for an edit before the bigram: the end of the word agrees, and a half of what precedes the bigram."""
    half = f"shiftright(p + {d}, 1)"
    return f"array(concat('c', length(word) + {d}, ' ', right(word, length(word) + {d} - {half})), concat('d', length(word) + {d}, ' ', left(word, {half}), ' ', right(word, length(word) - p)))"


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: all pairs of near words, each once, a before b. Words have four code points at least."""
    pivoted = checkpoint(_pivoted(words))
    index = pivoted.select(F.explode(F.expr(f"flatten(transform(prefix, p -> concat({_after('0')}, {_before('0')})))")).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("last_b"))
    # an edit lies after the first pivot or before the second one
    looked_up = f"flatten(transform(array(-1, 0, 1), d -> concat(transform(slice(pivots, 1, 1), p -> {_after('d')})[0], transform(slice(pivots, 2, 1), p -> {_before('d')})[0])))"
    probes = pivoted.select(F.explode(F.expr(looked_up)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("last_a"))
    met = probes.join(index, "key").where("a <> b and last_a <= last_b and abs(length(a) - length(b)) <= 1 and levenshtein(a, b, 1) = 1")
    ordered = met.selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "if(a < b, n_a, n_b) AS n_a", "if(a < b, n_b, n_a) AS n_b")
    return ordered.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word of ``forms`` (word, form) the last that its forms lead to."""
    at = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        further = checkpoint(further)
        at = further.select("word", "root")
        if further.where("_moved").isEmpty():
            return at


def variants(words: DataFrame) -> DataFrame:
    """word, n, form, root, n_near, form_n for the words and counts given (columns word and n, each word once)."""
    words = checkpoint(words.select("word", "n"))
    pairs = checkpoint(near_words(words))
    both = pairs.selectExpr("a AS word", "b AS near", "n_b AS near_n").union(pairs.selectExpr("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.less") >= RATIO * F.col("n"), F.lit(False)))
    near = checkpoint(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("has"), F.col("best.near")).alias("form"), F.when(F.col("has"), -F.col("best.less")).alias("form_n")))
    roots = _roots(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
