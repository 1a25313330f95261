"""Toxicity by maximum-scoring segments.

Tokens carry the log-odds of toxic against clean labelled documents, with a Dirichlet prior in proportion to
their use in both. A token too rare for that takes those of its longest known beginning (``STEMS`` letters), as
compounds and inflections share one. A linear scan over the tokens of a text finds every maximal segment of positive score,
where each token without a weight costs a little. Scores of segments in clean documents have an exponential
tail, so the best of a text follows an extreme-value law in its length; a segment is significant if it is
rarer under that law than ``SIGNIFICANT``. The law is fitted by its mean excess over the least score; where all scores are
equal, by that score. A text's evidence, which is made of its segments and nothing else, is calibrated to a
probability on the labelled rows.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are learned from, a bounded sample of at most
``TRAIN_ROWS`` of them on average. Text alone makes a score; labels, languages, sources and ids don't.
Null and empty texts have no segments and get the score of that evidence; texts of any length are scanned whole. Of
columns only those named are read, so others may have any name. Rows with a null doc_id are not
held out and not learned from. Repeated rows get equal scores; an empty table gives an empty one. Without
labels of both kinds there is nothing to learn: every score is then the share of toxic labels, or 0.5.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, map_texts

#: Labelled rows learned from, strength of the prior, least z-score and toxic documents of a token that carries a weight.
TRAIN_ROWS, PRIOR, LEAST_Z, LEAST_DOCS = 20_000, 500.0, 3.0, 8
#: What a token without a weight costs; how rare a segment has to be; the threshold of ``predicted``.
GAP, SIGNIFICANT, THRESHOLD = 0.03, 0.05, 0.7
TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings that may stand in for a longer token, written with a star.
STEMS = (7, 5)
REMEMBERED = 200_000


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    rate: float  # of the tail: P(S > s) is about k * n * exp(-rate * s) in a clean text of n tokens
    k: float
    coefficients: tuple[float, ...]


def segments(hits: list[tuple[int, float]], n: int, gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of n tokens, in time linear in the hits.

    Hits are the places and weights of tokens that carry one. Kept segments lie on a stack with the running
    total before and after them; a new one is joined to the last whose total before is lower, as long as that
    makes it score more. Each keeps a link to the last before it whose total before is lower, so none is passed
    over twice; where there is none, the segments so far are final.
    """
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[float, float, int, int, int]] = []  # total before, total after, start, end, the last one with a lower total before
    total, last = 0.0, 0
    for place, weight in hits:
        total -= gap * (place - last)
        last = place + 1
        before, start = total, place
        total = after = total + weight
        if weight <= 0:
            continue
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0:  # no total before is lower, nor will one be: what is on the stack stays as it is
                done += [(a, b, after_ - before_) for before_, after_, a, b, _ in stack]
                stack.clear()
                break
            if stack[j][1] >= after:
                break
            before, start, back = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = back
        stack.append((before, after, start, place + 1, j))
    return done + [(a, b, after - before) for before, after, a, b, _ in stack]


class Weights(dict):
    """Token -> weight or 0, worked out once for each token; the memory is emptied when full."""

    def __init__(self, known: dict[str, float]):
        self.known = known

    def __missing__(self, token: str) -> float:
        weight = self.known.get(token)
        if weight is None:
            weight = next((self.known[f"{token[:n]}*"] for n in STEMS if len(token) > n and f"{token[:n]}*" in self.known), 0.0)
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = weight
        return weight


def hits_of(text: str, weights: Weights) -> tuple[list[tuple[int, float]], int]:
    tokens = TOKEN.findall(text.lower())
    found = list(map(weights.__getitem__, tokens))
    return [(i, w) for i, w in enumerate(found) if w], len(tokens)


def rarity(score: float, n: int, rate: float, k: float) -> float:
    """-log10 of the chance that a clean text of n tokens has a segment that scores so much."""
    expected = k * max(n, 1) * math.exp(-min(rate * score, 700.0))
    return -math.log10(max(-math.expm1(-expected), 1e-300))


def evidence(found: list[tuple[int, int, float]], n: int, rate: float, k: float) -> list[float]:
    """What is calibrated, from the segments alone: rarity of the best, and of the significant ones the sum of their
    rarities and of their lengths."""
    each = [(rarity(s, n, rate, k), b - a) for a, b, s in found]
    strong = [(r, size) for r, size in each if r >= -math.log10(SIGNIFICANT)]
    return [1.0, math.sqrt(min(max((r for r, _ in each), default=0.0), 30.0)), math.log1p(sum(r for r, _ in strong)), math.log1p(sum(size for _, size in strong))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def crc_rest(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def _beginnings(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = labels.select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (crc_rest("_k") != 1))
    known = known.groupBy("_k").agg(F.max("_y").alias("_y"))
    total = known.count()
    part = min(1.0, rows / max(total, 1))
    # the sample holds ``rows`` rows on average, so it may be broadcast at any size of the tables
    sample = known.where(F.pmod(F.xxhash64("_k"), F.lit(1_000_000)) < int(part * 1_000_000))
    texts = docs.select(F.col(id_col).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(sample), "_k")
    # equal texts count once, as toxic if any of them is
    texts = checkpoint(texts.groupBy("_text").agg(F.max("_y").alias("_y")))
    size = {y: n for y, n in texts.groupBy("_y").count().collect()}
    if not size.get(0) or not size.get(1):
        share = size.get(1, 0) / (size.get(0, 0) + size.get(1, 0)) if size else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, 1.0, 1.0, (math.log(share / (1 - share)),) + (0.0,) * 3)
    words = F.array_distinct(F.expr(r"regexp_extract_all(lower(_text), '\\p{L}+', 0)"))
    token = F.explode(F.array_distinct(F.concat(words, *[_beginnings(words, n) for n in STEMS]))).alias("t")
    counts = texts.select("_y", token).groupBy("t").agg(F.sum("_y").alias("toxic"), F.count(F.lit(1)).alias("both")).where(F.col("toxic") >= LEAST_DOCS)
    toxic, both = F.col("toxic").cast("double"), F.col("both").cast("double")
    n1, n0 = float(size[1]), float(size[0])
    prior = F.lit(PRIOR) * both / F.lit(n0 + n1) / 10
    odds = F.log((toxic + prior) / (n1 + PRIOR / 10 - toxic)) - F.log((both - toxic + prior) / (n0 + PRIOR / 10 - both + toxic))
    z = odds / F.sqrt(1 / (toxic + prior) + 1 / (both - toxic + prior))
    top = counts.where(both - toxic + prior > 0).where(toxic < n1 + PRIOR / 10).select("t", odds.alias("w"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("w") >= 1.0))
    # every token that passes: they come from the bounded sample, with LEAST_DOCS of its documents each
    weights = {r["t"]: float(r["w"]) for r in top.collect()}

    def scan(ids: list, texts_: list) -> list:
        memory = Weights(weights)
        found = [hits_of(t, memory) for t in texts_]
        return [ids, [[float(i) for i, _ in h] for h, _ in found], [[w for _, w in h] for h, _ in found], [n for _, n in found]]

    scanned = map_texts(texts, scan, "y int, places array<double>, weights array<double>, n bigint", "_y", "_text").collect()
    rows_ = [([(int(i), w) for i, w in zip(r["places"], r["weights"])], r["n"], r["y"]) for r in scanned]
    clean = [(max((s for _, _, s in segments(h, n)), default=0.0), n) for h, n, y in rows_ if y == 0]
    tail = [s for s, _ in clean if s > 0]
    low = min(tail, default=0.0)
    spread = float(np.mean(tail)) - low if tail else 1.0
    rate = 1.0 / spread if spread > 1e-9 else 1.0 / low
    k = max(len(tail), 1) / max(sum(n for _, n in clean), 1) * math.exp(min(rate * low, 50.0))
    x = np.array([evidence(segments(h, n), n, rate, k) for h, n, _ in rows_])
    y = np.array([float(r[2]) for r in rows_])
    return Model(weights, float(rate), float(k), tuple(_logistic(x, y).tolist()))


def score_text(text: str, model: Model, weights: Weights | None = None) -> tuple[float, list[tuple[int, int, float]]]:
    hits, n = hits_of(text, Weights(model.weights) if weights is None else weights)
    found = segments(hits, n)
    z = float(np.dot(evidence(found, n, model.rate, model.k), model.coefficients))
    strong = [s for s in found if rarity(s[2], n, model.rate, model.k) >= -math.log10(SIGNIFICANT)]
    return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0))), strong


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, passages (token start:end of the significant segments, comma-joined)."""
    model = model or train(docs, labels, id_col=id_col, text_col=text_col)

    memory = Weights(model.weights)

    def rows(ids: list, texts: list) -> list:
        found = [score_text(t, model, memory) for t in texts]
        return [ids, [s for s, _ in found], [int(s >= THRESHOLD) for s, _ in found], [",".join(f"{a}:{b}" for a, b, _ in p) for _, p in found]]

    scored = map_texts(docs, rows, "doc_id bigint, score double, predicted int, passages string", id_col, text_col)
    held_out = F.coalesce(crc_rest("doc_id") == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", "predicted", "passages")
