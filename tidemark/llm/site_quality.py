"""Quality by hierarchical empirical Bayes.

A classifier of the text gives each document evidence of quality. Hosts, and paths below them, have a mean
quality of their own, estimated from that evidence and shrunk: a path towards its host, a host towards all
documents, the more so the fewer documents it has. How strongly follows from the data alone: the variance between
the sites' means beyond what the documents' own variance explains, by moments. Where there is none beyond it, every
site takes its parent's mean. A document's odds are those of its text times the ratio of its path's odds to those
of all documents, as by Bayes' rule the site's mean stands for the prior that the classifier took from all. What a
document's own text says counts once: its site's sums are taken without it.

The classifier is a logistic regression over counts of the text's characters and words, fitted to at most
``TRAIN_ROWS`` labelled rows on average; all else is summed over every document, by partial sums, so a host
may hold any share of the rows. Null and empty texts are scored like any other text (of no words). A null
host or path is a site of its own. Repeated rows count each; texts of any length are described whole. Columns of other names, also of
those used here, do no harm; an empty table gives an empty result. Without labels of both kinds the classifier
says 0.5 for every text, and all are kept.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_batches, checkpoint, fresh, map_texts
from tidemark.llm.toxic_segments import _logistic

TRAIN_ROWS = 20_000
#: Documents whose probability of quality is below this are rejected.
KEEP = 0.35
#: Sites up to which their means are broadcast (some 100 bytes each).
BROADCAST_SITES = 200_000
LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_SENTENCE = re.compile(rb"[.!?](?:\s|$)")


@dataclass(frozen=True)
class Classifier:
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    coefficients: tuple[float, ...]


def describe(text: str) -> list[float]:
    """What the classifier sees of a text: shares of kinds of characters, repeated words and lines, lengths."""
    data = text.encode("utf-8")
    n = max(len(data), 1)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    w = max(len(words), 1)
    upper = len(data.translate(None, b"".join(bytes([b]) for b in range(256) if not 0x41 <= b <= 0x5A)))
    letters = n - len(data.translate(None, LETTERS))
    digits = n - len(data.translate(None, b"0123456789"))
    bars = data.count(b"|")
    marks = n - len(data.translate(None, b"!#$%&*<>{}[]=~^\\_|"))
    stops = len(_SENTENCE.findall(data))
    return [
        math.log1p(n), upper / n, letters / n, digits / n, math.log1p(100 * bars / w), math.log1p(100 * marks / n), 1 - len(set(words)) / w, 1 - len(set(lines)) / max(len(lines), 1),
        min(n / w, 40.0), math.log1p(w / max(stops, 1)), math.log1p(w / max(len(lines), 1)), float(upper > 0.5 * letters), float(marks > 0.05 * n), min(w, 20) / 20.0,
    ]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier | None:
    known = labels.select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1)).groupBy("_k").agg(F.min("_y").alias("_y"))
    part = min(1.0, rows / max(known.count(), 1))
    # ``rows`` rows on average, whatever the size of the tables: small enough to broadcast
    sample = known.where(F.pmod(F.xxhash64("_k", F.lit(3)), F.lit(1_000_000)) < int(part * 1_000_000))
    texts = docs.select(F.col(id_col).alias("_k"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(sample), "_k")
    seen = map_texts(texts, lambda ids, t: [ids, [describe(x) for x in t]], "y int, x array<double>", "_y", "_text").collect()
    y = np.array([float(r["y"]) for r in seen])
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([r["x"] for r in seen])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic(np.hstack([np.ones((len(x), 1)), _wide((x - mean) / spread)]), y)
    return Classifier(tuple(mean.tolist()), tuple(spread.tolist()), tuple(w.tolist()))


def _wide(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.hstack([z, z * z])


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def probabilities(texts: list[str], model: Classifier | None) -> np.ndarray:
    """The classifier's probability that each text is good."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x = (np.array([describe(t) for t in texts]) - model.mean) / model.spread
    z = np.hstack([np.ones((len(x), 1)), _wide(x)]) @ np.array(model.coefficients)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, host, path and ``evidence``, the classifier's probability that the text is good."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    key = F.struct(F.col(id_col).cast("bigint").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"))

    def rows(keys: list, texts: list) -> list:
        return [keys, probabilities(texts, model)]

    keyed = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    return map_texts(keyed, rows, "key struct<doc_id: bigint, host: string, path: string>, evidence double", "_key", "_text").select("key.*", "evidence")


def _strength(sites: DataFrame, inside: float, prior: Column, groups: str | None = None) -> float:
    """Documents that the prior of a site is worth: the variance inside sites over that between them, by moments.

    Infinite where the sites' means spread no more than ``inside``, the documents' variance, explains. ``prior`` is
    the mean that each site is held against, of which ``groups`` tells the number. One row comes to the driver.
    """
    n, m = F.col("n"), F.col("m")
    parents = F.lit(1) if groups is None else F.countDistinct(F.struct(groups))
    # of each parent the sum of squared counts over the count, so that the parent's own mean is allowed for
    total, spread, count, held = sites.agg(F.sum("n"), F.sum(n * F.pow(m - prior, 2)), F.count(F.lit(1)), parents).first()
    if not count or count <= held:
        return math.inf
    if groups is None:
        lost = sites.agg(F.sum(n * n) / F.sum("n")).first()[0]
    else:
        lost = sites.groupBy(groups).agg((F.sum(n * n) / F.sum("n")).alias("x")).agg(F.sum("x")).first()[0]
    between = (spread - (count - held) * inside) / (total - lost) if total > lost else 0.0
    return inside / between if between > 0 else math.inf


def _shrunk(k: float, prior: Column) -> Column:
    return prior if math.isinf(k) else (F.col("n") * F.col("m") + F.lit(k) * prior) / (F.col("n") + F.lit(k))


def site_posteriors(seen: DataFrame) -> tuple[DataFrame, float, int]:
    """host, path, host_posterior, path_posterior: means of the evidence, shrunk down the hierarchy; the mean of all; how many sites.

    Further columns: counts and means of path and host (n, m, host_n, host_m) and how many documents their priors are
    worth (path_k, host_k; null if infinitely many).
    """
    e = F.col("evidence")
    paths = checkpoint(seen.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(e).alias("m"), F.var_pop(e).alias("v")))
    weighted = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    rows, overall, within, sites = paths.agg(F.sum("n"), weighted, F.sum(F.col("n") * F.col("v")), F.count(F.lit(1))).first()
    overall = 0.5 if overall is None else float(overall)
    inside = within / (rows - sites) if rows and rows > sites else 0.0
    hosts = paths.groupBy("host").agg(weighted.alias("m"), F.sum("n").alias("n"))
    kh = _strength(hosts, inside, F.lit(overall))
    shrunk = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("m").alias("host_mean"), _shrunk(kh, F.lit(overall)).alias("host_posterior"))
    below = paths.join(shrunk, F.col("host").eqNullSafe(F.col("h")))
    kp = _strength(below, inside, F.col("host_mean"), "host")
    worth = [F.lit(None if math.isinf(k) else float(k)).cast("double").alias(name) for k, name in ((kh, "host_k"), (kp, "path_k"))]
    return below.select("host", "path", "host_posterior", _shrunk(kp, F.col("host_posterior")).alias("path_posterior"), "n", "m", "host_n", F.col("host_mean").alias("host_m"), *worth), overall, sites


def without_own(evidence: Column, site: Column, overall: float) -> tuple[Column, Column]:
    """Posteriors of host and path as the documents other than one with this evidence make them. ``site``: a row of ``site_posteriors``."""

    def shrunk(n: Column, m: Column, k: Column, prior: Column) -> Column:
        return F.coalesce((n * m - evidence + k * prior) / F.nullif(n - 1 + k, F.lit(0.0)), prior)

    host = shrunk(site["host_n"], site["host_m"], site["host_k"], F.lit(overall))
    return host, shrunk(site["n"], site["m"], site["path_k"], host)


#: What a document needs to know of its site.
SITE = ("n", "m", "path_k", "host_n", "host_m", "host_k")


def _score(evidence: Column, path_posterior: Column, overall: float) -> Column:
    return 1 / (1 + F.exp(-(_logit(evidence) + _logit(path_posterior) - _logit(F.lit(overall)))))


def quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, model: Classifier | None = None, **columns) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, keep: one row for each document; posteriors as the other documents make them."""
    model = model or train(docs, labels)
    seen = checkpoint(evidence(docs, model, **columns))
    posteriors, overall, n = site_posteriors(seen)
    sites = posteriors.select(F.col("host").alias("h"), F.col("path").alias("p"), F.struct(*SITE).alias("site"))
    sites = F.broadcast(sites) if n <= BROADCAST_SITES else sites
    joined = seen.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    of_host, of_path = without_own(F.col("evidence"), F.col("site"), overall)
    score = _score(F.col("evidence"), of_path, overall)
    return joined.select("doc_id", "host", "path", "evidence", of_host.alias("host_posterior"), of_path.alias("path_posterior"), score.alias("score"), (score >= keep).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, model: Classifier | None = None, text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, each row by its own score.

    Texts are not shuffled: the first pass over them sums up the sites, the second scores each row where it is read,
    and the sites come to it (by broadcast up to ``BROADCAST_SITES`` of them, else as Spark decides).
    """
    model = model or train(docs, labels, text_col=text_col)
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    no_id, at_host, at_path, judgement, site_host, site_path, posterior = (fresh(docs, n) for n in ("no_id", "at_host", "at_path", "judgement", "site_host", "site_path", "site_posterior"))
    posteriors, overall, n = site_posteriors(evidence(docs.withColumn(no_id, F.lit(0)), model, no_id, text_col, host, path))
    sites = posteriors.select(F.col("host").alias(site_host), F.col("path").alias(site_path), F.struct(*SITE).alias(posterior))
    sites = F.broadcast(sites) if n <= BROADCAST_SITES else sites

    @F.arrow_udf("double")
    def judged(texts: pa.Array) -> pa.Array:
        return pa.array(probabilities(texts.to_pylist(), model), pa.float64())

    arrow_batches(docs.sparkSession)
    scored = docs.withColumns({judgement: judged(F.coalesce(F.col(text_col), F.lit(""))), at_host: host.cast("string"), at_path: path.cast("string")})
    joined = scored.join(sites, F.col(at_host).eqNullSafe(F.col(site_host)) & F.col(at_path).eqNullSafe(F.col(site_path)))
    of_path = without_own(F.col(judgement), F.col(posterior), overall)[1]
    return joined.where(_score(F.col(judgement), of_path, overall) >= keep).select(*[F.col(f"`{c}`") for c in docs.columns])
