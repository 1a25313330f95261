"""Periodic runs, language model scores and spelling variants against brute force."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as X
from tidemark.llm import katz, pivotal_grams, queries, recompression

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- periodic runs ------------------------------------------------------------------------------------------
def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every period is tried at every place; of one stretch the smallest period stays."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def made_words(rnd: random.Random) -> np.ndarray:
    kinds, n = rnd.choice([1, 2, 2, 3, 5, 50]), rnd.choice([0, 1, 23, 24, 25, 60, 200, 600])
    x = [rnd.randrange(kinds) for _ in range(n)]
    for _ in range(rnd.randrange(4)):
        if n > 30:
            a, p = rnd.randrange(n), rnd.choice([1, 2, 3, 4, 7, 8, 9, 13, 40])
            for t in range(a + p, min(n, a + rnd.randrange(20, 160))):
                x[t] = x[t - p]
    return np.array(x, np.int64)


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        texts = [made_words(rnd) for _ in range(rnd.choice([1, 5, 12]))]
        for text, found in zip(texts, recompression.runs_of(texts), strict=True):
            assert [tuple(r) for r in found.tolist()] == plain_runs(text.tolist())


def test_candidates_in_small_portions_find_the_same_runs(monkeypatch):
    rnd = random.Random(5)
    texts = [made_words(rnd) for _ in range(20)]
    want = [r.tolist() for r in recompression.runs_of(texts)]
    for most in (1, 7, 100):
        monkeypatch.setattr(recompression, "PAIRS_AT_ONCE", most)
        assert [r.tolist() for r in recompression.runs_of(texts)] == want


def test_grammar_answers_how_far_places_agree():
    rnd = random.Random(2)
    for kinds in (1, 2, 3, 30):
        x = [kinds, *(rnd.randrange(kinds) for _ in range(400)), kinds + 1]
        if kinds > 1:
            x[200:300] = x[50:150]
        grammar = recompression.Grammar(np.array(x))
        pairs = [(i, j) for i in range(1, 400, 3) for j in range(i + 1, 401, 2)]
        i, j = np.array(pairs).T

        def agree(a, b, step):
            n = 0
            while x[a] == x[b]:
                a, b, n = a + step, b + step, n + 1
            return n

        assert grammar.lce(i, j).tolist() == [agree(a, b, 1) for a, b in pairs]
        assert grammar.lce(i, j, forward=False).tolist() == [agree(a, b, -1) for a, b in pairs]


def test_grammar_shrinks_by_level():
    grammar = recompression.Grammar(np.concatenate([[5], np.arange(100_000) % 3, [6]]))
    assert len(grammar.symbols[-1]) == 1 and sum(map(len, grammar.symbols)) < 1_000_000


def plain_op11(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    s = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
    c = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
    return (str(doc_id), len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), s, c)


OP11 = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def short(docs):
    """Without the text that is too long for brute force; it has a test of its own."""
    return docs.where("text is null or length(text) < 100000")


@pytest.mark.parametrize("docs", [X.documents, X.odd, X.clashing, X.nothing])
def test_runs_of_documents(spark, docs):
    docs = short(docs(spark)).where("text is null or length(text) < 30000")
    got = recompression.digests(recompression.periodic_runs(docs, recompression.planted_period)).select(OP11).collect()
    want = [plain_op11(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, ((str(r[0]), *r[1:]) for r in got))) == sorted(map(str, want))


def test_long_text_is_one_run(spark):
    rows = recompression.periodic_runs(X.odd(spark).where("doc_id in (3, 4)")).collect()
    assert [(r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows] == [(200_000, [(0, 200_000, 5)], "lorem ipsum dolor sit amet")] * 2


def test_op11_query(spark):
    got = queries.op11_runs(spark, X.SMALL)
    assert got.columns[:8] == OP11 and got.count() == X.documents(spark).count()
    assert got.where("n_runs > 0 and start is not null and exponent_milli >= 3000").count() > 10


# -- spelling variants --------------------------------------------------------------------------------------
def plain_vocabulary(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    """Words are near if one is the other without a letter, or both are equal without the letter at one place."""
    without = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            without[w[:i] + "*" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in words:
                without[w, i] = {w, w[:i] + w[i + 1 :]}
    near = defaultdict(set)
    for group in without.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows)


def test_variants_equal_brute_force(spark):
    rnd = random.Random(3)
    words = {}
    for _ in range(4000):
        w = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(5, 9)))
        words[w] = rnd.randrange(3, 200)
    words |= {"xxxxx": 3, "xxxxxx": 6, "xxxxxxx": 12, "xxxxxxxx": 24, "xxxxxxxxx": 48, "ababa": 4, "babab": 9, "x" * 3000: 5, "x" * 3001: 11}
    got = pivotal_grams.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    rows = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect())
    assert rows == plain_variants(words) and sum(r[4] for r in rows) > 3000


@pytest.mark.parametrize("docs", [X.documents, X.odd, X.clashing, X.nothing])
def test_variants_of_documents(spark, docs):
    docs = docs(spark)
    got = pivotal_grams.variants(pivotal_grams.vocabulary(docs, pivotal_grams.deleted_letter))
    want = plain_variants(plain_vocabulary([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == want


def test_op13_query(spark):
    got = queries.op13_variants(spark, X.SMALL)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.where("root <> word").count() > 0


def test_pivots_are_the_cheapest_that_do_not_overlap():
    rnd = random.Random(4)
    for _ in range(500):
        ranks = [rnd.randrange(6) for _ in range(rnd.randrange(4, 12))]
        places, rank, place = pivotal_grams.prefix_of(ranks)
        assert sorted((ranks[p], p) for p in places[:3]) == sorted((r, p) for p, r in enumerate(ranks))[:3]
        chosen = pivotal_grams.pivots_of(places[:3], ranks.__getitem__)
        pairs = [(ranks[a] + ranks[b], a, b) for a in places[:3] for b in places[:3] if b - a >= 2]
        assert chosen[1] - chosen[0] >= 2 and sum(ranks[p] for p in chosen) == min(pairs)[0]


def test_words_are_whole_across_pieces(monkeypatch):
    text = "Wörter und noch Mehr, ohne Rest " * 20
    want = pivotal_grams.words_of(7, text)
    for size in (1, 5, 33):
        monkeypatch.setattr(pivotal_grams, "PIECE", size)
        assert pivotal_grams.words_of(7, text) == want


# -- language model -----------------------------------------------------------------------------------------
class PlainKatz:
    """The definition, with dictionaries of n-grams (tuples) and a recursion for each token."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        self.after = [defaultdict(set) for _ in range(order)]
        for tokens in texts:
            x = ["<s>", *tokens, "</s>"]
            for i in range(1, len(x)):
                for k in range(min(order, i + 1)):
                    if k == 0 or i - k >= 0:
                        self.counts[k][tuple(x[i - k : i + 1])] += 1
                        self.after[k][tuple(x[i - k : i])].add(x[i])
        self.d = []
        for c in self.counts:
            n = Counter(c.values())
            self.d.append({})
            for r in range(1, 6):
                d = -1.0
                if n[1] and n[r] and 6 * n[6] / n[1] < 1:
                    a = 6 * n[6] / n[1]
                    d = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
                self.d[-1][r] = d if 0 < d < 1 else (r - 0.5) / r
        self.total, self.kinds = sum(self.counts[0].values()), len(self.counts[0])

    def whole(self, context):
        k = len(context)
        seen = [self.counts[k][(*context, w)] for w in self.after[k][context]]
        return sum(seen) + (not any(c <= 5 for c in seen))

    def p(self, word, context=()):
        k = len(context)
        whole = self.whole(context)
        c = self.counts[k][(*context, word)]
        if c:
            return self.d[k].get(c, 1.0) * c / whole
        seen = self.after[k].get(context) or ()
        left = 1 - sum(self.p(w, context) for w in seen)
        if not k:
            return left
        if not seen:
            return self.p(word, context[1:])
        return left / (1 - sum(self.p(w, context[1:]) for w in seen)) * self.p(word, context[1:])

    def score(self, tokens):
        x = ["<s>", *tokens, "</s>"]
        return sum(math.log10(self.p(x[i], tuple(x[max(0, i - self.order + 1) : i]))) for i in range(1, len(x)))

    def base(self, tokens):
        return sum(math.log10((self.counts[0][w,] + 0.5) / (self.total + 0.5 * (self.kinds + 1))) for w in [*tokens, "</s>"])


def tokens_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]


def fifth(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 1"


def hold(got, docs, order):
    rows = [(r["doc_id"], tokens_of(r["text"])) for r in docs.select("doc_id", "text").collect()]
    model = PlainKatz([t for i, t in rows if i is not None and not fifth(i)], order)
    memory = functools.lru_cache(maxsize=None)(model.p)
    model.p = memory
    model.whole = functools.lru_cache(maxsize=None)(model.whole)
    known = lambda t: sum(model.counts[0][w,] > 0 for w in [*t, "</s>"])
    want = sorted(((str(i), fifth(i), len(t) + 1, known(t), model.total, model.base(t), model.score(t)) for i, t in rows), key=str)
    have = sorted(((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got.collect()), key=str)
    assert [r[:5] for r in have] == [r[:5] for r in want]
    for a, b in zip(have, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return model


def made_docs(spark, n=250, seed=6):
    rnd = random.Random(seed)
    kinds = [f"W{k}" for k in range(60)] + ["ÄB", "the", "The"]
    weights = [1 / (k + 1) for k in range(len(kinds))]
    return spark.createDataFrame([(i, " ".join(rnd.choices(kinds, weights, k=rnd.randrange(40)))) for i in range(n)], "doc_id bigint, text string")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_definition(spark, order):
    docs = made_docs(spark)
    model = hold(katz.score(docs, F.expr(HELD_OUT), order), docs, order)
    every = [w for (w,) in model.counts[0]] + ["never seen"]
    for k in range(order):
        for context in list(model.after[k])[:40]:
            assert sum(model.p(w, context) for w in every) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_do_not_depend_on_blocks_pieces_and_buckets(spark, order):
    docs = made_docs(spark, 120).repartition(3)
    hold(katz.score(docs, F.expr(HELD_OUT), order, katz.Sizes(block_tokens=150, bucket_keys=200, hot=40, piece=30)), docs, order)


@pytest.mark.parametrize("docs", [X.odd, X.clashing, X.nothing])
def test_scores_of_odd_documents(spark, docs):
    docs = short(docs(spark))
    hold(katz.score(docs, F.expr(HELD_OUT)), docs, 2)


def test_scores_with_nothing_to_learn_from(spark):
    rows = katz.score(made_docs(spark, 20), F.lit(True)).collect()
    assert {(r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in rows} == {(0.0, 0.0, 0, 0)}


def test_scores_of_a_very_long_text(spark):
    docs = X.odd(spark).where("doc_id in (3, 5)").cache()
    rows = {r["doc_id"]: r for r in katz.score(docs, F.lit(False)).collect()}
    assert rows[3]["n_tokens"] == 200_001 and rows[3]["score"] > rows[3]["base_score"]


def test_op12_query_beats_its_base(spark):
    docs = X.documents(spark).where("doc_id < 60")
    hold(katz.score(docs, F.expr(HELD_OUT)), docs, 2)
    got = queries.op12_katz(spark, X.SMALL)
    held = got.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and held["s"] > held["b"]
