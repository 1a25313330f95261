"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a doubly linked list; a heap holds its adjacent pairs by rank, then by place.
The lowest pair is popped and merged until none is left. The count of tokens is the count of symbols less
the merges: no identifiers are made.

Null and empty texts count as no bytes and no tokens. The special strings of the vocabulary count one token
each wherever they stand, as the library has them by default. Texts of any length are counted whole; repeated rows are counted
each for itself; an empty table gives an empty one. Of columns only the two named are read, so others may have any name.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
LIMIT = 2048
REMEMBERED = 300_000


def _merge(parts: list, rank_of: Callable) -> int:
    """Merge in place, leaving None where a symbol went into the one before it; how many merges were made."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    made = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue  # one of the two has been merged since
        made += 1
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := rank_of((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return made


def merges(symbols: Sequence, rank_of: Callable) -> int:
    """How many merges the symbols take; ``rank_of((a, b))`` is None where the pair has none."""
    return _merge(list(symbols), rank_of)


def merge_symbols(symbols: Sequence, rank_of: Callable) -> list:
    """The symbols after all merges."""
    parts = list(symbols)
    _merge(parts, rank_of)
    return [p for p in parts if p is not None]


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Counts(dict):
    def __init__(self, counter: PairCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count_word(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


class PairCounter:
    """Counts for a vocabulary file of byte-level BPE with word ends (lower case, white space dropped)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.rank = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        specials = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.specials = specials
        self.split = regex.compile("|".join(map(regex.escape, specials)) or r"(?!)").split
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.known = _Counts(self)

    def count_word(self, word: str) -> int:
        symbols = [self.alphabet[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        return len(symbols) - merges(symbols, self.rank.get)

    def count(self, text: str) -> int:
        total = 0
        pieces = self.split(text) if any(s in text for s in self.specials) else [text]
        total += len(pieces) - 1
        for piece in pieces:
            if not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            # each character is lowered by itself: a capital sigma never becomes a final one
            piece = piece.replace("Σ", "σ").lower()
            total += sum(map(self.known.__getitem__, self.find(piece)))
        return total


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> PairCounter:
    with open(vocabulary, encoding="utf-8") as file:
        return PairCounter(json.load(file))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens are more than ``limit``."""
    path = vocabulary or default_vocabulary()

    def rows(ids: list, texts: list) -> list:
        count = counter(path).count
        tokens = [count(t) for t in texts]
        return [ids, [len(t.encode("utf-8")) for t in texts], tokens, [n > limit for n in tokens]]

    return map_texts(docs, rows, SCHEMA, id_col, text_col)
