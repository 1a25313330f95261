"""Byte-level BPE by monoid tree reduction.

A text falls into matches of the pattern, which are encoded independently: between two of them no window is
needed. A match is reduced from its single bytes. Its bytes are halved recursively, the left part being the largest
power of two that leaves a right one, so that runs of a repeated character stay aligned; the parts' tokens are
joined by encoding a window around their boundary anew, one token on either side at first, then twice as many on
the side that needs it, until the tokens outside provably stay as they are: a sequence of tokens is the encoding of
its bytes if every adjacent pair of tokens is the encoding of the pair's own bytes, so a window is wide enough when
its first and last token form such pairs with their neighbours outside. No window has a largest size. A match that
is a token as a whole is that token, as in the library. The matches' tokens are then concatenated up a tree to the
text's. Results are remembered for short parts, pairs of tokens and matches, since words recur; a full memory is
emptied.

Decoding concatenates the bytes of tokens pair by pair up the same kind of tree.

Null and empty texts give no tokens (both hashes are those of the empty string); repeated rows are encoded each for
itself; an empty table gives an empty table. Of columns only those named are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Entries of each memory of a Python worker, and the longest part and match that are remembered.
REMEMBERED, PART_BYTES, MATCH_CHARS = 250_000, 8, 64
#: Neighbours concatenated at once where no window is needed.
FAN = 32
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

Tokens = tuple[int, ...]


class _Remembered(dict):
    """Key -> what ``make`` gives for it."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        found = self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = found
        return found


class _Matches(_Remembered):
    """Match -> its ids as little-endian unsigned 32-bit integers; long ones are not kept."""

    def __missing__(self, match: str) -> bytes:
        return super().__missing__(match) if len(match) <= MATCH_CHARS else self.make(match)


def reduced(parts: list[bytes], fan: int = FAN) -> bytes:
    """Neighbours concatenated, ``fan`` at a time, level by level."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + fan]) for i in range(0, len(parts), fan)]
    return parts[0] if parts else b""


class TreeCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.matches = _Matches(lambda m: self.pack(self.encode_match(m.encode("utf-8", "surrogatepass"))))
        self.windows = _Remembered(lambda tokens: self.merged(b"".join(map(self.bytes_of.__getitem__, tokens))))
        self.parts = _Remembered(self.halves)

    @staticmethod
    def pack(ids: Tokens) -> bytes:
        return array("I", ids).tobytes() if LITTLE else np.asarray(ids, "<u4").tobytes()

    # -- inside one match ---------------------------------------------------------------------
    def merged(self, data: bytes) -> Tokens:
        """The bytes of a window encoded anew: the adjacent pair of lowest rank is merged until none is left."""
        rank = self.ranks
        n = len(data)
        end = list(range(1, n + 1))  # where the symbol that begins here ends; 0 once it is merged away
        start = list(range(-1, n))  # where the symbol that ends here begins
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = end[i]
            if not j or j >= k or end[j] != k:
                continue  # one of the two has been merged since
            end[i], end[j], start[k] = k, 0, i
            if k < n and (r := rank.get(data[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
            if i and (r := rank.get(data[(h := start[i]) : k])) is not None:
                heapq.heappush(heap, (r, h, k))
        found, i = [], 0
        while i < n:
            found.append(rank[data[i : end[i]]])
            i = end[i]
        return tuple(found)

    def join(self, left: Tokens, right: Tokens) -> Tokens:
        """The tokens of two neighbouring parts as one sequence."""
        windows = self.windows
        window = windows[left[-1], right[0]]
        a = b = 1
        while True:
            grow_a = a < len(left) and windows[key := (left[-a - 1], window[0])] != key
            grow_b = b < len(right) and windows[key := (window[-1], right[b])] != key
            if not grow_a and not grow_b:
                return left[:-a] + window + right[b:]
            if grow_a:
                a = min(2 * a, len(left))
            if grow_b:
                b = min(2 * b, len(right))
            window = windows.make(left[-a:] + right[:b])

    def halves(self, data: bytes) -> Tokens:
        n = len(data)
        if n == 1:
            return (self.ranks[data],)
        half = 1 << (n - 1).bit_length() - 1
        tree = self.parts.__getitem__ if n <= 2 * PART_BYTES else self.halves
        return self.join(tree(data[:half]), tree(data[half:]))

    def encode_match(self, data: bytes) -> Tokens:
        whole = self.ranks.get(data)
        return self.halves(data) if whole is None else (whole,)

    # -- over whole texts; ids are kept as bytes, four to a token -----------------------------------
    def encode(self, text: str) -> bytes:
        return reduced(list(map(self.matches.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return reduced(list(map(self.bytes_of.__getitem__, ids)))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> TreeCodec:
    """One for each Python worker. Vocabulary files are installed on every machine; see the README."""
    return TreeCodec(read_ranks(vocabulary), pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return the count and digests of both.

    ``carry`` names columns that come along. ``keep_ids`` adds the ids themselves as ``ids array<int>``, ``keep_text``
    the decoded text as ``decoded``.
    """
    path, default_pattern = default_vocabulary()
    path, pattern = vocabulary or path, pattern or default_pattern

    def rows(keys: list, texts: list) -> list:
        tree = codec(path, pattern)
        counts, encoded, decoded, kept, back = [], [], [], [], []
        for text in texts:
            data = tree.encode(text)
            numbers = np.frombuffer(data, "<u4").tolist()
            whole = tree.decode(numbers)
            counts.append(len(numbers))
            encoded.append(hashlib.sha256(data).hexdigest())
            decoded.append(hashlib.sha256(whole).hexdigest())
            if keep_ids:
                kept.append(numbers)
            if keep_text:
                back.append(whole.decode("utf-8", "replace"))
        return [keys, counts, encoded, decoded] + [kept] * keep_ids + [back] * keep_text

    key = F.struct(F.col(id_col).cast("bigint").alias("doc_id"), *carry)
    keyed = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    schema = f"key {keyed.schema['_key'].dataType.simpleString()}, {SCHEMA}" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    out = map_texts(keyed, rows, schema, "_key", "_text")
    return out.select("key.*", *out.columns[1:])
