"""Secret scans: fixed patterns, and novelty under a dictionary-primed compressor.

A candidate is a run of at least 20 characters of the alphabets in which keys are written, with letters and
digits, that stands after a word such as key, token or password. It is compressed with a dictionary made of
the text around it and a list of identifiers usual in code. What the dictionary makes short (names, paths,
text repeated nearby) is no secret; what stays as long as random characters of its own alphabet is reported as
``novel``. Copies of the candidate are left out of its dictionary, all that follow it and those before it that
stand after such a word too: a secret written twice is reported twice. A copy before it in plain text counts.

Null and empty texts have no spans; texts of any length are searched whole. Offsets count code points, the end is exclusive.
Repeated rows give repeated results; an empty table gives an empty one. Of columns only the two named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"
KINDS = ("assign", "access", "hex", "novel")

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SENSITIVE = re.compile(r"(?i)key|secret|token|passw|credential|auth|bearer|private|signature|salt|session")
#: Characters before a candidate in which a sensitive word has to stand, and on either side that prime the dictionary.
NEAR, AROUND = 48, 400
#: Compressed bytes for each character from which a candidate counts as new. Random base64 takes 0.75 at least; a
#: candidate of a smaller alphabet counts from the same share of what random characters of that alphabet take.
NOVEL, RANDOM = 0.70, 0.75
#: Letters and digits in which keys are written, fewest first.
ALPHABETS = tuple(map(frozenset, ("0123456789ABCDEF", "0123456789abcdef", string.hexdigits, string.ascii_uppercase + "234567", string.ascii_lowercase + "234567", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits)))

IDENTIFIERS = b" ".join(
    b"access account address admin algorithm application array authorization await background base buffer button "
    b"callback certificate class client cluster column component config configuration connection const container "
    b"content controller cookie count create credentials database default delete description development document "
    b"element encoding encryption endpoint environment error event example exception export factory filename "
    b"function generate getElementById handler header hostname identifier implementation import index initialize "
    b"instance interface internal iterator javascript language length library listener localhost location manager "
    b"message metadata method middleware module namespace network number object operation option organization "
    b"package parameter parent password path permission placeholder private process production project promise "
    b"property protected protocol provider public query random reference register release repository request "
    b"response result return router schema secret security selector sequence serializer server service session "
    b"settings signature static status storage string structure subscription success system table template "
    b"timestamp token transaction transform undefined undefined_value update upload username validate value variable "
    b"version width window workflow workspace http:// https:// www. .com .org .net /usr/local/lib /var/log /api/v1 "
    b"0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ".split()
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def compressor(before: str, after: str) -> zstandard.ZstdCompressor:
    primed = IDENTIFIERS + b" " + after.encode("utf-8", "replace") + b" " + before.encode("utf-8", "replace")
    return zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)


def marginal_bytes(candidate: str, before: str, after: str, press: zstandard.ZstdCompressor | None = None) -> int:
    """Bytes the candidate takes beyond an empty frame, the dictionary being its surroundings and the identifiers."""
    press = press or compressor(before, after)
    return len(press.compress(candidate.encode("utf-8"))) - len(press.compress(b""))


def random_like(run: str) -> str:
    """Random characters of the run's own alphabet, the same for each call; other signs stay where they stand."""
    letters = {c for c in run if c.isalnum()}
    alphabet = sorted(next(a for a in ALPHABETS if letters <= a))
    draw = random.Random(len(run))
    return "".join(draw.choice(alphabet) if c.isalnum() else c for c in run)


def sensitive(text: str, at: int) -> bool:
    return SENSITIVE.search(text, max(0, at - NEAR), at) is not None


def without(text: str, run: str, low: int, high: int, first: int, last: int, plain: bool) -> str:
    """``text[low:high]`` without the copies of ``run`` within ``first`` and ``last``; with those in plain text if ``plain``."""
    parts, at = [], text.find(run, first, last)
    while at >= 0:
        end = at + len(run)
        if not plain or sensitive(text, at):
            parts.append(text[low:at])
            low = end
        at = text.find(run, end, last)
    return "".join([*parts, text[low:high]])


def surroundings(text: str, a: int, b: int) -> tuple[str, str]:
    """The text before and after a run, without the copies of it that say nothing against it; see the module's notes."""
    run, low, high = text[a:b], max(0, a - AROUND), b + AROUND
    before = without(text, run, low, a, max(0, low - len(run) + 1), a, True)
    return before, without(text, run, b, high, b, high + len(run) - 1, False)


def novel_spans(text: str, taken: list[tuple[str, int, int]], threshold: float = NOVEL) -> list[tuple[str, int, int]]:
    found = []
    taken, at, reach = sorted((a, b) for _, a, b in taken), 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        run = m.group()
        # candidates come in order: of the spans that begin before its end, does the furthest reach into it?
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run) or len(set(run)) < 10:
            continue
        if reach > a or not sensitive(text, a):
            continue
        before, after = surroundings(text, a, b)
        press = compressor(before, after)
        size = marginal_bytes(run, before, after, press)
        if size >= threshold * len(run) or size >= threshold / RANDOM * marginal_bytes(random_like(run), before, after, press):
            found.append(("novel", a, b))
    return found


def render(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_secrets(docs: DataFrame, threshold: float = NOVEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text; see the module's notes."""

    def rows(ids: list, texts: list) -> list:
        bases = [base_spans(t) for t in texts]
        novel = [novel_spans(t, b, threshold) for t, b in zip(texts, bases, strict=True)]
        counts = [[sum(k == kind for k, _, _ in b) for b in bases] for kind in KINDS[:3]]
        digests = [hashlib.sha256(render(b).encode()).hexdigest() for b in bases]
        return [ids, *counts, digests, [render(b + n) for b, n in zip(bases, novel, strict=True)], [len(n) for n in novel]]

    return map_texts(docs, rows, SCHEMA, id_col, text_col)
