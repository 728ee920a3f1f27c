"""Secret scans: pattern spans, and credential values judged by their guess cost.

Guess cost is the least number of guesses, as a base-2 logarithm, over all ways to cut a value into spans: dictionary
words (with simple letter swaps), dates, repeats, keyboard walks, alphabet runs, and brute force. A dynamic programme
over the ends of spans finds it. Values in a credential context that cost more than a threshold are secrets even where
no fixed pattern matches; placeholders such as ``changeme`` or ``xxxxxxxx`` cost little and are left alone. A context is
a keyword and ``:``, ``=``, ``:=``, ``=>``, ``is`` or an opening quote, or ``bearer`` and a space. After ``is`` and a
space, values that are words of prose (lower-case letters but for first ones, joined by hyphens, full stops, slashes or
apostrophes) are left alone. The words of the dictionary are a fixed list and those of most documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract, by kind in its order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Where credentials are named in prose or code; group 2 is what stands between, group 3 the value.
CREDENTIAL = r"""(pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)["']?(\x20*(?::=|=>|[:=])\x20*["'`]?|\x20+is:?\x20+["'`]?|\x20+["'`]|(?<=bearer)\x20+)([^\x00-\x20"'`,;<>(){}\[\]]{8,})"""
#: What a text must match for one of the patterns to match it; these run on whole Arrow batches.
HINTS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{12}", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "credential": r"(?i)(pass(word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)"}
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "credential")

# Words that guessers try first, most frequent first.
COMMON = (
    "password 123456 qwerty admin welcome login master dragon monkey shadow letmein sunshine princess football baseball "
    "superman batman trustno iloveyou secret changeme default example sample placeholder test guest root user pass token "
    "api key access private public server database service account company office internet computer summer winter spring "
    "autumn january february march april june july august september october november december monday friday love hello "
    "money freedom whatever michael jordan charlie thomas george daniel andrew jessica michelle ashley your here value none null true false todo redacted hidden"
).split()
# Rows of a keyboard, unshifted.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
# Letters that digits and signs stand for.
SWAPS = {"4": "a", "@": "a", "3": "e", "1": "l", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g"}

#: Letters of the longest word that is looked up; longer entries of a dictionary count for nothing.
LONGEST_WORD = 20

_ASSIGN, _CREDENTIAL = re.compile(ASSIGN, re.I | re.A), re.compile(CREDENTIAL, re.I | re.A)
_ACCESS, _HEX = re.compile(ACCESS), re.compile(HEX)
_PROSE = re.compile(r"[^\W\d_]?[^\W\d_A-Z]*(?:[-'/.][^\W\d_]?[^\W\d_A-Z]+)*")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


@lru_cache(maxsize=1)
def _neighbours() -> dict[str, set[str]]:
    """Keys next to each key, from the rows: beside it, and the two nearest keys of the row below and above."""
    near: dict[str, set[str]] = {c: set() for row in KEY_ROWS for c in row}
    for i, row in enumerate(KEY_ROWS):
        for j, c in enumerate(row):
            others = [*row[max(0, j - 1) : j], *row[j + 1 : j + 2]]
            if i + 1 < len(KEY_ROWS):
                shift = 1 if i == 0 else 0
                others += [*KEY_ROWS[i + 1][max(0, j - 1 - shift) : max(0, j + 1 - shift)]]
            for other in others:
                near[c].add(other)
                near[other].add(c)
    return near


def _alphabet(c: str) -> int:
    """Size of the alphabet that a brute-force guesser has to run through for this character."""
    if c.isdigit():
        return 10
    if c.isascii() and c.isalpha():
        return 26
    return 33 if c.isascii() else 100


def _spans(value: str, words: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, log2 guesses) of every span that a guesser has a pattern for."""
    n, low = len(value), "".join(c.lower() if c.isascii() else c for c in value)
    plain = "".join(SWAPS.get(c, c) for c in low)
    longest = LONGEST_WORD
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for text, extra in ((low, 0.0), (plain, 1.0)):
                if (rank := words.get(text[i:j])) is not None:
                    cased = 0.0 if value[i:j].islower() or not value[i:j].isalpha() else 1.0
                    yield i, j, math.log2(rank + 1) + extra + cased
                    break
    for m in _DATE.finditer(value):
        yield m.start(), m.end(), math.log2(119.0 if len(m[0]) == 4 else 365.0 * 119 * 4)
    i = 0
    while i < n:  # a unit, again and again
        end = 0
        for unit in (1, 2, 3, 4):
            if i + 2 * unit > n:
                break
            j = i + unit
            while value[j : j + unit] == value[i : i + unit]:
                j += unit
            if j - i >= max(3, 2 * unit) and j > end:
                end = j
                yield i, j, sum(math.log2(_alphabet(c)) for c in value[i : i + unit]) + math.log2((j - i) / unit)
        i = max(i + 1, end)
    near = _neighbours()
    for what in ("walk", "run"):
        i = 0
        while i < n - 2:
            j = i + 1
            if what == "walk":
                while j < n and low[j] in near.get(low[j - 1], ()):
                    j += 1
                cost, least = math.log2(47) + (j - i) * 1.5, 4
            else:
                step = ord(low[j]) - ord(low[i])
                while j < n and abs(step) == 1 and ord(low[j]) - ord(low[j - 1]) == step:
                    j += 1
                cost, least = math.log2(_alphabet(value[i])) + 1 + math.log2(j - i), 3
            if j - i >= least:
                yield i, j, cost
            i = max(i + 1, j - 1)


def guess_cost(value: str, words: dict[str, int] | None = None) -> float:
    """Least log2 guesses over all segmentations of a value; an empty value costs nothing."""
    words = {w: k for k, w in enumerate(COMMON, 1)} if words is None else words
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _spans(value, words):
        ends.setdefault(j, []).append((i, cost))
    best = [0.0]
    for j in range(1, len(value) + 1):  # one more brute-force character, or a span that ends here
        cost = best[j - 1] + math.log2(_alphabet(value[j - 1]))
        for i, own in ends.get(j, ()):
            cost = min(cost, best[i] + own + 1)
        best.append(cost)
    return best[-1]


def find_spans(text: str, least_bits: float, words: dict[str, int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of a text by start, then kind: code points, end exclusive."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    for m in _CREDENTIAL.finditer(text):
        value = m[3].rstrip(".!?:")
        if len(value) >= 8 and not (m[2].strip() in ("is", "is:") and _PROSE.fullmatch(value)) and guess_cost(value, words) >= least_bits:
            found.append((m.start(3), m.start(3) + len(value), "credential"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


#: Words that a dictionary takes from the corpus.
MOST_WORDS = 20_000


def common_words(docs: DataFrame, most: int = MOST_WORDS, text_col: str = "text") -> tuple[str, ...]:
    """The fixed words and then the ``most`` words of 3 to 20 lower-case letters that most documents have, in that order.

    Words are counted over every whole text, once for each document, and ordered by count and then by spelling; only
    words between white space or stops count, so that no part of a key becomes a word. Empty tables add none.
    """
    words = F.array_distinct(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"(?<![^\s])([a-z]{3,20})(?=[\s.,;:!?]|$)"), F.lit(1)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = [r[0] for r in counts.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]
    return tuple(dict.fromkeys([*COMMON, *ranked]))


#: log2 guesses from which a value in a credential context is taken for a secret.
LEAST_BITS = 36.0

SCAN_SCHEMA = "id long, n_assign long, n_access long, n_hex long, n_credential long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bits: float = LEAST_BITS, words: tuple[str, ...] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Secrets in every whole text: counts by kind, a digest of the pattern spans, and all spans.

    Returns a row for each row of ``docs``: id, n_assign, n_access, n_hex, n_credential, base_sha256, spans and the
    columns of ``keep``. Null texts count as empty and have no spans (the digest is that of the empty string); null ids
    stay null; repeated rows give repeated rows; other columns are ignored. Texts of any length are read whole. words:
    the dictionary, most frequent first; by default :func:`common_words` of ``docs``.
    """
    words = common_words(docs, text_col=text_col) if words is None else words  # MOST_WORDS and the fixed ones at most
    ranks = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words, 1)})
    empty = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = "|".join(f"(?:{h})" for h in HINTS.values())
        for batch in batches:
            text = batch.column(1)
            likely = pc.fill_null(pc.match_substring_regex(text, hint), False).to_numpy(zero_copy_only=False)
            counts = {k: [0] * len(likely) for k in KINDS}
            digests, lists = [empty] * len(likely), [""] * len(likely)
            for i in likely.nonzero()[0].tolist():
                spans = find_spans(text[i].as_py(), least_bits, ranks.value)
                if spans:
                    for _, _, kind in spans:
                        counts[kind][i] += 1
                    digests[i] = hashlib.sha256(joined([s for s in spans if s[2] != "credential"]).encode()).hexdigest()
                    lists[i] = joined(spans)
            out = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(lists, pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[2:]], names=[*fields, *keep])

    fields = [f.split()[0] for f in SCAN_SCHEMA.split(", ")]
    picked = docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text_", *[f"`{c}`" for c in keep])
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return picked.mapInArrow(scan, SCAN_SCHEMA + kept)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bits: float = LEAST_BITS, words: tuple[str, ...] | None = None, length_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with every secret span of the text replaced by ``[kind]``; nothing is dropped.

    Overlapping spans are replaced as one, under the kind of the first. Texts without spans, null texts and all other
    columns stay as they are, but for ``length_col``: there changed rows get the code points of their new text. words:
    as in :func:`scan_secrets`. Repeated rows and null ids are rows like any other; an empty table stays empty.
    """
    words = common_words(docs, text_col=text_col) if words is None else words
    ranks = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words, 1)})
    at = docs.columns.index(text_col)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = "|".join(f"(?:{h})" for h in HINTS.values())
        for batch in batches:
            text = batch.column(at)
            likely = pc.fill_null(pc.match_substring_regex(text, hint), False).to_numpy(zero_copy_only=False)
            changed = {i: redacted(text[i].as_py(), least_bits, ranks.value) for i in likely.nonzero()[0].tolist()}
            if changed:
                values = [changed.get(i, x) for i, x in enumerate(text.to_pylist())]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, text.type))
                if length_col is not None:
                    k = batch.schema.names.index(length_col)
                    lengths = [len(changed[i]) if i in changed else x for i, x in enumerate(batch.column(k).to_pylist())]
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(lengths, batch.column(k).type))
            yield batch

    return docs.mapInArrow(redact, docs.schema)


def redacted(text: str, least_bits: float, words: dict[str, int] | None = None) -> str:
    """A text with its secret spans replaced."""
    parts, done = [], 0
    merged: list[list] = []
    for start, end, kind in find_spans(text, least_bits, words):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        parts += [text[done:start], f"[{kind}]"]
        done = end
    return "".join([*parts, text[done:]])
