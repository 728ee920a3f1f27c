"""Toxicity by a noisy channel: obfuscated words are restored under a character language model, then the text is scored.

A token that mixes letters with look-alike signs, stretches letters or spaces them out is a lattice: each character is
itself, a letter that it stands for, or (repeats and separators) nothing. A Viterbi search finds the likeliest reading
under character trigrams that are counted over every whole text. The score is a logistic regression on the words and
word beginnings of the text, restored words included, fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm._common import lean, materialise

# Letters that signs are written for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "²": "z"}
#: Signs that may stand between the letters of one word.
SEPARATORS = " .-_*'`~^,/"
#: Letters that the character model tells apart: a word's edge, a to z, and all others.
CODES = 28
#: Log-probability that the channel takes for a sign in a letter's place, a dropped repeat or separator, and one kept as a gap.
SIGN, REPEAT, JOIN, GAP = -1.0, -0.5, -0.3, -2.0

_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters or signs one by one with the same kind of gap between them, and what a text must match to hold that.
_SPELT = re.compile(r"(?<![^\s.,])(?:(?:[^\s.,] ){2,}|(?:[^\s.,][.,]){2,}|(?:[^\s.,][-_*~/]){2,})[^\s.,](?![^\s.,!?])")
_SPELT_HINT = r"(?:^|[\s.,])(?:[^\s.,] [^\s.,] [^\s.,]|[^\s.,][.,][^\s.,][.,][^\s.,]|[^\s.,][-_*~/][^\s.,][-_*~/][^\s.,])(?:[ .,\-_*~/\s!?]|$)"
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_EDGES = ".,;:?\"'()[]{}<>#%&*~-_ "
#: Signs behind a word that are stress, not letters.
_STRESS = re.compile(r"(?:!+|\${3,}|\+{2,}|\|+)$")
_STOPS = str.maketrans(".,", "  ")


def _core(token: str) -> str:
    return _STRESS.sub("", token.strip(_EDGES)).strip(_EDGES)


def _byte_codes() -> np.ndarray:
    """Code of a UTF-8 byte: letters by number in either case, others by their first byte; 255 for bytes that follow it."""
    table = np.zeros(256, np.uint8)
    table[0x80:0xC0] = 255
    table[0xC3:0xE2] = table[0xE3:0xF0] = CODES - 1
    table[65:91] = table[97:123] = np.arange(1, 27)
    return table


_BYTE_CODES = _byte_codes()


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of (before, before, letter); a run of other characters than letters is one edge, and none is seen past it."""
    code = _BYTE_CODES[np.frombuffer(f" {' '.join(texts)} ".encode("utf-8", "replace"), np.uint8)]
    code = code[code != 255]
    code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
    if len(code) < 3:
        return np.zeros(CODES**3, np.int64)
    cell = code[1:-1].astype(np.uint16) * np.uint16(CODES) + code[2:]
    cell += np.where(code[1:-1] == 0, np.uint8(0), code[:-2]).astype(np.uint16) * np.uint16(CODES * CODES)
    return np.bincount(cell, minlength=CODES**3)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over every whole text; tasks hand on one row for each trigram that they have seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES**3, np.int64)
        for batch in batches:
            total += trigram_counts([t or "" for t in batch.column(0).to_pylist()])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["cell", "n"])

    rows = docs.select(F.col(f"`{text_col}`")).mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most CODES ** 3
    total = np.zeros(CODES**3, np.int64)
    for cell, n in rows:
        total[cell] = n
    return total


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c]: trigrams, backed by bigrams and letters."""
    n3 = counts.reshape(CODES, CODES, CODES).astype(np.float64)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + CODES)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    return np.log((n3 + 5 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 5))


def _code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else CODES - 1 if c.isalpha() else 0


def restore(token: str, model: list) -> str:
    """The likeliest reading of a lower-case token; gaps that the search leaves are spaces."""
    # a reading is its last letter and the reading before that, so that the search is linear in the token's length
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last = ""
    for c in token:
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0))
            if c == last:
                options.append(("", REPEAT))
        else:
            options += [(x, SIGN) for x in LOOKALIKES.get(c, "")]
            if c in LOOKALIKES and c == last:
                options.append(("", REPEAT))
            if c in SEPARATORS or c not in LOOKALIKES:
                options += [("", JOIN), (" ", GAP)]
        last = c
        grown: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, read) in states.items():
            for out, cost in options:
                if not out:
                    key, value = (a, b), score + cost
                else:
                    k = _code(out)
                    key, value = ((b, k) if k and b else (0, k)), score + cost + model[a][b][k]
                if key not in grown or value > grown[key][0]:
                    grown[key] = value, (read, out) if out else read
        states = grown  # at most CODES * CODES
    ends = [(score + model[a][b][0], read) for (a, b), (score, read) in states.items()]
    most = max((score for score, _ in ends), default=0.0)
    return max((_spelling(read) for score, read in ends if score == most), default="")


def _spelling(read: tuple | None) -> str:
    letters = []
    while read is not None:
        read, letter = read
        letters.append(letter)
    return "".join(reversed(letters))


def is_disguised(token: str) -> bool:
    """Whether a lower-case token without its edges mixes letters and signs, stretches a letter or is spelt out."""
    if len(token) < 3 or token.isalpha() and not _STRETCHED.search(token):
        return False
    letters = sum(c.isalpha() for c in token)
    signs = sum(c in LOOKALIKES for c in token)
    return letters + signs >= 3 and (letters > 0 or signs >= 4) and letters + signs + sum(c in SEPARATORS for c in token) == len(token)


def words_of(token: str, model: list) -> set[str]:
    """The words of a lower-case token as it is written and, where it is disguised, as it reads."""
    words = set(_LETTERS.findall(token))
    core = _core(token)
    if is_disguised(core):
        words.update(restore(core, model).split())
    return words


def tokens_of(text: str, spelt: bool) -> tuple[set[str], bool]:
    """The distinct tokens of a text in lower case, and whether it stretches a letter; spelt: it may spell words out."""
    low = text.lower()
    tokens = set(low.translate(_STOPS).split())
    if spelt:
        tokens.update(_SPELT.findall(low))
    points = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    same = points[1:] == points[:-1]
    return tokens, bool((same[1:] & same[:-1] & (points[2:] >= 97)).any())


def spells_out(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, _SPELT_HINT), False).to_pylist()


def features_of(word: str) -> list[str]:
    """A word whole and its beginnings."""
    return [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k)] if len(word) > 2 else []


@dataclass
class ToxicityModel:
    """What scoring needs: at most ``most_features`` weights, and the character model."""

    characters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    base: float = -4.0

    def reader(self, most: int = 200_000):
        """text, whether words may be spelt out -> score.

        Most tokens are plain words whose first letters begin no known feature and cost one look at a set; the others
        are read whole, and kept in a table that is emptied beyond ``most``.
        """
        model, weights, seen = self.characters.tolist(), self.weights, {}
        starts = {f[1:4] for f in weights}

        def known(token: str) -> tuple[str, ...]:
            found = tuple(f for w in words_of(token, model) for f in features_of(w) if f in weights)
            if len(seen) >= most:
                seen.clear()
            seen[token] = found
            return found

        def score(text: str, spelt: bool) -> float:
            tokens, stretched = tokens_of(text, spelt)
            active: set[str] = set()
            for t in tokens:
                if t[:3] not in starts:
                    if t.isalpha():
                        if not stretched or not _STRETCHED.search(t):
                            continue
                    else:
                        core = _core(t)
                        if core[:3] not in starts and core.isalpha() and not (stretched and _STRETCHED.search(core)):
                            continue
                found = seen.get(t)
                active.update(known(t) if found is None else found)
            return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.base + sum(weights[f] for f in sorted(active))))))

        return score


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: the CRC-32 of the id as text leaves 2 when divided by 4; never for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _fit_weights(rows: list[list[int]], labels: np.ndarray, features: int, rounds: int = 400, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features by Nesterov's gradient method, with a ridge."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.fromiter((f for r in rows for f in r), np.int64, len(at))
    w, v, b, vb = np.zeros(features), np.zeros(features), -2.0, 0.0
    rate = 4.0 / (np.bincount(at, minlength=len(rows)).max(initial=0) + 1)
    for _ in range(rounds):
        ahead, ahead_b = w + 0.9 * v, b + 0.9 * vb
        z = ahead_b + np.bincount(at, ahead[which], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels
        v = 0.9 * v - rate * (np.bincount(which, error[at], minlength=features) + ridge * 0.01 * ahead) / max(1.0, labels.sum())
        vb = 0.9 * vb - rate * error.mean()
        w, b = w + v, b + vb
    return w, float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 30_000, most_features: int = 1024, least_docs: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from all texts (characters) and a sample of about ``most_rows`` labelled rows (weights).

    Rows that :func:`held_out` names are never learnt from; the sample is by hash of the id, so that reruns agree. Null
    labels and labels of unknown documents are passed over; of repeated labels the highest counts. Without labelled
    rows no feature has a weight and every text has the same low score.
    """
    model = ToxicityModel(character_model(count_trigrams(docs, text_col)))
    key = F.col(f"`{id_col}`").cast("long")
    marked = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label is not null and id is not null")
    marked = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    share = min(1.0, most_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # a bounded number of ids and labels: about most_rows
    texts = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text_")).join(F.broadcast(marked), "id").select("text_", "label")
    characters = model.characters

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = characters.tolist(), {}
        for batch in batches:
            found = []
            for text, spelt in zip(batch.column(0).to_pylist(), spells_out(batch.column(0)), strict=True):
                words: set[str] = set()
                for t in tokens_of(text or "", spelt)[0]:
                    if t not in seen:
                        seen[t] = words_of(t, table)
                    words |= seen[t]
                found.append(sorted({f for w in words for f in features_of(w)}))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["label", "features"])

    sample = materialise(texts.mapInArrow(lean(read), "label int, features array<string>"), "toxicity-sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, all_ = Counter(), Counter()
        for batch in batches:
            for label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                all_.update(found)
                if label:
                    one.update(found)
        names = list(all_)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([all_[n] for n in names], pa.int64()), pa.array([one[n] for n in names], pa.int64())], names=["feature", "n", "toxic"])

    n, toxic = sample.agg(F.count(F.lit(1)), F.sum((F.col("label") > 0).cast("long"))).first()
    if not n or not toxic or toxic == n:
        return model

    def part(count: Column, of: float) -> Column:
        return F.when(count > 0, count * F.log(count / of)).otherwise(0.0)

    told = sample.mapInArrow(lean(tally), "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= least_docs)
    clean, expected, rest = F.col("n") - F.col("toxic"), F.col("n") * (toxic / n), F.col("n") * (1 - toxic / n)
    told = told.withColumn("gain", part(F.col("toxic"), expected) + part(clean, rest)).orderBy(F.desc("gain"), "feature").limit(most_features)
    names = [r[0] for r in told.select("feature").collect()]
    listed = _active(sample, names)
    weights, model.base = _fit_weights([r[1] for r in listed], np.array([r[0] > 0 for r in listed], float), len(names))
    model.weights = {f: float(w) for f, w in zip(names, weights, strict=True)}
    return model


def _active(sample: DataFrame, names: list[str]) -> list:
    """(label, numbers of the features in ``names``) of each row of the bounded sample, in an order that reruns agree on."""
    number = {f: i for i, f in enumerate(names)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[number[f] for f in row if f in number] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "features"])

    return sorted(map(tuple, sample.mapInArrow(lean(look), "label int, features array<int>").collect()), key=lambda r: (r[0], r[1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row of ``docs``: 0 to 1, higher where the text is likelier toxic.

    Whole texts are read, whatever their length; null and empty texts have the score of a text without known features.
    Null ids stay null, repeated rows give repeated rows, an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features weights and CODES ** 3 numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for batch in batches:
            scores = [read(t or "", s) for t, s in zip(batch.column(1).to_pylist(), spells_out(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text_").mapInArrow(lean(score), "id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.reader()
        for batch in batches:
            scores = [read(t or "", s) for t, s in zip(batch.column(at).to_pylist(), spells_out(batch.column(at)), strict=True)]
            yield batch.filter(pa.array([x < least for x in scores], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
