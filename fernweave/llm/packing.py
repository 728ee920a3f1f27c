"""Packing documents by length patterns: non-negative least squares over the histogram of lengths.

The histogram of piece lengths has at most ``capacity`` bins however many documents there are, so the plan is made from
it alone. Patterns are multisets of a few length classes that fill a sequence; repeat counts that reproduce the
histogram are fitted by non-negative least squares and rounded down; each pattern then takes real lengths, longest of
its class first and last the longest piece that still fits, as long as that fills a sequence, and what is left over in
the histogram is packed best fit, longest first, as runs of equal sequences. The plan maps (length, number
among the pieces of that length) to a place; documents never leave their tasks for it.
"""

from __future__ import annotations

import threading
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernweave.llm._common import lean, materialise

# ---------------------------------------------------------------- token ids


class WordIds:
    """Token ids of texts, as unsigned 32-bit integers in little-endian order.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its white-space separated
    pieces in turn. Pieces seen before come from a table, which is emptied beyond ``most``. New pieces that are Latin
    letters (with at most one stop or comma behind) are read many at a time by the same vocabulary without its
    patterns, which could not cut them; every other piece takes the tokenizer's whole path.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.seen: dict[bytes, bytes] = {}
        self.most = most
        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(self, pieces: list[bytes]) -> None:
        words, odd = [], []
        for piece in pieces:
            core, end = (piece[:-1], piece[-1:]) if piece[-1] in b".," else (piece, b"")
            text = core.decode()
            word = text.lower()
            # up to Latin letters the lower case is the same everywhere
            if text.isalpha() and (text.isascii() or (max(word) < "\u0250" and len(word) == len(text) and unicodedata.is_normalized("NFC", text))):
                words.append((piece, word, end))
            else:
                odd.append(piece)
        for piece in odd:
            self.seen[piece] = array("I", self.whole.encode(piece.decode(), add_special_tokens=False).ids).tobytes()
        stops = {b"": b""} | {c: array("I", self.whole.encode(c.decode(), add_special_tokens=False).ids).tobytes() for c in (b".", b",")}
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.letters.encode(" ".join(w for _, w, _ in some), add_special_tokens=False).ids, np.uint32)
            ends, raw, start = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes(), 0
            for (piece, _, end), stop in zip(some, ends, strict=True):
                self.seen[piece] = raw[start:stop] + stops[end]
                start = stop

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        if len(self.seen) >= self.most:
            self.seen.clear()
        raw = [(text or "").encode() for text in texts]
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]  # special tokens are told by their case
        seen = self.seen
        new = set()
        for words in split:
            new.update([w for w in words if w not in seen])
        self.learn(list(new))
        return [b"".join([seen[w] for w in words]) for words in split]


_tables: dict[str, WordIds] = {}
_lock = threading.Lock()


def word_ids(path: str) -> WordIds:
    """One table for each Python worker."""
    with _lock:
        if path not in _tables:
            _tables[path] = WordIds(path)
        return _tables[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32 (and ids, as bytes).

    A document is its token ids and then ``end_id``; only longer ones than ``capacity`` are cut, into pieces of
    ``capacity`` tokens with the rest last. A null or empty text has the one piece of ``end_id`` alone.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer_path)
        for batch in batches:
            ids, piece, start, length, crc, data = [], [], [], [], [], []
            for one, raw in zip(batch.column(0).to_pylist(), table.of(batch.column(1).to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    ids.append(one), piece.append(k), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                    if with_ids:
                        data.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *([pa.array(data, pa.binary())] if with_ids else [])], names=["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    picked = docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text_")
    return picked.mapInArrow(lean(cut), "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# ---------------------------------------------------------------- the plan


def length_patterns(classes: int, parts: int) -> np.ndarray:
    """All multisets of at most ``parts`` classes (1..classes) whose classes sum to ``classes``: a row of counts each.

    Class c stands for lengths of at most c / classes of a sequence, so each pattern fits.
    """
    found: list[list[int]] = []

    def extend(chosen: list[int], left: int, most: int, parts: int) -> None:
        if left == 0:
            found.append(chosen)
        elif parts:
            for c in range(min(left, most), (left - 1) // parts, -1):
                extend([*chosen, c], left - c, c, parts - 1)

    extend([], classes, classes, parts)
    out = np.zeros((len(found), classes + 1), np.float64)
    for i, chosen in enumerate(found):
        np.add.at(out[i], chosen, 1)
    return out[:, 1:]


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes a @ x near b: projected gradient with momentum and restarts, from a proportional start."""
    gram, ab = a.T @ a, a.T @ b
    step = 1.0 / max(1e-9, np.linalg.norm(gram, 2))
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (gram @ y - ab))
        if (y - new) @ (new - x) > 0:
            t, y = 1.0, new
        else:
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, t = new + (t - 1) / t2 * (new - x), t2
        x = new
    return x


def plan_packing(histogram: np.ndarray, capacity: int, classes: int = 128, parts: int = 3) -> list[tuple[list[int], int]]:
    """(lengths of a sequence in order, number of such sequences) of a packing of ``histogram[length]`` pieces.

    Work and result are bounded by ``capacity``, not by the number of pieces.
    """
    full = [([capacity], int(histogram[capacity]))] if histogram[capacity] else []
    left = histogram.astype(np.int64).copy()
    left[capacity] = 0
    width = capacity / classes
    of_length = np.ceil(np.arange(capacity + 1) / width).astype(int)
    target = np.bincount(of_length, left, classes + 1)[1:]
    patterns = length_patterns(classes, parts)
    scale = max(1.0, target.max())
    repeats = np.floor(non_negative_least_squares(patterns.T, target / scale) * scale + 1e-6).astype(np.int64)
    # rounded with several measures of how open a pattern's sequence may stay: the plan with the fewest sequences
    plans = [_rounded(left.copy(), repeats, patterns, of_length, capacity, classes, open_by) for open_by in SLACKS]
    return full + min(plans, key=lambda plan: sum(number for _, number in plan))


#: Tokens by which a pattern's sequence may stay open; one that no last piece fills so far is left to the residuals.
SLACKS = (0, 1, 2, 4, 8, 32)


def _rounded(left: np.ndarray, repeats: np.ndarray, patterns: np.ndarray, of_length: np.ndarray, capacity: int, classes: int, slack: int) -> list[tuple[list[int], int]]:
    """A plan for the lengths ``left`` from repeat counts of patterns, with the residuals packed best fit."""
    spare = [[int(n) for n in np.flatnonzero(of_length == c) if left[n]] for c in range(classes + 1)]
    open_runs: dict[int, list[list]] = {}  # room -> runs of equal sequences that have it: [lengths, number]

    def close(lengths: list[int], number: int) -> None:
        open_runs.setdefault(capacity - sum(lengths), []).append([lengths, number])

    for k in np.argsort(-repeats):
        need = int(repeats[k])
        if need <= 0:
            break
        chosen = sorted((c + 1 for c in np.flatnonzero(patterns[k]) for _ in range(int(patterns[k][c]))), reverse=True)
        while need > 0:
            lengths: list[int] = []
            for c in chosen[:-1]:
                while spare[c] and not left[spare[c][-1]]:
                    spare[c].pop()
                best = next((n for n in reversed(spare[c]) if left[n] > lengths.count(n)), None)
                if best is None:
                    break
                lengths.append(best)
            if len(lengths) < len(chosen) - 1:
                break
            # the last place takes the longest piece that still fits; a sequence that stays too open is left to the residuals
            room = capacity - sum(lengths)
            last = next((n for n in range(room, max(0, room - slack - 1), -1) if left[n] > lengths.count(n)), None)
            if last is None:
                break
            lengths.append(last)
            number = min(need, *(int(left[n]) // lengths.count(n) for n in set(lengths)))
            for n in lengths:
                left[n] -= number
            need -= number
            close(lengths, number)

    # residuals, longest first, each into the smallest room that holds it; equal sequences are moved as one
    rooms = np.zeros(capacity + 1, np.int64)
    for room, runs in open_runs.items():
        rooms[room] = sum(r[1] for r in runs)
    for n in range(capacity, 0, -1):
        while left[n]:
            fit = np.flatnonzero(rooms[n:])
            if len(fit):
                room = int(fit[0]) + n
                lengths, number = open_runs[room][-1]
                each, moved = 1, min(number, int(left[n]))
                if number == 1 or left[n] >= 2 * number:  # as many of this length as the room takes
                    each = max(1, min(room // n, int(left[n]) // moved))
                if moved == number:
                    open_runs[room].pop()
                else:
                    open_runs[room][-1][1] -= moved
                rooms[room] -= moved
            else:
                lengths, room = [], capacity
                each = min(capacity // n, int(left[n]))
                moved = max(1, int(left[n]) // each)
            left[n] -= moved * each
            filled = [*lengths, *[n] * each]
            close(filled, moved)
            rooms[capacity - sum(filled)] += moved
    return [(lengths, number) for _, runs in sorted(open_runs.items()) for lengths, number in runs]


class Places:
    """Where the k-th piece of a length goes: runs of slots by length, searched by k."""

    def __init__(self, plan: list[tuple[list[int], int]]):
        runs: dict[int, list[tuple[int, int, int]]] = {}  # length -> (slots, first sequence, offset)
        first = 0
        for lengths, number in plan:
            at = 0
            for n in lengths:
                runs.setdefault(n, []).append((number, first, at))
                at += n
            first += number
        self.sequences = first
        self.runs = {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}
        self.ends = {n: np.cumsum(r[0]) for n, r in self.runs.items()}

    def of(self, length: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces numbered k (from 0) of a length."""
        run = np.searchsorted(self.ends[length], k, side="right")
        number, first, at = (x[run] for x in self.runs[length])
        return first + k - (self.ends[length][run] - number), at


LEAST_SALTS = 64
ROWS_PER_SALT = 1 << 20


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, classes: int = 128, parts: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents in few sequences of at most ``capacity`` tokens: a row for each piece with its sequence and offset.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty: one piece of one
    token. Repeated rows and equal ids are packed as often as they occur; null ids are kept. An empty table gives no
    pieces. Other columns are ignored. Pieces are numbered within their length by (salt, id, piece), so that no task
    holds all pieces of a length and a repeated task finds the same places.
    """
    pieces = materialise(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    salts = max(LEAST_SALTS, -(-pieces.count() // ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    cells = materialise(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "length-cells")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cells.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    places = docs.sparkSession.sparkContext.broadcast(Places(plan_packing(histogram, capacity, classes, parts)))

    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    in_cell = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("in_cell", in_cell).join(cells, ["length", "salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, k: pd.Series) -> pd.DataFrame:
        n, k = length.to_numpy(), k.to_numpy()
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else ():
            sequence[group], offset[group] = places.value.of(int(n[group[0]]), k[group])
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = numbered.withColumn("place", place(F.col("length"), F.col("before") + F.col("in_cell")))
    return placed.select("id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
