"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words and an end. A token is written in bits: one of the most frequent words by its
Huffman code, any other as an escape, its bytes and a stop, in a Huffman code of bytes. So a text's probability is the
product of its bits' probabilities, and those of all texts sum to 1 at most. Each bit has three predictions: by its place
in the code alone, and behind two contexts (for words the last very frequent word, and the word before; for bytes that word
with the two bytes before, and the three before), each a table of counts of 0 and 1 at a hash of context and place.

The predictions are mixed in the logistic domain. Weights are gated: by the kind and depth of the bit and by each
predictor's confidence. They are learned online, bit after bit, on training documents that the tables have not seen (one in
MIX_FOLD), and are refined adaptively while a text is scored: each run of STEPS bits has multipliers of its own that follow its
errors. A probability map, learned as well, corrects the result. Runs, not texts, go in lockstep through numpy, so a long
text costs no more than many short ones.

Everything is gathered from all training documents: counts of words (a table, joined), and the predictors' counts, which
tasks hand on by blocks and which are summed by block. A model holds ``most_words`` words and two tables of
2^``most_slots`` pairs of counts at most, whatever the input; the words beyond are scored by their bytes and counted by a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweave.llm._common import lean, materialise
from fernweave.llm.shingles import CHUNK, mix, word_hashes

_U, _V = np.uint64, np.uint32
#: The identity of the end of a text; words have others.
END = 1
#: Bits of a run, which has its own multipliers; words that count as very frequent; one training document in so many fits the mixer.
STEPS, FREQUENT, MIX_FOLD = 512, 32, 32
#: Predictions of a bit, gates, classes of confidence, cells of the probability map.
INPUTS, GATES, CLASSES, CELLS = 3, 6, 16, 64
#: Occurrences from which a word is in the lexicon.
LEAST = 2
#: Units (words or bytes) written in bits at once.
UNITS = 1 << 17
#: Counters of one row on its way to the sums; partial sums that meet in one step of the tree.
BLOCK, FAN = 1 << 13, 64
#: Steps of the mixed logit in which probabilities are told.
FINE = 1 << 12
#: Step of the stored logits, bounds of the mixed ones, rates of learning.
GRAIN, MOST, RATE, OWN_RATE = 0.08, 9.0, 0.05, 0.08
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


def for_mixing(doc_id: Column) -> Column:
    """Training documents that fit the mixer and not the tables."""
    return F.pmod(F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|mix"))), F.lit(MIX_FOLD)) == 0


def prefix_code(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a canonical Huffman code; light symbols weigh a 2^20th at least, so that codes stay below 32 bits."""
    heap = [(max(float(w), 1.0, float(weights.sum()) / (1 << 20)), k) for k, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    parent = [0] * (2 * len(heap) - 1)
    for node in range(len(heap), len(parent)):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left] = parent[right] = node
        heapq.heappush(heap, (a + b, node))
    depth = [0] * len(parent)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    lengths = np.array(depth[: len(weights)], np.int64)
    order = np.argsort(lengths, kind="stable")
    values, code, before = np.zeros(len(weights), np.uint32), 0, 0
    for k in order.tolist():
        code <<= int(lengths[k]) - before
        values[k], before = code, int(lengths[k])
        code += 1
    return values, lengths


class Lexicon:
    """The most frequent words with their counts and codes: symbol 0 is the end, 1 the escape, others are words by rank."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, weights: np.ndarray, letters: np.ndarray):
        """ids: the words by falling weight; counts, weights: of all symbols, in all training and in what the tables see.

        letters: counts of bytes, then of stops.
        """
        order = np.argsort(ids)
        self.ids, self.symbols = ids[order], (order + 2).astype(np.int32)
        self.counts, self.weights, self.letters = counts, weights, letters
        self.values, self.lengths = prefix_code(weights)
        self.letter_values, self.letter_lengths = prefix_code(letters)
        self.least = int(weights[2:].min(initial=1 << 62))
        #: Where the words begin whose identities have the same high bits; hashes fall evenly, so few share them.
        self.first = np.searchsorted(self.ids, np.arange(1 << 19, dtype=np.uint64) << _U(45)).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(ids))).max(initial=0))

    def symbols_of(self, ids: np.ndarray) -> np.ndarray:
        """The symbol of each word, 1 for those beyond."""
        out = np.where(ids == _U(END), np.int32(0), np.int32(1))
        at = self.first.take((ids >> _U(45)).astype(np.int64)) if len(self.ids) else np.zeros(len(ids), np.int32)
        for step in range(self.most):
            found = np.flatnonzero(self.ids.take(at + step, mode="clip") == ids)
            out[found] = self.symbols.take(at[found] + step, mode="clip")
        return out


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about CHUNK bytes, cut at white space; contexts begin anew with a part."""
    while len(raw) > CHUNK:
        gaps = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, CHUNK)])
        if not len(gaps):
            gaps = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8)])[:1]
            if not len(gaps):
                break
        yield raw[: int(gaps[-1]) + 1]
        raw = raw[int(gaps[-1]) + 1 :]
    yield raw


class Tokens:
    """Words of some parts of texts, each text's last part with its end behind it."""

    def __init__(self, parts: list[tuple[bytes, bool]]):
        self.raw = np.frombuffer(b" ".join(p for p, _ in parts) + b" ", np.uint8).copy()
        upper = (self.raw >= 65) & (self.raw <= 90)
        self.raw[upper] += np.uint8(32)
        hashes, starts = word_hashes(self.raw, _values(), _SPACE)
        words = np.where(hashes == _U(END), _U(END + 1), hashes)
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) + 1 for p, _ in parts])]))
        ends = np.array([last for _, last in parts])
        count = np.diff(bounds) + ends
        self.part = np.repeat(np.arange(len(parts)), count)
        self.ids = np.full(len(self.part), _U(END))
        self.starts = np.full(len(self.part), -1, np.int64)
        is_end = np.zeros(len(self.part), bool)
        is_end[np.cumsum(count)[ends] - 1] = True
        self.ids[~is_end], self.starts[~is_end] = words, starts
        #: Bytes of each part's words, and one for each word or end.
        self.sizes = np.array([len(p) + 1 for p, _ in parts]) - np.add.reduceat(_SPACE[self.raw], np.cumsum([0, *(len(p) + 1 for p, _ in parts[:-1])])) + count
        #: Places of the words in their part, 0 for the first: contexts do not look behind it.
        self.place = np.arange(len(self.part)) - np.repeat(np.cumsum(count) - count, count)


def _values() -> np.ndarray:
    value = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    value[_SPACE] = 0
    return value


def _tokens(texts: Iterator[str | bytes | None]) -> Iterator[tuple[Tokens, list[int]]]:
    """Tokens of about CHUNK bytes of texts at a time, and which text each part belongs to."""
    held: list[tuple[bytes, bool]] = []
    owner: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        parts = list(_parts(text or b""))
        for j, part in enumerate(parts):
            if held and size + len(part) > CHUNK:
                yield Tokens(held), owner
                held, owner, size = [], [], 0
            held.append((part, j == len(parts) - 1))
            owner.append(k)
            size += len(part) + 1
    if held:
        yield Tokens(held), owner


def _behind(values: np.ndarray, place: np.ndarray, far: int) -> np.ndarray:
    """The value ``far`` places before each one, 0 where its part has none."""
    out = np.zeros_like(values)
    out[far:] = values[:-far] if far < len(values) else 0
    out[place < far] = 0
    return out


class Units:
    """What a sequence of tokens is written in: codes of words and, behind escapes, of bytes; each with its contexts."""

    def __init__(self, tokens: Tokens, symbols: np.ndarray, lexicon: Lexicon):
        short = (tokens.ids >> _U(32)).astype(_V) | _V(1)
        escaped = np.flatnonzero((symbols == 1) & (tokens.starts >= 0))
        edges = np.flatnonzero(_SPACE[tokens.raw])
        stops = edges[np.searchsorted(edges, tokens.starts[escaped])]
        letters = stops - tokens.starts[escaped] + 1
        extra = np.zeros(len(symbols), np.int64)
        extra[escaped] = letters
        at = np.cumsum(1 + extra) - (1 + extra)  # where each token's own unit stands
        n = int((1 + extra).sum())
        self.part = np.repeat(tokens.part, 1 + extra)
        self.value, self.length = np.zeros(n, np.uint32), np.zeros(n, np.int64)
        self.value[at], self.length[at] = lexicon.values[symbols], lexicon.lengths[symbols]
        self.kind = np.ones(n, np.uint8)
        self.kind[at] = 0
        self.contexts = [np.zeros(n, _V) for _ in range(INPUTS - 1)]
        frequent = np.where((symbols > 1) & (symbols < FREQUENT + 2), np.arange(len(symbols)), -1)
        latest = np.maximum.accumulate(frequent)
        before = np.concatenate([[-1], latest[:-1]])[: len(latest)]
        same = (before >= 0) & (before >= np.arange(len(symbols)) - tokens.place)
        self.contexts[0][at] = np.where(same, short[np.maximum(before, 0)], _V(0)) * _V(0x2C1B3C6D) + _V(1)
        self.contexts[1][at] = _behind(short, tokens.place, 1) * _V(0x297A2D39) + _V(2)
        spelt = np.flatnonzero(self.kind)
        if len(spelt):
            first = np.repeat(np.cumsum(letters) - letters, letters)
            place = np.arange(len(spelt)) - first
            source = np.repeat(tokens.starts[escaped], letters) + place
            last = place == np.repeat(letters - 1, letters)
            byte = np.where(last, 256, tokens.raw[source].astype(np.int64))
            self.value[spelt], self.length[spelt] = lexicon.letter_values[byte], lexicon.letter_lengths[byte]
            c = byte.astype(_V) + _V(1)
            b1, b2, b3 = (_behind(c, place, k) for k in (1, 2, 3))
            near = np.repeat(np.where(same, short[np.maximum(before, 0)], _V(0))[escaped], letters)
            two_bytes = b1 << _V(9) ^ b2
            self.contexts[0][spelt] = (two_bytes * _V(0x7FEB352D) ^ near) * _V(0x9E3779B1) + _V(0x51ED270B)
            self.contexts[1][spelt] = (two_bytes << _V(9) ^ b3) * _V(0x846CA68B) + _V(0x68E31DA5)
        for c in self.contexts:
            c ^= c >> _V(15)
            c *= _V(0x846CA68B)
            c ^= c >> _V(13)

    def __len__(self) -> int:
        return len(self.value)


class Decisions:
    """The bits of some units, each with its place in the code and the counter of each context."""

    def __init__(self, value: np.ndarray, length: np.ndarray, kind: np.ndarray, contexts: list[np.ndarray | None], log: int):
        """A counter for each context; None is the place in the code alone."""
        lines = (length + 3) // 4
        unit = np.repeat(np.arange(len(value)), lines)
        group = np.arange(len(unit)) - (np.cumsum(lines) - lines).take(unit)
        shift = length.take(unit) - 4 * group
        whole, kinds = value.take(unit), kind.take(unit)
        prefix = ((_V(1) << (4 * group).astype(_V)) | (whole >> shift.astype(_V))) * _V(0x9E3779B1) + kinds
        bits = np.minimum(shift, 4)
        # each line holds the bits behind one prefix of the code: 15 places, by the bits before within the line
        four = (whole >> (shift - bits).astype(_V)) & ((_V(1) << bits.astype(_V)) - _V(1))
        gate = np.where(kinds == 1, 5, np.minimum(group, 4))
        packed = np.repeat(((four | (_V(1) << bits.astype(_V))) | (bits << 5) | (gate << 8)).astype(np.uint16), bits)
        left = np.repeat(np.cumsum(bits, dtype=np.int32), bits) - np.arange(1, len(packed) + 1, dtype=np.int32)  # bits of the line behind this one
        marked = (packed & np.uint16(31)) >> left.astype(np.uint16)  # 1, the bits before, the bit
        self.bit = (marked & np.uint16(1)).astype(np.uint8)
        local = (marked >> np.uint16(1)).astype(np.int64)
        self.gate = (packed >> np.uint16(8)).astype(np.int64)
        down = _V(32 - (log - 4))
        self.slots = []
        for context in contexts:
            base = prefix
            if context is not None:
                own = context.take(unit)
                base = (prefix ^ own) + own
            base = base ^ (base >> _V(16))
            base = base * _V(0x85EBCA6B)
            base = base ^ (base >> _V(13))
            base = (((base * _V(0xC2B2AE35)) >> down) << _V(4)).astype(np.int64)
            self.slots.append(np.repeat(base, bits) | local)
        self.count = np.add.reduceat(bits, np.cumsum(lines) - lines) if len(unit) else np.zeros(0, np.int64)  # bits of each unit


def decisions(units: Units, log: int, alone: bool = True) -> Iterator[tuple[np.ndarray, Decisions]]:
    """Bits of about UNITS units at a time, with the parts that they are of and the number of each one's bits.

    alone: with the counter of the place in the code alone before those of the contexts. Parts stay whole or are cut at UNITS
    units of their own, so a text is always written in the same pieces.
    """
    edges = np.flatnonzero(np.concatenate([[True], units.part[1:] != units.part[:-1]])).tolist() + [len(units)]
    cuts, start = [], 0
    for a, b in zip(edges, edges[1:], strict=False):
        if b - start > UNITS and a > start:
            cuts.append((start, a))
            start = a
        while b - start > UNITS:
            cuts.append((start, start + UNITS))
            start += UNITS
    for a, b in [*cuts, (start, len(units))]:
        s = slice(a, b)
        d = Decisions(units.value[s], units.length[s], units.kind[s], [*([None] if alone else []), *(c[s] for c in units.contexts)], log)
        own = units.part[s]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        d.sizes = np.add.reduceat(d.count, first) if len(own) else first
        yield own[first], d


def states(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Counts as states of 16 bits: the logit in GRAINs, and the class of confidence (how many counts, and whether all agree)."""
    n = zeros + ones
    logit = np.log((ones + 0.3) / (zeros + 0.3))
    size = np.searchsorted([1, 2, 3, 6, 20, 100, 1000], n, side="right")
    sure = (zeros == 0) | (ones == 0)
    return ((np.clip(np.rint(logit / GRAIN), -127, 127).astype(np.int16).astype(np.int64) & 255) | ((size + 8 * sure) << 8)).astype(np.uint16)


#: The logit of each state.
_LOGITS = np.tile(np.arange(256).astype(np.uint8).view(np.int8).astype(np.float32) * np.float32(GRAIN), CLASSES)


class Mixer:
    """Gated weights by gate, predictor and class, and a map from mixed logits to probabilities for each gate."""

    def __init__(self) -> None:
        self.weights = np.full((GATES, INPUTS, CLASSES), 0.4, np.float32)
        self.weights[:, 0] = 0.5
        self.weights[:, :, [0, 8]] = 0.0  # no counts
        centres = (np.arange(CELLS) + 0.5) * (2 * MOST / CELLS) - MOST
        self.map = np.repeat((1 / (1 + np.exp(-centres)))[None], GATES, axis=0).astype(np.float32)


    def costs(self) -> np.ndarray:
        """log2 of the probability of a 0 and of a 1 by gate and FINE steps of the mixed logit: its own and the map's, in halves."""
        logit = (np.arange(FINE) + 0.5) * (2 * MOST / (FINE - 1)) - MOST
        p = 0.5 / (1 + np.exp(-logit)) + 0.5 * self.map[:, _cell(logit)].astype(np.float64)
        return np.log2(np.stack([1 - p, p], axis=1)).ravel()


def _cell(mixed: np.ndarray) -> np.ndarray:
    return np.clip(((mixed + np.float32(MOST)) * np.float32(CELLS / (2 * MOST))).astype(np.int64), 0, CELLS - 1)


class Model:
    """Everything that scoring needs; a broadcast of bounded size."""

    def __init__(self, lexicon: Lexicon, log: int, tables: list[np.ndarray], total: int, distinct: int, mixer: Mixer):
        self.lexicon, self.log, self.tables, self.total, self.distinct, self.mixer = lexicon, log, tables, total, distinct, mixer

    def inputs(self, d: Decisions) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each predictor its logits and the numbers of its weights."""
        logits, cells = [], []
        for k, slots in enumerate(d.slots):
            state = self.tables[k].take(slots)
            logits.append(_LOGITS.take(state))
            cells.append((d.gate * INPUTS + k) * CLASSES + (state >> np.uint16(8)))
        return logits, cells

    def weighted(self) -> list[np.ndarray]:
        """For each predictor its weighted logit by gate and state."""
        return [(self.mixer.weights[:, k, np.arange(CLASSES << 8) >> 8] * _LOGITS).ravel() for k in range(INPUTS)]


def runs_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bit and length of each run: bits of one part, STEPS at most; the longest first. lengths: bits of the parts."""
    edges = np.cumsum(lengths) - lengths
    pieces = -(-lengths // STEPS)
    within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(edges, pieces) + within * STEPS
    size = np.minimum(STEPS, np.repeat(edges + lengths, pieces) - first)
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def score_bits(model: Model, d: Decisions) -> np.ndarray:
    """log2 of the probability of each bit."""
    gate = d.gate * (CLASSES << 8)
    inputs = [own.take(gate + model.tables[k].take(slots, mode="clip"), mode="clip") for k, (slots, own) in enumerate(zip(d.slots, model.weighted(), strict=True))]
    first, size = runs_of(d.sizes)
    flat = np.zeros(len(d.bit), np.float32)
    for most in (STEPS, STEPS // 8, STEPS // 64):  # runs of about one length together
        a, b = np.searchsorted(-size, [-most, -(most // 8) if most > STEPS // 64 else 0], side="left")
        if b > a:
            _lockstep(inputs, d.bit, first[a:b], size[a:b], flat)
    flat += np.float32(MOST)
    flat *= np.float32((FINE - 1) / (2 * MOST))
    return model.mixer.costs().take(flat.astype(np.int64) + d.gate * (2 * FINE) + d.bit * np.int64(FINE), mode="clip")


def _lockstep(inputs: list[np.ndarray], bit: np.ndarray, first: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
    """Mixed logits of runs, the longest first, each with multipliers that follow its errors.

    Inputs and sums are held with the other sign, so that a step needs no negation.
    """
    steps, rate, one = int(size[0]), np.float32(OWN_RATE), np.float32(1)
    lanes = np.searchsorted(-size, -np.arange(steps), side="left").tolist()  # runs that are longer than t come first
    place = np.minimum(first[None] + np.arange(steps)[:, None], len(bit) - 1)
    x = np.empty((steps, len(inputs), len(first)), np.float32)
    for k, column in enumerate(inputs):
        np.negative(column.take(place, mode="clip"), out=x[:, k])
    want = bit.take(place, mode="clip") * rate
    mixed = np.zeros(place.shape, np.float32)
    own = np.ones((len(inputs), len(first)), np.float32)
    with np.errstate(over="ignore"):  # beyond 88 the exponential is infinite and the prediction 0
        for t, n in enumerate(lanes):
            row, mine, dot = x[t, :, :n], own[:, :n], mixed[t, :n]
            np.add.reduce(row * mine, axis=0, out=dot)
            error = np.exp(dot)
            error += one
            np.divide(rate, error, out=error)
            np.subtract(want[t, :n], error, out=error)
            row *= error
            mine -= row
    np.negative(mixed, out=mixed)
    np.clip(mixed, -MOST, MOST, out=mixed)
    full = int(np.searchsorted(-size, -steps, side="right"))
    out[place[:, :full]] = mixed[:, :full]
    used = np.arange(steps)[:, None] < size[None, full:]
    out[place[:, full:][used]] = mixed[:, full:][used]


def learn(mixer: Mixer, model: Model, d: Decisions, spent: np.ndarray, visits: np.ndarray, seen: np.ndarray) -> None:
    """One pass of online learning over some bits, in lockstep; seen counts zeros and ones by cell of the map."""
    logits, cells = model.inputs(d)
    weights = mixer.weights.reshape(-1)
    first, size = runs_of(d.sizes)
    lanes = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for t, n in enumerate(lanes.tolist()):
        at = first[:n] + t
        x, w = np.stack([c[at] for c in logits]), np.stack([c[at] for c in cells])
        dot = np.clip((weights[w] * x).sum(axis=0), -MOST, MOST)
        bit = d.bit[at]
        slope = (bit - 1 / (1 + np.exp(-dot))) * x
        step = np.bincount(w.ravel(), slope.ravel(), len(weights))
        spent += step * step
        weights += (RATE * step / np.sqrt(spent + 1.0)).astype(np.float32)
        visits += np.bincount(w.ravel(), minlength=len(weights))
        np.add.at(seen, (bit.astype(np.int64), d.gate[at], _cell(dot.astype(np.float32))), 1)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def count_tokens(texts: DataFrame) -> DataFrame:
    """(kind, id, n, own) of texts (text, mixing): counts of words and ends (kind 0), and of bytes and stops in words (kind 1).

    own: the part of n in texts that are not for mixing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}
        letters = np.zeros(257, np.int64)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for mixing, found in held.items():
                if found:
                    ids, inverse = np.unique(np.concatenate([h[0] for h in found]), return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([h[1] for h in found]), len(ids)).astype(np.int64)
                    yield _count_rows(0, ids.view(np.int64), n, np.zeros_like(n) if mixing else n)
                    found.clear()

        for batch in batches:
            texts_, flags = _texts(batch, 0), batch.column(1).to_pylist()
            for mixing, found in held.items():
                for tokens, _ in _tokens(t for t, flag in zip(texts_, flags, strict=True) if flag == mixing):
                    found.append(np.unique(tokens.ids, return_counts=True))
                    size += len(found[-1][0])
                    if not mixing:
                        bytes_ = np.bincount(tokens.raw, minlength=256)
                        bytes_[_SPACE] = 0
                        letters[:256] += bytes_
                        letters[256] += int((tokens.starts >= 0).sum())
            if size > 1 << 20:
                yield from flush()
                size = 0
        yield from flush()
        yield _count_rows(1, np.arange(257), letters, letters)

    return texts.mapInArrow(lean(count), "kind int, id long, n long, own long").groupBy("kind", "id").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def _count_rows(kind: int, ids: np.ndarray, *n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind), pa.int32()), pa.array(ids, pa.int64()), *(pa.array(v, pa.int64()) for v in n)], names=["kind", "id", "n", "own"][: 2 + len(n)])


def lexicon_of(counts: DataFrame, most_words: int) -> tuple[Lexicon, int, int]:
    """The lexicon of the most frequent words of texts that are not for mixing, and how many training tokens and distinct ones there are.

    A word is in it from LEAST occurrences on, so that escapes are as likely there as words never seen are elsewhere.
    """
    words = counts.where(F.col("kind") == 0)
    total, distinct, own = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum("own"), F.lit(0))).first()
    top = words.where((F.col("id") != END) & (F.col("own") >= LEAST)).orderBy(F.desc("own"), "id").limit(most_words).toArrow()
    ids, n, weights = (top.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "own"))
    end = words.where(F.col("id") == END).first()
    end_n, end_own = (end.n, end.own) if end else (0, 0)
    letters = np.ones(257, np.int64)
    for r in counts.where(F.col("kind") == 1).collect():  # a row for each byte
        letters[r.id] += r.n
    return Lexicon(ids.view(np.uint64), np.concatenate([[end_n, 0], n]), np.concatenate([[end_own, own - end_own - int(weights.sum())], weights]), letters), total, distinct


def count_bits(texts: DataFrame, lexicon: Broadcast, log: int) -> list[np.ndarray]:
    """The states of the context tables, counted over all texts."""
    half = BLOCK // 2  # slots of a block: a count of zeros and one of ones each

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Lexicon = lexicon.value
        total = np.zeros((INPUTS - 1) << (log + 1), np.uint32)
        size = 0
        for batch in batches:
            for tokens, _ in _tokens(_texts(batch, 0)):
                units = Units(tokens, own.symbols_of(tokens.ids), own)
                for _, d in decisions(units, log, alone=False):
                    for k in range(INPUTS - 1):
                        np.add.at(total, ((k << (log + 1)) + 2 * d.slots[k]) + d.bit, np.uint32(1))
                    size += len(d.bit)
                if size > 1 << 31:  # before a counter could pass 32 bits
                    yield from _counter_rows(total)
                    total[:] = 0
                    size = 0
        yield from _counter_rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in _added(batches):
            yield from _counter_rows(total, block)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in _added(batches):
            yield _rows([block], [states(total[::2], total[1::2]).tobytes()], [b""], [b""])

    rows = texts.mapInArrow(lean(count), _COUNTERS)
    tasks = rows.rdd.getNumPartitions()
    while tasks > FAN:
        rows = rows.withColumn("group", (F.spark_partition_id() / FAN).cast("int")).repartition("block", "group").drop("group").mapInArrow(lean(add), _COUNTERS)
        tasks = -(-tasks // FAN)
    found = rows.repartition("block").mapInArrow(lean(add_up), _COUNTERS).select("block", "low").toArrow()  # a state for each counter of the tables
    tables = np.zeros((INPUTS - 1) << log, np.uint16)
    for block, state in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        tables[block * half : (block + 1) * half] = np.frombuffer(state.as_buffer(), np.uint16)
    return list(tables.reshape(INPUTS - 1, -1))


_COUNTERS = "block long, low binary, places binary, high binary"


def _rows(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "low", "places", "high"])


def _counter_rows(total: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Blocks of counters: their low bytes, and what is above a byte where there is any."""
    for a in range(0, len(total), BLOCK):
        own = total[a : a + BLOCK]
        if own.any():
            high = own >> np.uint8(8)
            places = np.flatnonzero(high)
            yield _rows([first + a // BLOCK], [(own & own.dtype.type(255)).astype(np.uint8).tobytes()], [places.astype("<u2").tobytes()], [high[places].astype("<i8").tobytes()])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of the blocks of a task, whose rows are read one by one."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, low, places, high in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            total = held.setdefault(block, np.zeros(BLOCK, np.int64))
            total += np.frombuffer(low, np.uint8)
            total[np.frombuffer(places, "<u2")] += np.frombuffer(high, "<i8") << 8
    yield from sorted(held.items())


def first_table(lexicon: Lexicon, log: int) -> np.ndarray:
    """States of bits by their place in the codes alone, from the counts of words and bytes."""
    counts = np.zeros(2 << log, np.int64)
    for kind, values, lengths, n in ((0, lexicon.values, lexicon.lengths, lexicon.weights), (1, lexicon.letter_values, lexicon.letter_lengths, lexicon.letters)):
        d = Decisions(values, lengths, np.full(len(values), kind, np.uint8), [None], log)
        np.add.at(counts, 2 * d.slots[0] + d.bit, np.repeat(n, d.count))
    return states(counts[::2], counts[1::2])


def fit_mixer(texts: DataFrame, model: Broadcast) -> Mixer:
    """Weights and map: tasks learn online from their own texts, and weights are averaged by how often each was used.

    Weights travel as integers, so their mean does not depend on the order in which tasks end; it does depend on how the texts
    are dealt to tasks. Without texts the mixer keeps its first weights.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        mixer = Mixer()
        cells = mixer.weights.size
        spent, visits, seen = np.zeros(cells), np.zeros(cells, np.int64), np.zeros((2, GATES, CELLS), np.int64)
        for batch in batches:
            for tokens, _ in _tokens(_texts(batch, 0)):
                for _, d in decisions(Units(tokens, own.lexicon.symbols_of(tokens.ids), own.lexicon), own.log):
                    learn(mixer, own, d, spent, visits, seen)
        used = np.flatnonzero(visits)
        scaled = np.rint(mixer.weights.ravel()[used].astype(np.float64) * 4096).astype(np.int64) * visits[used]
        yield _count_rows(0, used, scaled)
        yield _count_rows(1, used, visits[used])
        yield _count_rows(2, np.arange(seen.size), seen.ravel())

    found = texts.mapInArrow(lean(work), "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).collect()  # a row for each weight and cell
    mixer = Mixer()
    sums = {k: np.zeros(size, np.float64) for k, size in enumerate((mixer.weights.size, mixer.weights.size, 2 * mixer.map.size))}
    for r in found:
        sums[r.kind][r.id] = r.n
    learned = sums[1] > 0
    mixer.weights.reshape(-1)[learned] = (sums[0][learned] / sums[1][learned] / 4096).astype(np.float32)
    zeros, ones = sums[2].reshape(2, GATES, CELLS)
    mixer.map = ((ones + 8 * mixer.map) / (zeros + ones + 8)).astype(np.float32)
    return mixer


def fit_model(docs: DataFrame, id_col: str, text_col: str, most_words: int, most_slots: int) -> tuple[Model, DataFrame]:
    """The model of the training documents, and the counts of all their tokens as a table."""
    spark = docs.sparkSession
    doc_id = F.col(f"`{id_col}`")
    training = docs.where(~held_out(doc_id))
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    counts = materialise(count_tokens(training.select(text, for_mixing(doc_id).alias("mixing"))), "token-counts")
    lexicon, total, distinct = lexicon_of(counts, most_words)
    log = min(most_slots, max(14, (total + 1).bit_length()))  # counters follow the corpus, up to the bound
    shared = spark.sparkContext.broadcast(lexicon)
    tables = count_bits(training.where(~for_mixing(doc_id)).select(text), shared, log)
    model = Model(lexicon, log, [first_table(lexicon, log), *tables], total, distinct, Mixer())
    sent = spark.sparkContext.broadcast(model)
    model.mixer = fit_mixer(training.where(for_mixing(doc_id)).select(text), sent)
    sent.unpersist()
    shared.unpersist()
    return model, counts


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, most_words: int = 1 << 18, most_slots: int = 22) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    score: the model's log10 probability of the text; bits_per_byte: its bits over the bytes of the words and one for each
    end; base_score: the same by counts of tokens with one added. A null text is an empty one, which is its end alone; a null
    id counts as an empty one; repeated rows are scored, and learned from, row by row; an empty table gives no rows, and without
    training documents all counts are 0. Extra columns are ignored.
    """
    spark = docs.sparkSession
    model, counts = fit_model(docs, id_col, text_col, most_words, most_slots)
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        logs = np.log10(own.lexicon.counts + 1.0)
        base = float(np.log10(own.total + own.distinct + 1.0))
        for batch in batches:
            texts = _texts(batch, 2)
            n = len(texts)
            tokens_of, known, spare, bits, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            beyond: list[list[np.ndarray]] = [[] for _ in range(n)]
            for tokens, owner in _tokens(texts):
                of = np.array(owner)
                symbols = own.lexicon.symbols_of(tokens.ids)
                text = of[tokens.part]
                tokens_of += np.bincount(text, minlength=n)
                inside = symbols != 1
                known += np.bincount(text[inside & (own.lexicon.counts[symbols] > 0)], minlength=n)
                spare += np.bincount(text[inside], logs[symbols[inside]], n)
                away = np.flatnonzero(~inside)
                for part in np.unique(text[away]).tolist():
                    beyond[part].append(tokens.ids[away[text[away] == part]])
                for part, d in decisions(Units(tokens, symbols, own.lexicon), own.log):
                    if len(part):
                        bits -= np.bincount(of[part], np.add.reduceat(score_bits(own, d).astype(np.float64), np.cumsum(d.sizes) - d.sizes), n)
                size += np.bincount(of, tokens.sizes, n).astype(np.int64)
            rows = [np.unique(np.concatenate(b), return_counts=True) if b else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for b in beyond]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]), pa.int32())
            ids = pa.array(np.concatenate([r[0] for r in rows]).view(np.int64) if rows else [], pa.int64())
            times = pa.array(np.concatenate([r[1] for r in rows]) if rows else [], pa.int64())
            columns = [pa.array(v) for v in (tokens_of, known, spare - tokens_of * base, -bits * np.log10(2.0), bits / size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, times)], names=[*names, "ids", "times"])

    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]
    doc_id = F.col(f"`{id_col}`")
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double, ids array<long>, times array<long>"
    scored = docs.select(doc_id.alias("id"), held_out(doc_id).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(lean(work), schema)
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "token-scores")  # numbered once, as they are written
    away = scored.select("row", F.explode(F.arrays_zip("ids", "times")).alias("w")).select("row", F.col("w.ids").alias("id"), F.col("w.times").alias("times"))
    rest = counts.where((F.col("kind") == 0) & (F.col("own") <= model.lexicon.least)).select("id", "n")  # the lexicon has the others
    found = away.join(rest, "id").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("gain"))
    none = F.lit(0)
    return scored.join(found, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", none)).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    )
