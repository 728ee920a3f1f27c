"""Token-id matrices: best-fit-decreasing packing with a segment tree over the room left.

Each task packs its own documents, a bounded number of tokens at a time, so there is no shuffle and no task holds more
than one such shard. Documents longer than a sequence are cut without loss: their pieces, in order, are the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fernweave.llm.packing import word_ids

#: Tokens that a task packs together; 16 Mi tokens are 64 MB and some thousand sequences.
SHARD_TOKENS = 1 << 24


class RoomTree:
    """Open sequences by the room they have left: a segment tree over 0..capacity that counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, room: int, sequence: int) -> None:
        self.at.setdefault(room, []).append(sequence)
        self._add(room, 1)

    def pop_best(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room of at least ``need``, taken out of the tree."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up, until a right neighbour has one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:  # down, to the leftmost
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers: the longest piece first, each where the least room is left that holds it."""
    tree, sequences = RoomTree(capacity), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        found = tree.pop_best(need)
        if found is None:
            found = capacity, len(sequences)
            sequences.append([])
        room, k = found
        sequences[k].append(piece)
        if room > need:
            tree.push(room - need, k)
    return sequences


MATRIX_SCHEMA = "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, segment_ids array<long>, segment_starts array<long>"


def token_matrices(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 49407, pad_id: int = 49407, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed rows of ``capacity`` token ids.

    A row is a sequence: ``input_ids`` are ``capacity`` little-endian unsigned 16-bit ids (``pad_id`` after
    ``n_tokens``), ``position_ids`` count from 0 again in each segment (0 in the padding), ``cu_seqlens`` are the bounds
    of the segments (0 first, ``n_tokens`` last), ``segment_ids`` the document of each segment and ``segment_starts``
    the tokens of that document before it. A document is its ids and ``end_id``; only longer ones are cut.

    Null and empty texts are a segment of ``end_id`` alone; a null id is a null in ``segment_ids``; repeated rows are
    packed as often as they occur; an empty table gives no rows; other columns are ignored. A vocabulary or id of more
    than 16 bits raises a ValueError. The numbers of sequences
    are those of the task and of the place in it.
    """
    if capacity > 1 << 16:
        raise ValueError("position ids are 16-bit: capacity can be at most 65536")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer_path)
        if max(len(table.ends) - 1, end_id, pad_id) >= 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        end = np.array([end_id], "<u2").tobytes()
        first = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        starts: list[int] = []
        data: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            lengths = np.fromiter(map(len, data), np.int64, len(data)) // 2
            sequences = best_fit_decreasing(lengths, capacity)
            for at in range(0, len(sequences), 256):
                some = sequences[at : at + 256]
                bounds = [np.concatenate([[0], np.cumsum(lengths[s])]).astype(np.int32) for s in some]
                matrix = np.full((len(some), capacity), pad_id, "<u2")
                places = np.zeros((len(some), capacity), "<u2")
                for row, (members, cut) in enumerate(zip(some, bounds, strict=True)):
                    matrix[row, : cut[-1]] = np.frombuffer(b"".join([data[p] for p in members]), "<u2")
                    places[row, : cut[-1]] = np.arange(cut[-1]) - np.repeat(cut[:-1], np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(first, first + len(some)), pa.int64()),
                        pa.array([int(b[-1]) for b in bounds], pa.int32()),
                        pa.array([r.tobytes() for r in matrix], pa.binary()),
                        pa.array([r.tobytes() for r in places], pa.binary()),
                        pa.array(bounds, pa.list_(pa.int32())),
                        pa.array([[ids[p] for p in s] for s in some], pa.list_(pa.int64())),
                        pa.array([[starts[p] for p in s] for s in some], pa.list_(pa.int64())),
                    ],
                    names=[f.split()[0] for f in MATRIX_SCHEMA.split(", ")],
                )
                first += len(some)
            ids.clear(), starts.clear(), data.clear()
            held = 0

        for batch in batches:
            for one, raw in zip(batch.column(0).to_pylist(), table.of(batch.column(1).to_pylist()), strict=True):
                short = np.frombuffer(raw, "<u4").astype("<u2").tobytes() + end
                for at in range(0, len(short), 2 * capacity):
                    ids.append(one), starts.append(at // 2), data.append(short[at : at + 2 * capacity])
                held += len(short) // 2
                if held >= shard_tokens:
                    yield from flush()
        yield from flush()

    picked = docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text_")
    return picked.mapInArrow(pack, MATRIX_SCHEMA)


def matrix_of(rows: list[bytes], capacity: int = 4096) -> np.ndarray:
    """Rows of ``input_ids`` or ``position_ids`` as one matrix."""
    return np.frombuffer(b"".join(rows), "<u2").reshape(-1, capacity)
