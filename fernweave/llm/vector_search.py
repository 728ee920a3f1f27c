"""Top-k inner-product search in blocks: what the nearest-neighbour and the exact search share.

Equal vectors are one class, searched once, with its least ids. Classes are dealt to shards and distinct query vectors
to blocks, both by hash and of bounded size; a task gets one shard and one block at a time, and each query's best of
all shards are merged. Nothing is sent whole to a task, whatever vectors or queries are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernweave.llm._common import materialise

#: shard rows, query rows, number of results -> scores and row numbers, both [queries, results]; -1 where there is none.
Search = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, zero_too: bool) -> DataFrame:
    """(vec_id, vector array<double>) of vectors that are not null, empty or hold null or non-finite components.

    Without ``zero_too``, zero vectors are left out as well.
    """
    picked = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = picked.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite)
    return kept if zero_too else kept.where(F.exists("vector", lambda x: x != 0))


def packed_vectors(usable: DataFrame, encode: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, int]:
    """(vec_id, vec binary) and the number of components; shorter vectors are filled up with zeros.

    encode makes an array of components the one whose bytes are stored.
    """
    size = usable.agg(F.max(F.size("vector"))).first()[0] or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            full = np.zeros((len(lengths), size))
            full[np.arange(size)[None] < lengths[:, None]] = flat
            rows = encode(full)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "vec"])

    return usable.mapInArrow(pack, "vec_id long, vec binary"), size


def vector_classes(packed: DataFrame, most: int) -> DataFrame:
    """(vec, ids): each distinct vector with its ``most`` smallest ids in order.

    Tasks hand on only the smallest ids of the vectors that they have seen, so a vector that fills a table moves little.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(ids)[:most] for ids in held.values()], pa.list_(pa.int64()))], names=["vec", "ids"])
            held.clear()
            return out

        for batch in batches:
            for one, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = held.setdefault(vec, [])
                ids.append(one)
                if len(ids) >= 4 * most + 64:
                    ids.sort()
                    del ids[most:]
            if len(held) >= 50_000:
                yield flush()
        if held:
            yield flush()

    told = packed.mapInArrow(smallest, "vec binary, ids array<long>")
    return told.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))


def top_k(packed: DataFrame, is_query: str, k: int, dtype: str, search: Search, shard_rows: int, block_rows: int, score_type: str = "double") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all other rows for each row that ``is_query`` names.

    Best first, ties to smaller ids. A query's own row is no candidate, but rows with equal vectors are; rows that
    repeat a query's id are no candidates for it, and an id that several query rows have is asked once,
    with the least of their vectors by bytes.
    """
    packed = materialise(packed, "vectors")
    classes = materialise(vector_classes(packed, k + 1), "vector-classes")
    queries = packed.where(is_query).select(F.col("vec_id").alias("query_id"), "vec").groupBy("query_id").agg(F.min("vec").alias("vec"))
    asked = materialise(queries.select("vec").distinct(), "query-vectors")
    shards, blocks = (max(1, -(-df.count() // rows)) for df, rows in ((classes, shard_rows), (asked, block_rows)))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "vec"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "vec"), F.lit(blocks)).cast("int")
    left = classes.withColumns({"shard": shard, "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = asked.withColumns({"block": block, "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})

    def run(own: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["vec", "score", "vec_id"]
        types = [pa.binary(), pa.float64() if score_type == "double" else pa.int64(), pa.int64()]
        if not own.num_rows or not wanted.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
        ids = own.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: ids[i])  # rows by smallest id: ties go to the row before
        vecs = own.column("vec").to_pylist()
        rows = np.frombuffer(b"".join([vecs[i] for i in order]), dtype).reshape(len(order), -1)
        keys = wanted.column("vec").to_pylist()
        scores, found = search(rows, np.frombuffer(b"".join(keys), dtype).reshape(len(keys), -1), k + 1)
        out: tuple[list, list, list] = [], [], []
        for key, own_scores, own_found in zip(keys, scores.tolist(), found.tolist(), strict=True):
            best = [(-s, i) for s, r in zip(own_scores, own_found, strict=True) if r >= 0 for i in ids[order[r]]]
            for s, i in sorted(best)[: k + 1]:
                out[0].append(key), out[1].append(-s), out[2].append(i)
        return pa.table({n: pa.array(c, t) for n, t, c in zip(names, types, out, strict=True)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, f"vec binary, score {score_type}, vec_id long")
    merged = found.withColumn("place", F.row_number().over(W.partitionBy("vec").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    answers = merged.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    own = queries.join(answers, "vec").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
