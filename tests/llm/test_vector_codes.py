"""Vector codes against brute force in Python integers and against their SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from fernweave.llm import queries, vector_codes

SMALL = "/root/testdata/sf0.001"


def brute(rows, parts, entries, rounds, scale):
    """Plain loops over Python integers: rows of (vec_id, vector, label) -> the operator's rows."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = -(-max([len(r[1]) for r in kept] + [1]) // parts) * parts
    width = size // parts
    whole = [[math.floor(v * scale) if abs(v) < 2**52 else int(v) * scale for v in list(r[1]) + [0.0] * (size - len(r[1]))] for r in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    book = [[part(v, p) for v in whole[:entries]] for p in range(parts)]
    near = lambda v, p: min(range(len(book[p])), key=lambda e: (far(part(v, p), book[p][e]), e))
    for _ in range(rounds):
        moved = [list(b) for b in book]
        for p in range(parts):
            mine = [near(v, p) for v in whole]
            for e in range(len(book[p])):
                if own := [part(v, p) for v, m in zip(whole, mine, strict=True) if m == e]:
                    moved[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
        book = moved
    out, by_label = [], {}
    for r, v in zip(kept, whole, strict=True):
        code = [near(v, p) for p in range(parts)]
        error = sum(far(part(v, p), book[p][c]) for p, c in enumerate(code))
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append([r[0], "".join(f"{c:02x}" for c in code), error, r[2]])
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    fit = lambda v: v if v < 2**63 else None
    whole_label = {k: all(r[2] < 2**63 for r in out if r[3] == k) for k in by_label}
    return sorted([(i, c, fit(e), fit(by_label[k]) if whole_label[k] else None, digest) for i, c, e, k in out], key=str)


def check(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = vector_codes.product_codes(frame, **kw)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, kw["parts"], kw["entries"], kw["rounds"], kw["scale"])


def test_codes_equal_brute_force_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist(), int(rng.integers(0, 3)) or None) for i in range(120)]  # coarse: many ties
    rows += [rows[5], rows[5], (None, [1.0] * 8, 2), (7, [2.5] * 8, 1), (300, None, 1), (301, [1.0, None] + [0.0] * 6, 1), (302, [math.nan] * 8, 1), (303, [math.inf] * 8, 1), (304, [1.5, -1.5], 1), (305, [], 9)]
    check(spark, rows, parts=4, entries=5, rounds=3, scale=2)
    check(spark, [(i, rng.normal(0, 0.2, 12).tolist(), 1) for i in range(90)], parts=4, entries=16, rounds=6, scale=4096)


def test_lengths_that_parts_do_not_divide_and_few_vectors(spark):
    check(spark, [(1, [0.5, 0.25, 1.0], 1), (2, [0.1] * 7, None)], parts=4, entries=16, rounds=2, scale=4096)
    assert vector_codes.product_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_integers_beyond_64_bits(spark):
    rows = [(i, [1e308 if i % 7 == 0 else float(i), -3e38 * (i % 3), 2.0**60 + i, 0.5], i % 2) for i in range(24)]
    check(spark, rows, parts=2, entries=4, rounds=3, scale=4096)


def test_screening_never_loses_the_nearest_entry():
    rng = np.random.default_rng(9)
    for size in (30, 3000, 10**6, 2**28):
        book = rng.integers(-size, size, (16, 8))
        book[7] = book[2]  # a tie
        x = np.concatenate([rng.integers(-size, size, (400, 8)), (book[rng.integers(0, 16, 400)] + book[rng.integers(0, 16, 400)]) // 2])  # half-way points
        far = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
        mask = vector_codes.overlapping(x.astype(float), book.astype(float))
        assert mask[np.arange(len(x)), far.astype(np.float64).argmin(axis=1)].all()
        assert all(mask[i][far[i] == far[i].min()].all() for i in range(len(x)))
        chosen, error = vector_codes.Codebooks([book.tolist()]).assign(x.astype(float), 1)
        assert chosen[:, 0].tolist() == [min(range(16), key=lambda e: (far[i, e], e)) for i in range(len(x))]
        assert error == far.min(axis=1).tolist()
    assert vector_codes.overlapping(x.astype(float), book.astype(float)).sum(axis=1).mean() < 3  # most entries are screened out


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        vector_codes.product_codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), scale=1000)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_vector_codes"]).fetchall()
    got = queries.QUERIES["op12_vector_codes"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(want)
