"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source gets a target in words. A document of a source with rate ``r = target / source size`` is expected
``r`` times. Documents of a source lie in the order (size, salt, id, digest of id and text), the salt from the digest; ``r`` times the place in that order is the prefix
sum of the expected copies, one random offset is added, and a document is emitted once for each integer that its step
of the prefix sum crosses. Because the order is by size, any stretch of similar sizes gets its share, so the words
taken come near the target.

Places are found without putting a source in one task: documents are counted by (source, size, salt), those counts are
summed by (source, size) and by (source, size band), and each level is a short window over the one above. Only the last
window sees documents, and it holds one (source, size, salt) cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernweave.llm._common import WORD_REGEX, materialise

#: Rows that one salt of a (source, size) cell stands for at most, on the average.
ROWS_PER_SALT = 1 << 20
LEAST_SALTS = 64


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key that is never null and sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(key, source_size) -> target double and rate double.

    Sources in code-point order, null last, take the weights in turn. Shares of the total above ``most`` times the
    source's size are cut and reshared by weight until none is above. That end state is ``min(most * size, level *
    weight)`` for one level, found from sums over the sources ordered by the level at which each is full. The table has
    a row for each source, so its windows are over the list of sources, never over documents.
    """
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    place = F.row_number().over(W.orderBy("key")) - 1
    listed = sizes.select("key", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")).alias("weight"))
    listed = listed.withColumns({"cap": (most * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(everything).cast("double")})
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before, onward = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    # with all sources before this one full, the level of the rest:
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = listed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(0.0)
    return levels.select("key", "source_size", target.alias("target"), rate.alias("rate"))


def source_offset(key: Column, seed: int) -> Column:
    """The one random number in [0, 1) of a source: from its key and the seed, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17, keep_rows: bool = False) -> DataFrame:
    """Copies of each document in a mix whose sources have shares of all words by weight.

    Returns a row for each row of ``docs``: id, source, size, source_size, target, copies, taken (= copies * size), and
    with ``keep_rows`` the whole row as struct ``row``. No document has more than ``most`` copies.

    Null and empty texts have size 0 and take nothing. A null source is a source of its own, last in the order. Null
    ids come first in the order. Repeated rows are documents like any other; rows that are equal in id and text may
    change places with each other, but no others. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    said = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    digest = F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long").alias("digest")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), source_key(F.col(f"`{source_col}`")).alias("key"), digest, word_count(F.col(f"`{text_col}`")).alias("size"), *[row] * keep_rows)
    slim = materialise(picked.select("id", "key", "size", "digest"), "mix-sizes")
    salts = max(LEAST_SALTS, -(-slim.count() // ROWS_PER_SALT))
    band = F.floor(F.log2(F.col("size") + F.lit(1.0)) * 8).cast("int").alias("band")
    salt = F.pmod("digest", F.lit(salts)).cast("int").alias("salt")

    cells = materialise(slim.groupBy("key", "size", salt).agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    lines = cells.groupBy("key", "size", band).agg(F.sum("n").alias("n"))
    bands = lines.groupBy("key", "band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    sizes = bands.groupBy("key").agg(F.sum("words").alias("source_size"))

    def before(by: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    bands = bands.select("key", "band", before(["key"], "band").alias("bands_before")).join(source_targets(sizes, weights, most), "key")
    lines = lines.select("key", "size", "band", before(["key", "band"], "size").alias("lines_before")).join(bands, ["key", "band"])
    cells = cells.select("key", "size", "salt", before(["key", "size"], "salt").alias("cells_before")).join(lines, ["key", "size"])
    start = F.col("bands_before") + F.col("lines_before") + F.col("cells_before")
    cells = cells.select("key", "size", "salt", start.alias("start"), "source_size", "target", "rate")

    rows = (picked if keep_rows else slim).withColumn("salt", salt)
    rows = rows.withColumn("in_cell", F.row_number().over(W.partitionBy("key", "size", "salt").orderBy("id", "digest")))
    place = F.col("start") + F.col("in_cell")

    def reached(place: Column) -> Column:
        return F.floor(source_offset(F.col("key"), seed) + place * F.col("rate"))

    mixed = rows.join(cells, ["key", "size", "salt"]).withColumn("copies", F.least(F.lit(most), reached(place) - reached(place - 1)).cast("long"))
    source = F.when(F.col("key") != "1", F.expr("substring(key, 2)")).alias("source")
    return mixed.select("id", source, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *["row"] * keep_rows)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_sources` says, with the columns of ``docs``."""
    mixed = mix_sources(docs, keep_rows=True, **options)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
