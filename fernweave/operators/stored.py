"""Tables on disk that change by parts: rows lie in buckets by key, and a change reads and writes the buckets it touches.

A bucket is a directory, and a change replaces whole buckets (dynamic partition overwrite): others keep their files. Changes
of one table follow one another, and each gives the same table when it is made again, so one that broke off is simply repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.operators.tables import content_hash, upsert

#: Column that names the bucket.
BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a stored table, with their buckets; None where there is none yet."""
    try:
        return spark.read.parquet(path).withColumn(BUCKET, F.col(BUCKET).cast("int"))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _replace(path: str, rows: DataFrame) -> None:
    """Put rows in the place of the buckets that they are of; a large bucket is written by several tasks."""
    rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def _drop(spark: SparkSession, path: str, buckets: list[int]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for k in buckets:
        place = hadoop.Path(f"{path}/{BUCKET}={k}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def merge_stored(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], buckets: int = 64, change: Callable[[DataFrame, DataFrame], DataFrame] | None = None, touched: list[int] | None = None) -> list[int]:
    """Change a stored table by ``incoming`` and return the buckets that were written; by default rows replace those with their keys.

    keys: what the buckets are by (change may work on finer keys). change(current, incoming) gives the next rows of the touched
    buckets, and has to give the same rows for the same incoming rows once more; a bucket that it gives no row for stays as
    it is. The first merge makes the table. touched: the buckets of ``incoming``, where they are known, so that its rows are not
    made once more to find them.
    """
    came = incoming.withColumn(BUCKET, bucket_of(keys, buckets))
    if touched is None:
        touched = sorted(r[0] for r in came.select(BUCKET).distinct().collect())  # ``buckets`` numbers at most
    if not touched:
        return []
    stored = read_stored(spark, path)
    current = spark.createDataFrame([], came.schema) if stored is None else stored.where(F.col(BUCKET).isin(touched))
    after = change(current.drop(BUCKET), incoming) if change else upsert(current.drop(BUCKET), incoming, keys)
    _replace(path, after.withColumn(BUCKET, bucket_of(keys, buckets)))
    return touched


def refresh_stored(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int = 64) -> list[int]:
    """Make a stored table equal to ``rows``: buckets with a new, changed or stale row are written anew, others are not touched.

    Both sides are compared by keys and hashes of contents. Returns the buckets that were written.
    """
    own = rows.withColumn(BUCKET, bucket_of(keys, buckets))
    stored = read_stored(spark, path)
    if stored is None:
        return merge_stored(spark, path, rows, keys, buckets, lambda _, incoming: incoming)

    def marks(frame: DataFrame) -> DataFrame:
        return frame.groupBy(BUCKET, content_hash(rows.columns).alias("mark")).agg(F.count(F.lit(1)).alias("n"))

    changed = marks(own).withColumn("side", F.lit(1)).unionByName(marks(stored).withColumn("side", F.lit(-1)))
    differing = changed.groupBy(BUCKET, "mark").agg(F.sum(F.col("n") * F.col("side")).alias("n")).where("n <> 0")
    touched = sorted(r[0] for r in differing.select(BUCKET).distinct().collect())  # ``buckets`` numbers at most
    if touched:
        after = own.where(F.col(BUCKET).isin(touched))
        full = {r[0] for r in after.select(BUCKET).distinct().collect()}
        _replace(path, after)
        _drop(spark, path, [k for k in touched if k not in full])
    return touched
