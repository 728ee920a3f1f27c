"""What the training-data operators share: the cluster's shared folder and table loading."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define words: [^\x20\x09-\x0D]+
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none (tests on one machine) a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="fernweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/fernweave/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and lost executors cost nothing that was done before."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key from which it is joined apart, and most such keys; those beyond have a HOT_KEYS-th of all rows at most.
HOT_ROWS, HOT_KEYS = 2000, 2000


def join_unique(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a table that has each key once, whatever share of the rows one key has.

    The keys with the most rows, from HOT_ROWS rows on and HOT_KEYS keys at most, are joined by broadcast. Null keys
    find nothing.
    """
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("rows_")).where((F.col("rows_") > HOT_ROWS) & F.col(key).isNotNull())
    hot = [r[0] for r in counts.orderBy(F.desc("rows_")).limit(HOT_KEYS).select(key).collect()]
    if not hot:
        return many.join(one, key)
    is_hot = F.col(key).isin(hot)
    return many.where(~is_hot).join(one.where(~is_hot), key).unionByName(many.where(is_hot).join(F.broadcast(one.where(is_hot)), key))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a finished intermediate table of the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, once a session, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_fernweave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="fernweave-"), "fernweave.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._fernweave_shipped = True


def small_batches(spark: SparkSession, rows: int) -> None:
    """Rows in an Arrow batch: whole texts are long, so a task holds few of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Work on batches that hands its memory back when a task ends: Python workers live on and allocators keep what they had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return run
