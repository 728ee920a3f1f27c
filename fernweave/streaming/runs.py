"""Running a stream to the end of what is there, with everything that it keeps in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where the session has none (one machine) a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="fernweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/fernweave/{label}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: str | None = None, files_each: int | None = None) -> DataFrame:
    """A stream of the Parquet files below a folder, or of those that a pattern names; files_each: files of a batch."""
    shape = spark.read.parquet(path).schema if schema is None else schema
    reader = spark.readStream.schema(shape)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(path)


def run_now(stream: DataFrame, folder: str) -> DataFrame:
    """Write what a stream gives for the files that are there to ``folder``/rows, and read it; a second run goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
