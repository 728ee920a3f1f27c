"""Reading CSV, JSON and JSON lines, verified page texts, links in web pages, and JDBC tables; writing JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header under a stated schema; empty fields are null and a byte order mark is passed over."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("enforceSchema", True).csv(path)


def read_json_documents(spark: SparkSession, path: str, field: str = "documents") -> DataFrame:
    """The elements of a list in a JSON document, one row each."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("d")).select("d.*")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).dropna("all")


def typed(frame: DataFrame, schema: str) -> DataFrame:
    """Columns of text as the types of a schema; empty texts and those that are no such value are null."""
    fields = StructType.fromDDL(schema)
    return frame.select(*[F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in fields])


def verified_pages(documents: DataFrame, expected: DataFrame | None = None, revision: str | None = None) -> DataFrame:
    """(doc_id, page_number, text, fault) of documents with an array of pages; fault is null where a page can be used.

    documents: (doc_id, pages) and, where they are to be checked, source_hash and mapping_revision; expected: (doc_id,
    sha256) of the source files, each once; revision: the only one that is taken. Texts have plain spaces and none
    around them. A document without pages has one row without a page number.
    """
    told = F.lit(None).cast("string")
    if revision is not None:
        told = F.when(~F.col("mapping_revision").eqNullSafe(revision), "revision").otherwise(told)
    if expected is not None:
        documents = documents.join(expected.select("doc_id", F.col("sha256").alias("expected_")), "doc_id", "left")
        told = F.when(~F.coalesce(F.col("source_hash") == F.col("expected_"), F.lit(False)), "provenance").otherwise(told)
    pages = documents.select("doc_id", told.alias("told_"), F.explode_outer("pages").alias("p")).select("doc_id", "told_", "p.*", F.col("p").isNull().alias("none_"))
    pages = pages.withColumn("text", F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\u00a0", " "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    fault = F.when(F.col("told_").isNotNull(), F.col("told_")).when(F.col("none_"), "no pages").when(~F.coalesce("verified", F.lit(False)), "unverified").when(F.col("text") == "", "empty").when(F.col("text").rlike("[\\uE000-\\uF8FF]"), "private use").when(~F.sha2("text", 256).eqNullSafe(F.col("sha256")), "hash")
    return pages.select("doc_id", "page_number", "text", fault.alias("fault"))


def page_links(pages: DataFrame, pattern: str = 'href="([^"]+)"') -> DataFrame:
    """(url, page_id): addresses that pages link to, once each with the last page that has it."""
    links = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))).alias("url"))
    last = F.row_number().over(W.partitionBy("url").orderBy(F.desc("page_id")))
    return links.withColumn("last", last).where("last = 1").select("url", "page_id")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_jdbc_parts(spark: SparkSession, url: str, table: str, key: str, parts: int = 16, where: str | None = None, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table of a database read in ranges of a whole-number key, each by a task; null keys come with the first range.

    The bounds are asked of the database, so ranges follow its keys; where: a condition that it applies itself. An empty table is
    read at once.
    """
    chosen = f"(select {', '.join(columns) if columns else '*'} from {table}{f' where {where}' if where else ''}) t"
    least, most = read_jdbc(spark, url, f"(select min({key}) as a, max({key}) as b from {table}{f' where {where}' if where else ''}) t", **options).first()
    if least is None:
        return read_jdbc(spark, url, chosen, **options)
    return read_jdbc(spark, url, chosen, partitionColumn=key, lowerBound=str(int(least)), upperBound=str(int(most) + 1), numPartitions=str(parts), **options)


def open_table(spark: SparkSession, backend: str, place: str, name: str, **options: str) -> DataFrame:
    """A table by the backend that a setting names: ``local`` for Parquet in a folder, ``jdbc`` for a database; others are refused."""
    if backend == "local":
        return read_table(spark, place, name)
    if backend == "jdbc":
        return read_jdbc(spark, place, name, **options)
    raise ValueError(f"there is no backend {backend!r}: local or jdbc")


def _finite(value: Column, kind: DataType) -> Column:
    """A value with NaN and infinite numbers, at any depth, as null."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_finite(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def write_json(frame: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinite numbers are written as null."""
    clean = {f.name: _finite(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema}
    frame.withColumns(clean).write.option("ignoreNullFields", False).json(path)


def traces(turns: DataFrame, keep: tuple[str, ...] = ("candidate_count", "grounded_count", "duration_ms", "requests")) -> DataFrame:
    """(trace_id, owner_ref, session_ref, status, and what of ``keep`` there is): turns without anything they say.

    turns: (trace_id, owner_id, session_id, status, ...). Owners and sessions are told by a hash, and a status beside
    complete and cancelled is error.
    """
    refs = [F.substring(F.sha2(F.col(f"{c}_id").cast("string"), 256), 1, 16).alias(f"{c}_ref") for c in ("owner", "session")]
    status = F.when(F.col("status").isin("complete", "cancelled"), F.col("status")).otherwise("error").alias("status")
    return turns.select("trace_id", *refs, status, *[c for c in keep if c in turns.columns])
