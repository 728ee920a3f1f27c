"""The corpus behind retrieval: its manifest, links to documents, the quality of extracted pages, and what tells a stale index."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a manifest must say of a document.
REQUIRED = ("doc_id", "product_id", "product_name", "source_page_url", "pdf_url", "publisher", "retrieved_at", "sha256", "page_count", "language", "extraction_status", "local_path")


def _beyond_first(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands at a smaller position too."""
    first = rows.groupBy(key).agg(F.min("position").alias("first_"))
    return rows.join(first, key).where(F.col("position") > F.col("first_"))


def manifest_errors(documents: DataFrame, files: DataFrame, required: tuple[str, ...] = REQUIRED, expected: int | None = None) -> DataFrame:
    """(doc_id, error): what is wrong with the documents of a manifest.

    documents: (position, the required fields, corrected_text_path), positions without ties; files: (path, content_hash,
    is_pdf), each path once. A document with a null field is told with the names of such fields and looked at no
    further, and so is one without its file. Of equal ids and of equal contents all but the first are told. expected:
    how many documents there must be; another number is told under a null id.
    """
    lacks = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in sorted(required)]), lambda x: x.isNotNull())
    rows = documents.withColumn("lacks_", lacks)
    whole = rows.where(F.size("lacks_") == 0)
    held = whole.join(files.select(F.col("path").alias("local_path"), "content_hash", "is_pdf"), "local_path", "left")
    stored = held.where("content_hash is not null")
    faults = {
        "not a PDF": ~F.col("is_pdf"),
        "hash differs": F.col("content_hash") != F.col("sha256"),
        "page count": F.col("page_count") < 1,
        "no corrected text": F.col("corrected_text_path").isNull(),
    }
    told = [
        rows.where(F.size("lacks_") > 0).select("doc_id", F.concat(F.lit("missing fields: "), F.array_join("lacks_", ", ")).alias("error")),
        _beyond_first(whole, "doc_id").select("doc_id", F.lit("repeated id").alias("error")),
        held.where("content_hash is null").select("doc_id", F.lit("no file").alias("error")),
        stored.select("doc_id", F.explode(F.array(*[F.when(bad, name) for name, bad in faults.items()])).alias("error")).where("error is not null"),
        _beyond_first(stored, "content_hash").select("doc_id", F.lit("repeated content").alias("error")),
        stored.where("corrected_text_path is not null").join(files.select(F.col("path").alias("corrected_text_path")), "corrected_text_path", "left_anti").select("doc_id", F.lit("corrected text does not exist").alias("error")),
    ]
    if expected is not None:
        number = documents.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
        told.append(number.select(F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), F.concat(F.lit(f"{expected} documents expected, not "), F.col("n").cast("string")).alias("error")))
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out


def extraction_quality(pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, pages_with_text, empty_pages, characters, private_use, extraction_status) of each document.

    pages: (doc_id, page_number, text); a null text is an empty page. Characters are those of the pages joined by line
    feeds. Without any text a document is image_only, with letters of the private use area limited_text_encoding.
    """
    text = F.coalesce("text", F.lit(""))
    full = text.rlike(r"(?U)\S")
    own = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if(full).alias("pages_with_text"),
        F.array_sort(F.collect_list(F.when(~full, F.col("page_number")))).alias("empty_pages"),
        (F.sum(F.length(text)) + F.count(F.lit(1)) - 1).alias("characters"),
        F.sum(F.length(text) - F.length(F.regexp_replace(text, r"[\uE000-\uF8FF]", ""))).alias("private_use"),
    )
    return own.withColumn("extraction_status", F.when(F.col("pages_with_text") == 0, "image_only").when(F.col("private_use") > 0, "limited_text_encoding").otherwise("passed"))


def _holders(value: object, field: str) -> Iterator[dict]:
    """Objects of a JSON value that have a text under the field, outer ones and earlier ones first."""
    waiting = [value]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            if isinstance(node.get(field), str):
                yield node
            node = list(node.values())
        if isinstance(node, list):
            waiting += reversed(node)


def embedded_links(pages: DataFrame, field: str, suffix: str = ".pdf", host: str | None = None, within: str = "", script_id: str = "__NEXT_DATA__") -> DataFrame:
    """(url, page_id, name, path, kind): addresses in the JSON that pages embed in a script, at any depth.

    pages: (page_id, html). An address stands under ``field``, ends with the suffix, has the host and contains
    ``within``, whatever the case; its path is percent-encoded. Each address is given once, with what its last holder
    says as name, path and type (empty where it says nothing). Pages without such a script or with unreadable JSON have
    none.
    """
    data = F.regexp_extract("html", rf'(?s)<script id="{script_id}"[^>]*>(.*?)</script>', 1)

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, text in zip(batch.page_id, batch.data, strict=True):
                try:
                    value = json.loads(text)
                except ValueError:
                    continue
                for place, node in enumerate(_holders(value, field)):
                    parts = urlsplit(node[field])
                    if node[field].lower().endswith(suffix) and within.lower() in node[field].lower() and host in (None, parts.hostname):
                        rows.append((parts._replace(path=quote(parts.path)).geturl(), page, place, *[str(node.get(k) or "") for k in ("name", "path", "type")]))
            yield pd.DataFrame(rows, columns=["url", "page_id", "place", "name", "path", "kind"])

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), data.alias("data")).where("data <> ''").mapInPandas(links, "url string, page_id long, place long, name string, path string, kind string")
    return found.groupBy("url").agg(F.max_by(F.struct("page_id", "name", "path", "kind"), F.struct("page_id", "place")).alias("l")).select("url", "l.*")


def id_set_hash(frame: DataFrame, id_col: str) -> DataFrame:
    """(ids_sha256): one row, the hash of a set of ids whatever their order.

    Ids are put in order within the lists of those whose own hash begins with the same four digits, each list is hashed,
    and so are the hashes of the lists in their order: a list holds a 65,536th of the ids, and no task holds all.
    """
    own = F.col(id_col).cast("string")
    lists = frame.groupBy(F.substring(F.sha2(own, 256), 1, 4).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(own)), "\n"), 256).alias("digest"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])
    return lists.where("part is not null").agg(F.sha2(F.array_join(in_order, ""), 256).alias("ids_sha256"))


def fingerprint(config: dict[str, object]) -> str:
    """Hash of a configuration (model, chunk sizes, file hashes), the same whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def index_metadata(chunks: DataFrame, config: dict[str, object], id_col: str = "chunk_id") -> DataFrame:
    """(chunk_count, ids_sha256, fingerprint): the row that is stored beside an index."""
    return chunks.agg(F.count(F.lit(1)).alias("chunk_count")).crossJoin(id_set_hash(chunks, id_col)).withColumn("fingerprint", F.lit(fingerprint(config)))


def index_faults(metadata: DataFrame, chunks: DataFrame, config: dict[str, object], expected: int | None = None, id_col: str = "chunk_id") -> DataFrame:
    """(fault): why an index must be built anew; no rows if it can be used. Without metadata it cannot."""
    now = index_metadata(chunks, config, id_col).select(F.col("chunk_count").alias("count_now"), F.col("ids_sha256").alias("ids_now"), F.col("fingerprint").alias("print_now"))
    both = now.join(metadata, F.lit(True), "left")
    faults = {
        "no metadata": F.col("fingerprint").isNull(),
        "fingerprint": F.col("fingerprint") != F.col("print_now"),
        "ids": (F.col("ids_sha256") != F.col("ids_now")) | (F.col("chunk_count") != F.col("count_now")),
        "count": F.col("count_now") != F.lit(expected).cast("long"),
    }
    return both.select(F.explode(F.array(*[F.when(bad, name) for name, bad in faults.items()])).alias("fault")).where("fault is not null")


def refreshed_rows(stored: DataFrame, current: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index after a refresh: stored rows whose content is the current one, and current rows that are new or changed.

    Both have the key and content_hash; rows with a null hash are always taken from ``current``.
    """
    same = [key, "content_hash"]
    kept = stored.join(current.select(*same), same, "left_semi")
    return kept.unionByName(current.join(stored.select(*same), same, "left_anti"), allowMissingColumns=True)


def coverage(actual: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, absent): keys that only one side has; absent says from which, ``list`` or ``data``. Nulls are not looked at."""
    ours, theirs = (f.select(key).where(F.col(key).isNotNull()).distinct() for f in (actual, listed))
    return ours.join(theirs, key, "left_anti").withColumn("absent", F.lit("list")).unionByName(theirs.join(ours, key, "left_anti").withColumn("absent", F.lit("data")))
