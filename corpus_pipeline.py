"""A corpus pipeline over ``documents``: toxic texts go, near copies go, secrets are masked, sources are mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fernweave.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from fernweave.llm._common import materialise, ship, small_batches, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.3; it learns from the labels of these documents.

    Null and empty texts have the score of a text without known words and stay, unless labels make that toxic; rows with
    a null id and repeated rows are scored one by one; without labels nothing goes; an empty table stays empty.
    """
    ship(spark)
    small_batches(spark, 1000)
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")), least=0.3)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words: the smallest id.

    Null ids come last in a group; of repeated rows one stays; documents without words are in no group and all stay; an
    empty table stays empty.
    """
    ship(spark)
    small_batches(spark, 1000)
    return jaccard_join.one_of_each_group(docs, words=5, num=8, den=10)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by their kind.

    Null and empty texts stay as they are; ids, repeated rows and other columns are untouched, but for ``n_chars`` of a
    changed text; an empty table stays empty.
    """
    ship(spark)
    small_batches(spark, 1000)
    return secret_scan.redact_secrets(docs, length_col="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them.

    Null and empty texts have no words and may be left out or repeated like others of their source's order; a null
    source is a source; null ids come first in the order; repeated rows count each; an empty table stays empty.
    """
    return mixing.mixed_documents(docs, weights=(5, 2, 1), most=3, seed=17)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in a sequence of at most 4096 tokens.

    Null and empty texts are one piece of the end token; null ids and repeated rows are packed as often as they occur;
    an empty table gives no pieces.
    """
    ship(spark)
    small_batches(spark, 256)
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return pieces.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("secret scan", without_secrets),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]
#: The stages use models and hashes that SQL has no form for; the tests hold run()'s stages against a plain chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
