"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Each stage takes any table with the columns of documents, reads those alone (so other columns can have any name), and
gives no rows for no rows.  Null and very long texts are handled by the operators in batches of bounded bytes.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framestack.llm import bpe, mixing, secret_scan, simhash, toxicity
from framestack.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut; learned from the labels of documents.

    A null text scores as an empty one; rows are judged one by one, so repeated rows and null keys stay or go alike.
    """
    model = toxicity.train(*toxicity.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model).select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group.

    The smallest key stays (nulls last).  Null, empty and wordless texts are copies of each other; of repeated rows one stays.
    """
    return simhash.deduplicated(docs).select(*COLUMNS)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars counted anew; a null text stays null, with a null n_chars."""
    clean = secret_scan.redact(secret_scan.scan(docs, secret_scan.trained(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the temperature mixture of its source uses it, at least once.

    Rows without a source are one source; repeated rows and null keys count as rows of their own, in a fixed order of their contents.
    """
    return mixing.repeated(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row, repeated rows and null keys included; a null text has no ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_dedup", near_copies_out),
    ("secret_scan", secrets_out),
    ("temperature_mix", mixed),
    ("bpe_encode", encoded),
]

#: SQL can express neither the classifier nor the fingerprints; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
