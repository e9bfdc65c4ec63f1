"""The corpus pipeline: toxic documents go, exact and near copies go, secrets are blanked out, and what
is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run`` writes
each stage's rows to the shared folder and reads them back for the next. All but the last return the
columns of ``documents``. What a stage does with nulls, empty texts, repeated rows and empty tables is
what its operator states.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecard.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from ratecard.llm.common import stored, table

NEAR_PERCENT = 80  # similarity, in per cent, from which documents are near copies
SEQUENCE = 2048
WORD_CACHE = 120_000  # the workers serve all stages, so packing keeps fewer words than on its own
ARROW_ROWS = 1_000  # rows that travel to a worker at once: whole texts are long


def small_batches(spark: SparkSession) -> None:
    """Every stage sends whole texts to Python workers; the session's batches are cut down for them (they
    stay so), as an executor holds a batch of each worker several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    small_batches(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    small_batches(spark)
    return near_dedup.near_dedup(docs, NEAR_PERCENT)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    small_batches(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most SEQUENCE tokens."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, cache=WORD_CACHE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", blank_secrets),
    ("packing", pack_sequences),
]

# model scores and packing are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
