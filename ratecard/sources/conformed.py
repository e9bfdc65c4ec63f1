"""Conformed logical tables, built once per session and source folder.

The analyses all read the same two logical tables. Re-deriving ``quotes``
(a four-way join over the fact table) inside every query and every scalar
subquery repeats the most expensive shuffle of the job, so the tables are
written once as parquet into the shared folder the cluster names in
``spark.checkpoint.dir`` (a private scratch folder only when unset, as in
tests) and every query scans that copy.

``quotes`` is range-partitioned on (quote_date, customer_id, l_orderkey) --
the date alone has too few values to spread a large table -- and sorted in
that order inside each file, so the date windows of the churn, pricing and experiment analyses skip files and row groups through
parquet min/max statistics (PushedFilters on quote_date).

The first query of a session builds the tables, i.e. runs jobs while its
plan is built; they are built anew when a file of a source table changes. Each
is built when first asked for: a query that reads the quotes once, into a small
table of its own, needs no copy of them (``Tables.quotes_once``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ratecard.session import ensure_checkpoint_dir
from ratecard.sources.testdata import load_accounts, load_quotes, load_table, source_version

_CACHE: dict = {}


def _root(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/ratecard-conformed-{uuid.uuid4().hex[:12]}"


SOURCES = ("region", "nation", "customer", "part", "orders", "lineitem")


def _file_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """One output file per core, or per ~128 MB of expanded input when that
    is more: enough scan parallelism on a cluster, no sea of tiny files."""
    from ratecard.operators.ranking import bucket_count
    cores = spark.sparkContext.defaultParallelism
    return max(cores, bucket_count(load_table(spark, sf_dir, name)))


def source_key(spark: SparkSession, sf_dir: str) -> tuple:
    """Names this state of the source tables in this session."""
    root = sf_dir.rstrip("/")
    return (spark.sparkContext.applicationId, root,
            tuple(source_version(spark, f"{root}/{name}.parquet") for name in SOURCES))


def _stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables written so far from this state of the sources."""
    key = source_key(spark, sf_dir)
    hit = _CACHE.get(key[:2])
    if hit is None or hit[0] != key:
        hit = _CACHE[key[:2]] = (key, {})
    return hit[1]


def conformed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _stored(spark, sf_dir)
    if "accounts" not in tables:
        path = f"{_root(spark)}/accounts"
        (load_accounts(spark, sf_dir).repartition(_file_count(spark, sf_dir, "customer"), "customer_id")
         .write.mode("overwrite").parquet(path))
        tables["accounts"] = spark.read.parquet(path)
    return tables["accounts"]


def conformed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _stored(spark, sf_dir)
    if "quotes" not in tables:
        path = f"{_root(spark)}/quotes"
        # line-item keys ride along (parquet reads only the columns a query
        # asks for); they are the tie-breakers of the quote sequence id
        (load_quotes(spark, sf_dir, keep_line_columns=True)
         .repartitionByRange(_file_count(spark, sf_dir, "lineitem"), "quote_date", "customer_id", "l_orderkey")
         .sortWithinPartitions("quote_date", "customer_id", "l_orderkey")
         .write.mode("overwrite").parquet(path))
        tables["quotes"] = spark.read.parquet(path)
    return tables["quotes"]


def quotes_stored(spark: SparkSession, sf_dir: str) -> bool:
    """Whether this session has written the quotes already."""
    return "quotes" in _stored(spark, sf_dir)


def conformed_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return conformed_accounts(spark, sf_dir), conformed_quotes(spark, sf_dir)
