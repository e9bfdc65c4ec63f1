"""Stored lookup tables with versions.

A version is a folder of parquet files of its own and, written after them, one
line in the table's manifest. Readers go by the manifest: a version whose
writer was lost on the way has no line and is never read, and readers of an
older version keep their files. Everything goes through Spark's readers and
writers, so any store they know will do.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecard.sources.io import read_table, write_table

MANIFEST_SCHEMA = T.StructType([
    T.StructField("version", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("n_rows", T.LongType(), False),
])


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The complete versions of the table under ``root`` (none if nothing was ever published)."""
    try:
        return read_table(spark, f"{root}/manifest", MANIFEST_SCHEMA, "json").where("version IS NOT NULL")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def publish(df: DataFrame, root: str, schema: T.StructType) -> int:
    """Write ``df`` (columns of ``schema``) as the newest version; returns its number.

    Numbers rise with the clock and stay above all listed ones. Two writers at once both get a line;
    the higher number is the newest."""
    spark = df.sparkSession
    newest = versions(spark, root).agg(F.max("version")).first()[0]
    number = max(time.time_ns(), (newest or 0) + 1)
    path = f"{root}/version-{number}-{uuid.uuid4().hex[:8]}"
    write_table(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), path)
    n_rows = read_table(spark, path, schema).count()
    line = spark.createDataFrame([(number, path, n_rows)], MANIFEST_SCHEMA).coalesce(1)
    write_table(line, f"{root}/manifest", "json", mode="append")
    return number


def read_newest(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The newest complete version. It is an error if there is none, or if its files hold another
    number of rows than were published."""
    top = versions(spark, root).orderBy(F.desc("version")).first()
    if top is None:
        raise LookupError(f"no complete version under {root}")
    table = read_table(spark, top["path"], schema)
    found = table.count()
    if found != top["n_rows"]:
        raise LookupError(f"{top['path']} holds {found} rows, published were {top['n_rows']}")
    return table
