"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ratecard.session import ensure_checkpoint_dir

# The two alphabets of the A-Z lower-casing.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, a lost executor
    costs no recomputation, and Spark knows the table's size when it plans what follows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(col: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str,
           rows_per_bucket: int = 50_000) -> DataFrame:
    """``df`` with a gapless rank from 0 within each ``group`` in column ``out`` (long).

    A group may hold any share of the rows, so it is never sorted in one task: rows are dealt by a
    hash of ``order`` into buckets of about ``rows_per_bucket``, counted per (group, bucket), and
    numbered inside their bucket; running totals of the counts give each bucket its first rank. Rows
    that agree in all of ``order`` may swap ranks. ``df`` is read twice: store it first."""
    n = max(1, -(-df.count() // rows_per_bucket))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(n)))
    sizes = dealt.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    return (numbered.join(sizes, [*group, "_b"])
            .withColumn(out, (F.col("_from") + F.col("_at")).cast("long"))
            .drop("_b", "_from", "_at"))


def likely_in(df: DataFrame, keys: DataFrame, on: list[str], slots: int = 1 << 20,
              others: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``on`` may occur in ``keys``: all that do, and few others (or, with
    ``others``, the remaining rows).

    Keys are hashed to ``slots`` numbers; the distinct numbers (at most ``slots`` rows, whatever the
    data) are broadcast. A join on the keys themselves then shuffles few wide rows."""
    slot = F.pmod(F.xxhash64(*on), F.lit(slots)).alias("_slot")
    taken = keys.select(slot).distinct()
    kind = "left_anti" if others else "left_semi"
    return df.withColumn("_slot", slot).join(F.broadcast(taken), "_slot", kind).drop("_slot")


def small(batches: Iterator[pa.RecordBatch], rows: int = 300) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that arrays per word stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()  # workers are reused by later stages


def buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of an Arrow string or binary array, without a copy.
    A null has no bytes."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    if values.null_count:
        values = values.fill_null("" if pa.types.is_string(values.type) or
                                  pa.types.is_large_string(values.type) else b"")
    off = np.frombuffer(values.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[values.offset:values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]
