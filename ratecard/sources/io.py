"""Generic table sources and sinks (CSV with declared schema, parquet)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("true_segment", T.StringType(), True),
    T.StructField("signup_date", T.DateType(), True),
    T.StructField("industry", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("contract_type", T.StringType(), True),
])

QUOTE_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("segment", T.StringType(), True),
    T.StructField("quote_date", T.DateType(), True),
    T.StructField("mode", T.StringType(), True),
    T.StructField("service_level", T.StringType(), True),
    T.StructField("weight_kg", T.DoubleType(), True),
    T.StructField("distance_km", T.DoubleType(), True),
    T.StructField("competitor_price", T.DoubleType(), True),
    T.StructField("price_ratio", T.DoubleType(), True),
    T.StructField("quoted_price", T.DoubleType(), True),
    T.StructField("accepted", T.IntegerType(), True),
])

MONTHLY_SCHEMA = T.StructType([
    T.StructField("month", T.DateType(), False),
    T.StructField("segment", T.StringType(), False),
    T.StructField("revenue", T.DoubleType(), True),
    T.StructField("shipments", T.LongType(), True),
])

RECOMMENDATION_SCHEMA = T.StructType([
    T.StructField("segment", T.StringType(), False),
    T.StructField("current_avg_price_ratio", T.DoubleType(), True),
    T.StructField("recommended_price_ratio", T.DoubleType(), True),
    T.StructField("recommended_accept_prob", T.DoubleType(), True),
    T.StructField("expected_revenue_at_recommendation", T.DoubleType(), True),
    T.StructField("optimum_still_rising_at_data_edge", T.BooleanType(), True),
    T.StructField("implied_price_move", T.DoubleType(), True),
])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Scan a table. CSV needs a declared schema (never inferSchema)."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV sources need a declared schema")
        return (spark.read.schema(schema)
                .option("header", True)
                .option("dateFormat", date_format)
                .option("mode", "FAILFAST")
                .csv(path))
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> None:
    """Write a result; keys are ordinary columns (no index column)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


# ---- globally sorted tables -------------------------------------------------------

def write_sorted(df: DataFrame, path: str, order: Sequence[str], files: int, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """Write ``df`` sorted by ``order``: file after file (by name) the rows are in order.

    One range exchange; each of at most ``files`` tasks sorts and writes its own range, so no task
    sees all rows. Rows that agree in all of ``order`` stay in one file, in any order among them."""
    sorted_rows = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    write_table(sorted_rows, path, fmt, mode=mode)


def file_bounds(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per file of a parquet table: ``file``, ``n_rows``, its ``lowest`` and ``highest`` key."""
    key = F.struct(*order)
    return table.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("lowest"), F.max(key).alias("highest"))


def file_overlaps(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: ``n_rows`` and ``n_overlaps``, the files that begin before the file before them ends.
    0 means that the files' key ranges are disjoint."""
    w = Window.orderBy("lowest", "highest")   # one row per file
    before = F.max("highest").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bounds = file_bounds(table, order).withColumn("_before", before)
    return bounds.agg(F.sum("n_rows").alias("n_rows"),
                      F.count(F.when(F.col("lowest") <= F.col("_before"), 1)).alias("n_overlaps"))


def rank_from_files(table: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """The 1-based position of every row of a table written by ``write_sorted``, from its place in its
    file and the sizes of the files before it: no row is exchanged or sorted again."""
    bounds = file_bounds(table, order)
    w = Window.orderBy("lowest", "highest").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file of a table with a stated number of files
    offsets = bounds.select("file", F.coalesce(F.sum("n_rows").over(w), F.lit(0)).alias("_before"))
    rows = table.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_at"))
    return (rows.join(F.broadcast(offsets), "file")
            .withColumn(name, F.col("_before") + F.col("_at") + 1).drop("file", "_before", "_at"))
