"""Map the TPC-H-style testdata onto the two logical tables.

accounts  <- customer x nation x region x first order date
quotes    <- lineitem x orders x customer [x part]

Money and ratios are computed in exact DECIMAL arithmetic and then stored
as DOUBLE, so every later sum can be made order-independent by summing
them back as DECIMAL (see ``ratecard.functions.exact``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def source_version(spark: SparkSession, path: str) -> tuple:
    """The files under ``path`` with their sizes and modification times (a
    listing by the store's own file system): changes when the source does."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one testdata table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ntz(d: dt.date) -> F.Column:
    # literal of the same type as the raw column so the comparison reaches
    # the parquet scan as a pushed filter
    return F.lit(d.isoformat() + " 00:00:00").cast("timestamp_ntz")


def _orders(spark, sf_dir, start=None, end=None) -> DataFrame:
    o = load_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if start is not None:
        o = o.filter(F.col("o_orderdate") >= _ntz(start))
    if end is not None:
        o = o.filter(F.col("o_orderdate") < _ntz(end))
    return o


def load_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per account; ``signup_date`` (the first order) is null for an
    account without orders.

    nation and region are fixed-size dimensions (25 and 5 rows in every
    TPC-H scale factor), so broadcasting them is size-safe.
    """
    nation = load_table(spark, sf_dir, "nation")
    region = load_table(spark, sf_dir, "region")
    geo = F.broadcast(
        nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        .select("n_nationkey", F.col("n_name").alias("industry"), F.col("r_name").alias("region")))
    first_order = (load_table(spark, sf_dir, "orders")
                   .groupBy(F.col("o_custkey").alias("c_custkey"))
                   .agg(F.min("o_orderdate").cast("date").alias("signup_date")))
    cust = load_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return (cust.join(geo, cust.c_nationkey == geo.n_nationkey)
            .join(first_order, "c_custkey", "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_mktsegment").alias("true_segment"),
                    "signup_date", "industry", "region",
                    F.when(F.col("c_acctbal") >= 5000, "Contract").otherwise("Spot")
                    .alias("contract_type")))


_RATIO = ("(CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(4,2)))"
          " * (CAST(1 AS DECIMAL(3,2)) + CAST(l_tax AS DECIMAL(4,2)))")


def load_quotes(spark: SparkSession, sf_dir: str, start: dt.date | None = None,
                end: dt.date | None = None, with_part: bool = True,
                keep_line_columns: bool = False, parts_first: bool = False,
                contracts: DataFrame | None = None) -> DataFrame:
    """One row per line item = one price quote.

    ``start``/``end`` bound quote_date as [start, end) and are applied to
    the orders scan so parquet skips row groups. ``with_part=False`` skips
    the part join when an analysis needs neither ``mode`` nor
    ``distance_km`` (Catalyst cannot drop an inner join by itself).
    Orders are joined to customer first (orders is ~4x smaller than
    lineitem), so the fact table is shuffled once by order key and, when
    needed, once by part key. ``parts_first`` joins the parts before the
    orders: an aggregation by customer then merges the lines of an order in
    the task that joined them. ``contracts`` (customer_id, contract_type) adds
    that column (null: no such customer), joined to the orders as well.
    """
    orders = _orders(spark, sf_dir, start, end)
    cust = load_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "c_mktsegment")
    if contracts is not None:
        oc = oc.join(contracts.select("customer_id", "contract_type"), F.col("o_custkey") == F.col("customer_id"),
                     "left").drop("customer_id")
    li_cols = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
               "l_tax", "l_returnflag"]
    if keep_line_columns:
        li_cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                   "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                   "l_linestatus", "l_shipdate"]
    li = load_table(spark, sf_dir, "lineitem").select(*li_cols)
    # fact x fact on the order key: sort-merge, never broadcast (a pruned
    # small-file estimate must not make the fact table a broadcast side)
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    if with_part and parts_first:
        li = li.join(part, li.l_partkey == part.p_partkey)
    q = li.hint("merge").join(oc, li.l_orderkey == oc.o_orderkey)
    cols = [
        F.col("o_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderdate").cast("date").alias("quote_date"),
    ]
    if with_part:
        if not parts_first:
            q = q.join(part, q.l_partkey == part.p_partkey)
        cols.append(F.col("p_type").alias("mode"))
    cols += [
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Express")
        .otherwise("Standard").alias("service_level"),
        F.col("l_quantity").alias("weight_kg"),
    ]
    if with_part:
        cols.append(F.col("p_size").cast("double").alias("distance_km"))
    cols += [
        F.col("l_extendedprice").alias("competitor_price"),
        F.expr(_RATIO).cast("double").alias("price_ratio"),
        F.round(F.expr(f"CAST(l_extendedprice AS DECIMAL(15,2)) * {_RATIO}"), 2)
        .cast("double").alias("quoted_price"),
        F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("accepted"),
    ]
    if contracts is not None:
        cols.append(F.col("contract_type"))
    if keep_line_columns:
        cols += [F.col(c) for c in li_cols
                 if c not in ("l_quantity", "l_extendedprice", "l_partkey")]
        cols.append(F.col("l_partkey"))
    return q.select(*cols)
