"""Rules that keep results whole and tasks small, each probed on a small case."""

import ast
import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratecard.functions.exact import dec_sum
from ratecard.operators import ranking as rk
from ratecard.operators import segments as sg
from ratecard.params import AnalysisParams
from ratecard.sources.testdata import load_accounts, load_quotes
from tests.conftest import SF_SMALL


def test_defaults_are_the_published_settings():
    p = AnalysisParams()
    assert (p.gbt_iter, p.forecast_gbt_iter, p.dependence_points) == (300, 250, 100)
    assert sg.kmeans_fit.__defaults__[-2:] == (10, 300) and sg.kmeans_k_sweep.__defaults__[-2:] == (10, 300)


def test_unlisted_tier_fails_loudly(spark):
    df = spark.createDataFrame([(0, "A"), (1, "NEW")], "cluster int, tier string")
    assert sg.crosstab(df.where("tier = 'A'"), "cluster", "tier", ["A"]).count() == 1
    with pytest.raises(PySparkException, match="unlisted value NEW"):
        sg.crosstab(df, "cluster", "tier", ["A"]).collect()


def test_null_feature_fails_loudly(spark):
    cols = ", ".join(f"{c} double" for c in sg.SEGMENT_FEATURES)
    df = spark.createDataFrame([(1.0,) * 6, (None,) + (2.0,) * 5], cols)
    with pytest.raises(Exception, match="(?i)null"):
        sg.kmeans_fit(df, 2, restarts=1)


def test_exact_sums_never_round(spark):
    df = spark.createDataFrame([(1.0004,), (0.1,), (None,)], "x double")
    assert df.agg(dec_sum("x").alias("s")).first().s == 1.1004
    with pytest.raises(PySparkException, match="more than 4 decimals"):
        spark.createDataFrame([(1.00004,)], "x double").agg(dec_sum("x")).collect()


def test_ranking_metrics_beyond_long_products(spark, monkeypatch):
    # counts per distinct score as a large book would have them
    counts = spark.createDataFrame([(0.1, 0, 3 * 10**12), (0.5, 4 * 10**6, 10**12), (0.9, 5 * 10**6, 0)],
                                   "score double, pos long, neg long")
    monkeypatch.setattr(rk, "score_counts", lambda *a: counts)
    auc = rk.roc_auc(counts, "score", "label").first()
    pos, neg = 9 * 10**6, 4 * 10**12
    want = (4 * 10**6 * (3 * 10**12 + 10**12 / 2) + 5 * 10**6 * neg) / (pos * neg)
    assert abs(auc["roc_auc"] - want) < 1e-12
    ap = rk.average_precision(counts, "score", "label").first()[0]
    assert abs(ap - (5 / 9 + 4 / 9 * pos / (pos + 10**12))) < 1e-12


def test_no_tables_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    df = spark.range(500).select((F.col("id") % 7).alias("g"), "id")
    out = rk.group_sequence(df, ["g"], ["id"], "rn", n_buckets=5)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert out.agg(F.max("rn")).first()[0] == 72 and out.count() == 500


def test_hot_group_stays_spread(spark):
    """No exchange of row-level data on the group column."""
    df = spark.range(2000).select(F.lit("hot").alias("g"), "id")
    plan = rk.group_sequence(df, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g#" not in plan


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="testdata missing")
def test_replaced_source_is_noticed(spark, tmp_path):
    from ratecard.sources.conformed import conformed_tables
    for name in ("region", "nation", "customer", "part", "orders", "lineitem"):
        shutil.copyfile(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    n = conformed_tables(spark, str(tmp_path))[1].count()
    half = pq.read_table(tmp_path / "lineitem.parquet").slice(0, n // 2)
    pq.write_table(half, tmp_path / "lineitem.parquet")
    assert conformed_tables(spark, str(tmp_path))[1].count() == n // 2 < n


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="testdata missing")
def test_quotes_spread_beyond_their_dates(spark):
    q = load_quotes(spark, SF_SMALL, keep_line_columns=True)
    one_day = q.where(F.col("quote_date") == q.agg(F.max("quote_date")).first()[0])
    day = spark.range(400).crossJoin(one_day.limit(1).drop("l_orderkey")).withColumn("l_orderkey", F.col("id"))
    ids = day.repartitionByRange(8, "quote_date", "customer_id", "l_orderkey").select(F.spark_partition_id())
    assert ids.distinct().count() > 4


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="testdata missing")
def test_accounts_without_orders_stay(spark, tmp_path):
    for name in ("region", "nation", "customer"):
        shutil.copyfile(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_custkey > 10").write.parquet(str(tmp_path / "orders.parquet"))
    accounts = load_accounts(spark, str(tmp_path))
    assert accounts.count() == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert accounts.where("signup_date IS NULL").count() >= 5


def test_oracle_imports_nothing_of_the_engine():
    import ratecard.plans.oracle as oracle
    with open(oracle.__file__) as f:
        names = {n.module for n in ast.walk(ast.parse(f.read())) if isinstance(n, ast.ImportFrom)}
    assert {n for n in names if n.startswith("ratecard")} == {"ratecard.params"}
