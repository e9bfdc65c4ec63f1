"""Queries that read the quotes once do so without the stored copy, with the same rows."""

import datetime as dt
import os
import shutil

import pytest

from ratecard.operators import features as fe
from ratecard.operators.pricing import with_contract
from ratecard.plans.context import Tables
from ratecard.plans.queries import QUERIES, priced_quotes
from ratecard.session import small_splits
from ratecard.sources.conformed import quotes_stored
from ratecard.sources.testdata import load_quotes

SF_SMALL = "/root/testdata/sf0.001"


def copied(tmp_path):
    for name in ("region", "nation", "customer", "part", "orders", "lineitem"):
        shutil.copyfile(f"{SF_SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="testdata missing")
def test_single_reads_store_no_quotes(spark, tmp_path):
    d = copied(tmp_path)
    for name in ("lag_features", "misfiled_top10", "ab_segment_effects", "rfm_features", "monthly_revenue"):
        assert QUERIES[name](spark, d).count() > 0
        assert not quotes_stored(spark, d), name


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="testdata missing")
def test_rows_are_those_of_the_stored_table(spark, tmp_path):
    t = Tables(spark, copied(tmp_path))
    rows = lambda q: sorted(map(str, q.select(*names).collect()))
    window = dt.date(2001, 1, 1), dt.date(2001, 7, 1)
    names = t.quotes_once().columns
    once = [rows(t.quotes_once()), rows(t.quotes_once(by_order=True)), rows(t.quotes_once(*window))]
    account = sorted(map(str, fe.rfm_features(t.accounts(), t.quotes_once(by_order=True), t.p.as_of).collect()))
    assert not quotes_stored(spark, t.sf_dir)
    assert [rows(t.quotes())] * 2 + [rows(t.quotes(*window))] == once and quotes_stored(spark, t.sf_dir)
    assert account == sorted(map(str, fe.rfm_features(t.accounts(), t.quotes(), t.p.as_of).collect()))


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="testdata missing")
def test_priced_quotes_need_no_stored_quotes(spark, tmp_path):
    t = Tables(spark, copied(tmp_path))
    assert QUERIES["demand_curve_tail"](spark, t.sf_dir).count() > 0
    assert not quotes_stored(spark, t.sf_dir)
    rows = lambda q: sorted(map(str, q.select(*priced_quotes(t).columns).collect()))
    kept = rows(priced_quotes(t))
    # an account that is missing leaves its quotes, without a contract
    gone = t.accounts().where("customer_id % 3 <> 0")
    once = rows(load_quotes(spark, t.sf_dir, contracts=gone))
    assert kept == rows(with_contract(t.quotes(), t.accounts()))
    assert once == rows(with_contract(t.quotes(), gone)) and any("contract_type=None" in r for r in once)


def test_small_splits_bound_a_task_and_are_set_back(spark, tmp_path):
    name = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(name)
    spark.range(40_000).repartition(4).write.parquet(str(tmp_path / "rows"))
    with small_splits(spark, 1000):
        assert spark.read.parquet(str(tmp_path / "rows")).rdd.getNumPartitions() > 4
    with pytest.raises(ZeroDivisionError), small_splits(spark, 2 ** 40):
        assert int(spark.conf.get(name)) <= 2 ** 40 - 1
        raise ZeroDivisionError
    assert spark.conf.get(name) == was
