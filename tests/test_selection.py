"""Radix selection, exact silhouettes, stored versions, sorted tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecard.operators import ranking as rk
from ratecard.operators import selection as sel
from ratecard.operators import silhouette as si
from ratecard.sources import io, versions


def test_bits_compare_like_doubles():
    v = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    bits = sel.ordered_bits(v)
    assert np.all(np.diff(bits.astype(object)) >= 0) and bits[4] == bits[5]
    assert [sel.from_bits(int(b)) for b in bits] == v.tolist()


QS = [0.0, 0.25, 0.5, 0.97, 1.0]


def table(spark, n=900):
    rng = np.random.default_rng(6)
    rows = [(["a", "b", None][i % 3], float(np.round(rng.normal() * 100, 2)), int(rng.integers(-5, 5)),
             None if i % 3 == 1 else float(rng.choice([1.5, np.nan, -0.0, 0.0]))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, x double, k int, z double").repartition(6)


@pytest.mark.parametrize("gather", [100_000, 40, 0])
def test_quantiles_of_all_columns_equal_numpy(spark, monkeypatch, gather):
    monkeypatch.setattr(sel, "GATHER", gather)
    rows, df = table(spark)
    got = {(r["g"], r["column"], r["q"]): r["value"] for r in
           sel.selected_quantiles(df, ["g"], ["x", "k", "z"], QS).collect()}
    want = {}
    for g in ("a", "b", None):
        for i, c in enumerate(("x", "k", "z"), 1):
            v = [float(r[i]) for r in rows if r[0] == g and r[i] is not None and r[i] == r[i]]
            want |= {(g, c, q): float(np.quantile(v, q)) for q in QS if v}
    assert got.keys() == want.keys() and ("b", "z", 0.5) not in got
    assert got == pytest.approx(want, rel=1e-12)


def test_quantiles_without_groups_rows_or_with_many_groups(spark, monkeypatch):
    rows, df = table(spark, 90)
    whole = {r["q"]: r["value"] for r in sel.selected_quantiles(df, [], ["x"], QS).collect()}
    assert whole == pytest.approx({q: float(np.quantile([r[1] for r in rows], q)) for q in QS})
    assert sel.selected_quantiles(df.where("x > 1e9"), ["g"], ["x"], QS).count() == 0
    assert sel.selected_quantiles(df.where("x > 1e9"), [], ["x"], QS).count() == 0
    few = df.where("g IS NOT NULL")
    want = sorted(map(tuple, sel.selected_quantiles(few, ["g"], ["x", "k"], QS).collect()))
    monkeypatch.setattr(sel, "MAX_GROUPS", 1)
    assert sorted(map(tuple, sel.selected_quantiles(few, ["g"], ["x", "k"], QS).collect())) == want


def test_quantiles_agree_with_the_ordering(spark):
    _, df = table(spark)
    df = df.where("g IS NOT NULL")
    a = {(r["g"], r["q_idx"]): r["value"] for r in rk.exact_quantiles(df, ["g"], "x", QS).collect()}
    b = {(r["g"], r["q_idx"]): r["value"] for r in sel.selected_quantiles(df, ["g"], ["x"], QS).collect()}
    assert a == pytest.approx(b, rel=1e-12)


@pytest.mark.parametrize("block", [4096, 7])
def test_silhouettes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(si, "BLOCK_ROWS", block)
    monkeypatch.setattr(si, "CHUNK_ROWS", 5)
    rng = np.random.default_rng(3)
    x, c = np.round(rng.normal(size=(61, 2)), 1), np.array([*rng.integers(0, 3, 60), 9])
    df = spark.createDataFrame([(i, int(k), *map(float, p)) for i, (p, k) in enumerate(zip(x, c))],
                               "id long, cluster int, p double, q double").repartition(4)
    got = {r["id"]: r for r in si.silhouettes(df, "id", "cluster", ["p", "q"]).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(61):
        mine = [far[i, j] for j in range(61) if c[j] == c[i] and j != i]
        other = min(far[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        s = (other - np.mean(mine)) / max(other, np.mean(mine)) if mine else 0.0
        assert got[i]["silhouette"] == pytest.approx(s, abs=1e-12) and got[i]["nearest"] == pytest.approx(other)
    assert got[60]["own"] is None
    means = {r["cluster"]: r for r in si.mean_silhouette(df, "id", "cluster", ["p", "q"]).collect()}
    assert means[None]["n"] == 61 and means[9]["silhouette"] == 0.0
    one = si.silhouettes(df.where("cluster = 0"), "id", "cluster", ["p", "q"]).collect()
    assert one and all(r["silhouette"] is None and r["nearest"] is None for r in one)
    assert si.silhouettes(df.where("id < 0"), "id", "cluster", ["p", "q"]).count() == 0
    with pytest.raises(Exception, match="null or NaN"):
        si.silhouettes(df.withColumn("p", F.when(F.col("id") > 3, F.col("p"))), "id", "cluster", ["p"]).count()


@pytest.mark.parametrize("block, most", [(1024, 3), (8, 3), (1024, 40)])
def test_clusterings_share_their_distances(spark, monkeypatch, block, most):
    monkeypatch.setattr(si, "BLOCK_ROWS", block)
    monkeypatch.setattr(si, "READ_ROWS", 50)
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, *map(int, rng.integers(0, most, 2)), *map(float, p)) for i, p in enumerate(rng.normal(size=(150, 2)))]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, p double, q double").repartition(3)
    columns = ["b", "a", "c"]
    got = {(r["clustering"], r["id"]): r for r in si.silhouettes_of(df, "id", columns, ["p", "q"]).collect()}
    assert len(got) == 3 * 150
    for i, column in enumerate(columns):
        for r in si.silhouettes(df, "id", column, ["p", "q"]).collect():
            mine = got[i, r["id"]]
            assert mine["cluster"] == r["cluster"] and (mine["own"] is None) == (r["own"] is None)
            assert (mine["nearest"], mine["silhouette"]) == pytest.approx((r["nearest"], r["silhouette"]), abs=1e-12)
    with pytest.raises(Exception, match="null or NaN"):
        si.silhouettes_of(df.withColumn("c", F.when(F.col("id") > 3, F.col("c"))), "id", columns, ["p"]).count()


@pytest.mark.parametrize("kind", ["spread", "near", "equal"])
def test_block_distances_keep_their_digits(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    y = {"spread": rng.normal(size=(300, 6)), "near": x[rng.integers(0, 40, 300)] + rng.normal(size=(300, 6)) * 1e-7,
         "equal": np.repeat(x[:1], 300, axis=0)}[kind]
    y[:40] = x
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    got = si.block_distances(x, y)
    assert np.abs(got - want).max() < 1e-11 and (got[np.arange(40), np.arange(40)] == 0).all()


def test_silhouettes_of_points_far_from_zero(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, *map(float, p)) for i, p in enumerate(np.round(rng.normal(size=(90, 2)), 3))]
    df = spark.createDataFrame(rows, "id long, cluster int, p double, q double")
    near = {r["id"]: r["silhouette"] for r in si.silhouettes(df, "id", "cluster", ["p", "q"]).collect()}
    far = df.select("id", "cluster", *[(F.col(c) + 2.0 ** 20).alias(c) for c in "pq"])
    assert {r["id"]: r["silhouette"] for r in si.silhouettes(far, "id", "cluster", ["p", "q"]).collect()} == \
        pytest.approx(near, abs=1e-8)


SCHEMA = T.StructType([T.StructField("segment", T.StringType()), T.StructField("ratio", T.DoubleType())])


def test_only_complete_versions_are_read(spark, tmp_path):
    root = f"file://{tmp_path}/recs"
    with pytest.raises(LookupError):
        versions.read_newest(spark, root, SCHEMA)
    first = versions.publish(spark.createDataFrame([("a", 1.0)], SCHEMA), root, SCHEMA)
    # a writer lost after its files, before its line
    spark.createDataFrame([("a", 9.0)], SCHEMA).write.parquet(f"{root}/version-{first + 10**15}-lost")
    assert versions.read_newest(spark, root, SCHEMA).collect() == [("a", 1.0)]
    old = versions.read_newest(spark, root, SCHEMA)
    # other column order, another type and a column too many
    new = spark.createDataFrame([(2, "x", "b"), (3, "y", "c")], "ratio int, extra string, segment string")
    second = versions.publish(new, root, SCHEMA)
    assert second > first and versions.versions(spark, root).count() == 2
    got = versions.read_newest(spark, root, SCHEMA)
    assert got.schema == SCHEMA and sorted(got.collect()) == [("b", 2.0), ("c", 3.0)]
    assert old.collect() == [("a", 1.0)]
    versions.publish(new.limit(0), root, SCHEMA)
    assert versions.read_newest(spark, root, SCHEMA).count() == 0


def test_a_version_that_lost_files_is_an_error(spark, tmp_path):
    root = f"{tmp_path}/recs"
    versions.publish(spark.range(40).select(F.col("id").cast("string").alias("segment"), F.lit(1.0).alias("ratio"))
                     .repartition(3), root, SCHEMA)
    folder = next(d for d in os.listdir(root) if d.startswith("version-"))
    os.remove(next(f"{root}/{folder}/{f}" for f in os.listdir(f"{root}/{folder}") if f.endswith(".parquet")))
    with pytest.raises(LookupError, match="published were 40"):
        versions.read_newest(spark, root, SCHEMA)


@pytest.mark.parametrize("files", [1, 3, 8])
def test_sorted_files_and_their_ranks(spark, tmp_path, files):
    rng = np.random.default_rng(files)
    rows = [(int(rng.integers(0, 5)), int(i), f"t{i}") for i in rng.permutation(700)]
    df = spark.createDataFrame([*rows, (None, 9000, "n")], "k long, i long, t string").repartition(4)
    io.write_sorted(df, str(tmp_path / "s"), ["k", "i"], files)
    table = spark.read.parquet(str(tmp_path / "s"))
    parts = sorted(f for f in os.listdir(tmp_path / "s") if f.endswith(".parquet"))
    assert len(parts) <= files and io.file_bounds(table, ["k", "i"]).count() == len(parts)
    assert io.file_overlaps(table, ["k", "i"]).first() == (701, 0)
    in_order = [r for p in parts for r in spark.read.parquet(str(tmp_path / "s" / p)).collect()]
    want = sorted([*rows, (None, 9000, "n")], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r) for r in in_order] == want
    ranks = {r["i"]: r["rank"] for r in io.rank_from_files(table, ["k", "i"]).collect()}
    assert ranks == {r[1]: at for at, r in enumerate(want, 1)}
    df.repartition(3).write.parquet(str(tmp_path / "u"))
    assert io.file_overlaps(spark.read.parquet(str(tmp_path / "u")), ["k", "i"]).first()["n_overlaps"] > 0
