"""Boosted trees from binned rows: the trees of MLlib's own fit, in one task and over cached blocks."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from ratecard.operators import boosting as bo
from ratecard.operators import churn as ch
from ratecard.operators import inspection as ins


def table(spark, n=900):
    rng = np.random.default_rng(11)
    a, b, c = np.round(rng.normal(size=n), 3), rng.integers(0, 9, n), rng.choice(list("pqrst"), n)
    y = (a + (c == "q") + 0.3 * b + rng.normal(size=n) > 1.2).astype(int)
    rows = [(float(u), int(v), None if i % 50 == 7 else str(w), int(z)) for i, (u, v, w, z) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(rows, "a double, b int, c string, y int").repartition(3)


@pytest.mark.parametrize("one_task, block, rebase", [(10 ** 6, 100_000, 50), (0, 100, 3)])
def test_trees_equal_mllib(spark, monkeypatch, one_task, block, rebase):
    monkeypatch.setattr(bo, "ONE_TASK_ROWS", one_task)
    monkeypatch.setattr(bo, "BLOCK_ROWS", block)
    monkeypatch.setattr(bo, "REBASE", rebase)
    df = table(spark)
    mine = ch.fit_gbt(df, ["c"], ["a", "b"], "y", max_depth=3, step=0.2, max_iter=8)
    theirs = Pipeline(stages=[*ch._prep_stages(["c"], ["a", "b"], False), GBTClassifier(
        labelCol="y", maxDepth=3, stepSize=0.2, maxIter=8, maxBins=255, seed=42)]).fit(df)
    assert mine.stages[-1].getNumTrees == 8 and mine.stages[-1].treeWeights == theirs.stages[-1].treeWeights
    scored = [sorted(ch.positive_probability(m, df, "p").select("a", "b", "c", "y", "p").collect(), key=str)
              for m in (mine, theirs)]
    assert [r["p"] for r in scored[0]] == pytest.approx([r["p"] for r in scored[1]], abs=1e-12)
    a, b = (ins.boosting_losses(m, df, "y") for m in (mine, theirs))
    assert a == pytest.approx(b, abs=1e-12) and ins.loss_rises(a) == 0


def test_cuts_from_a_summary_use_every_row(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    exact = bo.numeric_cuts(df, ["v"], 5000, 10)[0]
    monkeypatch.setattr(bo, "VALUES", 100)
    near = bo.numeric_cuts(df, ["v"], 5000, 10)[0]
    assert len(exact) == len(near) == 9 and near == pytest.approx(exact, abs=10)


def test_few_values_are_cut_between_all():
    assert bo.strided_cuts([0.0, 1.0, 4.0], [5, 1, 2], 255) == [0.5, 2.5]
    assert bo.strided_cuts([3.0], [7], 255) == []


@pytest.mark.parametrize("bad", ["CASE WHEN a > 2 THEN NULL ELSE a END", "CASE WHEN a > 2 THEN double('NaN') ELSE a END"])
def test_a_feature_without_a_value_is_an_error(spark, bad):
    with pytest.raises(Exception, match="null, NaN or infinite"):
        ch.fit_gbt(table(spark).withColumn("a", F.expr(bad)), ["c"], ["a", "b"], "y", max_depth=2, max_iter=2)
    with pytest.raises(Exception, match="0 or 1"):
        ch.fit_gbt(table(spark).withColumn("y", F.lit(2)), ["c"], ["a", "b"], "y", max_depth=2, max_iter=2)
    with pytest.raises(ValueError, match="no training rows"):
        ch.fit_gbt(table(spark).where("a > 1e9"), ["c"], ["a"], "y", max_depth=2, max_iter=2)


def test_held_rows_step_from_level_to_level():
    rng = np.random.default_rng(3)
    widths = [4, 6]
    blocks = [(np.array([rng.integers(0, w, n) for w in widths], np.uint8), rng.choice([-1, 1], n).astype(np.int8),
               np.zeros(n)) for n in (40, 25)]
    settings = (5, 3, 0.3, [3], [[0.5, 1.5, 2.5, 3.5, 4.5]], widths)
    anew = [(c, y, m.copy()) for c, y, m in blocks]
    by_jobs = bo._rounds(*settings, lambda tree, opened, level, first: bo._summed(
        bo._counted(tree.bare(), opened, level, first, widths)(anew)),
        lambda trees: anew.__setitem__(slice(None), bo._moved([trees[-1].bare()])(anew)))
    held = bo.Held(blocks, widths)
    for a, b in zip(by_jobs, bo._rounds(*settings, held.counted, held.add), strict=True):
        assert (a.column == b.column).all() and a.value == pytest.approx(b.value, abs=1e-12)
    assert all(t.split for t in by_jobs)


def test_of_two_large_siblings_one_is_counted(monkeypatch):
    monkeypatch.setattr(bo, "BOTH_ROWS", 0)
    rng = np.random.default_rng(8)
    widths, n = [4, 6, 3], 300
    codes = np.array([rng.integers(0, w, n) for w in widths], np.uint8)
    y = np.where(codes[1] + rng.normal(size=n) > 3, 1, -1).astype(np.int8)
    settings = (6, 4, 0.3, [3], [[0.5, 1.5, 2.5, 3.5, 4.5], [0.5, 1.5]], widths)
    held, asked, counted = bo.Held([(codes, y, np.zeros(n))], widths), [], 0

    def count(tree, nodes, level, first):
        nonlocal counted
        sums = held.counted(tree, nodes, level, first)
        asked.append(nodes)
        counted += sums[0][:, :widths[0]].sum()
        return sums

    trees = bo._rounds(*settings, count, held.add)
    assert all(len({(node - 1) // 2 for node in nodes}) == len(nodes) for nodes in asked)
    assert counted <= 6 * n * (1 + 3 / 2)   # every row at the root, at most half of them on each level below
    # what was not counted equals the sums of the rows themselves
    margin = np.zeros(n)
    for m, t in enumerate(trees):
        g, at = bo._residuals(y, margin, m == 0), t.nodes(codes, t.depth)
        for node, rows in at.items():
            assert t.value[node] == pytest.approx(g[rows].mean(), abs=1e-12) and t.stats[node][0] == len(rows)
        t.moved(margin, at)
    assert sorted(np.concatenate(list(at.values()))) == list(range(n))


def test_a_level_reads_the_rows_of_its_open_nodes_in_their_order():
    """Sums to the last bit those of one pass over all rows: rounding decides between splits of equal gain."""
    rng = np.random.default_rng(8)
    widths, n = [4, 6, 3], 300
    codes = np.repeat(np.array([rng.integers(0, w, n // 2) for w in widths], np.uint8), 2, axis=1)  # every row twice
    y = np.where(codes[1] + rng.normal(size=n) > 3, 1, -1).astype(np.int8)
    held = bo.Held([(codes, y, np.zeros(n))], widths)
    levels = []

    def count(tree, opened, level, first):
        sums = held.counted(tree, opened, level, first)
        at, g = held.at[0], held.g[0]
        slot = np.full(n, -1)
        for k, node in enumerate(opened):
            assert (np.diff(at[node]) > 0).all()
            slot[at[node]] = k
        there = slot >= 0
        start = 0
        for j, w in enumerate(widths):
            place = slot[there] * w + codes[j][there]
            assert (sums[1][:, start:start + w].ravel() == np.bincount(place, g[there], len(opened) * w)).all()
            start += w
        assert sums[0][:, :widths[0]].sum() == there.sum()
        assert sorted(np.concatenate(list(at.values()))) == list(range(n))
        levels.append(level)
        return sums

    trees = bo._rounds(6, 4, 0.3, [3], [[0.5, 1.5, 2.5, 3.5, 4.5], [0.5, 1.5]], widths, count, held.add)
    assert len(trees) == 6 and max(levels) == 3


def test_half_a_million_rows_need_no_job_per_level(spark, monkeypatch):
    monkeypatch.setattr(bo, "_counted", None)
    n = 500_000
    df = spark.range(n).select((F.col("id") % 50).cast("double").alias("a"), F.expr("string(id % 3)").alias("c"),
                               (F.col("id") % 7 < 2).cast("int").alias("y"))
    assert ch.fit_gbt(df, ["c"], ["a"], "y", max_depth=2, max_iter=3).stages[-1].getNumTrees == 3


def test_joint_counts_equal_those_per_column(monkeypatch):
    """Rows, residuals and squares per node and code, whether columns are counted together or one by one."""
    rng = np.random.default_rng(5)
    widths, n = [7, 300, 4, 40, 9_000, 3], 30_000
    codes = np.array([rng.integers(0, w, n) for w in widths], np.uint32)
    blocks = [(codes, rng.choice([-1, 1], n).astype(np.int8), rng.normal(size=n))]
    tree = bo.Growing(1.0, 3, max(widths))
    tree.column[[0, 1, 2]] = 1, 0, 4
    tree.to_right[0, 120:300] = True          # beyond a threshold
    tree.to_right[1, :7] = np.arange(7) != 3  # all but one category
    tree.to_right[2, 5] = True                # one category
    asked = [3, 4, 5, 6]
    together = next(bo._counted(tree.bare(), asked, 2, False, widths)(blocks))
    plain = bo._no_sums(len(asked), widths)
    bo._add_block(plain, codes, bo._residuals(blocks[0][1], blocks[0][2], False), tree.nodes(codes, 2), asked, widths)
    assert (together[0] == plain[0]).all()
    assert together[1] == pytest.approx(plain[1], abs=1e-9) and together[2] == pytest.approx(plain[2])
    # of a block's rows at the root a group of columns is counted once, and rows that are known not at all
    narrow = [7, 50, 4, 40, 3]
    counts = []
    monkeypatch.setattr(bo.np, "bincount", lambda *a, f=np.bincount, **k: counts.append(1) or f(*a, **k))
    next(bo._counted(tree.bare(), [0], 0, False, narrow, True)([(codes[[0, 3, 2, 3, 5]], *blocks[0][1:])]))
    assert len(counts) == len(bo._joint_columns(narrow)) < len(narrow)


@pytest.mark.parametrize("flagged", [[], [0], [3], [2, 3, 4], [0, 1, 3, 4], [0, 1, 4, 5, 6], [1, 2, 5], [0, 2, 4], range(7)])
def test_flags_by_comparison(flagged):
    flags = np.isin(np.arange(9), list(flagged))
    codes = np.array([*range(9), 3, 3], np.uint8)
    assert (bo._among(codes, flags) == flags[codes]).all()


def test_steps_are_the_values_of_the_leaves():
    rng = np.random.default_rng(6)
    codes = np.array([rng.integers(0, 6, 500), rng.integers(0, 5, 500)], np.uint8)
    tree = bo.Growing(0.3, 3, 6)
    tree.column[[0, 1, 5]] = 0, 1, 0
    tree.to_right[0, 2:6], tree.to_right[1, 1], tree.to_right[5, 4:6] = True, True, True
    tree.value = rng.normal(size=15)
    margin = np.zeros(500)
    tree.moved(margin, tree.nodes(codes, 3))
    assert (tree.steps(codes) == margin).all() and len(set(margin.tolist())) == 3


def test_tasks_of_a_large_table_fill_all_cores(spark, monkeypatch):
    monkeypatch.setattr(bo, "PART_ROWS", 100)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 20)
    rows = spark.range(450).select((F.col("id") % 3).cast("double").alias("c0"), (F.col("id") % 2).cast("double").alias("y"))
    parts = []
    monkeypatch.setattr(bo, "freeze", lambda df: parts.append(df.rdd.getNumPartitions()) or df)
    bo.coded_blocks(rows, 450, 1, [], np.uint8)
    cores = spark.sparkContext.defaultParallelism
    assert parts[0] % cores == 0 and parts[0] >= 5
