"""Looking into fitted models: permutation importance, partial dependence and
certificates that a fit is optimal.

None of them orders the test rows globally or multiplies them by a grid:

- a permutation takes, for every row, the values of the next row in a random
  order inside a random bucket (cyclically), so one hash exchange of the rows
  serves all features of a repeat;
- partial dependence carries the whole grid of predictions as one vector per
  row, summed position by position inside each task;
- a certificate recomputes what defines the optimum (a gradient, the nearest
  centre, an eigenvector's residual, the loss per round) with plain
  aggregations over the training rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratecard.operators.ranking import banded_auc_by, exact_quantiles, score_edges
from ratecard.session import ensure_checkpoint_dir

BUCKET_ROWS = 50_000  # rows among which a repeat permutes


# ---- permutation importance -----------------------------------------------------

def cyclic_neighbours(df: DataFrame, columns: Sequence[str], keys: Sequence[str], repeats: int,
                      seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row once per repeat (``_r``), with another row's ``columns`` as ``_other``.

    In each repeat rows are dealt by a hash of ``keys`` into buckets of about
    ``bucket_rows``; inside a bucket they stand in the order of a second hash
    and each takes the values of the next one, the last those of the first.
    Over all rows that is a permutation without fixed rows (but for a bucket of
    one). One hash exchange; ``keys`` should name a row, as equal keys share a
    bucket. Counts the rows while the plan is built."""
    buckets = max(1, -(-df.count() // bucket_rows))
    mark = F.xxhash64(*keys, F.col("_r"), F.lit(seed))
    dealt = (df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
             .withColumn("_mark", mark).withColumn("_bucket", F.pmod("_mark", F.lit(buckets))))
    order = [F.xxhash64("_mark", F.lit(seed + 1)), *[F.col(k) for k in keys]]
    w = Window.partitionBy("_r", "_bucket").orderBy(*order)
    values = F.struct(*columns)
    first = F.first(values).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (dealt.withColumn("_other", F.coalesce(F.lead(values).over(w), first))
            .drop("_mark", "_bucket"))


def permutation_importance(score: Callable[[DataFrame], DataFrame], test: DataFrame,
                           features: Sequence[str], label_col: str, keys: Sequence[str],
                           n_repeats: int = 8, seed: int = 42, model: PipelineModel | None = None) -> DataFrame:
    """AUC drop when one feature's values are permuted across the test rows.

    All (feature, repeat) replicas and the unpermuted rows are scored in one
    model pass; their AUCs come from ``banded_auc_by``. No range exchange.
    With ``model``, the boosted pipeline that ``score`` applies, a row is encoded
    once per repeat and its replicas are scored by the trees that ask for the
    permuted feature (``tree_replicas``)."""
    feats = list(features)
    rows = test.select(*dict.fromkeys([*keys, label_col, *feats]))
    edges = score_edges(score(rows), "score")
    moved = cyclic_neighbours(rows, feats, keys, n_repeats, seed)
    if model is not None:
        aucs = banded_auc_by(tree_replicas(model, moved, feats, label_col), ["_f", "_r"], "score", label_col, edges)
        name = F.get(F.array(*[F.lit(f) for f in feats]), F.col("_f"))
        return _auc_drops(aucs.withColumn("_f", F.coalesce(name, F.lit(""))))
    # the feature "" leaves the row as it is: the base score, once
    names = F.array(*[F.lit(f) for f in feats])
    moved = moved.withColumn("_f", F.explode(
        F.when(F.col("_r") == 0, F.concat(names, F.array(F.lit("")))).otherwise(names)))
    permuted = moved.select(label_col, "_f", "_r", *[
        F.when(F.col("_f") == f, F.col("_other")[f]).otherwise(F.col(f)).alias(f) for f in feats])
    return _auc_drops(banded_auc_by(score(permuted), ["_f", "_r"], "score", label_col, edges))


def _auc_drops(aucs: DataFrame) -> DataFrame:
    """Per feature the mean and deviation of its replicas' loss of AUC; the feature "" is the base."""
    # one row per replica: the base is read across them
    base = F.max(F.when(F.col("_f") == "", F.col("roc_auc"))).over(Window.partitionBy(F.lit(1)))
    return (aucs.withColumn("_base", base).where("_f <> ''").groupBy(F.col("_f").alias("feature"))
            .agg((F.max("_base") - F.avg("roc_auc")).alias("importance_mean"),
                 F.stddev_pop("roc_auc").alias("importance_std")))


# ---- boosted trees as arrays ------------------------------------------------------

@dataclass(frozen=True)
class Tree:
    """Nodes by position; leaves have feature -1. A row goes left if its value is at most the threshold
    or, for a categorical feature, one of the listed categories."""

    weight: float
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    categories: tuple[tuple[float, ...] | None, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.feature[node] < 0 or not len(rows):
                out[rows] = self.value[node]
                continue
            v = x[rows, self.feature[node]]
            some = self.categories[node]
            left = v <= self.threshold[node] if some is None else np.isin(v, some)
            stack += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return out

    def by_columns(self, x: np.ndarray, node: int = 0) -> np.ndarray | float:
        """``predict`` for rows given as columns (``x``: position x row); one number if all rows agree. Rows are
        marked leaf by leaf and take their value at the end: a mark costs a byte, a value eight."""
        if self.feature[node] < 0:
            return self.value[node]
        ends, stack = [], [(node, None)]
        while stack:
            node, there = stack.pop()
            if self.feature[node] < 0:
                ends.append((node, there))
                continue
            v, some = x[self.feature[node]], self.categories[node]
            if some is None:
                left = v <= self.threshold[node]
            else:
                left = v == some[0] if len(some) == 1 else np.isin(v, some)
            right = ~left
            if there is not None:
                left &= there
                right &= there
            stack += [(self.left[node], left), (self.right[node], right)]
        place = np.zeros(x.shape[1], np.uint8 if len(ends) <= 256 else np.uint32)
        for k, (_, there) in enumerate(ends[1:], 1):
            place += there.astype(place.dtype) * place.dtype.type(k)
        return np.array([self.value[node] for node, _ in ends]).take(place)

    def cuts(self, feature: int) -> list[float]:
        return sorted({self.threshold[i] for i, f in enumerate(self.feature)
                       if f == feature and self.categories[i] is None})


def tree_arrays(model) -> list[Tree]:
    """The trees of a fitted boosted model, read from its saved form in the shared folder. A model is
    bounded by its rounds and depth, so the driver may hold it."""
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosted-{uuid.uuid4().hex}"
    model.save(path)
    weights = model.treeWeights
    nodes: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").collect():
        nodes.setdefault(r["treeID"], []).append(r["nodeData"])
    out = []
    for tree in sorted(nodes):
        rows = sorted(nodes[tree], key=lambda n: n["id"])
        at = {n["id"]: i for i, n in enumerate(rows)}
        leaf = [n["leftChild"] < 0 for n in rows]
        some = [n["split"]["leftCategoriesOrThreshold"] for n in rows]
        plain = [n["split"]["numCategories"] == -1 for n in rows]
        out.append(Tree(
            float(weights[tree]),
            tuple(-1 if end else n["split"]["featureIndex"] for end, n in zip(leaf, rows)),
            tuple(s[0] if not end and p else math.nan for end, p, s in zip(leaf, plain, some)),
            tuple(None if end or p else tuple(s) for end, p, s in zip(leaf, plain, some)),
            tuple(-1 if end else at[n["leftChild"]] for end, n in zip(leaf, rows)),
            tuple(-1 if end else at[n["rightChild"]] for end, n in zip(leaf, rows)),
            tuple(n["prediction"] for n in rows)))
    return out


def grid_margins(trees: Sequence[Tree], x: np.ndarray, feature: int, grid: np.ndarray) -> np.ndarray:
    """The ensemble's sum for every row (of ``x``) and every grid value of one numeric feature.

    A tree that never asks for the feature is evaluated once; any other once per interval between its
    own thresholds on it, and the grid points take the value of their interval."""
    out = np.zeros((len(x), len(grid)))
    fixed, x = np.zeros(len(x)), x.copy()
    for tree in trees:
        cuts = tree.cuts(feature)
        if not cuts:
            fixed += tree.weight * tree.predict(x)
            continue
        at = np.searchsorted(cuts, grid, side="left")  # a value equal to a threshold goes left
        for k in np.unique(at).tolist():
            x[:, feature] = cuts[k] if k < len(cuts) else np.inf
            out[:, at == k] += tree.weight * tree.predict(x)[:, None]
    return out + fixed[:, None]


def replica_margins(trees: Sequence[Tree], x: np.ndarray, other: np.ndarray,
                    places: Sequence[np.ndarray]) -> Iterator[np.ndarray]:
    """The ensemble's sum for the rows ``x`` (position x row) and then, for each of ``places`` (the positions
    of one feature), for the rows with ``other``'s values at these positions.

    A tree that asks for none of the positions keeps its values. The trees are added in their order every
    time, so that rows with equal leaves have equal sums."""
    asked = [set(t.feature) for t in trees]
    kept = [t.weight * t.by_columns(x) for t in trees]

    def added(values) -> np.ndarray:
        out = np.zeros(x.shape[1])
        for v in values:
            out += v
        return out

    yield added(kept)
    for at in places:
        mixed, where = x.copy(), set(at.tolist())
        mixed[at] = other[at]
        yield added(k if where.isdisjoint(a) else t.weight * t.by_columns(mixed)
                    for t, a, k in zip(trees, asked, kept))


REPLICA_ROWS = 10_000  # rows whose values of all trees are held at a time (some 25 MB)


def tree_replicas(model: PipelineModel, moved: DataFrame, feats: Sequence[str], label_col: str) -> DataFrame:
    """The scored replicas of the rows of ``cyclic_neighbours``: the label, ``_f`` (the number of the permuted
    feature; -1: none, in the first repeat only), ``_r`` and ``score``."""
    trees, encode = tree_arrays(model.stages[-1]), PipelineModel(model.stages[:-1])
    x = vector_to_array("features")
    mine = encode.transform(moved)
    names = feature_names(mine)
    places = [np.array([i for i, n in enumerate(names) if n == f or n.startswith(f"_{f}_oh_")], int) for f in feats]
    mine = mine.select(label_col, "_r", "_other", x.alias("_x"))
    both = encode.transform(mine.select(label_col, "_r", "_x", "_other.*")).select(
        F.col(label_col).alias("y"), "_r", "_x", x.alias("_o"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, REPLICA_ROWS):
                b = whole.slice(start, REPLICA_ROWS)
                own, other = (np.ascontiguousarray(b.column(c).flatten().to_numpy().reshape(b.num_rows, -1).T)
                              for c in ("_x", "_o"))
                first = pa.array(b.column("_r").to_numpy() == 0)
                for f, margin in enumerate(replica_margins(trees, own, other, places), -1):
                    out = pa.record_batch({
                        label_col: b.column("y"), "_f": pa.array(np.full(len(margin), f, np.int32)),
                        "_r": b.column("_r"), "score": pa.array(1 / (1 + np.exp(-2 * margin)))})
                    yield out if f >= 0 else out.filter(first)

    label_type = moved.schema[label_col].dataType.simpleString()
    return both.mapInArrow(scored, f"`{label_col}` {label_type}, _f int, _r int, score double")


def partial_dependence(model: PipelineModel, test: DataFrame, feature: str, points: int = 100,
                       lo_q: float = 0.05, hi_q: float = 0.95) -> DataFrame:
    """Average probability of the positive class with the numeric ``feature`` set to each of ``points``
    values spread evenly between its 5th and 95th percentiles, for a boosted classifier.

    A row's predictions are one vector of ``points`` numbers; every task adds them up and sends a single
    vector, so the test rows are never multiplied. Null rows of the feature take part like any other
    (the feature is replaced). An empty table gives no rows."""
    q = {r["q_idx"]: r["value"] for r in
         exact_quantiles(test, [], feature, [lo_q, hi_q]).select("q_idx", "value").collect()}
    schema = "grid_value double, avg_prediction double, feature string"
    if not q:
        return test.sparkSession.createDataFrame([], schema)
    grid = np.linspace(q[0], q[1], points)
    trees = tree_arrays(model.stages[-1])
    rows = PipelineModel(model.stages[:-1]).transform(test)
    at = feature_index(rows, feature)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(points), 0
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                column = b.column("x").slice(start, 2000)
                x = column.flatten().to_numpy().reshape(len(column), -1)
                total += (1 / (1 + np.exp(-2 * grid_margins(trees, x, at, grid)))).sum(axis=0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())),
                                              pa.array([n], pa.int64())], ["total", "n"])

    per_task = rows.select(vector_to_array("features").alias("x")).mapInArrow(
        sums, "total array<double>, n long")
    whole = per_task.agg(F.array(*[F.sum(F.col("total")[i]) for i in range(points)]).alias("total"),
                         F.sum("n").alias("n"))
    # one row from here on
    lines = F.arrays_zip(F.array(*[F.lit(float(g)) for g in grid]).alias("grid_value"), F.col("total").alias("s"))
    return (whole.select(F.explode(lines).alias("g"), "n")
            .select(F.col("g.grid_value").alias("grid_value"), (F.col("g.s") / F.col("n")).alias("avg_prediction"),
                    F.lit(feature).alias("feature")))


# ---- optimality certificates ------------------------------------------------------

def feature_names(rows: DataFrame, column: str = "features") -> list[str]:
    """The names of an assembled vector's positions, from its metadata."""
    attrs = rows.schema[column].metadata["ml_attr"]["attrs"]
    named = {a["idx"]: a.get("name", "") for kind in attrs.values() for a in kind}
    return [named[i] for i in range(len(named))]


def feature_index(rows: DataFrame, feature: str) -> int:
    return feature_names(rows).index(feature)


def logistic_gradient(model: PipelineModel, train: DataFrame, label_col: str,
                      num_cols: Sequence[str], weight_col: str | None = None) -> DataFrame:
    """Per coefficient (and for the intercept) the penalised gradient of the fitted logistic loss.

    The fit minimises mean weighted log-loss + regParam / 2 * |coefficients|^2, so at the optimum
    every entry is 0. One aggregation over the training rows."""
    logit = model.stages[-1]
    rows = PipelineModel(model.stages[:-1]).transform(train)
    beta, penalty = logit.coefficients.toArray(), logit.getRegParam()
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    p = vector_to_array(logit.getProbabilityCol())[1]
    scored = logit.transform(rows).select(
        (w * (p - F.col(label_col).cast("double"))).alias("pull"), w.alias("w"), vector_to_array("features").alias("x"))
    sums = scored.agg(F.sum("w").alias("w"), F.sum("pull").alias("pull"),
                      *[F.sum(F.col("pull") * F.col("x")[i]).alias(f"g{i}") for i in range(len(beta))]).first()
    scaled = iter(num_cols)
    entries = []
    for i, name in enumerate(feature_names(rows)):
        if "_oh_" in name:
            name = name.removeprefix("_").replace("_oh_", "=", 1)
        else:  # positions of the standardised vector, in the order of the numeric columns
            name = next(scaled)
        entries.append((name, sums[f"g{i}"] / sums["w"] + penalty * float(beta[i])))
    entries.append(("intercept", sums["pull"] / sums["w"]))
    return train.sparkSession.createDataFrame(entries, "coefficient string, gradient double")


def kmeans_certificate(model, data: DataFrame) -> DataFrame:
    """Per cluster the rows that lie nearer to another centre than to their own and the largest
    distance, over the features, of the centre from the mean of its rows. Both are 0 at a fixed
    point of K-means."""
    centres = [c.tolist() for c in model.clusterCenters()]
    rows = model.transform(data).select("cluster", vector_to_array("features").alias("x"))
    distances = F.array(*[sum(((F.col("x")[i] - F.lit(v)) ** 2 for i, v in enumerate(c)), F.lit(0.0))
                          for c in centres])
    rows = rows.withColumn("d", distances)
    size = len(centres[0])
    nearer = F.get("d", F.col("cluster")) > F.array_min("d") + 1e-9
    means = rows.groupBy("cluster").agg(F.sum(nearer.cast("long")).alias("nearer_elsewhere"),
                                        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)])
    # one row per cluster
    own = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres])
    gap = F.greatest(*[F.abs(F.get(F.get(own, F.col("cluster")), F.lit(i)) - F.col(f"m{i}")) for i in range(size)])
    return means.select(F.col("cluster").cast("long").alias("cluster"), "nearer_elsewhere", gap.alias("centre_gap"))


def pca_certificate(components: np.ndarray, ratios: Sequence[float], data: DataFrame,
                    column: str = "features") -> DataFrame:
    """Per component v (columns of ``components``) with eigenvalue l: the largest entry of
    |Cov v - l v|, |v|, and v's product with the next component. The covariance is one aggregation."""
    size, k = components.shape
    x = data.select(vector_to_array(column).alias("x"))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    row = x.agg(*[F.covar_samp(F.col("x")[i], F.col("x")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((size, size))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    entries = []
    for c in range(k):
        v = components[:, c]
        value = ratios[c] * np.trace(cov)
        entries.append((c + 1, float(np.abs(cov @ v - value * v).max()), float(np.sqrt(v @ v)),
                        float(v @ components[:, (c + 1) % k]) if k > 1 else 0.0))
    return data.sparkSession.createDataFrame(
        entries, "component int, residual double, length double, product_with_next double")


LOSS_ROWS = 10_000  # rows whose margins are held at a time: they stay in a core's cache


def boosting_losses(model: PipelineModel, train: DataFrame, label_col: str, loss: str | None = None) -> list[float]:
    """The training loss after every boosting round: a classifier's mean of 2 log(1 + exp(-2ym)) (y: -1 or 1, m: the
    sum of the trees so far), or with ``loss`` a regressor's.

    A classifier's trees are added one after the other to the margins of some rows; a task sends a sum per round."""
    rows = PipelineModel(model.stages[:-1]).transform(train)
    boosted = model.stages[-1]
    rows = rows.withColumn(boosted.getLabelCol(), F.col(label_col).cast("double"))
    if loss is not None:
        return boosted.evaluateEachIteration(rows, loss)
    trees = tree_arrays(boosted)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(trees)), 0
        for whole in batches:
            for start in range(0, whole.num_rows, LOSS_ROWS):
                b = whole.slice(start, LOSS_ROWS)
                y = b.column("y").to_numpy(zero_copy_only=False)
                if not np.isin(y, (0.0, 1.0)).all():
                    raise ValueError("labels must be 0 or 1")
                x = np.ascontiguousarray(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1).T)
                side, margin = 2.0 - 4.0 * y, np.zeros(b.num_rows)   # -2y
                for i, tree in enumerate(trees):
                    margin += tree.weight * tree.by_columns(x)
                    z = side * margin
                    # log(1 + exp(z)) without overflow
                    total[i] += 2 * (np.maximum(z, 0).sum() + np.log1p(np.exp(-np.abs(z))).sum())
                n += b.num_rows
        if n:
            yield pa.record_batch({"total": pa.array([total.tolist()], pa.list_(pa.float64())),
                                   "n": pa.array([n], pa.int64())})

    per_task = rows.select(vector_to_array(boosted.getFeaturesCol()).alias("x"), F.col(boosted.getLabelCol()).alias("y"))
    whole = per_task.mapInArrow(sums, "total array<double>, n long").agg(
        F.array(*[F.sum(F.col("total")[i]) for i in range(len(trees))]).alias("total"), F.sum("n").alias("n")).first()
    return [t / whole["n"] if whole["n"] else math.nan for t in whole["total"]]


def loss_rises(losses: Sequence[float], slack: float = 1e-9) -> int:
    """In how many rounds the training loss rose."""
    return sum(b > a + slack for a, b in zip(losses, losses[1:]))


def hot_entries(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """The one-hot positions of every row that are set, by name: ``key``, ``name``, ``value``. What is
    encoded is read back from the assembled vector, so indexer, encoder and assembler are all seen."""
    rows = PipelineModel(model.stages[:-1]).transform(df)
    names = [n.removeprefix("_").replace("_oh_", "=", 1) if "_oh_" in n else None for n in feature_names(rows)]
    x = vector_to_array("features")
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.get(x, F.lit(i)).alias("value"))
                        for i, n in enumerate(names) if n is not None])
    return rows.select(key, F.inline(F.filter(entries, lambda e: e["value"] != 0.0)))


def scoring_differences(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` scored and the largest ``difference`` between the model's probabilities and
    the same computed from its parts: coefficients as plain columns, or trees as arrays."""
    last = model.stages[-1]
    rows = PipelineModel(model.stages[:-1]).transform(df)
    p = vector_to_array(last.getProbabilityCol())[1].alias("p")
    rows = last.transform(rows).select(vector_to_array("features").alias("x"), p)
    if hasattr(last, "coefficients"):
        z = sum((F.col("x")[i] * float(b) for i, b in enumerate(last.coefficients.toArray())), F.lit(float(last.intercept)))
        own = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("p") - own)).alias("difference"))
    trees = tree_arrays(last)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                margin = sum(t.weight * t.predict(x) for t in trees)
                gap = np.abs(b.column("p").to_numpy() - 1 / (1 + np.exp(-2 * margin))).max()
                yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64()), "gap": pa.array([gap])})

    return rows.mapInArrow(compare, "n long, gap double").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.max("gap").alias("difference"))
