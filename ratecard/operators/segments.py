"""Behavioural segmentation and its comparison with assigned tiers.

Clusters come either from Spark ML K-means on standardised RFM features
(the model path) or from a fixed behavioural rule (the SQL-checkable
path); every comparison operator below works on any ``cluster`` column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratecard.operators.silhouette import silhouettes_of
from ratecard.session import ensure_checkpoint_dir, freeze

SEGMENT_FEATURES = ("log_recency", "log_frequency", "log_monetary",
                    "acceptance_rate", "avg_price_ratio", "express_share")
PROFILE_COLS = ("recency_days", "frequency_per_year", "monetary_per_year", "acceptance_rate",
                "avg_price_ratio", "express_share", "avg_weight_kg", "avg_distance_km",
                "tenure_years")

# Business names given to clusters by rank.
NAME_TOP = "High-Value Core"
NAME_BOTTOM = "Low-Engagement / Occasional"
NAME_WEAKEST = "Price-Sensitive / At-Risk"
NAME_REST = "Steady Mid-Value"


def rule_clusters(rfm: DataFrame, accept_threshold: float = 2 / 3,
                  express_threshold: float = 0.4) -> DataFrame:
    """Deterministic 4-way behavioural grouping (acceptance x urgency)."""
    return rfm.withColumn(
        "cluster",
        ((F.col("acceptance_rate") >= F.lit(accept_threshold)).cast("int") * 2
         + (F.col("express_share") >= F.lit(express_threshold)).cast("int")).cast("int"))


def listed(col: str, values) -> F.Column:
    """The column, with an error for any row whose value is not in ``values``."""
    c = F.col(col)
    return F.when(c.isin(*values), c).otherwise(F.raise_error(
        F.concat(F.lit(f"{col}: unlisted value "), F.coalesce(c.cast("string"), F.lit("null")))))


def crosstab(df: DataFrame, row_col: str, col_col: str, col_order) -> DataFrame:
    """Counts with a fixed, zero-filled column order (pivot with explicit
    values: one aggregation, no distinct-values pass). A value outside
    ``col_order`` is an error, never a missing column."""
    wide = (df.withColumn(col_col, listed(col_col, col_order)).groupBy(row_col)
            .pivot(col_col, list(col_order)).agg(F.count(F.lit(1))))
    return wide.select(row_col, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c)
                                  for c in col_order])


def crosstab_row_pct(ct: DataFrame, row_col: str, col_order) -> DataFrame:
    total = sum((F.col(f"`{c}`") for c in col_order), F.lit(0))
    return ct.select(row_col, *[(F.col(f"`{c}`") / total).alias(c) for c in col_order])


def dominant_tier(df: DataFrame, cluster_col: str, tier_col: str, tier_order) -> DataFrame:
    """Most frequent tier per cluster; ties go to the first tier in order."""
    order = F.array(*[F.lit(t) for t in tier_order])
    counts = df.groupBy(cluster_col, tier_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(cluster_col).orderBy(F.col("_n").desc(),
                                                F.array_position(order, F.col(tier_col)))
    return (counts.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select(cluster_col, F.col(tier_col).alias("dominant_tier")))


def adjusted_rand_index(df: DataFrame, a_col: str, b_col: str) -> DataFrame:
    """ARI from the contingency table: sums of C(n,2) are exact decimals."""
    d = "decimal(38,0)"

    def comb2(c):
        return (F.col(c).cast(d) * (F.col(c).cast(d) - 1) / 2).cast(d)

    cont = df.groupBy(a_col, b_col).agg(F.count(F.lit(1)).alias("_n"))
    s_a = cont.groupBy(a_col).agg(F.sum("_n").alias("_n")).agg(F.sum(comb2("_n"))).scalar()
    s_b = cont.groupBy(b_col).agg(F.sum("_n").alias("_n")).agg(F.sum(comb2("_n"))).scalar()
    tot = cont.agg(F.sum(comb2("_n")).alias("_ij"), F.sum("_n").alias("_nn"))
    ij, a, b = F.col("_ij").cast("double"), s_a.cast("double"), s_b.cast("double")
    n = F.col("_nn").cast("double")
    expected = a * b / (n * (n - 1) / 2)
    mx = (a + b) / 2
    ari = F.when(mx == expected, F.lit(1.0)).otherwise((ij - expected) / (mx - expected))
    return tot.select(ari.alias("ari"), F.col("_nn").cast("long").alias("n"))


def cluster_profile(feat: DataFrame, tier_order, cluster_col: str = "cluster",
                    tier_col: str = "true_segment") -> DataFrame:
    """Means of the profile columns, size, dominant tier and rank-based
    name per cluster (one row per cluster, k rows)."""
    prof = feat.groupBy(cluster_col).agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in PROFILE_COLS],
        F.count(F.lit(1)).alias("n_customers"))
    prof = prof.join(dominant_tier(feat, cluster_col, tier_col, tier_order), cluster_col)
    # k rows: ordered windows over the whole (tiny) profile are bounded
    # names go by the profile as published, i.e. rounded to two decimals
    by_money = Window.orderBy(F.round("monetary_per_year", 2).desc(), F.col(cluster_col))
    allw = Window.partitionBy(F.lit(1))
    prof = (prof.withColumn("_rk", F.row_number().over(by_money))
            .withColumn("_k", F.count(F.lit(1)).over(allw)))
    middle = (F.col("_rk") > 1) & (F.col("_rk") < F.col("_k"))
    rate = F.round("acceptance_rate", 2)
    weakest_acc = F.min(F.when(middle, rate)).over(allw)
    first_weak = F.min(F.when(middle & (rate == weakest_acc),
                              F.col("_rk"))).over(allw)
    name = (F.when(F.col("_rk") == F.col("_k"), NAME_BOTTOM)
            .when(F.col("_rk") == 1, NAME_TOP)
            .when(F.col("_rk") == first_weak, NAME_WEAKEST)
            .otherwise(NAME_REST))
    return prof.withColumn("cluster_name", name).drop("_rk", "_k")


def misfiled_accounts(feat: DataFrame, profile: DataFrame, cluster_col: str = "cluster",
                      tier_col: str = "true_segment") -> DataFrame:
    """Accounts whose tier differs from their cluster's dominant tier,
    counted per (tier, cluster name)."""
    tagged = feat.join(profile.select(cluster_col, "dominant_tier", "cluster_name"), cluster_col)
    return (tagged.where(F.col(tier_col) != F.col("dominant_tier"))
            .groupBy(tier_col, "cluster_name").agg(F.count(F.lit(1)).alias("n_accounts")))


def misfiled_share(feat: DataFrame, profile: DataFrame, cluster_col: str = "cluster",
                   tier_col: str = "true_segment") -> DataFrame:
    """How many accounts sit in a cluster dominated by another tier, of all."""
    tagged = feat.join(profile.select(cluster_col, "dominant_tier"), cluster_col)
    wrong = F.count(F.when(F.col(tier_col) != F.col("dominant_tier"), F.lit(1)))
    return (tagged.agg(F.count(F.lit(1)).alias("n_accounts"), wrong.alias("n_misfiled"))
            .withColumn("share", F.col("n_misfiled") / F.col("n_accounts")))


# ---- model path (Spark ML) --------------------------------------------------

def _scaled(rfm: DataFrame, cols=SEGMENT_FEATURES):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    va = VectorAssembler(inputCols=list(cols), outputCol="_raw", handleInvalid="error")
    vec = va.transform(rfm)
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    return scaler.fit(vec).transform(vec)


BLOCK_ROWS = 20_000  # rows whose distances to the centres are held at a time


def _feature_blocks(data: DataFrame):
    """The feature vectors as blocks of a matrix, a row per feature, kept for the rounds of all fits."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BLOCK_ROWS):
                column = b.column("x").slice(start, BLOCK_ROWS)
                x = column.flatten().to_numpy().reshape(len(column), -1)
                yield pa.record_batch({"n": pa.array([len(x)], pa.int64()), "x": pa.array([x.T.tobytes()])})

    blocks = data.select(vector_to_array("features").alias("x")).mapInArrow(pack, "n long, x binary")
    return blocks.rdd.map(lambda r: np.frombuffer(r["x"]).reshape(-1, r["n"])).persist()


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row (a column of ``x``) the nearest centre, the first of equals, and the squared distance."""
    d = (centres ** 2).sum(axis=1)[:, None] - 2 * (centres @ x)
    best, at = d[0], np.zeros(x.shape[1], np.int64)
    for c in range(1, len(centres)):
        nearer = d[c] < best
        at[nearer] = c
        best = np.where(nearer, d[c], best)
    return at, np.maximum(best + (x ** 2).sum(axis=0), 0.0)


def _cluster_sums(fits: dict[int, np.ndarray]):
    """A task's rows, feature sums (per cluster) and cost of every fit."""
    def add(blocks):
        sums = {f: [np.zeros(len(c)), np.zeros(c.shape), 0.0] for f, c in fits.items()}
        for x in blocks:
            for f, centres in fits.items():
                at, d = _nearest(x, centres)
                sums[f][0] += np.bincount(at, minlength=len(centres))
                sums[f][1] += np.array([np.bincount(at, v, len(centres)) for v in x]).T
                sums[f][2] += d.sum()
        yield sums
    return add


def lloyd(data: DataFrame, starts: Sequence[np.ndarray], max_iter: int, tol: float) -> list[tuple[np.ndarray, float]]:
    """The centres that K-means reaches from each of ``starts``, and the cost in its last round.

    The rounds of all fits run together: one job a round reads the rows once for every fit that still moves.
    As in MLlib a fit ends when no centre moved farther than ``tol``; a centre without rows stays."""
    centres, cost = [np.array(c, float) for c in starts], [0.0] * len(starts)
    moving = list(range(len(starts)))
    blocks = _feature_blocks(data)
    try:
        for _ in range(max_iter):
            if not moving:
                break
            parts = blocks.mapPartitions(_cluster_sums({f: centres[f] for f in moving})).collect()
            still = []
            for f in moving:
                n, total, cost[f] = (sum(p[f][i] for p in parts) for i in range(3))
                new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[f])
                if (((new - centres[f]) ** 2).sum(axis=1) > tol ** 2).any():
                    still.append(f)
                centres[f] = new
            moving = still
    finally:
        blocks.unpersist()
    return [(c, float(x)) for c, x in zip(centres, cost)]


def _as_model(start, centres: np.ndarray):
    """``start`` (a KMeansModel) with other centres: saved, it gets them as its data."""
    from pyspark.ml.clustering import KMeansModel
    from pyspark.ml.linalg import Vectors
    spark = SparkSession.active()
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kmeans-{uuid.uuid4().hex}"
    start.save(f"{root}/start")
    spark.read.text(f"{root}/start/metadata").coalesce(1).write.text(f"{root}/best/metadata")
    rows = [(i, Vectors.dense(c.tolist())) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, spark.read.parquet(f"{root}/start/data").schema).coalesce(1).write.parquet(
        f"{root}/best/data")
    return KMeansModel.load(f"{root}/best")


def _best_kmeans(data: DataFrame, ks: Sequence[int], seed: int, restarts: int, max_iter: int) -> list[tuple]:
    """Per k the cheapest of ``restarts`` fits (of equal costs but for rounding the first) and its cost.
    MLlib chooses the first centres."""
    from pyspark.ml.clustering import KMeans
    vectors = data.select("features").persist()
    try:
        first = [KMeans(k=k, seed=seed + r, maxIter=0, featuresCol="features", predictionCol="cluster").fit(vectors)
                 for k in ks for r in range(restarts)]
    finally:
        vectors.unpersist()
    # so small a tolerance stops only at a fixed point
    fits = lloyd(data, [m.clusterCenters() for m in first], max_iter, 1e-7)
    out = []
    for i in range(0, len(fits), restarts):
        least = min(cost for _, cost in fits[i:i + restarts])
        best = next(j for j in range(i, i + restarts) if fits[j][1] <= least * (1 + 1e-11))
        out.append((_as_model(first[best], fits[best][0]), fits[best][1]))
    return out


def kmeans_fit(rfm: DataFrame, k: int, seed: int = 42, restarts: int = 10, max_iter: int = 300):
    """K-means on standardised features; best of ``restarts`` seeds by cost.
    A null feature is an error.

    The scaled feature frame is written once and reused by every fit."""
    data = freeze(_scaled(rfm))
    return _best_kmeans(data, [k], seed, restarts, max_iter)[0][0], data


def kmeans_segments(model, data: DataFrame, tier_order) -> DataFrame:
    """Accounts with their cluster, its name and dominant tier, from ``kmeans_fit``."""
    feat = model.transform(data).drop("_raw", "features")
    prof = cluster_profile(feat, tier_order)
    return (feat.join(prof.select("cluster", "cluster_name",
                                  F.col("dominant_tier").alias("dominant_tier_of_cluster")),
                      "cluster")
            .select("customer_id", "true_segment", "cluster", "cluster_name",
                    "dominant_tier_of_cluster", "recency_days", "frequency", "monetary",
                    "acceptance_rate", "avg_price_ratio"))


def kmeans_k_sweep(rfm: DataFrame, ks, seed: int = 42, restarts: int = 10,
                   max_iter: int = 300) -> DataFrame:
    """Inertia and silhouette for each k (the fits of all k run together; the
    driver loops over k for the rest). ``silhouette`` is exact, by Euclidean distances, and its
    work grows with the square of the accounts, but once for all k; Spark's, by squared distances,
    stands beside it."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    data = freeze(_scaled(rfm))
    fits = _best_kmeans(data, ks, seed, restarts, max_iter)
    columns = [f"_cluster_{i}" for i in range(len(fits))]
    out = data
    for column, (m, _) in zip(columns, fits):
        out = m.setPredictionCol(column).transform(out)
    out = freeze(out.select("customer_id", "features", *columns))
    points = out.select("customer_id", *columns, vector_to_array("features").alias("_x"))
    points = points.select("customer_id", *columns, *[F.col("_x")[i].alias(c) for i, c in enumerate(SEGMENT_FEATURES)])
    exact = {r["clustering"]: r["s"] for r in silhouettes_of(points, "customer_id", columns, SEGMENT_FEATURES)
             .groupBy("clustering").agg(F.avg("silhouette").alias("s")).collect()}
    rows = []
    for i, (k, (_, cost)) in enumerate(zip(ks, fits)):
        ev = ClusteringEvaluator(featuresCol="features", predictionCol=columns[i], distanceMeasure="squaredEuclidean")
        rows.append((int(k), cost, float(exact[i]), float(ev.evaluate(out))))
    return rfm.sparkSession.createDataFrame(
        rows, "k int, inertia double, silhouette double, silhouette_sq_euclidean double")


def pca_fit(rfm: DataFrame, k: int = 2):
    """The fitted components and the standardised features."""
    from pyspark.ml.feature import PCA
    data = _scaled(rfm)
    return PCA(k=k, inputCol="features", outputCol="_pc").fit(data), data


def pca_2d(rfm: DataFrame) -> DataFrame:
    """Two principal components of the standardised features, with the
    explained-variance ratio of each as columns."""
    model, data = pca_fit(rfm)
    ev = [float(x) for x in model.explainedVariance]
    out = model.transform(data).withColumn("_a", vector_to_array("_pc"))
    return out.select("customer_id", F.col("_a")[0].alias("pc1"), F.col("_a")[1].alias("pc2"),
                      F.lit(ev[0]).alias("pc1_explained"), F.lit(ev[1]).alias("pc2_explained"))
