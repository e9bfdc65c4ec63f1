"""Global orderings without a single-task window.

``Window.orderBy`` with no partition moves every row into one task. The
helpers here compute running totals in a global order the distributed way:

1. range-partition on the full ordering (Spark samples the keys, so a hot
   value of the first key is split by the following keys) and freeze the
   bucket ids with a reliable checkpoint;
2. running totals inside each range with a window partitioned by range id;
3. per-range totals -> at most ``n_buckets`` rows -> prefix offsets, which
   are broadcast (size bounded by the bucket count) and added back.

On top of that: sequence numbers, exact quantiles, deciles, ROC-AUC,
average precision, ROC / PR points and calibration bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecard.session import default_parallelism, freeze

_B = "_rt_bucket"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


BUCKET_BYTES = 128 * 1024 * 1024


def bucket_count(df: DataFrame) -> int:
    """Buckets for a global ordering: about 128 MB of input each.

    The volume comes from the plan's leaf relations (bytes of the scanned
    files, times 4 for decompression); ``running_totals`` writes its input
    first, so the leaf is the ranked frame itself and an aggregated frame
    counts with its aggregated size. Small inputs get one bucket per core;
    there is no upper limit, and the offset table has one row per bucket."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if not sizes or max(sizes) >= 2 ** 62:   # a leaf of unknown size (e.g. an RDD)
        return default_parallelism(df.sparkSession)
    # at least one bucket per core, so small inputs still use the whole cluster
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-4 * sum(sizes) // BUCKET_BYTES))


def running_totals(df: DataFrame, order_by: Sequence, values: dict,
                   n_buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` ({name: column}) in the global
    order ``order_by``. Returns ``df`` plus one column per name.

    Runs jobs while the plan is built: the input is evaluated once and
    written to the checkpoint folder (range bounds are sampled from that
    copy, not from a second evaluation), then written again by range."""
    df = freeze(df)
    nb = n_buckets or bucket_count(df)
    order = [_col(c) for c in order_by]
    # The range bounds come from sampling, and sampling sees rows in an
    # order a shuffle does not fix; two executions of the exchange (one per
    # consumer below, or a retry) could therefore disagree on bucket ids.
    # Writing the bucketed rows once to the reliable checkpoint folder
    # freezes one assignment for both consumers and survives executor loss.
    # written bucketed on the bucket id: the per-bucket window and totals
    # below read it without another exchange
    ranged = freeze(df.repartitionByRange(nb, *order).withColumn(_B, F.spark_partition_id()),
                    bucket_col=_B, n_buckets=nb)
    w = (Window.partitionBy(_B).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select("*", *[F.sum(_col(v)).over(w).alias(f"_rt_l_{k}")
                                 for k, v in values.items()])
    totals = ranged.groupBy(_B).agg(*[F.sum(_col(v)).alias(f"_rt_t_{k}")
                                      for k, v in values.items()])
    # at most n_buckets rows: a single ordered window here is bounded
    wo = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_B, *[F.coalesce(F.sum(f"_rt_t_{k}").over(wo), F.lit(0))
                                  .alias(f"_rt_o_{k}") for k in values])
    out = local.join(F.broadcast(offsets), _B)
    return out.select(*df.columns, *[(F.col(f"_rt_l_{k}") + F.col(f"_rt_o_{k}")).alias(k)
                                     for k in values])


def sequence_id(df: DataFrame, order_by: Sequence, name: str = "seq",
                n_buckets: int | None = None) -> DataFrame:
    """1-based position in the global order (row_number without one task)."""
    return running_totals(df, order_by, {name: F.lit(1)}, n_buckets)


def group_running_totals(df: DataFrame, group_cols: Sequence[str], order_by: Sequence,
                         values: dict, n_buckets: int | None = None) -> DataFrame:
    """Running totals restarting in every group (values must be >= 0).

    Global running totals over (group, order) minus the total before each
    group; the per-group start table has one row per group.
    """
    g = list(group_cols)
    glob = running_totals(df, [*g, *order_by], values, n_buckets)
    if not g:   # one group: its start offsets are 0
        return glob
    starts = freeze(glob.groupBy(*g).agg(*[F.min(F.col(k) - _col(v)).alias(f"_gs_{k}")
                                           for k, v in values.items()]))
    # few groups: their starts are broadcast, so the ranked rows of a hot
    # group stay spread over the ranges; many groups: an ordinary join
    out = glob.join(F.broadcast(starts) if few_groups(starts) else starts, g)
    return out.select(*[c for c in glob.columns if c not in values],
                      *[(F.col(k) - F.col(f"_gs_{k}")).alias(k) for k in values])


FEW_GROUPS = 100_000


def few_groups(per_group: DataFrame) -> bool:
    """Whether a frame of one row per group is small enough to broadcast (counted)."""
    return per_group.count() <= FEW_GROUPS


def group_sequence(df: DataFrame, group_cols: Sequence[str], order_by: Sequence,
                   name: str = "rn", n_buckets: int | None = None) -> DataFrame:
    """row_number() over (partition by group order by ...) that splits hot groups."""
    return group_running_totals(df, group_cols, order_by, {name: F.lit(1)}, n_buckets)


def with_group_size(ranked: DataFrame, group_cols: Sequence[str], rank: str, name: str) -> DataFrame:
    """Rows ranked by ``group_sequence`` with their group's size (its last
    rank); few groups are broadcast, so a hot group is not shuffled."""
    g = list(group_cols)
    sizes = freeze(ranked.groupBy(*g).agg(F.max(rank).alias(name)))
    return ranked.join(F.broadcast(sizes) if few_groups(sizes) else sizes, g)


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    qs: Sequence[float], n_buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy default / SQL
    ``quantile_cont``), distributed.

    Values are first pre-aggregated to (group, value, count), so a hot
    value is one row; cumulative counts per group come from
    ``group_running_totals``. Output: group cols, ``q_idx``, ``q``, ``value``.
    """
    g = list(group_cols)
    v = F.col(value_col)
    freq = freeze(df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
                  .groupBy(*g, v.alias("_qv")).agg(F.count(F.lit(1)).alias("_qn")))
    cum = group_running_totals(freq, g, ["_qv"], {"_qc": F.col("_qn")}, n_buckets)
    if g:
        sizes = freq.groupBy(*g).agg(F.sum("_qn").alias("_qtot"))
        cum = cum.join(F.broadcast(sizes) if few_groups(sizes) else sizes, g)
    else:
        cum = cum.withColumn("_qtot", freq.agg(F.sum("_qn")).scalar())
    n1 = F.col("_qtot") - 1
    before = F.col("_qc") - F.col("_qn")   # 0-based rank of the first copy of _qv
    # each (group, value) row keeps only the quantile positions it covers
    qarr = F.array(*[F.struct(F.lit(i).alias("q_idx"), F.lit(float(q)).alias("q"))
                     for i, q in enumerate(qs)])
    cand = F.transform(qarr, lambda s: F.struct(
        s["q_idx"].alias("q_idx"), s["q"].alias("q"), (s["q"] * n1).alias("pos"),
        F.floor(s["q"] * n1).alias("lo"), F.ceil(s["q"] * n1).alias("hi")))
    covers = lambda x: (((before <= x["lo"]) & (x["lo"] < F.col("_qc")))
                        | ((before <= x["hi"]) & (x["hi"] < F.col("_qc"))))
    hit = (cum.select(*g, "_qv", "_qc", "_qn", F.explode(F.filter(cand, covers)).alias("x"))
           .select(*g, "_qv", "_qc", "_qn", "x.*"))
    has_lo = (F.col("_qc") - F.col("_qn") <= F.col("lo")) & (F.col("lo") < F.col("_qc"))
    has_hi = (F.col("_qc") - F.col("_qn") <= F.col("hi")) & (F.col("hi") < F.col("_qc"))
    picked = (hit.groupBy(*g, "q_idx", "q", F.col("pos").alias("_pos"),
                          F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
              .agg(F.max(F.when(has_lo, F.col("_qv"))).alias("_vlo"),
                   F.max(F.when(has_hi, F.col("_qv"))).alias("_vhi")))
    val = F.when((F.col("_hi") == F.col("_lo")) | (F.col("_vlo") == F.col("_vhi")),
                 F.col("_vlo")).otherwise(
        (F.col("_hi") - F.col("_pos")) * F.col("_vlo")
        + (F.col("_pos") - F.col("_lo")) * F.col("_vhi"))
    return picked.select(*g, "q_idx", "q", val.cast("double").alias("value"))


def approx_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                     qs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Quantiles per group from a mergeable summary, for groups too large to order.

    One aggregation: every task summarises its rows, the summaries are merged. The value returned for
    q is one of the group's values, and its rank among the group's n values is within n / accuracy of
    q * n. Same columns as ``exact_quantiles``; a group without values gives no rows."""
    g = list(group_cols)
    v = F.col(value_col).cast("double")
    got = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*g)
           .agg(F.percentile_approx(v, [float(q) for q in qs], accuracy).alias("_v")))
    lines = F.array(*[F.struct(F.lit(i).alias("q_idx"), F.lit(float(q)).alias("q"), F.get("_v", F.lit(i)).alias("value"))
                      for i, q in enumerate(qs)])
    return got.where("_v IS NOT NULL").select(*g, F.inline(lines))


def quantile_rank_check(df: DataFrame, group_cols: Sequence[str], value_col: str,
                        qs: Sequence[float], accuracy: int) -> DataFrame:
    """Per group and quantile: n, and whether the approximate value's true rank (any of its equal
    values') is within the error that ``approx_quantiles`` states (and one rank for rounding)."""
    g = list(group_cols)
    v = F.col(value_col).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*g, v.alias("_x"))
    got = approx_quantiles(rows, g, "_x", qs, accuracy)
    values = got.groupBy(*g).agg(F.transform(F.sort_array(F.collect_list(F.struct("q_idx", "value"))),
                                             lambda s: s["value"]).alias("_v"))
    # one row per group; a plain join unless there are few
    values = freeze(values)
    counted = rows.join(F.broadcast(values) if few_groups(values) else values, g).groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum((F.col("_x") < F.get("_v", F.lit(i))).cast("long")).alias(f"_b{i}")
                                        for i in range(len(qs))],
        *[F.sum((F.col("_x") <= F.get("_v", F.lit(i))).cast("long")).alias(f"_a{i}") for i in range(len(qs))])
    slack = F.col("n") / accuracy + 1
    lines = F.array(*[F.struct(F.lit(float(q)).alias("q"),
                               ((F.col(f"_b{i}") - slack <= F.lit(float(q)) * F.col("n"))
                                & (F.lit(float(q)) * F.col("n") <= F.col(f"_a{i}") + slack)).alias("rank_in_bound"))
                      for i, q in enumerate(qs)])
    return counted.select(*g, "n", F.inline(lines))


def decile_assign(scored: DataFrame, score_col: str, id_col: str, n_bins: int = 10,
                  n_buckets: int | None = None) -> DataFrame:
    """Equal-count bins from first-come ranks, 1 = highest score.

    rank = position by (score asc, id asc); bin = max(1, ceil((rank-1)*B/(n-1)));
    decile = B + 1 - bin. This equals quantile-cutting the ranks (qcut),
    which is *not* ``ntile``: the short bucket lands in the middle.
    """
    ranked = sequence_id(scored, [score_col, id_col], "_rank", n_buckets)
    n = ranked.agg(F.max("_rank")).scalar()
    b = F.greatest(F.lit(1), F.ceil((F.col("_rank") - 1) * n_bins / F.greatest(n - 1, F.lit(1))))
    return (ranked.withColumn("decile", (F.lit(n_bins + 1) - b).cast("int"))
            .drop("_rank"))


def decile_lift(scored: DataFrame, score_col: str, label_col: str, id_col: str,
                n_bins: int = 10, n_buckets: int | None = None) -> DataFrame:
    """Per decile n, positives, rate, cumulative positives and capture."""
    d = decile_assign(scored, score_col, id_col, n_bins, n_buckets)
    per = d.groupBy("decile").agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.col(label_col)).cast("long").alias("churners"))
    # n_bins rows: ordered window is bounded
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy(F.lit(1))
    return (per.withColumn("churn_rate", F.col("churners") / F.col("n"))
            .withColumn("cum_churners", F.sum("churners").over(w))
            .withColumn("cum_capture_rate",
                        F.col("cum_churners") / F.sum("churners").over(wall))
            .select("decile", "n", "churners", "churn_rate", "cum_churners", "cum_capture_rate"))


# ---- binary-classifier metrics on a score column ---------------------------

def score_counts(df: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """(score, pos, neg) per distinct score: the pre-aggregation every
    threshold metric starts from (ties merge into one row)."""
    y = F.col(label_col).cast("long")
    return df.groupBy(F.col(score_col).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))


def _auc_term(neg_below: Column) -> Column:
    """pos * (2 * negatives below + negatives tied), in decimals from the
    start: the product of two counts outgrows a long."""
    wide = "decimal(19,0)"
    return (F.col("pos").cast(wide) * (neg_below.cast(wide) * 2 + F.col("neg").cast(wide))
            ).cast("decimal(38,0)")


def roc_auc(df: DataFrame, score_col: str, label_col: str,
            n_buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC, ties counted 1/2 (Mann-Whitney)."""
    c = running_totals(score_counts(df, score_col, label_col), ["score"],
                       {"cum_neg": F.col("neg")}, n_buckets)
    neg_below = F.col("cum_neg") - F.col("neg")
    agg = c.agg(F.sum(_auc_term(neg_below)).alias("_num2"),
                F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(
        (F.col("_num2").cast("double")
         / (F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
        .alias("roc_auc"),
        F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def _desc_cumulative(df, score_col, label_col, n_buckets):
    return running_totals(score_counts(df, score_col, label_col), [F.col("score").desc()],
                          {"tp": F.col("pos"), "fp": F.col("neg")}, n_buckets)


def average_precision(df: DataFrame, score_col: str, label_col: str,
                      n_buckets: int | None = None) -> DataFrame:
    """Step-wise AP = sum over thresholds of (R_k - R_{k-1}) * P_k."""
    c = _desc_cumulative(df, score_col, label_col, n_buckets)
    agg = c.agg(F.sum(F.col("pos").cast("double") * F.col("tp").cast("double")
                      / (F.col("tp") + F.col("fp"))).alias("_s"),
                F.sum("pos").alias("_p"))
    return agg.select((F.col("_s") / F.col("_p")).alias("average_precision"))


def threshold_points(df: DataFrame, score_col: str, label_col: str,
                     n_buckets: int | None = None) -> DataFrame:
    """One row per distinct score (descending thresholds): tp, fp, tpr, fpr,
    precision, recall -- the data behind ROC and PR curves."""
    c = _desc_cumulative(df, score_col, label_col, n_buckets)
    # the last cumulative row holds the totals
    n_pos, n_neg = c.agg(F.max("tp")).scalar(), c.agg(F.max("fp")).scalar()
    return c.select(
        F.col("score").alias("threshold"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        (F.col("tp") / n_pos).alias("tpr"),
        (F.col("fp") / n_neg).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / n_pos).alias("recall"))


def curve_with_ends(points: DataFrame, x: str, y: str, start: tuple[float, float]) -> DataFrame:
    """A curve's (x, y) with its first point, at which nothing is predicted positive."""
    first = points.sparkSession.createDataFrame([start], f"{x} double, {y} double")
    return points.select(x, y).unionByName(first)


def log_loss_brier(df: DataFrame, prob_col: str, label_col: str) -> DataFrame:
    eps = 2.220446049250313e-16
    p = F.least(F.greatest(F.col(prob_col), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label_col).cast("double")
    return df.agg(
        F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias("log_loss"),
        F.avg((F.col(prob_col) - y) * (F.col(prob_col) - y)).alias("brier"),
        F.count(F.lit(1)).alias("n"))


def calibration_bins(df: DataFrame, prob_col: str, label_col: str, n_bins: int = 10,
                     n_buckets: int | None = None) -> DataFrame:
    """Quantile-binned reliability table: bin = number of inner edges < p."""
    qs = [i / n_bins for i in range(1, n_bins)]
    # n_bins-1 doubles, sorted by quantile: a bounded scalar subquery
    edges = (exact_quantiles(df, [], prob_col, qs, n_buckets)
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("q_idx", "value"))),
                              lambda s: s["value"])).scalar())
    binned = (df.withColumn("_edges", edges)
              .withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(prob_col)))))
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(prob_col).alias("mean_predicted"),
        F.avg(F.col(label_col).cast("double")).alias("fraction_positive"))


def roc_auc_by(df: DataFrame, group_cols: Sequence[str], score_col: str, label_col: str,
               n_buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC per group (e.g. per permuted feature and repeat)."""
    g = list(group_cols)
    y = F.col(label_col).cast("long")
    sc = df.groupBy(*g, F.col(score_col).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    c = group_running_totals(sc, g, ["score"], {"cum_neg": F.col("neg")}, n_buckets)
    neg_below = F.col("cum_neg") - F.col("neg")
    agg = c.groupBy(*g).agg(
        F.sum(_auc_term(neg_below)).alias("_num2"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(*g, (F.col("_num2").cast("double")
                           / (F.lit(2.0) * F.col("_p").cast("double") * F.col("_n").cast("double")))
                      .alias("roc_auc"))


# ---- metrics without a range exchange ----------------------------------------

BAND_ROWS = 100_000


def score_edges(scored: DataFrame, score_col: str, band_rows: int = BAND_ROWS) -> list[float]:
    """Scores that cut ``scored`` into bands of about ``band_rows`` rows; none for fewer rows. One
    number per band goes to the driver. Any edges give exact results: they only size the bands."""
    bands = -(-scored.count() // band_rows)
    if bands < 2:
        return []
    cuts = [i / bands for i in range(1, bands)]
    edges = scored.agg(F.percentile_approx(score_col, cuts, 10 * bands).alias("e")).first()["e"]
    return sorted(set(edges))


def banded_auc_by(df: DataFrame, group_cols: Sequence[str], score_col: str, label_col: str,
                  edges: Sequence[float] = ()) -> DataFrame:
    """Exact ROC-AUC per group, ties counted 1/2, from hash exchanges alone.

    Rows merge to (group, score, pos, neg); a score's band is the number of edges below it. Inside a
    (group, band) negatives are counted up in order of score; what lies below a band is added from
    the band totals, of which a group has at most ``len(edges) + 1``."""
    g = list(group_cols)
    y = F.col(label_col).cast("long")
    score = F.col(score_col)
    freq = df.groupBy(*g, score.alias("score")).agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    cuts = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    freq = freq.withColumn("_band", F.size(F.filter(cuts, lambda e: e < F.col("score"))))
    inside = (Window.partitionBy(*g, "_band").orderBy("score")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    freq = freq.withColumn("_below", F.sum("neg").over(inside) - F.col("neg"))
    bands = freq.groupBy(*g, "_band").agg(F.sum(_auc_term(F.col("_below"))).alias("_num2"),
                                          F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lower = Window.partitionBy(*g).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(19,0)"
    before = F.coalesce(F.sum("neg").over(lower), F.lit(0)).cast(wide)
    bands = bands.withColumn("_num2", F.col("_num2") + (F.col("pos").cast(wide) * before * 2).cast("decimal(38,0)"))
    return bands.groupBy(*g).agg(
        (F.sum("_num2").cast("double") / (F.lit(2.0) * F.sum("pos").cast("double") * F.sum("neg").cast("double")))
        .alias("roc_auc"))


# ---- all metrics of several models from one table of scores --------------------

def cumulative_scores(scored: DataFrame, model_col: str, score_col: str, label_col: str,
                      n_buckets: int | None = None) -> DataFrame:
    """(model, score, pos, neg, tp, fp) for every distinct score of every model, in one global
    ordering of all models: ``tp`` and ``fp`` count the rows scored at least so high. Frozen, so that
    every metric below reads the same table and no model or ordering runs again."""
    y = F.col(label_col).cast("long")
    freq = scored.groupBy(F.col(model_col).alias("model"), F.col(score_col).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    return freeze(group_running_totals(freq, ["model"], [F.col("score").desc()],
                                       {"tp": F.col("pos"), "fp": F.col("neg")}, n_buckets))


def metrics_of_scores(cum: DataFrame) -> DataFrame:
    """Per model AUC, average precision, log-loss and Brier score from ``cumulative_scores``."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    eps = 2.220446049250313e-16
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    wide = "decimal(19,0)"
    # 2 * pos * (negatives scored higher) + pos * (negatives scored alike)
    above = (F.col("pos").cast(wide) * (F.col("fp").cast(wide) * 2 - F.col("neg").cast(wide))).cast("decimal(38,0)")
    agg = cum.groupBy("model").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(above).alias("_above"),
        F.sum(pos * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        F.sum(-(pos * F.log(p) + neg * F.log(F.lit(1.0) - p))).alias("_ll"),
        F.sum(pos * (1 - F.col("score")) ** 2 + neg * F.col("score") ** 2).alias("_b"))
    n_pos, n_neg = F.col("_p").cast("double"), F.col("_n").cast("double")
    return agg.select(
        "model", (F.lit(1.0) - F.col("_above").cast("double") / (2 * n_pos * n_neg)).alias("roc_auc"),
        (F.col("_ap") / n_pos).alias("average_precision"),
        (F.col("_ll") / (n_pos + n_neg)).alias("log_loss"), (F.col("_b") / (n_pos + n_neg)).alias("brier"),
        (F.col("_p") + F.col("_n")).cast("long").alias("n"))


METRICS = ("roc_auc", "average_precision", "log_loss", "brier")


def long_metrics(wide: DataFrame) -> DataFrame:
    """(model, metric, value): a row per model and metric."""
    return wide.select("model", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))


def curves_of_scores(cum: DataFrame, points: int | None = None) -> DataFrame:
    """ROC and precision-recall points per model from ``cumulative_scores``.

    With ``points`` = q a model keeps the scores at which its rows, counted from the highest score,
    reach or cross one of q equal steps, and its first (at most q + 1 points). What a gap skips is
    fewer than n / q rows before the kept score's own ties, so the area under the straight lines is
    off by at most 5 n^2 / (8 q P N) (P positive, N negative of n rows)."""
    # the last row of a model holds its totals
    totals = cum.groupBy("model").agg(F.max("tp").alias("_p"), F.max("fp").alias("_n"))
    out = cum.join(F.broadcast(totals) if few_groups(totals) else totals, "model")
    seen = F.col("tp") + F.col("fp")
    if points is not None:
        rows = F.col("_p") + F.col("_n")
        band = lambda c: F.floor(c * F.lit(points) / rows)
        crosses = band(seen) > band(seen - F.col("pos") - F.col("neg"))
        first = seen == F.col("pos") + F.col("neg")
        out = out.where(crosses | first)
    return out.select("model", F.col("score").alias("threshold"), F.col("tp").cast("long").alias("tp"),
                      F.col("fp").cast("long").alias("fp"), (F.col("tp") / F.col("_p")).alias("tpr"),
                      (F.col("fp") / F.col("_n")).alias("fpr"), (F.col("tp") / seen).alias("precision"),
                      (F.col("tp") / F.col("_p")).alias("recall"))
