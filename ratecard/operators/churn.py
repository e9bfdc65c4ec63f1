"""Churn modelling: split, preparation, fitted models and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecard.operators.ranking import exact_quantiles, group_sequence, with_group_size

# The names of the model's columns.
NUM_FEATURES = ("tenure_days_at_cutoff", "n_quotes_12m", "n_accepted_12m", "acceptance_rate_12m",
                "avg_price_ratio_12m", "revenue_12m", "express_share_12m", "price_ratio_trend",
                "trend_missing")
CAT_FEATURES = ("segment", "industry", "region", "contract_type")
ZSCORE_COLS = ("tenure_days_at_cutoff", "n_quotes_12m", "n_accepted_12m", "acceptance_rate_12m",
               "avg_price_ratio_12m", "revenue_12m", "express_share_12m")


def model_frame(labels: DataFrame) -> DataFrame:
    """Rename the tier to ``segment`` and add the missing-trend flag."""
    return (labels.withColumnRenamed("true_segment", "segment")
            .withColumn("trend_missing", F.col("price_ratio_trend").isNull().cast("int")))


def hash_key(id_col: str, salt: str) -> F.Column:
    """Reproducible pseudo-random order: md5(salt || id) (same text in SQL)."""
    return F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, strata_col: str, id_col: str, test_fraction: float,
                     salt: str) -> DataFrame:
    """Deterministic stratified split: inside each stratum, rows ordered by
    md5(salt||id); the first ceil(fraction * n_stratum) are test.

    The per-stratum rank comes from ``group_sequence`` (range-partitioned
    prefix sums), so a stratum holding most rows is still split over tasks.
    """
    keyed = df.withColumn("_h", hash_key(id_col, salt))
    ranked = group_sequence(keyed, [strata_col], ["_h"], "_rn")
    return (with_group_size(ranked, [strata_col], "_rn", "_ns")
            .withColumn("split", F.when(F.col("_rn") <= F.ceil(F.col("_ns") * test_fraction),
                                        "test").otherwise("train"))
            .drop("_h", "_rn", "_ns"))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """'balanced' weights n / (n_classes * n_class); they sum to n."""
    n = df.agg(F.count(F.lit(1))).scalar()
    k = df.agg(F.countDistinct(label_col)).scalar()
    return (df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("weight", n / (k * F.col("n"))))


def median_impute(df: DataFrame, col: str) -> DataFrame:
    """Fill nulls with the exact median (midpoint interpolation, unlike
    ``Imputer`` which returns an element)."""
    med = exact_quantiles(df, [], col, [0.5]).agg(F.first("value")).scalar()
    return df.withColumn(f"{col}_imputed", F.coalesce(F.col(col), med))


def zscores(df: DataFrame, cols=ZSCORE_COLS, key: str = "customer_id") -> DataFrame:
    """(x - mean) / population std, statistics from one aggregation pass
    delivered as a single struct scalar subquery."""
    stats = df.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")
                              for c in cols])).scalar()
    return df.select(key, *[((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(f"z_{c}")
                            for c in cols])


def stub_risk_score(df: DataFrame) -> F.Column:
    """Fixed arithmetic risk score (stands in for a model when checking the
    ranking metrics against SQL): higher when acceptance is low."""
    return F.round(F.lit(0.9) - F.lit(0.6) * F.col("acceptance_rate_12m")
                   + F.lit(0.2) * F.col("express_share_12m"), 3)


# ---- fitted models ------------------------------------------------------------

def _prep_stages(cat_cols, num_cols, scale: bool):
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    idx = [StringIndexer(inputCol=c, outputCol=f"_{c}_ix", handleInvalid="keep") for c in cat_cols]
    ohe = OneHotEncoder(inputCols=[f"_{c}_ix" for c in cat_cols],
                        outputCols=[f"_{c}_oh" for c in cat_cols], handleInvalid="keep",
                        dropLast=True)
    stages = [*idx, ohe]
    if scale:
        stages += [VectorAssembler(inputCols=list(num_cols), outputCol="_num"),
                   StandardScaler(inputCol="_num", outputCol="_nums", withMean=True, withStd=True)]
        inputs = [f"_{c}_oh" for c in cat_cols] + ["_nums"]
    else:
        inputs = [f"_{c}_oh" for c in cat_cols] + list(num_cols)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def fit_logistic(train: DataFrame, cat_cols, num_cols, label_col: str, weight_col=None,
                 max_iter: int = 200, tol: float = 1e-8):
    """One-hot + standardise + L2 logistic regression (C=1 <=> regParam=1/n), run until the gradient
    is 0 for practical purposes (``inspection.logistic_gradient`` shows it)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                            tol=tol)
    if weight_col:
        lr.setWeightCol(weight_col)
    return Pipeline(stages=[*_prep_stages(cat_cols, num_cols, True), lr]).fit(train)


def fit_gbt(train: DataFrame, cat_cols, num_cols, label_col: str, max_depth: int = 4,
            step: float = 0.06, max_iter: int = 300, seed: int = 42):
    """Gradient-boosted trees (tree training rejects NaN: impute first), grown by ``boosting.fit_boosted``."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from ratecard.operators.boosting import fit_boosted
    gbt = GBTClassifier(featuresCol="features", labelCol=label_col, maxDepth=max_depth,
                        stepSize=step, maxIter=max_iter, maxBins=255, seed=seed)
    prepared = Pipeline(stages=_prep_stages(cat_cols, num_cols, False)).fit(train)
    sizes = prepared.stages[len(cat_cols)].categorySizes
    model = fit_boosted(prepared, train, [f"_{c}_ix" for c in cat_cols], sizes, num_cols, gbt)
    return PipelineModel([*prepared.stages, model])


def positive_probability(model, df: DataFrame, out: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return (model.transform(df).withColumn(out, vector_to_array("probability")[1])
            .drop("features", "probability", "rawPrediction", "prediction"))


def churn_model_frame(labels: DataFrame, salt: str, test_fraction: float) -> DataFrame:
    """Model frame with split, median-imputed trend (median of the training
    rows) and balanced class weights."""
    mf = model_frame(labels)
    split = stratified_split(mf, "churned", "customer_id", test_fraction, salt)
    med = (exact_quantiles(split.where(F.col("split") == "train"), [], "price_ratio_trend", [0.5])
           .agg(F.first("value")).scalar())
    train = split.where(F.col("split") == "train")
    n = train.agg(F.count(F.lit(1))).scalar()
    n_pos = train.agg(F.sum("churned")).scalar()
    w = F.when(F.col("churned") == 1, n / (2 * n_pos)).otherwise(n / (2 * (n - n_pos)))
    return (split.withColumn("price_ratio_trend", F.coalesce(F.col("price_ratio_trend"), med))
            .withColumn("class_weight", w))


def fit_churn_model(train: DataFrame, which: str, gbt_iter: int = 300, seed: int = 42):
    """One churn model: ``Logistic Regression`` or ``Gradient Boosting``."""
    if which == "Logistic Regression":
        return fit_logistic(train, CAT_FEATURES, NUM_FEATURES, "churned", weight_col="class_weight")
    return fit_gbt(train, CAT_FEATURES, NUM_FEATURES, "churned", max_depth=4, step=0.06,
                   max_iter=gbt_iter, seed=seed)


def scorer(model):
    def score(df: DataFrame) -> DataFrame:
        return positive_probability(model, df, "score")
    return score
