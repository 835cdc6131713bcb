"""Scores to predictions, confusion tables, metrics and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.conventions import EPSILON
from voxelarium.functions.scalars import bce_with_logits, et_wt_ratio, focal_loss, log_volume, sigmoid
from voxelarium.operators.distributed import ordered_rank


def scalar_features(df: DataFrame, et: str = "et_volume", wt: str = "wt_volume") -> DataFrame:
    """Log volumes and the enhancing share in its training and serving forms."""
    return df.withColumns(
        {
            "et_log": log_volume(F.col(et)),
            "wt_log": log_volume(F.col(wt)),
            "ratio_train": et_wt_ratio(F.col(et), F.col(wt)),
            "ratio_serve": et_wt_ratio(F.col(et), F.col(wt), serving=True),
        }
    )


def feature_matrix(df: DataFrame, features: Sequence[str], key: str = "case_id") -> DataFrame:
    """Features as one array column, scalar and pooled image features side by side."""
    return df.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("features"))


def linear_score(df: DataFrame, weights: Sequence[float], bias: float, features: str = "features") -> DataFrame:
    """Add ``logit`` of a linear model with fixed weights."""
    terms = [F.get(features, F.lit(i)) * w for i, w in enumerate(weights)]
    return df.withColumn("logit", sum(terms, F.lit(float(bias))))


def score_to_prediction(df: DataFrame, logit: str = "logit") -> DataFrame:
    """Probability, strict 0.5 decision, grade text and confidence."""
    positive = F.col("prob") > 0.5
    return df.withColumn("prob", sigmoid(F.col(logit))).withColumns(
        {
            "prediction": positive.cast("int"),
            "grade_text": F.when(positive, "HIGH").otherwise("LOW"),
            "confidence": F.when(positive, F.col("prob")).otherwise(1 - F.col("prob")),
        }
    )


def attach_predictions(labels: DataFrame, predictions: DataFrame, label: str = "label") -> DataFrame:
    """Join predictions to labels on the case, never by position."""
    joined = labels.join(predictions, "case_id")
    return joined.withColumn("correct", (F.col(label) == F.col("prediction")).cast("int"))


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
    )


def _ratio(top: Column, bottom: Column, eps: float) -> Column:
    if eps:
        return top / (bottom + eps)
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def binary_metrics(confusion: DataFrame, smoothed: bool = False) -> DataFrame:
    """Accuracy, sensitivity, specificity, precision and F1.

    Zero denominators give 0; the smoothed form adds an epsilon to each instead.
    """
    eps = EPSILON if smoothed else 0.0
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    measured = confusion.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn, eps),
            "sensitivity": _ratio(tp, tp + fn, eps),
            "specificity": _ratio(tn, tn + fp, eps),
            "precision": _ratio(tp, tp + fp, eps),
        }
    )
    p, s = F.col("precision"), F.col("sensitivity")
    return measured.withColumn("f1", _ratio(2 * p * s, p + s, eps))


def grade_report(
    df: DataFrame, classes: Sequence[int], label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class from one pass."""
    sums = []
    for c in classes:
        y, p = F.col(label) == c, F.col(prediction) == c
        sums += [F.count_if(y & p).alias(f"tp{c}"), F.count_if(p).alias(f"p{c}"), F.count_if(y).alias(f"y{c}")]
    cells = [
        F.struct(
            F.lit(c).alias("class"),
            F.col(f"tp{c}").cast("double").alias("_tp"),
            F.col(f"p{c}").alias("_p"),
            F.col(f"y{c}").alias("support"),
        )
        for c in classes
    ]
    long = df.agg(*sums).select(F.inline(F.array(*cells)))
    return long.select(
        "class",
        _ratio(F.col("_tp"), F.col("_p"), 0.0).alias("precision"),
        _ratio(F.col("_tp"), F.col("support"), 0.0).alias("recall"),
        _ratio(2 * F.col("_tp"), F.col("_p") + F.col("support"), 0.0).alias("f1"),
        "support",
    )


def macro_f1(df: DataFrame, classes: Sequence[int], **columns: str) -> DataFrame:
    return grade_report(df, classes, **columns).agg(F.avg("f1").alias("macro_f1"))


def row_losses(
    df: DataFrame, weights: Sequence[float], gamma: float = 1.0, logit: str = "logit", label: str = "label"
) -> DataFrame:
    """BCE, focal, class-weighted focal and class-weighted BCE of every row."""
    weight = F.when(F.col(label) == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    return df.withColumn("bce", bce_with_logits(F.col(logit), F.col(label))).withColumns(
        {
            "focal": focal_loss(F.col("bce"), gamma),
            "weighted_focal": focal_loss(F.col("bce"), gamma) * weight,
            "weighted_bce": F.col("bce") * weight,
        }
    )


def mean_losses(losses: DataFrame) -> DataFrame:
    names = ["bce", "focal", "weighted_focal", "weighted_bce"]
    return losses.agg(*[F.avg(c).alias(c) for c in names])


def mean_of_batch_means(losses: DataFrame, size: int, key: str = "case_id", loss: str = "bce") -> DataFrame:
    """Loss averaged inside batches of ``size`` rows in key order, then over the batches."""
    batch = F.floor((F.col("rn") - 1) / size)
    per_batch = ordered_rank(losses.select(key, loss), key).groupBy(batch.alias("batch")).agg(F.avg(loss).alias("m"))
    return per_batch.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("m").alias(f"{loss}_by_batch"))


def fit_baseline(df: DataFrame, features: Sequence[str], label: str, weight: str):
    """Weighted logistic regression on scalar features, fitted on the executors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=list(features), outputCol="assembled")
    model = LogisticRegression(featuresCol="assembled", labelCol=label, weightCol=weight, maxIter=200, tol=1e-10)
    return Pipeline(stages=[assembler, model]).fit(df)
