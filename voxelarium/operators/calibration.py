"""Ranking metrics, calibration, ensembles and fusion of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxelarium.functions.scalars import bce_with_logits, sigmoid
from voxelarium.operators.distributed import running_totals
from voxelarium.storage import materialise


def ranking_metrics(df: DataFrame, score: str = "logit", label: str = "label") -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision, exact.

    Equal scores are counted together, then running totals over the distinct
    scores give every threshold at once.
    """
    by_score = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    by_score = materialise(by_score, "scores")
    ranked = running_totals(by_score, "score", ["pos", "neg"])
    totals = by_score.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t"))
    wide = ranked.withColumn("t", totals.scalar())
    tp = F.col("t.p") - F.col("cum_pos") + F.col("pos")
    fp = F.col("t.n") - F.col("cum_neg") + F.col("neg")
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    return wide.groupBy(F.col("t.p").alias("p"), F.col("t.n").alias("n")).agg(
        F.sum(F.col("pos") * below).alias("u"), F.sum(F.col("pos") * F.try_divide(tp, tp + fp)).alias("a")
    ).select(
        F.try_divide("u", F.col("p") * F.col("n")).alias("auroc"), F.try_divide("a", "p").alias("pr_auc")
    )


def cohen_kappa(confusion: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    return confusion.select(F.try_divide((tp + tn) / n - chance, 1 - chance).alias("kappa"))


def temperature_scaling(
    df: DataFrame, grid: Sequence[float], logit: str = "logit", label: str = "label"
) -> DataFrame:
    """Mean log loss at every temperature of the grid, from one scan, with the best one marked."""
    losses = [
        F.avg(bce_with_logits(F.col(logit) / F.lit(float(t)), F.col(label))).alias(f"nll{i}")
        for i, t in enumerate(grid)
    ]
    cells = F.array(
        *[
            F.struct(F.col(f"nll{i}").alias("nll"), F.lit(float(t)).alias("temperature"))
            for i, t in enumerate(grid)
        ]
    )
    table = df.agg(*losses).select(cells.alias("c"))
    return table.select(F.inline("c"), F.array_min("c").alias("m")).select(
        "temperature", "nll", (F.col("temperature") == F.col("m.temperature")).cast("int").alias("best")
    )


def reliability_bins(df: DataFrame, bins: int = 10, prob: str = "prob", label: str = "label") -> DataFrame:
    """Mean probability, observed rate and gap per probability bin."""
    place = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(place).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(prob).alias("mean_prob"),
        F.avg(F.col(label).cast("double")).alias("rate"),
    ).withColumn("gap", F.abs(F.col("mean_prob") - F.col("rate")))


def binary_entropy(p: Column) -> Column:
    """Entropy in nats, 0 at certainty."""
    def part(q: Column) -> Column:
        return F.when(q > 0, -q * F.ln(q)).otherwise(0.0)

    return part(p) + part(1 - p)


def ensemble_uncertainty(
    members: DataFrame,
    case: str = "case_id",
    prob: str = "prob",
    max_variance: float = 0.3,
    max_entropy: float = 0.5,
) -> DataFrame:
    """Mean, deviation, variance and entropy over the members of each case, with review flags."""
    spread = members.groupBy(case).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.avg(prob).alias("mean_prob"),
        F.stddev_pop(prob).alias("std_prob"),
        F.var_pop(prob).alias("variance"),
    )
    return spread.withColumn("entropy", binary_entropy(F.col("mean_prob"))).withColumn(
        "review", ((F.col("variance") > max_variance) | (F.col("entropy") > max_entropy)).cast("int")
    )


def threshold_sweep(
    df: DataFrame, error_cost: float, review_cost: float, uncertainty: str = "uncertainty", wrong: str = "wrong"
) -> DataFrame:
    """Mean cost of accepting everything up to each uncertainty and reviewing the rest."""
    by_value = df.groupBy(F.col(uncertainty).alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("wrong")
    )
    by_value = materialise(by_value, "uncertainties")
    ranked = running_totals(by_value, "threshold", ["n", "wrong"])
    total = by_value.agg(F.sum("n"))
    n = total.scalar()
    cost = (error_cost * F.col("cum_wrong") + review_cost * (n - F.col("cum_n"))) / n
    return ranked.select(
        "threshold", F.col("cum_n").alias("accepted"), F.col("cum_wrong").alias("errors"), cost.alias("cost")
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Cheapest threshold, the smallest one on ties."""
    return sweep.agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "threshold", "accepted", "errors")).alias("b")).select(
        "b.threshold", "b.accepted", "b.errors", "b.cost"
    )


def late_fusion(
    scores: DataFrame, case: str = "case_id", modality: str = "modality", prob: str = "prob"
) -> DataFrame:
    """Average and majority vote over the per-modality scores of a case."""
    per = scores.groupBy(case, modality).agg(F.avg(prob).alias("p"))
    votes = F.count_if(F.col("p") > 0.5)
    return per.groupBy(case).agg(
        F.count(F.lit(1)).alias("n_modalities"),
        F.avg("p").alias("mean_prob"),
        votes.alias("votes"),
    ).select(
        case,
        "n_modalities",
        "mean_prob",
        (F.col("mean_prob") > 0.5).cast("int").alias("by_average"),
        (2 * F.col("votes") > F.col("n_modalities")).cast("int").alias("by_majority"),
    )


def modality_ablation(
    scores: DataFrame,
    labels: DataFrame,
    modalities: Sequence[str],
    case: str = "case_id",
    modality: str = "modality",
    prob: str = "prob",
    label: str = "label",
) -> DataFrame:
    """Accuracy of average fusion with all modalities and without each one.

    The sums with one modality left out come from the same aggregate, so the
    scores are read once.  A case left with no score counts as predicted 0.
    """
    per = scores.groupBy(case, modality).agg(F.avg(prob).alias("p"))
    aggs = [F.avg("p").alias("full")]
    aggs += [F.avg(F.when(F.col(modality) != m, F.col("p"))).alias(f"w{i}") for i, m in enumerate(modalities)]
    fused = per.groupBy(case).agg(*aggs).join(labels.select(case, label), case)

    def accuracy(column: str) -> Column:
        decided = (F.coalesce(F.col(column), F.lit(0.0)) > 0.5).cast("int")
        return F.avg((decided == F.col(label)).cast("double"))

    wide = fused.agg(accuracy("full").alias("full"), *[accuracy(f"w{i}").alias(f"w{i}") for i in range(len(modalities))])
    cells = [
        F.struct(F.lit(m).alias("without"), F.col("full"), F.col(f"w{i}").alias("accuracy"))
        for i, m in enumerate(modalities)
    ]
    return wide.select(F.inline(F.array(*cells))).withColumn("drop", F.col("full") - F.col("accuracy"))


def with_probability(df: DataFrame, logit: str = "logit") -> DataFrame:
    return df.withColumn("prob", sigmoid(F.col(logit)))
