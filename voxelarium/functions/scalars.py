"""Scalar formulas: features, scores, windows, durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from voxelarium.conventions import EPSILON, LOG_VOLUME_SCALE


def log_volume(volume: Column) -> Column:
    return F.log1p(volume.cast("double")) / LOG_VOLUME_SCALE


def et_wt_ratio(et: Column, wt: Column, serving: bool = False) -> Column:
    """Training adds an epsilon to the denominator, serving gives 0 for an empty tumour."""
    if serving:
        return F.when(wt > 0, F.try_divide(et.cast("double"), wt.cast("double"))).otherwise(0.0)
    return et.cast("double") / (wt.cast("double") + EPSILON)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hu_window(value: Column, low: float = -100.0, high: float = 300.0) -> Column:
    """Clip to a window and scale it to [0, 1]."""
    return (F.greatest(F.least(value, F.lit(high)), F.lit(low)) - low) / (high - low)


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.format_string(
        "%dh %dm %ds", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    )


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Linear extrapolation, 0 before anything is done."""
    return F.coalesce(F.try_divide(elapsed, done) * (total - done), F.lit(0.0))


def bce_with_logits(logit: Column, label: Column) -> Column:
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(bce: Column, gamma: float = 1.0) -> Column:
    return F.pow(1 - F.exp(-bce), F.lit(gamma)) * bce
