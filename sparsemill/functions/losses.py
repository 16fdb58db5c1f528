"""Logistic scores, losses and gradients as columns. Sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(t: Column) -> Column:
    return 1 / (1 + F.exp(-t))


def prediction(total: Column) -> Column:
    """The probability for a sum of scores: one half for NaN, sums clamped to +-50."""
    t = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total))
    return F.when(F.isnan(total), F.lit(0.5)).otherwise(logistic(t))


def gradient(total: Column, label: Column, importance: Column) -> Column:
    """The logistic loss's derivative: zero for NaN and beyond +-50."""
    return F.when(F.isnan(total) | (F.abs(total) > 50), F.lit(0.0)).otherwise((prediction(total) - label) * importance)


def clamped_gradient(total: Column, label: Column, importance: Column) -> Column:
    """The same, but beyond +-50 what it is there: the clamped prediction less the label."""
    return F.when(F.isnan(total), F.lit(0.0)).otherwise((prediction(total) - label) * importance)


def logloss(p: Column, label: Column, floor: float = 1e-15) -> Column:
    """Loss of one prediction; probabilities of zero count as `floor`."""
    own = F.when(label == 1, p).otherwise(1 - p)
    return -F.log(F.greatest(own, F.lit(floor)))


def prediction_line(column: str = "prediction") -> Column:
    """A line of a prediction file."""
    return F.format_string("%.6f", column)
