"""Severity ranks, penalties and grades as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: penalty weights by severity and confidence
SEVERITY_WEIGHT = {"advisory": 1.0, "warning": 4.0, "error": 12.0}
CONFIDENCE_WEIGHT = {"low": 0.5, "medium": 0.75, "high": 1.0}
SEVERITY_RANK = {"advisory": 1, "warning": 2, "error": 3}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def _from(values: dict, column: Column, default) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return _from(SEVERITY_RANK, severity, 0)


def penalty(severity: Column, confidence: Column) -> Column:
    return _from(SEVERITY_WEIGHT, severity, 0.0) * _from(CONFIDENCE_WEIGHT, confidence, 0.0)


def clamped(points: Column) -> Column:
    """A score between 0 and 100 with two decimals."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(points, 2)))


def letter(score: Column) -> Column:
    out = F.lit("F")
    for least, grade in reversed(GRADES):
        out = F.when(score >= least, grade).otherwise(out)
    return out


def threshold_severity(value: Column, warning: float, error: float, low: bool = False) -> Column:
    """Severity of a metric that is strictly above (low: below) one of two limits, else null."""
    past = (lambda limit: value < limit) if low else (lambda limit: value > limit)
    return F.when(past(error), "error").when(past(warning), "warning")
