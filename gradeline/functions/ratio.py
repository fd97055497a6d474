"""Guarded arithmetic used by every metric."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0.0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return share(100 * part, whole)


def precision(tp: Column, fp: Column) -> Column:
    return share(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return share(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Harmonic mean of precision and recall, 0.0 when both are zero."""
    p, r = precision(tp, fp), recall(tp, fn)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def long_sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("bigint")
