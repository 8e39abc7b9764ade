"""Item response theory as column expressions: curve, information, likelihood."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def icc(theta: Column, a: Column, b: Column, g: Column) -> Column:
    """Probability of a right answer in the three-parameter model, kept off 0 and 1."""
    return F.least(F.greatest(g + (1 - g) / (1 + F.exp(-a * (theta - b))), F.lit(EPS)), F.lit(1 - EPS))


def information(theta: Column, a: Column, b: Column, g: Column) -> Column:
    """Fisher information of an item at an ability."""
    p = icc(theta, a, b, g)
    return a * a * (F.pow(p - g, F.lit(2.0)) / F.pow(1 - g, F.lit(2.0))) * ((1 - p) / p)


def log_loss(correct: Column, p: Column) -> Column:
    """Negative log likelihood of one answer (0 or 1)."""
    return -(correct * F.log(p) + (1 - correct) * F.log(1 - p))
