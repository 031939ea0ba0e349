"""Scores of vectors and logits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.try_divide(dot(a, b), size)).otherwise(F.lit(0.0))


def second_of_two(a: Column, b: Column) -> Column:
    """The second class's share of a softmax."""
    return 1 / (1 + F.exp(a - b))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
