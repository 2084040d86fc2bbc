"""Unions, differences and ordered distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.windows import first_per_key


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of unlike frames; a column that a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_keep_first(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_per_key(frame, keys, order)


def difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).distinct().join(b.select(on), on, "left_anti")


def intersection(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).distinct().join(b.select(on), on, "left_semi")


def ordered_distinct(array):
    return F.array_distinct(F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x != ""))
