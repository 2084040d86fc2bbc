"""Predicates and row selection by symbol, text, list and range."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.text import base_symbol


def symbol_match(column: Column, symbol: str, mode: str = "exact", folded: Column | None = None) -> Column:
    """``exact``, ``members`` (the symbol, what follows a dot or an index) or ``base``, ignoring case.

    ``folded`` is a stored lower-case copy of the column; with it the predicate reaches the scan.
    """
    low = F.lower(column) if folded is None else folded
    s = symbol.lower()
    if mode == "exact":
        return low == s
    if mode == "members":
        return (low == s) | low.startswith(s + ".") | low.startswith(s + "[")
    if mode == "base":
        return base_symbol(low) == s
    raise ValueError(f"unknown mode {mode!r}")


def contains(column: Column, query: str, ignore_case: bool = True) -> Column:
    """Literal substring; ``_`` and ``%`` mean themselves."""
    return F.contains(F.lower(column), F.lit(query.lower())) if ignore_case else F.contains(column, F.lit(query))


def in_list(column: Column, values: str | Iterable[str] | None) -> Column:
    """Membership in a list or a comma-separated string; an empty list lets all through."""
    items = [v.strip() for v in (values.split(",") if isinstance(values, str) else values or []) if v and v.strip()]
    return column.isin(*items) if items else F.lit(True)


def destructive(column: Column, wanted: bool | None, writes: Iterable[str] = ("write", "read_write")) -> Column:
    """Writes only, all but writes (null neither way), or everything."""
    if wanted is None:
        return F.lit(True)
    return column.isin(*writes) if wanted else ~column.isin(*writes)


def plain_scope(scope: Column) -> Column:
    return F.regexp_replace(scope, "^Program:", "")


def in_range(column: Column, start=None, end=None) -> Column:
    """Both ends inclusive, either open."""
    keep = F.lit(True)
    if start is not None:
        keep &= column >= F.lit(start)
    if end is not None:
        keep &= column <= F.lit(end)
    return keep


def point_lookup(frames: Iterable[tuple[DataFrame, Column]], order: list) -> DataFrame:
    """The first row that satisfies its predicate, frames in order of preference; all frames have the same columns."""
    found = None
    for rank, (frame, predicate) in enumerate(frames):
        part = frame.where(predicate).withColumn("__rank", F.lit(rank))
        found = part if found is None else found.unionByName(part)
    return found.orderBy("__rank", *order).limit(1).drop("__rank")


def exists(frame: DataFrame, predicate: Column) -> DataFrame:
    """One row: found, n."""
    return frame.where(predicate).agg((F.count("*") > 0).alias("found"), F.count("*").alias("n"))
