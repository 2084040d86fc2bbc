"""Sorting, limits and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(value, low: int, high: int | None = None, default: int | None = None) -> int:
    """An integer setting within its bounds."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        n = low if default is None else default
    return max(low, n if high is None else min(n, high))


def page(frame: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return frame.orderBy(*order).offset(bounded(offset, 0)).limit(bounded(limit, 0))


def probe(frame: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page and, if there is one, the row after it, which tells that there are more without a count."""
    return page(frame, order, bounded(limit, 0) + 1, offset)


def envelope(frame: DataFrame, order: list, limit: int, offset: int = 0, exact: bool = True) -> dict:
    """A page as rows with totals; without ``exact`` one more row is fetched instead of counting."""
    limit, offset = bounded(limit, 0), bounded(offset, 0)
    if exact:
        total = frame.count()
        rows = page(frame, order, limit, offset).collect()
        more = offset + len(rows) < total
        return {"items": [r.asDict(True) for r in rows], "total": total, "offset": offset, "limit": limit, "has_more": more, "truncated": more}
    rows = probe(frame, order, limit, offset).collect()
    return {"items": [r.asDict(True) for r in rows[:limit]], "total": None, "offset": offset, "limit": limit, "has_more": len(rows) > limit, "truncated": None}


def numeric_first(column: Column, missing: int = 1_000_000_000) -> list[Column]:
    """Order numbers by value and put what is no number last."""
    number = F.when(column.rlike(r"^\d+$"), column.try_cast("long"))
    return [F.coalesce(number, F.lit(missing)), column]


def did_you_mean(frame: DataFrame, name: str, query: str, limit: int = 5) -> DataFrame:
    """Distinct names that contain the query, the shortest first."""
    close = frame.select(name).where(F.contains(F.lower(name), F.lit(query.lower()))).distinct()
    return close.orderBy(F.length(name), name).limit(limit)
