"""Static rules over reads and writes, and their runner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.operators.sets import union_all

SEVERITIES = ("error", "warning", "info")
CAP = 500


def _columns(item: str | list[str]) -> list[str]:
    return [item] if isinstance(item, str) else list(item)


def multiple_writers(writes: DataFrame, item: str | list[str], writer: str, least: int = 2, shown: int = 10) -> DataFrame:
    """Items (one or more columns) that several units write: writer_count and the first writers by name."""
    item = _columns(item)
    pairs = writes.select(*item, writer).distinct()
    many = pairs.groupBy(*item).agg(F.count("*").alias("writer_count")).where(F.col("writer_count") >= least)
    rank = F.row_number().over(W.partitionBy(*item).orderBy(writer))
    first = pairs.withColumn("r", rank).where(F.col("r") <= shown).groupBy(*item).agg(F.sort_array(F.collect_list(writer)).alias("writers"))
    return many.join(first, item)


def written_never_read(writes: DataFrame, reads: DataFrame, item: str | list[str]) -> DataFrame:
    item = _columns(item)
    return writes.select(*item).distinct().join(reads.select(*item), item, "left_anti")


def read_never_written(writes: DataFrame, reads: DataFrame, item: str | list[str]) -> DataFrame:
    item = _columns(item)
    return reads.select(*item).distinct().join(writes.select(*item), item, "left_anti")


def broken_references(refs: DataFrame, ref: str, known: list[tuple[DataFrame, str]], by: list[str] | None = None) -> DataFrame:
    """Rows whose reference no list of known names has (with equal ``by``, such as the project)."""
    by = by or []
    out = refs.where(F.col(ref).isNotNull())
    for frame, name in known:
        out = out.join(frame.select(*by, F.col(name).alias(ref)), [*by, ref], "left_anti")
    return out


def unused_definitions(defined: DataFrame, name: str, uses: list[tuple[DataFrame, str]], by: list[str] | None = None) -> DataFrame:
    by = by or []
    used = union_all([f.select(*by, F.col(c).alias(name)) for f, c in uses]).distinct()
    return defined.join(used, [*by, name], "left_anti")


def run(rules: dict[str, Callable[[], DataFrame]], only: list[str] | None = None, severity: str | None = None, cap: int = CAP) -> DataFrame:
    """Findings (rule, severity, entity, title, detail) of the chosen rules, at most ``cap`` a rule, with its uncapped total."""
    found = union_all([make() for name, make in rules.items() if not only or name in only])
    if severity:
        found = found.where(F.col("severity") == severity)
    w = W.partitionBy("rule")
    ranked = found.withColumns({"rank": F.row_number().over(w.orderBy("entity", "detail"))}).where(F.col("rank") <= cap)
    totals = found.groupBy("rule").agg(F.count("*").alias("total"))
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int")
    return ranked.join(totals, "rule").withColumn("severity_rank", order).drop("rank")


def summary(findings: DataFrame, by: str) -> DataFrame:
    return findings.groupBy(by).agg(F.count("*").alias("n"))
