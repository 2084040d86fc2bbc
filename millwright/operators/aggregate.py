"""Facets, counts, surfaces and caps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def facets(frame: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """facet, key, n: the most frequent values of each column, ties by key.

    Values are counted by one grouping-sets aggregate; only the counts are ranked.
    """
    sets = [[c] for c in columns]
    counted = frame.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    bit = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    facet = F.coalesce(*[F.when(F.col("g") == bit[c], F.lit(c)) for c in columns])
    key = F.coalesce(*[F.when(F.col("g") == bit[c], F.col(c).cast("string")) for c in columns])
    rows = counted.select(facet.alias("facet"), key.alias("key"), "n")
    rank = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), F.asc_nulls_first("key")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def distinct_per_group(frame: DataFrame, keys: list[str], value: str, out: str, limit: int | None = None) -> DataFrame:
    """Sorted distinct values of each group as one array (the first ``limit`` of them)."""
    unique = frame.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    if limit is not None:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(value))
        unique = unique.withColumn("__r", rank).where(F.col("__r") <= limit).drop("__r")
    return unique.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(out))


def cap_and_count(frame: DataFrame, key: str, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each key (null is one), each with the key's uncapped ``total``.

    Counts combine before the shuffle, and rows are cut in each task before they are ranked.
    """
    totals = frame.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("total"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    first = frame.withColumn("rank", rank).where(F.col("rank") <= cap)
    return first.join(totals, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def coverage_surface(source: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """key, source_count, covered_count, missing_count, status from two frames of rows that carry the key."""
    a = source.groupBy(key).agg(F.count("*").alias("source_count"))
    b = covered.groupBy(key).agg(F.count("*").alias("covered_count"))
    both = a.join(b, key, "full")
    n, m = F.coalesce("source_count", F.lit(0)), F.coalesce("covered_count", F.lit(0))
    missing = F.greatest(n - m, F.lit(0))
    return both.select(key, n.alias("source_count"), m.alias("covered_count"), missing.alias("missing_count"), F.when(missing == 0, "green").otherwise("red").alias("status"))


def conditional_counts(frame: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """dataset, n."""
    parts = [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n") for name, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def element_counts(frame: DataFrame, text: str, pattern: str, columns: Iterable[str] = ()) -> DataFrame:
    """element, n: how often the pattern's first group matches in a text column."""
    hits = frame.select(*columns, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("element"))
    return hits.groupBy(*columns, "element").agg(F.count("*").alias("n"))
