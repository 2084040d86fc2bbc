"""Order-dependent operators: previous row, neighbourhoods, running ordinals, first rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def previous(frame: DataFrame, keys: list[str], order: list[str], columns: list[str], slot: Column | None = None) -> DataFrame:
    """Add prev_<column> and has_prev from the row before in each group.

    ``slot`` is a monotone function of the order (a day of a time): rows are then ordered within (group, slot) only,
    and what crosses a slot is looked up in a table of each slot's last row, so no group meets in one task.
    """
    values = F.struct(F.lit(True).alias("has"), *[F.col(c) for c in columns])
    if slot is None:
        before = F.lag(values).over(W.partitionBy(*keys).orderBy(*order))
        found = frame.withColumn("__p", before)
    else:
        rows = frame.withColumn("__slot", slot)
        rows = rows.withColumn("__p", F.lag(values).over(W.partitionBy(*keys, "__slot").orderBy(*order)))
        lasts = rows.groupBy(*keys, "__slot").agg(F.max_by(values, F.struct(*order)).alias("__last"))
        lasts = lasts.withColumn("__before", F.lag("__last").over(W.partitionBy(*keys).orderBy("__slot"))).drop("__last")
        k = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "__slot"]]
        cond = k[0]
        for x in k[1:]:
            cond &= x
        found = rows.alias("a").join(lasts.alias("b"), cond, "left").select("a.*", "b.__before").withColumn("__p", F.coalesce("__p", "__before")).drop("__before", "__slot")
    return found.select(*frame.columns, F.coalesce(F.col("__p.has"), F.lit(False)).alias("has_prev"), *[F.col(f"__p.{c}").alias(f"prev_{c}") for c in columns])


def ordinal(frame: DataFrame, keys: list[str], order: list[str], out: str, slot: Column | None = None) -> DataFrame:
    """Add the zero-based place of each row in its group as ``out``.

    With a ``slot`` (see ``previous``) rows are counted within (group, slot), and what comes before a slot is the sum over
    the slots before it, so no group meets in one task.
    """
    if slot is None:
        return frame.withColumn(out, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    rows = frame.withColumn("__slot", slot)
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1))
    starts = rows.groupBy(*keys, "__slot").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(before, F.lit(0)))
    rows = rows.withColumn("__in", F.row_number().over(W.partitionBy(*keys, "__slot").orderBy(*order)) - 1)
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "__slot"]])
    joined = rows.alias("a").join(starts.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in frame.columns], (F.col("b.__start") + F.col("a.__in")).cast("long").alias(out))


def at_places(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys and place (``__i``) are in ``wanted``; null is a key like any other."""
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys], F.col("a.__i") == F.col("b.__i"))
    return rows.alias("a").join(wanted.alias("b"), same, "left_semi")


def neighbourhood(frame: DataFrame, keys: list[str], order: list[str], match: Column, before: int = 1, after: int = 1, slot: Column | None = None) -> DataFrame:
    """Rows at most ``before`` ahead of a match or ``after`` behind one.

    With a ``slot`` (see ``ordinal``) each match names the places around it, and the rows at those places are kept.
    """
    if slot is None:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-after, before)
        near = F.max(F.when(match, 1).otherwise(0)).over(w)
        return frame.withColumn("__near", near).where("__near = 1").drop("__near")
    rows = ordinal(frame.withColumn("__hit", F.coalesce(match, F.lit(False))), keys, order, "__i", slot)
    around = F.explode(F.sequence(F.col("__i") - before, F.col("__i") + after))
    wanted = rows.where("__hit").select(*keys, around.alias("__i")).distinct()
    return at_places(rows, wanted, keys).select(*frame.columns)


def running_id(frame: DataFrame, keys: list[str], order: list[str], out: str, prefix: str = "", width: int = 0, slot: Column | None = None) -> DataFrame:
    """A zero-based ordinal for each row of a group, optionally as a padded id; ``slot`` as in ``ordinal``."""
    rows = ordinal(frame, keys, order, out, slot)
    return rows.withColumn(out, F.concat(F.lit(prefix), F.lpad(F.col(out).cast("string"), width, "0"))) if width else rows


def first_per_key(frame: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_per_group(frame, keys, order, 1)


def last_per_key(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last written wins (the upsert of an indexed table)."""
    return top_per_group(frame, keys, [F.desc(c) for c in order], 1)


def top_per_group(frame: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts each task's groups to ``n`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")
