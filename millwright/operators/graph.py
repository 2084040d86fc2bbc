"""Closures, chains, trees and paths by iterated joins.

Each round's frontier is written out, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.sources.shared import discard, materialize


def impact_closure(reads: DataFrame, writes: DataFrame, start: DataFrame, max_depth: int = 3) -> DataFrame:
    """kind ('unit' or 'item'), id, depth of all that a change reaches, by first visit.

    ``reads`` (unit, item): a unit that reads an affected item is affected one level deeper, and so is (at the unit's
    level) every item of ``writes`` (unit, item) that it drives. ``start`` (item) has depth 0. Both relations are read
    as they are in each round, semi-joined to the frontier, and only what that touches is made distinct; a table sorted
    by its join column skips what the frontier does not name.
    """
    reads, writes = reads.select("unit", "item"), writes.select("unit", "item")
    items = [materialize(start.select("item").distinct().withColumn("depth", F.lit(0)), "items")]
    units: list[DataFrame] = []
    frontier = items[0]
    for depth in range(1, max_depth + 1):
        found = reads.join(frontier.select("item"), "item", "left_semi").select("unit").distinct()
        if units:
            found = found.join(reduce(DataFrame.union, units).select("unit"), "unit", "left_anti")
        found = materialize(found.withColumn("depth", F.lit(depth)), "units")
        units.append(found)
        driven = writes.join(found.select("unit"), "unit", "left_semi").select("item").distinct()
        driven = driven.join(reduce(DataFrame.union, items).select("item"), "item", "left_anti")
        frontier = materialize(driven.withColumn("depth", F.lit(depth)), "items")
        if frontier.isEmpty():
            break
        items.append(frontier)
    out = reduce(DataFrame.union, items).select(F.lit("item").alias("kind"), F.col("item").cast("string").alias("id"), "depth")
    return out.union(reduce(DataFrame.union, units).select(F.lit("unit"), F.col("unit").cast("string"), "depth")) if units else out


def alias_roots(aliases: DataFrame, name: str, target: str) -> DataFrame:
    """name, root, hops for every alias, by doubling: each round follows a chain twice as far.

    A chain that runs into a cycle has the cycle's smallest name as root and no hops (null). Of several targets of a
    name the largest counts.
    """
    edges = aliases.select(F.col(name).alias("name"), F.col(target).alias("target")).where("target is not null").groupBy("name").agg(F.max("target").alias("target"))
    at = materialize(edges.select("name", F.col("target").alias("root"), F.lit(1).cast("long").alias("hops"), F.col("target").alias("low")), "alias")
    most, reach, last = at.count(), 1, -1
    while True:
        hop = at.select(F.col("name").alias("root"), F.col("root").alias("next"), F.col("hops").alias("more"), F.col("low").alias("lower"))
        step = at.join(hop, "root", "left").select("name", F.coalesce("next", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.least("low", "lower").alias("low"), F.col("next").isNotNull().alias("moved"))
        before, at, reach = at, materialize(step, "alias"), 2 * reach
        discard(before)
        moving = at.where("moved").count()
        if not moving:
            return at.select("name", "root", "hops")
        # On a chain every distance to its end occurs, so a round in which none arrives leaves those that go round alone.
        most, last = moving if moving == last else most, moving
        if reach > most:  # what still moves goes round: its place is on a cycle, and ``low`` there has seen all of it
            ends = at.where("moved").select(F.col("name").alias("root"), F.col("low").alias("least"))
            out = at.join(ends, "root", "left")
            return out.select("name", F.coalesce("least", "root").alias("root"), F.when(F.col("least").isNull(), F.col("hops")).alias("hops"))


def alias_group(aliases: DataFrame, name: str, target: str, start: str) -> DataFrame:
    """name of everything that resolves to the same root as ``start`` (itself and the root too)."""
    roots = materialize(alias_roots(aliases, name, target), "roots")
    own = roots.where(F.col("name") == F.lit(start)).select("root").first()
    root = start if own is None else own["root"]
    found = roots.where((F.col("root") == F.lit(root)) | (F.col("name") == F.lit(root))).select(F.col("name").cast("string").alias("name"))
    spark = aliases.sparkSession
    return found.union(spark.createDataFrame([(str(start),), (str(root),)], "name string")).distinct()


def tree(nodes: DataFrame, key: str, parent: str, by: list[str] | None = None) -> DataFrame:
    """by, key, parent, root, depth, orphan, cycle for each key (within ``by``), of any depth, by doubling.

    Roots have no parent, themselves as parent, or an unknown one (orphans). What never reaches a root, because its
    parents go round, has ``cycle`` and neither root nor depth. Of several parents of a key the smallest counts.
    """
    by = by or []
    rows = nodes.groupBy(*by, F.col(key).alias("key")).agg(F.min(parent).alias("parent"))
    known = rows.select(*by, F.col("key").alias("parent"), F.lit(True).alias("known"))
    rows = rows.join(known, [*by, "parent"], "left")
    top = F.col("parent").isNull() | (F.col("parent") == F.col("key"))
    orphan = ~top & F.col("known").isNull()
    top = top | orphan
    at = rows.select(*by, "key", "parent", F.when(top, F.col("key")).otherwise(F.col("parent")).alias("root"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done"), orphan.alias("orphan"))
    at = materialize(at, "tree")
    last = -1
    # On a branch every distance to its root occurs, so a round in which none arrives leaves those that go round alone.
    while (going := at.where("not done").count()) not in (0, last):
        last = going
        hop = at.select(*by, F.col("key").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ended"))
        step = at.join(hop, [*by, "root"]).select(*by, "key", "parent", F.col("next").alias("root"), (F.col("depth") + F.when(F.col("done"), 0).otherwise(F.col("more"))).alias("depth"), F.col("ended").alias("done"), "orphan")
        before, at = at, materialize(step, "tree")
        discard(before)
    return at.select(*by, "key", "parent", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).cast("int").alias("depth"), "orphan", (~F.col("done")).alias("cycle"))


def expand_paths(edges: DataFrame, start: DataFrame, max_depth: int, branches: int, order: list[Column]) -> DataFrame:
    """path, depth, state of every walk from ``start`` (node) along ``edges`` (node, next, ...).

    At most ``branches`` edges of a node are followed (by ``order``); a walk ends as ``leaf`` (no edge on), ``cycle``
    (the node is on the walk already) or ``max_depth``; walks that go on are ``inner``.
    """
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("node").orderBy(*order))
    few = materialize(edges.withColumn("__r", rank).where(F.col("__r") <= branches).select("node", "next"), "edges")
    has = few.select("node").distinct().withColumn("on", F.lit(True))
    level = start.select("node", F.array("node").alias("path"), F.lit(False).alias("cycle"))
    levels = []
    for depth in range(max_depth + 1):
        state = F.when(F.col("cycle"), "cycle").when(F.lit(depth == max_depth), "max_depth").when(F.col("on").isNull(), "leaf").otherwise("inner")
        level = materialize(level.join(has, "node", "left").select("node", "path", F.lit(depth).alias("depth"), state.alias("state")), "paths")
        levels.append(level)
        going = level.where("state = 'inner'")
        if depth == max_depth or going.isEmpty():
            break
        level = going.join(few, "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.array_contains("path", F.col("next")).alias("cycle"))
    return reduce(DataFrame.union, levels).select("path", "depth", "state")
