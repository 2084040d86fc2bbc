"""Nested values of trees that are stored as rows."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.operators.graph import tree
from millwright.sources.shared import discard, materialize


def filled(record: dict) -> dict:
    """Without nulls, empty strings, lists and maps; zeros and false stay."""
    return {k: v for k, v in record.items() if v is not None and v != "" and v != [] and v != {}}


def assembled(rows, max_depth: int, max_children: int | None):
    """The tree of one root as JSON texts of its top elements, from rows in ``post`` order.

    An element meets its children's texts when it ends, and only as many are kept as are shown; what is open at any time
    are the elements from the root to the current one.
    """
    waiting: dict[int, tuple[list[str], int]] = {}  # by parent: texts of the first children, and how many there are
    for r in rows:
        children, n = waiting.pop(r["pre"], ([], 0))
        if r["level"] > max_depth:
            children, n = [], 0
            texts, seen = waiting.get(r["parent_pre"], ([], 0))
            waiting[r["parent_pre"]] = texts, seen + 1
            continue
        deep = r["level"] == max_depth and n > 0
        shown = [] if deep else children
        head = filled({"element": r["element"], "attributes": dict(r["attrs"] or {}), "text": r["text"]})
        cut = 0 if max_children is None else max(0, n - max_children)
        body = json.dumps(head, ensure_ascii=False, separators=(",", ":"))[1:-1]
        body += (',"children":[' + ",".join(shown) + "]" if shown else "") + f',"children_truncated":{cut},"depth_truncated":{"true" if deep else "false"}'
        texts, seen = waiting.setdefault(r["parent_pre"], ([], 0))
        if max_children is None or seen < max_children:
            texts.append("{" + body + "}")
        waiting[r["parent_pre"]] = texts, seen + 1
    return waiting


def nested_values(nodes: DataFrame, by: list[str], max_depth: int, max_children: int | None) -> DataFrame:
    """``by`` and ``parsed``, a JSON array of the trees under each root: elements of a level up to ``max_depth`` (0 is
    the first below the root), each with at most ``max_children`` children; what is left out is counted or marked.

    ``nodes``: by, pre, post, parent_pre, root_pre, level, element, attrs, text. Each root's rows are streamed in ``post``
    order; an element that is left out holds nothing.
    """
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in by}

    def run(batches):
        key, rows = None, []

        def out():
            top, _ = assembled(rows, max_depth, max_children).get(key[-1], ([], 0))
            return pa.RecordBatch.from_pydict({**{c: [v] for c, v in zip(by, key)}, "parsed": ["[" + ",".join(top) + "]"]})

        for b in batches:
            for r in b.to_pylist():
                at = (*(r[c] for c in by), r["root_pre"])
                if at != key:
                    if rows:
                        yield out()
                    key, rows = at, []
                rows.append(r)
        if rows:
            yield out()

    dealt = nodes.repartition(*by, "root_pre").sortWithinPartitions(*by, "root_pre", "post")
    return dealt.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", parsed string")


def _cycle_heads(going_round: DataFrame, by: list[str]) -> DataFrame:
    """by, key of the smallest key of each cycle, of rows (by, key, parent) that all lead into one."""
    at = materialize(going_round.select(*by, "key", F.col("parent").alias("far"), F.col("key").alias("least")), "cycle")
    steps = max(1, at.count()).bit_length()
    # First far enough that every row's far key is on its cycle, then the smallest key on the way round from there.
    for seek in (False, True):
        if seek:
            start = at.select(*by, F.col("far").alias("key")).distinct()
            before, at = at, materialize(start.join(going_round, [*by, "key"]).select(*by, "key", F.col("parent").alias("far"), F.col("key").alias("least")), "cycle")
            discard(before)
        for _ in range(steps):
            hop = at.select(*by, F.col("key").alias("far"), F.col("far").alias("next"), F.col("least").alias("other"))
            step = at.join(hop, [*by, "far"]).select(*by, "key", F.col("next").alias("far"), F.least("least", "other").alias("least"))
            before, at = at, materialize(step, "cycle")
            discard(before)
    return at.select(*by, F.col("least").alias("key")).distinct()


def nested_forest(rows: DataFrame, key: str, parent: str, by: list[str], fields: list[str], order: list[Column]) -> DataFrame:
    """by, roots, orphans, cycles: each tree of ``rows`` (one row a key) as nested JSON, children by ``order``, to any depth.

    Roots are keys without a parent, orphans (of an unknown parent) and, of keys whose parents go round, the smallest of
    each cycle; the latter two are also named. Levels are folded from the deepest up: a level's nodes join their
    children's texts, so no node is handled twice.
    """
    keyed = rows.select(*by, F.col(key).cast("string").alias("key"), F.nullif(F.col(parent).cast("string"), F.lit("")).alias("p"), F.struct(*order).alias("o"), F.struct(*fields).alias("shown"))
    keyed = materialize(keyed, "forest")
    links = keyed.select(*by, F.col("key").alias("k"), "p")
    places = materialize(tree(links, "k", "p", by), "forest-places")
    cycles = places.where("cycle")
    if cycles.isEmpty():
        heads = cycles.select(*by, "key")
    else:
        heads = materialize(_cycle_heads(cycles.select(*by, "key", "parent"), by), "forest-heads")
        cut = heads.select(*by, F.col("key").alias("k"), F.lit(True).alias("head"))
        links = links.join(cut, [*by, "k"], "left").withColumn("p", F.when(F.col("head"), F.lit(None)).otherwise(F.col("p")))
        places = materialize(tree(links, "k", "p", by), "forest-places")
    marks = heads.select(*by, "key", F.lit(True).alias("cycle_head"))
    nodes = places.drop("cycle").join(marks, [*by, "key"], "left").join(keyed.drop("p"), [*by, "key"])
    shown = [F.col(f"shown.{c}") for c in fields] + [F.when(F.col("orphan"), True).alias("orphan"), F.when(F.col("cycle_head"), True).alias("cycle")]
    up = F.when(F.col("depth") > 0, F.col("parent"))
    nodes = materialize(nodes.select(*by, "key", up.alias("up"), "depth", "orphan", F.col("cycle_head").isNotNull().alias("cycle"), "o", F.to_json(F.struct(*shown)).alias("text")), "forest-nodes")
    below = None
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        level = level.withColumn("children", F.lit("")) if below is None else level.join(below, [*by, "key"], "left")
        inner = F.concat(F.lit('"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        text = F.concat(F.expr("substring(text, 1, length(text) - 1)"), F.when(F.col("text") == "{}", F.lit("")).otherwise(F.lit(",")), inner)
        level = materialize(level.select(*by, "up", "o", "key", "orphan", "cycle", text.alias("text")), "forest-level")
        if depth:
            each = F.array_sort(F.collect_list(F.struct("o", "key", "text")))
            below = level.groupBy(*by, F.col("up").alias("key")).agg(F.array_join(F.transform(each, lambda x: x["text"]), ",").alias("children"))
    roots = F.transform(F.array_sort(F.collect_list(F.struct("o", "key", "text"))), lambda x: x["text"])
    names = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("key")))).alias(f"{c}s")
    return level.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(roots, ","), F.lit("]")).alias("roots"), names("orphan"), names("cycle"))
