"""Joins: enrichment, semi and anti, prefix, array members, outer bindings, steps through a shared key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.text import base_symbol


def enrich_by_priority(rows: DataFrame, key: str, lookups: list[DataFrame], out: str) -> DataFrame:
    """Left join to several lookups (key, value): the first lookup that knows the key gives ``out``.

    One join against the union of the lookups instead of one for each.
    """
    parts = [d.select(F.col(d.columns[0]).alias("__k"), F.struct(F.lit(i).alias("p"), F.col(d.columns[1]).cast("string").alias("v")).alias("s")) for i, d in enumerate(lookups)]
    best = reduce(DataFrame.unionByName, parts).groupBy("__k").agg(F.min("s").alias("s"))
    return rows.join(best, rows[key] == best["__k"], "left").select(*[rows[c] for c in rows.columns], F.col("s.v").alias(out))


def present(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(other.select(*on), on, "left_semi")


def absent(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(other.select(*on), on, "left_anti")


def prefix_join(symbols: DataFrame, symbol: str, refs: DataFrame, ref: str, by: list[str] | None = None) -> DataFrame:
    """Symbols with each reference to them or to a member: an equi-join on the base (and ``by``), then the exact rule."""
    a = symbols.withColumn("__base", base_symbol(F.col(symbol)))
    b = refs.withColumn("__base", base_symbol(F.col(ref)))
    s, r = F.col(symbol), F.col(ref)
    fits = (r == s) | F.startswith(r, F.concat(s, F.lit("."))) | F.startswith(r, F.concat(s, F.lit("[")))
    return a.join(b, [*(by or []), "__base"]).where(fits).drop("__base")


def member_join(rows: DataFrame, array: str, also: str, names: DataFrame, name: str) -> DataFrame:
    """Rows whose array column (or the ``also`` column) holds a name: exploded equi-join, each pair once."""
    keys = F.array_distinct(F.concat(F.coalesce(F.col(array), F.array().cast("array<string>")), F.array(F.col(also))))
    return rows.withColumn("__m", F.explode(keys)).join(names, F.col("__m") == F.col(name)).drop("__m")


def through(left: DataFrame, right: DataFrame, via: str, frm: str, to: str) -> DataFrame:
    """Distinct (frm, to) pairs of rows that share ``via``: one step of a flow.

    The pairs are what is asked for, so a ``via`` with n and m distinct ends gives n * m of them.
    """
    return left.select(via, frm).distinct().join(right.select(via, to).distinct(), via).select(frm, to).distinct()


def bindings(formal: DataFrame, instance: DataFrame, wires: DataFrame, args: DataFrame, on: list[str]) -> DataFrame:
    """Every instance with every formal parameter, its wires and arguments as sorted arrays, and whether it is wired.

    ``formal`` (type, param, ...), ``instance`` (id, type), ``wires`` and ``args`` (id, param, expr); ``on`` names the
    three columns type, id and param.
    """
    kind, key, param = on
    full = instance.join(formal, kind)
    w = wires.groupBy(key, param).agg(F.sort_array(F.collect_list("expr")).alias("sources"))
    a = args.groupBy(key, param).agg(F.min("expr").alias("argument"))
    out = full.join(w, [key, param], "left").join(a, [key, param], "left")
    return out.withColumn("wired", F.col("sources").isNotNull() | F.col("argument").isNotNull())


def binding_totals(bound: DataFrame, key: str, required: Column) -> DataFrame:
    return bound.groupBy(key).agg(F.count("*").alias("total"), F.count_if("wired").alias("wired"), F.count_if(~F.col("wired")).alias("unwired"), F.count_if(~F.col("wired") & required).alias("required_unwired"))


def wire_ends(wires: DataFrame, nodes: DataFrame, group: str, frm: str, to: str, node: str, label: str) -> DataFrame:
    """Labels of both ends of each wire; an unknown end is ``unresolved:<id>``."""
    n = nodes.select(F.col(group).alias("__g"), F.col(node).alias("__n"), F.col(label).alias("__l"))
    for end, out in ((frm, "source"), (to, "target")):
        m = n.select(*[F.col(c).alias(f"{c}_{out}") for c in n.columns])
        wires = wires.join(m, (F.col(group) == F.col(f"__g_{out}")) & (F.col(end) == F.col(f"__n_{out}")), "left")
        wires = wires.withColumn(out, F.coalesce(F.col(f"__l_{out}"), F.concat(F.lit("unresolved:"), F.col(end)))).drop(f"__g_{out}", f"__n_{out}", f"__l_{out}")
    return wires
