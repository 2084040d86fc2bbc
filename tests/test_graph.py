"""Aliases and trees by doubling against plain walks, on random graphs with chains and cycles."""

import random

import pytest

from millwright.operators import graph


def alias_walk(target, k):
    """The root and hops of a name; on a cycle its smallest name and none."""
    seen = [k]
    while target.get(k) is not None:
        k = target[k]
        if k in seen:
            return min(seen[seen.index(k) :]), None
        seen.append(k)
    return k, len(seen) - 1


def tree_walk(parent, k):
    """The root, depth and whether it never gets there."""
    seen = [k]
    while parent[k] is not None and parent[k] != k and parent[k] in parent:
        k = parent[k]
        if k in seen:
            return None, None, True
        seen.append(k)
    return k, len(seen) - 1, False


def graph_of(seed):
    if seed == 0:  # a chain of 300 and a cycle of 37
        return {i: i - 1 if i else None for i in range(300)} | {1000 + i: 1000 + (i + 1) % 37 for i in range(37)}
    r = random.Random(seed)
    n = r.choice([1, 5, 40, 120])
    return {i: t if t >= 0 else None for i in range(n) if (t := r.randrange(-n // 4 - 1, n)) is not None}


@pytest.mark.parametrize("seed", range(4))
def test_doubling(spark, seed):
    target = graph_of(seed)
    frame = spark.createDataFrame(list(target.items()), "k long, t long")
    got = {r["name"]: (r["root"], r["hops"]) for r in graph.alias_roots(frame, "k", "t").collect()}
    assert got == {k: alias_walk(target, k) for k, t in target.items() if t is not None}
    got = {r["key"]: (r["root"], r["depth"], r["cycle"]) for r in graph.tree(frame, "k", "t").collect()}
    assert got == {k: tree_walk(target, k) for k in target}
