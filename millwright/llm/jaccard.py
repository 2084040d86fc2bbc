"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's set is its distinct shingles of ``WIDTH`` words (fewer words: the whole sequence as one), as 64-bit hashes:
two texts with different sets are mistaken only if shingles of theirs share a hash, about 1e-14 for sets of 500. Equal
sets, by a 128-bit digest, become one record first. Sets of n and m shingles are linked if they share at least
T = ceil(percent * (n + m) / (100 + percent)) of them.

A set's inverted lists are divided: all but a few are long, namely those of its most frequent shingles, and the short
ones are the n - ceil(percent * n / 100) + l(n) rarest, l(n) = 2 + n // 100. Two linked sets share at least the smaller
l of their short lists, since only so many elements of each can be missing in the other. So the short lists alone are
stored and merged, with a heap, for each set; a candidate that is often enough in them is probed for the rest of the
shingles by binary search, in the order from rare to frequent, until it has T or cannot get there. (The probe of a long
list for one candidate is made in the candidate's sorted shingles, which says the same: the list itself, which may name
a third of all documents, never travels.)

The order of shingles is by counts over all documents, kept as the levels of at most ``HEAVY`` heaviest shingles in a
table of ``SLOTS`` bytes, then by hash. Any order gives the same links; this one keeps lists short.

A short list of more than ``LIST_LIMIT`` sets is that of a large family of near copies. It is dealt into sublists by
hash; in each a set is compared with the two others nearest to it by the parities of its shingles in hash ranges: each
shingle that only one of two sets has changes one, so that as many differ at most as shingles do. Links found join components; rounds go on with one set a component and list, until
lists have one component or nothing new is found. What is left (sets outside the largest component of a list) is
compared with the whole list, in blocks, through the same bound: every pair that shares a list is compared or connected.

Null and empty texts and those without words have the empty set and are linked with nothing, not even each other. Null
doc_ids never name a component unless it has no other. Rows with equal or null doc_id are separate. Repeated rows, ties
and other columns are harmless; an empty table gives an empty result. Input that is not read from Parquet files is
written out first, since texts are read several times.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import RID, as_table, column, discard, join_bounded, materialize, pick, shuffle_partitions, slices, small_batches, split_words, strings
from millwright.llm.simhash import components

WIDTH, PERCENT = 3, 90
SLOTS, HEAVY = 1 << 22, 1 << 20
BLOCK_SHINGLES = 1 << 20
LIST_LIMIT, ROUNDS = 32, 4
PARITY_BITS = 1024

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # the finalizer of MurmurHash3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest as xxh

    coded = words.dictionary_encode()
    return np.fromiter(map(xxh, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, each text's in ascending order, and the number of each."""
    parent, words = split_words(pc.ascii_lower(texts))
    n = len(texts)
    w = _word_hashes(words)
    size = np.bincount(parent, minlength=n)
    first = np.cumsum(size) - size

    def chained(starts, count):
        h = np.full(len(starts), count, np.uint64)
        for k in range(count):
            h = _mix(h * _M2 + w[starts + k])
        return h

    full = np.flatnonzero(parent[: max(0, len(w) - width + 1)] == parent[width - 1 :]) if len(w) >= width else np.zeros(0, np.int64)
    owners, hashes = [parent[full]], [chained(full, width)]
    for count in range(1, width):
        short = np.flatnonzero(size == count)
        owners.append(short)
        hashes.append(chained(first[short], count))
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((hashed, owner))
    owner, hashed = owner[order], hashed[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    return hashed[new], np.bincount(owner[new], minlength=n)


def at_least(n, percent: int):
    """The fewest shingles that a set linked with one of ``n`` shares with it."""
    return (percent * n + 99) // 100


def required(n, m, percent: int):
    return -(-percent * (n + m) // (100 + percent))


def extra(n):
    """l(n): how many of its short lists a set shares at least with another one, if both have as many."""
    return 2 + n // 100


def can_link(n, percent: int):
    """Whether a set of n shingles can be linked with another set at all."""
    return 100 * n >= percent * (n + 1)


# --- scans ------------------------------------------------------------------------------------------------------

_SCAN = pa.schema([("rid", pa.struct([("file", pa.int64()), ("row", pa.int64())])), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("key", pa.int64()), ("parity", pa.binary()), ("shingle", pa.int64()), ("count", pa.int64())])
_SCAN_SQL = "rid struct<file:long,row:long>, doc_id long, n long, digest binary, key long, parity binary, shingle long, count long"


def _digests(hashed: np.ndarray, ends: np.ndarray, n: np.ndarray) -> list[bytes]:
    from xxhash import xxh3_128_digest

    view = memoryview(np.ascontiguousarray(hashed)).cast("B")
    return [xxh3_128_digest(view[8 * (e - k) : 8 * e]) for e, k in zip(ends.tolist(), n.tolist())]


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _scan(width: int):
    """A row for each document, and the shingles that a block of them has more than once."""

    def heavy(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts > 1
        k = int(often.sum())
        if k:
            given = {"shingle": pa.array(values[often].view(np.int64)), "count": pa.array(counts[often])}
            yield pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(k, f.type) for f in _SCAN], schema=_SCAN)

    def run(batches):
        held, size, seen = [], 0, set()
        for b in slices(batches, "text"):
            hashed, n = shingle_sets(strings(b, "text"), width)
            ends = np.cumsum(n)
            digests = _digests(hashed, ends, n)
            slot = np.repeat(np.arange(len(b)) * PARITY_BITS, n) + (hashed >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
            parity = np.zeros(len(b) * PARITY_BITS // 8, np.uint8)
            np.bitwise_xor.at(parity, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
            parity = parity.reshape(len(b), PARITY_BITS // 8)
            none = {f: pa.nulls(len(b), pa.int64()) for f in ("shingle", "count")}
            given = {"rid": column(b, RID).cast(_SCAN.field("rid").type), "doc_id": column(b, "doc_id").cast(pa.int64()), "n": pa.array(n.astype(np.int64)), "digest": pa.array(digests, pa.binary()), "key": pa.array([_key(d) for d in digests], pa.int64()), "parity": pa.array([x.tobytes() for x in parity], pa.binary())}
            yield pa.RecordBatch.from_arrays([(given | none)[f.name] for f in _SCAN], schema=_SCAN)
            fresh = []
            for d in digests:
                fresh.append(d not in seen)
                seen.add(d)
            held.append(hashed[np.repeat(np.array(fresh, bool), n)])
            size += len(held[-1])
            if size >= BLOCK_SHINGLES:
                yield from heavy(held)
                held, size, seen = [], 0, set()
        if held:
            yield from heavy(held)

    return run


def shingle_levels(counts: DataFrame, heavy: int = HEAVY, slots: int = SLOTS) -> np.ndarray:
    """A byte for each slot of hashes: the binary magnitude of the heaviest shingle there, 0 if none is among the ``heavy`` heaviest.

    ``counts``: shingle, count (several rows a shingle). The table has ``slots`` bytes, whatever the data.
    """
    summed = materialize(counts.groupBy("shingle").agg(F.floor(F.log2(F.sum("count").cast("double"))).cast("int").alias("level")), "jaccard-heavy")
    least, have = 64, 0
    for level, n in sorted(((r["level"], r["count"]) for r in summed.groupBy("level").count().collect()), reverse=True):
        have += n
        if have > heavy:
            break
        least = level
    table = summed.where(F.col("level") >= least).groupBy(F.pmod("shingle", F.lit(slots)).alias("slot")).agg(F.max("level").alias("level")).toArrow()
    out = np.zeros(slots, np.uint8)
    out[table["slot"].to_numpy()] = table["level"].to_numpy()
    return out


def _ordered(hashed: np.ndarray, n: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Each set's shingles from rare to frequent."""
    level = levels[(hashed & np.uint64(len(levels) - 1)).astype(np.int64)]
    return hashed[np.lexsort((hashed, level, np.repeat(np.arange(len(n)), n)))]


def _short_lists(levels: np.ndarray, width: int, percent: int):
    """Rows (shingle, key) of the short lists of every set; copies within a task once."""

    def run(batches):
        seen: set[bytes] = set()
        for b in slices(batches, "text"):
            hashed, n = shingle_sets(strings(b, "text"), width)
            ends = np.cumsum(n)
            digests = _digests(hashed, ends, n)
            use = can_link(n, percent)
            for i in np.flatnonzero(use).tolist():
                use[i] = digests[i] not in seen
                seen.add(digests[i])
            if len(seen) > 1 << 18:
                seen = set()
            short = np.where(use, np.minimum(n, n - at_least(n, percent) + extra(n)), 0)
            nth = np.arange(len(hashed)) - np.repeat(ends - n, n)
            keys = np.fromiter(map(_key, digests), np.int64, len(digests))
            yield pa.RecordBatch.from_arrays([pa.array(_ordered(hashed, n, levels)[nth < np.repeat(short, n)].view(np.int64)), pa.array(np.repeat(keys, short))], names=["shingle", "key"])

    return run


def _bodies(levels: np.ndarray, width: int):
    """id and shingles, from rare to frequent, of each row."""

    def run(batches):
        for b in slices(batches, "text"):
            hashed, n = shingle_sets(strings(b, "text"), width)
            data, ends = _ordered(hashed, n, levels).astype("<u8"), np.cumsum(n)
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([data[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())], pa.binary())], names=["id", "body"])

    return run


# --- search -----------------------------------------------------------------------------------------------------


def merge_lists(lists: list[list[tuple[int, int]]], n: int, id_: int, percent: int) -> list[int]:
    """Ids of the smaller sets that are in as many of the sorted short ``lists`` (of n, id) as a link asks for."""
    low, high = (at_least(n, percent), -1), (n, id_)
    cut = [x[bisect_left(x, low) : bisect_left(x, high)] for x in lists]
    return [m[1] for m, run in groupby(heapq.merge(*[x for x in cut if x])) if sum(1 for _ in run) >= extra(m[0])]


def _merge(percent: int):
    """Rows sorted by (n, id), each with one list, to pairs a, b."""

    def run(batches):
        head, lists = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for r in b.to_pylist():
                if (r["n"], r["id"]) != head:
                    if lists:
                        out += [(head[1], x) for x in merge_lists(lists, *head, percent)]
                    head, lists = (r["n"], r["id"]), []
                lists.append([(x["n"], x["id"]) for x in r["members"]])
            yield _pairs(out)
        if lists:
            yield _pairs([(head[1], x) for x in merge_lists(lists, *head, percent)])

    return run


def _pairs(found) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def probe(q: np.ndarray, c: np.ndarray, percent: int) -> bool:
    """Whether c (sorted) has enough of q (from rare to frequent): binary search, in growing steps, with an end as soon as it is sure."""
    need, have, at, step = required(len(q), len(c), percent), 0, 0, max(16, len(q) - at_least(len(q), percent) + extra(len(q)))
    while have < need <= have + len(q) - at:
        part = q[at : at + step]
        have += int((c[np.minimum(np.searchsorted(c, part), len(c) - 1)] == part).sum())
        at, step = at + len(part), 2 * step
    return have >= need


def _probe(percent: int):
    def run(batches):
        for b in batches:
            qs, cs = column(b, "body_a"), column(b, "body_b")
            ok = [probe(np.frombuffer(q.as_buffer(), "<u8"), np.sort(np.frombuffer(c.as_buffer(), "<u8")), percent) for q, c in zip(qs, cs)]
            yield pa.RecordBatch.from_arrays([column(b, "a").filter(pa.array(ok, pa.bool_())), column(b, "b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return run


def _close(n, parity, m, others, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``others`` (sets of m shingles) a set of n can be linked with by size and parities, and how many of these differ."""
    apart = np.bitwise_count(others ^ parity).sum(axis=1, dtype=np.int64)
    return (np.minimum(n, m) >= at_least(np.maximum(n, m), percent)) & (apart <= n + m - 2 * required(n, m, percent)), apart


def _arrays(members) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([x["n"] for x in members], np.int64), np.array([x["id"] for x in members], np.int64), np.stack([np.frombuffer(x["parity"], "<u8") for x in members])


def _nearest(percent: int, most: int = 2):
    """Pairs of each member of a sublist with the ``most`` earlier ones nearest to it."""

    def run(batches):
        for b in batches:
            out = []
            for members in column(b, "members").to_pylist():
                n, ids, parity = _arrays(members)
                for i in range(1, len(n)):
                    ok, apart = _close(n[i], parity[i], n[:i], parity[:i], percent)
                    at = np.flatnonzero(ok)
                    out += [(int(ids[i]), int(ids[j])) for j in at[np.argsort(apart[at], kind="stable")][:most]]
            yield _pairs(out)

    return run


def _against(percent: int):
    """Pairs of a row's set with the members of the row's block that have another component and may be linked."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n, ids, parity = _arrays(r["members"])
                ok, _ = _close(r["n"], np.frombuffer(r["parity"], "<u8"), n, parity, percent)
                ok &= np.array([x["label"] for x in r["members"]]) != r["label"]
                out += [(max(r["id"], x), min(r["id"], x)) for x in ids[ok].tolist()]
            yield _pairs(out)

    return run


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    return rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more links: components of components, so that earlier links are not gone through again."""
    if labels is None:
        return components(links)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = nodes.join(labels, "node", "full").withColumn("label", F.coalesce("label", "node"))
    every = materialize(every, "jaccard-labels")
    a, b = (every.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    edges = materialize(links.join(a, "a").join(b, "b").where("label_a != label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "jaccard-edges")
    tops = components(edges).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return materialize(every.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "jaccard-labels")


def _family_labels(hot: DataFrame, verified, percent: int, limit: int) -> DataFrame | None:
    """node, label: the components of the sets of long lists (shingle, id, n, parity); None if they have no links."""
    labels = None
    for seed in range(ROUNDS):
        firsts = _labelled(hot, labels).groupBy("shingle", "label").agg(F.min(F.struct("n", "id", "parity")).alias("m"))
        open_ = firsts.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1")
        dealt = firsts.join(open_, "shingle").withColumn("sub", F.pmod(F.xxhash64(F.lit(seed), "label"), F.ceil(F.col("k") / limit)))
        blocks = dealt.groupBy("shingle", "sub").agg(F.sort_array(F.collect_list("m")).alias("members"))  # about ``limit``, dealt by hash
        pairs = materialize(blocks.mapInArrow(_nearest(percent), "a long, b long").distinct(), "jaccard-near")
        new = verified(pairs)
        if new.isEmpty():
            break
        labels = _joined(labels, new)
    rest = materialize(_labelled(hot, labels), "jaccard-rest")
    sizes = rest.groupBy("shingle", "label").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("labels"))
    sizes = materialize(sizes.where("labels > 1"), "jaccard-open")
    if not sizes.isEmpty():
        left = rest.join(sizes, "shingle")
        blocks = left.withColumn("sub", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / (8 * limit)))).groupBy("shingle", "sub").agg(F.collect_list(F.struct("n", "id", "label", "parity")).alias("members"))
        outside = left.where("label != most").select("shingle", "id", "n", "label", "parity")
        dealt = outside.repartition(4 * shuffle_partitions(hot.sparkSession))  # few rows, each with much to compare
        pairs = dealt.join(blocks, "shingle").mapInArrow(_against(percent), "a long, b long").distinct()
        new = verified(materialize(pairs, "jaccard-outside"))
        if not new.isEmpty():
            labels = _joined(labels, new)
    return labels


def jaccard_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, list_limit: int = LIST_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """rows (rid, doc_id, n, digest), sets (id, rep, n, digest; one for each distinct set) and edges a, b between sets (ids) that connect all within the bound: links, and for large families each set with its component."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = as_table(docs)
    base = pick(docs, "doc_id", "text", rid=True)
    scan = materialize(base.mapInArrow(_scan(width), _SCAN_SQL), "jaccard-scan")
    levels = shingle_levels(scan.where("shingle is not null").select("shingle", "count"))
    rows = scan.where("shingle is null").select("rid", "doc_id", "n", "digest", "key", "parity")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("rep")
    sets = rows.where("n > 0").groupBy("digest").agg(first, F.first("n").alias("n"), F.first("key").alias("key"), F.first("parity").alias("parity"))
    sets = materialize(sets.withColumn("id", F.monotonically_increasing_id()), "jaccard-sets")

    short = materialize(base.select("text").mapInArrow(_short_lists(levels, width, percent), "shingle long, key long").distinct(), "jaccard-short")
    shared = short.groupBy("shingle").agg(F.count("*").alias("d")).where("d > 1")
    lists = short.join(shared, "shingle").join(sets.select("key", "id", "n"), "key").select("shingle", "d", "id", "n")
    lists = materialize(lists, "jaccard-lists")
    discard(short)
    if lists.isEmpty():
        return rows, sets, None

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``; texts are read again for the sets that these name."""
        named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        needed = materialize(named.join(sets.select("id", F.col("rep.rid").alias(RID)), "id"), "jaccard-needed")
        texts = join_bounded(base.select(RID, "text"), needed, [RID], "inner").select("id", "text")
        bodies = materialize(texts.mapInArrow(_bodies(levels, width), "id long, body binary"), "jaccard-bodies")
        a, b = (bodies.select(F.col("id").alias(x), F.col("body").alias(f"body_{x}")) for x in "ab")
        links = materialize(pairs.join(a, "a").join(b, "b").mapInArrow(_probe(percent), "a long, b long"), "jaccard-links")
        discard(bodies)
        return links

    hot = lists.where(F.col("d") > list_limit)
    labels = None if hot.isEmpty() else _family_labels(hot.join(sets.select("id", "parity"), "id"), verified, percent, list_limit)
    cold = lists.where(F.col("d") <= list_limit)
    members = F.sort_array(F.collect_list(F.struct("n", "id")))  # at most ``list_limit``
    queries = cold.groupBy("shingle").agg(members.alias("members")).select("members", F.explode("members").alias("q")).select("q.n", "q.id", "members")
    pairs = queries.repartition("id").sortWithinPartitions("n", "id").mapInArrow(_merge(percent), "a long, b long")
    if labels is not None:  # those connected already need no probe
        a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
        pairs = pairs.join(a, "a", "left").join(b, "b", "left").where("label_a is null or label_b is null or label_a != label_b").select("a", "b")
    links = verified(materialize(pairs, "jaccard-pairs"))
    if labels is not None:
        links = links.unionByName(labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    return rows, sets, links


def jaccard_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per document: rid, doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    rows, sets, links = jaccard_links(docs, width, percent, list_limit)
    if links is None:
        tops = sets.select("digest", F.col("rep.doc_id").alias("component_id"))
    else:
        labels = components(links)
        named = sets.join(labels, sets["id"] == labels["node"], "left").select("digest", "rep", F.coalesce("label", "id").alias("label"))
        tops = named.join(named.groupBy("label").agg(F.min("rep.z").alias("z"), F.min("rep.doc_id").alias("component_id")), "label").select("digest", "component_id")
    # Written out, so that the join has a plain exchange on both sides and Spark may split a hot set.
    tops = materialize(tops, "jaccard-tops")
    out = rows.join(tops, "digest", "left")
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
