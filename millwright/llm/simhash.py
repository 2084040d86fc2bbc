"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints are 64 bits over 4-word shingles. Bit position i carries a vector m(i) of r + 1 bits; for each of the
2^(r+1) - 1 nonzero vectors v one table keeps the positions whose m(i) has an odd product with v. For any r or fewer
differing positions some v is orthogonal to all of them, so every pair within radius r agrees on the kept bits of
some table: no link is missed. Copies collapse to one row per distinct fingerprint first, and a bucket yields a
spanning forest of its links, never all pairs. A bucket over ``bucket_limit`` is spread by a second covering of the
bits its table leaves free, which are few enough to bound the sub-buckets.

Null text counts as empty; texts without words have fingerprint zero, linked like any other. Texts of one to three
words use their whole word sequence as the only shingle. Null doc_ids never name a component unless it has no other.
Repeated rows, ties and other columns are harmless; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import RID, as_table, column, discard, materialize, pick, raw_bytes, slices, small_batches, split_words, strings, without_rows

RADIUS = 4
BUCKET_LIMIT = 65_536


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit positions; the vectors cycle through all nonzero values, so halves are balanced."""
    width = radius + 1
    vector = {b: 1 + i % ((1 << width) - 1) for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, 1 << width)]


def _fingerprints(batches):
    from xxhash import xxh64_intdigest as xxh

    for b in slices(batches, "text"):
        texts = pc.ascii_lower(strings(b, "text"))
        parent, words = split_words(texts)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py() if len(words) else ""
        data = joined.encode()
        _, offsets = raw_bytes(words)
        start = (offsets[:-1] + np.arange(len(words))).tolist()
        end = (offsets[1:] + np.arange(len(words))).tolist()
        first = np.searchsorted(parent, np.arange(len(b) + 1)).tolist()
        out = np.zeros(len(b), np.uint64)
        for i in range(len(b)):
            lo, hi = first[i], first[i + 1]
            if lo == hi:
                continue
            last = max(lo + 1, hi - 3)
            reach = 3 if hi - lo > 3 else hi - lo - 1
            h = np.fromiter((xxh(data[s:e], 42) for s, e in zip(start[lo:last], end[lo + reach : last + reach])), np.uint64, last - lo)
            ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0]
        yield pa.RecordBatch.from_arrays([column(b, RID), column(b, "doc_id").cast(pa.int64()), pa.array(out.view(np.int64))], names=["rid", "doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """rid, doc_id and the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    base = pick(docs, "doc_id", "text", rid=True)
    return base.mapInArrow(_fingerprints, f"rid {base.schema[RID].dataType.simpleString()}, doc_id long, fp long")


def _forest(values: np.ndarray, earlier: np.ndarray, radius: int):
    """Spanning forest of the links within ``radius`` that no earlier table shows; each value is expanded once."""
    left, src, dst = values, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            diff = left ^ x
            near = np.bitwise_count(diff) <= radius
            if near.any():
                at = np.flatnonzero(near)
                for m in earlier:
                    at = at[(diff[at] & m) != 0]
                near[:] = False
                near[at] = True
                new = left[near]
                src += [x] * len(new)
                dst += new.tolist()
                queue += new.tolist()
                left = left[~near]
    return np.array(src, np.uint64), np.array(dst, np.uint64)


def _link(masks: list[int], radius: int, limit: int):
    """Sorted rows (bucket, table, key, fp) to link rows; a bucket over ``limit`` gives its rows back as overflow."""

    def emit(src, dst, bucket=None, table=None, over=False):
        n = len(src)
        full = lambda v, t: pa.array(np.full(n, v), t) if v is not None else pa.nulls(n, t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, over)), full(bucket, pa.int64()), full(table, pa.int32()), pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["over", "bucket", "table", "a", "b"])

    def whole(bucket, table, key, fps, spilled):
        """A finished run."""
        if spilled:
            if len(fps):
                yield emit(fps, np.full(len(fps), key, np.uint64), bucket, table, True)
        elif len(fps) > 1:
            src, dst = _forest(fps, np.array(masks[:table], np.uint64), radius)
            if len(src):
                yield emit(src, dst)

    def run(batches):
        held, head, spilled = np.zeros(0, np.uint64), None, False
        for b in batches:
            if not b.num_rows:
                continue
            bucket, table = (column(b, c).to_numpy(zero_copy_only=False) for c in ("bucket", "table"))
            key, fps = (column(b, c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp"))
            fresh = np.ones(len(fps), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1])
            starts = np.flatnonzero(fresh)
            stops = np.append(starts[1:], len(fps))
            first = (int(bucket[0]), int(table[0]), int(key[0]))
            if head == first:  # goes on from the batch before
                held = np.concatenate([held, fps[: stops[0]]])
                if len(held) > limit:
                    yield emit(held, np.full(len(held), head[2], np.uint64), head[0], head[1], True)
                    held, spilled = held[:0], True
                starts, stops = starts[1:], stops[1:]
                if not len(starts):
                    continue
            if head is not None:
                yield from whole(*head, held, spilled)
            # runs of two, by far the most frequent, at once
            size = stops - starts
            two = starts[:-1][size[:-1] == 2]
            diff = fps[two] ^ fps[two + 1]
            ok = np.bitwise_count(diff) <= radius
            for t, m in enumerate(masks):
                ok &= ((diff & np.uint64(m)) != 0) | (table[two] <= t)
            if ok.any():
                yield emit(fps[two[ok]], fps[two[ok] + 1])
            for i in np.flatnonzero(size[:-1] > 2):
                lo, hi = starts[i], stops[i]
                yield from whole(int(bucket[lo]), int(table[lo]), int(key[lo]), fps[lo:hi], hi - lo > limit)
            lo = starts[-1]
            head, held, spilled = (int(bucket[lo]), int(table[lo]), int(key[lo])), fps[lo:].copy(), False
        if head is not None:
            yield from whole(*head, held, spilled or len(held) > limit)

    return run


_LINKS = "over boolean, bucket long, table int, a long, b long"


def _tables(rows: DataFrame, masks: list[int], radius: int, limit: int) -> DataFrame:
    """``masks`` (of the first level): a link shows only in the first table that has it."""
    dealt = rows.repartition("bucket", "table", "key").sortWithinPartitions("bucket", "table", "key", "fp")
    return materialize(dealt.mapInArrow(_link(masks, radius, limit), _LINKS), "simhash-links")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that connect all pairs within ``radius``."""
    masks = covering_masks(radius, list(range(64)))
    deal = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]))
    first = _tables(fps.select("fp", deal.alias("t")).select(F.lit(0).cast("long").alias("bucket"), "t.table", "t.key", "fp"), masks, radius, bucket_limit)
    found = first.where("not over").select("a", "b")
    over = first.where("over")
    if over.isEmpty():
        return found
    # A second covering of the bits that the first table leaves free.
    free = [covering_masks(radius, [b for b in range(64) if not m >> b & 1]) for m in masks]
    per_table = F.array(*[F.array(*[F.lit(signed(x)) for x in sub]) for sub in free])
    spread = over.select(F.col("table").cast("long").alias("bucket"), F.col("a").alias("fp"), "b", F.posexplode(F.element_at(per_table, F.col("table") + 1)).alias("table", "mask"))
    # The outer key stays part of the key: its bits are disjoint from those of the inner mask.
    second = spread.select("bucket", "table", F.col("fp").bitwiseAND(F.col("mask")).bitwiseOR(F.col("b")).alias("key"), "fp")
    return found.unionByName(_tables(second, [], radius, 1 << 62).where("not over").select("a", "b"))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, label: the smallest node of its connected component, for each node that has an edge.

    Each round takes the smallest label around a node and then the label of that label, so that chains shorten by
    half; labels are written out between rounds.
    """
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "cc-edges", 2 * edges.count())
    most = both.count()
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "cc-labels", most)
    before = labels
    for _ in range(max_rounds):
        near = both.join(labels, both["v"] == labels["node"]).select(F.col("u").alias("node"), "label")
        best = near.union(labels).groupBy("node").agg(F.min("label").alias("seen"))
        hop = labels.select(F.col("node").alias("seen"), F.col("label").alias("hop"))
        step = best.join(hop, "seen", "left").select("node", F.least("seen", "hop").alias("label"))
        moved = materialize(step.join(labels.withColumnRenamed("label", "was"), "node").select("node", "label", (F.col("label") != F.col("was")).alias("moved")), "cc-labels", most)
        discard(before)
        before, labels = moved, moved.select("node", "label")
        if moved.where("moved").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def near_groups(docs: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: rid, doc_id, fingerprint (hex), component_id, first (its row stays)."""
    rows = materialize(fingerprints(docs), "simhash-fp")
    key = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid"))
    total = rows.count()
    distinct = materialize(rows.groupBy("fp").agg(key.alias("rep")), "simhash-distinct", total)
    labels = components(links(distinct.select("fp"), radius, bucket_limit))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    tops = named.groupBy("label").agg(F.min("rep").alias("top"))
    # Written out, so that the join has a plain exchange on both sides and Spark may split a hot fingerprint.
    named = materialize(named.join(tops, "label").select("fp", "top"), "simhash-named", total)
    return rows.join(named, "fp").select("rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("top.doc_id").alias("component_id"), (F.col("top.rid") == F.col("rid")).alias("first"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document (smallest doc_id) of each component, all columns as they were."""
    docs = as_table(docs)
    dropped = materialize(near_groups(docs).where("not first").select(F.col("rid").alias(RID)), "simhash-dropped", docs.count())
    return without_rows(docs, dropped)
