"""Ranked lexical search with Block-Max MaxScore over document shards.

The index is built by document shards: each task turns about ``SHARD_BYTES`` of whole texts into inverted lists in
ascending doc_id order, cut into blocks of ``BLOCK`` postings. A block's header, which stays uncompressed, has its last
document, its highest impact and the widths of its byte-packed gaps and term frequencies. Impacts are what a posting
adds to a score apart from the term's weight; they need the number of documents and terms of the whole table, which
one aggregate gives before.

A query looks at a shard window by window of documents. The highest impacts of its lists, times their weights, sorted,
part them into essential lists, and others that together cannot lift a document over the lowest score of the full
heap. Candidates come from essential lists alone. For the others, the bounds of the blocks in which the candidates
would stand reject most of them before a block is decompressed. Each shard gives the heap of each query; Spark merges
them by rank.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. Null and
empty texts have none, count neither as documents nor in lengths, and are in no result; queries without terms, or with
terms that no document has, have no result rows. Equal scores go by ascending doc_id, null last. Rows with equal or
null ids are separate documents and separate queries. An empty table on either side gives an empty result. Texts of any
length are whole; a text over ``SHARD_BYTES`` is a shard by itself. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import column, give_back, join_bounded, materialize, pick, raw_bytes, shuffle_partitions, slices, small_batches, split_words, strings

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP, BLOCK, SHARD_BYTES = 10, 128, 24 << 20
QUERY_BLOCK = 512
FIRST_WINDOW, WINDOW = 512, 2048

#: Bytes of terms as they are or in lower case, all others as a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_HEAD = np.dtype([("last", "<u4"), ("top", "<u4"), ("at", "<u4"), ("n", "<u2"), ("gap", "u1"), ("tf", "u1")])


def folded_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The index of its text for each term, and the terms."""
    data, offsets = raw_bytes(texts)
    kept = _FOLD[data]
    return split_words(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept)))


def _count(batches):
    for b in slices(batches, "text"):
        data, offsets = raw_bytes(strings(b, "text"))
        kept = _FOLD[data] != 32
        begins = kept.copy()
        begins[1:] &= ~kept[:-1]
        full = offsets[:-1][np.diff(offsets) > 0]
        begins[full] = kept[full]  # a text's first character follows no other
        upto = np.append(0, np.cumsum(begins))
        n = upto[offsets[1:]] - upto[offsets[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "terms"])


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    small_batches(docs.sparkSession)
    row = pick(docs, "text").mapInArrow(_count, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


# --- the index --------------------------------------------------------------------------------------------------


def damping(n, documents: int, terms: int):
    """m of documents of ``n`` terms."""
    return 100 - 75 + 75 * np.asarray(n, np.int64) * documents // max(1, terms)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _widths(blocks_max: np.ndarray) -> np.ndarray:
    return np.where(blocks_max < 1 << 8, 1, np.where(blocks_max < 1 << 16, 2, 4)).astype(np.uint8)


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        wide = width > k
        out[at[wide] + k] = (values[wide] >> (8 * k)) & 255


def pack_lists(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings sorted by (term, doc) as compressed lists: first posting, headers and payload and the bounds of both for each term."""
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(starts, append=len(term))
    inside = np.arange(len(term)) - np.repeat(starts, sizes)
    first = np.flatnonzero(inside % BLOCK == 0)  # of each block
    count = np.diff(first, append=len(term))
    gaps = np.diff(doc, prepend=0) - 1
    gaps[starts] = doc[starts]
    head = np.zeros(len(first), _HEAD)
    head["n"], head["last"] = count, doc[first + count - 1]
    head["top"] = np.maximum.reduceat(impacts(tf, m[doc]), first)
    head["gap"], head["tf"] = _widths(np.maximum.reduceat(gaps, first)), _widths(np.maximum.reduceat(tf, first))
    size = count * (head["gap"].astype(np.int64) + head["tf"])
    ends = np.cumsum(size)
    block_of = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(term)) - first[block_of]
    out = np.zeros(int(ends[-1]), np.uint8)
    gap_at = (ends - size)[block_of] + nth * head["gap"][block_of]
    _put(out, gap_at, gaps, head["gap"][block_of])
    tf_at = (ends - size + count * head["gap"])[block_of] + nth * head["tf"][block_of]
    _put(out, tf_at, tf, head["tf"][block_of])
    list_block = block_of[starts]  # the first block of each list
    payload_at = (ends - size)[list_block]
    head["at"] = (ends - size) - np.repeat(payload_at, np.diff(list_block, append=len(first)))
    return starts, sizes, head, np.append(list_block, len(first)), out, np.append(payload_at, len(out))


_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("head", pa.binary()), ("payload", pa.binary())])
_INDEX_SQL = "shard long, term string, df long, head binary, payload binary"


def _cut(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _build(documents: int, terms: int, shard_bytes: int):
    """Rows of one shard: one without a term for its documents (ids, then m), one for each term."""

    class Shard:
        def __init__(self):
            self.codes: dict[str, int] = {}
            self.ids, self.known, self.lengths, self.postings, self.docs, self.bytes = [], [], [], [], 0, 0

        def add(self, b):
            texts = strings(b, "text")
            parent, found = folded_terms(texts.cast(pa.string()))
            self.bytes += int(pc.sum(pc.binary_length(texts)).as_py() or 0)
            if not len(found):
                return
            coded = found.dictionary_encode()
            known = self.codes
            code = np.fromiter((known.setdefault(t, len(known)) for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            key, tf = np.unique(parent << 32 | code[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
            length = np.bincount(parent, minlength=len(b))
            full = np.flatnonzero(length)  # only documents with terms
            place = np.zeros(len(b), np.int64)
            place[full] = self.docs + np.arange(len(full))
            ids = column(b, "doc_id").cast(pa.int64()).take(pa.array(full))
            self.ids.append(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
            self.known.append(pc.is_valid(ids).to_numpy(zero_copy_only=False))
            self.lengths.append(length[full])
            self.postings.append(((key & 0xFFFFFFFF).astype(np.int32), place[key >> 32].astype(np.int32), tf.astype(np.int32)))
            self.docs += len(full)

        def rows(self, shard):
            if not self.docs:
                return
            ids, known, n = (np.concatenate(x) for x in (self.ids, self.known, self.lengths))
            order = np.lexsort((np.arange(len(ids)), ids, ~known))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            m = damping(n[order], documents, terms)
            term, doc, tf = (np.concatenate(x) for x in zip(*self.postings))
            self.postings = []
            doc = rank[doc]
            by = np.argsort(term.astype(np.int64) << 32 | doc)
            starts, sizes, head, head_at, payload, payload_at = pack_lists(term[by], doc[by], tf[by].astype(np.int64), m)
            names = pa.array(list(self.codes), pa.string())  # in the order of their codes, each with a posting
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), pa.array([len(ids)]), pa.array([ids[order].astype("<i8").tobytes() + known[order].tobytes()]), pa.array([m.astype("<i8").tobytes()])], schema=_INDEX)
            heads = _cut(head.view(np.uint8), head_at * _HEAD.itemsize)
            lists = [pa.array(np.full(len(names), shard)), names, pa.array(sizes.astype(np.int64)), heads, _cut(payload, payload_at)]
            for lo in range(0, len(names), 8192):
                yield pa.RecordBatch.from_arrays([x.slice(lo, 8192) for x in lists], schema=_INDEX)

    def run(batches):
        shard, name = Shard(), TaskContext.get().partitionId() << 24
        for b in slices(batches, "text"):
            shard.add(b)
            if shard.bytes >= shard_bytes:
                yield from shard.rows(name)
                shard, name = Shard(), name + 1
                give_back()
        yield from shard.rows(name)
        give_back()

    return run


def build_index(docs: DataFrame, size: tuple[int, int], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index of ``docs`` of ``corpus_size``: shard, term (null: its documents), df, head, payload."""
    small_batches(docs.sparkSession)
    base = pick(docs, "doc_id", "text").where("length(text) > 0")
    return materialize(base.mapInArrow(_build(*size, shard_bytes), _INDEX_SQL), "lexical-index")


# --- the search -------------------------------------------------------------------------------------------------


class Postings:
    """One list: blocks are decompressed when they are first needed."""

    def __init__(self, head: bytes, payload: bytes, m: np.ndarray):
        self.head, self.payload, self.m = np.frombuffer(head, _HEAD), payload, m
        self.last, self.tops = self.head["last"].astype(np.int64), self.head["top"].astype(np.int64)
        self.top = int(self.tops.max())
        count = self.head["n"].astype(np.int64)
        self.first = np.cumsum(count) - count
        #: Documents; all of a block are its last one until it is decompressed, which keeps the order.
        self.docs, self.gain = np.repeat(self.last, count), np.zeros(int(count.sum()), np.int64)
        self.open = np.zeros(len(self.head), bool)

    def need(self, blocks) -> None:
        for i in blocks:
            if self.open[i]:
                continue
            self.open[i] = True
            last, _, at, n, gap, tf = self.head[i].item()
            gaps = np.frombuffer(self.payload, f"<u{gap}", n, at).astype(np.int64)
            tfs = np.frombuffer(self.payload, f"<u{tf}", n, at + n * gap).astype(np.int64)
            lo = int(self.first[i])
            docs = np.cumsum(gaps + 1) + (int(self.last[i - 1]) if i else -1)
            self.docs[lo : lo + n], self.gain[lo : lo + n] = docs, impacts(tfs, self.m[docs])

    def span(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from lo to below hi and their impacts."""
        a, b = np.searchsorted(self.last, (lo, hi - 1))
        self.need(range(int(a), min(int(b) + 1, len(self.last))))
        x, y = np.searchsorted(self.docs, (lo, hi))
        return self.docs[x:y], self.gain[x:y]


def best_of_shard(lists: list[tuple[int, Postings]], docs: int, top: int, stop_early: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``top`` highest scores above 0; ``lists``: weights with postings."""
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: -x[0] * x[1].top)
    bounds = [w * p.top for w, p in lists]
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0) if bounds else np.zeros(1, np.int64)
    won, score, bar, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    while lo < docs and lists:
        hi = min(docs, lo + (WINDOW if lo else FIRST_WINDOW))
        # Lists from ``split`` on are not essential: together they cannot pass the bar.
        split = int(np.argmax(rest <= bar)) if stop_early else len(lists)
        if split == 0:
            break
        sums = np.zeros(hi - lo, np.int64)
        for w, p in lists[:split]:
            at, gain = p.span(lo, hi)
            sums[at - lo] += w * gain
        doc = np.flatnonzero((sums > 0) & (sums + rest[split] > bar))
        have = sums[doc]
        doc += lo
        for i in range(split, len(lists)):
            if not len(doc):
                break
            w, p = lists[i]
            block = np.searchsorted(p.last, doc)
            inside = block < len(p.last)
            bound = np.where(inside, w * p.tops[np.minimum(block, len(p.last) - 1)], 0)
            keep = have + bound + rest[i + 1] > bar
            doc, have, block, inside = doc[keep], have[keep], block[keep], inside[keep]
            p.need(np.unique(block[inside]).tolist())
            at = np.minimum(np.searchsorted(p.docs, doc), len(p.docs) - 1)
            have = have + np.where(p.docs[at] == doc, w * p.gain[at], 0)
        good = have > bar
        won, score = np.concatenate([won, doc[good]]), np.concatenate([score, have[good]])
        order = np.lexsort((won, -score))[:top]
        won, score = won[order], score[order]
        bar = int(score[-1]) if len(score) == top else 0
        lo = hi
    return won, score


def _search(top: int):
    """Rows sorted by (shard, queries, term), the shard's documents first: the heap of each query."""

    def group(rows):
        ids, known, m, lists, wants = None, None, None, {}, {}
        for r in rows:
            if r["term"] is None:
                n = r["df"]
                ids, known, m = np.frombuffer(r["head"], "<i8", n), np.frombuffer(r["head"], bool, n, 8 * n), np.frombuffer(r["payload"], "<i8")
                continue
            lists[r["term"]] = Postings(r["head"], r["payload"], m)
            for want in r["wants"]:
                wants.setdefault(want["query"], []).append((want["times"] * r["weight"], r["term"]))
        out = []
        for query, of in wants.items():
            doc, score = best_of_shard([(w, lists[t]) for w, t in of], len(m), top)
            out += [(query, int(ids[d]) if known[d] else None, int(s), rows[0]["shard"], int(d)) for d, s in zip(doc.tolist(), score.tolist())]
        return out

    def run(batches):
        key, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if (r["shard"], r["part"]) != key:
                    if rows:
                        yield batch(group(rows))
                    key, rows = (r["shard"], r["part"]), []
                rows.append(r)
        if rows:
            yield batch(group(rows))
        give_back()

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 5, names=["query", "doc_id", "score", "shard", "place"])

    return run


def weight(documents: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * documents + 2)) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


def search(index: DataFrame, documents: int, items: DataFrame, top: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item (item_id, text) in an index of so many documents."""
    spark = items.sparkSession
    asked = materialize(pick(items, "item_id", "text").withColumn("query", F.monotonically_increasing_id()), "lexical-queries")
    parts = max(1, -(-asked.count() // query_block))
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    wanted = asked.select("query", F.explode(words).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
    wanted = materialize(wanted.groupBy("part", "term").agg(F.collect_list(F.struct("query", "times")).alias("wants")), "lexical-terms")
    terms = wanted.select("term").distinct()
    lists = index.where("term is not null")
    counts = join_bounded(lists.select("term", "df"), terms, ["term"], "left_semi").groupBy("term").agg(F.sum("df").alias("total"))
    weighed = materialize(wanted.join(counts, "term").withColumn("weight", weight(documents, F.col("total"))).drop("total"), "lexical-weights")
    met = join_bounded(lists, weighed, ["term"], "inner", 100_000).select("shard", "part", "term", "df", "head", "payload", "wants", "weight")
    every = index.where("term is null").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    rows = met.unionByName(every.select(*index.columns, "part"), allowMissingColumns=True)
    tasks = max(shuffle_partitions(spark), parts)
    dealt = rows.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", F.col("term").asc_nulls_first())
    heaps = dealt.mapInArrow(_search(top), "query long, doc_id long, score long, shard long, place long")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "shard", "place")
    best = heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Index ``docs`` (doc_id, text) and rank them for each of ``items`` (item_id, text)."""
    size = corpus_size(docs)
    return search(build_index(docs, size, shard_bytes), size[0], items, top)
