"""Exact dedup by a Golomb-coded fingerprint exchange.

Every partition reduces its texts to short fingerprints, sorts them and sends each owner (a range of fingerprint
values) one Golomb-Rice coded message of its distinct values. Owners answer with a bitmap per message: which values
also came from elsewhere. Rows behind a set bit, and rows repeated inside their partition, are suspects; only the
texts of suspects are shuffled, and grouped by their bytes.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; null is empty. Of equal texts the row
with the most code points in its original text stays, then the smallest doc_id (null last), then the first row. An
empty table gives an empty result. Rows with equal or null doc_id are still separate rows. Other columns are ignored.
Texts are read a second time by the hash of (doc_id, text) that the first reading wrote, so it does not matter how the
second reading is split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import RID, as_table, column, join_bounded, materialize, pick, shuffle_partitions, slices, small_batches, strings, text_or_empty, without_rows

BLANK = b" \t\n\x0b\x0c\r"
FP_BITS = 48
BLOCK_ROWS, OWNER_ROWS = 1 << 20, 1 << 22


def rice_encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Sorted distinct values below ``span`` as Rice parameter and bits: unary quotients of the gaps, then remainders."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.floor(np.log2(max(1.0, 0.69 * span / max(1, len(values)))))))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, k: int, payload: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(payload, np.uint8))
    rest_bytes = (n * k + 7) // 8
    unary = bits[: len(bits) - 8 * rest_bytes]
    quotients = np.diff(np.flatnonzero(unary)[:n], prepend=-1) - 1
    rest = bits[len(bits) - 8 * rest_bytes :][: n * k].reshape(n, k).astype(np.uint64)
    low = (rest << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


_SCAN = pa.schema([("kind", pa.int8()), ("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("payload", pa.binary()), ("rid", pa.struct([("file", pa.int64()), ("row", pa.int64())])), ("key", pa.int64()), ("doc_id", pa.int64()), ("points", pa.int64()), ("sha", pa.binary())])
_SCAN_SQL = "kind byte, block long, owner int, n int, k int, payload binary, rid struct<file:long,row:long>, key long, doc_id long, points long, sha binary"
ROW, PACKED, MESSAGE = 0, 1, 2


def _fill(rows: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given[f.name] if isinstance(given.get(f.name), pa.Array) else pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in _SCAN], schema=_SCAN)


def _scan(owner_bits: int, class_bytes: int):
    """Rows, and for each block of them its fingerprint order and its messages."""
    span = 1 << (FP_BITS - owner_bits)

    def flush(block, keys, fps):
        keys, fps = np.concatenate(keys), np.concatenate(fps)
        order = np.argsort(fps, kind="stable")
        values, counts = np.unique(fps, return_counts=True)
        owners = (values >> np.uint64(FP_BITS - owner_bits)).astype(np.int64)
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        packed = counts.astype("<i4").tobytes() + keys[order].astype("<i8").tobytes()
        yield _fill(1, kind=[PACKED], block=[block], n=[len(values)], payload=[packed])
        out = {"kind": [], "block": [], "owner": [], "n": [], "k": [], "payload": []}
        for lo, hi in zip(starts, [*starts[1:], len(values)]):
            k, bits = rice_encode(values[lo:hi] & np.uint64(span - 1), span)
            for name, x in zip(out, (MESSAGE, block, int(owners[lo]), int(hi - lo), k, bits)):
                out[name].append(x)
        yield _fill(len(out["n"]), **out)

    def run(batches):
        keys, fps, held, block = [], [], 0, TaskContext.get().partitionId() << 32
        for b in slices(batches, "text"):
            texts = strings(b, "text")
            shas = [hashlib.sha256(t.as_buffer().to_pybytes().translate(None, BLANK)).digest() for t in texts.cast(pa.binary())]
            yield _fill(len(b), kind=np.full(len(b), ROW, np.int8), rid=column(b, RID).cast(_SCAN.field("rid").type), key=column(b, "key"), doc_id=column(b, "doc_id").cast(pa.int64()), points=pc.utf8_length(texts).cast(pa.int64()), sha=shas)
            keys.append(column(b, "key").to_numpy(zero_copy_only=False))
            heads = b"".join(s[: min(8, class_bytes)].ljust(8, b"\0") for s in shas)
            fps.append(np.frombuffer(heads, ">u8").astype(np.uint64) >> np.uint64(64 - FP_BITS))
            held += len(b)
            if held >= BLOCK_ROWS:
                yield from flush(block, keys, fps)
                keys, fps, held, block = [], [], 0, block + 1
        if held:
            yield from flush(block, keys, fps)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One owner: a bitmap for each message, set where another message has the value too."""
    sent = [rice_decode(n, k, p) for n, k, p in zip(pdf["n"], pdf["k"], pdf["payload"])]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    twice = values[counts > 1]
    return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "n": pdf["n"], "bitmap": [np.packbits(np.isin(v, twice)).tobytes() for v in sent]})


def _suspects(batches):
    """Keys of the rows of a block behind a set bit or repeated in the block."""
    for b in batches:
        for row in b.to_pylist():
            n = row["n"]
            counts = np.frombuffer(row["payload"], "<i4", n)
            keys = np.frombuffer(row["payload"], "<i8", offset=4 * n)
            bits = [np.unpackbits(np.frombuffer(x["bitmap"], np.uint8))[: x["n"]] for x in sorted(row["bitmaps"], key=lambda x: x["owner"])]
            yield pa.RecordBatch.from_arrays([pa.array(keys[np.repeat((np.concatenate(bits) > 0) | (counts > 1), counts)])], names=["key"])


def exact_groups(docs: DataFrame, owners: int | None = None, class_bytes: int = 32) -> DataFrame:
    """One row per document: rid, doc_id, keep_id, group_size, kept, text_sha256.

    ``owners``: number of fingerprint ranges (a power of two; if not given, four per shuffle partition and no more
    than about ``OWNER_ROWS`` rows in each).
    ``class_bytes``: bytes of the digest that name a class before the bytes of the texts decide.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = as_table(docs)
    total = docs.count()
    bits = int(owners or max(4 * shuffle_partitions(spark), 2 * total // OWNER_ROWS)).bit_length() - 1
    base = pick(docs, "doc_id", "text", rid=True).withColumn("key", F.xxhash64("doc_id", "text"))
    scan = materialize(base.mapInArrow(_scan(bits, class_bytes), _SCAN_SQL), "dedup-scan")
    rows = scan.where(f"kind = {ROW}").select("rid", "key", "doc_id", "points", "sha", F.substring("sha", 1, class_bytes).alias("class"))
    answers = scan.where(f"kind = {MESSAGE}").select("block", "owner", "n", "k", "payload").groupBy("owner").applyInPandas(_answer, "block long, owner int, n int, bitmap binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "n", "bitmap")).alias("bitmaps"))
    packed = scan.where(f"kind = {PACKED}").select("block", "n", "payload").join(answers, "block")
    suspects = materialize(packed.mapInArrow(_suspects, "key long"), "dedup-suspects", total)
    n_suspects = suspects.count()

    # The texts of suspects travel once for each task that holds them; equal bytes combine before the shuffle.
    norm = text_or_empty()
    for c in BLANK.decode():
        norm = F.replace(norm, F.lit(c), F.lit(""))
    texts = join_bounded(base, suspects, ["key"], "left_semi").select(RID, norm.alias("norm"))
    texts = texts.withColumn("class", F.substring(F.unhex(F.sha2("norm", 256)), 1, class_bytes))
    versions = texts.groupBy("class", "norm").agg(F.count("*").alias("n")).groupBy("class").agg(F.count("*").alias("versions"))
    clashes = materialize(versions.where("versions > 1").select("class"), "dedup-clashes", n_suspects)
    if not clashes.isEmpty():  # different texts with one digest: their own bytes name the classes
        exact = join_bounded(texts, clashes, ["class"], "left_semi").select(F.col(RID).alias("rid"), F.concat("class", F.encode("norm", "UTF-8")).alias("exact"))
        rows = rows.join(exact, "rid", "left").withColumn("class", F.coalesce("exact", "class")).drop("exact")

    flagged = join_bounded(rows, suspects, ["key"], "left_semi")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("best")
    # Written out, so that the join below has a plain exchange on both sides and Spark may split a hot class.
    groups = materialize(flagged.groupBy("class").agg(best, F.count("*").alias("group_size")), "dedup-groups", n_suspects)
    return rows.join(groups, "class", "left").select(
        "rid",
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies of texts that stay, all columns as they were."""
    docs = as_table(docs)
    dropped = materialize(exact_groups(docs).where("not kept").select(F.col("rid").alias(RID)), "dedup-dropped", docs.count())
    return without_rows(docs, dropped)
