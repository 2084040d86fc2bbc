"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Each source's documents, in seeded random order, form a stream of words that repeats; the stream is cut into blocks
of equal length. Slot j of the mix maps the golden-ratio point frac(j * phi) through the cumulative targets to a
source; the r-th slot of a source takes its r-th block, up to the source's target. A source whose target is too small
for a slot of its own gets its first block, up to its target, with ``every_source`` (as the query and the pipeline
have it), and nothing without. Targets share the total by weight, none above ``max_repeat``
times its source, the excess going to the others by weight until none is above.

Sources sort by code point, null last, and weigh 1, 2, 3 repeating. Null text has size 0; such documents, and sources
without words, are taken 0 times. Rows with equal or null doc_id are separate. Reruns agree. An empty table gives an
empty result. Other columns are ignored by ``mix`` and kept by ``mixed_documents``. Input that is not read from Parquet files is
written out first where it is read twice.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import RID, WORD, as_table, materialize, pick, prefix_offsets, row_id, word_count

SEED, BLOCK_WORDS, WEIGHTS, MAX_REPEAT = 71, 128, (1, 2, 3), 3
GOLDEN = 11_400_714_819_323_198_485  # 2^64 / phi
CELLS = 1024
RANGE_ROWS = 1024


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """src, source, source_size, weight, target, from rows (source, source_size): one row for each source."""
    order = W.orderBy(F.col("source").isNull(), "source")  # one row per source
    ranked = sources.withColumn("src", F.row_number().over(order))
    ranked = materialize(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1)), "mix-sources", 0)
    total, level, capped = None, 0.0, -1
    cap = F.col("source_size") * max_repeat
    while True:
        over = F.col("weight") * F.lit(level) > cap
        row = ranked.agg(F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        total = row[0] or 0
        if row[3] == capped:
            break
        capped, level = row[3], (total - (row[1] or 0)) / row[2] if row[2] else level
    return ranked.withColumn("target", F.when(F.col("weight") * F.lit(level) > cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def schedule(plan: DataFrame, total: int, block: int) -> DataFrame:
    """src, block: the slots of the mix, each with the number of its slot within the source."""
    spark = plan.sparkSession
    slots = round(total / block) if total else 0
    slots = max(slots, 1 if total else 0)
    below = W.orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    spans = plan.where("target > 0").withColumn("lo", F.coalesce(F.sum("target").over(below), F.lit(0.0)) / F.lit(float(max(1, total))))
    nxt = F.lead("lo").over(W.orderBy("src"))
    spans = spans.select("src", "lo", F.coalesce(nxt, F.lit(2.0)).alias("hi"))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least("hi", F.lit(1.0)) * CELLS))))
    turn = F.pmod(F.col("id").cast("decimal(38,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)"))
    points = spark.range(slots).withColumn("u", turn.cast("double") / F.lit(float(1 << 64)))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    dealt = points.join(cells, "cell").where("u >= lo and u < hi").select("src", "id", F.floor(F.col("id") / 8192).alias("chunk"))
    counts = dealt.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    start = prefix_offsets(counts, "chunk", "n", "start", slots // 8192 + 1, by=["src"]).select("src", "chunk", "start")
    inner = F.row_number().over(W.partitionBy("src", "chunk").orderBy("id")) - 1
    return dealt.withColumn("inner", inner).join(start, ["src", "chunk"]).select("src", "id", (F.col("start") + F.col("inner")).alias("block"))


def _prepared(docs: DataFrame, weights, max_repeat, block, seed):
    base = pick(docs, "doc_id", "source", "text", rid=True)
    base = base.select(RID, F.col("doc_id"), "source", word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))
    base = materialize(base, "mix-rows")
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    plan = materialize(plan, "mix-targets", 0)
    rows, total = base.agg(F.count("*"), F.sum("size")).first()
    return base, plan, rows, total or 0


def _taken(base, plan, rows, total, block, range_rows, every_source):
    """rid, pass, taken: words of each pass over a document that scheduled blocks cover."""
    slots = materialize(schedule(plan, total, block).select("src", "block"), "mix-slots", total // block + 1)
    if every_source:
        # A source without a slot has its first block.
        missed = plan.where("target >= 1").join(slots.where("block = 0").select("src"), "src", "left_anti")
        slots = slots.unionByName(materialize(missed.select("src", F.lit(0).cast(slots.schema["block"].dataType).alias("block")), "mix-missed", 0))
    used = slots.groupBy("src").agg((F.max("block") + 1).alias("blocks"))
    stop = F.least(F.col("blocks") * block, F.floor("target"))
    known = plan.join(used, "src").select("src", "source", "source_size", stop.alias("stop"), F.ceil(stop / F.col("source_size")).alias("passes")).where("stop > 0")
    run = base.join(F.broadcast(known) if known.limit(10_001).count() <= 10_000 else known, base["source"].eqNullSafe(known["source"])).where("size > 0").select(RID, "doc_id", "size", "key", "src", "source_size", "stop", "passes")
    # Offsets in a random order of each source: by hash range, then within the range.
    bits = max(0, math.ceil(math.log2(max(1, rows) / range_rows)))
    spread = run.withColumn("range", F.shiftright("key", 64 - bits) + F.lit(1 << (bits - 1)) if bits else F.lit(0).cast("long"))  # from 0, in the order of the signed keys
    sums = spread.groupBy("src", "range").agg(F.sum("size").alias("words"))
    start = prefix_offsets(sums, "range", "words", "start", 1 << bits, by=["src"]).select("src", "range", "start")
    inner = W.partitionBy("src", "range").orderBy("key", "doc_id", RID).rowsBetween(W.unboundedPreceding, -1)
    stream = spread.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(start, ["src", "range"])
    stream = stream.select(RID, "src", "size", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"), "source_size", "stop", (F.col("start") + F.col("inner")).alias("first"))
    stream = stream.withColumn("lo", F.col("first") + F.col("pass") * F.col("source_size"))
    stream = stream.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("stop"))).where("lo < hi")
    pieces = stream.select(RID, "src", "pass", "lo", "hi", "size", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))).alias("block"))
    overlap = F.least("hi", (F.col("block") + 1) * block) - F.greatest(F.col("lo"), F.col("block") * block)
    return pieces.select(RID, "src", "pass", "size", "block", overlap.alias("words")).join(slots.select("src", "block"), ["src", "block"])


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK_WORDS, seed: int = SEED, range_rows: int = RANGE_ROWS, every_source: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    base, plan, rows, total = _prepared(docs, weights, max_repeat, block, seed)
    taken = _taken(base, plan, rows, total, block, range_rows, every_source).groupBy(RID).agg(F.sum("words").alias("taken"))
    known = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = base.join(taken, RID, "left")
    return out.join(known, out["source"].eqNullSafe(known["s"]), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK_WORDS, seed: int = SEED, range_rows: int = RANGE_ROWS, every_source: bool = False) -> DataFrame:
    """``docs`` once for each pass of which the mix takes at least half (the schedule cuts one document a source).

    What a source gives is the beginning of its order, after whole passes. So a row's copies follow from its place
    against the last document of that beginning, one row a source, and texts need no shuffle.
    """
    docs = as_table(docs)
    base, plan, rows, total = _prepared(docs, weights, max_repeat, block, seed)
    passes = _taken(base, plan, rows, total, block, range_rows, every_source).groupBy(RID, "pass").agg(F.sum("words").alias("words"), F.first("size").alias("size"))
    copies = materialize(passes.where("2 * words >= size").groupBy(RID).agg(F.count("*").alias("copies")), "mix-copies", rows)
    counted = materialize(base.where("size > 0").join(copies, RID, "left").select("source", F.struct("key", "doc_id", RID).alias("place"), F.coalesce("copies", F.lit(0)).alias("copies")), "mix-counted", rows)
    ends = counted.groupBy("source").agg(F.min("copies").alias("whole"), F.max(F.struct("copies", "place")).alias("end"))
    ends = materialize(ends.select(F.col("source").alias("__mw_source"), "whole", F.when(F.col("end.copies") > F.col("whole"), F.col("end.place")).alias("end")), "mix-ends", 0)
    ends = F.broadcast(ends) if ends.count() <= 10_000 else ends
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "source", "text")}
    bare = docs.toDF(*names)
    bare = bare.select(row_id(bare).alias(RID), *names)
    placed = bare.where(F.coalesce(F.col(at["text"]).rlike(WORD), F.lit(False))).join(ends, F.col(at["source"]).eqNullSafe(F.col("__mw_source")))
    place = F.struct(F.xxhash64(F.lit(seed), at["doc_id"], at["text"]).alias("key"), F.col(at["doc_id"]).alias("doc_id"), RID)
    times = F.col("whole") + F.coalesce((place <= F.col("end")).cast("int"), F.lit(0))
    taken = placed.withColumn("__mw_copies", times.cast("int")).where(F.col("__mw_copies") > 0)
    return taken.withColumn("__mw_copy", F.explode(F.sequence(F.lit(1), F.col("__mw_copies")))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
