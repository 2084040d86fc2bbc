"""Two-pass external shuffle into shards, in DataFrame operations alone.

Pass 1 scatters whole records uniformly into memory-sized buckets by a seeded hash of the row (its id, its text and its
place in its file). Pass 2 permutes each bucket with Spark's seeded Fisher-Yates ``shuffle`` and writes it. What is shuffled is
the numbers of a bucket's records; the records themselves are sorted by Spark, which spills, and never gathered. A
first look at the rows of each hash cell gives each bucket its place in the global order, so record g of N goes to
shard floor(g * shards / N): shard counts differ by at most one (law ``rows``).

Null text counts as empty (size 16), null doc_id hashes like any value, other columns travel along whatever their
names (they sit in ``record``). Repeated rows, however many, spread over all buckets by their places (those at the same place of different files share one). A very long text
makes its bucket larger by itself. An empty table gives an empty result. Equal texts (groups of copies) are dealt like
any others. Input that is not read from Parquet files is written out first, since it is read twice.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millwright.llm.common import RID, as_table, materialize, pick, prefix_offsets, row_id, shared_path, shuffle_partitions, text_or_empty

SEED, BUCKET_BYTES, SHARDS = 20_240_117, 32 << 20, 40
CELL_BITS = 20  # buckets are ranges of hash cells
MAX_TASKS = 20_000


def _place(seed: int, doc_id, text, rid: str = RID):
    """The seeded hash of a row; its cell is the top bits. Only repeats of a row that have the same place in their files share it."""
    return F.xxhash64(F.lit(seed), doc_id, text, F.col(f"{rid}.row"))


def _cell(place):
    return F.shiftrightunsigned(place, 64 - CELL_BITS)


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write Parquet files under ``path/shard=N`` and return them: shard, slot, size, doc_id, text, record (all columns of docs)."""
    spark = docs.sparkSession
    docs = as_table(docs)
    path = path or shared_path(spark, "shards")
    size = lambda text: (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long")
    narrow = pick(docs, "doc_id", "text", rid=True)
    cells = narrow.groupBy(_cell(_place(seed, "doc_id", "text")).alias("cell")).agg(F.count("*").alias("n"), F.sum(size("text")).alias("bytes"))
    cells = materialize(cells, "shard-cells")
    rows, volume = cells.agg(F.sum("n"), F.sum("bytes")).first()
    rows, volume = rows or 0, volume or 0
    buckets = min(1 << CELL_BITS, max(math.ceil(volume / bucket_bytes), shuffle_partitions(spark)))
    tasks = min(buckets, MAX_TASKS)
    bucket = lambda cell: F.shiftright(cell * F.lit(buckets), CELL_BITS).cast("int")
    task = F.expr(f"cast(cast(bucket as long) * {tasks} div {buckets} as int)")  # a range of buckets, so of one or two shards

    counts = cells.groupBy(bucket(F.col("cell")).alias("bucket")).agg(F.sum("n").alias("n"))
    offsets = prefix_offsets(counts, "bucket", "n", "start", buckets).select("bucket", "n", "start", task.alias("task"))
    # shuffle() draws from one stream a partition: the exchange by partition id and the order fix what it draws.
    dealt = offsets.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "bucket")
    dealt = dealt.select("task", "bucket", "start", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(seed)).alias("order"))

    names = [f"c{i}" for i in range(len(docs.columns))]
    own = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    bare = docs.toDF(*names)
    record = F.struct(*[F.col(n) for n in names])
    placed = bare.select(row_id(bare).alias(RID), record.alias("record")).withColumn("place", _place(seed, f"record.{own['doc_id']}", f"record.{own['text']}"))
    scattered = placed.withColumn("bucket", bucket(_cell(F.col("place")))).withColumn("task", task).repartitionById(tasks, F.col("task"))
    inner = F.row_number().over(W.partitionBy("task", "bucket").orderBy("place", RID)) - 1
    mixed = scattered.withColumn("pos", inner).join(dealt.hint("merge"), ["task", "bucket"])
    out = mixed.select((F.col("start") + F.get("order", F.col("pos"))).alias("g"), "record")
    shard = F.floor(F.col("g") * F.lit(shards) / F.lit(max(1, rows))) if rows * shards < 1 << 52 else F.expr(f"(g * {shards}) div {max(1, rows)}")
    out = out.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"g - (shard * {max(1, rows)}L + {shards - 1}) div {shards}").cast("long"))
    out = out.withColumn("size", size(F.col("record")[own["text"]]))
    out.select("shard", "slot", "size", "record").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    schema = out.select("slot", "size", "record", "shard").schema
    return spark.read.schema(schema).parquet(path).select("shard", "slot", "size", F.col("record")[own["doc_id"]].alias("doc_id"), F.col("record")[own["text"]].alias("text"), "record")


def shard_digest(written: DataFrame) -> DataFrame:
    """What the written shards hold, row by row."""
    return written.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
