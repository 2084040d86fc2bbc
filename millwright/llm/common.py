"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.batches import give_back, slices, small_batches  # noqa: F401
from millwright.sources.shared import discard, materialize, shared_path  # noqa: F401

RID = "__mw_rid"
WS_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{WS_CLASS}]+"


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a table of Parquet files under projections and filters alone, so that each of its rows is a row of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size():
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias", "View") or not plan.deterministic():
            return False
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def row_id(df: DataFrame) -> Column:
    """An id of each row. For a table of Parquet files it is the row's place, (hash of the file's path, row in it), which
    no other number of cores, splits or attempts can change; two of a million files share a hash with probability 3e-8.
    Other frames get ``monotonically_increasing_id``, which is good for one reading: see ``as_table``.
    """
    if not is_scan(df):
        return F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def as_table(df: DataFrame) -> DataFrame:
    """``df`` itself if ``is_scan``, else a written copy (of an ``explode``, a join, a union, rows in memory): reading it twice gives the same rows and ids."""
    names = list(df.columns)
    bare = df.toDF(*[f"c{i}" for i in range(len(names))])
    return df if is_scan(bare) else materialize(bare, "rows").toDF(*names)


def pick(df: DataFrame, *names: str, rid: bool = False) -> DataFrame:
    """Exactly the named columns, whatever other (even equally named) columns ``df`` has; the first match counts.

    ``rid`` adds ``row_id``, so that rows with equal or null ids stay apart.
    """
    found = list(df.columns)
    bare = df.toDF(*[f"__mw_{i}" for i in range(len(found))])
    cols = [F.col(f"__mw_{found.index(n)}").alias(n) for n in names]
    return bare.select(*([row_id(bare).alias(RID)] if rid else []), *cols)


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` (a table) without the rows whose id is in ``dropped`` (RID); all columns as they were."""
    names = [f"__mw_{i}" for i in range(len(docs.columns))]
    bare = docs.toDF(*names)
    return join_bounded(bare.select(row_id(bare).alias(RID), *names), dropped, [RID], "left_anti").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def join_bounded(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = 1_000_000) -> DataFrame:
    """Join a materialised narrow table: broadcast while it has at most ``limit`` rows, else a shuffled join."""
    if small.count() <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def prefix_offsets(counts: DataFrame, order: str, value: str, out: str, rows: int, fan: int = 4096, by: list[str] | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` by the integer ``order`` from 0 to below ``rows`` (within ``by``), in two levels.

    No task sees more than about ``max(fan, rows / fan)`` rows, so the per-bucket table may grow with the data.
    """
    from pyspark.sql import Window as W

    by = by or []
    runs = counts.withColumn("__mw_run", F.floor(F.col(order) / F.lit(fan)))
    inner = W.partitionBy(*by, "__mw_run").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("__mw_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    if rows <= fan:
        return runs.withColumnRenamed("__mw_in", out).drop("__mw_run")
    tops = runs.groupBy(*by, "__mw_run").agg(F.sum(value).alias("__mw_total"))
    outer = W.partitionBy(*by).orderBy("__mw_run").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.withColumn("__mw_base", F.coalesce(F.sum("__mw_total").over(outer), F.lit(0))).drop("__mw_total")
    return runs.join(tops, [*by, "__mw_run"]).withColumn(out, F.col("__mw_base") + F.col("__mw_in")).drop("__mw_run", "__mw_base", "__mw_in")


# --- inside tasks -----------------------------------------------------------------------------------------------


def worker_state() -> dict:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("_millwright_worker", types.ModuleType("_millwright_worker")).__dict__


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty strings."""
    return pc.fill_null(column(batch, name), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The index of its text for each word, and the words."""
    parts = pc.ascii_split_whitespace(texts)
    words, parent = parts.flatten(), pc.list_parent_indices(parts)
    full = pc.greater(pc.binary_length(words), 0)
    return parent.filter(full).to_numpy(zero_copy_only=False).astype(np.int64), words.filter(full)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and its offsets into them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
