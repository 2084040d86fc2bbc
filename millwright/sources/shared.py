"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir`` (a temporary folder only where it is unset and the master local)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote, once nothing that is still to run reads them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


FREE_FILES, ROWS_A_FILE = 48, 1_000_000


def files_for(rows: int) -> int:
    """How many files a narrow table of so many rows is worth: one for each 20,000 up to ``FREE_FILES``, then one for each million."""
    return max(1, min(FREE_FILES, -(-rows // 20_000)), -(-rows // ROWS_A_FILE))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` and read it back: a lost executor costs no recomputation above this point.

    ``rows``: the most rows that it can have. A narrow table then has no more files than these are worth, however many
    partitions it comes from.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df if rows is None else df.coalesce(files_for(rows))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
