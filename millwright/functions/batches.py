"""Arrow batches in small pieces: how rows travel to Python, and how much of them is worked on at a time."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows travel to Python in batches of about ``size`` bytes from now on, unless the session says otherwise.

    It holds for the session, since the jobs of a lazy result start later; results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, size)


def give_back() -> None:
    """Return freed memory to the system; an executor's workers stay, and share its memory with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str, budget: int = 1 << 20, hold: int = 8 << 20):
    """Cut Arrow batches where ``column`` passes ``budget`` bytes, so that work arrays stay small.

    Freed memory goes back to the system after every ``hold`` bytes and at the end.
    """
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64)
        starts = np.flatnonzero(np.diff((upto - sizes) // budget, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))
            done += int(upto[hi - 1] - upto[lo] + sizes[lo])
            if done >= hold:
                done = 0
                give_back()
        batch = None
    give_back()
