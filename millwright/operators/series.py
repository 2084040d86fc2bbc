"""Time series of samples: statistics, changes, slices, even downsampling, synthetic readers, byte budgets."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.values import kind
from millwright.operators.windows import at_places, ordinal, previous


def change_points(samples: DataFrame, keys: list[str], order: list[str], value: str, error: str, slot: Column | None = None) -> DataFrame:
    """Samples whose value or error differs from the sample before of the same key, with what was before.

    The first sample of a key is never one. ``slot``: see ``windows.previous``.
    """
    rows = previous(samples, keys, order, [order[0], value, error], slot)
    value_moved = ~F.col(value).eqNullSafe(F.col(f"prev_{value}"))
    error_moved = F.coalesce(F.col(error), F.lit("")) != F.coalesce(F.col(f"prev_{error}"), F.lit(""))
    rows = rows.withColumns({"value_changed": value_moved, "error_changed": error_moved})
    return rows.where("has_prev and (value_changed or error_changed)").drop("has_prev")


def session_summary(samples: DataFrame, keys: list[str], order: list[str], value: str, error: str, slot: Column | None = None) -> DataFrame:
    """Statistics of each key: counts, changes of value or error, first and last, extremes of samples without error."""
    rows = previous(samples, keys, order, [value, error], slot)
    bad = F.coalesce(F.col(error), F.lit("")) != ""
    moved = F.col("has_prev") & (~F.col(value).eqNullSafe(F.col(f"prev_{value}")) | (F.coalesce(F.col(error), F.lit("")) != F.coalesce(F.col(f"prev_{error}"), F.lit(""))))
    seq = F.struct(*order)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.count_if(bad).alias("errors"),
        F.count_if(moved).alias("n_changes"),
        F.min(order[0]).alias("first_at"),
        F.max(order[0]).alias("last_at"),
        F.min_by(value, seq).alias("first_value"),
        F.max_by(value, seq).alias("last_value"),
        F.min(F.when(moved, F.col(order[0]))).alias("first_change_at"),
        F.max_by(error, F.when(bad, seq)).alias("last_error"),
        F.min(F.when(~bad, F.col(value))).alias("min_value"),
        F.max(F.when(~bad, F.col(value))).alias("max_value"),
    )


def json_summary(samples: DataFrame, keys: list[str], order: list[str], value: str, error: str, slot: Column | None = None) -> DataFrame:
    """``session_summary`` of values held as JSON text.

    Extremes are those of the kind (bool, number, string) of a key's first sample without error; numbers compare as such.
    """
    base = session_summary(samples, keys, order, value, error, slot).drop("min_value", "max_value")
    good = samples.where(F.coalesce(F.col(error), F.lit("")) == "").withColumn("kind", kind(F.col(value))).where("kind is not null")
    first = good.groupBy(*keys).agg(F.min_by("kind", F.struct(*order)).alias("kind"))
    place = F.struct(F.col(value).try_cast("double").alias("number"), F.col(value).alias("text"))
    ends = good.join(first, [*keys, "kind"]).groupBy(*keys).agg(F.min_by(value, place).alias("min_value"), F.max_by(value, place).alias("max_value"), F.first("kind").alias("kind"))
    return base.join(ends, keys, "left")


def latest(samples: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key; combines before the shuffle."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("v")
    return samples.groupBy(*keys).agg(best).select(*keys, *[F.col(f"v.{c}").alias(c) for c in columns])


def downsample(rows: DataFrame, keys: list[str], order: list[str], n: int, slot: Column | None = None) -> DataFrame:
    """At most ``n`` rows of each key at even steps, both ends kept (halves round to even); n = 1 gives the first.

    ``slot``: see ``windows.ordinal``.
    """
    if n <= 0:
        return rows.limit(0)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    if n == 1:
        wanted = sizes.select(*keys, F.lit(0).cast("long").alias("__i"))
    else:
        even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(n - 1)).cast("long"))
        every = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)
        wanted = sizes.select(*keys, F.explode(F.when(F.col("__n") <= n, every).otherwise(F.array_distinct(even))).alias("__i"))
    return at_places(ordinal(rows, keys, order, "__i", slot), wanted, keys).select(*rows.columns)


def synthetic(spark: SparkSession, tags: list[str], cycles: int, kind: str = "DINT", period: int = 20, amplitude: float = 10.0, offset: float = 0.0) -> DataFrame:
    """cycle, tag, value, type of a deterministic reader: a saw tooth for numbers, odd cycles for BOOL."""
    names = F.posexplode(F.array(*map(F.lit, tags))).alias("i", "tag")
    rows = spark.range(cycles).select(F.col("id").alias("cycle"), names)
    phase = F.pmod(F.col("cycle") + F.col("i"), F.lit(period)) / F.lit(period)
    wave = F.lit(offset) + F.lit(amplitude) * phase
    if kind == "BOOL":
        value = F.when(F.pmod(F.col("cycle") + F.col("i"), F.lit(2)) == 1, "true").otherwise("false")
    elif kind == "REAL":
        value = F.bround(wave, 6).cast("string")
    else:
        value = F.bround(wave).cast("long").cast("string")
    return rows.select("cycle", "tag", value.alias("value_json"), F.lit(kind).alias("type"))


def enforce_budget(samples: DataFrame, keys: list[str], order: list[str], value: str, error: str, limit: int = 4096) -> DataFrame:
    """Within each cycle values that no longer fit the byte budget become null with an error.

    What fits depends on what was cut before, so a cycle is walked in order; its samples stream through a task that
    keeps only the bytes used so far.
    """
    names = [f"c{i}" for i in range(len(samples.columns))]
    own = dict(zip(samples.columns, names))
    inside = [own[c] for c in keys]
    sized = samples.toDF(*names).withColumn("size", F.coalesce(F.octet_length(own[value]), F.lit(0)))
    sized = sized.repartition(*inside).sortWithinPartitions(*inside, *[own[c] for c in order])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema)
    out = sized.mapInArrow(_walk(inside, own[value], own[error], limit), types)
    return out.select(*[F.col(own[c]).alias(c) for c in samples.columns])


def _walk(keys: list[str], value: str, error: str, limit: int):
    def run(batches):
        at, used = None, 0
        for batch in batches:
            fits = []
            for *key, size in zip(*(batch[c].to_pylist() for c in [*keys, "size"])):
                if key != at:
                    at, used = key, 0
                fits.append(used + size <= limit)
                used += size if fits[-1] else 0
            ok, note = pa.array(fits, pa.bool_()), pa.scalar("sample exceeds the byte budget of its cycle")
            cut = {value: lambda c: pc.if_else(ok, c, pa.scalar(None, c.type)), error: lambda c: pc.if_else(ok, c, note.cast(c.type))}
            yield pa.RecordBatch.from_arrays([cut.get(n, lambda c: c)(batch[n]) for n in batch.schema.names], names=batch.schema.names)

    return run


def snapshot(requested: DataFrame, results: DataFrame, tag: str, value: str, error: str) -> DataFrame:
    """Every requested tag in its order, an error where the reader gave nothing."""
    got = results.select(tag, value, error, F.lit(True).alias("__got"))
    out = requested.join(got, tag, "left")
    return out.withColumn(error, F.when(F.col("__got").isNull(), F.lit("missing tag result")).otherwise(F.col(error))).drop("__got")
