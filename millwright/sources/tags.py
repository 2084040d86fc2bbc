"""Tag readers as a Spark data source: ``spark.read.format("tags")`` and ``spark.readStream.format("tags")``.

Options: ``source`` (the reader's name), ``tags`` (a JSON array of names), ``cycles`` (how many; a stream without it goes
on), ``interval_ms``, ``started`` (UTC, ISO; the time of cycle 0), ``partitions`` (groups of tags read by a task each), and
those of the reader. Rows are one a cycle and tag; a cycle's number is the stream's offset, and a cycle's time follows
from ``started``, so that a restarted stream goes on at its offset and a batch that is read again has the same rows.

A reader answers one cycle's tags with samples in any form; they are matched by tag, then by position, and normalised.
Readers that reach a device register under a name of their own (``register_reader``); here are the synthetic one and one
that replays a recorded log.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "tags"
MOST_TAGS = 32
CYCLES_A_TASK = 1000
COLUMNS = "seq long, ts timestamp, ts_utc string, cycle long, tag string, value_json string, type string, error string"


# --- samples ----------------------------------------------------------------------------------------------------


def utc_text(at: datetime) -> str:
    return at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def utc_time(text: str) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def plain(value):
    """A value of any kind as JSON can hold it: times as text, other objects by their text."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, datetime):
        return utc_text(value if value.tzinfo else value.replace(tzinfo=UTC))
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value, key=repr) if isinstance(value, (set, frozenset)) else value)]
    return str(value)


@dataclass
class Sample:
    tag: str
    value_json: str | None
    type: str | None
    error: str | None


def normalized(raw) -> Sample:
    """A sample from a mapping or an object with tag, value, type and error; the tag is required."""
    get = raw.get if isinstance(raw, Mapping) else lambda name: getattr(raw, name, None)
    tag = str(get("tag") or "")
    if not tag:
        raise ValueError("a sample needs a tag")
    value, kind, error = get("value"), get("type"), get("error")
    return Sample(tag, None if value is None else json.dumps(plain(value), ensure_ascii=False, separators=(",", ":")), None if kind is None else str(kind), None if error is None else str(error))


def matched(tags: list[str], samples: Iterable) -> list[Sample]:
    """One sample for each tag: the one of its name, else the one at its place, else an error."""
    found = [normalized(x) for x in samples]
    by_tag = {x.tag: x for x in found}
    place = lambda i, tag: found[i] if i < len(found) and found[i].tag not in tags else Sample(tag, None, None, "missing tag result")
    return [by_tag.get(tag) or place(i, tag) for i, tag in enumerate(tags)]


# --- readers ----------------------------------------------------------------------------------------------------


class TagReader:
    """One cycle's tags at a time. ``options`` are those of the data source, with names in lower case."""

    def __init__(self, options: Mapping[str, str]):
        self.options = options

    def open(self) -> None:
        """Before the first cycle of a task."""

    def close(self) -> None:
        """After its last one, also if it failed."""

    def identity(self) -> dict:
        return {}

    def last_cycle(self) -> int | None:
        """The number of cycles there are, None for no end."""
        return None

    def read(self, tags: list[tuple[int, str]], cycle: int) -> Iterable:
        """Samples of the tags, each given with its place among all tags."""
        raise NotImplementedError


class SimulatedReader(TagReader):
    """A saw tooth for each tag; odd cycles for BOOL. ``failing`` tags (a JSON array) give errors."""

    def open(self) -> None:
        get = self.options.get
        self.kind, self.period = str(get("kind", "DINT")).upper(), max(1, int(get("period", 20)))
        self.amplitude, self.offset = float(get("amplitude", 10.0)), float(get("offset", 0.0))
        self.failing = {*json.loads(get("failing", "[]"))}

    def identity(self) -> dict:
        return {"name": "simulated", "simulated": True}

    def read(self, tags, cycle):
        for i, tag in tags:
            wave = self.offset + self.amplitude * (((cycle + i) % self.period) / self.period)
            value = bool((cycle + i) % 2) if self.kind == "BOOL" else round(wave, 6) if self.kind in ("REAL", "LREAL") else round(wave)
            yield {"tag": tag, "type": self.kind} | ({"error": "tag could not be read"} if tag in self.failing else {"value": value})


class RecordedReader(TagReader):
    """Replays the log at ``path`` (Parquet, or JSON lines with ``log_format`` json): rows of cycle, tag, value or value_json, type, error.

    A task reads its tags and cycles alone; ``session_id`` takes one session of a table of sessions.
    """

    def _log(self):
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        path = self.options["path"]
        store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        parts = ds.partitioning(pa.schema([("session_id", pa.string()), ("epoch", pa.int64())]), flavor="hive") if self.options.get("log_format", "parquet") == "parquet" else None
        return ds.dataset(at, filesystem=store, format=self.options.get("log_format", "parquet"), partitioning=parts)

    def _where(self, log, *more):
        import pyarrow.compute as pc

        terms = [*more, *([pc.field("session_id") == self.options["session_id"]] if self.options.get("session_id") else [])]
        out = pc.scalar(True)
        for t in terms:
            out = out & t
        return out

    def open(self) -> None:
        self.log, self.held, self.upto = self._log(), {}, -1

    def identity(self) -> dict:
        return {"name": "recorded"}

    def last_cycle(self) -> int | None:
        import pyarrow.compute as pc

        log = self._log()
        most = -1
        for batch in log.to_batches(columns=["cycle"], filter=self._where(log)):
            most = max(most, pc.max(batch.column(0)).as_py() if batch.num_rows and batch.column(0).null_count < batch.num_rows else -1)
        return most + 1

    def read(self, tags, cycle):
        import pyarrow.compute as pc

        if cycle >= self.upto:  # a stretch of cycles at once
            self.held, self.upto = {}, cycle + CYCLES_A_TASK
            names = [c for c in ("cycle", "tag", "value_json", "value", "type", "error") if c in self.log.schema.names]
            where = self._where(self.log, pc.field("cycle") >= cycle, pc.field("cycle") < self.upto, pc.field("tag").isin([t for _, t in tags]))
            for batch in self.log.to_batches(columns=names, filter=where):
                for r in batch.to_pylist():
                    if r.get("value_json") is not None:
                        r["value"] = json.loads(r["value_json"])
                    self.held.setdefault(r["cycle"], []).append(r)
        return self.held.get(cycle, [])


READERS: dict[str, type[TagReader]] = {"simulated": SimulatedReader, "fake": SimulatedReader, "recorded": RecordedReader}


def register_reader(name: str, reader: type[TagReader]) -> None:
    READERS[name.lower()] = reader


def reader_of(source: str) -> type[TagReader]:
    """The reader of a name; one that is not registered is an error."""
    found = READERS.get((source or "").lower())
    if found is None:
        raise ValueError(f"no reader {source!r}: one of {', '.join(sorted(READERS))}")
    return found


# --- data source ------------------------------------------------------------------------------------------------


@dataclass
class Stretch(InputPartition):
    tags: list
    start: int
    end: int


class _Cycles:
    """What batch and stream have in common."""

    def __init__(self, options: Mapping[str, str], reader: type[TagReader]):
        self.options, self.made = {k.lower(): v for k, v in options.items()}, reader
        self.tags = [*enumerate(json.loads(self.options.get("tags", "[]")))]
        self.interval = int(self.options.get("interval_ms", 1000))
        self.started = utc_time(self.options["started"]) if "started" in self.options else datetime.now(UTC)
        self.cycles = int(self.options["cycles"]) if "cycles" in self.options else None
        if not self.tags:
            raise ValueError("the option tags names no tag")

    def there(self) -> int | None:
        """How many cycles there will be."""
        ends = [x for x in (self.cycles, self.made(self.options).last_cycle()) if x is not None]
        return min(ends) if ends else None

    def stretches(self, start: int, end: int) -> list[Stretch]:
        groups = max(1, min(len(self.tags), int(self.options.get("partitions", 1))))
        return [Stretch(self.tags[g::groups], lo, min(lo + CYCLES_A_TASK, end)) for lo in range(start, end, CYCLES_A_TASK) for g in range(groups)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        names = [t for _, t in partition.tags]
        reader = self.made(self.options)
        reader.open()
        try:
            for cycle in range(partition.start, partition.end):
                at = self.started + timedelta(milliseconds=cycle * self.interval)
                try:
                    samples = matched(names, reader.read(partition.tags, cycle))
                except Exception as e:  # a cycle that cannot be read is a sample of its error for each tag
                    samples = [Sample(tag, None, None, str(e)) for tag in names]
                for (i, tag), s in zip(partition.tags, samples):
                    yield cycle * MOST_TAGS + i, at, utc_text(at), cycle, tag, s.value_json, s.type, s.error
        finally:
            reader.close()


class BatchReader(_Cycles, DataSourceReader):
    def partitions(self):
        end = self.there()
        if end is None:
            raise ValueError("a batch needs the option cycles")
        return self.stretches(0, end) or [Stretch(self.tags, 0, 0)]


class StreamReader(_Cycles, DataSourceStreamReader):
    """Cycles are due by the clock; of a recorded log all are due at once, unless ``paced``."""

    def __init__(self, options, reader):
        super().__init__(options, reader)
        self.end = self.there()
        self.paced = self.options.get("paced", "false" if reader is RecordedReader else "true") == "true"

    def initialOffset(self) -> dict:
        return {"cycle": 0}

    def latestOffset(self) -> dict:
        due = max(0, int((datetime.now(UTC) - self.started) / timedelta(milliseconds=self.interval)) + 1)
        return {"cycle": due if self.end is None else min(due, self.end) if self.paced else self.end}

    def partitions(self, start: dict, end: dict):
        return self.stretches(start["cycle"], end["cycle"])

    def commit(self, end: dict) -> None:
        """Nothing to forget: cycles can be read again."""


class TagSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options, self._made())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options, self._made())

    def _made(self) -> type[TagReader]:
        return reader_of(self.options.get("source", "simulated"))


def _options(tags: list[str], options: dict) -> dict[str, str]:
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    return {"tags": json.dumps(tags), **{k: text(v) for k, v in options.items() if v is not None}}


def _registered(spark: SparkSession, source: str) -> str:
    """The format of the data source with this reader in it: Spark sends the class to processes of its own, which have registered nothing."""
    made = reader_of(source)

    class Tags(TagSource):
        def _made(self):
            return made if self.options.get("source", "").lower() == source.lower() else reader_of(self.options.get("source", "simulated"))

    spark.dataSource.register(Tags)
    return FORMAT


def read_tags(spark: SparkSession, source: str, tags: list[str], **options) -> DataFrame:
    """A batch of ``cycles`` cycles."""
    return spark.read.format(_registered(spark, source)).options(**_options(tags, {"source": source, **options})).load()


def stream_tags(spark: SparkSession, source: str, tags: list[str], **options) -> DataFrame:
    return spark.readStream.format(_registered(spark, source)).options(**_options(tags, {"source": source, **options})).load()


def normalized_samples(frame: DataFrame, now: datetime | None = None) -> DataFrame:
    """Rows of a foreign log with the columns of samples: what is missing is null, times default to ``now``, values of any type become JSON.

    A row without a tag is an error.
    """
    types = dict(frame.dtypes)
    col = lambda name, kind: F.col(name).cast(kind) if name in types else F.lit(None).cast(kind)
    ts = F.coalesce(F.to_timestamp("ts_utc") if "ts_utc" in types else F.lit(None), col("ts", "timestamp"), F.lit(now or datetime.now(UTC)))
    if "value_json" in types or "value" not in types:
        value = col("value_json", "string")
    elif types["value"] == "string":
        value = F.when(F.col("value").isNotNull(), F.to_json(F.array("value")))
        value = F.substring(value, F.lit(2), F.length(value) - 2)
    elif types["value"].startswith(("array", "map", "struct")):
        value = F.to_json("value")
    else:
        value = F.col("value").cast("string")
    tag = F.when(F.length(F.coalesce(col("tag", "string"), F.lit(""))) > 0, F.col("tag")).otherwise(F.raise_error(F.lit("a sample needs a tag"))) if "tag" in types else F.raise_error(F.lit("a sample needs a tag"))
    return frame.select(col("seq", "long").alias("seq"), ts.alias("ts"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_utc"), col("cycle", "long").alias("cycle"), tag.cast("string").alias("tag"), value.alias("value_json"), col("type", "string").alias("type"), col("error", "string").alias("error"))
