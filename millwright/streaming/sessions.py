"""Capture sessions, their samples and states, change points and statistics as Structured Streaming.

Samples lie by session and epoch: a batch that Spark runs again replaces what it wrote, so that each sample is there
once, and counters are taken from the samples. A capture renews its lease with every state that it writes; a session
that is running by its last state and past its lease has lost its process, and reads as failed.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import subprocess
import sys
import threading
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millwright.operators import series
from millwright.sources.tags import MOST_TAGS, reader_of, stream_tags, utc_text

SAMPLES = "session_id string, seq long, ts_utc string, ts timestamp, cycle long, tag string, value_json string, type string, error string"
# Limits of a capture (fixed values).
LEAST_INTERVAL_MS, MOST_SECONDS, CYCLE_BYTES = 100, 300, 4096
LEASE_SECONDS = 30  # a running capture writes a state at least three times in it
KEEP_STATES = 3
SESSION_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")


def normalize_tags(tags: list[str]) -> list[str]:
    """Trimmed distinct names, between one and ``MOST_TAGS``."""
    names = list(dict.fromkeys(t.strip() for t in tags if t and t.strip()))
    if not names or len(names) > MOST_TAGS:
        raise ValueError(f"between 1 and {MOST_TAGS} tags, not {len(names)}")
    return names


def check_limits(interval_ms: int, seconds: float) -> None:
    if interval_ms < LEAST_INTERVAL_MS:
        raise ValueError(f"an interval of at least {LEAST_INTERVAL_MS} ms, not {interval_ms}")
    if not math.isfinite(seconds) or not 0 < seconds <= MOST_SECONDS:
        raise ValueError(f"a duration over 0 and up to {MOST_SECONDS} s, not {seconds}")


def check_source(source: str) -> None:
    """An unknown reader is an error."""
    reader_of(source)


def new_session_id(prefix: str = "session") -> str:
    return f"{prefix}-{uuid.uuid4().hex[:12]}"


MANIFEST = "schema_version int, session_id string, created_at string, requested_tags array<string>, interval_ms int, duration_seconds double, source string, mode string, controller_identity string, path_fingerprint string, permission string, retention_policy string, limits map<string,double>"
STATES = "session_id string, version long, status string, updated_at string, lease_until string, ended_at string, cycles long, samples long, errors long, error string"
RUNNING, COMPLETED, STOPPED, FAILED = "running", "completed", "stopped", "failed"
PREVIEW_TAGS = 20


def _now() -> str:
    return utc_text(datetime.now(UTC))


def create_session(spark: SparkSession, root: str, session_id: str, tags: list[str], interval_ms: int = 1000, seconds: float = 60, identity: str = "", path: str = "", **more: str) -> DataFrame:
    """Write a session's manifest; an existing session is not overwritten. Its path is kept as a fingerprint only."""
    if not SESSION_ID.fullmatch(session_id):
        raise ValueError(f"bad session id {session_id!r}")
    limits = {"max_tags": MOST_TAGS, "max_bytes_per_cycle": CYCLE_BYTES, "max_duration_seconds": MOST_SECONDS}
    row = {"schema_version": 1, "session_id": session_id, "created_at": pd.Timestamp.now("UTC").strftime("%Y-%m-%dT%H:%M:%SZ"), "requested_tags": normalize_tags(tags), "interval_ms": interval_ms, "duration_seconds": seconds, "source": "simulated", "mode": "OFFLINE", "controller_identity": identity, "path_fingerprint": hashlib.sha256(path.encode()).hexdigest()[:16], "permission": "read_only", "retention_policy": "keep", "limits": limits, **more}
    frame = spark.createDataFrame([(json.dumps(row),)], "value string")
    frame.coalesce(1).write.mode("errorifexists").text(f"{root}/manifests/session_id={session_id}")
    return frame


def write_state(spark: SparkSession, root: str, session_id: str, status: str, version: int, cycles: int = 0, samples: int = 0, errors: int = 0, error: str | None = None, lease: float = LEASE_SECONDS) -> None:
    """Write a state of a session; the one of the highest version counts, so that readers never see half of a change.

    The same version again replaces itself; only the newest few stay.
    """
    now = datetime.now(UTC)
    running = status == RUNNING
    row = (session_id, version, status, utc_text(now), utc_text(now + timedelta(seconds=lease)) if running else None, None if running else utc_text(now), cycles, samples, errors, error)
    folder = f"{root}/states/{session_id}"
    spark.createDataFrame([row], STATES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{version:012d}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in store.listStatus(where))
    for name in names[:-KEEP_STATES]:
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def states(spark: SparkSession, root: str, session_id: str | None = None) -> DataFrame:
    """The current state of each session (or of one); a running one past its lease has failed."""
    there = _exists(spark, f"{root}/states/{session_id}" if session_id else f"{root}/states")
    read = spark.read.schema(STATES).option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
    rows = read.parquet(f"{root}/states/{session_id}" if session_id else f"{root}/states") if there else spark.createDataFrame([], STATES)
    newest = F.max_by(F.struct(*[c.split()[0] for c in STATES.split(", ")[1:]]), F.struct("version", "updated_at")).alias("s")
    current = rows.groupBy("session_id").agg(newest).select("session_id", "s.*")
    lost = (F.col("status") == RUNNING) & (F.col("lease_until") < _now())
    return current.withColumns({"status": F.when(lost, FAILED).otherwise(F.col("status")), "ended_at": F.when(lost, F.col("lease_until")).otherwise(F.col("ended_at")), "error": F.when(lost, "the capture's process did not renew its lease").otherwise(F.col("error"))})


def request_stop(spark: SparkSession, root: str, session_id: str) -> None:
    """Ask the capture of a session, in whatever process it runs, to end after its current cycle."""
    spark.createDataFrame([(_now(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/stops/{session_id}")


def stop_requested(spark: SparkSession, root: str, session_id: str) -> bool:
    return _exists(spark, f"{root}/stops/{session_id}/_SUCCESS")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of all sessions; those that cannot be read or are of another version are left out."""
    m = spark.read.text(f"{root}/manifests/*").select(F.from_json("value", MANIFEST).alias("m")).select("m.*")
    return m.where(F.col("schema_version") == 1)


def sessions(spark: SparkSession, root: str, status: str | None = None) -> DataFrame:
    """Sessions with their state and the first tags, the newest first."""
    m = manifests(spark, root).withColumns({"tag_count": F.size("requested_tags"), "requested_tags": F.slice("requested_tags", 1, PREVIEW_TAGS)})
    rows = m.join(states(spark, root), "session_id", "left").withColumn("status", F.coalesce("status", F.lit("created")))
    rows = rows.where(F.col("status") == status) if status else rows
    return rows.orderBy(F.desc("created_at"), F.desc("session_id"))


def append_epoch(batch: DataFrame, root: str, session_id: str, epoch: int) -> None:
    """Put a batch in its place; the same epoch again replaces itself."""
    kept = series.enforce_budget(batch, ["session_id", "cycle"], ["seq"], "value_json", "error", CYCLE_BYTES)
    kept.drop("session_id").write.mode("overwrite").parquet(f"{root}/samples/session_id={session_id}/epoch={epoch}")


def capture(spark: SparkSession, root: str, session_id: str, tags: list[str], interval_ms: int = 1000, seconds: float = 60, source: str = "simulated", lease: float = LEASE_SECONDS, started: str | None = None, **options) -> StreamingQuery:
    """Write samples of a reader to the session, one row a tag and cycle, for ``seconds`` or until a stop is asked for.

    The data source's cycles are the offsets: a capture that is started again with the time at which it ``started`` goes
    on where its checkpoint is. ``options`` are the reader's. The session's states say how far it is and how it ended.
    """
    check_limits(interval_ms, seconds)
    names = normalize_tags(tags)
    cycles = math.ceil(seconds * 1000 / interval_ms)
    rows = stream_tags(spark, source, names, cycles=cycles, interval_ms=interval_ms, started=started or _now(), **options).withColumn("session_id", F.lit(session_id))
    rows = rows.select(*[c.split()[0] for c in SAMPLES.split(", ")])
    ended, told = threading.Event(), [0.0]

    def end(query: StreamingQuery) -> None:
        while not ended.wait(lease / 6):
            if not query.isActive:  # it failed: the caller has its exception, others its state
                last = states(spark, root, session_id).first()
                write_state(spark, root, session_id, FAILED, (last["version"] if last else 0) + 1, error=str(query.exception())[:500])
                return
        query.stop()

    def append(batch: DataFrame, epoch: int) -> None:
        if ended.is_set():
            return
        spark = batch.sparkSession
        append_epoch(batch, root, session_id, epoch)
        last = batch.agg(F.max("cycle")).first()[0]
        done = last is not None and last + 1 >= cycles
        status = STOPPED if stop_requested(spark, root, session_id) else COMPLETED if done else RUNNING
        if status != RUNNING or time.monotonic() - told[0] > lease / 3:
            told[0] = time.monotonic()
            n, errors, most = read_samples(spark, root, session_id).agg(F.count("*"), F.count("error"), F.max("cycle")).first()
            write_state(spark, root, session_id, status, epoch + 1, (-1 if most is None else most) + 1, n, errors, lease=lease)
        if status != RUNNING:
            ended.set()

    write_state(spark, root, session_id, RUNNING, 0, lease=lease)
    query = rows.writeStream.foreachBatch(append).option("checkpointLocation", f"{root}/checkpoints/{session_id}").trigger(processingTime=f"{interval_ms} milliseconds").start()
    threading.Thread(target=end, args=(query,), daemon=True).start()
    return query


def capture_process(workspace: str, session_id: str, tags: list[str], interval_ms: int = 1000, seconds: float = 60, source: str = "simulated", runtime: str | None = None) -> int:
    """Start a capture in a process of its own, which outlives this one, and give its PID."""
    check_limits(interval_ms, seconds)
    check_source(source)
    arguments = {"tags": json.dumps(normalize_tags(tags)), "interval-ms": interval_ms, "duration-seconds": seconds, "session-id": json.dumps(session_id), "source-name": source}
    command = [sys.executable, "-m", "millwright.cli", "runtime-capture-run", "--workspace", workspace, *(["--runtime", runtime] if runtime else [])]
    command += [x for k, v in arguments.items() for x in (f"--{k}", str(v))]
    return subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True).pid


def read_samples(spark: SparkSession, root: str, session_id: str | None = None) -> DataFrame:
    """Samples of all sessions or one; a capture that has written none yet has none."""
    if not _exists(spark, f"{root}/samples"):
        return spark.createDataFrame([], SAMPLES)
    rows = spark.read.schema(f"{SAMPLES}, epoch long").parquet(f"{root}/samples").drop("epoch")
    return rows.where(F.col("session_id") == session_id) if session_id else rows


CHANGES = "session_id string, tag string, ts timestamp, seq long, value_json string, error string, prev_ts timestamp, prev_value_json string, prev_error string, value_changed boolean, error_changed boolean"


class _Changes(StatefulProcessor):
    """Keeps the last sample of a (session, tag); rows wait for the watermark and are taken in the order (ts, seq)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, value_json string, error string", ttlDurationMs=None)
        self.held = handle.getListState("held", "ts timestamp, seq long, value_json string, error string", ttlDurationMs=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.held.appendList([(r.ts.to_pydatetime(), int(r.seq), r.value_json, r.error) for r in pdf.itertuples()])
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, int(pdf.ts.max().timestamp() * 1000)))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.held.get(), key=lambda r: (r[0], r[1]))
        due = [r for r in rows if r[0].timestamp() * 1000 <= mark]
        rest = rows[len(due) :]
        last = self.last.get() if self.last.exists() else None
        out = []
        for ts, seq, value, error in due:
            if last is not None:
                moved, broke = value != last[1], (error or "") != (last[2] or "")
                if moved or broke:
                    out.append((*key, ts, seq, value, error, last[0], last[1], last[2], moved, broke))
            last = (ts, value, error)
        if last is not None:
            self.last.update(last)
        self.held.clear()
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(int(rest[0][0].timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def change_stream(samples: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Change points of a stream of samples; equals the batch operator on the same rows once the watermark has passed."""
    rows = samples.withWatermark("ts", lateness).select("session_id", "tag", "ts", "seq", "value_json", "error")
    return rows.groupBy("session_id", "tag").transformWithStateInPandas(_Changes(), CHANGES, "append", "EventTime")


def latest_stream(samples: DataFrame) -> DataFrame:
    """Running last value of each tag (update or complete output)."""
    return samples.groupBy("session_id", "tag").agg(F.count("*").alias("samples"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"), F.max_by(F.struct("ts", "value_json", "error"), F.struct("ts", "seq")).alias("last")).select("session_id", "tag", "samples", "errors", "last.*")


def window_stream(samples: DataFrame, lateness: str = "10 seconds", width: str = "1 minute") -> DataFrame:
    """Samples, errors and extremes of each tag and window."""
    number = F.col("value_json").try_cast("double")
    return samples.withWatermark("ts", lateness).groupBy(F.window("ts", width), "session_id", "tag").agg(F.count("*").alias("samples"), F.count("error").alias("errors"), F.min(number).alias("min_value"), F.max(number).alias("max_value")).select("window.start", "window.end", "session_id", "tag", "samples", "errors", "min_value", "max_value")
