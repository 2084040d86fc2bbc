"""The tag data source: batch and stream, offsets, replays, foreign readers; exactly-once samples; leases."""

import datetime as dt
import os
import signal
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millwright.operators import series
from millwright.sources import tags
from millwright.streaming import sessions

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import the tests
STARTED = "2024-01-01T00:00:00Z"


class Device(tags.TagReader):
    """A reader as another package would register it: objects instead of mappings, other names, a cycle that fails."""

    def open(self):
        self.ready = True

    def close(self):
        self.ready = False

    def identity(self):
        return {"name": "device"}

    def read(self, wanted, cycle):
        assert self.ready
        if cycle == 2:
            raise OSError("no answer")
        for _, tag in wanted:
            if tag != "silent":
                yield type("Answer", (), {"tag": tag.upper() if tag == "other" else tag, "value": {"n": cycle, "at": dt.datetime(2024, 1, 1, tzinfo=dt.UTC)}, "type": "UDT", "error": None})()


@pytest.fixture(autouse=True)
def device():
    tags.register_reader("device", Device)


def test_batch_equals_the_column_form(spark):
    for kind in ("DINT", "BOOL"):
        got = tags.read_tags(spark, "simulated", ["a", "b", "c"], cycles=25, kind=kind, period=4, started=STARTED, interval_ms=500, partitions=2)
        want = series.synthetic(spark, ["a", "b", "c"], 25, kind, 4, 10.0)
        row = lambda r: (r["cycle"], r["tag"], r["value_json"], r["type"])
        assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))
    r = got.where("cycle = 3 and tag = 'b'").first()
    assert r["ts_utc"] == "2024-01-01T00:00:01.500000Z" and r["seq"] == 3 * tags.MOST_TAGS + 1
    assert got.rdd.getNumPartitions() == 2


def test_names_and_options(spark):
    with pytest.raises(ValueError, match="no reader 'pycom'"):
        tags.read_tags(spark, "pycom", ["a"], cycles=1)
    with pytest.raises(Exception, match="no reader"):
        spark.read.format("tags").option("source", "nobody").option("tags", '["a"]').option("cycles", "1").load().collect()
    with pytest.raises(Exception, match="needs the option cycles"):
        tags.read_tags(spark, "simulated", ["a"]).collect()


def test_device_reader(spark):
    got = {(r["cycle"], r["tag"]): r for r in tags.read_tags(spark, "device", ["a", "silent", "b"], cycles=3, started=STARTED).collect()}
    assert got[0, "a"]["value_json"] == '{"n":0,"at":"2024-01-01T00:00:00.000000Z"}' and got[1, "b"]["type"] == "UDT"
    assert got[0, "silent"]["error"] == "missing tag result" and got[0, "silent"]["value_json"] is None
    assert {got[2, t]["error"] for t in ("a", "silent", "b")} == {"no answer"}


def test_samples_of_any_form():
    assert tags.normalized({"tag": 5, "value": float("nan")}) == tags.Sample("5", '"nan"', None, None)
    assert tags.normalized({"tag": "a", "value": ({1, 2}, b"x", dt.date(2024, 1, 2))}).value_json == '[[1,2],"b\'x\'","2024-01-02"]'
    for bad in ({"value": 1}, {"tag": ""}):
        with pytest.raises(ValueError):
            tags.normalized(bad)
    found = tags.matched(["a", "b"], [{"tag": "A", "value": 1}, {"tag": "b", "value": 2}])
    assert [(s.tag, s.value_json) for s in found] == [("A", "1"), ("b", "2")]


def test_foreign_logs(spark):
    now = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)
    df = spark.createDataFrame([("a", 'say "x"', "2024-01-01T00:00:01Z"), ("b", None, None)], "tag string, value string, ts_utc string")
    a, b = tags.normalized_samples(df, now).orderBy("tag").collect()
    assert a["value_json"] == '"say \\"x\\""' and a["ts_utc"] == "2024-01-01T00:00:01.000000Z" and a["cycle"] is None
    assert b["value_json"] is None and b["ts_utc"] == "2024-05-01T00:00:00.000000Z" and b["error"] is None
    nested = spark.createDataFrame([("a", (1, [True]))], "tag string, value struct<n: int, l: array<boolean>>")
    assert tags.normalized_samples(nested, now).first()["value_json"] == '{"n":1,"l":[true]}'
    assert tags.normalized_samples(spark.createDataFrame([("a", 2.5)], "tag string, value double"), now).first()["value_json"] == "2.5"
    with pytest.raises(Exception, match="a sample needs a tag"):
        tags.normalized_samples(spark.createDataFrame([("", 1)], "tag string, value int")).collect()


def run_stream(frame, out, checkpoint):
    query = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
    return query


def test_a_restarted_stream_goes_on(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    started = tags.utc_text(dt.datetime.now(dt.UTC))
    options = dict(cycles=40, interval_ms=100, started=started, partitions=2)
    first = run_stream(tags.stream_tags(spark, "simulated", ["a", "b"], **options), out, checkpoint)
    until = time.time() + 60
    while not (first.lastProgress and first.lastProgress["sources"][0]["endOffset"]) and time.time() < until:
        time.sleep(0.2)
    first.stop()
    again = run_stream(tags.stream_tags(spark, "simulated", ["a", "b"], **options), out, checkpoint)
    try:
        while time.time() < until and spark.read.schema(tags.COLUMNS).parquet(out).agg(F.max("cycle")).first()[0] != 39:
            time.sleep(0.5)
    finally:
        again.stop()
    row = lambda r: (r["seq"], r["ts"], r["cycle"], r["tag"], r["value_json"])
    got = sorted(map(row, spark.read.parquet(out).collect()))
    want = sorted(map(row, tags.read_tags(spark, "simulated", ["a", "b"], **options).collect()))
    assert got == want and len(got) == 80


def test_recorded_log_is_replayed(spark, tmp_path):
    root = str(tmp_path)
    for sid in ("s1", "2"):
        rows = tags.read_tags(spark, "simulated", ["a", "b"], cycles=6, period=5 if sid == "2" else 3, started=STARTED).withColumn("session_id", F.lit(sid))
        for epoch in (0, 1):
            sessions.append_epoch(rows.where(F.floor(F.col("cycle") / 3) == epoch), root, sid, epoch)
    assert sessions.read_samples(spark, root, "2").count() == 12  # a session's name is text
    log = dict(path=f"{root}/samples", session_id="2", started=STARTED)
    want = sorted((r["cycle"], r["tag"], r["value_json"]) for r in sessions.read_samples(spark, root, "2").collect())
    got = tags.read_tags(spark, "recorded", ["b", "a"], **log, partitions=2)
    assert sorted((r["cycle"], r["tag"], r["value_json"]) for r in got.collect()) == want
    query = tags.stream_tags(spark, "recorded", ["a", "b", "none"], **log).writeStream.format("memory").queryName("replay").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    replay = spark.table("replay")
    assert sorted((r["cycle"], r["tag"], r["value_json"]) for r in replay.where("tag <> 'none'").collect()) == want
    assert {r["error"] for r in replay.where("tag = 'none'").collect()} == {"missing tag result"}
    tags.read_tags(spark, "simulated", ["a"], cycles=2, started=STARTED).select("cycle", "tag", "value_json").write.json(str(tmp_path / "j"))
    assert tags.read_tags(spark, "recorded", ["a"], path=str(tmp_path / "j"), log_format="json").count() == 2


def test_an_epoch_again_replaces_itself(spark, tmp_path):
    root = str(tmp_path)
    rows = tags.read_tags(spark, "simulated", ["a"], cycles=4, started=STARTED).withColumn("session_id", F.lit("s"))
    for epoch in (0, 1, 1, 0):
        sessions.append_epoch(rows.where(F.col("cycle").between(2 * epoch, 2 * epoch + 1)), root, "s", epoch)
        sessions.write_state(spark, root, "s", sessions.RUNNING, epoch + 1, samples=2 * (epoch + 1))
    got = sessions.read_samples(spark, root, "s")
    assert got.count() == 4 == got.select("seq").distinct().count()
    assert sessions.states(spark, root).first()["samples"] == 4
    for version in range(2, 9):
        sessions.write_state(spark, root, "s", sessions.RUNNING, version)
    assert len(os.listdir(f"{root}/states/s")) == sessions.KEEP_STATES and sessions.states(spark, root, "s").first()["version"] == 8


def test_a_lease_that_runs_out(spark, tmp_path):
    root = str(tmp_path)
    sessions.write_state(spark, root, "gone", sessions.RUNNING, 1, lease=-1)
    sessions.write_state(spark, root, "there", sessions.RUNNING, 1)
    sessions.write_state(spark, root, "over", sessions.COMPLETED, 1, lease=-1)
    found = {r["session_id"]: r for r in sessions.states(spark, root).collect()}
    assert {k: r["status"] for k, r in found.items()} == {"gone": "failed", "there": "running", "over": "completed"}
    assert found["gone"]["ended_at"] and "lease" in found["gone"]["error"]


def test_a_capture_that_fails_says_so(spark, tmp_path):
    root = str(tmp_path)
    query = sessions.capture(spark, root, "s", ["a"], interval_ms=100, seconds=100, source="recorded", path=str(tmp_path / "nowhere"), lease=6)
    with pytest.raises(Exception):
        query.awaitTermination(60)
    until = time.time() + 30
    while time.time() < until and sessions.states(spark, root, "s").first()["status"] == "running":
        time.sleep(0.5)
    assert sessions.states(spark, root, "s").first()["status"] == "failed"


def test_a_killed_process_reads_as_failed(spark, plant, tmp_path, monkeypatch):
    """The capture runs in a process of its own and is seen to die."""
    root = str(tmp_path / "r")
    monkeypatch.setenv("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    pid = sessions.capture_process(plant.path, "own", ["a"], 200, 120, runtime=root)
    try:
        until = time.time() + 120
        while time.time() < until and (sessions.states(spark, root, "own").first() or {"samples": 0})["samples"] < 1:
            time.sleep(1)
        state = sessions.states(spark, root, "own").first()
        assert state["status"] == "running" and state["samples"] > 0
    finally:
        os.kill(pid, signal.SIGKILL)
    until = time.time() + sessions.LEASE_SECONDS + 20
    while time.time() < until and sessions.states(spark, root, "own").first()["status"] == "running":
        time.sleep(1)
    assert sessions.states(spark, root, "own").first()["status"] == "failed"
    assert [r["session_id"] for r in sessions.sessions(spark, root, "failed").collect()] == ["own"]
