"""Streaming forms against their batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millwright.operators import series
from millwright.streaming import sessions

BASE = dt.datetime(2024, 1, 1)


def rows(values, tag="t", start=0):
    return [("s", start + i, None, BASE + dt.timedelta(seconds=start + i), start + i, tag, v, "DINT", e) for i, (v, e) in enumerate(values)]


CHANGES = [("0", None), ("0", None), ("1", None), ("1", "bad"), ("1", "bad"), ("2", None)]


def test_change_points_batch(spark):
    df = spark.createDataFrame(rows(CHANGES) + rows(CHANGES[::-1], "u"), sessions.SAMPLES)
    for slot in (None, F.date_trunc("minute", "ts"), F.col("seq") % 1 + F.floor(F.col("seq") / 2)):
        got = series.change_points(df, ["tag"], ["ts", "seq"], "value_json", "error", slot)
        assert sorted((r["tag"], r["cycle"]) for r in got.collect()) == [("t", 2), ("t", 3), ("t", 5), ("u", 1), ("u", 3), ("u", 4)]


def test_summary_and_downsample(spark):
    df = spark.createDataFrame([(i, float(v), e) for i, (v, e) in enumerate([(10, None), (10, None), (12, None), (8, None), (8, "x")])], "seq long, v double, e string").withColumn("tag", F.lit("t"))
    r = series.session_summary(df, ["tag"], ["seq"], "v", "e").first()
    assert (r["samples"], r["errors"], r["n_changes"], r["min_value"], r["max_value"], r["first_change_at"], r["last_error"]) == (5, 1, 3, 8.0, 12.0, 2, "x")
    ramp = spark.range(20).withColumn("tag", F.lit("t"))
    assert [r["id"] for r in series.downsample(ramp, ["tag"], ["id"], 5).orderBy("id").collect()] == [0, 5, 10, 14, 19]
    assert [r["id"] for r in series.downsample(ramp, ["tag"], ["id"], 1).collect()] == [0]
    assert series.downsample(ramp, ["tag"], ["id"], 0).count() == 0 and series.downsample(ramp, ["tag"], ["id"], 99).count() == 20


def test_values(spark):
    from millwright.functions import values

    df = spark.createDataFrame([('{"b": 1, "a": [1.0, true]}',), ('"' + "x" * 400 + '"',), ("[" + ",".join(map(str, range(25))) + "]",), (None,)], "v string")
    got = df.select(values.canonical("v").alias("c"), values.compact("v").alias("s")).collect()
    assert got[0]["c"] == '{"a":[1.0,true],"b":1}' and got[1]["s"] == '"' + "x" * 300 + '..."' and got[2]["s"].endswith('19, {"truncated_items": 5}]') and got[3]["c"] is None
    rows_ = [(i, v, e) for i, (v, e) in enumerate([("10", None), ("9.5", None), ('"zz"', None), ("8", "x"), ("true", None)])]
    r = series.json_summary(spark.createDataFrame(rows_, "seq long, v string, e string").withColumn("tag", F.lit("t")), ["tag"], ["seq"], "v", "e").first()
    assert (r["kind"], r["min_value"], r["max_value"], r["n_changes"], r["errors"]) == ("number", "9.5", "10", 4, 1)


def test_synthetic_and_budget(spark):
    got = {(r["cycle"], r["tag"]): r["value_json"] for r in series.synthetic(spark, ["a", "b"], 4, "DINT", 4, 10.0).collect()}
    assert [got[(c, "a")] for c in range(4)] == ["0", "2", "5", "8"] and got[(3, "b")] == "0"
    assert {r["value_json"] for r in series.synthetic(spark, ["a"], 2, "BOOL").collect()} == {"false", "true"}
    df = spark.createDataFrame([(0, 0, "x" * 6, None), (0, 1, "y" * 6, None), (0, 2, "zz", None), (1, 3, "w" * 6, None)], "cycle long, seq long, v string, e string")
    out = {r["seq"]: (r["v"], r["e"] is not None) for r in series.enforce_budget(df, ["cycle"], ["seq"], "v", "e", 9).collect()}
    assert out == {0: ("x" * 6, False), 1: (None, True), 2: ("zz", False), 3: ("w" * 6, False)}


def test_change_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    every = rows(CHANGES * 3) + rows(CHANGES[::-1] * 3, "u")
    end = [("s", 10_000, None, BASE + dt.timedelta(hours=1), 10_000, "z", "0", "DINT", None)]
    end2 = [("s", 10_001, None, BASE + dt.timedelta(hours=2), 10_001, "z", "0", "DINT", None)]
    src = tmp_path / "in"
    for i, part in enumerate((every[::2], every[1::2], end, end2)):  # rows come late and out of order
        spark.createDataFrame(part, sessions.SAMPLES).coalesce(1).write.mode("append").parquet(str(src / str(i)))
    # One folder after another, so that files are read in this order.
    live = tmp_path / "live"
    live.mkdir()
    stream = spark.readStream.schema(sessions.SAMPLES).parquet(str(live))
    query = sessions.change_stream(stream, "30 seconds").writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i in range(4):
            for f in sorted((src / str(i)).glob("part-*.parquet")):
                (live / f"{i}-{f.name}").write_bytes(f.read_bytes())
            query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r["tag"], r["seq"], r["prev_value_json"], r["value_changed"], r["error_changed"]) for r in spark.table("changes").where("tag <> 'z'").collect())
    batch = series.change_points(spark.createDataFrame(every, sessions.SAMPLES), ["session_id", "tag"], ["ts", "seq"], "value_json", "error")
    assert got == sorted((r["tag"], r["seq"], r["prev_value_json"], r["value_changed"], r["error_changed"]) for r in batch.collect())


def test_capture(spark, tmp_path):
    root = str(tmp_path)
    sessions.create_session(spark, root, "s1", [" a ", "b", "a"])
    with pytest.raises(Exception):
        sessions.create_session(spark, root, "s1", ["a"])
    query = sessions.capture(spark, root, "s1", ["a", "b"], interval_ms=100, seconds=0.5, failing=("b",))
    assert query.awaitTermination(120) and query.exception() is None
    state = sessions.states(spark, root).first()
    assert (state["status"], state["cycles"], state["samples"], state["errors"]) == ("completed", 5, 10, 5) and state["ended_at"]
    sessions.create_session(spark, root, "s2", ["c"])
    long = sessions.capture(spark, root, "s2", ["c"], interval_ms=100, seconds=300)
    sessions.request_stop(spark, root, "s2")  # as another process would
    assert long.awaitTermination(120)
    assert {r["session_id"]: r["status"] for r in sessions.sessions(spark, root).collect()} == {"s1": "completed", "s2": "stopped"}
    assert [r["session_id"] for r in sessions.sessions(spark, root, "stopped").collect()] == ["s2"]
    m = sessions.manifests(spark, root).where("session_id = 's1'").first()
    assert m["limits"]["max_tags"] == 32 and len(m["path_fingerprint"]) == 16
    got = sessions.read_samples(spark, root, "s1")
    assert got.count() == 10 and {r["tag"] for r in got.select("tag").distinct().collect()} == {"a", "b"}
    assert sessions.sessions(spark, root, "completed").first()["requested_tags"] == ["a", "b"]
    for bad in ((50, 1), (100, 0), (100, float("inf")), (100, 301)):
        with pytest.raises(ValueError):
            sessions.check_limits(*bad)
    for bad in ([], [" "], [str(i) for i in range(33)]):
        with pytest.raises(ValueError):
            sessions.normalize_tags(bad)


def test_null_keys_with_and_without_slots(spark):
    """Null is a key like any other, in every form of the operators."""
    from millwright.operators import aggregate, windows

    df = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(20)], "k string, i long").repartition(3)
    hit = F.col("i") == 7
    plain, dealt = (sorted(map(str, windows.neighbourhood(df, ["k"], ["i"], hit, 1, 2, slot).collect())) for slot in (None, F.floor(F.col("i") / 4)))
    assert plain == dealt and len(plain) == 8
    plain, dealt = (sorted(map(str, series.downsample(df, ["k"], ["i"], 5, slot).collect())) for slot in (None, F.floor(F.col("i") / 4)))
    assert plain == dealt and len(plain) == 10
    assert series.downsample(df, ["k"], ["i"], 1).count() == 2
    assert {(r["k"], r["rank"], r["total"]) for r in aggregate.cap_and_count(df, "k", ["i"], 2).collect()} == {(k, r, 20) for k in ("a", None) for r in (1, 2)}
