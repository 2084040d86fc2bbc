"""Versions of a workspace: updates of single projects, readers that hold theirs, ingests that break off; snippets."""

import itertools
import os
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from fixtures import PROJECT
from millwright.operators import search
from millwright.plans.analysis import Analysis
from millwright.sources import workspace
from millwright.sources.workspace import Workspace, WorkspaceError, compact, ingest, versions

WORKS = PROJECT.replace('"Plant"', '"Works"')
CHANGED = WORKS.replace("XIC(Lamp)OTE(Motor);", "XIC(Lamp)XIC(Newcomer)OTE(Motor);")


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Two projects, then a second ingest of one of them."""
    folder = tmp_path_factory.mktemp("grown")
    for name, text in (("plant", PROJECT), ("works", WORKS)):
        (folder / f"{name}.L5X").write_text(text)
    path = str(folder / "w")
    first = ingest(spark, str(folder / "*.L5X"), path)
    files = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(f"{path}/data") for f in (os.path.join(d, n) for n in names)}
    (folder / "works.L5X").write_text(CHANGED)
    second = ingest(spark, str(folder / "works.L5X"), path, update=True)
    return folder, path, first, files, second


def symbols(w, doc="works"):
    return {r["symbol"] for r in w.xrefs.where(f"doc like '%{doc}.L5X'").collect()}


def test_update_of_one_project(spark, grown):
    folder, path, first, files, second = grown
    assert all(os.stat(f).st_mtime_ns == at for f, at in files.items())  # nothing that was there is touched
    assert [len(i["dead"]) for i in second.manifest["ingests"]] == [0, 1] and versions(spark, path) == [1, 2]
    assert "Newcomer" in symbols(second) and "Newcomer" not in symbols(second, "plant") | symbols(first)
    assert second.manifest["controllers"] == ["Plant", "Works"] and second.manifest["fingerprint"] != first.manifest["fingerprint"]
    for name, n in second.manifest["counts"].items():
        assert getattr(second, name).count() == n, name
    assert first.manifest["counts"]["xrefs"] == first.xrefs.count() == second.xrefs.count() - 1  # its reader holds the old version
    key = ["doc", "id"]
    assert second.tags.groupBy(*key).count().where("count > 1").count() == 0


def test_search_after_an_update(grown):
    *_, first, _, second = grown
    found = Analysis(second).search("Newcomer").collect()
    assert found and all(r["doc"].endswith("works.L5X") for r in found) and any("[Newcomer]" in r["snippet"] for r in found)
    assert not any("[Newcomer]" in (r["snippet"] or "") for r in Analysis(first).search("Newcomer").collect())
    a = Analysis(second)
    docs, postings, statistics = second.search_store()
    for query in ("Motor", "start button"):
        want = {r["key"]: r["score"] for r in search.ranked(a.search_documents(), "key", "text", query).collect()}
        assert {r["key"]: r["score"] for r in search.ranked_by_index(docs, postings, "key", query, statistics).collect()} == want


def test_an_ingest_that_breaks_off(spark, grown, monkeypatch):
    folder, path, _, _, second = grown

    def stop(*_, **__):
        raise OSError("no space")

    monkeypatch.setattr(workspace, "write_index", stop)
    with pytest.raises(OSError):
        ingest(spark, str(folder / "plant.L5X"), path)
    assert versions(spark, path) == [1, 2] and Workspace(spark, path).manifest == second.manifest
    with pytest.raises(Exception):  # two ingests cannot publish one version
        workspace.publish(spark, path, second.manifest["ingests"], ["tags"], "s", 1)


def test_compaction_and_old_versions(spark, grown):
    _, path, _, _, second = grown
    rows = lambda w: sorted(map(str, w.xrefs.drop("doc").collect()))
    want, n = rows(second), second.manifest["counts"]
    one = compact(second)
    assert rows(one) == want and one.manifest["counts"] == n and one.manifest["fingerprint"] == second.manifest["fingerprint"] and len(one.manifest["ingests"]) == 1
    assert versions(spark, path) == [2, 3] and rows(second) == want
    with pytest.raises(WorkspaceError):
        Workspace(spark, path, 1)
    assert Analysis(one).exists("Newcomer") > 0


# --- snippets


def test_windows_against_all_windows():
    rng = random.Random(9)
    for _ in range(300):
        lengths = [rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(1, 3))]
        places = [sorted(rng.sample(range(60), rng.randint(0, 6))) for _ in lengths]
        width = rng.randint(4, 20)
        if not any(places):
            assert search.covering_window(places, lengths, width) == (0, width)
            continue

        def shown(first, places=places, lengths=lengths, width=width):
            inside = [sum(first <= at and at + n <= first + width for at in ats) for ats, n in zip(places, lengths)]
            return sum(x > 0 for x in inside), sum(inside)

        first, n = search.covering_window(places, lengths, width)
        assert n == width and shown(first) == max(shown(f) for f in range(0, 64))


@pytest.mark.parametrize("words", [3, 32, 33, 200])
def test_marked_texts(words):
    text = " ".join(f"w{i}" for i in range(words))
    for at in {0, 1, words // 2, words - 1}:
        got = search.marked(text, [[at]], [1])
        assert f"[w{at}]" in got and len(re.findall(r"w\d+", got)) == min(words, 32)
        assert got.startswith(" ... ") == ("w0 " not in got.replace("[w0]", "w0") + " ") and got.endswith(" ... ") == (f"w{words - 1}" not in got)
        assert got.replace("[", "").replace("]", "").strip(" .") in text
    assert search.marked("", [], []) == "" and search.marked("?!", [[0]], [1]) == "?!"
    assert search.marked("Start-Button pressed, start button!", [[0, 3]], [2]) == "[Start-Button] pressed, [start button]!"


def test_snippets_of_stored_postings(spark, tmp_path):
    texts = {i: " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "x", "y", "z"], weights=[1, 1, 1, 20, 20, 20], k=150)) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").withColumns({"kind": search.F.lit("k"), "name": search.F.lit("n")})
    search.write_index(docs, "id", "text", str(tmp_path), partitions=3)
    parts = [spark.read.parquet(f"{tmp_path}/{p}") for p in ("documents", "postings", "statistics")]
    hits = search.search(parts[0], "id", "name", "text", "alpha gamma", None, None, *parts[1:], places=True)
    found = search.snippets(hits, "text", "alpha gamma").collect()
    assert {r["id"] for r in found} == {i for i, t in texts.items() if {"alpha", "gamma"} <= {*t.split()}}
    for r in found:
        words = texts[r["id"]].split()
        best = max(((len({"alpha", "gamma"} & {*w}), sum(x in ("alpha", "gamma") for x in w)) for w in (words[i : i + 32] for i in range(len(words) - 31))))
        shown = [*itertools.chain(*(re.findall(r"\w+", x) for x in re.findall(r"\[(.*?)\]", r["snippet"])))]
        assert (len({*shown}), len(shown)) == best


def long_texts(rows: int) -> list[str | None]:
    """Texts of 4 kB, some short, empty or null, whose terms stand at known places."""
    return [None if i % 500 == 7 else "" if i % 500 == 8 else f"only{i} " * 2 if i % 500 == 9 else f"first{i} " + "alpha beta " * 350 + f"last{i}" for i in range(rows)]


def test_postings_of_a_large_batch():
    """Work and output stay small however many rows of text come in one batch, and no row is lost at a cut."""
    texts = long_texts(4000)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "key": pa.array(range(len(texts)), pa.int64())})
    got, largest = {}, 0
    tracemalloc.start()
    for out in search._postings([batch, batch.slice(0, 0)]):
        largest = max(largest, out.nbytes)
        keys, words, starts = out["key"].to_numpy(), out["term"].to_pylist(), out["positions"].flatten().take(out["positions"].offsets.slice(0, out.num_rows)).to_pylist()
        got |= {(k, w): (n, p) for k, w, n, p in zip(keys.tolist(), words, out["tf"].to_pylist(), starts)}
    peak = tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    want = {}
    for i, t in enumerate(texts):
        for at, w in enumerate((t or "").split()):
            n, first = want.get((i, w), (0, at))
            want[i, w] = n + 1, first
    assert got == want
    assert largest < 8 << 20 and peak < 48 << 20, (largest, peak)


def test_texts_reach_the_index_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"term": pa.array([""]), "key": pa.array([0], pa.int64()), "tf": pa.array([b.nbytes], pa.int64()), "positions": pa.array([[]], pa.list_(pa.int32()))})

    monkeypatch.setattr(search, "_postings", sizes)
    docs = spark.newSession().range(0, 4000, 1, 1).selectExpr("id", "repeat('alpha beta ', 370) AS text")
    found = [r["tf"] for r in search.build_index(docs, "id", "text").collect()]
    assert sum(found) > 16_000_000 and max(found) < 8 << 20


def test_stored_texts_reach_the_postings_in_small_batches(spark, tmp_path, monkeypatch):
    """``write_index`` reads the documents that it stored, many to a file; how it is dealt out does not matter."""
    most = tmp_path / "most"
    most.mkdir()
    make = search._postings

    def seen(batches):
        def noted():
            for k, b in enumerate(batches):
                (most / f"{os.getpid()}-{k}-{b.nbytes}").touch()
                yield b

        yield from make(noted())

    monkeypatch.setattr(search, "_postings", seen)
    session = spark.newSession()
    texts = [t or "" for t in long_texts(3000)]
    docs = session.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    search.write_index(docs, "id", "text", f"{tmp_path}/index", partitions=3)
    assert max(int(p.name.rsplit("-", 1)[1]) for p in most.iterdir()) < 8 << 20
    documents, postings, statistics = (session.read.parquet(f"{tmp_path}/index/{p}") for p in ("documents", "postings", "statistics"))
    assert postings.count() == sum(len({*t.split()}) for t in texts)
    for query in ("alpha", "first1234 last1234"):
        want = {r["id"]: r["score"] for r in search.ranked(docs, "id", "text", query).collect()}
        assert want and {r["id"]: r["score"] for r in search.ranked_by_index(documents, postings, "id", query, statistics).collect()} == want
