"""Two exports with the same names in one workspace: every answer stays within its project."""

import pytest
from fixtures import PROJECT
from millwright.plans.analysis import Analysis
from millwright.sources.workspace import ingest

LONG = "XIC(Lamp)" + "".join(f"XIC(Pad{i:03d})" for i in range(200)) + "XIC(TailTag)OTE(Motor);"
OTHER = PROJECT.replace('"Plant"', '"Works"').replace("XIC(Lamp)OTE(Motor);", LONG).replace('Name="Perm" Usage="Input"', 'Name="Perm" Usage="Output"')


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("two")
    (folder / "plant.L5X").write_text(PROJECT)
    (folder / "works.L5X").write_text(OTHER)
    return Analysis(ingest(spark, str(folder / "*.L5X"), str(folder / "w")))


QUESTIONS = {
    "cross_reference": lambda a: a.cross_reference("Motor", "members"),
    "producers_consumers": lambda a: a.producers_consumers("Lamp"),
    "impact_of": lambda a: a.impact_of("Start", 2),
    "alias_chain": lambda a: a.alias_chain("MotorB"),
    "call_view": lambda a: a.call_view("R1"),
    "scheduling": lambda a: a.scheduling(),
    "device_tree": lambda a: a.device_tree(),
    "resolve_alarm": lambda a: a.resolve_alarm("Alm"),
    "decode_summary": lambda a: a.decode_summary("Alm"),
    "binding_totals": lambda a: a.bindings().select("doc", "instance", "param", "wired", "sources"),
    "equations": lambda a: a.equations(),
    "findings": lambda a: a.findings().drop("total"),
}


@pytest.mark.parametrize("name", sorted(QUESTIONS))
def test_answers_of_one_project(two, plant, name):
    """What a workspace of two projects says of the first is what a workspace of the first alone says."""
    alone, both = QUESTIONS[name](Analysis(plant)), QUESTIONS[name](two)
    plain = lambda frame: sorted(str(r.asDict(True)) for r in frame.drop("doc").collect())
    mine = both.where("doc like '%plant.L5X'")
    assert plain(mine) == plain(alone)
    assert both.where("doc like '%works.L5X'").count() > 0


def test_roles_and_whole_texts(two):
    roles = {(r["doc"].rsplit("/", 1)[1], r["symbol"]): r["access"] for r in two.data.xrefs.where("instruction = 'PUMP' and symbol = 'U1.Run'").collect()}
    assert roles == {("plant.L5X", "U1.Run"): "read", ("works.L5X", "U1.Run"): "write"}
    found = {r["symbol"] for r in two.decode_summary("Motor").where("doc like '%works.L5X'").collect()}
    assert {"Pad000", "Pad199", "TailTag"} <= found
    assert two.data.manifest["controllers"] == ["Plant", "Works"]


def test_stored_search(two):
    """The stored index and a scan of the documents rank alike; kinds and phrases."""
    from millwright.operators import search

    docs, postings, _ = two.data.search_store()
    for query in ("too fast", "Motor", "start button", "Program:Main.Routine:R1", "nothing-of-it"):
        want = {r["key"]: r["score"] for r in search.ranked(two.search_documents(), "key", "text", query).collect()}
        got = {r["key"]: r["score"] for r in search.ranked_by_index(docs, postings, "key", query).collect()}
        assert got == want, query
    assert two.exists("TailTag") > 0 and two.exists("Motor", kinds=["none"]) == 0
    assert {r["kind"] for r in two.search("Motor", kinds=["tag"]).collect()} == {"tag"}
