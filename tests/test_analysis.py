"""Analyses on the small export."""

import pytest

from millwright.plans import answers
from millwright.plans.analysis import Analysis
from millwright.plans.reading_views import views
from millwright.sources.workspace import Workspace, WorkspaceError, find_workspace, newest, read_jsonl, write_jsonl


@pytest.fixture(scope="module")
def a(plant):
    return Analysis(plant)


def rows(frame, *columns):
    return {tuple(r) for r in frame.select(*columns).collect()}


def test_references(a):
    found = a.cross_reference("motor", destructive=True).collect()
    assert {r["routine_name"] for r in found} == {"R1", "S1", "R9"} and all(r["destructive"] for r in found)
    assert any("OTE(Motor)" in r["snippet"] for r in found)
    assert {r["symbol"] for r in a.references("U1").collect()} == {"U1.Run", "U1.Spd"}
    facets = {(r["facet"], r["key"]): r["n"] for r in a.reference_facets("Motor", "exact").collect()}
    assert facets[("access", "write")] == 3
    roles = rows(a.producers_consumers("Lamp"), "role", "routine_name")
    assert roles == {("producer", "R1"), ("producer", "F1"), ("consumer", "R9")}


def test_graphs(a):
    impact = rows(a.impact_of("Start", 2), "kind", "id", "depth")
    assert ("tag", "Motor", 1) in impact and ("routine", "Program:Main.Routine:R1", 1) in impact and ("routine", "Program:Idle.Routine:R9", 2) in impact
    assert rows(a.alias_chain("MotorB"), "name") == {("Motor",), ("MotorA",), ("MotorB",)}
    assert a.io_trace("MotorB")["references"].count() == a.references("Motor").count()
    assert rows(a.call_view("R1"), "direction", "type", "name") == {("callee", "routine", "R2"), ("callee", "aoi", "PUMP")}
    assert rows(a.call_view("R2"), "direction", "name") == {("caller", "Program:Main.Routine:R1"), ("caller", "Program:Main.Routine:F1")}
    assert rows(a.scheduling(), "program", "task") == {("Main", "T1"), ("Idle", None)}
    assert rows(a.device_tree(), "name", "root", "depth", "orphan") == {("Local", "Local", 0, False), ("Adapter", "Local", 1, False), ("Adapter:4", "Local", 2, False), ("Stray", "Stray", 0, True)}


def test_diagrams(a):
    sheet = "Program:Main.Routine:F1.Sheet:"
    assert rows(a.sheet_equations(sheet + "1"), "kind", "target", "expr") == {("block_output", "AND_01.Out", "Start AND Motor"), ("connector_source", 'net "both"', "AND_01.Out")}
    got = rows(a.sheet_equations(sheet + "2"), "kind", "target", "expr")
    assert got == {("connector_source_remote", 'net "both"', "AND_01.Out"), ("jsr_call", "JSR:4", "R2"), ("oref_write", "Lamp", "P1.Sts"), ("aoi_input", "P1.EnableIn", "UNWIRED"), ("aoi_input", "P1.Cmd", 'net "both"'), ("aoi_input", "P1.Perm", "UNWIRED"), ("aoi_output", "Lamp", "P1.Sts")}
    assert rows(a.binding_totals(), "total", "wired", "required_unwired") == {(4, 2, 1)}
    paths = {tuple(x.split("#")[1] for x in r["path"]): r["state"] for r in a.trace_upstream("Lamp", 6).collect()}
    assert paths[("2", "1", "0", "3", "2", "0")] == "leaf" and paths[("2", "1", "0", "3", "2", "1")] == "leaf"
    assert a.sheet_summary().where("aois = 1").count() == 1


def test_sheet_answers(a):
    f1 = "Program:Main.Routine:F1"
    one = answers.sheet_answer(a, f1, sheet=2)
    assert one["status"] == "ok" and "Lamp := P1.Sts" in one["equations"] and "CALL R2" in one["equations"]
    assert one["summary"]["aois"] == 1 and one["summary"]["jsr_calls"] == 1 and {p["param"] for p in one["unwired_pins"]} == {"EnableIn", "Perm"}
    assert one["output_tags"] == ["Lamp"] and one["aoi_instances"][0]["instance"] == "P1"
    assert answers.sheet_answer(a, f1)["status"] == "needs_sheet" and len(answers.sheet_answer(a, f1)["sheets"]) == 3
    assert answers.sheet_answer(a, f1, sheet=3)["status"] == "empty_sheet"
    assert answers.sheet_answer(a, f1, sheet=1, form="drawing")["status"] == "unsupported_form"
    assert "equations" not in answers.sheet_answer(a, routine="F1", program="Main", sheet=1, form="summary")
    assert answers.sheet_answer(a, routine="R1")["status"] == "not_fbd" and not answers.sheet_answer(a, routine="none")["found"]
    assert len(answers.sheet_answer(a, f1, sheet=2, limit=1)["equations"]) == 1


def test_trace_answers(a):
    lamp = answers.trace_answer(a, "Lamp", max_depth=6)
    assert lamp["status"] == "ok" and {p["leaf_operand"] for p in lamp["paths"]} == {"Start", "Motor"} and not lamp["unresolved"]
    assert any("OTE(Lamp)" in u["text"] for u in lamp["units"]) and any(e["target"] == "Lamp" for e in lamp["pseudo_equations"])
    assert {u["reason"] for u in answers.trace_answer(a, "Lamp", max_depth=1)["unresolved"]} == {"max_depth"}
    assert answers.trace_answer(a, "Lamp", "downstream")["status"] == "limited"
    assert answers.trace_answer(a, "Nothing")["status"] == "unresolved"
    report, page = answers.diagnostics_report(a)
    assert report["by_rule"]["broken_alias"] == 1 and "| error | broken_alias | Bad |" in page


def test_alarms(a):
    alarm = a.resolve_alarm("zu schnell").first()
    assert (alarm["tag_name"], alarm["source_tags"], alarm["status"]) == ("Alm", ["Speed"], "plc_logic_found")
    members = {r["symbol"]: r for r in a.decode_summary("Alm").collect()}
    assert members["Speed"]["alarms"] == ["Alarm:Alm:AlarmDigital"] and members["Start"]["references"] >= 4


def test_slices_and_search(a):
    r1 = "Program:Main.Routine:R1"
    assert [r["number"] for r in a.routine_slice(r1, unit_id=r1 + ".Rung:2", before=1, after=0).collect()] == ["1", "2"]
    assert [r["number"] for r in a.routine_slice(r1, query="start it", before=0, after=1).collect()] == ["0", "1"]
    assert a.sfc_chart("Program:Main.Routine:S1").where("ambiguous").count() == 2
    assert a.sfc_chart("Program:Main.Routine:S1", "Pending").count() == 1
    hits = a.search("too fast").collect()
    assert hits and all("too fast" in h["text"] for h in hits)
    assert a.search("tooth").count() == 0 and a.search("oo fas").count() > 0
    assert rows(a.suggestions("motor"), "name") == {("Motor",), ("MotorA",), ("MotorB",)}
    fragment = a.data.source_fragments.where("element = 'Trends'").first()
    assert a.source_fragment(fragment["id"], 3).first()["raw_xml"] == "<Tr"
    found = a.triage("Why does Motor stop when Speed is high on the screen")
    assert {r["name"] for r in found["names"].collect()} == {"Motor", "Speed"}
    context = {r["name"]: r for r in found["context"].collect()}["Motor"]
    refs = a.data.xrefs.where("base_symbol = 'Motor'").collect()
    assert context["references"] == len(refs) and context["exact_references"] == sum(r["symbol"] == "Motor" for r in refs) and context["trace_status"] == "ok"
    assert context["writers"] >= 2 and context["first_writer"]["routine"] and 0 < len(context["evidence"]) <= 3 and context["evidence"][0]["snippet"]
    assert a.scope_limits("the HMI screen is slow") == ["read_only_offline_export_only", "needs_hmi_export_or_runtime"]
    assert a.tag_bundle("Start")["tag_comments"].count() == 2
    assert a.module_bundle("Adapter:4")["io_points"].count() == 2
    assert a.aoi_bundle("Pump")["parameters"].count() == 4


def test_findings(a):
    got = rows(a.findings(), "rule", "severity", "entity")
    for want in [("multiple_output", "warning", "Motor"), ("multiple_output", "warning", "Lamp"), ("read_never_written", "info", "Ghost"), ("read_never_written", "info", "Start"), ("written_never_read", "info", "Local1"), ("broken_alias", "error", "Bad"), ("unscheduled_program", "warning", "Idle"), ("inhibited_or_faulted_module", "warning", "Adapter"), ("aoi_never_instantiated", "info", "Spare"), ("udt_never_used", "info", "LostT")]:
        assert want in got, (want, got)
    assert not any(r[0] == "alarm_tag_unknown" or r[2] in ("MotorA", "Pump", "UnitT") for r in got)
    assert {r[0] for r in rows(a.findings(severity="error"), "rule")} == {"broken_alias"}


def test_workspace(spark, a, tmp_path):
    import os

    w = a.data
    assert w.manifest["controllers"] == ["Plant"] and w.manifest["counts"]["tags"] == w.tags.count() and len(w.manifest["counts"]) == 40
    assert w.dataset("symbols", "udt").count() == 2
    with pytest.raises(WorkspaceError):
        Workspace(spark, str(tmp_path / "none"))
    write_jsonl(w.tags.select("name", "description", "comment_count", "data_formats"), str(tmp_path / "t"))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert '{"name":"Motor","comment_count":0}' in text
    torn = tmp_path / "s.jsonl"
    torn.write_text('{"a":1}\n{"a":2}\n{"a":')
    assert {r["a"] for r in read_jsonl(spark, str(torn), "a int").where("a is not null").collect()} == {1, 2}
    assert read_jsonl(spark, str(tmp_path / "no.jsonl"), "a int").count() == 0
    assert w.manifest["export_date"] == "Tue Jan 02 10:00:00 2024" and read_jsonl(spark, str(torn.with_suffix("")), "a int").count() > 0
    above = os.path.dirname(w.path)
    assert find_workspace(spark, above).endswith(os.path.basename(w.path)) and find_workspace(spark, above, w.path) == w.path
    with pytest.raises(WorkspaceError):
        find_workspace(spark, str(tmp_path))
    with pytest.warns(UserWarning, match="later export"):
        find_workspace(spark, above, "/elsewhere/old")
    rows = [("p1", "Tue Jan 02 10:00:00 2024", "x"), ("p2", "Wed Feb 07 09:00:00 2024", "a"), ("p3", None, "z")]
    assert newest(spark.createDataFrame(rows, "path string, export_date string, fingerprint string")).first()[0] == "p2"
    pages = {r["name"]: r["body"] for r in views(w).collect()}
    assert "| Motor | BOOL |" in pages["tags/Controller_Plant.md"] and {n.split("/")[0] for n in pages} >= {"routines", "modules", "tasks", "programs", "comments", "charts", "messages", "coverage", "types"}
