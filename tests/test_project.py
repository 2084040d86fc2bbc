"""Project scan and datasets on a small export."""

import pytest

from fixtures import PROJECT
from millwright.functions import ladder
from millwright.plans.project import Project
from millwright.sources.project import ProjectFormatError, nodes_of


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("export")
    (folder / "plant.L5X").write_text(PROJECT)
    return Project.load(spark, str(folder / "*.L5X"))


def rows(frame, *columns):
    return {tuple(r) for r in frame.select(*columns).collect()}


def one(frame, where, *columns):
    found = frame.where(where).select(*columns).collect()
    assert len(found) == 1, found
    return tuple(found[0])


def test_scan_rejects_other_files():
    for content in (b"<a/>", b"<RSLogix5000Content><X/></RSLogix5000Content>", b"<broken"):
        with pytest.raises(ProjectFormatError):
            list(nodes_of("x", content))


def test_intervals_and_paths():
    found = sorted(nodes_of("x", PROJECT.encode()), key=lambda r: r["pre"])
    by = {r["pre"]: r for r in found}
    for r in found:
        if r["parent_pre"] is not None:
            p = by[r["parent_pre"]]
            assert p["pre"] < r["pre"] and r["post"] < p["post"] and r["anc"][-1]["pre"] == p["pre"]
    assert any(r["path_p"].endswith("Tags/Tag[@Name='Start']/Comments[1]/Comment[@Operand='.x']") or "Comment[@Operand='.x']" in r["path_p"] for r in found)


def test_tags_types_and_programs(project):
    assert rows(project.tags.where("scope_type <> 'Controller'"), "id") == {("Program:Main.Local1",), ("AOI:Pump.Tmr",)}
    assert one(project.tags, "name = 'Start'", "id", "description", "comment_count") == ("Controller:Start", "start button", 2)
    assert one(project.tags, "name = 'U1'", "data_formats") == (["L5K", "Decorated"],)
    assert [m["name"] for m in one(project.data_types, "name = 'UnitT'", "members")[0]] == ["Run", "Spd"]
    assert one(project.tasks, "true", "id", "scheduled_programs") == ("Task:T1", ["Main"])
    assert rows(project.program_children, "id") == {("ProgramChild:Main:Idle",)}
    assert one(project.aoi_signatures(), "instruction = 'PUMP'", "aoi_roles") == (["read", "read", "write"],)
    assert one(project.aoi_signatures(required_only=True), "instruction = 'PUMP'", "aoi_roles") == (["read", "read"],)


def test_comments_data_alarms(project):
    assert {("Start.x", "bit x"), ("Start[0].y", "deep y")} == rows(project.tag_comments, "target", "text")
    assert one(project.comments, "text = 'start button'", "kind", "target") == ("description", "Start")
    assert project.tag_data.count() == 4
    values = rows(project.data_values(), "level", "element")
    assert {(0, "Structure"), (1, "DataValueMember"), (2, "Element")} <= values
    assert any(r["depth_truncated"] for r in project.data_values(1).collect())
    assert rows(project.messages, "message_type", "lang", "text") == {("CAM", "en", "too fast"), ("CAM", "de", "zu schnell"), ("X", None, None)}
    alarm = project.alarms.first()
    assert (alarm["id"], alarm["alarm_class"], alarm["severity"], alarm["assoc_tags"], len(alarm["messages"])) == ("Alarm:Alm:AlarmDigital", "Process", "500", ["Speed"], 3)
    assert rows(project.produce_consume, "direction", "rpi") == {("produced", "5")}


def test_hardware(project):
    assert rows(project.modules, "name", "name_source", "slot", "network_address") == {("Local", "Name", "0", None), ("Adapter", "Name", "3", "10.0.0.5"), ("Adapter:4", "generated", "4", None), ("Stray", "Name", None, None)}
    assert rows(project.module_connections, "module", "kind", "rpi") == {("Adapter", "connection", "20"), ("Adapter:4", "rack_connection", None)}
    assert rows(project.module_io_tags, "id") == {("Module:Adapter.IOTag:Input:0",), ("Module:Adapter.IOTag:Output:1",), ("Module:Adapter:4.IOTag:Config:0",), ("Module:Adapter:4.IOTag:InAlias:1",)}
    assert rows(project.module_io_points, "operand", "point", "direction", "description", "tag_description") == {(".0", 0, "input", "door shut", "inputs"), (".DATA[3]", 3, "input", "level ok", "inputs")}
    assert one(project.engineering_units, "true", "operand", "point", "engineering_unit") == ("CH0", 0, "bar")
    assert one(project.message_parameters, "true", "tag_name", "service_code") == ("Msg", "16#0e")


def test_ladder_calls():
    calls = ladder.ladder_calls("XIC(A[1,2])MOV('x,)',B)CPT(C,MUL(D,E)+1)OTE(")
    assert [(c["instruction"], c["args"]) for c in calls] == [("XIC", ["A[1,2]"]), ("MOV", ["x,)", "B"]), ("CPT", ["C", "MUL(D,E)+1"])]
    assert ladder.ladder_calls("NOP()")[0]["args"] == []
    assert calls[0]["span"] == [0, 11]
    assert len({name for name, _, _ in ladder.OPERAND_ROLES}) == 93


def test_units_and_references(project):
    assert rows(project.routines.where("program = 'Main'"), "id", "language") == {(f"Program:Main.Routine:{n}", k) for n, k in (("R1", "RLL"), ("R2", "ST"), ("F1", "FBD"), ("S1", "SFC"))}
    body = one(project.routines, "name = 'R1'", "body", "unit_count")
    assert body[0].startswith("RUNG 0\nCOMMENT: start it\nXIC(Start)") and body[1] == 4
    x = project.xrefs
    r1 = rows(x.where("routine_name = 'R1'"), "symbol", "access", "instruction", "confidence", "source")
    rung = "Program:Main.Routine:R1.Rung:"
    for want in [("Start", "read", "XIC", "typed", rung + "0"), ("Motor", "write", "OTE", "typed", rung + "0"), ("Motor", "read", "XIC", "typed", rung + "0"), ("Target", "write", "MOV", "typed", rung + "1"), ("R2", "call", "JSR", "typed", rung + "2"), ("P1", "read_write", "PUMP", "typed", rung + "2"), ("Start", "read", "PUMP", "typed", rung + "2"), ("Lamp", "write", "PUMP", "typed", rung + "2"), ("Alm.InAlarm", "write", "ALMD", "typed", rung + "2"), ("Target", "write", "BTD", "typed", rung + "3"), ("Local1", "write", "CPT", "typed", rung + "3")]:
        assert want in r1, want
    assert not any(r[0] == "skip" for r in r1)
    st = rows(x.where("routine_name = 'R2'"), "symbol", "access", "instruction")
    assert st == {("Speed", "write", "ST_ASSIGN"), ("Target", "read", "ST"), ("U1.Spd", "read", "ST"), ("U1.Run", "write", "ST_ASSIGN"), ("Motor", "read", "ST")}
    fbd = rows(x.where("routine_name = 'F1'"), "symbol", "access", "instruction")
    assert fbd == {("Start", "read", "FBD_IRef"), ("Motor", "read", "FBD_IRef"), ("AND_01", "read_write", "FBD_Block"), ("P1", "read_write", "FBD_AddOnInstruction"), ("Lamp", "write", "FBD_ORef"), ("R2", "call", "FBD_JSR")}
    sfc = rows(x.where("routine_name = 'S1' and content_index = 0"), "symbol", "access", "instruction")
    assert {("Motor", "write", "ST_ASSIGN"), ("Start", "read", "ST"), ("Speed", "read", "SFC_ST"), ("Step_0", "read_write", "SFC_OPERAND"), ("Step_7", "read_write", "SFC_OPERAND")} <= sfc


def test_diagrams_and_charts(project):
    assert rows(project.fbd_sheets, "number", "node_count", "wire_count") == {("1", 5, 3), ("2", 4, 2), ("3", 0, 0)}
    assert one(project.fbd_wires, "id like '%Wire:0003'", "sheet_number") == ("2",)
    assert rows(project.sfc_charts, "id", "online_edit_type", "node_count", "link_count", "branch_count", "leg_count") == {("Program:Main.Routine:S1.SFC", "Original", 5, 1, 1, 2), ("Program:Main.Routine:S1.SFC:1", "Pending", 1, 0, 0, 0)}
    assert one(project.sfc_nodes, "operand = 'Step_7'", "parent_branch_id", "parent_leg_id") == ("5", "6")
    assert rows(project.sfc_legs, "id", "sequence") == {("Program:Main.Routine:S1.SFC.Branch:5.Leg:6", 0), ("Program:Main.Routine:S1.SFC.Branch:5.Leg:8", 1)}


def test_derived_datasets(project):
    kinds = {r["kind"] for r in project.edges.select("kind").distinct().collect()}
    assert kinds == {"scheduled_program", "contains", "xref", "fbd_wire", "sfc_link", "program_child"}
    frames = project.datasets()
    assert len(frames) >= 39
    assert frames["source_fragments"].where("coverage_mode = 'raw_preserved'").count() == 2
    assert {"tag", "udt", "aoi", "module", "task", "program", "aoi_parameter"} == {r["kind"] for r in project.symbols.select("kind").distinct().collect()}
    assert project.entities.where("kind = 'routine'").count() == 6
    surfaces = {r["surface"]: (r["source_count"], r["covered_count"], r["missing_count"]) for r in project.coverage().collect()}
    assert surfaces.pop("unknown_elements") == (1, 0, 1)
    assert all(v[2] == 0 for v in surfaces.values()), surfaces
