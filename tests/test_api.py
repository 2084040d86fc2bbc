"""The tools within their budget, and the command line."""

import json

import pytest

from millwright import cli
from millwright.api import PAYLOAD, TOOLS, Tools

CALLS = {
    "get_tag": {"name": "Start"}, "get_udt": {"name": "UnitT"}, "get_program": {"name": "Main"}, "get_routine": {"name": "R1"}, "get_aoi": {"name": "Pump"}, "get_tag_context": {"name": "Start"}, "get_routine_context": {"routine_id": "Program:Main.Routine:F1"},
    "get_aoi_context": {"name": "Pump"}, "get_module_context": {"name": "Adapter"}, "get_entity": {"entity_id": "Program:Main"}, "search_entities": {"query": "pump"}, "search_logic": {"pattern": "MOV("}, "search_project": {"query": "too fast"},
    "get_sfc_chart": {"routine_id": "Program:Main.Routine:S1"}, "get_source_fragment": {"anchor": "xml:none"}, "exists": {"query": "Start"}, "get_operand_context": {"operand": "Motor"}, "get_routine_slice": {"routine_id": "Program:Main.Routine:R1"},
    "get_fbd_sheet": {"sheet_id": "Program:Main.Routine:F1.Sheet:2"}, "cross_reference": {"symbol": "Motor"}, "find_references": {"symbol": "U1"}, "trace_signal": {"symbol": "Lamp"}, "triage_issue": {"issue_text": "Motor stops"}, "resolve_alarm": {"name": "Alm"},
    "decode_summary": {"tag": "Alm"}, "aoi_instance_bindings": {"instance": "p1"}, "tag_producers_consumers": {"name": "Lamp"}, "impact_of": {"name": "Start"}, "io_trace": {"name": "MotorB"}, "read_tags_now": {"tags": ["a"]},
}
RUNTIME = {"runtime_evidence_summary", "start_runtime_capture", "runtime_capture_status", "stop_runtime_capture", "list_runtime_sessions", "read_runtime_stream_slice", "runtime_change_points"}


@pytest.fixture(scope="module")
def tools(spark, plant):
    return Tools(spark, plant.path)


def test_fifty_tools():
    assert len(TOOLS) == 50


def test_all_calls_within_budget(tools):
    for name in TOOLS:
        if name not in RUNTIME:
            out = tools.call(name, **CALLS.get(name, {}))
            assert len(json.dumps(out)) <= PAYLOAD, name
    assert tools.call("get_sfc_chart", routine_id="Program:Main.Routine:S1")["status"] == "needs_variant"
    assert tools.call("get_tag", name="Moto")["suggestions"] == ["Motor", "MotorA", "MotorB"]
    assert tools.call("run_diagnostics", severity="error")["by_rule"] == {"broken_alias": 1}
    start = tools.call("get_tag_context", name="Start")
    assert {tuple(sorted(x)) for x in start["comments"]["items"]} == {("target", "text")} and start["comments"]["limit"] == 5
    assert tools.call("get_tag_context", name="Start", detail="detail")["references"]["limit"] == 50
    with pytest.raises(ValueError):
        tools.call("get_tag_context", name="Start", detail="none")
    with pytest.raises(ValueError):
        tools.call("read_tags_now", tags=["a"], source="device")
    page = tools.call("list_tags", limit=3, offset=2)
    assert len(page["items"]) == 3 and page["has_more"] and page["total"] == 16


def test_runtime_tools(tools):
    sid = tools.call("start_runtime_capture", tags=["a"], interval_ms=100, session_id="s9")["session_id"]
    while len(tools.captures[sid].recentProgress) < 3:
        tools.captures[sid].awaitTermination(1)
    assert tools.call("runtime_capture_status", session_id=sid)["status"] == "running"
    assert tools.call("stop_runtime_capture", session_id=sid)["status"] == "stopped"
    assert tools.call("list_runtime_sessions", status="running")["total"] == 0
    assert tools.call("list_runtime_sessions")["total"] == 1
    assert tools.call("read_runtime_stream_slice", session_id=sid, tag="a", max_points=2)["total"] == 2
    assert tools.call("runtime_evidence_summary")["items"][0]["tag"] == "a"
    assert tools.call("runtime_change_points", session_id=sid)["total"] >= 0


def test_command_line(tools, capsys):
    assert len(cli.COMMANDS) + 3 == 25
    assert cli.main(["xref", "--workspace", tools.data.path, "--symbol", "Motor", "--destructive", "true"]) == 0
    assert json.loads(capsys.readouterr().out)["total"] == 3
