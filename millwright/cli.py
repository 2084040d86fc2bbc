"""Command line: ``python -m millwright.cli <command> --workspace PATH [--key value ...]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from millwright.api import TOOLS, Tools
from millwright.sources.workspace import Workspace, ingest

COMMANDS = {
    "search": "search_project", "exists": "exists", "operand": "get_operand_context", "routine-slice": "get_routine_slice", "fbd-sheet": "get_fbd_sheet", "xref": "cross_reference", "trace": "trace_signal",
    "triage": "triage_issue", "scope": "scope_metadata", "resolve-alarm": "resolve_alarm", "decode-summary": "decode_summary", "aoi-bindings": "aoi_instance_bindings", "sdk-status": "sdk_status", "runtime-summary": "runtime_evidence_summary",
    "runtime-read-now": "read_tags_now", "runtime-capture-start": "start_runtime_capture", "runtime-capture-run": "start_runtime_capture", "runtime-capture-status": "runtime_capture_status", "runtime-capture-stop": "stop_runtime_capture",
    "runtime-sessions": "list_runtime_sessions", "runtime-slice": "read_runtime_stream_slice", "runtime-change-points": "runtime_change_points",
}


def value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millwright", description=__doc__)
    parser.add_argument("command", choices=["ingest", "inspect", "serve", *COMMANDS, *TOOLS])
    parser.add_argument("--workspace", required=True)
    parser.add_argument("--source", help="project files to ingest")
    parser.add_argument("--runtime", help="folder of the captures, if it is not in the workspace")
    known, rest = parser.parse_known_args(argv)
    arguments = {k.removeprefix("--").replace("-", "_"): value(v) for k, v in zip(rest[::2], rest[1::2], strict=True)}
    spark = SparkSession.builder.appName("millwright").getOrCreate()
    if known.command == "ingest":
        out = ingest(spark, known.source, known.workspace).identity()
    elif known.command == "inspect":
        out = Workspace(spark, known.workspace).manifest
    elif known.command == "serve":  # one JSON request a line: {"tool": ..., "arguments": {...}}
        tools = Tools(spark, known.workspace)
        while line := input():
            request = json.loads(line)
            print(json.dumps(tools.call(request["tool"], **request.get("arguments", {})), default=str), flush=True)
        return 0
    else:
        if known.command.startswith("runtime-capture-") and COMMANDS[known.command] == "start_runtime_capture":
            arguments.setdefault("wait", True)  # the capture runs in this process; another one may ask it to stop
        if "source_name" in arguments:
            arguments["source"] = arguments.pop("source_name")
        out = Tools(spark, known.workspace, known.runtime).call(COMMANDS.get(known.command, known.command), **arguments)
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
