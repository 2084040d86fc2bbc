"""The query surface: one function per tool, each a thin reading of a DataFrame within a payload budget."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.text import clip
from millwright.operators import match, paging, series
from millwright.plans import answers
from millwright.plans.analysis import Analysis
from millwright.sources.workspace import Workspace
from millwright.sources.tags import read_tags
from millwright.streaming import sessions

PAYLOAD = 50_000
CLIP = 200
# The most rows that a tool returns, and the caps of single tools.
MOST_ROWS = 1000
# Rows of each part of a context, by detail; ``full`` has MOST_ROWS of all.
CAPS = {
    "tag": {"comments": (5, 25), "tag_comments": (10, 50), "data": (10, 50), "messages": (5, 25), "references": (10, 50)},
    "routine": {"routine_units": (25, 100), "fbd_nodes": (25, 100), "fbd_wires": (40, 160)},
    "aoi": {"parameters": (20, 100), "local_tags": (20, 100), "routines": (10, 50)},
    "module": {"connections": (10, 50), "io_tags": (20, 100), "io_points": (50, 250), "engineering_units": (25, 100), "profiles": (25, 100)},
}
DETAILS = ("summary", "detail", "full")
# What a summary shows of these parts, with the characters it keeps.
SHORT = {"comments": {"target": CLIP, "text": 240}, "tag_comments": {"target": CLIP, "text": 240}, "data": {"owner": CLIP, "element": CLIP, "format": CLIP, "raw_text": 180}}
NESTED = ("attributes", "raw_xml", "body", "instructions", "parameters", "arrays", "info", "message_attributes")


def summarize(frame: DataFrame) -> DataFrame:
    """Scalar columns, long strings clipped; arrays as their sizes; nested values left out."""
    cols = []
    for f in frame.schema:
        kind = f.dataType.typeName()
        if f.name in NESTED or kind in ("map", "struct"):
            continue
        if kind == "array":
            cols.append(F.coalesce(F.size(f.name), F.lit(0)).alias(f"{f.name}_count"))
        else:
            cols.append(clip(F.col(f.name), CLIP).alias(f.name) if kind == "string" else F.col(f.name))
    return frame.select(*cols)


def listing(frame: DataFrame, limit: int = 100, offset: int = 0, detail: str = "summary") -> dict:
    """A page in the order of the columns ``id``, ``name`` or the first."""
    if detail not in DETAILS:
        raise ValueError(f"unknown detail {detail!r}")
    order = [c for c in ("id", "name", "sequence", "key") if c in frame.columns] or [frame.columns[0]]
    shown = summarize(frame) if detail == "summary" else frame
    limit = paging.bounded(limit, 0, MOST_ROWS, 100)
    return paging.envelope(shown, [c for c in order if c in shown.columns] or [shown.columns[0]], limit, offset)


def bundle(frames: dict[str, DataFrame], caps: dict[str, int] | None = None, detail: str = "summary") -> dict:
    return {name: listing(f, (caps or {}).get(name, 20), detail=detail) for name, f in frames.items()}


def context(kind: str, frames: dict[str, DataFrame], detail: str = "summary") -> dict:
    """The parts of a context with their caps by detail; a summary shows comments and data in short form."""
    if detail not in DETAILS:
        raise ValueError(f"unknown detail {detail!r}")
    caps = {name: (*CAPS[kind][name], MOST_ROWS)[DETAILS.index(detail)] if name in CAPS[kind] else (20, 100, MOST_ROWS)[DETAILS.index(detail)] for name in frames}
    if detail == "summary":
        frames = {name: short(f, SHORT[name]) if name in SHORT else f for name, f in frames.items()}
    return {"detail": detail, **bundle(frames, caps, detail)}


def short(frame: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Single-line columns cut at their sizes; what a dataset does not have is left out."""
    return frame.select(*[clip(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " ")), n).alias(c) for c, n in columns.items() if c in frame.columns])


class Tools:
    """Tools over one workspace; runtime tools over a capture folder."""

    def __init__(self, spark: SparkSession, workspace: str, runtime: str | None = None):
        self.spark, self.data, self.runtime = spark, Workspace(spark, workspace), runtime or f"{workspace}/runtime"
        self.a = Analysis(self.data)
        self.captures: dict[str, object] = {}

    def call(self, tool: str, spill: bool = False, **arguments) -> dict:
        """Run a tool by name; a result over the budget is cut to its first items and says so.

        With ``spill`` the whole of such a result is also written as text under its hash, and ``spilled`` names the path.
        """
        result = TOOLS[tool](self, **arguments)
        text = json.dumps(result, default=str)
        if spill and len(text) > PAYLOAD:
            path = f"{self.data.path}/spill/{tool}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
            result = {**result, "spilled": path, "spilled_characters": len(text)}
        while len(text) > PAYLOAD and isinstance(result.get("items"), list) and len(result["items"]) > 1:
            result = {**result, "items": result["items"][: len(result["items"]) // 2], "truncated": True, "has_more": True}
            text = json.dumps(result, default=str)
        return json.loads(text)

    def not_found(self, kind: str, name: str) -> dict:
        return {"found": False, "kind": kind, "name": name, "suggestions": [r["name"] for r in self.a.suggestions(name).collect()]}


TOOLS: dict[str, Callable[..., dict]] = {}


def tool(make):
    TOOLS[make.__name__] = make
    return make


def _lists(name: str, dataset: str, **defaults):
    def run(t: Tools, limit: int = 100, offset: int = 0, detail: str = "summary", **equal):
        frame = getattr(t.data, dataset)
        for column, value in equal.items():
            if value is not None:
                frame = frame.where(match.plain_scope(F.col(column)) == value.removeprefix("Program:") if column == "scope" else F.col(column) == value)
        return listing(frame, limit, offset, detail)

    run.__name__ = name
    TOOLS[name] = run


for _name, _dataset in {"list_tags": "tags", "list_udts": "data_types", "list_programs": "programs", "list_routines": "routines", "list_aois": "aoi_definitions", "list_modules": "modules", "list_entities": "entities"}.items():
    _lists(_name, _dataset)


def _gets(name: str, dataset: str, kind: str):
    def run(t: Tools, name: str, scope: str | None = None, program: str | None = None):
        frame = getattr(t.data, dataset).where(F.col("name") == name)
        for column, value in (("scope", scope), ("program", program)):
            if value is not None and column in frame.columns:
                frame = frame.where(F.col(column) == value)
        rows = frame.orderBy("id").limit(1).collect()
        return {"found": True, "item": rows[0].asDict(True)} if rows else t.not_found(kind, name)

    run.__name__ = name
    TOOLS[name] = run


for _name, (_dataset, _kind) in {"get_tag": ("tags", "tag"), "get_udt": ("data_types", "udt"), "get_program": ("programs", "program"), "get_routine": ("routines", "routine"), "get_aoi": ("aoi_definitions", "aoi")}.items():
    _gets(_name, _dataset, _kind)


@tool
def project_summary(t):
    return {**t.data.identity(), "counts": t.data.manifest["counts"]}


@tool
def coverage_report(t):
    return {"surfaces": [r.asDict() for r in t.data.coverage().orderBy("surface").collect()]}


@tool
def get_tag_context(t, name, detail="summary"):
    return context("tag", t.a.tag_bundle(name), detail)


@tool
def get_routine_context(t, routine_id, detail="summary"):
    return context("routine", t.a.routine_context(routine_id), detail)


@tool
def get_aoi_context(t, name, detail="summary"):
    return context("aoi", t.a.aoi_bundle(name), detail)


@tool
def get_module_context(t, name, detail="summary"):
    return context("module", t.a.module_bundle(name), detail)


@tool
def get_entity(t, entity_id):
    rows = t.a.find_entity(entity_id).collect()
    return {"found": True, "item": rows[0].asDict(True)} if rows else t.not_found("entity", entity_id)


@tool
def search_entities(t, query, limit=50):
    hay = F.concat_ws(" ", "id", "name", "description")
    return listing(t.data.entities.where(match.contains(hay, query)), limit)


@tool
def search_logic(t, pattern, limit=50):
    return listing(t.a.search_logic(pattern), limit)


@tool
def search_project(t, query, kinds=None, scope=None, limit=20, offset=0):
    return paging.envelope(summarize(t.a.search(query, kinds, scope)), [F.desc("score"), "kind", "name", "key"], paging.bounded(limit, 1, 100, 20), offset)


@tool
def get_sfc_chart(t, routine_id, variant=None, limit=100):
    charts = t.a.sfc_chart(routine_id, variant)
    rows = charts.collect()
    if not rows:
        return t.not_found("sfc_chart", routine_id)
    if rows[0]["ambiguous"]:
        return {"found": True, "status": "needs_variant", "variants": [r["online_edit_type"] for r in rows]}
    own = F.col("chart_id") == rows[0]["chart_id"]
    return {"found": True, "chart": rows[0].asDict(True), **bundle({n: getattr(t.data, f"sfc_{n}").where(own) for n in ("nodes", "links", "branches", "legs")}, dict.fromkeys(("nodes", "links", "branches", "legs"), limit))}


@tool
def get_source_fragment(t, anchor, max_bytes=20_000):
    rows = t.a.source_fragment(anchor, max_bytes).collect()
    return {"found": True, "item": rows[0].asDict(True)} if rows else t.not_found("source_fragment", anchor)


@tool
def exists(t, query, kinds=None, scope=None):
    n = t.a.exists(query, kinds, scope)
    return {"query": query, "exists": n > 0, "total": n}


@tool
def get_operand_context(t, operand, scope=None):
    exact = t.a.references(operand, "exact", scope=scope)
    return {"operand": operand, "references": listing(exact, 25), **bundle({k: v for k, v in t.a.tag_bundle(operand.split(".")[0]).items() if k != "references"}, {"comments": 5, "tag_comments": 10, "data": 10})}


@tool
def get_routine_slice(t, routine_id, unit_id=None, query=None, before=1, after=1, chart_id=None, sheet=None):
    return {**listing(t.a.routine_slice(routine_id, unit_id, query, before, after, chart_id, sheet), 50), "limits": [r.asDict() for r in t.a.coverage_limits("routine").collect()]}


@tool
def get_fbd_sheet(t, sheet_id=None, program=None, routine=None, routine_id=None, sheet=None, form="pseudo", limit=100):
    if sheet_id is not None:  # a sheet's id begins with its routine's
        routine_id, sheet = sheet_id.rsplit(".Sheet:", 1)[0], sheet_id
    return answers.sheet_answer(t.a, routine_id, routine, program, sheet, form, limit)


@tool
def cross_reference(t, symbol, mode="exact", access=None, destructive=None, scope=None, limit=50, offset=0):
    page = paging.envelope(t.a.cross_reference(symbol, mode, access, destructive, scope), ["routine", "source", "symbol", "access"], paging.bounded(limit, 0, 200, 50), offset)
    facets = t.a.reference_facets(symbol, mode, access=access, destructive=destructive, scope=scope)
    return {**page, "facets": [r.asDict() for r in facets.orderBy("facet", F.desc("n"), "key").collect()]}


@tool
def find_references(t, symbol, limit=200):
    return paging.envelope(t.a.references(symbol), ["routine", "source", "symbol", "access"], paging.bounded(limit, 0, 200, 200))


@tool
def trace_signal(t, symbol, direction="upstream", max_depth=4, limit=100):
    return answers.trace_answer(t.a, symbol, direction, max_depth, limit)


@tool
def triage_issue(t, issue_text, limit=5):
    found = t.a.triage(issue_text)
    context = found["context"].orderBy(F.desc("references"), "doc", "name")
    return {"tokens": found["tokens"], "names": listing(found["names"], limit), "hits": listing(found["hits"], limit), "candidates": listing(context, paging.bounded(limit, 1, 20, 5), detail="full")}


@tool
def scope_metadata(t, issue_text=""):
    counts = t.data.manifest["counts"]
    evidence = {"logic": ["tags", "routines", "routine_units", "xrefs"], "diagrams": ["fbd_nodes", "fbd_wires"], "charts": ["sfc_nodes", "sfc_links"], "hardware": ["modules", "module_io_points"], "alarms": ["alarms", "messages"]}
    return {"available": {k: {n: counts[n] for n in names} for k, names in evidence.items()}, "limits": t.a.scope_limits(issue_text)}


@tool
def resolve_alarm(t, name, limit=10):
    return listing(t.a.resolve_alarm(name), paging.bounded(limit, 1, 50, 10), detail="full")


@tool
def decode_summary(t, tag, limit=50):
    return paging.envelope(t.a.decode_summary(tag), ["symbol"], paging.bounded(limit, 1, 200, 50))


@tool
def aoi_instance_bindings(t, instance, limit=10):
    b = t.a.bindings().where(F.lower("instance") == instance.lower())
    return paging.envelope(b, ["evidence_ref", "place"], 25 * paging.bounded(limit, 0, 40, 10))


@tool
def tag_producers_consumers(t, name):
    return {"tag": name, "rows": [r.asDict() for r in t.a.producers_consumers(name).orderBy("role", "program", "routine").limit(MOST_ROWS).collect()]}


@tool
def impact_of(t, name, max_depth=3, limit=300):
    return paging.envelope(t.a.impact_of(name, max_depth), ["depth", "kind", "id"], paging.bounded(limit, 0, MOST_ROWS, 300))


@tool
def io_trace(t, name):
    return bundle(t.a.io_trace(name), {"references": 100, "io_points": 100, "chain": 100, "routines": 100})


@tool
def call_graph(t, routine=None, program=None):
    frame = t.a.call_view(routine, program) if routine else t.a.scheduling()
    return paging.envelope(frame, frame.columns, 1000)


@tool
def run_diagnostics(t, rules=None, severity=None, limit=50):
    f = t.a.findings(rules, severity)
    by = {k: {r[k]: r["n"] for r in f.groupBy(k).agg(F.count("*").alias("n")).collect()} for k in ("rule", "severity")}
    return {**paging.envelope(f, ["severity_rank", "rule", "entity", "detail"], paging.bounded(limit, 0, MOST_ROWS, 50)), "by_rule": by["rule"], "by_severity": by["severity"]}


@tool
def sdk_status(t):
    return {"available": False, "reason": "no controller kit is used; projects are read from exports"}


@tool
def runtime_evidence_summary(t, limit=50):
    latest = series.latest(sessions.read_samples(t.spark, t.runtime), ["tag"], ["ts", "seq"], ["session_id", "ts_utc", "value_json", "error"])
    return paging.envelope(latest, ["tag"], paging.bounded(limit, 0, MOST_ROWS, 50))


@tool
def read_tags_now(t, tags, kind="DINT", source="simulated"):
    names = sessions.normalize_tags(tags)
    rows = read_tags(t.spark, source, names, cycles=1, kind=kind)
    return {"mode": "OFFLINE", "source": source, "samples": [r.asDict() for r in rows.orderBy("seq").drop("ts").collect()]}  # one row a tag


@tool
def start_runtime_capture(t, tags, interval_ms=1000, duration_seconds=60, session_id=None, wait=False, source="simulated", process=False):
    """Starts a capture in this process, or with ``process`` in one of its own; with ``wait`` returns when it has ended."""
    sessions.check_source(source)
    sid = session_id or sessions.new_session_id()
    sessions.check_limits(interval_ms, duration_seconds)
    if process:
        pid = sessions.capture_process(t.data.path, sid, tags, interval_ms, duration_seconds, source, t.runtime)
        return {"session_id": sid, "status": "starting", "pid": pid}
    identity = ",".join(t.data.manifest["controllers"][:5])
    sessions.create_session(t.spark, t.runtime, sid, tags, interval_ms, duration_seconds, identity, t.runtime, source=source)
    t.captures[sid] = sessions.capture(t.spark, t.runtime, sid, tags, interval_ms, duration_seconds, source)
    if wait:
        t.captures[sid].awaitTermination()
    return runtime_capture_status(t, sid)


@tool
def runtime_capture_status(t, session_id):
    """The state that the capture wrote, whatever process it runs in; one whose process is lost has failed."""
    row = sessions.states(t.spark, t.runtime, session_id).first()
    return {"session_id": session_id, "status": "unknown"} if row is None else row.asDict()


@tool
def stop_runtime_capture(t, session_id):
    """Asks for the end of a capture; waits for it where it runs in this process."""
    sessions.request_stop(t.spark, t.runtime, session_id)
    if session_id in t.captures:
        t.captures[session_id].awaitTermination(60)
    return {**runtime_capture_status(t, session_id), "stop_requested": True}


@tool
def list_runtime_sessions(t, status=None, limit=50, offset=0):
    return paging.envelope(sessions.sessions(t.spark, t.runtime, status), [F.desc("created_at"), F.desc("session_id")], paging.bounded(limit, 0, MOST_ROWS), offset)


@tool
def read_runtime_stream_slice(t, session_id, tag, start=None, end=None, max_points=200):
    rows = sessions.read_samples(t.spark, t.runtime, session_id).where((F.col("tag") == tag) & match.in_range(F.col("ts_utc"), start, end))
    return paging.envelope(series.downsample(rows, ["session_id", "tag"], ["ts", "seq"], paging.bounded(max_points, 0, 1000)), ["ts", "seq"], 1000)


@tool
def runtime_change_points(t, session_id, tag=None, max_points=200):
    rows = sessions.read_samples(t.spark, t.runtime, session_id)
    rows = rows.where(F.col("tag") == tag) if tag else rows
    points = series.change_points(rows, ["session_id", "tag"], ["ts", "seq"], "value_json", "error")
    total, few = points.count(), series.downsample(points, ["session_id"], ["ts", "seq", "tag"], paging.bounded(max_points, 0, 1000, 200))
    return {**paging.envelope(few, ["ts", "seq", "tag"], 1000), "total": total}
