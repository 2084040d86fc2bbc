"""Answers about one sheet, one signal or the whole project that put several analyses together.

Each is a small dictionary: what it counts is aggregated by Spark, and what it lists has a limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators import paging
from millwright.plans.analysis import Analysis

# Statuses, forms and the most rows of each list.
FORMS = ("pseudo", "summary")
MOST_EQUATIONS, MOST_PINS, MOST_TAGS, MOST_INSTANCES, MOST_UNRESOLVED, MOST_TRACES = 300, 100, 50, 20, 100, 100
MOST_FINDINGS = 1000


def _rows(frame: DataFrame, order: list, limit: int) -> list[dict]:
    return [r.asDict(True) for r in frame.orderBy(*order).limit(limit).collect()]


def equation_text(kind: str, target: str, expr: str) -> str:
    if kind == "jsr_call":
        return f"CALL {expr}"
    return f"{target} -> UNWIRED" if kind == "aoi_output_unwired" else f"{target} := {expr}"


def sheet_answer(a: Analysis, routine_id: str | None = None, routine: str | None = None, program: str | None = None, sheet=None, form: str = "pseudo", limit: int = 100) -> dict:
    """One sheet as equations with its tags, instances, open pins, connectors and open ends; or why there is none."""
    d = a.data
    own = d.routines.where(F.col("id") == routine_id) if routine_id else d.routines.where(F.col("name") == (routine or ""))
    own = own.where(F.col("program") == program) if program else own
    head = own.select("doc", "id", "name", "program", "language").orderBy("doc", "id").first()
    if head is None:
        return {"found": False, "routine": routine_id or routine, "program": program, "sheets": []}
    about = head.asDict()
    if head["language"] != "FBD":
        return {"found": False, "status": "not_fbd", "routine": about}
    units = d.routine_units.where((F.col("kind") == "fbd_sheet") & (F.col("doc") == head["doc"]) & (F.col("routine_id") == head["id"]))
    known = [r.asDict() for r in units.select("id", "number", "sequence", "node_count", "wire_count").orderBy("sequence").limit(1000).collect()]
    wanted = str(sheet) if sheet is not None else None
    chosen = known[0] if wanted is None and len(known) == 1 else next((u for u in known if wanted in (u["id"], str(u["number"]))), None)
    if chosen is None:
        return {"found": True, "status": "needs_sheet" if known else "no_fbd_sheets", "routine": about, "sheets": known}
    if form not in FORMS:
        return {"found": False, "status": "unsupported_form", "routine": about, "sheet": chosen, "forms": list(FORMS)}

    limit = paging.bounded(limit, 0, MOST_EQUATIONS, 100)
    here = (F.col("doc") == head["doc"]) & (F.col("sheet_id") == chosen["id"])
    equations = a.sheet_equations(chosen["id"]).where(F.col("doc") == head["doc"])
    nodes = d.fbd_nodes.where(here & (F.col("node_type") != "TextBox"))
    pins = a.bindings().where(here)
    tags = lambda side: pins.where(F.lower("usage").isin(side, "inout") & F.col("argument").isNotNull()).select(F.col("argument").alias("tag"))
    operands = lambda kind: nodes.where((F.col("node_type") == kind) & F.col("operand").isNotNull()).select(F.col("operand").alias("tag"))
    names = lambda frame: [r["tag"] for r in frame.distinct().orderBy("tag").limit(MOST_TAGS).collect()]
    open_ends = a.open_ends().where(here)
    counts = {r["node_type"]: r["count"] for r in nodes.groupBy("node_type").count().collect()}
    unwired = pins.where("not wired").select("instance", F.col("instruction").alias("aoi"), "param", "usage", "required")
    n_equations, n_open, n_unwired = equations.count(), open_ends.count(), unwired.count()
    shown = _rows(equations.select("kind", "target", "expr", "sheet_id", "evidence_ref"), ["evidence_ref", "kind", "target", "expr"], limit)
    out = {
        "found": True,
        "status": "ok" if counts else "empty_sheet",
        "routine": about,
        "sheet": chosen,
        "form": form,
        "summary": {
            "node_count": sum(counts.values()),
            "wire_count": chosen["wire_count"],
            "input_refs": counts.get("IRef", 0),
            "output_refs": counts.get("ORef", 0),
            "blocks": counts.get("Block", 0),
            "jsr_calls": counts.get("JSR", 0),
            "aois": counts.get("AddOnInstruction", 0),
            "connectors": counts.get("ICon", 0) + counts.get("OCon", 0),
            "unresolved_edges": n_open,
            "unwired_aoi_pins": n_unwired,
            "equation_count": n_equations,
        },
        "source_tags": names(operands("IRef").union(tags("input"))),
        "output_tags": names(operands("ORef").union(tags("output"))),
        "connectors": _rows(nodes.where(F.col("node_type").isin("ICon", "OCon")).select("id", "node_type", "connector_name"), ["id"], MOST_TAGS),
        "aoi_instances": _rows(a.binding_totals().join(nodes.select(F.col("id").alias("evidence_ref"), F.col("operand").alias("instance"), F.col("instruction").alias("aoi")), "evidence_ref"), ["evidence_ref"], MOST_INSTANCES),
        "unwired_pins": _rows(unwired, ["instance", "param"], MOST_PINS),
        "unresolved_edges": _rows(open_ends.select("node", "wire", "reason"), ["node", "wire", "reason"], MOST_UNRESOLVED),
        "truncated_equations": max(0, n_equations - limit),
        "limits": [x for x, true in (("no_nodes_extracted", not counts), ("pseudo_equations_truncated", n_equations > limit), ("unresolved_edges_present", n_open > 0)) if true],
    }
    if form == "pseudo":
        out |= {"pseudo_equations": shown, "equations": [equation_text(e["kind"], e["target"], e["expr"]) for e in shown]}
    return out


def trace_answer(a: Analysis, symbol: str, direction: str = "upstream", max_depth: int = 4, limit: int = 50) -> dict:
    """Where a signal comes from: its writers, the walks against the wires, the sheets and the logic texts they stand in.

    Downstream gives the readers alone (status ``limited``).
    """
    limit, max_depth = paging.bounded(limit, 1, MOST_TRACES, 50), paging.bounded(max_depth, 1, 12, 4)
    order = ["routine", "source", "symbol", "access"]
    if direction != "upstream":
        return {"symbol": symbol, "direction": direction, "status": "limited", "references": paging.envelope(a.cross_reference(symbol, "members", destructive=False), order, limit)}
    refs = paging.envelope(a.cross_reference(symbol, "members", destructive=True), order, limit)
    walks = a.trace_paths(symbol, max_depth)
    units = a.trace_units(symbol)
    sheets = a.references(symbol, "members", destructive=True).join(a.data.fbd_nodes.select("doc", F.col("id").alias("source"), "sheet_id"), ["doc", "source"]).select("doc", "sheet_id").distinct()
    equations = a.equations().join(sheets, ["doc", "sheet_id"], "left_semi").select("sheet_id", "kind", "target", "expr", "evidence_ref")
    unresolved = walks.where("reason is not null").select(F.col("node"), "reason").union(units.where("text is null").select("source", F.lit("source_unit_not_found"))).distinct()
    paths = _rows(walks.where("state <> 'inner'").select("doc", "path", "depth", "state", "leaf_operand", "reason"), ["doc", "path"], limit)
    logic = _rows(units.where("text is not null").select("doc", "routine", "source", "language", "text"), ["doc", "routine", "source"], limit)
    return {
        "symbol": symbol,
        "direction": direction,
        "status": "ok" if paths or logic else "unresolved",
        "writer_count": refs["total"],
        "references": refs,
        "paths": paths,
        "units": logic,
        "pseudo_equations": [{**e, "text": equation_text(e["kind"], e["target"], e["expr"])} for e in _rows(equations, ["sheet_id", "evidence_ref", "kind", "target", "expr"], 80)],
        "unresolved": _rows(unresolved, ["node", "reason"], MOST_UNRESOLVED),
    }


def diagnostics_report(a: Analysis) -> tuple[dict, str]:
    """All findings (at most ``MOST_FINDINGS``) as a dictionary and as Markdown, with counts by rule and severity."""
    f = a.findings()
    totals = {r["rule"]: r["total"] for r in f.select("rule", "total").distinct().orderBy("rule").collect()}
    by_severity = {r["severity"]: r["count"] for r in f.groupBy("severity").count().orderBy("severity").collect()}
    items = _rows(f.select("severity_rank", "severity", "rule", "entity", "title", "detail"), ["severity_rank", "rule", "entity", "detail"], MOST_FINDINGS)
    cell = lambda x: " ".join(str(x or "").split()).replace("|", "\\|")
    lines = ["# Diagnostics", "", *[f"- {rule}: {n}" for rule, n in totals.items()], "", "| severity | rule | entity | finding | detail |", "|---|---|---|---|---|"]
    lines += ["| " + " | ".join(cell(x[k]) for k in ("severity", "rule", "entity", "title", "detail")) + " |" for x in items]
    return {"by_rule": totals, "by_severity": by_severity, "findings": [{k: v for k, v in x.items() if k != "severity_rank"} for x in items]}, "\n".join(lines) + "\n"
