"""Analyses of controller projects: each method is a DataFrame over the project's datasets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions.text import IDENTIFIER, NOT_SYMBOLS, base_symbol, clip, snippet
from millwright.operators import aggregate, expressions, graph, joins, match, paging, rules, search, windows
from millwright.operators.sets import union_all

READ, WRITE = ("read", "read_write"), ("write", "read_write")
ITEM = ["doc", "name"]
SEP = "\x1f"  # between a project and a name in a joined key
EVIDENCE_CHARACTERS = 240
AREAS = {"sfc": ("sfc_nodes", "sfc_links", "unextracted_elements"), "routine": ("sfc_nodes", "sfc_links", "unextracted_elements"), "project": ("unextracted_elements",)}
NO_SOURCE = ("SPACE", "NULL", "0", "FALSE", "TRUE")
SEARCH_COLUMNS = (
    "name", "id", "description", "text", "summary", "element", "data_type", "alias_for", "catalog_number", "module",
    "vendor", "cat_num", "instance_application_path", "engineering_unit", "operand", "tag_name", "message_type",
    "connection_path", "local_element", "destination_tag", "parent_program", "child_program", "online_edit_type",
    "node_type", "raw_text",
)
SEARCHED = (
    "symbols", "routines", "routine_units", "comments", "alarms", "modules", "module_io_points", "sfc_charts",
    "sfc_nodes", "sfc_branches", "source_fragments", "engineering_units", "message_parameters",
    "module_profile_fragments", "program_children", "entities",
)
# Words of an issue text that name nothing, and words that point beyond the export.
STOP_WORDS = ("the", "and", "will", "not", "run", "auto", "shows", "with", "even", "hmi", "mcc", "alarm")
BEYOND = (
    ("needs_hmi_export_or_runtime", ("hmi", "screen", "display", "color", "colour", "red", "green", "mcc screen", "factorytalk", "view", "slow")),
    ("needs_runtime_or_field_state", ("runtime", "live", "online", "actual state", "currently", "breaker off", "feedback mismatch")),
    ("may_depend_on_external_controller_or_gateway", ("prosoft", "modbus", "serial", "gateway", "external", "genset", "ge engine", "engine ecu")),
)


class Analysis:
    """``data`` has the datasets as attributes (a Project or a loaded Workspace)."""

    def __init__(self, data):
        self.data = data

    # --- references

    def references(self, symbol: str, mode: str = "members", access=None, destructive: bool | None = None, scope: str | None = None) -> DataFrame:
        x = self.data.xrefs
        folded = F.col("base_lc") if mode == "base" else F.col("symbol_lc")
        hit = (folded == base_of(symbol.lower())) if mode == "base" else match.symbol_match(F.col("symbol"), symbol, mode, folded)
        x = x.where(hit & match.in_list(F.col("access"), access) & match.destructive(F.col("access"), destructive))
        return x.where(F.col("program") == re.sub("^Program:", "", scope)) if scope else x

    def unit_texts(self) -> DataFrame:
        """doc, source, text: whole text of every unit and node that a reference may come from."""
        text = lambda f, *cols: f.select("doc", F.col("id").alias("source"), F.coalesce(*[F.col(c) for c in cols], F.lit("")).alias("text"))
        return union_all([text(self.data.rungs if hasattr(self.data, "rungs") else self.data.routine_units, "text", "comment"), text(self.data.fbd_nodes, "operand", "instruction"), text(self.data.sfc_nodes, "st_body", "condition_body", "operand")])

    def evidence(self) -> DataFrame:
        """doc, source, snippet: ``unit_texts`` cut for display."""
        return self.unit_texts().select("doc", "source", clip(F.regexp_replace("text", r"\s+", " "), EVIDENCE_CHARACTERS).alias("snippet"))

    def cross_reference(self, symbol: str, mode: str = "exact", access=None, destructive: bool | None = None, scope: str | None = None) -> DataFrame:
        """References with destructive flag and evidence, in the order routine, source, symbol."""
        x = self.references(symbol, mode, access, destructive, scope)
        x = x.join(self.evidence(), ["doc", "source"], "left").withColumn("destructive", F.col("access").isin(*WRITE))
        return x.orderBy("routine", "source", "symbol")

    def reference_facets(self, symbol: str, mode: str = "exact", **filters) -> DataFrame:
        return aggregate.facets(self.references(symbol, mode, **filters), ["access", "instruction", "routine"])

    def producers_consumers(self, name: str) -> DataFrame:
        """doc, role, routine, program, instructions of the routines that write or read the tag."""
        x = self.data.xrefs.where(F.col("base_symbol") == base_of(name))
        side = lambda wanted, role: aggregate.distinct_per_group(x.where(F.col("access").isin(*wanted)), ["doc", "routine", "routine_name", "program"], "instruction", "instructions").withColumn("role", F.lit(role))
        return side(WRITE, "producer").unionByName(side(READ, "consumer"))

    # --- graphs

    def impact_of(self, name: str, max_depth: int = 3) -> DataFrame:
        """doc, kind (routine, tag, alarm), id, depth of what a change of the tag reaches, in each project."""
        x = self.data.xrefs.where("base_symbol <> '' and routine is not null")
        part = lambda wanted: x.where(F.col("access").isin(*wanted)).select(F.concat_ws(SEP, "doc", "routine").alias("unit"), F.concat_ws(SEP, "doc", "base_symbol").alias("item"))
        start = self.data.controller.select(F.concat_ws(SEP, "doc", F.lit(base_of(name))).alias("item"))
        found = graph.impact_closure(part(READ), part(WRITE), start, max_depth)
        found = found.select(F.substring_index("id", SEP, 1).alias("doc"), F.when(F.col("kind") == "item", "tag").otherwise("routine").alias("kind"), F.substring_index("id", SEP, -1).alias("id"), "depth")
        tags = found.where("kind = 'tag'").select("doc", F.col("id").alias("b"), "depth")
        alarms = self.data.alarms.withColumn("b", base_symbol(F.col("tag_name"))).join(tags, ["doc", "b"]).select("doc", F.lit("alarm").alias("kind"), F.col("tag_name").alias("id"), "depth")
        return found.where("not (kind = 'tag' and depth = 0)").unionByName(alarms)

    def alias_chain(self, name: str) -> DataFrame:
        """doc, name of all tags that resolve to the same tag as ``name``, in each project that has it."""
        key = lambda c: F.concat_ws(SEP, "doc", c)
        a = self.data.tags.where("alias_for <> ''").select(key("name").alias("name"), key(base_symbol(F.col("alias_for"))).alias("target"))
        roots = graph.alias_roots(a, "name", "target")
        starts = self.data.tags.where(F.col("name") == name).select(key("name").alias("name")).distinct()
        own = starts.join(roots, "name", "left").select("name", F.coalesce("root", "name").alias("root"))
        same = roots.join(own.select("root"), "root", "left_semi").select("name")
        every = same.union(own.select("name")).union(own.select("root")).distinct()
        return every.select(F.substring_index("name", SEP, 1).alias("doc"), F.substring_index("name", SEP, -1).alias("name"))

    def io_trace(self, name: str) -> dict[str, DataFrame]:
        chain = self.alias_chain(name).select("doc", F.col("name").alias("base_symbol"))
        points = self.data.module_io_points.withColumn("base_symbol", base_symbol(F.col("operand")))
        alarms = self.data.alarms.withColumn("base_symbol", base_symbol(F.col("tag_name")))
        on = ["doc", "base_symbol"]
        refs = self.data.xrefs.join(chain, on, "left_semi")
        return {"chain": chain, "references": refs, "routines": refs.select("doc", "routine", "routine_name", "program").distinct(), "io_points": points.join(chain, on, "left_semi"), "alarms": alarms.join(chain, on, "left_semi")}

    def call_view(self, routine: str, program: str | None = None) -> DataFrame:
        """doc, direction, type, name: what the routine calls and who calls it."""
        own = self.data.routines.where(F.col("name") == routine)
        own = own.where(F.col("program") == program) if program else own
        ids = own.select("doc", F.col("id").alias("routine"))
        x = self.data.xrefs.withColumn("op", F.upper("instruction"))
        aoi = self.data.aoi_definitions.select("doc", F.upper("name").alias("op")).distinct()
        out = x.join(ids, ["doc", "routine"], "left_semi")
        calls = out.where("access = 'call'").select("doc", F.lit("callee").alias("direction"), F.lit("routine").alias("type"), F.col("symbol").alias("name"))
        uses = out.where("access <> 'call'").join(aoi, ["doc", "op"], "left_semi").select("doc", F.lit("callee"), F.lit("aoi"), "instruction")
        callers = x.where((F.col("access") == "call") & (F.col("symbol") == routine)).join(ids, ["doc", "routine"], "left_anti").join(ids.select("doc").distinct(), "doc", "left_semi").select("doc", F.lit("caller"), F.lit("routine"), "routine")
        return calls.union(uses).union(callers).distinct()

    def scheduling(self) -> DataFrame:
        """doc, program, task (null: never scheduled)."""
        s = self.data.tasks.select("doc", F.col("name").alias("task"), F.explode("scheduled_programs").alias("program"))
        return self.data.programs.select("doc", F.col("name").alias("program")).join(s, ["doc", "program"], "left")

    def device_tree(self) -> DataFrame:
        m = self.data.modules
        t = graph.tree(m.select("doc", "name", "parent_module"), "name", "parent_module", ["doc"])
        return m.select("doc", "name", "id", "catalog_number", "slot", "address", "network_address", "inhibited", "major_fault").join(t.withColumnRenamed("key", "name"), ["doc", "name"])

    # --- diagrams

    def _labels(self) -> DataFrame:
        """Nodes with the expression that others see of them."""
        n = self.data.fbd_nodes
        label = F.coalesce(F.nullif("operand", F.lit("")), F.concat("instruction", F.lit("_"), "node_id"))
        net = F.concat(F.lit('net "'), F.coalesce("connector_name", F.lit("UNNAMED")), F.lit('"'))
        return n.withColumn("label", label).withColumn("own", F.when(F.col("node_type").isin("IRef", "ORef"), F.coalesce("operand", "node_type")).when(F.col("node_type").isin("ICon", "OCon"), net))

    def wire_expressions(self) -> DataFrame:
        """Wires with the expression at both ends (unresolved:<id> where a node is missing)."""
        n = self._labels().select("doc", "sheet_id", "node_id", "label", "own")
        w = self.data.fbd_wires.withColumn("ordinal", windows_ordinal())
        for end, pin, out in (("from_id", "from_param", "source"), ("to_id", "to_param", "target")):
            m = n.select("doc", "sheet_id", F.col("node_id").alias(end), F.col("label").alias("_l"), F.col("own").alias("_o"))
            w = w.join(m, ["doc", "sheet_id", end], "left")
            seen = F.coalesce("_o", F.when(F.coalesce(pin, F.lit("")) != "", F.concat("_l", F.lit("."), pin)).otherwise(F.col("_l")))
            w = w.withColumn(out, F.coalesce(seen, F.concat(F.lit("unresolved:"), end))).drop("_l", "_o")
        return w

    def node_inputs(self) -> DataFrame:
        """doc, sheet_id, node_id, inputs: ordered structs (param, expr) from wires, then from arguments not wired."""
        w = self.wire_expressions().select("doc", "sheet_id", F.col("to_id").alias("node_id"), F.col("ordinal").alias("o"), F.coalesce("to_param", F.concat(F.lit("In"), "ordinal")).alias("param"), F.col("source").alias("expr"))
        a = self.data.fbd_nodes.select("doc", "sheet_id", "node_id", F.posexplode("parameters").alias("i", "p")).where(F.col("p.kind").isin("InputParameter", "InOutParameter") & (F.coalesce(F.col("p.argument"), F.lit("")) != ""))
        a = a.select("doc", "sheet_id", "node_id", (F.col("i") + 100_000).alias("o"), F.col("p.name").alias("param"), F.col("p.argument").alias("expr"))
        a = a.join(w.select("doc", "sheet_id", "node_id", "param"), ["doc", "sheet_id", "node_id", "param"], "left_anti")
        rows = F.array_sort(F.collect_list(F.struct("o", F.struct("param", "expr").alias("x"))))
        return w.unionByName(a).groupBy("doc", "sheet_id", "node_id").agg(F.transform(rows, lambda r: r["x"]).alias("inputs"))

    def bindings(self) -> DataFrame:
        """Every pin of every add-on instruction instance: sources, destinations, argument, wired."""
        n = self._labels().where("node_type = 'AddOnInstruction'")
        formal = self.data.aoi_parameters.select("doc", F.lower("aoi").alias("k"), F.col("name").alias("param"), F.col("usage"), "required", F.col("sib").alias("place"))
        known = n.select("doc", "routine_id", "sheet_id", "sheet_number", "node_id", F.col("id").alias("evidence_ref"), "instruction", F.col("operand").alias("instance"), "label", "parameters").withColumn("k", F.lower("instruction"))
        rows = known.join(formal, ["doc", "k"]).drop("k")
        w = self.wire_expressions()
        ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", c))), lambda r: r[c])
        src = w.where("to_param is not null").groupBy("doc", "sheet_id", F.col("to_id").alias("node_id"), F.col("to_param").alias("param")).agg(ordered("source").alias("sources"))
        dst = w.where("from_param is not null").groupBy("doc", "sheet_id", F.col("from_id").alias("node_id"), F.col("from_param").alias("param")).agg(ordered("target").alias("destinations"))
        rows = rows.join(src, ["doc", "sheet_id", "node_id", "param"], "left").join(dst, ["doc", "sheet_id", "node_id", "param"], "left")
        argument = F.get(F.filter("parameters", lambda p: (p["name"] == F.col("param")) & (p["argument"] != "")), F.lit(0))["argument"]
        empty = F.array().cast("array<string>")
        rows = rows.withColumns({"argument": argument, "sources": F.coalesce("sources", empty), "destinations": F.coalesce("destinations", empty)}).drop("parameters")
        return rows.withColumn("wired", F.col("argument").isNotNull() | (F.size("sources") > 0) | (F.size("destinations") > 0))

    def binding_totals(self) -> DataFrame:
        return joins.binding_totals(self.bindings(), "evidence_ref", F.lower("required") == "true")

    def equations(self) -> DataFrame:
        """kind, target, expr, sheet_id, evidence_ref of all diagrams: nets, outputs, blocks, add-on instructions, calls."""
        n = self._labels().join(self.node_inputs(), ["doc", "sheet_id", "node_id"], "left")
        n = n.withColumn("inputs", F.coalesce("inputs", F.array().cast("array<struct<param:string,expr:string>>")))
        put = lambda f, kind, target, expr: f.select("doc", "routine_id", "sheet_id", F.lit(kind).alias("kind"), target.alias("target"), expr.alias("expr"), F.col("evidence_ref") if "evidence_ref" in f.columns else F.col("id").alias("evidence_ref"))
        values = F.transform("inputs", lambda x: x["expr"])
        merged = F.coalesce(expressions.merged(values), F.lit(expressions.UNRESOLVED))
        nets = put(n.where("node_type = 'OCon'"), "connector_source", F.col("own"), merged)
        outs = put(n.where("node_type = 'ORef' and operand is not null"), "oref_write", F.col("operand"), merged)
        jsr = put(n.where("node_type = 'JSR'"), "jsr_call", F.concat(F.lit("JSR:"), "node_id"), F.coalesce("callee", F.lit("UNKNOWN_ROUTINE")))
        wired = self.data.fbd_wires.where("from_param is not null").groupBy("doc", "sheet_id", F.col("from_id").alias("node_id")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("id", "from_param"))), lambda x: x["from_param"])).alias("outs"))
        b = n.where("node_type = 'Block'").join(wired, ["doc", "sheet_id", "node_id"], "left")
        named = F.transform(F.filter("parameters", lambda p: p["kind"].isin("OutputParameter", "InOutParameter")), lambda p: p["name"])
        pins = F.array_distinct(F.concat(F.coalesce("outs", F.array().cast("array<string>")), named))
        pins = F.when((F.size(pins) == 0) & (F.size("inputs") > 0), F.array(F.lit("Out"))).otherwise(pins)
        b = b.withColumn("out", F.explode(pins))
        blocks = put(b, "block_output", F.concat("label", F.lit("."), "out"), expressions.block(F.col("instruction"), F.col("inputs"), F.col("out")))
        a = self.bindings().withColumn("pin", F.concat("label", F.lit("."), "param"))
        usage = F.lower("usage")
        ins = put(a.where(usage.isin("input", "inout")), "aoi_input", F.col("pin"), F.coalesce(expressions.merged(F.concat(F.array("argument"), F.col("sources"))), F.lit("UNWIRED")))
        o = a.where(usage.isin("output", "inout")).withColumn("to", F.filter(F.concat(F.array("argument"), F.col("destinations")), lambda x: x.isNotNull()))
        aoi_out = put(o.withColumn("dest", F.explode("to")), "aoi_output", F.col("dest"), F.col("pin"))
        loose = put(o.where(F.size("to") == 0), "aoi_output_unwired", F.col("pin"), F.lit("UNWIRED"))
        return union_all([nets, outs, jsr, blocks, ins, aoi_out, loose]).dropDuplicates(["doc", "sheet_id", "kind", "target", "evidence_ref", "expr"])

    def sheet_equations(self, sheet_id: str) -> DataFrame:
        """Equations of one sheet, with those of other sheets' nets that it uses (``connector_source_remote``)."""
        e = self.equations()
        used = self.data.fbd_nodes.where((F.col("sheet_id") == sheet_id) & (F.col("node_type") == "ICon")).select("doc", "routine_id", F.concat(F.lit('net "'), "connector_name", F.lit('"')).alias("target")).distinct()
        remote = e.where((F.col("kind") == "connector_source") & (F.col("sheet_id") != sheet_id)).join(used, ["doc", "routine_id", "target"], "left_semi").withColumn("kind", F.lit("connector_source_remote"))
        return e.where(F.col("sheet_id") == sheet_id).unionByName(remote)

    def sheet_summary(self) -> DataFrame:
        k = lambda t: F.col("node_type") == t
        return aggregate.conditional_counts(self.data.fbd_nodes, ["doc", "sheet_id"], {"input_refs": k("IRef"), "output_refs": k("ORef"), "blocks": k("Block"), "jsr_calls": k("JSR"), "aois": k("AddOnInstruction"), "connectors": F.col("node_type").isin("ICon", "OCon")})

    def trace_upstream(self, symbol: str, max_depth: int = 4, branches: int = 3) -> DataFrame:
        """path (node ids from the target up), depth, state of the walks against the wires, across nets."""
        n = self.data.fbd_nodes
        key = F.concat("doc", F.lit("|"), "sheet_id", F.lit("#"), "node_id")
        wires = self.data.fbd_wires.select(F.concat("doc", F.lit("|"), "sheet_id", F.lit("#"), "to_id").alias("node"), F.concat("doc", F.lit("|"), "sheet_id", F.lit("#"), "from_id").alias("next"), F.col("id").alias("o"))
        o = n.where("node_type = 'OCon'").select("doc", "routine_id", "connector_name", key.alias("next"), F.col("id").alias("o"))
        hops = n.where("node_type = 'ICon'").select("doc", "routine_id", "connector_name", key.alias("node")).join(o, ["doc", "routine_id", "connector_name"]).select("node", "next", "o")
        driven = F.exists("parameters", lambda p: (p["argument"] == symbol) & p["kind"].isin("OutputParameter", "InOutParameter"))
        start = n.where((F.col("operand") == symbol) | driven).select(key.alias("node")).distinct()
        return graph.expand_paths(wires.unionByName(hops), start, max_depth, branches, [F.col("o")])

    def trace_paths(self, symbol: str, max_depth: int = 4, branches: int = 3) -> DataFrame:
        """``trace_upstream`` with what each walk ends at: doc, node, leaf_operand, and the reason where it goes no further."""
        n = self.data.fbd_nodes.select(F.concat("doc", F.lit("|"), "sheet_id", F.lit("#"), "node_id").alias("node"), "node_type", "operand")
        walks = self.trace_upstream(symbol, max_depth, branches).withColumn("node", F.element_at("path", -1)).join(n, "node", "left")
        kind = F.col("node_type")
        ends = F.when(kind.isNull(), "source_node_not_found").when(kind == "ICon", "connector_source_not_found").when(kind.isin("ORef", "OCon"), "no_incoming_wire")
        reason = F.when(F.col("state").isin("cycle", "max_depth"), F.col("state")).when(F.col("state") == "leaf", ends)
        return walks.withColumns({"doc": F.substring_index("node", "|", 1), "leaf_operand": F.when((F.col("state") == "leaf") & (kind == "IRef"), F.col("operand")), "reason": reason})

    def trace_units(self, symbol: str) -> DataFrame:
        """doc, routine, source, language, text of the writers outside of diagrams; no text where a source is unknown."""
        refs = self.references(symbol, "members", destructive=True).where("language <> 'FBD'").select("doc", "routine", "source", "language").distinct()
        bodies = self.data.routines.where("language = 'ST'").select("doc", F.col("id").alias("source"), F.col("body").alias("text"))
        return refs.join(self.unit_texts().unionByName(bodies), ["doc", "source"], "left")

    def open_ends(self) -> DataFrame:
        """doc, sheet_id, node, wire, reason: wires without a node at an end, and nodes that nothing feeds."""
        w = self.wire_expressions()
        lost = union_all([w.where(F.startswith(c, F.lit("unresolved:"))).select("doc", "sheet_id", F.col(end).alias("node"), F.col("id").alias("wire"), F.lit(reason).alias("reason")) for c, end, reason in (("source", "from_id", "source_node_not_found"), ("target", "to_id", "target_node_not_found"))])
        n = self.data.fbd_nodes
        fed = self.data.fbd_wires.select("doc", "sheet_id", F.col("to_id").alias("node_id")).distinct()
        dry = n.where(F.col("node_type").isin("ORef", "OCon")).join(fed, ["doc", "sheet_id", "node_id"], "left_anti").select("doc", "sheet_id", F.col("id").alias("node"), F.lit(None).cast("string").alias("wire"), F.lit("no_incoming_wire").alias("reason"))
        made = n.where("node_type = 'OCon'").select("doc", "routine_id", "connector_name").distinct()
        loose = n.where("node_type = 'ICon'").join(made, ["doc", "routine_id", "connector_name"], "left_anti").select("doc", "sheet_id", F.col("id").alias("node"), F.lit(None).cast("string").alias("wire"), F.lit("connector_source_not_found").alias("reason"))
        return union_all([lost, dry, loose])

    def trace_signal(self, symbol: str, direction: str = "upstream", max_depth: int = 4) -> DataFrame:
        """Writers (or, downstream, readers) of the symbol and its members with their evidence."""
        return self.cross_reference(symbol, "members", destructive=direction != "downstream")

    # --- alarms

    def _alarm_sources(self) -> DataFrame:
        tags = F.filter(F.transform(F.coalesce("assoc_tags", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: (t != "") & ~F.upper(t).isin(*NO_SOURCE))
        return self.data.alarms.withColumn("source_tags", F.array_distinct(tags))

    def resolve_alarm(self, name: str) -> DataFrame:
        """Alarms by tag or id, else by any of their texts, with source tags and how their condition was found."""
        a = self._alarm_sources()
        q = name.lower()
        exact = a.where((F.lower("tag_name") == q) | (F.lower("id") == q))
        hay = F.lower(F.concat_ws(" ", "tag_name", "id", "alarm_type", "alarm_class", "assoc_tags", F.transform("messages", lambda m: m["text"])))
        found = exact if not exact.isEmpty() else a.where(F.contains(hay, F.lit(q)))
        x = self.data.xrefs
        own = x.where(F.col("access").isin(*WRITE)).select("doc", base_symbol(F.col("symbol")).alias("tag_name")).distinct().withColumn("logic", F.lit(True))
        src = found.select("doc", "id", F.explode("source_tags").alias("t")).withColumn("base_symbol", base_symbol(F.col("t"))).join(x.select("doc", "base_symbol").distinct(), ["doc", "base_symbol"]).select("doc", "id").distinct().withColumn("source_logic", F.lit(True))
        p = lambda k: F.try_element_at("parameters", F.lit(k))
        status = F.when(F.col("logic"), "plc_logic_found").when(F.col("source_logic"), "source_tag_logic_found").when(F.coalesce(p("Condition"), p("In")).isNotNull(), "alarm_config_only").otherwise("none_found")
        rows = found.join(own, ["doc", "tag_name"], "left").join(src, ["doc", "id"], "left").withColumn("status", status)
        limits = F.array_compact(F.array(F.when(~F.col("status").isin("plc_logic_found", "source_tag_logic_found"), "no_trip_logic_found_in_this_controller"), F.when(F.exists("messages", lambda m: F.contains(F.coalesce(m["text"], F.lit("")), F.lit("%"))), "message_uses_hmi_or_alarm_server_substitution")))
        return rows.withColumn("limits", limits).drop("logic", "source_logic")

    def decode_summary(self, tag: str) -> DataFrame:
        """doc, symbol, references, alarms of what the whole logic that writes a summary tag mentions."""
        w = self.references(tag, "exact", destructive=True).select("doc", "source").distinct()
        text = w.join(self.unit_texts(), ["doc", "source"])
        names = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)), lambda s: ~F.upper(s).isin(*NOT_SYMBOLS)))
        m = text.select("doc", F.explode(names).alias("symbol")).where(base_symbol(F.col("symbol")) != base_of(tag)).distinct()
        refs = joins.prefix_join(m, "symbol", self.data.xrefs.select("doc", F.col("symbol").alias("ref")), "ref", ["doc"]).groupBy("doc", "symbol").agg(F.count("*").alias("references"))
        keyed = lambda f, c: F.concat_ws(SEP, f["doc"], c)  # noqa: E731  a name within its project
        s = self._alarm_sources()
        s = s.select("id", keyed(s, F.col("tag_name")).alias("tag_name"), F.transform("source_tags", lambda t: F.concat_ws(SEP, "doc", t)).alias("source_tags"))
        a = joins.member_join(s, "source_tags", "tag_name", m.select("doc", "symbol", keyed(m, F.col("symbol")).alias("s")), "s").groupBy("doc", "symbol").agg(F.sort_array(F.collect_set("id")).alias("alarms"))
        return m.join(refs, ["doc", "symbol"], "left").join(a, ["doc", "symbol"], "left").withColumn("references", F.coalesce("references", F.lit(0)))

    # --- bundles, slices, search

    def tag_bundle(self, name: str) -> dict[str, DataFrame]:
        d, is_tag = self.data, F.col("tag_name") == name
        return {"tag": d.tags.where(F.col("name") == name), "comments": d.comments.where((F.col("target") == name) | F.startswith("target", F.lit(name + ".")) | F.startswith("target", F.lit(name + "["))), "tag_comments": d.tag_comments.where(is_tag), "data": d.tag_data.where(is_tag), "messages": d.message_parameters.where(is_tag), "references": self.references(name)}

    def module_bundle(self, name: str) -> dict[str, DataFrame]:
        d, own = self.data, F.col("module") == name
        return {"module": d.modules.where(F.col("name") == name), "connections": d.module_connections.where(own), "io_tags": d.module_io_tags.where(own), "io_points": d.module_io_points.where(own), "engineering_units": d.engineering_units.where(own), "profiles": d.module_profile_fragments.where(own)}

    def aoi_bundle(self, name: str) -> dict[str, DataFrame]:
        d = self.data
        return {"aoi": d.aoi_definitions.where(F.col("name") == name), "parameters": d.aoi_parameters.where(F.col("aoi") == name), "local_tags": d.tags.where((F.col("scope_type") == "AOI") & (F.col("scope") == name)), "routines": d.routines.where(F.col("owner") == f"AOI:{name}")}

    def routine_context(self, routine_id: str) -> dict[str, DataFrame]:
        d, own = self.data, F.col("routine_id") == routine_id
        names = ("routine_units", "fbd_nodes", "fbd_wires", "sfc_charts", "sfc_nodes", "sfc_links", "sfc_branches", "sfc_legs")
        return {"routine": d.routines.where(F.col("id") == routine_id), **{n: getattr(d, n).where(own) for n in names}, "xrefs": d.xrefs.where(F.col("routine") == routine_id)}

    def routine_slice(self, routine_id: str, unit_id: str | None = None, query: str | None = None, before: int = 1, after: int = 1, chart_id: str | None = None, sheet=None) -> DataFrame:
        """Units of a routine around a unit, a chart, a sheet (by number or id) or those whose text has the query, in this
        order of priority; without any the first 20.
        """
        u = self.data.routine_units.where(F.col("routine_id") == routine_id)
        if unit_id or chart_id:
            hit = F.col("id") == (unit_id or chart_id)
        elif sheet is not None:
            hit = (F.col("kind") == "fbd_sheet") & ((F.col("number") == str(sheet)) | (F.col("id") == str(sheet)))
        elif query:
            hit = match.contains(F.concat_ws(" ", "id", "text", "comment", F.array_join("text_boxes", " ")), query)
        else:
            return u.orderBy("sequence").limit(20)
        return windows.neighbourhood(u, ["doc", "routine_id"], ["sequence"], hit, before, after).orderBy("sequence").limit(50)

    def sfc_chart(self, routine_id: str, variant: str | None = None) -> DataFrame:
        """Charts of a routine; ``ambiguous`` where several variants exist and none was asked for."""
        c = self.data.sfc_charts.where(F.col("routine_id") == routine_id)
        if variant is not None:
            return c.where(F.col("online_edit_type") == variant).withColumn("ambiguous", F.lit(False))
        n = c.groupBy("doc", "routine_id").agg((F.count("*") > 1).alias("ambiguous"))
        return c.join(n, ["doc", "routine_id"])

    def source_fragment(self, anchor: str, max_bytes: int = 20_000) -> DataFrame:
        raw = F.encode("raw_xml", "UTF-8")
        cut = F.decode(F.substring(raw, 1, max_bytes), "UTF-8") if max_bytes else F.lit("")
        return self.data.source_fragments.where(F.col("id") == anchor).withColumns({"truncated": F.octet_length("raw_xml") > max_bytes, "raw_xml": F.when(F.octet_length("raw_xml") > max_bytes, cut).otherwise(F.col("raw_xml"))})

    def search_documents(self) -> DataFrame:
        """key, doc, kind, name, scope, text: what full-text search covers."""
        frames = []
        for dataset in SEARCHED:
            f = getattr(self.data, dataset)
            pick = lambda *names, f=f: F.coalesce(*[F.col(n).cast("string") for n in names if n in f.columns], F.lit(None).cast("string"))
            parts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in SEARCH_COLUMNS if c in f.columns]
            parts += [F.to_json(c) for c in ("messages",) if dict(f.dtypes).get(c, "").startswith("array")]
            frames.append(f.select("doc", pick("kind").alias("kind"), pick("name", "tag_name", "operand", "routine", "id").alias("name"), pick("scope", "program", "owner", "module").alias("scope"), F.concat_ws(" ", *parts).alias("text")))
        docs = union_all(frames)
        return docs.withColumn("key", F.sha2(F.concat_ws("\0", "doc", "kind", "name", "scope", "text"), 256)).dropDuplicates(["key"])

    def search(self, query: str, kinds: list[str] | None = None, scope: str | None = None) -> DataFrame:
        """Hits, best first, each with the window of 32 terms that shows most of the query; from the workspace's stored index if it has one."""
        store = self._search_store()
        hits = search.search(store[0], "key", "name", "text", query, kinds, scope, *store[1:], places=True).drop("length")
        return search.snippets(hits, "text", query).orderBy(F.desc("score"), "kind", "name", "key")

    def _search_store(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        stored = getattr(self.data, "search_store", None)
        return (self.search_documents(), None, None) if stored is None else stored()

    def exists(self, query: str, kinds: list[str] | None = None, scope: str | None = None, most: int = 100) -> int:
        """How many hits a query has, counted up to ``most``; nothing is sorted."""
        store = self._search_store()
        return search.search(store[0], "key", "name", "text", query, kinds, scope, *store[1:]).limit(most).count()

    def search_logic(self, pattern: str) -> DataFrame:
        return self.data.routine_units.where(match.contains(F.coalesce("text", F.lit("")), pattern)).select("id", "routine_id", "kind", snippet(F.col("text"), pattern).alias("snippet"))

    def find_symbol(self, name: str, scope: str | None = None) -> DataFrame:
        s = self.data.symbols.where(F.col("name") == name)
        return (s.where(F.col("scope") == scope) if scope else s).orderBy("kind", "id").limit(1)

    def find_entity(self, entity_id: str) -> DataFrame:
        return self.data.entities.where(F.col("id") == entity_id).orderBy("kind").limit(1)

    def suggestions(self, name: str, kind: str | None = None) -> DataFrame:
        s = self.data.symbols
        return paging.did_you_mean(s.where(F.col("kind") == kind) if kind else s, "name", name)

    def coverage_limits(self, area: str | None = None) -> DataFrame:
        """Surfaces with missing elements; of an area (sfc, routine, project) those that concern it."""
        found = self.data.coverage().where("missing_count > 0")
        return found if area is None else found.where(F.col("surface").isin(*AREAS.get(area.lower(), ())))

    def name_context(self, names: DataFrame, most: int = 3) -> DataFrame:
        """Of each of ``names`` (doc, name): references to it and its members, those to itself, its writers and readers, the first writer, the first ``most`` references with their evidence, and whether a writer's logic is known (trace_status).

        One pass over the references for all names: counts combine before the shuffle, and references are cut in each task.
        """
        own = names.select("doc", F.col("name").alias("base_symbol")).distinct()
        x = self.data.xrefs.join(own, ["doc", "base_symbol"]).withColumn("name", F.col("base_symbol"))
        writes = F.col("access").isin(*WRITE)
        texts = self.unit_texts().where("text is not null").select("doc", "source").distinct().withColumn("known", F.lit(True))
        x = x.join(texts, ["doc", "source"], "left").withColumn("traced", writes & (F.coalesce("known", F.lit(False)) | F.col("language").isin("FBD", "ST")))
        counts = x.groupBy("doc", "name").agg(
            F.count("*").alias("references"), F.count_if(F.col("symbol") == F.col("name")).alias("exact_references"), F.count_if(writes).alias("writers"), F.count_if(F.col("access").isin(*READ)).alias("readers"),
            F.min(F.when(writes, F.struct("routine", "source", "instruction"))).alias("first_writer"), F.when(F.max("traced"), "ok").otherwise("unresolved").alias("trace_status"),
        )
        rank = F.row_number().over(W.partitionBy("doc", "name").orderBy("routine", "source", "symbol", "access"))
        first = x.withColumn("r", rank).where(F.col("r") <= most).join(self.evidence(), ["doc", "source"], "left")
        shown = F.struct("r", "symbol", "access", "routine", "source", "snippet")
        samples = first.groupBy("doc", "name").agg(F.sort_array(F.collect_list(shown)).alias("evidence"))  # at most ``most``
        return counts.join(samples, ["doc", "name"], "left")

    def triage(self, text: str) -> dict:
        """Names in an issue text that the project knows, each with its reference count; and the first search hits."""
        tokens = [t for t in re.findall(r"[A-Za-z0-9_#.-]+", text) if len(t) > 2 and t.lower() not in STOP_WORDS][:12]
        known = self.data.symbols.where(F.lower("name").isin(*[t.lower() for t in tokens])) if tokens else self.data.symbols.limit(0)
        counts = self.data.xrefs.groupBy("doc", F.col("base_symbol").alias("name")).agg(F.count("*").alias("references"))
        names = known.select("doc", "name", "kind", "id").join(counts, ["doc", "name"], "left")
        hits = None
        for q in [text, *tokens]:
            hits = self.search(q)
            if not hits.isEmpty():
                break
        return {"tokens": tokens, "names": names, "hits": hits, "context": self.name_context(known)}

    @staticmethod
    def scope_limits(text: str) -> list[str]:
        """What an issue text may need beyond the export."""
        return ["read_only_offline_export_only", *[limit for limit, words in BEYOND if re.search(rf"\b(?:{'|'.join(words)})\b", text.lower())]]

    # --- diagnostics

    def findings(self, only: list[str] | None = None, severity: str | None = None) -> DataFrame:
        """Static findings of all rules; see ``rules.run``."""
        return rules.run({name: getattr(self, f"_rule_{name}") for name in RULES}, only, severity)

    def _finding(self, frame: DataFrame, rule: str, severity, entity: str, title: Column, detail: str | Column) -> DataFrame:
        level = severity if isinstance(severity, Column) else F.lit(severity)
        return frame.select("doc", F.lit(rule).alias("rule"), level.alias("severity"), F.col(entity).alias("entity"), title.alias("title"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))

    def _known(self) -> DataFrame:
        return windows.first_per_key(self.data.tags.select("doc", "name", "data_type", "tag_type", "alias_for", "constant", "id"), ITEM, ["id"])

    def _accessed(self, wanted: tuple[str, ...]) -> DataFrame:
        return self.data.xrefs.where(F.col("access").isin(*wanted) & (F.col("base_symbol") != "")).select("doc", F.col("base_symbol").alias("name"), "routine", F.concat_ws("/", F.coalesce("program", F.substring_index("owner", ":", -1)), "routine_name").alias("label"))

    def _quoted(self, before: str, name: str, after: str) -> Column:
        return F.concat(F.lit(f"{before}'"), F.col(name), F.lit(f"'{after}"))

    def _rule_multiple_output(self) -> DataFrame:
        many = rules.multiple_writers(self._accessed(("write",)), ITEM, "label").join(self._known(), ITEM)
        title = F.concat(F.lit("'"), "name", F.lit("' is written by "), "writer_count", F.lit(" routines"))
        return self._finding(many, "multiple_output", F.when(F.col("data_type") == "BOOL", "warning").otherwise("info"), "name", title, F.array_join("writers", ", "))

    def _plain_tags(self) -> DataFrame:
        return self._known().where("coalesce(tag_type, '') <> 'Alias' and alias_for is null")

    def _rule_written_never_read(self) -> DataFrame:
        found = rules.written_never_read(self._accessed(WRITE), self._accessed(READ), ITEM).join(self._plain_tags(), ITEM)
        return self._finding(found, "written_never_read", "info", "name", self._quoted("", "name", " is written but never read"), "A dead output, or read outside of this project.")

    def _rule_read_never_written(self) -> DataFrame:
        found = rules.read_never_written(self._accessed(WRITE), self._accessed(READ), ITEM).join(self._plain_tags().where("lower(coalesce(constant, '')) <> 'true'"), ITEM)
        return self._finding(found, "read_never_written", "info", "name", self._quoted("", "name", " is read but never written"), "Driven from outside, or never set.")

    def _rule_broken_alias(self) -> DataFrame:
        a = self.data.tags.where("alias_for <> '' and instr(alias_for, ':') = 0").withColumn("target", base_symbol(F.col("alias_for")))
        found = rules.broken_references(a, "target", [(self.data.tags, "name"), (self.data.modules, "name")], ["doc"])
        return self._finding(found, "broken_alias", "error", "name", self._quoted("Alias ", "name", " points to nothing known"), F.col("alias_for"))

    def _rule_unscheduled_program(self) -> DataFrame:
        return self._finding(self.scheduling().where("task is null"), "unscheduled_program", "warning", "program", self._quoted("Program ", "program", " is in no task"), "It does not execute.")

    def _rule_inhibited_or_faulted_module(self) -> DataFrame:
        bad = lambda c: F.lower(F.coalesce(c, F.lit(""))) == "true"
        states = F.concat_ws(" and ", F.when(bad("inhibited"), "inhibited"), F.when(bad("major_fault"), "major fault"))
        found = self.data.modules.withColumn("states", states).where("states <> ''")
        return self._finding(found, "inhibited_or_faulted_module", "warning", "name", F.concat(F.lit("Module '"), "name", F.lit("' is "), "states"), F.coalesce("catalog_number", F.lit("")))

    def _used_types(self) -> list[tuple[DataFrame, str]]:
        members = self.data.data_types.select("doc", F.explode("members").alias("m")).select("doc", F.col("m.data_type").alias("data_type"))
        return [(self.data.tags, "data_type"), (self.data.aoi_parameters, "data_type"), (members, "data_type")]

    def _rule_aoi_never_instantiated(self) -> DataFrame:
        a = self.data.aoi_definitions.withColumn("op", F.upper("name")).join(self.data.xrefs.select("doc", F.upper("instruction").alias("op")).distinct(), ["doc", "op"], "left_anti")
        found = rules.unused_definitions(a, "name", self._used_types(), ["doc"])
        return self._finding(found, "aoi_never_instantiated", "info", "name", self._quoted("Add-on instruction ", "name", " is never used"), "No call and no tag of its type.")

    def _rule_udt_never_used(self) -> DataFrame:
        found = rules.unused_definitions(self.data.data_types, "name", self._used_types(), ["doc"])
        return self._finding(found, "udt_never_used", "info", "name", self._quoted("Type ", "name", " is never used"), "No tag, parameter or member has it.")

    def _rule_alarm_tag_unknown(self) -> DataFrame:
        a = self.data.alarms.withColumn("base", base_symbol(F.col("tag_name"))).where("base <> ''")
        found = rules.broken_references(a, "base", [(self.data.tags, "name")], ["doc"])
        return self._finding(found, "alarm_tag_unknown", "info", "tag_name", self._quoted("Alarm on ", "tag_name", " has no such tag"), "Its tag is not in the project.")


RULES = [n.removeprefix("_rule_") for n in vars(Analysis) if n.startswith("_rule_")]


def base_of(symbol: str) -> str:
    return symbol.split(".", 1)[0].split("[", 1)[0]


def windows_ordinal() -> Column:
    from pyspark.sql import Window as W

    return F.row_number().over(W.partitionBy("doc", "sheet_id", "to_id").orderBy("id"))
