"""Markdown reading views of a project, one document per row; the caller decides where they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.text import file_name

MOST_REFERENCES = 1000


def one_line(c):
    return F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))


def table(frame: DataFrame, keys: list[str], columns: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """keys, body: a Markdown table of each group's rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[one_line(F.col(c).cast("string")) for c in columns]), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], line.alias("line"))))
    rows = rows if most is None else F.slice(rows, 1, most)
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return frame.groupBy(*keys).agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("body"))


def views(data) -> DataFrame:
    """name (of the file), title, body of all views."""
    page = lambda f, folder, name, title: f.select(F.concat(F.lit(folder + "/"), file_name(name), F.lit(".md")).alias("name"), title.alias("title"), "body")
    tags = table(data.tags, ["scope_type", "scope"], ["name", "data_type", "alias_for", "description"], ["name"])
    x = data.xrefs.withColumnRenamed("routine", "routine_id")
    refs = table(x, ["routine_id"], ["symbol", "access", "instruction", "location"], ["seq", "source", "symbol"], MOST_REFERENCES)
    text = data.routines.where("body is not null").select(F.col("id"), F.concat(F.lit("```\n"), "body", F.lit("\n```")).alias("body"))
    udts = table(data.data_types.select("name", F.posexplode("members").alias("n", "m")).select(F.col("name").alias("type"), "n", "m.*"), ["type"], ["name", "data_type", "description"], ["n"])
    points = table(data.module_io_points, ["module"], ["role", "operand", "point", "description"], ["role", "operand"])
    params = table(data.aoi_parameters, ["aoi"], ["name", "usage", "data_type", "required"], ["sib"])
    alarms = table(data.alarms, ["alarm_class"], ["tag_name", "alarm_type", "severity"], ["tag_name"])
    modules = table(data.modules, ["doc"], ["name", "catalog_number", "parent_module", "slot", "address", "inhibited"], ["name", "id"])
    tasks = table(data.tasks.withColumn("programs", F.array_join("scheduled_programs", ", ")), ["doc"], ["name", "task_type", "rate", "priority", "programs"], ["name"])
    programs = table(data.programs, ["doc"], ["name", "main_routine", "fault_routine", "description"], ["name"])
    comments = table(data.comments, ["owner"], ["target", "text"], ["target", "id"], MOST_REFERENCES)
    messages = table(data.messages, ["tag_name"], ["message_type", "lang", "text"], ["message_no", "text_no"])
    charts = table(data.sfc_nodes, ["chart_id"], ["node_type", "node_id", "operand", "condition_body", "st_body"], ["pre"])
    transfers = table(data.message_parameters, ["doc"], ["tag_name", "message_type", "connection_path", "destination_tag"], ["tag_name", "id"])
    metadata = table(data.controller_metadata, ["doc"], ["element", "name", "text"], ["element", "id"])
    covered = table(data.coverage(), ["priority"], ["surface", "source_count", "covered_count", "missing_count"], ["surface"])
    of = lambda c: F.regexp_extract(F.col(c), r"([^/]*)$", 1)  # noqa: E731  the file of a project
    frames = [
        page(modules, "modules", of("doc"), F.concat(F.lit("Modules of "), of("doc"))),
        page(tasks, "tasks", of("doc"), F.concat(F.lit("Tasks of "), of("doc"))),
        page(programs, "programs", of("doc"), F.concat(F.lit("Programs of "), of("doc"))),
        page(comments, "comments", F.coalesce("owner", F.lit("none")), F.concat(F.lit("Comments of "), F.coalesce("owner", F.lit("none")))),
        page(messages, "messages", F.col("tag_name"), F.concat(F.lit("Messages of "), "tag_name")),
        page(charts, "charts", F.col("chart_id"), F.concat(F.lit("Chart "), "chart_id")),
        page(transfers, "transfers", of("doc"), F.concat(F.lit("Message transfers of "), of("doc"))),
        page(metadata, "metadata", of("doc"), F.concat(F.lit("Controller metadata of "), of("doc"))),
        page(covered, "coverage", F.col("priority"), F.concat(F.lit("Coverage "), "priority")),
        page(tags, "tags", F.concat_ws("_", "scope_type", "scope"), F.concat_ws(" ", F.lit("Tags of"), "scope_type", "scope")),
        page(refs, "references", F.col("routine_id"), F.concat(F.lit("References of "), "routine_id")),
        page(text, "routines", F.col("id"), F.concat(F.lit("Routine "), "id")),
        page(udts, "types", F.col("type"), F.concat(F.lit("Type "), "type")),
        page(points, "io_points", F.col("module"), F.concat(F.lit("IO points of "), "module")),
        page(params, "aoi", F.col("aoi"), F.concat(F.lit("Add-on instruction "), "aoi")),
        page(alarms, "alarms", F.coalesce("alarm_class", F.lit("none")), F.concat(F.lit("Alarms of class "), F.coalesce("alarm_class", F.lit("none")))),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("body", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n")))
