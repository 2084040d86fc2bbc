"""Nested values and nested hardware against trees built by hand."""

import json
import xml.etree.ElementTree as ET

import pytest

from fixtures import PROJECT
from millwright.operators.trees import filled, nested_forest
from millwright.plans.project import Project
from millwright.sources import project as scan
from pyspark.sql import functions as F

DEEP = "".join(f'<Structure Name="s{i}">' for i in range(12)) + "<DataValue Value='1'/>" + "</Structure>" * 12
WIDE = '<Array Dimensions="40">' + "".join(f'<Element Index="[{i}]" Value="{i}"/>' for i in range(40)) + "</Array>"
TAGS = f'<Tag Name="Deep"><Data Format="Decorated">{DEEP}</Data></Tag><Tag Name="Wide"><Data Format="Decorated">{WIDE}<Structure>a "text" \\ é</Structure></Data></Tag><Tag Name="None"><Data Format="L5K"/></Tag>'
AT = PROJECT.index("<Tags")
TEXT = PROJECT[: PROJECT.index(">", AT) + 1] + TAGS + PROJECT[PROJECT.index(">", AT) + 1 :]


@pytest.fixture(scope="module")
def project(spark):
    rows = [tuple(r[c] for c in scan.COLUMNS) for r in scan.nodes_of("d", TEXT.encode())]
    return Project(spark.createDataFrame(rows, scan.NODES).repartition(3).cache())


def by_hand(elem, max_depth, max_children, depth=0):
    children = list(elem)
    shown = children if max_children is None else children[:max_children]
    record = filled({"element": elem.tag, "attributes": dict(elem.attrib), "text": (elem.text or "").strip(), "children": [by_hand(c, max_depth, max_children, depth + 1) for c in shown] if depth < max_depth else []})
    return {**record, "children_truncated": len(children) - len(shown), "depth_truncated": bool(children) and depth >= max_depth}


@pytest.mark.parametrize(("max_depth", "max_children"), [(8, None), (4, 3), (0, None), (20, 1)])
def test_nested_values(project, max_depth, max_children):
    got = {(r["tag_name"], r["format"]): json.loads(r["parsed"]) if r["parsed"] else [] for r in project.data_trees(max_depth, max_children).where("tag_name in ('Deep', 'Wide', 'None', 'U1')").collect()}
    for tag in ET.fromstring(TEXT).iter("Tag"):
        if tag.get("Name") in ("Deep", "Wide", "None", "U1"):
            for data in tag.findall("Data"):
                want = [by_hand(c, max_depth, max_children) for c in data][:max_children]
                assert got[tag.get("Name"), data.get("Format")] == want
    assert len(got) == 5


def test_module_bundles(project):
    got = {r["name"]: r for r in project.module_bundles().collect()}
    assert [p["port_id"] for p in got["Adapter"]["ports"]] == ["1", "2"] and [c["name"] for c in got["Adapter"]["connections"]] == ["C1"]
    assert len(got["Adapter"]["io_tags"]) == 2 and got["Stray"]["ports"] == [] and got["Local"]["ports"][0]["bus_size"] == "10"
    assert [p["description"] for p in got["Adapter:4"]["io_points"]] and len(got) == 4


def test_hardware_tree(project):
    r = project.hardware_trees().first()
    roots = json.loads(r["roots"])
    assert [x["name"] for x in roots] == ["Local", "Stray"] and r["orphans"] == ["Stray"] and r["cycles"] == []
    local = roots[0]
    assert local["children"][0]["name"] == "Adapter" and local["children"][0]["children"][0]["name"] == "Adapter:4"
    assert roots[1]["orphan"] and "orphan" not in local and local["children"][0]["children"][0]["children"] == []


def test_forests_of_any_depth_with_cycles(spark):
    rows = [("d", f"n{i:03d}", f"n{i - 1:03d}" if i else None, str(i % 3)) for i in range(40)]  # a chain
    rows += [("d", c, p, s) for c, p, s in (("z", None, "10"), ("b", "z", "x"), ("a", "z", None), ("c", "z", "2"), ("d", "z", "11"))]
    rows += [("d", c, p, None) for c, p in (("r2", "r3"), ("r3", "r1"), ("r1", "r2"), ("tail", "r2"), ("self", "self"), ("lost", "nowhere"), ("tip", "tail"))]
    rows += [("e", "x", None, None)]
    df = spark.createDataFrame(rows, "doc string, name string, parent string, slot string")
    slot = F.when(F.col("slot").rlike(r"^\d+$"), F.col("slot").cast("long")).otherwise(999_999)
    got = {r["doc"]: r for r in nested_forest(df, "name", "parent", ["doc"], ["name", "slot"], [slot.alias("s"), F.col("name")]).collect()}
    roots = {x["name"]: x for x in json.loads(got["d"]["roots"])}
    assert set(roots) == {"n000", "z", "r1", "self", "lost"} and got["d"]["orphans"] == ["lost"] and got["d"]["cycles"] == ["r1"]
    assert [c["name"] for c in roots["z"]["children"]] == ["c", "d", "a", "b"]
    assert roots["r1"]["cycle"] and [c["name"] for c in roots["r1"]["children"]] == ["r3"] and roots["r1"]["children"][0]["children"][0]["name"] == "r2"
    assert [c["name"] for c in roots["r1"]["children"][0]["children"][0]["children"]] == ["tail"]
    node, depth = roots["n000"], 0
    while node["children"]:
        node, depth = node["children"][0], depth + 1
    assert depth == 39 and json.loads(got["e"]["roots"]) == [{"name": "x", "children": []}]
