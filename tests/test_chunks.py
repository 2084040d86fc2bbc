"""Large exports in chunks cut anywhere: the node table equals that of a single pass."""

import re

import pytest

from fixtures import PROJECT
from millwright.sources import project

EXTRA = """
  <!-- a comment with <Tags> and "quotes' -->
  <Tags Use="a > b"><Tag Name="x>y"  Note='say "hi" &lt;now&gt;'>text &amp; <![CDATA[<Tag Name="no"> ]] ]]> more<Description><![CDATA[long <text> here]]> and <b>inner</b> end</Description>
    <Data Format="L5K"><![CDATA[[1,2,<3>]]]></Data> tail</Tag><?keep <this> ?><Tag Name="é日本"/></Tags>
  <EngineeringUnits><EngineeringUnit Operand=".A">m/s<!-- c -->2</EngineeringUnit></EngineeringUnits> behind
  <Empty></Empty><ns:Other xmlns:ns="urn:x" ns:kind="k"><ns:Tag/></ns:Other>
"""


def with_extra(text):
    at = text.index("<Tags")
    return text[:at] + EXTRA.strip() + text[at:]


def split(text, cuts):
    """Chunks of a file as the text source makes them: each begins behind a "<" at or after the cut."""
    body = text[text.index("<") :]
    starts = sorted({0, *(i for i in (body.find("<", c) for c in cuts) if i > 0)})
    return [body[a:b] for a, b in zip(starts, [*starts[1:], len(body)])]


def in_chunks(text, cuts):
    chunks = split(text, cuts)
    effects = [{way: project.chunk_effect(c, way) for way in ("", *project.INSIDE)} for c in chunks]
    contexts = list(project.fold_effects("d", effects))
    rows, pieces = [], {}
    for k, (c, context) in enumerate(zip(chunks, contexts)):
        for r in project.chunk_rows("d", k, c, context):
            if "piece" in r:
                pieces.setdefault(r["pre"], []).append({"context": None, **r})
            else:
                rows.append(r)
    import pandas as pd

    for group in pieces.values():
        rows += project._whole_rows(pd.DataFrame(group)).to_dict("records")
    return sorted(({c: r[c] for c in project.COLUMNS} for r in rows), key=lambda r: r["pre"])


def whole(text):
    return sorted(({c: r[c] for c in project.COLUMNS} for r in project.nodes_of("d", text.encode())), key=lambda r: r["pre"])


def same(got, want):
    for a, b in zip(got, want):
        for c in project.COLUMNS:
            x, y = a[c], b[c]
            if c == "raw_xml" and x and y:  # a comment behind an element parts the text behind it
                x, y = x.rstrip(), y.rstrip()
            assert x == y or (x != x and y is None) or (c == "parent_pre" and (x is None or x != x) and y is None), (b["path_p"], c, x, y)
    assert len(got) == len(want)


@pytest.mark.parametrize("size", [40, 97, 333, 1500])
def test_cut_anywhere(size):
    text = with_extra(PROJECT)
    want = whole(text)
    for shift in range(0, size, max(1, size // 6)):
        same(in_chunks(text, range(shift, len(text), size)), want)


def test_every_single_cut():
    text = with_extra(PROJECT)
    at = text.index("<!-- a comment") - text.index("<")
    want = whole(text)
    for cut in range(at - 5, at + len(EXTRA) + 5, 3):
        same(in_chunks(text, [cut]), want)


def test_broken_files():
    for bad in ("<A><Controller/></A>", "<RSLogix5000Content><Other/></RSLogix5000Content>", PROJECT[:-40], PROJECT.replace("</Controller>", "", 1)):
        with pytest.raises(project.ProjectFormatError):
            in_chunks(bad, range(0, len(bad), 200))


def test_spark_splits_a_file(spark, tmp_path):
    text = with_extra(PROJECT)
    (tmp_path / "my plant+1.L5X").write_text(text, encoding="utf-8")
    (tmp_path / "other.L5X").write_text(PROJECT)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    one = project.read_nodes(spark, f"{tmp_path}/*.L5X").orderBy("doc", "pre").collect()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        many = project.read_nodes(spark, f"{tmp_path}/*.L5X", whole_bytes=100)
        rows = many.orderBy("doc", "pre").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(one) == len(rows)
    for a, b in zip(rows, one):
        a, b = a.asDict(True), b.asDict(True)
        raw = [re.sub(r"\s+$", "", r.pop("raw_xml") or "") for r in (a, b)]
        assert a == b and raw[0] == raw[1]
