"""Scan of controller project exports: each file becomes rows of one node table."""

from __future__ import annotations

import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.sources.shared import materialize

ROOT = "RSLogix5000Content"
# Elements whose whole text is read (fixed values of the format).
TEXT_ELEMENTS = (
    "Description", "Comment", "Text", "Line", "Data", "DefaultData", "AlarmClass", "EngineeringUnit", "TextBox",
    "Vendor", "CatNum", "ConfigID", "ADDAVersion", "ChildProgram", "RedundancyInfo", "Security", "SafetyInfo",
    "CST", "WallClockTime", "TimeSynchronize",
)
# Elements kept as raw fragments: those that a dataset also normalizes, and the others.
SEMANTIC = (
    "MessageParameters", "DataTypeFormats", "DataTypeFormat", "PL", "Version", "EngineeringUnits",
    "EngineeringUnit", "RedundancyInfo", "Security", "SafetyInfo", "CST", "WallClockTime", "TimeSynchronize",
    "ChildProgram",
)
RAW = (
    "Trends", "DataLogs", "ChildPrograms", "RevisionNote", "HMICmd",
)

WHOLE = frozenset((*TEXT_ELEMENTS, *SEMANTIC, *RAW))
WHOLE_BYTES = 64 << 20  # a file up to this size is one task

NODES = (
    "doc string, pre long, post long, parent_pre long, depth int, ordinal int, sib int, name string, attrs map<string,string>, "
    "direct_text string, text string, path_p string, path_x string, anc array<struct<pre: long, name: string, attrs: map<string,string>>>, raw_xml string"
)
PATH_KEYS = {"path_p": ("Name", "Operand", "Number", "ID", "Type", "Format"), "path_x": ("Name", "Operand", "Type", "Format", "Index", "Id")}


class ProjectFormatError(ValueError):
    """The file is no controller project."""


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def segment(name: str, attrs: dict[str, str], keys: tuple[str, ...], ordinal: int | None) -> str:
    for key in keys:
        if attrs.get(key):
            return f"{name}[@{key}={attrs[key]!r}]"
    return name if ordinal is None else f"{name}[{ordinal}]"


class Scan:
    """Rows of the elements of a stream of parser events, each when it ends; ``pre`` and ``post`` enclose those of the elements inside.

    An element leaves memory when it ends, unless one around it is read whole. ``above`` are the elements that are open
    where the stream begins, from the root on: their start tags and what else a chunk's context says of them.
    """

    def __init__(self, doc: str, clock: int = 0, above: list[dict] | None = None):
        self.doc, self.clock, self.given = doc, clock, list(above or [])
        self.controller = bool(self.given)
        self.open: list[tuple[ET.Element, dict, dict[str, int]]] = []  # element, row, children seen by name
        self.whole = 0
        self.held: tuple[dict, ET.Element] | None = None  # a row that waits for the text behind its element

    def _release(self):
        if self.held is not None:
            row, elem = self.held
            self.held = None
            row["raw_xml"] += elem.tail or ""
            yield row
            self._forget(elem)

    def _forget(self, elem: ET.Element) -> None:
        if not self.whole:
            elem.clear()
            if self.open:
                self.open[-1][0].remove(elem)

    def __call__(self, events):
        for event, elem in events:
            yield from self._release()
            name = local(elem.tag)
            if event == "start":
                self._start(name, elem)
                continue
            _, row, _ = self.open.pop()
            self.whole -= name in WHOLE
            row |= {"post": self.clock, "direct_text": (elem.text or "").strip(), "text": "".join(elem.itertext()).strip() if name in TEXT_ELEMENTS else None, "raw_xml": None}
            self.clock += 1
            if name in SEMANTIC or name in RAW:
                tail, elem.tail = elem.tail, None
                row["raw_xml"] = ET.tostring(elem, encoding="unicode")
                elem.tail = tail
                self.held = row, elem
                continue
            yield row
            self._forget(elem)

    def end(self):
        yield from self._release()

    def _start(self, name: str, elem: ET.Element) -> None:
        attrs = {local(k): v for k, v in elem.attrib.items()}
        given = self.given.pop(0) if self.given else None
        if self.open:
            _, above, seen = self.open[-1]
            if given is None:
                seen[name] = seen.get(name, 0) + 1
            ordinal, sib, parent, depth = (seen[name], sum(seen.values()) - 1, above["pre"], above["depth"] + 1) if given is None else (given["ordinal"], given["sib"], above["pre"], above["depth"] + 1)
            anc = [*above["anc"], {"pre": above["pre"], "name": above["name"], "attrs": above["attrs"]}]
            self.controller |= depth == 1 and name == "Controller"
        elif name != ROOT:
            raise ProjectFormatError(f"{self.doc}: not a project export with a controller")
        else:
            above, ordinal, sib, parent, depth, anc = None, 1, 0, None, 0, []
        row = {"doc": self.doc, "pre": self.clock if given is None else given["pre"], "parent_pre": parent, "depth": depth, "ordinal": ordinal, "sib": sib, "name": name, "attrs": attrs, "anc": anc}
        for out, keys in PATH_KEYS.items():
            step = segment(name, attrs, keys, ordinal if above is not None else None)
            row[out] = f"{above[out]}/{step}" if above is not None else step
        self.clock += given is None
        self.whole += name in WHOLE
        self.open.append((elem, row, dict(given["seen"]) if given else {}))


def nodes_of(doc: str, content: bytes):
    """Rows of the elements of one file, parsed as a stream."""
    scan = Scan(doc)
    try:
        yield from scan(ET.iterparse(io.BytesIO(content), events=("start", "end")))
        yield from scan.end()
    except ET.ParseError as e:
        raise ProjectFormatError(f"{doc}: {e}") from e
    if not scan.controller:
        raise ProjectFormatError(f"{doc}: not a project export with a controller")


COLUMNS = [c.split()[0] for c in NODES.replace("array<struct<pre: long, name: string, attrs: map<string,string>>>", "a").split(", ")]


def _frames(rows):
    while part := list(islice(rows, 5000)):
        yield pd.DataFrame(part, columns=COLUMNS)


def _parse(frames):
    for pdf in frames:
        for doc, content in zip(pdf["path"], pdf["content"]):
            yield from _frames(nodes_of(doc, content))


def read_nodes(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Node rows of all project files under ``path`` (a file, folder or glob): one task a file up to ``whole_bytes``, several for a larger one."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInPandas(_parse, NODES)
    large = [r["path"] for r in files.where(F.col("length") > whole_bytes).select("path").collect()]  # names alone, each of a large file
    return rows.unionByName(read_chunks(spark, large)) if large else rows


# --- large files ------------------------------------------------------------------------------------------------
#
# A file is read as text rows that end before each "<", which Spark splits into chunks by bytes. Nothing but comments,
# CDATA sections and processing instructions can hold a "<", so a chunk begins at a tag or inside one of these. Every
# chunk is reduced to what it does to the stack of open elements; a scan over these effects, a few numbers and the open
# tags a chunk, gives each chunk its context; with that each chunk is parsed by itself. An element whose text is read
# whole and that passes a chunk's end is put together from its pieces first.

TOKEN = re.compile(
    r"<!--(?:.*?-->|(?P<comment>.*)\Z)|<!\[CDATA\[(?:.*?\]\]>|(?P<cdata>.*)\Z)|<\?(?:.*?\?>|(?P<pi>.*)\Z)|<!(?:[^>]*)>"
    r"|</(?P<close>[^\s>]+)\s*>|<(?P<open>[^\s/>!?]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/)?>",
    re.S,
)
INSIDE = {"comment": ("<!--", "-->"), "cdata": ("<![CDATA[", "]]>"), "pi": ("<?x ", "?>")}


def chunk_effect(text: str, inside: str = "") -> dict:
    """What a chunk does to the stack of open elements, if it begins ``inside`` a comment, CDATA section or instruction ("": at a tag).

    ``seen``: children by name of the element at the top, then of each one uncovered by a close. ``pushed``: elements
    open at the end, with the text behind their tag while they have no child. ``lead``: text before the first tag.
    """
    at = 0
    if inside:
        stop = text.find(INSIDE[inside][1])
        if stop < 0:
            return {"seen": [{}], "pushed": [], "ticks": 0, "lead": text, "inside": inside, "tagged": False}
        at = stop + len(INSIDE[inside][1])
    seen: list[dict] = [{}]
    pushed: list[dict] = []
    ticks, lead, ends_inside = 0, None, ""
    for m in TOKEN.finditer(text, at):
        if m["open"] or m["close"]:
            if lead is None:
                lead = text[: m.start()]
            if pushed and pushed[-1]["text"] is None:
                pushed[-1]["text"] = text[pushed[-1]["end"] : m.start()]
        if m["open"]:
            name = m["open"].rsplit(":", 1)[-1]
            children = pushed[-1]["seen"] if pushed else seen[-1]
            children[name] = children.get(name, 0) + 1
            ticks += 1
            if m["empty"]:
                ticks += 1
            else:
                pushed.append({"tag": m[0], "name": name, "seen": {}, "ordinal": children[name], "sib": sum(children.values()) - 1, "tick": ticks - 1, "start": m.start(), "end": m.end(), "text": None})
        elif m["close"]:
            ticks += 1
            if pushed:
                pushed.pop()
            else:
                seen.append({})
        else:
            ends_inside = next((k for k in INSIDE if m[k] is not None), "")
    if pushed and pushed[-1]["text"] is None:
        pushed[-1]["text"] = text[pushed[-1]["end"] :]
    return {"seen": seen, "pushed": pushed, "ticks": ticks, "lead": text if lead is None else lead, "inside": ends_inside, "tagged": lead is not None}


def fold_effects(doc: str, effects: list[dict[str, dict]]):
    """The context of each chunk of a file, in their order, from the effects of each for every way to begin."""
    stack: list[dict] = []
    clock, inside, controller = 0, "", False
    for ways in effects:
        yield {"stack": [{**{x: e[x] for x in ("tag", "name", "pre", "ordinal", "sib", "text")}, "seen": dict(e["seen"])} for e in stack], "clock": clock, "inside": inside}
        e = ways[inside]
        if stack and not stack[-1]["seen"] and not stack[-1]["closed"]:
            stack[-1]["text"] += e["lead"]
        if e["tagged"] and stack:
            stack[-1]["closed"] = True
        for level, children in enumerate(e["seen"]):
            if level:
                if not stack:
                    raise ProjectFormatError(f"{doc}: an end tag without its start")
                stack.pop()
            before = stack[-1]["seen"] if stack else {}
            offset = dict(before), sum(before.values())
            controller |= len(stack) == 1 and "Controller" in children
            for name, n in children.items():
                before[name] = before.get(name, 0) + n
        for level, p in enumerate(e["pushed"]):
            first = level == 0  # its siblings before are those of the chunk and of earlier ones
            stack.append({**p, "pre": clock + p["tick"], "ordinal": p["ordinal"] + (offset[0].get(p["name"], 0) if first else 0), "sib": p["sib"] + (offset[1] if first else 0), "seen": dict(p["seen"]), "closed": bool(p["seen"])})
        clock += e["ticks"]
        inside = e["inside"]
        controller |= bool(stack) and "Controller" in stack[0]["seen"]
    if stack or inside or not controller:
        raise ProjectFormatError(f"{doc}: not a project export with a controller, or no end")


def _whole_end(text: str, depth: int, inside: str) -> tuple[int, int]:
    """Where an element that is open ``depth`` levels above the chunk's beginning ends, with the text behind it, and the ticks up to there; -1 if it does not."""
    at = 0
    if inside:
        at = text.find(INSIDE[inside][1])
        if at < 0:
            return -1, 0
    ticks = 0
    for m in TOKEN.finditer(text, at):
        if m["open"]:
            ticks += 2 if m["empty"] else 1
            depth += not m["empty"]
        elif m["close"]:
            ticks += 1
            depth -= 1
            if not depth:
                more = next((x for x in TOKEN.finditer(text, m.end()) if x["open"] or x["close"]), None)
                return more.start() if more else len(text), ticks
    return -1, ticks


def _feed(scan: Scan, above: list[dict], inside: str, text: str):
    """Rows of a chunk after the tags above it."""
    parser = ET.XMLPullParser(events=("start", "end"))
    for e in above:
        parser.feed(e["tag"] + (e["text"] or ""))
    if inside and (not above or above[-1]["seen"]):  # its text was closed by a child: only the kind of what is open matters
        parser.feed(INSIDE[inside][0])
    for at in range(0, len(text), 1 << 20):
        parser.feed(text[at : at + (1 << 20)])
        yield from scan(parser.read_events())
    parser.flush()  # the parser may hold back what it has not seen the end of
    yield from scan(parser.read_events())
    if scan.open:  # and the tree the text behind the last element
        parser.feed("<end>")
        parser.flush()


def chunk_rows(doc: str, block: int, text: str, context: dict):
    """Node rows of a chunk, and pieces (dictionaries with ``piece``) of elements that are read whole and lie in several chunks."""
    stack, clock, inside = context["stack"], context["clock"], context["inside"]
    at = next((i for i, e in enumerate(stack) if e["name"] in WHOLE), None)
    if at is not None:
        whole = stack[at]
        stop, ticks = _whole_end(text, len(stack) - at, inside)
        yield {"doc": doc, "pre": whole["pre"], "piece": text if stop < 0 else text[:stop], "block": block}
        if stop < 0:
            return
        text, clock, stack, inside = text[stop:], clock + ticks, stack[:at], ""
    effect = chunk_effect(text, inside)
    cut = next((p for p in effect["pushed"] if p["name"] in WHOLE), None)
    scan = Scan(doc, clock, stack)
    try:
        yield from _feed(scan, stack, inside, text if cut is None else text[: cut["start"]])
        yield from scan.end()
    except ET.ParseError as e:
        raise ProjectFormatError(f"{doc}: {e}") from e
    if cut is not None:
        tags = [e["tag"] for e in stack[: len(stack) - len(effect["seen"]) + 1]] + [p["tag"] for p in effect["pushed"][: effect["pushed"].index(cut)]]
        above = [{"tag": tag, "name": r["name"], "pre": r["pre"], "ordinal": r["ordinal"], "sib": r["sib"], "seen": seen, "text": ""} for tag, (_, r, seen) in zip(tags, scan.open, strict=True)]
        yield {"doc": doc, "pre": clock + cut["tick"], "piece": text[cut["start"] :], "block": block, "context": json.dumps({"stack": above, "clock": clock + cut["tick"]})}


def _gather(batches):
    """One row a chunk, with its effects for every way to begin."""

    def chunk(doc, block, rows):
        text = "<".join(rows if block else rows[1:])  # before the first "<" there is no element
        text = f"<{text}" if block or len(rows) > 1 else ""
        ways = {way: chunk_effect(text, way) for way in ("", *INSIDE)}
        return pa.RecordBatch.from_pydict({"doc": [doc], "block": pa.array([block], pa.int64()), "text": [text], "effects": [json.dumps(ways)]})

    key, rows = None, []
    for b in batches:
        for value, doc, block in zip(*(b.column(i).to_pylist() for i in range(3))):
            if (doc, block) != key:
                if rows:
                    yield chunk(*key, rows)
                key, rows = (doc, block), []
            rows.append(value)
    if rows:
        yield chunk(*key, rows)


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    contexts = fold_effects(pdf["doc"].iloc[0], [json.loads(x) for x in pdf["effects"]])
    return pd.DataFrame({"doc": pdf["doc"], "block": pdf["block"], "context": [json.dumps(c) for c in contexts]})


def _chunk_frames(frames):
    for pdf in frames:
        for doc, block, text, context in pdf[["doc", "block", "text", "context"]].itertuples(index=False):
            pieces: list[dict] = []

            def rows(doc=doc, block=block, text=text, context=context, pieces=pieces):
                for r in chunk_rows(doc, block, text, json.loads(context)):
                    if "piece" in r:
                        pieces.append(r)
                    else:
                        yield r

            for part in _frames(rows()):
                yield part.assign(piece=None, block=None, context=None)
            if pieces:
                yield pd.DataFrame(pieces, columns=[*COLUMNS, "piece", "block", "context"])


def _whole_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one element that is read whole, from its pieces."""
    pdf = pdf.sort_values("block")
    context = json.loads(pdf["context"].iloc[0])
    scan = Scan(pdf["doc"].iloc[0], context["clock"], context["stack"])
    rows = [*_feed(scan, context["stack"], "", "".join(pdf["piece"])), *scan.end()]
    return pd.DataFrame(rows, columns=COLUMNS)


def read_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Node rows of files (UTF-8) that Spark may split anywhere, in chunks of ``spark.sql.files.maxPartitionBytes``."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("lineSep", "<").text(paths).select("value", F.regexp_replace(path, "^(\\w+):///", "$1:/").alias("doc"), F.col("_metadata.file_block_start").alias("block"))
    chunks = materialize(lines.mapInArrow(_gather, "doc string, block long, text string, effects string"), "project-chunks")
    contexts = chunks.select("doc", "block", "effects").groupBy("doc").applyInPandas(_fold, "doc string, block long, context string")  # a few rows a file
    both = chunks.select("doc", "block", "text").join(contexts, ["doc", "block"])
    parsed = materialize(both.mapInPandas(_chunk_frames, f"{NODES}, piece string, block long, context string"), "project-rows")
    whole = parsed.where("piece is not null").select("doc", "pre", "block", "piece", "context").groupBy("doc", "pre").applyInPandas(_whole_rows, NODES)
    return parsed.where("piece is null").select(*COLUMNS).unionByName(whole)


def fingerprint(content: bytes, length: int = 12) -> str:
    return hashlib.sha256(content).hexdigest()[:length]
