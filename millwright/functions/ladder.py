"""Ladder and structured text: calls, operand roles, references."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.text import IDENTIFIER, tag_references, without_comments, without_strings

# Each instruction, the roles of its operands in order, and the role of all further operands (None: none).
OPERAND_ROLES = (
    ("XIC", ("read",), None),
    ("XIO", ("read",), None),
    ("CMP", ("read",), None),
    ("EOT", ("read",), None),
    ("OTE", ("write",), None),
    ("OTL", ("write",), None),
    ("OTU", ("write",), None),
    ("RES", ("write",), None),
    ("CLR", ("write",), None),
    ("ONS", ("read_write",), None),
    ("MSG", ("read_write",), None),
    ("IOT", ("read_write",), None),
    ("OSR", ("read_write", "write"), None),
    ("OSF", ("read_write", "write"), None),
    ("TON", ("read_write", "read", "read"), None),
    ("TOF", ("read_write", "read", "read"), None),
    ("RTO", ("read_write", "read", "read"), None),
    ("TONR", ("read_write", "read", "read"), None),
    ("TOFR", ("read_write", "read", "read"), None),
    ("RTOR", ("read_write", "read", "read"), None),
    ("CTU", ("read_write", "read", "read"), None),
    ("CTD", ("read_write", "read", "read"), None),
    ("CTUD", ("read_write", "read", "read"), None),
    ("EQU", ("read", "read"), None),
    ("NEQ", ("read", "read"), None),
    ("LES", ("read", "read"), None),
    ("LEQ", ("read", "read"), None),
    ("GRT", ("read", "read"), None),
    ("GEQ", ("read", "read"), None),
    ("LIM", ("read", "read", "read"), None),
    ("MEQ", ("read", "read", "read"), None),
    ("ADD", ("read", "read", "write"), None),
    ("SUB", ("read", "read", "write"), None),
    ("MUL", ("read", "read", "write"), None),
    ("DIV", ("read", "read", "write"), None),
    ("MOD", ("read", "read", "write"), None),
    ("XPY", ("read", "read", "write"), None),
    ("AND", ("read", "read", "write"), None),
    ("OR", ("read", "read", "write"), None),
    ("XOR", ("read", "read", "write"), None),
    ("SWPB", ("read", "read", "write"), None),
    ("MVM", ("read", "read", "write"), None),
    ("SIZE", ("read", "read", "write"), None),
    ("SQR", ("read", "write"), None),
    ("SQRT", ("read", "write"), None),
    ("NEG", ("read", "write"), None),
    ("ABS", ("read", "write"), None),
    ("LN", ("read", "write"), None),
    ("LOG", ("read", "write"), None),
    ("SIN", ("read", "write"), None),
    ("COS", ("read", "write"), None),
    ("TAN", ("read", "write"), None),
    ("ASN", ("read", "write"), None),
    ("ACS", ("read", "write"), None),
    ("ATN", ("read", "write"), None),
    ("DEG", ("read", "write"), None),
    ("RAD", ("read", "write"), None),
    ("TRN", ("read", "write"), None),
    ("NOT", ("read", "write"), None),
    ("MOV", ("read", "write"), None),
    ("TOD", ("read", "write"), None),
    ("FRD", ("read", "write"), None),
    ("CPT", ("write", "read"), None),
    ("COP", ("read", "write", "read"), None),
    ("CPS", ("read", "write", "read"), None),
    ("FLL", ("read", "write", "read"), None),
    ("BTD", ("read", "read", "write", "read", "read"), None),
    ("DTR", ("read", "read", "read_write"), None),
    ("FAL", ("read_write", "read", "read_write", "read", "write", "read"), None),
    ("FSC", ("read_write", "read", "read_write", "read", "read"), None),
    ("FFL", ("read", "write", "read_write", "read", "read_write"), None),
    ("FFU", ("read", "write", "read_write", "read", "read_write"), None),
    ("LFL", ("read", "write", "read_write", "read", "read_write"), None),
    ("LFU", ("read", "write", "read_write", "read", "read_write"), None),
    ("AVE", ("read", "write", "read_write", "read", "read_write"), None),
    ("BSL", ("read_write", "read_write", "read", "read"), None),
    ("BSR", ("read_write", "read_write", "read", "read"), None),
    ("SRT", ("read_write", "read_write", "read", "read_write"), None),
    ("STD", ("read", "write", "write", "read_write", "read", "read_write"), None),
    ("PID", ("read_write", "read", "read", "read_write"), "read"),
    ("PIDE", ("read_write",), "read"),
    ("GSV", ("read", "read", "read", "write"), None),
    ("SSV", ("read", "read", "read", "read"), None),
    ("ALMD", ("read_write", "read", "read", "read", "read"), None),
    ("ALMA", ("read_write", "read", "read", "read", "read", "read"), None),
    ("JSR", ("call",), "read_write"),
    ("FOR", ("call", "read_write", "read", "read", "read"), None),
    ("SBR", (), "write"),
    ("RET", (), "read"),
    ("JMP", ("label",), None),
    ("LBL", ("label",), None),
    ("SFR", ("call", "read"), None),
    ("SFP", ("call", "read"), None),
)
USAGE = {"Input": "read", "Output": "write", "InOut": "read_write"}
ALARMS = ("ALMD", "ALMA")

CALLS = T.ArrayType(T.StructType([T.StructField("instruction", T.StringType()), T.StructField("args", T.ArrayType(T.StringType())), T.StructField("span", T.ArrayType(T.IntegerType()))]))
_HEAD = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\(")
_MARK = re.compile(r"'(?:\\.|[^'\\])*'?|\"(?:\\.|[^\"\\])*\"?|[()\[\],]")


def ladder_calls(text: str | None) -> list[dict]:
    """Calls of a rung in order, outermost only, with their arguments; a call that never closes is passed over."""
    calls, at = [], 0
    text = text or ""
    while head := _HEAD.search(text, at):
        at, begin, args, round_, nested, close = head.end(), head.end(), [], 1, 0, None
        for mark in _MARK.finditer(text, begin):
            c = mark.group()
            round_ += (c == "(") - (c == ")")
            if round_ == 0:
                close = mark.start()
                break
            if c in "([":
                nested += 1
            elif c in ")]":
                nested = max(0, nested - 1)
            elif c == "," and not nested:
                args.append(text[begin : mark.start()])
                begin = mark.end()
        if close is not None:
            if args or text[begin:close].strip():
                args.append(text[begin:close])
            calls.append({"instruction": head.group(1).upper(), "args": [a.strip().lstrip("#").strip("\"'") for a in args], "span": [head.start(), close + 1]})
            at = close + 1
    return calls


@F.pandas_udf(CALLS)
def parse_calls(text: pd.Series) -> pd.Series:
    return text.map(ladder_calls)


def role_table(spark: SparkSession) -> DataFrame:
    """instruction, roles, rest: the operand roles of the fixed instruction set."""
    rows = [(name, list(roles), rest) for name, roles, rest in OPERAND_ROLES]
    return spark.createDataFrame(rows, "instruction string, roles array<string>, rest string")


def classify(calls: DataFrame, roles: DataFrame, aoi: DataFrame) -> DataFrame:
    """Explode calls (columns instruction, args, ...) to operands with access and confidence.

    The instruction set comes first, then add-on instructions (``aoi``: instruction, aoi_roles, and doc where names
    hold within a project; their operand 0 is the backing tag), and what neither knows is ``unknown``.
    """
    on = [c for c in ("doc", "instruction") if c in aoi.columns]
    rows = calls.join(F.broadcast(roles), "instruction", "left").join(aoi, on, "left")
    rows = rows.select("*", F.posexplode("args").alias("pos", "operand"))
    listed = F.coalesce(F.get("roles", F.col("pos")), F.col("rest"), F.lit("unknown"))
    own = F.when(F.col("pos") == 0, "read_write").otherwise(F.coalesce(F.get("aoi_roles", F.col("pos") - 1), F.lit("read_write")))
    access = F.when(F.col("roles").isNotNull(), listed).when(F.col("aoi_roles").isNotNull(), own).otherwise("unknown")
    return rows.withColumn("access", access).withColumn("confidence", F.when(access == "unknown", "heuristic").otherwise("typed")).drop("roles", "rest", "aoi_roles", "args")


def ladder_references(calls: DataFrame, roles: DataFrame, aoi: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol, access, instruction, confidence, seq from rows (keys, seq, instruction, args), labels dropped."""
    operands = classify(calls, roles, aoi).where("access <> 'label'")
    refs = operands.select(*keys, "seq", "pos", F.posexplode(tag_references(F.col("operand"), calls=False)).alias("nth", "symbol"), "access", "instruction", "confidence")
    # An alarm instruction also sets the InAlarm member of its tag.
    alarm = refs.where(F.col("instruction").isin(*ALARMS) & (F.col("pos") == 0))
    alarm = alarm.select(*keys, "seq", (F.col("pos") + 1000).alias("pos"), "nth", F.concat("symbol", F.lit(".InAlarm")).alias("symbol"), F.lit("write").alias("access"), "instruction", F.lit("typed").alias("confidence"))
    every = refs.unionByName(alarm)
    best = F.min(F.struct("seq", "pos", "nth", "confidence")).alias("b")
    return every.groupBy(*keys, "symbol", "access", "instruction").agg(best).select(*keys, "symbol", "access", "instruction", F.col("b.confidence").alias("confidence"), (F.col("b.seq") * 10_000 + F.col("b.pos") * 100 + F.col("b.nth")).alias("seq"))


ASSIGNMENT = rf"(?s)(?<![:<>=])\b({IDENTIFIER})\s*:=\s*(.*?);"


def assignments(text: Column) -> Column:
    """Structs target, expression, reads of the assignments in structured text."""
    clean = without_comments(text)
    pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(ASSIGNMENT), F.lit(1)).alias("target"), F.regexp_extract_all(clean, F.lit(ASSIGNMENT), F.lit(2)).alias("expression"))
    return F.transform(pairs, lambda p: F.struct(p["target"].alias("target"), F.trim(without_strings(p["expression"])).alias("expression"), tag_references(p["expression"], calls=False).alias("reads")))


def st_references(frame: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, symbol, access, instruction, confidence, seq: writes of targets and reads of right sides."""
    a = frame.select(*keys, F.posexplode(assignments(F.col(text))).alias("n", "a"))
    writes = a.select(*keys, F.col("a.target").alias("symbol"), F.lit("write").alias("access"), F.lit("ST_ASSIGN").alias("instruction"), (F.col("n") * 1000).alias("seq"))
    reads = a.select(*keys, "n", F.posexplode("a.reads").alias("i", "symbol")).select(*keys, "symbol", F.lit("read").alias("access"), F.lit("ST").alias("instruction"), (F.col("n") * 1000 + F.col("i") + 1).alias("seq"))
    every = writes.unionByName(reads).groupBy(*keys, "symbol", "access", "instruction").agg(F.min("seq").alias("seq"))
    return every.select(*keys, "symbol", "access", "instruction", F.lit("heuristic").alias("confidence"), "seq")


def ladder_callees(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct calls of rungs: subroutines by their first argument, other non-relay instructions by name."""
    jsr = (F.col("instruction") == "JSR") & (F.size("args") > 0)
    relay = F.col("instruction").isin("XIC", "XIO", "OTE", "OTL", "OTU")
    rows = frame.where(jsr | ~relay).select(*keys, F.when(jsr, "routine").otherwise("instruction").alias("call_type"), F.when(jsr, F.get("args", F.lit(0))).otherwise(F.col("instruction")).alias("callee"), "instruction")
    return rows.distinct()
