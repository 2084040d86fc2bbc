"""Expressions of diagrams from the expressions of their inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block opcodes with an operator form.
INFIX = {"BAND": "AND", "AND": "AND", "BOR": "OR", "OR": "OR"}
BINARY = {"ADD": "+", "SUB": "-", "MUL": "*", "DIV": "/", "EQU": "==", "EQ": "==", "NEQ": "!=", "NE": "!=", "GRT": ">", "GT": ">", "GEQ": ">=", "GE": ">=", "LES": "<", "LT": "<", "LEQ": "<=", "LE": "<="}
UNRESOLVED = "UNRESOLVED"


def bracketed(value: Column) -> Column:
    return F.when(F.contains(value, F.lit(" AND ")) | F.contains(value, F.lit(" OR ")), F.concat(F.lit("("), value, F.lit(")"))).otherwise(value)


def merged(values: Column) -> Column:
    """Null for no value, a value alone, or MERGE(a, b, ...)."""
    full = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(full) == 1, full[0]).when(F.size(full) > 1, F.concat(F.lit("MERGE("), F.array_join(full, ", "), F.lit(")")))


def infix(values: Column, op: str) -> Column:
    joined = F.array_join(F.transform(values, bracketed), f" {op} ")
    return F.when(F.size(values) == 0, UNRESOLVED).when(F.size(values) == 1, values[0]).otherwise(joined)


def binary(values: Column, op: str) -> Column:
    return F.when(F.size(values) < 2, UNRESOLVED).otherwise(F.concat(bracketed(F.get(values, F.lit(0))), F.lit(f" {op} "), bracketed(F.get(values, F.lit(1)))))


def block(instruction: Column, inputs: Column, output: Column) -> Column:
    """Expression of a block from its inputs (array of structs param, expr) and the name of an output."""
    op = F.upper(instruction)
    values = F.transform(inputs, lambda x: x["expr"])
    call = F.concat(instruction, F.lit("("), F.array_join(F.transform(inputs, lambda x: F.concat(x["param"], F.lit("="), x["expr"])), ", "), F.lit(")"), F.when(output == "Out", "").otherwise(F.concat(F.lit("."), output)))
    out = F.when(op.isin("BNOT", "NOT"), F.when(F.size(values) > 0, F.concat(F.lit("NOT("), F.get(values, F.lit(0)), F.lit(")"))).otherwise(UNRESOLVED))
    for code, sign in INFIX.items():
        out = out.when(op == code, infix(values, sign))
    for code, sign in BINARY.items():
        out = out.when(op == code, binary(values, sign))
    return out.otherwise(call)
