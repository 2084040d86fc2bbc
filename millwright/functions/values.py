"""Dynamic sample values, held as JSON text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a default answer shows of a value.
MOST_CHARACTERS, MOST_ITEMS = 300, 20
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+')


def canonical_text(text: str | None) -> str | None:
    """One spelling for equal values: keys sorted, no blanks; 1, 1.0 and true stay apart."""
    return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _shortened(token: str) -> str:
    if not token.startswith('"') or len(token) <= MOST_CHARACTERS + 2:
        return token
    body = json.loads(token)
    return token if len(body) <= MOST_CHARACTERS else json.dumps(body[:MOST_CHARACTERS] + "...", ensure_ascii=False)


def compact_text(text: str | None) -> str | None:
    """JSON text in which long strings end after MOST_CHARACTERS, and long lists and objects after MOST_ITEMS with the
    number of what is left out. One walk over the tokens: a counter for each open bracket, and what lies past the
    limit of the outermost full one is counted and not copied.
    """
    if text is None:
        return None
    out: list[str] = []
    places: list[list] = []  # of each open bracket: its kind, commas so far
    full = 0  # how many brackets were open when the limit was passed, 0 while all is copied
    tokens = _TOKEN.findall(text)
    for i, token in enumerate(tokens):
        if token in "]}":
            kind, commas = places.pop()
            if full == len(places) + 1:
                note = f'"truncated_items": {commas + 1 - MOST_ITEMS}'
                out.append(", " + (note if kind == "{" else f"{{{note}}}"))
                full = 0
        elif token == ",":
            places[-1][1] += 1
            if not full and places[-1][1] == MOST_ITEMS:
                full = len(places)
        if not full:
            is_key = i + 1 < len(tokens) and tokens[i + 1] == ":"
            out.append({",": ", ", ":": ": "}.get(token) or (token if is_key else _shortened(token)))
        if token in "[{":
            places.append([token, 0])
    return "".join(out)


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    return text.map(canonical_text, na_action="ignore")


@F.pandas_udf(StringType())
def compact(text: pd.Series) -> pd.Series:
    return text.map(compact_text, na_action="ignore")


def kind(value_json: Column) -> Column:
    """bool, number, string, or null for everything else: what can have a least and a greatest value."""
    return F.when(value_json.isin("true", "false"), "bool").when(value_json.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(F.startswith(value_json, F.lit('"')), "string")
