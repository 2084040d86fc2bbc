"""Chat formatting by event-sourced reconstruction.

A log has events (conv_id, seq, msg_id, kind, role, payload). ``fold`` takes the events of each message in the order
of seq and folds them: ``delta`` appends its payload, ``edit`` replaces the text by its payload, ``regenerate`` starts
the text anew, ``delete`` removes the message. Messages stand in the order of their first event. ``render`` writes one
segment a message; the segments of a conversation, in order, are its formatted text.

``read_back`` sees only that text: it joins the segments of a conversation, finds the turns by the template, and takes
the loss mask from their roles.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``, the role URL-encoded. Control strings of this and of other known
templates inside texts get a backslash after their first character, and backslashes are doubled, so that no text can
pose as a turn and every text can be read back. The loss mask covers the escaped text of assistant turns alone.

Null text or payload counts as empty, null role as an empty role, null conv_id is a conversation of its own. Equal
turn numbers go by role, then by the MD5 of the text; repeated rows are separate turns. Other columns are ignored. An empty table gives
an empty result. A conversation of any length streams through a task; it is never gathered. A message is folded in one
row, so its events must fit in memory, as its text must; very long texts and turns are whole.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import RID, column, give_back, materialize, pick, small_batches

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LOSS_ROLE = "assistant"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"\\(\\?)")


def escape(col):
    """Reversible: no control string is left in the text."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def events_of_turns(turns: DataFrame, revised: bool = False) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of their messages.

    Each text arrives in up to three deltas. With ``revised`` some messages (by their MD5) are first written otherwise and
    then regenerated or edited, so that the log holds every kind of event that ends in the same messages.
    """
    base = pick(turns, "conv_id", "turn", "role", "text").withColumn(RID, F.monotonically_increasing_id())  # read once
    text = F.coalesce("text", F.lit(""))
    base = base.select("conv_id", "turn", "role", text.alias("text"), F.struct(F.coalesce("role", F.lit("")).alias("r"), F.md5(text).alias("t"), F.col(RID).alias("i")).alias("msg_id"))
    part = F.ceil(F.length("text") / 3).cast("int")
    event = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))
    deltas = [event("delta", F.col("text").substr(F.lit(1) + i * part, part)) for i in range(3)]
    plain = F.array(*deltas)
    draft = event("delta", F.lit("a draft that does not stay "))
    regenerated = F.array(draft, event("regenerate", F.lit("")), *deltas)
    edited = F.array(draft, deltas[0], event("edit", F.col("text")))
    way = F.when(F.lit(revised), F.conv(F.substring("msg_id.t", 1, 1), 16, 10).cast("int") % 4).otherwise(0)
    log = F.when(way == 1, regenerated).when(way == 2, edited).otherwise(F.filter(plain, lambda e: e["payload"] != ""))
    log = F.when(F.size(log) == 0, F.array(event("delta", F.lit("")))).otherwise(log)
    rows = base.select("conv_id", "turn", "msg_id", "role", F.posexplode(log).alias("step", "e"))
    return rows.select("conv_id", F.struct("turn", "step").alias("seq"), "msg_id", "e.kind", "role", "e.payload")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, seq (of the first event), msg_id, role, text: the final messages."""
    event = F.struct("seq", F.when(F.col("kind") == "regenerate", 0).when(F.col("kind") == "edit", 1).otherwise(2).alias("rank"), "kind", F.coalesce("payload", F.lit("")).alias("payload"))
    groups = log.groupBy("conv_id", "msg_id").agg(F.array_sort(F.collect_list(event)).alias("events"), F.min_by("role", F.struct(F.col("role").isNull(), "seq")).alias("role"))
    # The text is what follows the last event that sets it anew.
    anew = F.transform("events", lambda e, i: F.when(e["kind"].isin("edit", "regenerate", "delete"), i).otherwise(F.lit(0)))
    tail = F.slice("events", F.array_max(anew) + 1, F.size("events"))
    live = groups.where(F.element_at("events", -1)["kind"] != "delete")
    return live.select("conv_id", F.col("events")[0]["seq"].alias("seq"), "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(tail, lambda e: e["payload"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One segment a message, keyed by its place: conv_id, seq, msg_id, segment."""
    turn = F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"), escape(F.col("text")), F.lit(END))
    return messages.select("conv_id", "seq", "msg_id", turn.alias("segment"))


def turns_of(text: str) -> tuple[list[tuple[str, str, bool]], int]:
    """The turns that a formatted text begins with: role, text, whether it bears loss; and where they end."""
    out, at = [], 0
    while turn := TURN.match(text, at):
        role = unquote_plus(turn.group(1))
        out.append((role, unescape(turn.group(2)), role == LOSS_ROLE))
        at = turn.end()
    return out, at


def _read_back(batches):
    """Digests of the text that a conversation's segments make up; state is its hashes and what is no whole turn yet."""
    state, out = None, []

    def done(s):
        if s["rest"]:
            raise ValueError(f"conversation {s['conv']}: text that is no turn: {s['rest'][:80]!r}")
        return (s["conv"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"])

    for b in batches:
        for conv, segment in zip(*(column(b, c).to_pylist() for c in ("conv_id", "segment"))):
            if state is None or state["conv"] != conv:
                if state is not None:
                    out.append(done(state))
                state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "rest": ""}
            text = state["rest"] + segment
            turns, end = turns_of(text)
            state["rest"] = text[end:]
            state["formatted"] += len(segment)
            for role, body, bears in turns:
                state["turns"] += 1
                state["all"].update(f"{role}\n{body}\n".encode())
                if bears:
                    state["chars"] += len(body)
                    state["loss"].update(body.encode())
        if out:
            yield _rows(out)
            out = []
    if state is not None:
        yield _rows([done(state)])
    give_back()


def _rows(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, parsed from the formatted text."""
    small_batches(segments.sparkSession)
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "msg_id")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_log(log: DataFrame) -> DataFrame:
    """The formatted segments of a log, written to the shared folder."""
    return materialize(render(fold(log)), "chat-segments")
