"""Chat formatting: a template is a black box that renders turns to one string.

Where a turn lies in the output is found by rendering: the output for k turns
less the output for k - 1 turns is turn k's span, if the shorter output is the
beginning of the longer one. A second rendering, with a probe in place of the
turn's text, shows what the template puts before and after the text; the rest
is the text as the template escaped it. A template whose output for k turns
does not begin with that for k - 1 turns rewrites history; that is reported
for the conversation, and its spans are then found in the whole output by
replacing one text at a time with the probe.

A long conversation is rendered in stretches of ``STRETCH`` turns: the prefixes of a
stretch begin with the two turns before it, and what they add must be what the
prefix of the whole conversation up to the stretch's end adds; else the
stretch is rendered again with all turns before it. So a template that appends
costs about ``STRETCH`` turns for each turn, and one rendering of the whole prefix for each stretch.
Conversations are streamed, and one at a time is held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwood.llm.common import n_partitions, quoted, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Two code points for private use; a text that holds them is probed with a longer run.
PROBE = "\ue000\ue001"

#: Turns whose prefixes are rendered without those before, and the turns before that they begin with.
STRETCH, CONTEXT = 64, 2

_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string can stand in the result: each holds "<" or "[" without a backslash before it."""
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def inst_template(turns: list[Turn]) -> str:
    """<s>, then for each turn [INST] text [/INST], text </s> for an assistant, or [ROLE name] text [/ROLE]."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f"<a> {escape(text)} </s>")
        else:
            out.append(f"[ROLE {escape(role).replace(']', chr(92) + ']')}] {escape(text)} [/ROLE]")
    return "".join(out)


_BODY = r"((?:[^\\<\[]|\\.)*)"
_TURN = re.compile(rf"\[INST\] {_BODY} \[/INST\]|<a> {_BODY} </s>|\[ROLE ((?:[^\\\]]|\\.)*)\] {_BODY} \[/ROLE\]", re.S)


def parse_inst(formatted: str) -> list[Turn]:
    """The turns, read back from the output alone."""
    if not formatted.startswith("<s>"):
        raise ValueError("no output of this template")
    turns, at = [], 3
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m[1] is not None:
            turns.append(("user", unescape(m[1])))
        elif m[2] is not None:
            turns.append(("assistant", unescape(m[2])))
        else:
            turns.append((unescape(m[3]), unescape(m[4])))
        at = m.end()
    return turns


def _probe_for(text: str) -> str:
    probe = PROBE
    while probe in text:
        probe += PROBE
    return probe


def _added(context: list[Turn], turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]] | None:
    """What the turns add to the output for the context, with the spans of the turns and of their texts in it; None if an output doesn't begin with the one before."""
    first = before = template(context)
    spans, bodies = [], []
    shown = list(context)
    for role, text in turns:
        probe = _probe_for(text)
        probed, after = template([*shown, (role, probe)]), template([*shown, (role, text)])
        at = probed.find(probe, len(before))
        if at < 0 or not probed.startswith(before) or not after.startswith(before):
            return None
        tail = len(probed) - at - len(probe)
        spans.append((len(before), len(after)))
        bodies.append((at, len(after) - tail))
        shown.append((role, text))
        before = after
    moved = lambda pairs: [(a - len(first), b - len(first)) for a, b in pairs]
    return before[len(first) :], moved(spans), moved(bodies)


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(output, span of each turn, span of each turn's text, whether the template rewrites history).

    In a rewriting template, a turn's span is that of its text.
    """
    whole, spans, bodies = template([]), [], []
    for at in range(0, len(turns), STRETCH):
        stretch = turns[at : at + STRETCH]
        after = template(turns[: at + len(stretch)])
        found = _added(turns[max(0, at - CONTEXT) : at], stretch, template)
        if found is None or whole + found[0] != after:
            found = _added(turns[:at], stretch, template) if at > CONTEXT else None
        if found is None or whole + found[0] != after:
            break
        spans += [(a + len(whole), b + len(whole)) for a, b in found[1]]
        bodies += [(a + len(whole), b + len(whole)) for a, b in found[2]]
        whole = after
    else:
        return whole, spans, bodies, False
    whole = template(turns)
    bodies = []
    for k, (role, text) in enumerate(turns):
        probe = _probe_for(text)
        probed = template([*turns[:k], (role, probe), *turns[k + 1 :]])
        at = probed.find(probe)
        # A text that the template leaves out has an empty span.
        bodies.append((at, len(whole) - (len(probed) - at - len(probe))) if at >= 0 else (len(whole), len(whole)))
    return whole, bodies, bodies, True


def format_turns(turns: list[Turn], template: Template = inst_template, learn: frozenset[str] = frozenset({"assistant"})) -> dict:
    """formatted, loss (spans of the texts of the roles in learn), turn spans, rewrites_history."""
    out, spans, bodies, rewrites = locate(turns, template)
    loss = [b for (role, _), b in zip(turns, bodies, strict=True) if role in learn]
    return {"formatted": out, "loss": loss, "spans": spans, "rewrites_history": rewrites}


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(df: DataFrame, template: Template = inst_template, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: Iterable[str] = ("assistant",)) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, formatted, loss and spans (code points, end exclusive), rewrites_history.

    Rows are taken by turn, those with equal turns by role, then text;
    repeated rows are turns of their own. A null turn comes first, null roles
    and texts are empty strings, rows without conv_id form one conversation.
    Very long texts are formatted whole. An empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    learned = frozenset(learn)
    kind = dict(df.dtypes)[conv_col]
    rows = df.select(F.col(quoted(conv_col)).alias("_conv"), F.col(quoted(turn_col)).alias("_turn"), F.coalesce(F.col(quoted(role_col)), F.lit("")).alias("_role"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("_text"))
    rows = rows.repartition(n_partitions(df.sparkSession), "_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")

    def made(done: list[tuple[object, list[Turn]]], ids: pa.DataType) -> pa.RecordBatch:
        out = [format_turns(turns, template, learned) for _, turns in done]
        columns = [
            pa.array([c for c, _ in done], ids),
            pa.array([len(turns) for _, turns in done], pa.int64()),
            pa.array([x["formatted"] for x in out], pa.string()),
            *(pa.array([[{"start": a, "end": b} for a, b in x[k]] for x in out], _SPAN) for k in ("loss", "spans")),
            pa.array([x["rewrites_history"] for x in out], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[conv_col, "n_turns", "formatted", "loss", "spans", "rewrites_history"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[object, list[Turn]]] = []
        ids = None
        for batch in batches:
            ids = batch.schema.field(0).type
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if not done or done[-1][0] != conv:
                    if len(done) >= 256:
                        yield made(done, ids)
                        done = []
                    done.append((conv, []))
                done[-1][1].append((role, text))
        if done:
            yield made(done, ids)

    span = "array<struct<start:bigint,end:bigint>>"
    return rows.mapInArrow(run, f"{quoted(conv_col)} {kind}, n_turns bigint, formatted string, loss {span}, spans {span}, rewrites_history boolean")


def digest_row(formatted: str, loss: list[tuple[int, int]]) -> tuple[int, str, int, str, int]:
    """(n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the output and the mask alone."""
    turns = parse_inst(formatted)
    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    masked = "".join(unescape(formatted[a:b]) for a, b in loss)
    return len(turns), sha, len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], rows.schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [digest_row(f, [(x["start"], x["end"]) for x in m]) for f, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([x[k] for x in out], kinds[k]) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"])

    formatted = format_conversations(rows.unionByName(extra)).select("conv_id", "formatted", "loss", "rewrites_history")
    return formatted.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean")
