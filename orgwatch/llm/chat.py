"""Chat formatting: conversations rendered through a compiled template, and read back.

Texts may hold the template's own control strings. Inside a text every ``<`` and ``\\`` and every ``#`` that begins a
line marker is preceded by a backslash, so no control string survives in a text and dropping each escaping backslash
gives the text back. Role names are escaped in the same way.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role, then text; repeated
rows are turns of their own; a null conversation id is a conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import Template

#: Each turn: its role on a line that begins with ###, its text, an end marker. The text and end of the assistant's
#: turns is what a model learns to write; the loss mask is the text alone.
CHAT = (
    '{% for m in messages %}{{ "### " }}{{ m.role | escape }}{{ ": " }}'
    '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}'
    '{{ " </turn>" + "\n" }}{% endfor %}'
)
_CONTROL = re.compile(r"[\\<#:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Possessive, so that a long text leaves nothing to come back to; the space before the end mark comes with the text.
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; raises where it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m or m[2][-1:] != " ":
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return out


@lru_cache(maxsize=8)
def compiled(source: str) -> Template:
    return Template(source, {"escape": escape})


def format_conversations(rows: DataFrame, template: str = CHAT) -> DataFrame:
    """``conv_id, formatted, spans`` (start and end of the trained texts in ``formatted``) for each conversation of
    the table (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn), _in_order), lambda t: F.struct(t["role"], t["text"])).alias("messages"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = compiled(template).render
        for batch in batches:
            made = [run({"messages": list(m)}) for m in batch["messages"]]
            yield pd.DataFrame({"conv_id": batch["conv_id"].astype("Int64"), "formatted": [t for t, _ in made], "spans": [[{"start": a, "end": b} for a, b in s] for _, s in made]})

    return grouped.mapInPandas(render, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


def _in_order(a, b):
    """Null turns first, then by turn, role and text."""

    def by(x, y, rest):
        return F.when(x < y, -1).when(x > y, 1).otherwise(rest)

    last = by(a["role"], b["role"], by(a["text"], b["text"], F.lit(0)))
    same = F.when(a["turn"].isNull() & b["turn"].isNull(), last).when(a["turn"].isNull(), -1).when(b["turn"].isNull(), 1)
    return same.otherwise(by(a["turn"], b["turn"], last))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Digests read back from the output of ``format_conversations``: turns, and the text under the loss mask."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["formatted"], batch["spans"]):
                turns = read_back(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), _sha(said), len(loss), _sha(loss), len(text)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "conv_id", batch["conv_id"].astype("Int64"))
            yield out

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInPandas(read, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
