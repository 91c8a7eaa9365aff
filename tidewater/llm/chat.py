"""Chat formatting: compiled templates render conversations with a loss mask, and a reader takes them apart again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import importable, partitions, tidy
from tidewater.llm.templates import Mark, compiled, unescape

#: Turns stand between <turn role> and </turn>; the assistant's texts are under the loss mask.
TEMPLATE = (
    "{% for turn in turns %}<turn {{ turn.role | escape_line }}>\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
#: Characters after which a long conversation goes on in its next segment, and in a batch of segments.
SEGMENT, TOGETHER = 1 << 20, 1 << 22
_TURN = re.compile(r"<turn ([^<>\n]*)>\n([^<>]*)</turn>\n")
_SHAPE = "conv_id long, segment long, text string, loss array<struct<begin:long,end:long>>"
_LOSS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def format_conversations(df: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, segment, text, loss): each conversation as text, with the spans under the loss mask.

    A conversation's rows are rendered in the order of turn, then role and text where turns repeat;
    a null turn comes first, null roles and texts are empty, rows with null conv_id make one
    conversation. Repeated rows are turns of their own; other columns are ignored. Spans count code
    points within their segment. A conversation is one segment unless longer than SEGMENT; then
    segments 0, 1, .. follow each other, cut between a template's pieces.

    Rows are dealt by conversation and sorted outside of Python; a task renders one turn after the
    other, so a conversation of any length needs a segment's memory.
    """
    importable(df.sparkSession)
    render = compiled(template)  # fails here, on the driver, if the template is wrong

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], _LOSS)],
                names=["conv_id", "segment", "text", "loss"],
            )
            out.clear()
            return made

        for key, group in groupby(rows, key=lambda r: r[0]):
            pieces, spans, at, number, opened = [], [], 0, 0, None
            for piece in render((r[1], r[2]) for r in group):
                if piece is Mark.BEGIN:
                    opened = at
                elif piece is Mark.CLOSE:
                    spans.append({"begin": opened, "end": at})
                    opened = None
                else:
                    pieces.append(piece)
                    at += len(piece)
                    if at >= SEGMENT and opened is None:
                        out.append((key, number, "".join(pieces), spans))
                        size += at
                        pieces, spans, at, number = [], [], 0, number + 1
                        if size >= TOGETHER:
                            yield batch()
                            size = 0
            if pieces or not number:
                out.append((key, number, "".join(pieces), spans))
                size += at
            if size >= TOGETHER or len(out) >= 4096:
                yield batch()
                size = 0
        if out:
            yield batch()

    rows = df.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _SHAPE)


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the default template's output.

    formatted must come straight from format_conversations, segments in order. Everything is read
    from its text and loss columns: turns by the marks, escapes undone; the digest of turns runs over
    role, newline, text, newline; that of the loss over the masked text, unescaped, with nothing
    between.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        out: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        for key, group in groupby(rows, key=lambda r: r[0]):
            turns, loss, n, masked, chars, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for _, text, spans in group:
                chars += len(text)
                for s in spans:
                    plain = unescape(text[s["begin"] : s["end"]])
                    masked += len(plain)
                    loss.update(plain.encode())
                rest += text
                at = 0
                while m := _TURN.match(rest, at):
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                rest = rest[at:]
            if rest:
                raise ValueError(f"conversation {key} can't be read back at {rest[:60]!r}")
            out.append((key, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
            if len(out) >= 4096:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
