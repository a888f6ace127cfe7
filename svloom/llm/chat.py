"""Chat formatting with a grammar round trip.

A turn is written as

    ### role:
    body
    </turn>

and a deterministic parser reads it back. Each turn is first rendered as it is; if the
parser doesn't recover the very role and body, the control strings in the body get one more
backslash, until it does. The parser takes one backslash off each control string that has
one, so every text comes back. Roles are percent-encoded beyond letters, digits, _ and -.

Null texts and roles count as empty ones; rows of one conversation are ordered by turn, then
role and text, so ties and repeated rows have one result; a null conversation is a group of
its own. Conversations are streamed in order through their task, a turn at a time: memory
doesn't grow with the length of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import P

OPEN, MID, END = "### ", ":\n", "\n</turn>\n"
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"\\(\\*)(###|</turn>)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def parse(out: str, at: int = 0) -> tuple[str, int, int, int]:
    """Of the turn at an offset: role, begin and end of its body, and where the next begins."""
    if not out.startswith(OPEN, at):
        raise ValueError(f"no turn at {at}")
    mid = out.find(MID, at)
    end = out.find(END, mid + len(MID) - 1)  # an empty body shares no newline: see render
    if mid < 0 or end < 0:
        raise ValueError(f"unended turn at {at}")
    return unquote(out[at + len(OPEN) : mid]), mid + len(MID), end, end + len(END)


def _recovers(out: str, role: str, text: str) -> bool:
    try:
        got, begin, end, after = parse(out)
    except ValueError:
        return False
    return begin <= end and after == len(out) and got == role and unescape(out[begin:end]) == text


def render(role: str, text: str) -> str:
    """The turn's output, checked by the parser."""
    head, body = OPEN + quote(role, safe="_-", errors="surrogatepass") + MID, text
    while not _recovers(out := head + body + END, role, text):
        if body != text:
            raise ValueError("escaping did not make the turn readable")
        body = escape(text)
    return out


def turns(out: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    found, at = [], 0
    while at < len(out):
        role, begin, end, at = parse(out, at)
        found.append((role, unescape(out[begin:end])))
    return found


def loss_spans(out: str, role: str = "assistant") -> list[tuple[int, int]]:
    """The loss mask: spans of the output in code points, one for each turn of the role."""
    spans, at = [], 0
    while at < len(out):
        got, begin, end, at = parse(out, at)
        if got == role:
            spans.append((begin, end))
    return spans


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, turn, role, text and formatted, the turn's piece of the output.

    The output of a conversation is its pieces in the order of (turn, role, text).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "formatted"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, "conv_id long, turn long, role string, text string, formatted string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation come together and in order; each piece is parsed again."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now: list | None = None
    done: list[tuple] = []

    def close() -> None:
        if now is not None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    for b in batches:
        for conv, out in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True):
            if now is None or now[0] != conv:
                close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in turns(out):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            for begin, end in loss_spans(out):
                text = unescape(out[begin:end])
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(out)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives, a row for each conversation."""
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.select("conv_id", "turn", "role", "text", "formatted").repartition(n, F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
