"""A total tokenizer for SystemVerilog text: token lengths always add up to the text.

Offsets and lengths are in bytes of UTF-8. An unknown character is one error token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the language: reserved words that aren't made by a rule below.
_WORDS = """
    accept_on alias always always_comb always_ff always_latch and assert assign assume automatic before begin bind bins binsof bit break buf byte case casex casez
    cell chandle checker class clocking cmos config const constraint context continue cover covergroup coverpoint cross deassign default defparam design disable
    dist do edge else end enum event eventually expect export extends extern final first_match for force foreach forever fork forkjoin function generate genvar
    global if iff ifnone ignore_bins illegal_bins implements implies import incdir include initial inout input inside instance int integer interconnect interface
    intersect join join_any join_none large let liblist library local localparam logic longint macromodule matches medium modport module nand negedge nettype new
    nexttime nmos nor noshowcancelled not null or output package packed parameter pmos posedge primitive priority program property protected pulldown pullup
    pulsestyle_ondetect pulsestyle_onevent pure rand randc randcase randsequence real realtime ref reg reject_on release repeat restrict return scalared sequence
    shortint shortreal showcancelled signed small soft solve specify specparam static string strong struct super table tagged task this throughout time
    timeprecision timeunit tran tri triand trior trireg type typedef union unique unsigned until until_with untyped use uwire var vectored virtual void wait
    wait_order wand weak while wildcard wire with within wor xnor xor
""".split()
#: Blocks that end in a word of their own, words with a strength or level of 0 or 1, resistive gates, and strong and synchronous properties.
_ENDED = "case checker class clocking config function generate group interface module package primitive program property specify sequence table task".split()
_LEVELLED = "bufif notif highz pull strong supply tri tranif rtranif weak".split()
KEYWORDS = frozenset(
    [*_WORDS, *("end" + w for w in _ENDED), *(w + k for w in _LEVELLED for k in "01"), "unique0", *("r" + w for w in ("cmos", "nmos", "pmos", "tran"))]
    + ["s_" + w for w in ("always", "eventually", "nexttime", "until", "until_with")]
    + ["sync_" + w for w in ("accept_on", "reject_on")]
)
NET_KINDS = ("wire", "tri", "tri0", "tri1", "wand", "wor", "triand", "trior", "trireg", "uwire", "supply0", "supply1", "interconnect")
TRIVIA = ("space", "line_comment", "block_comment")

_OPERATORS = """
<<<= >>>= <<< >>> <<= >>= === !== ==? !=? <-> &&& ->> |-> |=> -> <- => << >> <= >= == != && || ** ++ -- += -= *= /= %= &= |= ^= ~& ~| ~^ ^~ :: :/ := +: -: .* ## @* '{
""".split()
_TOKEN = re.compile(
    "|".join(
        [
            r"(?P<space>[ \t\n\f\r]+)",
            r"(?P<line_comment>//[^\n]*)",
            r"(?P<block_comment>/\*(?:.*?\*/|.*\Z))",
            r'(?P<string>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))',
            r"(?P<paste>``)",
            r'(?P<quote>`\\?`?")',
            r"(?P<directive>`[A-Za-z_][A-Za-z0-9_$]*)",
            r"(?P<escaped>\\[^ \t\n\f\r]+)",
            r"(?P<system>\$[A-Za-z0-9_$]+)",
            r"(?P<time>[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:s|ms|us|ns|ps|fs)(?![A-Za-z0-9_$]))",
            r"(?P<real>[0-9][0-9_]*(?:\.[0-9][0-9_]*(?:[eE][+-]?[0-9][0-9_]*)?|[eE][+-]?[0-9][0-9_]*))",
            r"(?P<based>(?:[0-9][0-9_]*[ \t]*)?'[sS]?[bBoOdDhH][ \t]*[0-9a-fA-FxXzZ?][0-9a-fA-FxXzZ?_]*)",
            r"(?P<unbased>'[01xXzZ](?![A-Za-z0-9_]))",
            r"(?P<number>[0-9][0-9_]*)",
            r"(?P<ident>[A-Za-z_][A-Za-z0-9_$]*)",
            "(?P<op>" + "|".join(map(re.escape, sorted(_OPERATORS, key=len, reverse=True))) + r"|[-+*/%&|^~!<>=?:;,.()\[\]{}#@$'])",
            r"(?P<error>.)",
        ]
    ),
    re.DOTALL,
)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    len: int


def lex(text: str) -> list[Token]:
    """All tokens, trivia included."""
    out, at, plain = [], 0, text.isascii()
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        n = len(s) if plain else len(s.encode())
        if kind == "ident" and s in KEYWORDS:
            kind = "keyword"
        out.append(Token(kind, s, at, n))
        at += n
    return out


TOKENS = "file_id int, seq int, kind string, start int, len int, text string"


def tokens(sources: DataFrame) -> DataFrame:
    """The tokens of sources (file_id, text), file by file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = lex(text or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([t.kind for t in found], pa.string()), pa.array([t.start for t in found], pa.int32()), pa.array([t.len for t in found], pa.int32()), pa.array([t.text for t in found], pa.string())],
                    names=["file_id", "seq", "kind", "start", "len", "text"],
                )

    return sources.select("file_id", "text").mapInArrow(work, TOKENS)
