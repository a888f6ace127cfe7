"""Syntax trees: what the reader recognised, as rows of nodes and as an indented listing.

Nodes are numbered from 0 in reading order, the file being 0; a node's place among those of its kind is its
identity, which edits of white space and comments leave alone. Spans are bytes of the text that was read, from a
node's first token to the end of its last; tokens are leaves of the innermost node around them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from svloom.functions.lexer import TRIVIA, lex
from svloom.functions.parser import Parser

#: Methods of the reader that recognise a node, and the node's kind.
KINDS = {
    "unit": "unit", "item": "item", "param_ports": "parameters", "port_list": "ports", "type_": "type", "connections": "connections", "generate_block": "block",
    "subprogram": "subprogram", "statement": "statement", "block": "block", "expr": "expression",
}
NODES = "file_id int, node_id int, parent_id int, kind string, ordinal int, start int, end int"


class TreeParser(Parser):
    """The reader, noting where each node begins and ends."""

    def __init__(self, text: str):
        super().__init__(text)
        self.nodes: list[list] = []  # kind, parent, first token, token behind the last
        self.inside: list[int] = []

    def node(self, kind: str, read: Callable, *args, **named):
        self.nodes.append([kind, self.inside[-1] if self.inside else None, self.i, self.i])
        own, declared = len(self.nodes) - 1, len(self.nodes)
        self.inside.append(own)
        try:
            return read(self, *args, **named)
        finally:
            self.inside.pop()
            self.nodes[own][3] = min(self.i, len(self.t))
            if self.i == self.nodes[own][2] and len(self.nodes) == declared and own:
                self.nodes.pop()  # nothing was read


def _noting(kind: str, read: Callable) -> Callable:
    return lambda self, *args, **named: self.node(kind, read, *args, **named)


for _name, _kind in KINDS.items():
    setattr(TreeParser, _name, _noting(_kind, getattr(Parser, _name)))


def tree(text: str) -> list[tuple]:
    """node_id, parent_id, kind, ordinal within the kind, start and end of each node."""
    p = TreeParser(text)
    p.node("file", Parser.file)
    size, seen, out = len(text.encode()), {}, []
    for i, (kind, parent, a, b) in enumerate(p.nodes):
        seen[kind] = seen.get(kind, -1) + 1
        start = p.t[a].start if a < len(p.t) else size
        end = p.t[b - 1].start + p.t[b - 1].len if b > a else start
        out.append((i, parent, kind, seen[kind], *((0, size) if not i else (start, end))))
    return out


def listing(text: str) -> str:
    """A line a node and token: kind@start..end, with the token's text, two spaces a level."""
    nodes, tokens = tree(text), [t for t in lex(text) if t.kind not in TRIVIA]
    below: dict[int | None, list[tuple]] = {}
    for n in nodes:
        below.setdefault(n[1], []).append(n)
    lines: list[str] = []

    def show(n: tuple, depth: int, at: int) -> int:
        lines.append(f"{'  ' * depth}{n[2]}@{n[4]}..{n[5]}")
        for child in [*below.get(n[0], []), None]:
            limit = n[5] if child is None else child[4]
            while at < len(tokens) and tokens[at].start < limit:
                t = tokens[at]
                lines.append(f'{"  " * (depth + 1)}{t.kind}@{t.start}..{t.start + t.len} "{t.text}"')
                at += 1
            if child is not None:
                at = show(child, depth + 1, at)
        return at

    show(nodes[0], 0, 0)
    return "\n".join(lines)


def nodes(texts: DataFrame) -> DataFrame:
    """The nodes of each text (file_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(file, *n) for n in tree(text or "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])

    return texts.select("file_id", "text").mapInArrow(work, NODES)
