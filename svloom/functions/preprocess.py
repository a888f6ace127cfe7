"""Compiler directives: conditionals, macros, includes and policy events of one file.

The expanded text comes as pieces, each with the place in a source file that it is from. Includes
splice the included file's text as it is, without handling directives in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from svloom.functions.lexer import NET_KINDS, TRIVIA, Token, lex

#: Nested expansions of one macro use.
MOST_DEPTH = 64
#: Directives that only leave an event (fixed values of the language).
PLAIN = ("celldefine", "endcelldefine", "unconnected_drive", "nounconnected_drive", "pragma", "line", "begin_keywords", "end_keywords")
CONDITIONAL = ("ifdef", "ifndef", "elsif", "else", "endif")


@dataclass
class Macro:
    params: list[tuple[str, str | None]] | None
    body: list[Token]


@dataclass
class Result:
    """pieces: (text, origin file, origin start, origin length, kind); events: (offset, kind, argument, start)."""

    pieces: list[tuple[str, int, int, int, str]] = field(default_factory=list)
    events: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    errors: list[tuple[int, int, str]] = field(default_factory=list)
    macros: dict[str, Macro] = field(default_factory=dict)
    size: int = 0

    @property
    def text(self) -> str:
        return "".join(p[0] for p in self.pieces)


class _Stack:
    """Open conditionals: whether the outside emits, whether a branch was taken, whether this one emits, whether else was seen."""

    def __init__(self) -> None:
        self.open: list[list[bool]] = []

    @property
    def emits(self) -> bool:
        return not self.open or self.open[-1][2]

    def push(self, holds: bool) -> None:
        outside = self.emits
        self.open.append([outside, holds, outside and holds, False])

    def branch(self, holds: bool, last: bool) -> str | None:
        if not self.open:
            return "without `ifdef"
        top = self.open[-1]
        if top[3]:
            return "after `else"
        top[2] = top[0] and not top[1] and holds
        top[1] |= holds
        top[3] = last
        return None


class Preprocessor:
    def __init__(self, file: int, path: str, text: str, includes: dict[tuple[str, str], tuple[int, str]] | None = None, macros: dict[str, Macro] | None = None):
        self.file, self.path, self.tokens, self.includes = file, path, lex(text), includes or {}
        self.out = Result(macros=dict(macros or {}))
        self.stack = _Stack()
        self.line_starts = [0, *(m.end() for m in re.finditer(b"\n", text.encode()))]

    # Emission

    def emit(self, text: str, start: int, length: int, kind: str = "source", file: int | None = None) -> None:
        if text:
            self.out.pieces.append((text, self.file if file is None else file, start, length, kind))
            self.out.size += len(text.encode())

    def event(self, kind: str, arg: str | None, start: int) -> None:
        self.out.events.append((self.out.size, kind, arg, start))

    def error(self, t: Token, message: str) -> None:
        self.out.errors.append((t.start, t.len, message))

    # Scanning

    def line(self, i: int) -> tuple[list[Token], int]:
        """The tokens after place i up to the end of the line (escaped line ends go on), and the place of its end."""
        found = []
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "space" and "\n" in t.text:
                if found and found[-1].text.startswith("\\") and found[-1].kind in ("error", "escaped"):
                    found.pop()
                else:
                    break
            if t.kind == "line_comment" and t.text.endswith("\\"):
                pass
            elif t.kind != "line_comment":
                found.append(t)
            i += 1
        return found, i

    def run(self) -> Result:
        i = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.kind == "directive":
                i = self.directive(i, t, t.text[1:])
            else:
                if self.stack.emits:
                    self.emit(t.text, t.start, t.len)
                i += 1
        if self.stack.open:
            self.out.errors.append((self.tokens[-1].start if self.tokens else 0, 0, "unterminated conditional"))
        return self.out

    def word(self, line: list[Token]) -> Token | None:
        return next((x for x in line if x.kind not in TRIVIA), None)

    def directive(self, i: int, t: Token, name: str) -> int:
        if name in CONDITIONAL:
            return self.conditional(i, t, name)
        if not self.stack.emits:
            return i + 1
        if name == "define":
            return self.define(i, t)
        line, end = self.line(i + 1)
        word = self.word(line)
        after = lambda: self.tokens.index(word, i) + 1 if word else i + 1
        if name == "undef":
            if word is None:
                self.error(t, "`undef needs a name")
                return end
            self.out.macros.pop(word.text, None)
            return after()
        if name == "undefineall":
            self.out.macros.clear()
            return i + 1
        if name == "resetall":
            self.event("resetall", None, t.start)
            return i + 1
        if name == "default_nettype":
            if word is None or word.text not in (*NET_KINDS, "none"):
                self.error(t, "`default_nettype needs a net kind or none")
                return end
            self.event("default_nettype", word.text, t.start)
            return after()
        if name == "timescale":
            text = "".join(x.text for x in line if x.kind not in TRIVIA)
            if re.fullmatch(r"[0-9]+(s|ms|us|ns|ps|fs)/[0-9]+(s|ms|us|ns|ps|fs)", text):
                self.event("timescale", text, t.start)
            else:
                self.error(t, "`timescale needs unit/precision")
            return end
        if name == "include":
            return self.include(t, line, end)
        if name in ("__FILE__", "__LINE__"):
            import bisect

            self.emit(f'"{self.path}"' if name == "__FILE__" else str(bisect.bisect(self.line_starts, t.start)), t.start, t.len, "macro")
            return i + 1
        if name in PLAIN:
            self.event(name, None, t.start)
            return end
        return self.use(i, t, name)

    def conditional(self, i: int, t: Token, name: str) -> int:
        line, _ = self.line(i + 1)
        word = self.word(line) if name in ("ifdef", "ifndef", "elsif") else None
        if name in ("ifdef", "ifndef", "elsif") and word is None:
            self.error(t, f"`{name} needs a name")
        holds = word is not None and word.text in self.out.macros
        problem = None
        if name in ("ifdef", "ifndef"):
            self.stack.push(holds if name == "ifdef" else not holds)
        elif name == "endif":
            problem = None if self.stack.open else "without `ifdef"
            if self.stack.open:
                self.stack.open.pop()
        else:
            problem = self.stack.branch(holds or name == "else", name == "else")
        if problem:
            self.error(t, f"`{name} {problem}")
        return self.tokens.index(word, i) + 1 if word else i + 1

    def include(self, t: Token, line: list[Token], end: int) -> int:
        text = "".join(x.text for x in line).strip()
        m = re.match(r'"([^"]*)"|<([^>]*)>', text)
        if not m:
            self.error(t, "`include needs a file name")
            return end
        key = ("quoted", m[1]) if m[1] is not None else ("angle", m[2])
        if key not in self.includes:
            self.error(t, f"cannot find {key[1]}")
            return end
        file, body = self.includes[key]
        self.emit(body, 0, len(body.encode()), "include", file)
        return end

    # Macros

    def define(self, i: int, t: Token) -> int:
        line, end = self.line(i + 1)
        at = next((k for k, x in enumerate(line) if x.kind not in TRIVIA), None)
        if at is None:
            self.error(t, "`define needs a name")
            return end
        name, rest = line[at], line[at + 1 :]
        params = None
        if rest and rest[0].text == "(":
            depth, k = 0, 0
            for k, x in enumerate(rest):  # noqa: B007
                depth += (x.text == "(") - (x.text == ")")
                if not depth:
                    break
            params = []
            for one in _split(rest[1:k]):
                words = [x for x in one if x.kind not in TRIVIA]
                if words:
                    default = "".join(x.text for x in one[one.index(words[0]) + 1 :]).strip()
                    params.append((words[0].text, default[1:].strip() if default.startswith("=") else None))
            rest = rest[k + 1 :]
        while rest and rest[0].kind == "space":
            rest = rest[1:]
        while rest and rest[-1].kind in TRIVIA:
            rest = rest[:-1]
        self.out.macros[name.text] = Macro(params, rest)
        return end

    def use(self, i: int, t: Token, name: str) -> int:
        macro, end, args = self.out.macros.get(name), i + 1, None
        if macro is None:
            self.event("undefined", name, t.start)
            self.error(t, f"undefined macro `{name}")
            return end
        if macro.params is not None:
            if end >= len(self.tokens) or self.tokens[end].text != "(":
                self.error(t, f"macro `{name} needs arguments")
                return end
            args, end = _arguments(self.tokens, end)
            if args is None:
                self.error(t, f"unterminated arguments of `{name}")
                return end
        try:
            text = self.expand(macro, args, 1)
        except ValueError as e:
            self.error(t, str(e))
            return end
        last = self.tokens[end - 1]
        self.emit(text, t.start, last.start + last.len - t.start, "macro")
        return end

    def expand(self, macro: Macro, args: list[list[Token]] | None, depth: int) -> str:
        if depth > MOST_DEPTH:
            raise ValueError("macro expansion is nested too deeply")
        given: dict[str, str] = {}
        if macro.params is not None:
            texts = ["".join(x.text for x in a).strip() for a in args or []]
            if len(texts) > len(macro.params) and texts != [""]:
                raise ValueError("too many macro arguments")
            for k, (name, default) in enumerate(macro.params):
                text = texts[k] if k < len(texts) else ""
                if k >= len(texts) and default is None:
                    raise ValueError("too few macro arguments")
                given[name] = text if text or default is None else default
        out, quoted, i, body = [], False, 0, macro.body
        while i < len(body):
            x = body[i]
            if x.kind == "paste":
                while out and not out[-1].strip():
                    out.pop()
                while i + 1 < len(body) and body[i + 1].kind == "space":
                    i += 1
            elif x.kind == "quote":
                out.append('\\"' if "\\" in x.text else '"')
                quoted = not quoted if "\\" not in x.text else quoted
            elif x.kind in ("ident", "keyword") and x.text in given:
                out.append(given[x.text])
            elif x.kind == "directive" and x.text[1:] in self.out.macros and not quoted:
                inner, own = self.out.macros[x.text[1:]], None
                if inner.params is not None:
                    k = i + 1
                    while k < len(body) and body[k].kind in TRIVIA:
                        k += 1
                    if k >= len(body) or body[k].text != "(":
                        raise ValueError(f"macro {x.text} needs arguments")
                    own, after = _arguments(body, k)
                    if own is None:
                        raise ValueError(f"unterminated arguments of {x.text}")
                    own = [[Token("text", "".join(given.get(y.text, y.text) if y.kind in ("ident", "keyword") else y.text for y in a), 0, 0)] for a in own]
                    i = after - 1
                out.append(self.expand(inner, own, depth + 1))
            else:
                out.append(x.text)
            i += 1
        text = "".join(out)
        if "`" in text and any(t.kind == "directive" and t.text[1:] in self.out.macros for t in lex(text)):
            again = Macro(None, [t for t in lex(text)])
            return self.expand(again, None, depth + 1)
        return text


def _split(tokens: list[Token]) -> list[list[Token]]:
    """At commas outside brackets."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t.text in ("(", "[", "{", "'{")) - (t.text in (")", "]", "}"))
        if t.text == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def _arguments(tokens: list[Token], at: int) -> tuple[list[list[Token]] | None, int]:
    """The arguments from the bracket at a place on, and the place behind them; None if unended."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k].text in ("(", "[", "{", "'{")) - (tokens[k].text in (")", "]", "}"))
        if not depth:
            return _split(tokens[at + 1 : k]), k + 1
    return None, len(tokens)


def preprocess(file: int, path: str, text: str, includes: dict[tuple[str, str], tuple[int, str]] | None = None) -> Result:
    return Preprocessor(file, path, text, includes).run()


def _inputs(b: pa.RecordBatch) -> Iterator[tuple[int, str, str, dict]]:
    for file, path, text, inc in zip(*(b.column(c).to_pylist() for c in ("file_id", "path", "text", "includes")), strict=True):
        yield file, path or "", text or "", {(x["kind"], x["spelling"]): (x["file_id"], x["text"] or "") for x in inc or []}


def _table(sources: DataFrame, schema: str, rows) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, path, text, inc in _inputs(b):
                found = [(file, *r) for r in rows(preprocess(file, path, text, inc))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, {"int": pa.int32(), "string": pa.string()}[s.split()[1]]) for c, s in zip(zip(*found, strict=True), schema.split(", "), strict=True)], names=names)

    return sources.select("file_id", "path", "text", "includes").mapInArrow(work, schema)


def directive_events(sources: DataFrame) -> DataFrame:
    """file_id, event_seq, expanded_offset, kind, arg and start. sources: file_id, path, text, includes."""
    return _table(sources, "file_id int, event_seq int, expanded_offset int, kind string, arg string, start int", lambda r: [(i, *e) for i, e in enumerate(r.events)])


def segments(sources: DataFrame) -> DataFrame:
    """file_id, exp_start, exp_end, origin_file, origin_start, origin_len, kind; runs of source text are one."""

    def rows(r: Result) -> list[tuple]:
        out, at = [], 0
        for text, file, start, length, kind in r.pieces:
            n = len(text.encode())
            if out and kind == "source" == out[-1][5] and out[-1][2] == file and out[-1][3] + out[-1][4] == start:
                out[-1] = (out[-1][0], at + n, file, out[-1][3], out[-1][4] + length, kind)
            else:
                out.append((at, at + n, file, start, length, kind))
            at += n
        return out

    return _table(sources, "file_id int, exp_start int, exp_end int, origin_file int, origin_start int, origin_len int, kind string", rows)


def errors(sources: DataFrame) -> DataFrame:
    return _table(sources, "file_id int, start int, len int, message string", lambda r: r.errors)


def expanded(sources: DataFrame) -> DataFrame:
    """file_id and the whole expanded text."""
    return _table(sources, "file_id int, text string", lambda r: [(r.text,)])
