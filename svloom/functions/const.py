"""Constant expressions of the parser's trees, in checked 64-bit arithmetic.

A value or one of the errors Overflow, DivideByZero, InvalidArgument, NonConstant, Unsupported,
Unresolved. Comparison, logic, power and the other operators that constant evaluation leaves out are Unsupported,
as are casts' targets: a cast passes its value through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

Value = int | str  # an error is a string

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_BASE = {"b": 2, "o": 8, "d": 10, "h": 16}


def literal(text: str) -> Value:
    clean = text.replace("_", "").replace(" ", "").replace("\t", "").lower()
    if "'" not in clean:
        return int(clean) if int(clean) <= _HIGH else "Overflow"
    size, rest = clean.split("'", 1)
    signed = rest[0] == "s"
    base, digits = _BASE[rest[signed]], rest[1 + signed :]
    if re.search("[xz?]", digits):
        return "NonConstant"
    if signed or not digits:
        return "Unsupported"
    try:
        value = int(digits, base)
    except ValueError:
        return "Overflow"
    if value >> 128:
        return "Overflow"
    if not size:
        return value if value <= _HIGH else "Overflow"
    if int(size) > 64:
        return "Overflow"
    value &= (1 << int(size)) - 1
    return value - (1 << 64) if value > _HIGH else value


def _checked(v: int) -> Value:
    return v if _LOW <= v <= _HIGH else "Overflow"


def clog2(n: int) -> Value:
    return "InvalidArgument" if n < 0 else 0 if n <= 1 else (n - 1).bit_length()


def binary(op: str, a: int, b: int) -> Value:
    if op in "+-*" and len(op) == 1:
        return _checked(a + b if op == "+" else a - b if op == "-" else a * b)
    if op in ("/", "%"):
        if b == 0:
            return "DivideByZero"
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return _checked(q if op == "/" else a - q * b)
    if op in ("<<", ">>"):
        if not 0 <= b < 64:
            return "Overflow"
        if op == ">>":
            return a >> b
        low = (a << b) & ((1 << 64) - 1)
        return low - (1 << 64) if low > _HIGH else low
    if op in ("&", "|", "^"):
        return a & b if op == "&" else a | b if op == "|" else a ^ b
    return "Unsupported"


def evaluate(e: list, name: Callable[[str | None, str], Value], system: Callable[[str, list], Value] | None = None) -> Value:
    """A tree's value; name resolves (package, name), system calls that aren't known here."""
    kind = e[0]
    if kind == "num":
        return literal(e[1])
    if kind == "name":
        return name(e[1], e[2])
    if kind == "un" and e[1] in ("+", "-", "~"):
        v = evaluate(e[2], name, system)
        return v if isinstance(v, str) or e[1] == "+" else _checked(-v) if e[1] == "-" else ~v
    if kind == "bin":
        a = evaluate(e[2], name, system)
        if isinstance(a, str):
            return a
        b = evaluate(e[3], name, system)
        return b if isinstance(b, str) else binary(e[1], a, b)
    if kind == "cast":
        return evaluate(e[2], name, system)
    if kind == "sys":
        if e[1] == "$clog2" and len(e[2]) == 1:
            v = evaluate(e[2][0], name, system)
            return v if isinstance(v, str) else clog2(v)
        return system(e[1], e[2]) if system else "Unsupported"
    return "Unsupported"


def names(e: list | None) -> set[tuple[str | None, str]]:
    """All (package, name) that a tree refers to."""
    if not isinstance(e, list) or not e:
        return set()
    if e[0] == "name" and len(e) == 4:
        return {(e[1], e[2])}
    return set().union(*[names(x) for x in e if isinstance(x, list)]) if any(isinstance(x, list) for x in e) else set()


def loop_values(init: int, holds: Callable[[int], Value], step: Callable[[int], Value], most: int) -> tuple[list[int], str | None]:
    """Values of a loop variable, and why it stopped if not by its condition."""
    found, v = [], init
    while True:
        ok = holds(v)
        if isinstance(ok, str):
            return found, ok
        if not ok:
            return found, None
        if len(found) >= most:
            return found, "IterationLimit"
        found.append(v)
        nxt = step(v)
        if isinstance(nxt, str):
            return found, nxt
        if nxt == v:
            return [], None  # a step of nothing yields nothing
        v = nxt


def compare(op: str, a: int, b: int) -> bool | None:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "!=": a != b}.get(op)


def environment(params: list[dict], given: Mapping[str, Value], positional: list[Value | None], name: Callable[[str | None, str], Value]) -> dict[str, Value]:
    """Parameter values in order; defaults see earlier parameters only."""
    env: dict[str, Value] = {}
    place = 0
    for p in params:
        value: Value | None = None
        if not p["local"]:
            value = given.get(p["name"], positional[place] if place < len(positional) else None)
            place += 1
        if value is None:
            own = lambda q, n: env[n] if q is None and n in env else name(q, n)
            value = evaluate(p["value"], own) if p["value"] else "Unresolved"
        env[p["name"]] = value
    return env


def span(ends: list[int]) -> range:
    """The numbers of the names that a range in an enum stands for: [n] for 0 to n - 1, [a:b] from a to b either way."""
    if len(ends) == 1:
        return range(ends[0])
    step = 1 if ends[0] <= ends[1] else -1
    return range(ends[0], ends[1] + step, step)
