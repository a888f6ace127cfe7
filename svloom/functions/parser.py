"""A lenient recursive-descent reader of design text that yields fact rows.

It never fails: what it doesn't know is skipped to the next semicolon. Facts are rows of tables:
defs, scopes, symbols, imports, exports, uses, params, ports, bodies (what elaboration needs, as a
tree), types (enum and record members), callables and sites (what rules look at, syntax errors included). Offsets are bytes of the
expanded text. order_key counts imports, uses and declarations in reading order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.functions import const
from svloom.functions.lexer import NET_KINDS, TRIVIA, Token, lex

#: Fixed values of the language.
DATA_TYPES = ("bit", "logic", "reg", "byte", "shortint", "int", "longint", "integer", "time", "real", "realtime", "shortreal", "string", "chandle", "event", "void")
UNITS = {"module": "endmodule", "macromodule": "endmodule", "interface": "endinterface", "program": "endprogram", "package": "endpackage", "primitive": "endprimitive", "checker": "endchecker"}
#: Blocks that are passed over.
PASSED = {"property": "endproperty", "sequence": "endsequence", "covergroup": "endgroup", "clocking": "endclocking", "specify": "endspecify", "config": "endconfig"}
DIRECTIONS = ("input", "output", "inout", "ref")
LEVELS = (("->", "<->"), ("||",), ("&&",), ("|",), ("^", "^~", "~^"), ("&",), ("==", "!=", "===", "!==", "==?", "!=?"), ("<", "<=", ">", ">=", "inside"), ("<<", ">>", "<<<", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",))
POWER = {op: 2 * i + 2 for i, ops in enumerate(LEVELS) for op in ops}
PREFIX = ("+", "-", "!", "~", "&", "~&", "|", "~|", "^", "~^", "^~", "++", "--")
#: Kinds of expressions that can be assigned to.
TARGETS = ("name", "index", "range", "field", "cat", "stream", "pattern")
ASSIGN = ("=", "<=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "<<<=", ">>>=")
STOP = Token("end", "", 0, 0)

Node = list[Any]


class Parser:
    def __init__(self, text: str):
        self.t = [t for t in lex(text) if t.kind not in TRIVIA]
        self.i = 0
        self.order = 0
        self.facts: dict[str, list[dict]] = {k: [] for k in ("defs", "scopes", "symbols", "imports", "exports", "uses", "params", "ports", "bodies", "types", "callables", "sites")}
        self.scope = self.open("file", None, None)
        self.loops = 0
        self.callable: str | None = None
        self.accesses: dict[int, dict] = {}  # sites of members of named things, by the name's place
        self.implicit = False  # whether an undeclared name here would declare a net

    # Tokens

    @property
    def now(self) -> Token:
        return self.t[self.i] if self.i < len(self.t) else STOP

    def peek(self, k: int = 1) -> Token:
        return self.t[self.i + k] if self.i + k < len(self.t) else STOP

    def take(self) -> Token:
        t = self.now
        self.i += 1
        return t

    def at(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind != "string"

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def name(self) -> Token | None:
        return self.take() if self.now.kind in ("ident", "escaped") else None

    def skip_to(self, *texts: str) -> None:
        """Past the next of these outside brackets."""
        depth = 0
        while self.now is not STOP:
            if not depth and self.at(*texts):
                self.i += 1
                return
            depth += self.at("(", "[", "{", "'{") - self.at(")", "]", "}")
            if depth < 0 or self.now.text.startswith("end") and self.now.kind == "keyword":
                return
            self.i += 1

    def skip_brackets(self) -> None:
        depth = 0
        while self.now is not STOP:
            depth += self.at("(", "[", "{", "'{") - self.at(")", "]", "}")
            self.i += 1
            if not depth:
                return

    # Facts

    def add(self, table: str, **row) -> dict:
        self.facts[table].append(row)
        return row

    def open(self, kind: str, parent: int | None, owner: str | None) -> int:
        n = len(self.facts["scopes"])
        self.add("scopes", scope_id=n, kind=kind, parent_id=parent, owner=owner)
        return n

    def key(self) -> int:
        self.order += 1
        return self.order

    def declare(self, t: Token, kind: str, value: Node | None = None, type_: dict | None = None) -> dict:
        ns = "type" if kind == "typedef" else "value"
        return self.add("symbols", symbol_id=len(self.facts["symbols"]), name=t.text.lstrip("\\"), kind=kind, ns=ns, scope_id=self.scope, start=t.start, len=t.len, order_key=self.key(), value=json.dumps(value) if value else None, type=json.dumps(type_) if type_ else None)

    def use(self, t: Token, ns: str, qualifier: str | None = None) -> None:
        self.add("uses", use_ordinal=len(self.facts["uses"]), qualifier=qualifier, name=t.text.lstrip("\\"), expected_ns=ns, scope_id=self.scope, order_key=self.key(), start=t.start, len=t.len, implicit=self.implicit)

    def site(self, kind: str, t: Token, detail: str | None = None) -> dict:
        return self.add("sites", kind=kind, start=t.start, len=t.len, scope_id=self.scope, loop_depth=self.loops, callable=self.callable, detail=detail)

    def problem(self, t: Token, what: str) -> None:
        """A syntax error; at the end of the text it lies on the last token."""
        self.site("syntax", t if t is not STOP or not self.t else self.t[-1], what)

    def close(self, opened: Token, *ends: str) -> None:
        if not self.eat(*ends):
            self.problem(opened, f"missing {ends[0]}")

    def semicolon(self) -> None:
        """The end of a declaration or statement; where another one begins instead, one is missing."""
        if self.now is STOP or self.now.kind == "keyword" and not self.at("with", "matches", "inside"):
            self.problem(self.now, "expected ;")
            return
        self.skip_to(";")

    # Units

    def file(self) -> dict[str, list[dict]]:
        while self.now is not STOP:
            before = self.i
            if self.at(*UNITS) or self.at("extern") and self.peek().text in UNITS:
                self.unit()
            else:
                self.item([])
            if self.i == before:
                self.i += 1
        return self.facts

    def unit(self) -> None:
        self.eat("extern")
        outside = self.t[self.i - 1].text == "extern" if self.i else False
        opened = self.take()
        kind = opened.text
        self.eat("static") or self.eat("automatic")
        t = self.name()
        if t is None:
            self.problem(opened, "expected a name")
            return
        kind = "module" if kind == "macromodule" else kind
        ordinal = len(self.facts["defs"])
        outer, self.scope = self.scope, self.open(kind, self.scope, t.text)
        self.add("defs", ordinal=ordinal, name=t.text.lstrip("\\"), kind=kind, start=t.start, len=t.len, scope_id=self.scope)
        body: list = []
        while self.at("import"):
            self.import_()
        if self.eat("#"):
            self.param_ports(ordinal)
        if self.at("("):
            self.port_list(ordinal)
        self.semicolon()
        if outside:
            self.scope = outer
            return
        if kind == "primitive":
            while self.now is not STOP and not self.at("endprimitive"):
                self.i += 1
        self.items(body, UNITS[kind], *UNITS, unit=ordinal)
        self.close(opened, UNITS[kind])
        if self.eat(":"):
            self.take()
        self.add("bodies", ordinal=ordinal, body=json.dumps(body))
        self.scope = outer

    def param_ports(self, ordinal: int) -> None:
        if not self.eat("("):
            return
        local = False
        while self.now is not STOP and not self.eat(")"):
            if self.at("parameter", "localparam"):
                local = self.take().text == "localparam"
            if self.at("type"):
                self.i += 1
                t = self.name()
                if t:
                    self.declare(t, "typedef")
                if self.eat("="):
                    self.type_()
            else:
                type_ = self.type_() if self.starts_type() else None
                t = self.name()
                if t is None:
                    self.i += 1
                    continue
                self.dims()
                value = self.expr() if self.eat("=") else None
                self.param(ordinal, t, value, local, type_)
            self.eat(",")

    def param(self, ordinal: int | None, t: Token, value: Node | None, local: bool, type_: dict | None) -> None:
        self.declare(t, "localparam" if local else "parameter", value, type_)
        if ordinal is not None:
            own = sum(1 for p in self.facts["params"] if p["def_ordinal"] == ordinal)
            self.add("params", def_ordinal=ordinal, ordinal=own, name=t.text, local=local, value=json.dumps(value) if value else None)

    def port_list(self, ordinal: int) -> None:
        self.eat("(")
        direction, n = "inout", 0
        while self.now is not STOP and not self.eat(")"):
            if self.at(*DIRECTIONS):
                direction = self.take().text
            if self.at(*NET_KINDS, "var"):
                self.i += 1
            type_, modport, interface = None, None, None
            if self.starts_type() or self.now.kind == "ident" and (self.peek().kind == "ident" or self.peek().text in ("::", ".") and self.peek(3).kind == "ident"):
                if self.now.kind == "ident" and self.peek().text == ".":
                    interface = self.now.text
                    self.use(self.take(), "definition")
                    self.i += 1
                    modport = self.take().text
                    direction = "interface"
                else:
                    type_ = self.type_()
            elif self.at("["):
                type_ = {"name": "logic", "dims": self.dims(), "signed": False}
            t = self.name()
            if t:
                dims = self.dims()
                value = self.expr() if self.eat("=") else None
                self.declare(t, "port", value, (type_ or {"name": "logic", "dims": [], "signed": False}) | {"unpacked": dims})
                self.add("ports", def_ordinal=ordinal, ordinal=n, name=t.text, direction=direction, modport=modport, interface=interface)
                n += 1
            elif not self.at(",", ")"):
                self.i += 1
            self.eat(",")

    # Items

    def items(self, body: list, *ends: str, unit: int | None = None) -> None:
        while self.now is not STOP:
            if self.at(*ends):
                if self.now.text not in UNITS:
                    return
                # A unit in another: nested if it names itself and the outer one has an end left, else the end is missing.
                rest = sum((t.text == ends[0]) - (UNITS.get(t.text) == ends[0]) for t in self.t[self.i :] if t.kind == "keyword")
                if rest < 1:
                    return
                self.unit()
                continue
            before = self.i
            self.item(body, unit)
            if self.i == before:
                self.i += 1

    def item(self, body: list, unit: int | None = None) -> None:
        t = self.now
        if self.at("import"):
            self.import_()
        elif self.at("export"):
            self.export()
        elif self.at("parameter", "localparam"):
            self.param_decl(unit)
        elif self.at("typedef"):
            self.typedef()
        elif self.at("genvar"):
            self.i += 1
            while n := self.name():
                self.declare(n, "genvar")
                if not self.eat(","):
                    break
            self.skip_to(";")
        elif self.at("function", "task"):
            self.subprogram()
        elif self.at("assign"):
            self.i += 1
            self.skip_strength()
            while True:
                start, self.implicit = self.now, self.peek().text == "="
                left = self.expr()
                self.implicit = False
                right = self.expr() if self.eat("=") else None
                self.written(left, False)
                self.site("assign", start, json.dumps([left, right]))
                if not self.eat(","):
                    break
            self.semicolon()
        elif self.at("always", "always_comb", "always_ff", "always_latch", "initial", "final"):
            self.i += 1
            self.statement()
        elif self.at("generate"):
            self.i += 1
            self.items(body, "endgenerate")
            self.eat("endgenerate")
        elif self.at("for"):
            self.generate_for(body)
        elif self.at("if"):
            self.generate_if(body)
        elif self.at("case"):
            self.generate_case(body)
        elif self.at("begin"):
            body.append(self.generate_block(None))
        elif self.at("modport"):
            self.modport()
        elif self.at(*DIRECTIONS):
            direction = self.take().text
            self.eat(*NET_KINDS) or self.eat("var")
            type_ = self.type_() if self.starts_type() or self.at("[") else None
            while n := self.name():
                self.declare(n, "port", None, (type_ or {"name": "logic", "dims": [], "signed": False}) | {"unpacked": self.dims()})
                if unit is not None:
                    own = [p for p in self.facts["ports"] if p["def_ordinal"] == unit]
                    known = next((p for p in own if p["name"] == n.text), None)
                    if known:
                        known["direction"] = direction
                    else:
                        self.add("ports", def_ordinal=unit, ordinal=len(own), name=n.text, direction=direction, modport=None, interface=None)
                if not self.eat(","):
                    break
            self.skip_to(";")
        elif self.at(*NET_KINDS):
            self.i += 1
            self.skip_strength()
            type_ = self.type_() if self.starts_type() or self.at("[", "signed", "unsigned") else {"name": "logic", "dims": [], "signed": False}
            self.declarators("net", type_)
        elif self.at("timeunit", "timeprecision"):
            self.i += 1
            words = []
            while self.now is not STOP and not self.at(";") and self.now.kind != "keyword":
                words.append(self.take().text)
            self.site(t.text, t, "".join(words))
            self.semicolon()
        elif self.at("var", "const", "static", "automatic") or self.starts_type():
            if self.at("automatic"):
                self.site("automatic", t)
            self.declaration()
        elif t.kind == "ident":
            self.instance_or_declaration(body)
        elif self.eat(";"):
            pass
        elif self.at(*PASSED):
            while self.now is not STOP and not self.at(PASSED[t.text], *UNITS.values()):
                self.i += 1
            self.close(t, PASSED[t.text])
            if self.eat(":"):
                self.name()
        elif t.kind == "keyword" and t.text.startswith("end"):
            self.i += 1  # of something that isn't read here
            if self.eat(":"):
                self.name()
        else:
            if t.kind in ("op", "number", "based", "string"):
                self.problem(t, f"unexpected {t.text}")
            self.i += 1
            self.skip_to(";")

    def skip_strength(self) -> None:
        if self.at("(") and self.peek().text in ("strong0", "strong1", "pull0", "pull1", "weak0", "weak1", "highz0", "highz1", "supply0", "supply1", "small", "medium", "large"):
            start = self.take()
            words = []
            while self.now is not STOP and not self.eat(")"):
                words.append(self.take().text)
            self.site("strength", start, " ".join(w for w in words if w != ","))
        if self.eat("#"):
            self.skip_brackets() if self.at("(") else self.take()

    def import_(self) -> None:
        self.i += 1
        while (p := self.name()) and self.eat("::"):
            member = None if self.eat("*") else self.take().text
            n = sum(1 for x in self.facts["imports"] if x["scope_id"] == self.scope)
            self.add("imports", scope_id=self.scope, ordinal=n, package=p.text, member=member, order_key=self.key(), start=p.start)
            if not self.eat(","):
                break
        self.eat(";") or self.at("#", "(", "import") or self.skip_to(";")

    def export(self) -> None:
        self.i += 1
        while self.now is not STOP and not self.at(";"):
            start = self.now.start
            package = None if self.eat("*") else getattr(self.name(), "text", None)
            self.eat("::")
            member = None if self.eat("*") else getattr(self.name(), "text", None)
            form = "all" if package is None else "wildcard" if member is None else "explicit"
            self.add("exports", scope_id=self.scope, ordinal=len(self.facts["exports"]), form=form, package=package, member=member, start=start)
            if not self.eat(","):
                break
        self.skip_to(";")

    def param_decl(self, unit: int | None) -> None:
        local = self.take().text == "localparam"
        if self.eat("type"):
            while n := self.name():
                self.declare(n, "typedef")
                if self.eat("="):
                    self.type_()
                if not self.eat(","):
                    break
        else:
            type_ = self.type_() if self.starts_type() or self.at("[", "signed", "unsigned") or self.now.kind == "ident" and self.peek().kind == "ident" else None
            while n := self.name():
                self.dims()
                value = self.expr() if self.eat("=") else None
                self.param(unit, n, value, local, type_)
                if not self.eat(","):
                    break
        self.skip_to(";")

    def typedef(self) -> None:
        self.i += 1
        type_ = self.type_()
        if n := self.name():
            self.declare(n, "typedef", None, type_ | {"unpacked": self.dims()})
        self.skip_to(";")

    def starts_type(self) -> bool:
        return self.at(*DATA_TYPES, "enum", "struct", "union", "signed", "unsigned", "virtual")

    def dims(self) -> list:
        found = []
        while self.eat("["):
            if self.eat("]"):
                found.append(["dynamic"])
                continue
            if self.eat("$"):
                found.append(["queue", self.expr() if self.eat(":") else None])
            elif self.at("*"):
                self.i += 1
                found.append(["assoc", "*"])
            elif self.at(*DATA_TYPES):
                self.type_()
                found.append(["assoc"])
            else:
                a = self.expr()
                found.append(["range", a, self.expr()] if self.eat(":") else ["size", a])
            self.skip_to("]") if not self.eat("]") else None
        return found

    def type_(self) -> dict:
        """A data type, named or in place."""
        if self.at("signed", "unsigned"):
            return {"name": "logic", "signed": self.take().text == "signed", "dims": self.dims()}
        if self.at("["):
            return {"name": "logic", "signed": False, "dims": self.dims()}
        if self.at("enum"):
            return self.enum()
        if self.at("struct", "union"):
            return self.record()
        if self.at(*DATA_TYPES):
            name = self.take().text
            signed = name in ("byte", "shortint", "int", "longint", "integer")
            if self.at("signed", "unsigned"):
                signed = self.take().text == "signed"
            return {"name": name, "signed": signed, "dims": self.dims()}
        self.eat("virtual")
        t = self.name()
        if t is None:
            self.i += 1
            return {"name": "?", "signed": False, "dims": []}
        package = None
        if self.eat("::"):
            package, t = t.text, self.take()
        self.use(t, "type_then_value", package)
        return {"name": t.text, "package": package, "user": True, "start": t.start, "signed": False, "dims": self.dims()}

    def enum(self) -> dict:
        start = self.take()
        base = self.type_() if not self.at("{") else {"name": "int", "signed": True, "dims": []}
        members = []
        if self.eat("{"):
            while self.now is not STOP and not self.eat("}"):
                n = self.name()
                if n is None:
                    self.i += 1
                    continue
                span = None
                if self.eat("["):
                    a = self.expr()
                    span = [a, self.expr()] if self.eat(":") else [a]
                    self.eat("]")
                value = self.expr() if self.eat("=") else None
                members.append({"name": n.text, "span": span, "value": value, "start": n.start})
                ends = [const.evaluate(x, lambda q, n: "Unresolved") for x in span or []]
                if span is None:
                    self.declare(n, "enum_member", value)
                elif not any(isinstance(x, str) for x in ends):
                    # Names of a range whose ends are plain numbers; others can't be told before names are resolved.
                    for k in const.span(ends)[:65_536]:
                        self.declare(Token("ident", f"{n.text}{k}", n.start, n.len), "enum_member")
                self.eat(",")
        self.add("types", kind="enum", start=start.start, scope_id=self.scope, base=json.dumps(base), members=json.dumps(members))
        return {"name": "enum", "signed": base["signed"], "base": base, "site": start.start, "dims": self.dims()}

    def record(self) -> dict:
        start = self.take()
        tagged, packed, signed = self.eat("tagged"), False, False
        while self.at("packed", "signed", "unsigned", "soft"):
            word = self.take().text
            packed |= word == "packed"
            signed |= word == "signed"
        members = []
        if self.eat("{"):
            while self.now is not STOP and not self.eat("}"):
                before = self.i
                type_ = self.type_()
                while n := self.name():
                    members.append({"name": n.text, "type": type_ | {"unpacked": self.dims()}})
                    if not self.eat(","):
                        break
                self.skip_to(";")
                if self.i == before:
                    self.i += 1
        kind = "tagged" if tagged else start.text
        self.add("types", kind=kind, start=start.start, scope_id=self.scope, base=json.dumps({"packed": packed, "signed": signed}), members=json.dumps(members))
        return {"name": kind, "packed": packed, "signed": signed, "members": members, "site": start.start, "dims": self.dims()}

    def declaration(self) -> None:
        constant = False
        while self.at("var", "const", "static", "automatic"):
            constant |= self.take().text == "const"
        type_ = self.type_() if not (self.now.kind == "ident" and self.peek().text in ("=", ";", ",", "[")) else {"name": "logic", "signed": False, "dims": []}
        self.declarators("variable", type_, constant)

    def declarators(self, kind: str, type_: dict, constant: bool = False) -> None:
        while n := self.name():
            dims = self.dims()
            value = self.expr() if self.eat("=") else None
            if constant and value is None:
                self.site("const_uninitialised", n, n.text)
            if type_.get("name") == "void":
                self.site("void_variable", n, n.text)
            self.declare(n, kind, value, type_ | {"unpacked": dims})
            if not self.eat(","):
                break
        self.semicolon()

    def instance_or_declaration(self, body: list) -> None:
        k = 1
        if self.peek().text == "::":
            k = 3
        named = self.peek(k).kind in ("ident", "escaped")
        if self.peek(k).text == "#" or named and self.peek(k + 1).text in ("(", "[") and self.opens_ports(k + 1):
            self.instances(body)
        elif named or self.peek(k).text == "[":
            self.declaration()
        elif self.peek().text == ":" and self.peek(2).text == "begin":
            label = self.take()
            self.i += 1
            body.append(self.generate_block(label))
        else:
            self.i += 1
            self.skip_to(";")

    def opens_ports(self, k: int) -> bool:
        """Whether brackets from the k-th token on end in a round one: an instance, maybe an array of them."""
        while self.peek(k).text == "[":
            depth = 0
            while self.peek(k) is not STOP:
                depth += (self.peek(k).text == "[") - (self.peek(k).text == "]")
                k += 1
                if not depth:
                    break
        return self.peek(k).text == "("

    def instances(self, body: list) -> None:
        t = self.take()
        self.use(t, "definition")
        overrides = self.connections() if self.eat("#") else []
        while n := self.name():
            dims = self.dims()
            ports = self.connections() if self.at("(") else []
            self.declare(n, "instance")
            body.append({"k": "inst", "module": t.text, "name": n.text, "params": overrides, "ports": ports, "start": n.start, "dims": dims})
            if not self.eat(","):
                break
        self.skip_to(";")

    def connections(self) -> list:
        """[name or null, expression or null], or ['*'] and ['.name']."""
        found = []
        if not self.eat("("):
            return [[None, self.primary()]]
        while self.now is not STOP and not self.eat(")"):
            if self.eat(".*"):
                found.append(["*"])
            elif self.eat("."):
                n = self.take()
                if self.eat("("):
                    self.implicit = self.peek().text == ")"
                    found.append([n.text, None if self.at(")") else self.expr()])
                    self.implicit = False
                    self.eat(")")
                else:
                    self.use(n, "value")
                    found.append([n.text, ["name", None, n.text, n.start]])
            elif self.at(","):
                found.append([None, None])
            else:
                before = self.i
                found.append([None, self.expr()])
                if self.i == before:
                    self.i += 1
            self.eat(",")
        return found

    def modport(self) -> None:
        self.i += 1
        while n := self.name():
            self.declare(n, "modport")
            direction, entries = "inout", []
            if self.eat("("):
                while self.now is not STOP and not self.eat(")"):
                    if self.at(*DIRECTIONS, "import", "export"):
                        direction = self.take().text
                    elif m := self.name():
                        entries.append({"name": m.text, "direction": direction})
                    else:
                        self.i += 1
            self.add("types", kind="modport", start=n.start, scope_id=self.scope, base=json.dumps(n.text), members=json.dumps(entries))
            if not self.eat(","):
                break
        self.skip_to(";")

    # Generate

    def generate_block(self, label: Token | None) -> dict:
        """A begin block, or one item."""
        start = self.now
        outer, self.scope = self.scope, self.open("generate", self.scope, label.text if label else None)
        body: list = []
        name = label.text if label else None
        if self.eat("begin"):
            if self.eat(":"):
                name = self.take().text
            self.items(body, "end")
            self.eat("end")
            if self.eat(":"):
                name = self.take().text
        else:
            self.item(body)
        self.facts["scopes"][self.scope]["owner"] = name
        self.scope = outer
        return {"k": "block", "name": name, "body": body, "start": start.start}

    def generate_for(self, body: list) -> None:
        start = self.take()
        self.eat("(")
        outer, self.scope = self.scope, self.open("generate", self.scope, None)
        if self.eat("genvar") and self.now.kind == "ident":
            self.declare(self.now, "genvar")
        var = self.take()
        self.eat("=")
        init = self.expr()
        self.eat(";")
        cond = self.expr()
        self.eat(";")
        step = self.step(var.text)
        self.skip_to(")")
        block = self.generate_block(None)
        self.scope = outer
        body.append({"k": "for", "var": var.text, "init": init, "cond": cond, "step": step, "body": block["body"], "name": block["name"], "start": start.start})

    def step(self, var: str) -> Node | None:
        """The next value of a loop variable, as an expression of it."""
        one, own = ["num", "1"], ["name", None, var, 0]
        if self.at("++", "--"):
            op = self.take().text[0]
            self.name()
            return ["bin", op, own, one]
        if n := self.name():
            self.use(n, "value")
            if self.at("++", "--"):
                return ["bin", self.take().text[0], own, one]
            if self.eat("="):
                return self.expr()
            if self.at(*ASSIGN):
                op = self.take().text[:-1]
                return ["bin", op, own, self.expr()]
        return None

    def generate_if(self, body: list) -> None:
        start = self.take()
        self.eat("(")
        cond = self.expr()
        self.skip_to(")")
        then = self.generate_block(None)
        other = self.generate_block(None) if self.eat("else") else None
        body.append({"k": "if", "cond": cond, "then": then, "else": other, "start": start.start})

    def generate_case(self, body: list) -> None:
        start = self.take()
        self.eat("(")
        value = self.expr()
        self.skip_to(")")
        arms = []
        while self.now is not STOP and not self.eat("endcase"):
            before = self.i
            labels = []
            if self.eat("default"):
                self.eat(":")
                labels = None
            else:
                while True:
                    labels.append(self.expr())
                    if not self.eat(","):
                        break
                self.eat(":")
            arms.append({"labels": labels, "block": self.generate_block(None)})
            if self.i == before:
                self.i += 1
        body.append({"k": "case", "value": value, "arms": arms, "start": start.start})

    # Subprograms and statements

    def subprogram(self) -> None:
        opened = self.take()
        kind = opened.text
        self.eat("static") or self.eat("automatic")
        if kind == "function" and (self.starts_type() or self.at("[") or self.now.kind == "ident" and self.peek().kind == "ident"):
            self.type_()
        t = self.name()
        if t is None:
            self.skip_to("end" + kind)
            return
        self.declare(t, kind)
        params: list[dict] = []
        row = self.add("callables", ordinal=len(self.facts["callables"]), name=t.text, kind=kind, start=t.start, scope_id=self.scope, params="[]")
        direction = "input"
        outer, self.scope = self.scope, self.open(kind, self.scope, t.text)
        was, self.callable, loops, self.loops = self.callable, kind, self.loops, 0
        if self.eat("("):
            while self.now is not STOP and not self.eat(")"):
                self.eat("const")
                if self.at(*DIRECTIONS):
                    direction = self.take().text
                self.eat("var")
                type_ = self.type_() if self.starts_type() or self.at("[") or self.now.kind == "ident" and self.peek().kind == "ident" else None
                if n := self.name():
                    type_ = (type_ or {"name": "logic", "signed": False, "dims": []}) | {"unpacked": self.dims()}
                    value = self.expr() if self.eat("=") else None
                    self.declare(n, "variable", None, type_)
                    params.append({"name": n.text, "direction": direction, "optional": value is not None})
                elif not self.at(",", ")"):
                    self.i += 1
                self.eat(",")
        self.skip_to(";")
        while self.now is not STOP and not self.at("end" + kind, *UNITS, *UNITS.values()):
            before, known = self.i, len(self.facts["symbols"])
            own = self.take().text if self.at(*DIRECTIONS) else None
            if own:
                typed = self.starts_type() or self.at("[") or self.now.kind == "ident" and self.peek().kind == "ident"
                self.declarators("variable", self.type_() if typed else {"name": "logic", "signed": False, "dims": []})
            else:
                self.statement()
            if own:
                params += [{"name": x["name"], "direction": own, "optional": False} for x in self.facts["symbols"][known:]]
            if self.i == before:
                self.i += 1
        row["params"] = json.dumps(params)
        self.close(opened, "end" + kind)
        if self.eat(":"):
            self.take()
        self.scope, self.callable, self.loops = outer, was, loops

    def statement(self) -> None:
        t = self.now
        while self.at("@", "#", "##"):
            self.i += 1
            if self.at("("):
                self.eat("(")
                while self.now is not STOP and not self.eat(")"):
                    if self.at("*", ",", "or", "posedge", "negedge", "edge", "iff"):
                        self.i += 1
                    else:
                        before = self.i
                        self.expr()
                        if self.i == before:
                            self.i += 1
            elif not self.at("*", "@*"):
                self.primary()
            else:
                self.i += 1
        if self.eat("@*"):
            pass
        if self.at("begin", "fork"):
            self.block()
        elif self.eat("if"):
            self.parens()
            self.statement()
            if self.eat("else"):
                self.statement()
        elif self.at("unique", "unique0", "priority"):
            self.i += 1
            self.statement()
        elif self.at("case", "casex", "casez"):
            self.case()
        elif self.eat("for"):
            outer, self.scope = self.scope, self.open("block", self.scope, None)
            self.eat("(")
            if self.starts_type():
                self.declaration()
            else:
                self.assignment()
            if not self.eat(";"):
                self.expr()
                self.eat(";")
            while self.now is not STOP and not self.eat(")"):
                before = self.i
                self.assignment(end=False)
                self.eat(",")
                if self.i == before:
                    self.i += 1
            self.loop()
            self.scope = outer
        elif self.eat("foreach"):
            outer, self.scope = self.scope, self.open("block", self.scope, None)
            self.eat("(")
            if n := self.name():
                self.use(n, "value")
            self.eat("[")
            found, own = [], None
            while self.now is not STOP and not self.eat("]"):
                if v := self.name():
                    self.declare(v, "variable", None, {"name": "int", "signed": True, "dims": [], "unpacked": []})
                    self.site("loop_variable", v, v.text)
                    own = v.text
                elif self.eat(","):
                    found.append(own)
                    own = None
                else:
                    self.i += 1
            if n:
                self.site("foreach", n, json.dumps({"array": n.text, "vars": [*found, own]}))
            self.skip_to(")")
            self.loop()
            self.scope = outer
        elif self.at("while", "repeat"):
            self.i += 1
            self.parens()
            self.loop()
        elif self.eat("forever"):
            self.loop()
        elif self.eat("do"):
            self.loop()
            self.eat("while")
            self.parens()
            self.skip_to(";")
        elif self.at("return", "break", "continue"):
            self.i += 1
            self.site(t.text, t)
            if not self.at(";"):
                self.expr()
            self.skip_to(";")
        elif self.at("parameter", "localparam"):
            self.param_decl(None)
        elif self.at("typedef"):
            self.typedef()
        elif self.at("import"):
            self.import_()
        elif self.at("var", "const", "static", "automatic") or self.starts_type() or t.kind == "ident" and (self.peek().kind == "ident" or self.peek().text == "::" and self.peek(3).kind == "ident"):
            self.declaration()
        elif self.eat(";"):
            pass
        else:
            self.assignment()

    def loop(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def parens(self) -> None:
        self.eat("(")
        self.expr()
        self.skip_to(")")

    def assignment(self, end: bool = True) -> None:
        start = self.now
        left = self.expr(no_compare=True)
        if self.at(*ASSIGN):
            self.written(left, self.now.text not in ("=", "<="))
            self.i += 1
            if self.at("#", "@"):
                self.i += 1
                self.primary()
            self.site("assign", start, json.dumps([left, self.expr()]))
        if end:
            self.semicolon()

    def written(self, left: Node, also_read: bool) -> None:
        """Notes that a member on the left side is written."""
        while left and left[0] in ("index", "range"):
            left = left[2] if left[0] == "range" else left[1]
        if left and left[0] == "field" and left[1][0] == "name" and (site := self.accesses.get(left[1][3])):
            site["detail"] = json.dumps(json.loads(site["detail"]) | {"access": "both" if also_read else "write"})

    def block(self) -> None:
        opened = self.take()
        ends = ("end",) if opened.text == "begin" else ("join", "join_any", "join_none")
        owner = self.take().text if self.eat(":") else None
        outer, self.scope = self.scope, self.open("block", self.scope, owner)
        while self.now is not STOP and not self.at(*ends, "endmodule", "endinterface", "endpackage", "endprogram", "endfunction", "endtask"):
            before = self.i
            self.statement()
            if self.i == before:
                self.i += 1
        self.close(opened, *ends)
        if self.eat(":"):
            self.take()
        self.scope = outer

    def case(self) -> None:
        t = self.take()
        self.parens()
        word = self.take().text if self.at("inside", "matches") else None
        self.site(t.text, t, word)
        while self.now is not STOP and not self.eat("endcase"):
            before = self.i
            if not self.eat("default"):
                while True:
                    self.expr()
                    if not self.eat(","):
                        break
            self.eat(":")
            self.statement()
            if self.i == before:
                self.i += 1

    # Expressions

    def expr(self, least: int = 0, no_compare: bool = False) -> Node:
        left = self.unary()
        while True:
            op = self.now.text
            if self.now.kind in ("op", "keyword") and op in POWER and POWER[op] > least and not (no_compare and op == "<="):
                self.i += 1
                left = ["bin", op, left, self.expr(POWER[op], no_compare)]
            elif op == "?" and least == 0:
                self.i += 1
                then = self.expr()
                self.eat(":")
                left = ["cond", left, then, self.expr()]
            else:
                return left

    def unary(self) -> Node:
        if self.now.kind == "op" and self.at(*PREFIX):
            op = self.take().text
            return ["un", op, self.unary()]
        return self.postfix(self.primary())

    def postfix(self, e: Node) -> Node:
        while True:
            if self.eat("["):
                a = self.expr()
                if self.at(":", "+:", "-:"):
                    mode = self.take().text
                    e = ["range", mode, e, a, self.expr()]
                else:
                    e = ["index", e, a]
                self.skip_to("]") if not self.eat("]") else None
            elif self.at(".") and self.peek().kind in ("ident", "keyword"):
                self.i += 1
                e = ["field", e, self.take().text]
                if e[1][0] == "name" and e[1][1] is None:
                    self.accesses[e[1][3]] = self.site("member", Token("ident", e[1][2], e[1][3], len(e[1][2].encode())), json.dumps({"name": e[1][2], "member": e[2], "access": "read"}))
            elif self.at("(") and e[0] in ("name", "field"):
                t = self.now
                given = [x for x in self.connections() if len(x) == 2]
                if e[0] == "name":
                    self.site("call", Token("ident", e[2], e[3], len(e[2].encode())), json.dumps([{"name": x[0], "given": x[1] is not None, "target": bool(x[1]) and x[1][0] in TARGETS} for x in given]))
                e = ["call", e, [x[1] for x in given]]
                if e[1][0] == "field":
                    self.site("method", t, json.dumps([e, bool(self.at("with"))]))
                    if self.eat("with"):
                        self.parens()
            elif self.at("'") and self.peek().text == "(":
                self.i += 2
                if e[0] == "name":  # a type or a number of bits
                    next(u for u in reversed(self.facts["uses"]) if u["start"] == e[3])["expected_ns"] = "type_then_value"
                to, e = e, ["cast", e, self.expr()]
                if to[0] == "name":
                    self.site("cast", Token("ident", to[2], to[3], len(to[2].encode())), json.dumps(e))
                self.eat(")")
            elif self.at("++", "--") and e[0] in ("name", "index", "field"):
                e = ["un", self.take().text, e]
            else:
                return e

    def arguments(self) -> list:
        return [x[1] for x in self.connections() if len(x) == 2]

    def primary(self) -> Node:
        t = self.now
        if t.kind in ("number", "based", "unbased", "real", "time"):
            self.i += 1
            return ["num" if t.kind in ("number", "based") else t.kind, t.text]
        if t.kind == "string":
            self.i += 1
            return ["str", t.text]
        if t.kind == "system":
            self.i += 1
            args = []
            if self.at("("):
                if self.peek().text in DATA_TYPES:
                    self.i += 1
                    args = [["type", self.type_()]]
                    self.skip_to(")")
                else:
                    args = self.arguments()
            self.site("system", t, json.dumps([t.text, len(args)]))
            return ["sys", t.text, args]
        if t.kind in ("ident", "escaped"):
            self.i += 1
            if self.at("::"):
                self.i += 1
                m = self.take()
                self.use(m, "value", t.text)
                return ["name", t.text, m.text, m.start]
            self.use(t, "value")
            return ["name", None, t.text.lstrip("\\"), t.start]
        if self.eat("new"):
            size = None
            if self.eat("["):
                size = self.expr()
                self.skip_to("]") if not self.eat("]") else None
            return ["new", size, self.arguments() if self.at("(") else []]
        if self.at(*DATA_TYPES) or self.at("signed", "unsigned", "const"):
            word = self.take().text
            if self.at("'") and self.peek().text == "(":
                self.i += 2
                e = ["cast", ["type", {"name": word, "dims": [], "signed": word not in ("bit", "logic", "reg")}], self.expr()]
                self.eat(")")
                return e
            return ["type", {"name": word, "dims": [], "signed": False}]
        if self.eat("("):
            e = self.expr()
            self.skip_to(")") if not self.eat(")") else None
            return e
        if self.at("{", "'{"):
            pattern = self.take().text == "'{"
            parts = []
            if self.at("<<", ">>"):
                op = self.take().text
                if not self.at("{"):
                    self.unary()
                self.eat("{")
                parts = self.list_("}")
                self.eat("}")
                return ["stream", op, parts]
            while self.now is not STOP and not self.eat("}"):
                before = self.i
                e = self.expr()
                if self.at("{"):
                    self.i += 1
                    e = ["rep", e, self.list_("}")]
                elif self.eat(":"):
                    e = ["pair", e, self.expr()]
                parts.append(e)
                self.eat(",")
                if self.i == before:
                    self.i += 1
            return ["pattern" if pattern else "cat", parts]
        if not self.at(";", ")", "]", "}", ",", ":"):
            self.i += 1
        return ["none"]

    def list_(self, end: str) -> list:
        found = []
        while self.now is not STOP and not self.eat(end):
            before = self.i
            found.append(self.expr())
            self.eat(",")
            if self.i == before:
                self.i += 1
        return found


def parse(text: str) -> dict[str, list[dict]]:
    return Parser(text).file()


#: Columns of the fact tables.
FACTS = {
    "defs": "ordinal int, name string, kind string, start int, len int, scope_id int",
    "scopes": "scope_id int, kind string, parent_id int, owner string",
    "symbols": "symbol_id int, name string, kind string, ns string, scope_id int, start int, len int, order_key int, value string, type string",
    "imports": "scope_id int, ordinal int, package string, member string, order_key int, start int",
    "exports": "scope_id int, ordinal int, form string, package string, member string, start int",
    "uses": "use_ordinal int, qualifier string, name string, expected_ns string, scope_id int, order_key int, start int, len int, implicit boolean",
    "params": "def_ordinal int, ordinal int, name string, local boolean, value string",
    "ports": "def_ordinal int, ordinal int, name string, direction string, modport string, interface string",
    "bodies": "ordinal int, body string",
    "types": "kind string, start int, scope_id int, base string, members string",
    "callables": "ordinal int, name string, kind string, start int, scope_id int, params string",
    "sites": "kind string, start int, len int, scope_id int, loop_depth int, callable string, detail string",
}


def facts(texts: DataFrame) -> DataFrame:
    """file_id, table and row (JSON) of all facts; texts: file_id and expanded text. Each file is read once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(file, k, json.dumps(r)) for k, own in parse(text or "").items() for r in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True)], names=["file_id", "table", "row"])

    return texts.select("file_id", "text").mapInArrow(work, "file_id int, table string, row string")


#: Bytes of typed facts that a task keeps for equal files, and rows handed on together.
KEPT, TOGETHER = 1 << 25, 20_000
_PLAIN = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_ARROW = {k: pa.struct([(x.split()[0], _PLAIN[x.split()[1]]) for x in v.split(", ")]) for k, v in FACTS.items()}


def _typed(text: str) -> list[pa.RecordBatch]:
    """table, and a column of each table's rows that is null in other tables' rows."""
    out = []
    for table, rows in parse(text).items():
        for at in range(0, len(rows), TOGETHER):
            own = rows[at : at + TOGETHER]
            columns = [pa.array(own, t) if k == table else pa.nulls(len(own), t) for k, t in _ARROW.items()]
            out.append(pa.RecordBatch.from_arrays([pa.array([table] * len(own), pa.string()), *columns], names=["table", *_ARROW]))
    return out


def typed_facts(texts: DataFrame) -> DataFrame:
    """The facts of texts with a typed column a table, so that no reader of a table parses JSON.

    Each file is read once, equal ones of a task together.
    """

    def joined(files: list[int], batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array([f for f, b in zip(files, batches, strict=True) for _ in range(b.num_rows)], pa.int32())
        yield from pa.Table.from_batches(batches).add_column(0, "file_id", ids).combine_chunks().to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[pa.RecordBatch]] = {}
        size, count, files, out = 0, 0, [], []
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                found = known.get(text)
                if found is None:
                    found = pa.Table.from_batches(_typed(text)).combine_chunks().to_batches()
                    cost = len(text) + sum(x.nbytes for x in found)
                    if size + cost > KEPT:
                        known, size = {}, 0
                    known[text], size = found, size + cost
                for x in found:
                    files.append(file)
                    out.append(x)
                    count += x.num_rows
                    if count >= TOGETHER:
                        yield from joined(files, out)
                        count, files, out = 0, [], []
        if out:
            yield from joined(files, out)

    columns = ", ".join(f"{k} struct<{', '.join(': '.join(x.split()) for x in v.split(', '))}>" for k, v in FACTS.items())
    return texts.select("file_id", "text").mapInArrow(work, f"file_id int, table string, {columns}")


def fact_table(all_facts: DataFrame, table: str) -> DataFrame:
    """One fact table with typed columns."""
    if table in all_facts.columns:
        return all_facts.where(F.col("table") == table).select("file_id", f"{table}.*")
    own = all_facts.where(F.col("table") == table).select("file_id", F.from_json("row", FACTS[table]).alias("r"))
    return own.select("file_id", "r.*")
