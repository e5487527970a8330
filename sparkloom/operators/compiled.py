"""Chat templates that models ship with, compiled to column expressions.

``Template`` reads the part of the template language that chat templates use: text, outputs, ``if``, ``for`` (also filtered), ``set``, namespaces,
comments, white-space marks; attributes, items, slices, calls of string methods, filters, tests, comparisons, conditionals.  What is outside this part
(macros, imports, unpacking) is a ``TemplateError`` when the template is compiled, never a wrong prompt.  Tags eat the line feed behind them and the blanks
before them on their line, as chat templates are rendered.

A loop is a ``transform`` whose texts are joined; a loop that sets a namespace is an ``aggregate`` that carries the namespace and the text so far.
Nothing leaves the JVM.

Values have Spark types.  Defined cases: null means missing, so it is both undefined and none, it is written as nothing, and it is false; an attribute that
the type lacks is undefined; a comparison of unlike types is false; ``tojson`` writes compact JSON without null fields; a null or empty list loops no
time; ``raise_exception`` raises where its branch is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sparkloom.functions.text import strip
from sparkloom.operators.templates import with_system_text

MESSAGE = "struct<role: string, content: string>"
TOOLS = "array<struct<type: string, function: struct<name: string, description: string, parameters: variant>>>"


class TemplateError(ValueError):
    """The template is outside the part of the language that is compiled, or doesn't parse."""


# --- reading

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+\-*%~|.,:()\[\]=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}


class _Reader:
    """Expressions of one tag, by precedence."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text.strip(), [], 0
        while at < len(self.text):
            found = _TOKEN.match(self.text, at)
            if not found:
                raise TemplateError(f"cannot read {self.text!r} at {at}")
            kind = found.lastgroup
            self.tokens.append((kind, found.group(kind)))
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        """The next operator or name; a string literal is none of these."""
        kind, text = self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else (None, None)
        return None if kind in ("str", None) else text

    def took(self, *texts: str) -> str | None:
        found = self.peek()
        if found in texts:
            self.at += 1
            return found
        return None

    def need(self, text: str) -> None:
        if not self.took(text):
            raise TemplateError(f"{text!r} expected in {self.text!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            raise TemplateError(f"a name expected in {self.text!r}")
        self.at += 1
        return text

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} not understood in {self.text!r}")

    def whole(self):
        value = self.value()
        if self.took("if"):
            cond = self.value()
            return ("cond", cond, value, self.whole() if self.took("else") else ("lit", None))
        return value

    def value(self):
        left = self.both()
        while self.took("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.took("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.took("not") else self.compared()

    def compared(self):
        left = self.sum()
        while True:
            if self.peek() == "not" and self.peek(1) == "in":
                self.at += 2
                left = ("not", ("in", left, self.sum()))
            elif op := self.took("==", "!=", "<", "<=", ">", ">=", "in"):
                left = (op, left, self.sum())
            else:
                return left

    def sum(self):
        left = self.product()
        while op := self.took("+", "-", "~"):
            left = (op, left, self.product())
        return left

    def product(self):
        left = self.signed()
        while op := self.took("*", "%"):
            left = (op, left, self.signed())
        return left

    def signed(self):
        return ("neg", self.signed()) if self.took("-") else self.tested()

    def tested(self):
        node = self.postfix(self.atom())
        while True:
            if self.took("|"):
                name = self.name()
                node = ("filter", node, name, *(self.arguments() if self.took("(") else ([], {})))
                node = self.postfix(node)
            elif self.took("is"):
                negated = bool(self.took("not"))
                node = ("test", node, self.name())
                node = ("not", node) if negated else node
            else:
                return node

    def atom(self):
        if self.took("("):
            inner = self.whole()
            self.need(")")
            return inner
        if self.took("["):
            items = []
            while not self.took("]"):
                items.append(self.whole())
                self.took(",")
            return ("list", items)
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind not in ("str", "num", "name"):
            raise TemplateError(f"a value expected in {self.text!r}")
        self.at += 1
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "num":
            return ("lit", int(text))
        return ("lit", _CONSTANTS[text]) if text in _CONSTANTS else ("name", text)

    def postfix(self, node):
        while True:
            if self.took("."):
                node = ("attr", node, self.name())
            elif self.took("("):
                node = ("call", node, *self.arguments())
            elif self.took("["):
                bounds = [None if self.peek() in (":", "]") else self.whole()]
                while self.took(":"):
                    bounds.append(None if self.peek() in (":", "]") else self.whole())
                self.need("]")
                node = ("item", node, bounds[0]) if len(bounds) == 1 else ("slice", node, *(bounds + [None])[:3])
            else:
                return node

    def arguments(self):
        given, named = [], {}
        while not self.took(")"):
            if self.peek(1) == "=":
                name = self.name()
                self.need("=")
                named[name] = self.whole()
            else:
                given.append(self.whole())
            self.took(",")
        return given, named


def _pieces(source: str):
    """("text", s), ("out", s) and ("tag", s), white space already settled."""
    out, at = [], 0
    for found in _TAG.finditer(source):
        text, whole = source[at : found.start()], found.group()
        if not whole.startswith("{{"):
            fresh = at == 0 or source[at - 1] == "\n"  # the text begins a line
            text = re.sub(r"((?:\A|\n))[ \t]+\Z" if fresh else r"(\n)[ \t]+\Z", r"\1", text)
        out.append(["text", text.rstrip() if whole[2] == "-" else text])
        out.append(["out", found[1]] if found[1] is not None else ["tag", found[2]] if found[2] is not None else ["text", ""])
        at = found.end()
        if whole[-3] == "-":
            at += len(source[at:]) - len(source[at:].lstrip())
        elif not whole.startswith("{{") and source[at : at + 1] == "\n":
            at += 1
    return [*out, ["text", source[at:]]]


def _parsed(source: str) -> list:
    """The statements of a template."""
    pieces, at = _pieces(source), 0

    def block(*ends: str):
        nonlocal at
        body = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                if text:
                    body.append(("text", text))
                continue
            read = _Reader(text)
            if kind == "out":
                body.append(("out", read.whole()))
                read.done()
                continue
            word = read.name()
            if word in ends:
                return body, word, read
            body += statement(word, read)
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, None, None

    def statement(word: str, read: _Reader) -> list:
        if word in ("generation", "endgeneration"):
            return []
        if word == "if":
            branches, cond = [], read.whole()
            while True:
                read.done()
                body, end, read = block("elif", "else", "endif")
                branches.append((cond, body))
                if end == "endif":
                    return [("if", branches)]
                cond = read.whole() if end == "elif" else ("lit", True)
        if word == "for":
            target = read.name()
            read.need("in")
            items = read.value()
            wanted = read.whole() if read.took("if") else None
            read.done()
            body, end, _ = block("else", "endfor")
            return [("for", target, items, wanted, body, block("endfor")[0] if end == "else" else [])]
        if word == "set":
            target = (read.name(), read.name() if read.took(".") else None)
            if not read.took("="):
                read.done()
                return [("capture", target, block("endset")[0])]
            value = read.whole()
            read.done()
            return [("set", target, value)]
        raise TemplateError(f"tag {word!r} isn't compiled")

    return block()[0]


def _names(node) -> set[str]:
    """All names that a piece of a template reads or sets."""
    if isinstance(node, dict):
        return set().union(*map(_names, node.values()))
    if not isinstance(node, (tuple, list)):
        return set()
    if len(node) == 2 and node[0] == "name":
        return {node[1]}
    return set().union(*map(_names, node))


def _set_inside(body: list) -> list[tuple[str, str]]:
    """Namespace attributes that a loop's body sets."""
    found = []
    for s in body:
        if s[0] in ("set", "capture") and s[1][1]:
            found.append(s[1])
        elif s[0] == "if":
            found += [t for _, b in s[1] for t in _set_inside(b)]
        elif s[0] == "for":
            found += _set_inside(s[4]) + _set_inside(s[5])
    return list(dict.fromkeys(found))


# --- compiling


@dataclass(frozen=True)
class _Value:
    col: Column
    type: S.DataType | None  # None: undefined

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, S.NumericType):
            return "number"
        return {S.StringType: "string", S.BooleanType: "bool", S.ArrayType: "list", S.StructType: "struct", S.VariantType: "variant"}.get(type(t), "none")


_STRING, _BOOL, _INT = S.StringType(), S.BooleanType(), S.IntegerType()
_UNDEFINED = _Value(F.lit, None)  # its column is never read: see _col


def _col(v: _Value) -> Column:
    return F.lit(None) if v.type is None else v.col


def _literal(x: Any) -> _Value:
    if x is None:
        return _UNDEFINED
    return _Value(F.lit(x), _BOOL if isinstance(x, bool) else _INT if isinstance(x, int) else _STRING)


def _true(v: _Value) -> Column:
    tests = {"string": lambda c: c != "", "bool": lambda c: c, "number": lambda c: c != 0, "list": lambda c: F.size(c) > 0, "struct": lambda c: c.isNotNull(), "variant": lambda c: c.isNotNull(), "none": lambda c: F.lit(False)}
    return F.coalesce(tests[v.kind](_col(v)), F.lit(False))


def _text(v: _Value) -> Column:
    if v.kind == "none":
        return F.lit("")
    if v.kind in ("list", "struct", "variant"):
        raise TemplateError("a list or mapping is written: tojson is missing")
    return F.coalesce(F.when(v.col, "True").when(~v.col, "False") if v.kind == "bool" else v.col.cast("string"), F.lit(""))


def _joined(texts: list[Column]) -> Column:
    return F.concat(*texts) if len(texts) > 1 else texts[0] if texts else F.lit("")


def _cut(chars: str, left: bool, right: bool, text: Column) -> Column:
    some = "[" + re.sub(r"([\\\]\[^\-&])", r"\\\1", chars) + "]+"
    text = F.regexp_replace(text, "^" + some, "") if left else text
    return F.regexp_replace(text, some + r"\z", "") if right else text


_SPACES = " \t\n\r\x0b\x0c"


class _Compiler:
    """Statements over an environment of values; namespaces are dictionaries of values."""

    def body(self, statements: list, env: dict) -> Column:
        return _joined([t for s in statements if (t := self.statement(s, env)) is not None])

    def statement(self, s: tuple, env: dict) -> Column | None:
        if s[0] == "text":
            return F.lit(s[1])
        if s[0] == "out":
            return _text(self.value(s[1], env))
        if s[0] in ("set", "capture"):
            (name, field), given = s[1], s[2]
            if s[0] == "set" and given[:2] == ("call", ("name", "namespace")):
                env[name] = {k: self.value(v, env) for k, v in given[3].items()}
                return None
            value = self.value(given, env) if s[0] == "set" else _Value(self.body(given, dict(env)), _STRING)
            if field:
                env[name] = {**self.space(name, env), field: value}
            else:
                env[name] = value
            return None
        return self.branches(s[1], env) if s[0] == "if" else self.loop(s, env)

    @staticmethod
    def space(name: str, env: dict) -> dict:
        if not isinstance(env.get(name), dict):
            raise TemplateError(f"{name!r} isn't a namespace")
        return env[name]

    def branches(self, branches: list, env: dict) -> Column:
        taken = []
        for cond, body in branches:
            own = dict(env)
            taken.append((_true(self.value(cond, env)), self.body(body, own), own))
        pick = lambda parts, other: self.chosen([(c, p) for (c, _, _), p in zip(taken, parts, strict=True)], other)
        out = pick([t for _, t, _ in taken], F.lit(""))
        for name in {n for _, _, own in taken for n in own if own[n] is not env.get(n)}:
            versions = [own.get(name, _UNDEFINED) for _, _, own in taken]
            if any(isinstance(v, dict) for v in versions):
                before = env.get(name, {})
                fields = {f for v in versions for f in v}
                env[name] = {f: self.merged([v.get(f, _UNDEFINED) for v in versions], before.get(f, _UNDEFINED), pick) for f in fields}
            else:
                env[name] = self.merged(versions, env.get(name, _UNDEFINED), pick)
        return out

    @staticmethod
    def chosen(cases: list, other: Column) -> Column:
        out = other
        for cond, value in reversed(cases):
            out = F.when(cond, value).otherwise(out)
        return out

    @staticmethod
    def merged(versions: list[_Value], before: _Value, pick) -> _Value:
        kinds = {v.kind: v.type for v in [*versions, before] if v.type is not None}
        if len(kinds) > 1:
            raise TemplateError("a variable has different types in the branches of an if")
        return _Value(pick([_col(v) for v in versions], _col(before)), next(iter(kinds.values()), None))

    def loop(self, s: tuple, env: dict) -> Column:
        _, target, items, wanted, body, otherwise = s
        found = self.value(items, env)
        if found.kind == "none":
            return self.body(otherwise, dict(env))
        if found.kind != "list":
            raise TemplateError("for goes over lists alone")
        element, rows = found.type.elementType, F.coalesce(found.col, F.array().cast(found.type.simpleString()))
        if wanted:
            rows = F.filter(rows, lambda x: _true(self.value(wanted, env | {target: _Value(x, element)})))
        n = F.size(rows)

        def inner(x: Column, i: Column) -> dict:
            place = {"index0": i, "index": i + 1, "length": n, "revindex": n - i, "revindex0": n - i - 1}
            flags = {"first": i == 0, "last": i == n - 1}
            near = {"previtem": F.when(i > 0, F.get(rows, i - 1)), "nextitem": F.get(rows, i + 1)}
            loop = {k: _Value(c, _INT) for k, c in place.items()} | {k: _Value(c, _BOOL) for k, c in flags.items()} | {k: _Value(c, element) for k, c in near.items()}
            return env | {target: _Value(x, element), "loop": loop}

        carried = [(space, f) for space, f in _set_inside(body) if isinstance(env.get(space), dict)]
        if not carried:
            out = F.array_join(F.transform(rows, lambda x, i: self.body(body, inner(x, i))), "")
        else:
            label = lambda space, f: f"{space}__{f}"
            for space, f in carried:
                if env[space].get(f, _UNDEFINED).type is None:
                    raise TemplateError(f"{space}.{f} is set in a loop and has no value of a type before it")
            start = F.struct(F.lit("").alias("text"), *(env[sp][f].col.alias(label(sp, f)) for sp, f in carried))

            def step(state: Column, x: Column) -> Column:
                own = inner(x["item"], x["at"])
                for sp, f in carried:
                    own[sp] = {**own[sp], f: _Value(state[label(sp, f)], env[sp][f].type)}
                text = self.body(body, own)
                for sp, f in carried:
                    if own[sp][f].kind != env[sp][f].kind:
                        raise TemplateError(f"{sp}.{f} changes its type in a loop")
                return F.struct(F.concat(state["text"], text).alias("text"), *(own[sp][f].col.alias(label(sp, f)) for sp, f in carried))

            end = F.aggregate(F.transform(rows, lambda x, i: F.struct(i.alias("at"), x.alias("item"))), start, step)
            for sp, f in carried:
                env[sp] = {**env[sp], f: _Value(end[label(sp, f)], env[sp][f].type)}
            out = end["text"]
        return F.when(n == 0, self.body(otherwise, dict(env))).otherwise(out) if otherwise else out

    def value(self, node, env: dict) -> _Value:
        return getattr(self, "_" + self.RULES.get(node[0], node[0]))(node, env)

    RULES = {"or": "logic", "and": "logic", "not": "negation", "+": "plus", "-": "arithmetic", "*": "arithmetic", "%": "arithmetic", "~": "tilde", "in": "within"} | {o: "compare" for o in ("==", "!=", "<", "<=", ">", ">=")}

    def _lit(self, node, env):
        return _literal(node[1])

    def _name(self, node, env):
        found = env.get(node[1], _UNDEFINED)
        if isinstance(found, dict):
            raise TemplateError(f"{node[1]!r} is used as a value")
        return found

    def _list(self, node, env):
        items = [self.value(n, env) for n in node[1]]
        if not items or len({v.kind for v in items}) > 1 or items[0].type is None:
            raise TemplateError("lists hold values of one type")
        return _Value(F.array(*(v.col for v in items)), S.ArrayType(items[0].type))

    def _attr(self, node, env):
        inner = node[1]
        if inner[0] == "name" and isinstance(env.get(inner[1]), dict):
            return env[inner[1]].get(node[2], _UNDEFINED)
        return self.field(self.value(inner, env), node[2])

    @staticmethod
    def field(value: _Value, name: str) -> _Value:
        if value.kind == "struct" and name in value.type.names:
            return _Value(value.col[name], value.type[name].dataType)
        return _UNDEFINED

    def _item(self, node, env):
        value = self.value(node[1], env)
        if node[2][0] == "lit" and isinstance(node[2][1], str):
            return self.field(value, node[2][1])
        at = self.value(node[2], env)
        if value.kind == "none":
            return _UNDEFINED
        if value.kind != "list" or at.kind != "number":
            raise TemplateError("items are taken by number from lists, by a fixed name from mappings")
        return _Value(F.get(value.col, F.when(at.col < 0, F.size(value.col) + at.col).otherwise(at.col).cast("int")), value.type.elementType)

    def _slice(self, node, env):
        value = self.value(node[1], env)
        low, high, step = (None if b is None else self.value(b, env) for b in node[2:])
        if value.kind == "none":
            return _UNDEFINED
        if value.kind != "list" or node[4] not in (None, ("lit", 1), ("neg", ("lit", 1))):
            raise TemplateError("slices are of lists, by steps of 1 or -1")
        if node[4] == ("neg", ("lit", 1)):
            if low or high:
                raise TemplateError("a slice by -1 has no bounds")
            return _Value(F.reverse(value.col), value.type)
        n = F.size(value.col)
        place = lambda v, other: other if v is None else F.least(n, F.when(v.col < 0, F.greatest(n + v.col, F.lit(0))).otherwise(v.col))
        start, end = place(low, F.lit(0)), place(high, n)
        return _Value(F.slice(value.col, start + 1, F.greatest(end - start, F.lit(0))), value.type)

    def _cond(self, node, env):
        return self.either(_true(self.value(node[1], env)), self.value(node[2], env), self.value(node[3], env))

    def either(self, cond: Column, a: _Value, b: _Value) -> _Value:
        return self.merged([a], b, lambda parts, other: F.when(cond, parts[0]).otherwise(other))

    def _logic(self, node, env):
        a, b = self.value(node[1], env), self.value(node[2], env)
        if len({a.kind, b.kind} - {"none"}) == 1 and "bool" not in (a.kind, b.kind):  # the value itself, as in a default by "or"
            return self.either(_true(a), *((a, b) if node[0] == "or" else (b, a)))
        return _Value(_true(a) | _true(b) if node[0] == "or" else _true(a) & _true(b), _BOOL)

    def _negation(self, node, env):
        return _Value(~_true(self.value(node[1], env)), _BOOL)

    def _neg(self, node, env):
        v = self.value(node[1], env)
        return _Value(-_col(v), v.type)

    def _plus(self, node, env):
        a, b = self.value(node[1], env), self.value(node[2], env)
        kinds = {a.kind, b.kind} - {"none"}
        if kinds == {"number"}:
            return self._arithmetic(node, env)
        if kinds == {"list"}:
            return _Value(F.concat(*(v.col for v in (a, b) if v.type is not None)), a.type or b.type)
        if kinds <= {"string"}:
            return _Value(F.concat(_text(a), _text(b)), _STRING)
        raise TemplateError("+ joins two strings, numbers or lists")

    def _arithmetic(self, node, env):
        a, b = self.value(node[1], env), self.value(node[2], env)
        if {a.kind, b.kind} != {"number"}:
            raise TemplateError(f"{node[0]} takes numbers")
        out = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col, "%": lambda: F.pmod(a.col, b.col)}[node[0]]()
        return _Value(out, _INT)

    def _tilde(self, node, env):
        return _Value(F.concat(_text(self.value(node[1], env)), _text(self.value(node[2], env))), _STRING)

    def _compare(self, node, env):
        op, a, b = node[0], self.value(node[1], env), self.value(node[2], env)
        if op in ("==", "!="):
            like = a.kind == b.kind or "none" in (a.kind, b.kind)
            equal = _col(a).eqNullSafe(_col(b)) if like and not {a.kind, b.kind} & {"variant"} else F.lit(False)
            return _Value(equal if op == "==" else ~equal, _BOOL)
        if a.kind != b.kind or a.kind not in ("number", "string"):
            raise TemplateError(f"{op} compares two numbers or two strings")
        out = {"<": lambda: a.col < b.col, "<=": lambda: a.col <= b.col, ">": lambda: a.col > b.col, ">=": lambda: a.col >= b.col}[op]()
        return _Value(F.coalesce(out, F.lit(False)), _BOOL)

    def _within(self, node, env):
        a, b = self.value(node[1], env), self.value(node[2], env)
        if b.kind == "struct" and node[1][0] == "lit":
            found = self.field(b, node[1][1])
            return _Value(_col(found).isNotNull(), _BOOL)
        if b.kind == "string" and a.kind == "string":
            return _Value(F.coalesce(F.contains(b.col, a.col), F.lit(False)), _BOOL)
        if b.kind == "list" and a.type is not None:
            return _Value(F.coalesce(F.array_contains(b.col, a.col), F.lit(False)), _BOOL)
        return _Value(F.lit(False), _BOOL)

    def _test(self, node, env):
        if node[2] == "defined" and node[1][0] == "name" and isinstance(env.get(node[1][1]), dict):
            return _literal(True)
        v = self.value(node[1], env)
        there = _col(v).isNotNull()
        kinds = {"string": ("string",), "number": ("number",), "mapping": ("struct",), "iterable": ("list", "string", "struct"), "sequence": ("list", "string"), "boolean": ("bool",)}
        if node[2] in kinds:
            return _Value(there if v.kind in kinds[node[2]] else F.lit(False), _BOOL)
        tests = {"defined": lambda: there, "undefined": lambda: ~there, "none": lambda: ~there}
        tests |= {w: lambda w=w: F.coalesce(v.col == (w == "true"), F.lit(False)) if v.kind == "bool" else F.lit(False) for w in ("true", "false")}
        if node[2] not in tests:
            raise TemplateError(f"test {node[2]!r} isn't compiled")
        return _Value(tests[node[2]](), _BOOL)

    def _filter(self, node, env):
        v, name, args = self.value(node[1], env), node[2], [self.value(a, env) for a in node[3]]
        if name in ("default", "d"):
            return self.either(_true(v) if len(args) > 1 else _col(v).isNotNull(), v, args[0])
        if name == "tojson":
            return _Value(F.lit("null") if v.type is None else self.json(v), _STRING)
        if name in ("length", "count"):
            return _Value(F.coalesce({"list": F.size, "string": F.length}[v.kind](v.col), F.lit(0)) if v.kind in ("list", "string") else F.lit(0), _INT)
        if name in ("first", "last") and v.kind == "list":
            return _Value(F.get(v.col, F.lit(0) if name == "first" else F.size(v.col) - 1), v.type.elementType)
        if name == "join" and v.kind == "list":
            return _Value(F.array_join(v.col, node[3][0][1] if node[3] else ""), _STRING)
        if name in ("string", "safe"):
            return _Value(_text(v), _STRING)
        if name == "list":
            return v
        return self.method(v, {"trim": "strip"}.get(name, name), node[3], args)

    @staticmethod
    def json(v: _Value) -> Column:
        if v.kind in ("list", "struct", "variant"):
            return F.coalesce(F.to_json(v.col), F.lit("null"))
        wrapped = F.to_json(F.array(v.col))
        return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)

    def _call(self, node, env):
        if node[1] == ("name", "raise_exception"):
            return _Value(F.raise_error(_text(self.value(node[2][0], env))).cast("string"), _STRING)
        if node[1][0] != "attr":
            raise TemplateError(f"call of {node[1]!r} isn't compiled")
        v = self.value(node[1][1], env)
        if node[1][2] == "get" and v.kind in ("struct", "none"):
            found = self.field(v, node[2][0][1])
            return found if len(node[2]) < 2 else self.either(_col(found).isNotNull(), found, self.value(node[2][1], env))
        return self.method(v, node[1][2], node[2], [self.value(a, env) for a in node[2]])

    @staticmethod
    def method(v: _Value, name: str, nodes: list, args: list[_Value]) -> _Value:
        text = _text(v)
        fixed = [n[1] if n[0] == "lit" else None for n in nodes]
        if name in ("strip", "lstrip", "rstrip"):
            if not fixed and name == "strip":
                return _Value(strip(text), _STRING)
            if fixed and not isinstance(fixed[0], str):
                raise TemplateError(f"{name} takes fixed characters")
            return _Value(_cut(fixed[0] if fixed else _SPACES, name != "rstrip", name != "lstrip", text), _STRING)
        whole: dict[str, Callable[[], _Value]] = {
            "upper": lambda: _Value(F.upper(text), _STRING), "lower": lambda: _Value(F.lower(text), _STRING), "capitalize": lambda: _Value(F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text)))), _STRING),
            "startswith": lambda: _Value(F.startswith(text, _text(args[0])), _BOOL), "endswith": lambda: _Value(F.endswith(text, _text(args[0])), _BOOL),
            "replace": lambda: _Value(F.replace(text, _text(args[0]), _text(args[1])), _STRING), "split": lambda: _Value(F.split(text, re.escape(fixed[0]), -1), S.ArrayType(_STRING)),
        }
        if name not in whole or (name == "split" and not (fixed and isinstance(fixed[0], str))):
            raise TemplateError(f"{name!r} isn't compiled")
        return whole[name]()


# --- templates


class Template:
    """A compiled template for messages and tools of the given types.

    ``additive`` tells whether a prompt is a frame plus one text for each message that depends on this message alone; then ``piece`` and ``frame`` give
    these, and the length of any choice of messages is a sum."""

    def __init__(self, source: str, message: str = MESSAGE, tools: str = TOOLS):
        self.statements = _parsed(source)
        self.message, self.tools = S.DataType.fromDDL(message), S.DataType.fromDDL(tools)
        loops = [s for s in self.statements if s[0] == "for" and s[2] == ("name", "messages")]
        others = [s for s in self.statements if not (loops and s is loops[0])]
        own = {name for s in self._all(others) if s[0] in ("set", "capture") for name in [s[1][0]]}
        self.additive = len(loops) == 1 and "messages" not in _names(others) and not _names(list(loops[0][3:5])) & ({"messages", "loop"} | own) and not loops[0][3] and not loops[0][5] and not _set_inside(loops[0][4])
        self._loop, self._others = (loops[0] if loops else None), others
        self.render(F.col("m"), F.col("t"), add_generation_prompt=True)  # whatever can't be compiled is told now

    @staticmethod
    def _all(body: list) -> list:
        return [t for s in body for t in [s, *(Template._all([u for _, b in s[1] for u in b]) if s[0] == "if" else Template._all(s[4]) if s[0] == "for" else [])]]

    def _env(self, tools: Column | None, flags: dict) -> dict:
        given = {name: _Value(x, _STRING) if isinstance(x, Column) else _literal(x) for name, x in flags.items()}
        return given | ({} if tools is None else {"tools": _Value(tools, self.tools)})

    def render(self, messages: Column, tools: Column | None = None, **flags) -> Column:
        """The prompt; flags are fixed values or string columns, by the names that the template gives them."""
        env = self._env(tools, flags) | {"messages": _Value(messages, S.ArrayType(self.message))}
        return _Compiler().body(self.statements, env)

    def piece(self, message: Column, tools: Column | None = None, **flags) -> Column:
        return _Compiler().body(self._loop[4], self._env(tools, flags) | {self._loop[1]: _Value(message, self.message)})

    def frame(self, tools: Column | None = None, **flags) -> Column:
        return _Compiler().body(self._others, self._env(tools, flags))


# What the probe asks with; a template that writes any of the last four knows tools.
PROBE_MESSAGE = "tool support probe"
PROBE_NAME, PROBE_DESCRIPTION, PROBE_PARAMETER, PROBE_VALUE = "__tool_probe_support__", "__tool_probe_description__", "__tool_probe_arg__", "__tool_probe_value__"


def knows_tools(spark: SparkSession, source: str) -> bool:
    """Whether a template writes tools: rendered without and with one, it differs and names it.  False for what isn't compiled or raises."""
    parameters = F.parse_json(F.lit('{"type":"object","properties":{"%s":{"type":"string","description":"%s"}}}' % (PROBE_PARAMETER, PROBE_VALUE)))
    function = F.struct(F.lit(PROBE_NAME).alias("name"), F.lit(PROBE_DESCRIPTION).alias("description"), parameters.alias("parameters"))
    tools = F.array(F.struct(F.lit("function").alias("type"), function.alias("function")))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit(PROBE_MESSAGE).alias("content")))
    try:
        template = Template(source)
        asked = [template.render(messages, t, add_generation_prompt=True).alias(n) for t, n in ((None, "without"), (tools, "with"))]
        row = spark.range(1).select(*asked).first()
    except Exception:  # a template that fails on the probe can't be used with tools
        return False
    return row["with"] != row["without"] and any(p in row["with"] for p in (PROBE_NAME, PROBE_DESCRIPTION, PROBE_PARAMETER, PROBE_VALUE))


@dataclass(frozen=True)
class Family:
    """How prompts of a model are made: the built-in template, the model's own one, whether that knows tools and may be given them, whether it is
    preferred without tools, and what opens the thinking."""

    builtin: Callable[[Column], Column]
    native: Template | None = None
    knows_tools: bool = False
    native_tools: bool = False
    prefer_native: bool = False
    opens: str = ""


def resolved(family: Family, messages: Column, tools: Column, choice: Column, injection: Column) -> Column:
    """The prompt of a request, in this order: the model's own template with the tools, if the choice is left to the model; else the tools as text in the
    messages, and then the model's own template if it is preferred, else the built-in one."""
    has = F.coalesce(F.size(tools) > 0, F.lit(False))
    told = F.when(has, with_system_text(messages, injection)).otherwise(messages)

    def opened(prompt: Column) -> Column:
        if not family.opens:
            return prompt
        bare = F.regexp_replace(prompt, r"\s+\z", "")
        return F.when(F.endswith(bare, F.lit(family.opens)), prompt).otherwise(F.concat(F.regexp_replace(prompt, r"\n+\z", ""), F.lit("\n" + family.opens)))

    flags = {"add_generation_prompt": True, "enable_thinking": bool(family.opens)}
    prefers = family.native is not None and family.prefer_native
    out = opened(family.native.render(told, **flags)) if prefers else family.builtin(told)
    if family.native is not None and family.native_tools and family.knows_tools:
        left = F.coalesce(choice, F.lit("auto")) == "auto"
        out = F.when(has & left, opened(family.native.render(messages, tools, **flags))).otherwise(out)
    return out
