"""The expression language: lexer, parser, and a compiler to Columns.

A program is worked out when the plan is made: fields, locals and maps known by their names are values of the compiler, so what
reaches Spark is one projection and one filter. Functions are inlined, conditions guard assignments, loops over the
fields of a record are unrolled. Programs that accumulate into ``@variables`` and emit them at the end become a
grouped aggregation.
"""

from __future__ import annotations

import contextlib
import dataclasses
import json
import logging
import math
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as fn
from ..functions.scalars import Val, call, lit
from .stream import HIDDEN, Stream, col, java_regex, matcher

# ---------------------------------------------------------------- lexer

_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)
    |(?P<num>0[xX][0-9a-fA-F]+|0[bB][01]+|0o[0-7]+|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)
    |(?P<bytes>b"(?:[^"\\]|\\.)*")
    |(?P<str>"(?:[^"\\]|\\.)*"i?)
    |(?P<pos>\$\[\[\[|\$\[\[|\$\[|@\[)
    |(?P<field>\$\*|\$\{[^}]*\}|\$[A-Za-z_0-9\u0080-￿]+)
    |(?P<oos>@\*|@\{[^}]*\}|@[A-Za-z_0-9]+)
    |(?P<op>>>>=|\?\?\?=|\*\*=|\?\?=|\|\|=|\^\^=|&&=|//=|<<=|>>=|>>>|\?\?\?|!=~|<=>|\.\+|\.-|\.\*|\./|\+=|-=|\*=|/=|%=|\.=|&=|\|=|\^=|\*\*|//|\?\?|\|\||\^\^|&&|=~|==|!=|>=|<=|<<|>>|[-+*/%.?:!~&|^<>=(){}\[\],;])
    |(?P<name>[A-Za-z_][A-Za-z_0-9]*)""",
    re.X,
)


@dataclasses.dataclass
class Token:
    kind: str
    text: str


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"what is {text[at : at + 20]!r}?")
        if m.lastgroup != "ws":
            out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return [*out, Token("end", "")]


# ---------------------------------------------------------------- parser

#: Binary operators by how tightly they bind, loosest first. Fixed values.
LEVELS = [
    ["||"], ["^^"], ["&&"], ["=~", "!=~", "==", "!=", "<=>"], [">", ">=", "<", "<="], ["|"], ["^"], ["&"], ["<<", ">>", ">>>"], ["+", "-", ".+", ".-"], ["*", "/", "//", "%", ".*", "./"], ["."],
]
COALESCE = ["??", "???"]
ASSIGN = {"=", "+=", "-=", "*=", "/=", "//=", "%=", "**=", ".=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "&&=", "||=", "^^=", "??=", "???="}
TYPES = {"var", "str", "num", "int", "float", "bool", "map", "arr", "funct", "any", "bytes"}


class Parser:
    """Programs as nested tuples: (kind, ...)."""

    def __init__(self, text: str):
        self.t = lex(text)
        self.i = 0

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def take(self, text: str | None = None) -> Token:
        tok = self.now
        if text is not None and tok.text != text:
            raise SyntaxError(f"{text!r} is missing before {tok.text!r}")
        self.i += 1
        return tok

    def skip(self, text: str) -> bool:
        if self.now.text == text and self.now.kind in ("op", "name"):
            self.i += 1
            return True
        return False

    # -- statements

    def program(self) -> list:
        out = self.statements("")
        if self.now.kind != "end":
            raise SyntaxError(f"what is {self.now.text!r}?")
        return out

    def statements(self, until: str) -> list:
        out = []
        while True:
            while self.skip(";"):
                pass
            if self.now.kind == "end" or self.now.text == until:
                return out
            out.append(self.statement())
            if self.now.text not in (";", until) and self.now.kind != "end" and out[-1][0] not in ("if", "block", "begin", "end", "func", "subr", "for1", "for2", "form", "forc", "while", "do"):
                raise SyntaxError(f"a ; is missing before {self.now.text!r}")

    def block(self) -> list:
        self.take("{")
        out = self.statements("}")
        self.take("}")
        return out

    def statement(self):
        tok = self.now
        if tok.kind == "name":
            w = tok.text
            if w in ("begin", "end") and self.peek().text == "{":
                self.take()
                return (w, self.block())
            if w in ("func", "subr") and self.peek().kind == "name":
                self.take()
                name = self.take().text
                params = self.params()
                if self.skip(":"):
                    self.take()
                return (w, name, params, self.block())
            if w == "if":
                arms, other = [], []
                self.take()
                self.take("(")
                c = self.expr()
                self.take(")")
                arms.append((c, self.block()))
                while self.now.text in ("elif", "else"):
                    if self.take().text == "else":
                        other = self.block()
                        break
                    self.take("(")
                    c = self.expr()
                    self.take(")")
                    arms.append((c, self.block()))
                return ("if", arms, other)
            if w == "for":
                return self.for_loop()
            if w == "while":
                self.take()
                self.take("(")
                c = self.expr()
                self.take(")")
                return ("while", c, self.block())
            if w == "do":
                self.take()
                body = self.block()
                self.take("while")
                self.take("(")
                c = self.expr()
                self.take(")")
                return ("do", c, body)
            if w == "return":
                self.take()
                return ("return", None if self.now.text in (";", "}") else self.expr())
            if w in ("break", "continue"):
                return (self.take().text,)
            if w == "unset":
                self.take()
                out = [self.postfix()]
                while self.skip(","):
                    out.append(self.postfix())
                return ("unset", out)
            if w == "filter":
                self.take()
                return ("filter", self.expr())
            if w in ("emit", "emitp", "emit1", "emitf"):
                return self.emit()
            if w in ("print", "printn", "eprint", "eprintn", "dump", "edump", "tee"):
                return self.beside()
            if w == "call":
                self.take()
                name = self.take().text
                return ("call", name, self.args())
            if w in TYPES and self.peek().kind == "name":
                self.take()
                name = self.take().text
                value = self.expr() if self.skip("=") else None
                return ("local", name, value)
        e = self.expr()
        if self.now.text in ASSIGN and self.now.kind == "op":
            op = self.take().text
            return ("assign", e, op, self.expr())
        if self.now.text == "{":
            return ("block", e, self.block())
        return ("bare", e)

    def params(self) -> list[str]:
        self.take("(")
        out = []
        while not self.skip(")"):
            if self.now.text in TYPES and self.peek().kind == "name":
                self.take()
            out.append(self.take().text)
            if self.skip(":"):
                self.take()
            self.skip(",")
        return out

    def for_loop(self):
        self.take("for")
        self.take("(")
        if self.now.text == "(" and self.now.kind == "op":  # ((k1, k2), v in m)
            self.take("(")
            names = [self.take().text]
            while self.skip(","):
                names.append(self.take().text)
            self.take(")")
            self.take(",")
            v = self.take().text
            self.take("in")
            e = self.expr()
            self.take(")")
            return ("form", v, names, e, self.block())
        if self.now.kind == "name" and self.peek().text == "in":
            k = self.take().text
            self.take("in")
            e = self.expr()
            self.take(")")
            return ("for1", k, e, self.block())
        if self.now.kind == "name" and self.peek().text == ",":
            k = self.take().text
            self.take(",")
            v = self.take().text
            self.take("in")
            e = self.expr()
            self.take(")")
            return ("for2", k, v, e, self.block())
        parts = []
        for stop in (";", ";", ")"):
            some = []
            while self.now.text != stop:
                some.append(self.statement())
                self.skip(",")
            self.take(stop)
            parts.append(some)
        return ("forc", *parts, self.block())

    def redirect(self):
        """``> name,`` and its like in front of what is written: (how, name)."""
        if self.now.kind != "op" or self.now.text not in (">", ">>", "|"):
            return None
        how = self.take().text
        if how == "|":
            raise SyntaxError("no pipes on a cluster")
        if self.now.kind == "name" and self.now.text in ("stdout", "stderr"):
            return (how, ("str", self.take().text))
        return (how, self.expr())

    def beside(self):
        how = self.take().text
        to = self.redirect()
        if to and self.now.text == ",":
            self.take(",")
        things = []
        while self.now.kind != "end" and self.now.text not in (";", "}", ""):
            things.append(self.expr())
            if not self.skip(","):
                break
        if how == "tee" and (not to or len(things) != 1):
            raise SyntaxError("tee > name, $*")
        return ("beside", how, to or (">", ("str", "stderr" if how.startswith("e") else "stdout")), things)

    def emit(self):
        how = self.take().text
        to = self.redirect()
        if to:
            self.take(",")
            e = self.expr()
            return ("beside", "emit", to, [e])
        if how == "emitf":
            names = [self.expr()]
            while self.skip(","):
                names.append(self.expr())
            return ("emitf", names)
        lashed = self.now.text == "("
        if lashed:
            self.take("(")
            things = [self.expr()]
            while self.skip(","):
                things.append(self.expr())
            self.take(")")
        else:
            things = [self.expr()]
        names = []
        while self.skip(","):
            names.append(self.expr())
        return ("emit", how, things, names)

    # -- expressions

    def expr(self):
        c = self.binary(0)
        if self.skip("?"):
            a = self.expr()
            self.take(":")
            return ("call", "?:", [c, a, self.expr()])
        return c

    def binary(self, level: int):
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.now.kind == "op" and self.now.text in LEVELS[level]:
            op = self.take().text
            left = ("call", op, [left, self.binary(level + 1)])
        return left

    def unary(self):
        if self.now.kind == "op" and self.now.text in ("+", "-", "!", "~"):
            op = self.take().text
            return ("call", op, [self.unary()])
        return self.coalesce()

    def coalesce(self):
        left = self.coalesce3()
        while self.now.text == "??":
            self.take()
            left = ("call", "??", [left, self.coalesce3()])
        return left

    def coalesce3(self):
        left = self.power()
        while self.now.text == "???":
            self.take()
            left = ("call", "???", [left, self.power()])
        return left

    def power(self):
        left = self.postfix()
        if self.now.text == "**":
            self.take()
            if self.now.text in ("+", "-"):
                op = self.take().text
                return ("call", "**", [left, ("call", op, [self.power()])])
            return ("call", "**", [left, self.power()])
        return left

    def args(self) -> list:
        self.take("(")
        out = []
        while not self.skip(")"):
            out.append(self.expr())
            if not self.skip(",") and self.now.text != ")":
                raise SyntaxError(f"a , is missing before {self.now.text!r}")
        return out

    def postfix(self):
        e = self.atom()
        while self.now.text == "[" and self.now.kind == "op":
            self.take()
            a = None if self.now.text == ":" else self.expr()
            if self.skip(":"):
                z = None if self.now.text == "]" else self.expr()
                e = ("slice", e, a, z)
            else:
                e = ("index", e, a)
            self.take("]")
        return e

    def atom(self):
        tok = self.take()
        k, x = tok.kind, tok.text
        if k == "num":
            if re.match(r"0[xX]", x):
                v = int(x, 16)
                return ("lit", v - 2**64 if v >= 2**63 else v)
            if re.match(r"0[bB]", x):
                return ("lit", int(x[2:], 2))
            if x.startswith("0o"):
                return ("lit", int(x[2:], 8))
            return ("lit", int(x) if x.isdigit() else float(x))
        if k == "str":
            if x.endswith("i"):
                return ("regexi", x[1:-2])
            return ("str", x[1:-1])
        if k == "bytes":
            return ("bytes", x[2:-1].encode().decode("unicode_escape").encode("latin1"))
        if k == "pos":
            e = self.expr()
            for _ in range(x.count("[")):
                self.take("]")
            return ({"$[[[": "posvalue", "$[[": "posname", "$[": "fieldx", "@[": "oosx"}[x], e)
        if k == "field":
            if x == "$*":
                return ("record",)
            return ("field", x[2:-1] if x.startswith("${") else x[1:])
        if k == "oos":
            if x == "@*":
                return ("allvars",)
            return ("oos", x[2:-1] if x.startswith("@{") else x[1:])
        if x == "(":
            e = self.expr()
            self.take(")")
            return e
        if x == "{":
            out = []
            while not self.skip("}"):
                key = self.expr()
                self.take(":")
                out.append((key, self.expr()))
                self.skip(",")
            return ("map", out)
        if x == "[":
            out = []
            while not self.skip("]"):
                out.append(self.expr())
                self.skip(",")
            return ("array", out)
        if k == "name":
            if x in ("true", "false"):
                return ("lit", x == "true")
            if x == "absent":
                return ("lit", None)
            if x == "func" and self.now.text == "(":
                params = self.params()
                if self.skip(":"):
                    self.take()
                return ("lambda", params, self.block())
            if self.now.text == "(":
                return ("call", x, self.args())
            return ("name", x)
        raise SyntaxError(f"what is {x!r}?")


# ---------------------------------------------------------------- compiler


class NotPlanned(ValueError):
    """A program that no plan can express: it takes one record after the other."""


@dataclasses.dataclass
class Record:
    """A map whose keys are known when the plan is made."""

    items: dict[str, object]

    def val(self) -> Val:
        vals = {k: _val(v) for k, v in self.items.items()}
        kinds = {v.kind for v in vals.values()}
        if len(kinds) == 1 and kinds & {"int", "float", "bool"}:
            k = kinds.pop()
            t = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}[k]
            cells = {n: v.c for n, v in vals.items()}
        else:
            t = T.StringType()
            cells = {n: fn.txt(v) for n, v in vals.items()}
        if not cells:
            return Val(F.create_map().cast("map<string,string>"), "map", T.MapType(T.StringType(), T.StringType()), literal={})
        m = F.create_map(*[x for n, c in cells.items() for x in (F.lit(n), c)])
        m = F.map_filter(m, lambda k, v: v.isNotNull())
        return Val(m, "map", T.MapType(T.StringType(), t), literal={n: v.literal for n, v in vals.items()})


@dataclasses.dataclass
class Lambda:
    params: list[str]
    body: list
    scope: dict


def _val(v) -> Val:
    return v.val() if isinstance(v, Record) else v


class _Return(Exception):
    pass


CONTEXT = {"M_PI": math.pi, "M_E": math.e, "IPS": "=", "IFS": ",", "IRS": "\n", "OPS": "=", "OFS": ",", "ORS": "\n", "FLATSEP": "."}


class Compiler:
    def __init__(self, s: Stream, presets: dict | None = None):
        self.s = s
        self.fields: dict[str, object] = {c: Val(col(c), fn.kind_of(s.dtype(c)), s.dtype(c)) for c in s.columns}
        self.vars: dict[str, object] = {k: lit(v) for k, v in (presets or {}).items()}
        self.funcs: dict[str, tuple] = {}
        self.subrs: dict[str, tuple] = {}
        self.keep: Column | None = None
        self.bare: Column | None = None
        self.captures: tuple[Column, str] | None = None
        #: Variables that were read before they were set: they hold what an earlier record left.
        self.early: set[str] = set()
        self.depth = 0
        self.emitted: list[tuple[Column | None, Record]] = []
        #: Hidden columns that are worked out first, in batches that each only look at those before: a value that is long
        #: to write and used more than once would else stand, with all it is made of, at every place of its use.
        self.steps: list[dict[str, Column]] = []
        #: (name of the output, whether it is added to, condition, text) of what is written beside the records.
        self.beside: list[tuple] = []
        self.hoists = False
        #: Above 0 where a value may not be worked out for every record: behind a condition, or in a function literal.
        self.lazy = 0

    def held(self, v):
        """The value as a hidden column of its own, if it is long to write."""
        if not self.hoists or self.lazy or not isinstance(v, Val) or v.literal is not None or v.kind == "absent":
            return v
        text = v.c._jc.toString()
        if len(text) < 300:
            return v
        name = f"{HIDDEN}step{sum(map(len, self.steps))}"
        if not self.steps or any(n in text for n in self.steps[-1]):
            self.steps.append({})
        self.steps[-1][name] = v.c
        return dataclasses.replace(v, c=col(name))

    def source(self) -> DataFrame:
        """The stream's rows with the hidden columns that the compiled program looks at."""
        df = self.s.df
        for batch in self.steps:
            df = df.withColumns(batch)
        return df

    @contextlib.contextmanager
    def behind(self, condition: bool = True):
        self.lazy += condition
        try:
            yield
        finally:
            self.lazy -= condition

    # -- expressions

    def eval(self, e, scope: dict):
        k = e[0]
        if k == "lit":
            return lit(e[1])
        if k == "str":
            return self._string(e[1])
        if k == "regexi":
            return Val(F.lit(e[1]), "str", literal=f'"{e[1]}"i')
        if k == "bytes":
            return Val(F.lit(e[1]), "bytes", literal=e[1])
        if k == "field":
            return self.fields.get(e[1], lit(None))
        if k == "fieldx":
            return self.fields.get(self._key(e[1], scope), lit(None))
        if k == "record":
            return Record(dict(self.fields))
        if k in ("posname", "posvalue"):
            at = _val(self.eval(e[1], scope)).literal
            names = list(self.fields)
            if not isinstance(at, int) or not 1 <= abs(at) <= len(names):
                return lit(None)
            name = names[at - 1 if at > 0 else at]
            return lit(name) if k == "posname" else self.fields[name]
        if k == "oos":
            if e[1] not in self.vars:
                self.early.add(e[1])
            return self.vars.get(e[1], lit(None))
        if k == "name":
            return self._name(e[1], scope)
        if k == "map":
            out = {}
            for key, v in e[1]:
                name = self._key(key, scope, None)
                if name is None:
                    return self._open_map(e[1], scope)
                out[name] = self.eval(v, scope)
            return Record(out)
        if k == "array":
            vals = [_val(self.eval(x, scope)) for x in e[1]]
            return self._array(vals)
        if k == "index":
            return self._index(self.eval(e[1], scope), _val(self.eval(e[2], scope)))
        if k == "slice":
            v = _val(self.eval(e[1], scope))
            a = _val(self.eval(e[2], scope)) if e[2] else lit(1)
            z = _val(self.eval(e[3], scope)) if e[3] else lit(-1)
            if v.kind != "array":
                return fn.substr1(v, a, z)
            n = F.size(v.c)
            lo, hi = (F.when(fn.lng(x) < 0, fn.lng(x) + n + 1).otherwise(fn.lng(x)) for x in (a, z))
            ok = (lo >= 1) & (hi <= n) & (lo <= hi)
            return Val(F.when(ok, F.slice(v.c, lo.cast("int"), (hi - lo + 1).cast("int"))).otherwise(F.slice(v.c, 1, 0)), "array", v.type)
        if k == "lambda":
            return Lambda(e[1], e[2], dict(scope))
        if k == "call":
            return self._call(e[1], e[2], scope)
        raise SyntaxError(f"{k} has no value")

    def _open_map(self, pairs, scope) -> Val:
        """A map with keys that only the data tell."""
        vals = [(_val(self.eval(a, scope)), _val(self.eval(b, scope))) for a, b in pairs]
        kinds = {v.kind for _, v in vals}
        t = {"int": T.LongType(), "float": T.DoubleType()}.get(next(iter(kinds))) if len(kinds) == 1 else None
        m = F.create_map(*[x for a, b in vals for x in (fn.txt(a), b.c if t else fn.txt(b))])
        return Val(m, "map", T.MapType(T.StringType(), t or T.StringType()))

    def _array(self, vals: list[Val]) -> Val:
        kinds = {v.kind for v in vals}
        literal = [v.literal for v in vals] if all(v.literal is not None for v in vals) else None
        if kinds and kinds <= {"int"}:
            return Val(F.array(*[v.c for v in vals]), "array", T.ArrayType(T.LongType()), literal)
        if kinds and kinds <= {"int", "float"}:
            return Val(F.array(*[fn.dbl(v) for v in vals]), "array", T.ArrayType(T.DoubleType()), literal)
        if kinds == {"array"}:
            return Val(F.array(*[v.c for v in vals]), "array", T.ArrayType(vals[0].type), literal)
        return Val(F.array(*[fn.txt(v) for v in vals]) if vals else F.array().cast("array<string>"), "array", T.ArrayType(T.StringType()), literal)

    def _string(self, raw: str) -> Val:
        text = re.sub(r'\\(["ntr])', lambda m: {"n": "\n", "t": "\t", "r": "\r", '"': '"'}[m[1]], raw)
        if self.captures and re.search(r"\\[0-9]", text):
            c, regex = self.captures
            out = [F.coalesce(F.when(c.rlike(regex), F.regexp_extract(c, regex, int(p[1]))), F.lit("")) if re.fullmatch(r"\\[0-9]", p) else F.lit(p) for p in re.split(r"(\\[0-9])", text) if p]
            groups = re.compile(re.sub(r"^\(\?i\)", "", regex)).groups
            out = [F.lit("") if re.fullmatch(r"\\[0-9]", p) and int(p[1]) > groups else o for p, o in zip([p for p in re.split(r"(\\[0-9])", text) if p], out)]
            return Val(F.concat(*out), "any")
        return lit(text)

    def _name(self, name: str, scope: dict):
        if name in scope:
            return scope[name]
        if name in CONTEXT:
            return lit(CONTEXT[name])
        if name == "NR":
            return Val(col(f"{HIDDEN}NR"), "int")
        if name == "FNR":
            return Val(col(f"{HIDDEN}FNR"), "int")
        if name == "NF":
            out = F.lit(0)
            for v in self.fields.values():
                out = out + _val(v).c.isNotNull().cast("int")
            return Val(out.cast("bigint"), "int")
        if name == "FILENAME":
            return Val(col(f"{HIDDEN}FILENAME"), "str")
        if name == "FILENUM":
            return Val(col(f"{HIDDEN}FILENUM"), "int")
        if name == "ENV":
            return Record({k: lit(v) for k, v in os.environ.items()})
        if name in self.funcs:
            params, body = self.funcs[name]
            return Lambda(params, body, {})
        return lit(None)

    def _key(self, e, scope, default=...):
        v = _val(self.eval(e, scope))
        if v.literal is None:
            if default is ...:
                raise NotPlanned("a field's name must be known when the plan is made")
            return default
        return str(v.literal)

    def _index(self, v, i: Val):
        if isinstance(v, Record):
            if i.literal is not None:
                return v.items.get(str(i.literal), lit(None))
            v = v.val()
        if v.kind == "array":
            return self._typed(F.try_element_at(v.c, fn.lng(i).cast("int")), v.type.elementType if isinstance(v.type, T.ArrayType) else None)
        if v.kind == "map":
            if isinstance(v.type, T.StructType):
                if i.literal in v.type.names:
                    return self._typed(v.c.getField(i.literal), v.type[i.literal].dataType)
                return self._typed(F.try_element_at(fn.as_map(v), fn.txt(i)), T.StringType())
            return self._typed(F.try_element_at(v.c, fn.txt(i)), v.type.valueType if isinstance(v.type, T.MapType) else None)
        if v.kind in ("str", "any", "int"):
            return fn.substr1(v, i, i)
        return lit(None)

    @staticmethod
    def _typed(c: Column, t) -> Val:
        return Val(c, fn.kind_of(t) if t is not None else "any", t)

    def _call(self, name: str, args: list, scope: dict):
        if name in ("=~", "!=~"):
            a, p = (_val(self.eval(x, scope)) for x in args)
            if name == "=~":
                self.captures = (fn.txt(a), java_regex(p.literal))
            if isinstance(a.literal, str) and isinstance(p.literal, str):
                return lit(bool(matcher(p.literal).search(a.literal)) == (name == "=~"))
            return call(name, a, p)
        if name in self.funcs:
            params, body = self.funcs[name]
            return self.apply(Lambda(params, body, {}), [self.eval(a, scope) for a in args])
        held = scope.get(name)
        if isinstance(held, Lambda):
            return self.apply(held, [self.eval(a, scope) for a in args])
        with self.behind(name in ("?:", "&&", "||", "^^", "??", "???")):
            vals = [self.eval(a, scope) for a in args]
        if name in ("apply", "select", "reduce", "fold", "sort", "any", "every"):
            with self.behind():
                return self._higher(name, vals)
        if name in ("mapexcept", "mapselect") and isinstance(vals[0], Record):
            names = set(fn._keys_of(tuple(_val(v) for v in vals[1:])))
            return Record({k: v for k, v in vals[0].items.items() if (k in names) == (name == "mapselect")})
        if name in ("mapsum", "mapdiff") and all(isinstance(v, Record) for v in vals):
            out = dict(vals[0].items) if vals else {}
            for v in vals[1:]:
                if name == "mapsum":
                    out |= v.items
                else:
                    out = {k: x for k, x in out.items() if k not in v.items}
            return Record(out)
        if name == "haskey" and isinstance(vals[0], Record) and _val(vals[1]).literal is not None:
            v = vals[0].items.get(str(_val(vals[1]).literal))
            return fn.B(_val(v).c.isNotNull()) if v is not None else lit(False)
        if name == "." and all(isinstance(v, Val) and v.literal is not None for v in vals):
            return lit("".join(str(v.literal) for v in vals))
        if name in ("is_map", "is_not_map", "asserting_map", "typeof") and isinstance(vals[0], Record):
            return {"is_map": lit(True), "is_not_map": lit(False), "asserting_map": vals[0], "typeof": lit("map")}[name]
        if name == "-" and len(vals) == 1 and isinstance(vals[0], Val) and isinstance(vals[0].literal, (int, float)):
            return lit(-vals[0].literal)
        return call(name, *[self.held(_val(v)) for v in vals])

    # -- functions

    def apply(self, f: Lambda, args: list):
        if len(args) != len(f.params):
            raise ValueError(f"a function of {len(f.params)} arguments is called with {len(args)}")
        self.depth += 1
        if self.depth > 40:
            raise NotPlanned("functions that call themselves cannot be worked out when the plan is made")
        try:
            return self.returned(f.body, {**f.scope, **dict(zip(f.params, args))})
        finally:
            self.depth -= 1

    def returned(self, body: list, scope: dict):
        """What a list of statements returns: branches become one conditional value."""
        with self.behind(any(st[0] == "if" for st in body)):
            return self._returned(body, scope)

    def _returned(self, body: list, scope: dict):
        scope = dict(scope)
        for i, st in enumerate(body):
            if st[0] == "return":
                return self.eval(st[1], scope) if st[1] else lit(None)
            if st[0] == "local":
                scope[st[1]] = self.eval(st[2], scope) if st[2] else lit(None)
            elif st[0] == "assign" and st[1][0] == "name":
                scope[st[1][1]] = self._assigned(self.eval(st[1], scope), st[2], st[3], scope)
            elif st[0] == "if":
                rest = body[i + 1 :]
                if not any(_returns(b) for _, b in st[1]) and not _returns(st[2]):
                    self._branch(st, scope)
                    continue
                out = self.returned([*st[2], *rest], scope)
                for c, b in reversed(st[1]):
                    p = _val(self.eval(c, scope))
                    out = fn.ternary(p, _val(self.returned([*b, *rest], scope)), _val(out))
                return out
            else:
                raise NotPlanned(f"{st[0]} within a function cannot be worked out when the plan is made")
        return lit(None)

    def _branch(self, st, scope: dict) -> None:
        """Locals that the arms of an if assign."""
        arms = [(self.eval(c, scope), b) for c, b in st[1]] + [(None, st[2])]
        done = None
        for p, b in arms:
            c = fn.boolean(_val(p)) if p is not None else F.lit(True)
            guard = c if done is None else c & ~done
            for x in b:
                if x[0] == "assign" and x[1][0] == "name":
                    old = scope.get(x[1][1], lit(None))
                    new = self._assigned(old, x[2], x[3], scope)
                    scope[x[1][1]] = fn.ternary(fn.B(guard), _val(new), _val(old))
                elif x[0] != "local":
                    raise NotPlanned(f"{x[0]} within a function cannot be worked out when the plan is made")
            done = c if done is None else done | c

    def _higher(self, name: str, vals: list):
        if name == "sort":
            v = vals[0]
            if len(vals) == 1 or isinstance(vals[1], Val):
                return fn.sort_by_flags(_val(v), vals[1].literal if len(vals) > 1 else "")
            v = _val(v)
            f = vals[1]
            if v.kind != "array":
                raise NotPlanned("sort: maps sort by flags")
            t = v.type.elementType
            order = F.array_sort(v.c, lambda a, b: fn.lng(_val(self.apply(f, [self._typed(a, t), self._typed(b, t)]))).cast("int"))
            return Val(order, "array", v.type)
        if name == "fold":
            v, f, first = _val(vals[0]), vals[1], _val(vals[2])
        else:
            v, f, first = vals[0], vals[1], None
        if isinstance(v, Record):
            return self._over_record(name, v, f, first)
        v = _val(v)
        if v.kind == "array":
            t = v.type.elementType if isinstance(v.type, T.ArrayType) else T.StringType()
            if name == "apply":
                probe = _val(self.apply(f, [self._typed(F.lit(None).cast(t), t)]))
                kind = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}.get(probe.kind, T.StringType())
                return Val(F.transform(v.c, lambda x: _val(self.apply(f, [self._typed(x, t)])).c), "array", T.ArrayType(probe.type or kind))
            if name == "select":
                return Val(F.filter(v.c, lambda x: fn.boolean(_val(self.apply(f, [self._typed(x, t)])))), "array", v.type)
            if name in ("any", "every"):
                g = F.exists if name == "any" else F.forall
                return fn.B(g(v.c, lambda x: fn.boolean(_val(self.apply(f, [self._typed(x, t)])))))
            start = F.element_at(v.c, 1) if first is None else first.c
            st = t if first is None else {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "any": T.StringType()}.get(first.kind, t)
            arr = F.slice(v.c, F.lit(2), F.greatest(F.size(v.c) - 1, F.lit(0))) if first is None else v.c
            out = F.aggregate(arr, start.cast(st), lambda acc, x: _val(self.apply(f, [self._typed(acc, st), self._typed(x, t)])).c.cast(st))
            return self._typed(F.when(F.size(v.c) > 0, out) if first is None else out, st)
        m, t = fn.as_map(v), (v.type.valueType if isinstance(v.type, T.MapType) else T.StringType())
        key = lambda k: Val(k, "str")
        if name == "select":
            return Val(F.map_filter(m, lambda k, x: fn.boolean(_val(self.apply(f, [key(k), self._typed(x, t)])))), "map", T.MapType(T.StringType(), t))
        if name in ("any", "every"):
            g = F.exists if name == "any" else F.forall
            return fn.B(g(F.map_entries(m), lambda e: fn.boolean(_val(self.apply(f, [key(e["key"]), self._typed(e["value"], t)])))))
        if name == "apply":
            return Val(F.map_from_entries(F.transform(F.map_entries(m), lambda e: self._entry(f, [key(e["key"]), self._typed(e["value"], t)]))), "map", T.MapType(T.StringType(), t))
        raise NotPlanned(f"{name} over a map whose keys only the data tell")

    def _entry(self, f: Lambda, args: list) -> Column:
        got = self.apply(f, args)
        if isinstance(got, Record):
            (k, v), = got.items.items()
            return F.struct(F.lit(k).alias("key"), _val(v).c.alias("value"))
        return F.element_at(F.map_entries(got.c), 1)

    def _over_record(self, name: str, r: Record, f: Lambda, first):
        pairs = [(lit(k), v) for k, v in r.items.items()]
        if name == "apply":
            out: dict = {}
            for k, v in pairs:
                got = self.apply(f, [k, v])
                if not isinstance(got, Record):
                    raise NotPlanned("apply over a map must return a map of one pair")
                out |= got.items
            return Record(out)
        if name == "select":
            return Record({k.literal: Val(F.when(fn.boolean(_val(self.apply(f, [k, v]))), _val(v).c), _val(v).kind, _val(v).type) for k, v in pairs})
        if name in ("any", "every"):
            out = lit(name == "every")
            for k, v in pairs:
                out = call("||" if name == "any" else "&&", out, _val(self.apply(f, [k, v])))
            return out
        acc_k, acc_v = (pairs[0] if first is None else (lit("acc"), next(iter(first.items.values())) if isinstance(first, Record) else first))
        for k, v in pairs[1:] if first is None else pairs:
            got = self.apply(f, [acc_k, acc_v, k, v])
            (name_, acc_v), = got.items.items()
            acc_k = lit(name_)
        return Record({acc_k.literal: acc_v})

    # -- statements

    def run(self, program: list) -> None:
        for st in program:
            if st[0] == "func":
                self.funcs[st[1]] = (st[2], st[3])
            elif st[0] == "subr":
                self.subrs[st[1]] = (st[2], st[3])
        for st in program:
            if st[0] == "begin":
                self.statements(st[1], {}, None)
        self.statements([st for st in program if st[0] not in ("func", "subr", "begin", "end")], {}, None)

    def statements(self, body: list, scope: dict, guard: Column | None) -> None:
        with self.behind(guard is not None):
            for st in body:
                self.statement(st, scope, guard)

    def _assigned(self, old, op: str, e, scope: dict):
        new = self.eval(e, scope)
        if op == "=":
            return new
        return call(op[:-1], _val(old), _val(new))

    def _guarded(self, old, new, guard: Column | None, skip_absent: bool):
        """The new value where the guard holds and (for fields) the value is not absent."""
        if isinstance(new, (Record, Lambda)) or isinstance(old, (Record, Lambda)):
            if guard is None:
                return new
            new, old = _val(new), _val(old)
        if new.kind == "absent" and skip_absent:
            return old
        if guard is None and (not skip_absent or old.kind == "absent" or new.literal is not None):
            return new
        if old.kind == new.kind or old.kind == "absent" or guard is not None or {old.kind, new.kind} <= {"str", "any"}:
            x, y, k = fn.merged(new, old)
            p = new.c.isNotNull() if skip_absent else F.lit(True)
            p = p if guard is None else guard & p
            return Val(F.when(p, x).otherwise(y), k, new.type if new.kind == k else old.type)
        return new

    def statement(self, st, scope: dict, guard: Column | None) -> None:
        k = st[0]
        if k == "assign":
            self._assign(st, scope, guard)
        elif k == "local":
            scope[st[1]] = self.held(self.eval(st[2], scope)) if st[2] else lit(None)
        elif k == "bare":
            p = fn.boolean(_val(self.eval(st[1], scope)))
            self.bare = p if guard is None else F.when(guard, p).otherwise(self.bare if self.bare is not None else F.lit(None))
        elif k == "filter":
            p = fn.boolean(_val(self.eval(st[1], scope)))
            old = self.keep if self.keep is not None else F.lit(True)
            self.keep = p if guard is None else F.when(guard, p).otherwise(old)
        elif k == "block":
            v = _val(self.eval(st[1], scope))
            if v.literal is False:
                return
            p = F.coalesce(fn.boolean(v), F.lit(False))
            own = guard if v.literal is True else p if guard is None else guard & p
            self._scoped(st[2], scope, own)
        elif k == "if":
            done = None
            for c, body in [*st[1], (None, st[2])]:
                v = _val(self.eval(c, scope)) if c is not None else lit(True)
                if v.literal is False:
                    continue
                p = F.coalesce(fn.boolean(v), F.lit(False))
                own = p if done is None else p & ~done
                if v.literal is True and done is None:
                    self._scoped(body, scope, guard)
                    break
                self._scoped(body, scope, own if guard is None else guard & own)
                if v.literal is True:
                    break
                done = p if done is None else done | p
        elif k == "unset":
            for target in st[1]:
                self._unset(target, scope, guard)
        elif k in ("for1", "for2"):
            v = self.eval(st[2] if k == "for1" else st[3], scope)
            body = st[-1]
            if isinstance(v, Record):
                for name, x in list(v.items.items()):
                    inner = {**scope, st[1]: lit(name)} | ({st[2]: x} if k == "for2" else {})
                    self._inner(body, scope, inner, guard, {st[1], st[2] if k == "for2" else st[1]})
            elif isinstance(v, Val) and isinstance(v.literal, list):
                for i, x in enumerate(v.literal):
                    inner = {**scope, st[1]: lit(x)} if k == "for1" else {**scope, st[1]: lit(i + 1), st[2]: lit(x)}
                    self._inner(body, scope, inner, guard, {st[1], st[2] if k == "for2" else st[1]})
            else:
                raise NotPlanned("a loop over a collection that only the data tell: use apply, select, fold")
        elif k == "form":
            self._nested(st[2], self.eval(st[3], scope), scope, {**scope}, guard, st)
        elif k == "beside":
            self._beside(st, scope, guard)
        elif k == "forc":
            self._counted(st, scope, guard)
        elif k == "call":
            if st[1] not in self.subrs:
                raise ValueError(f"no subroutine {st[1]}")
            params, body = self.subrs[st[1]]
            self.statements(body, dict(zip(params, [self.eval(a, scope) for a in st[2]])), guard)
        elif k == "emit":
            for thing in st[2]:
                r = self.eval(thing, scope)
                if not isinstance(r, Record):
                    raise NotPlanned("emit of a map that only the data tell")
                self.emitted.append((guard, r))
        else:
            raise NotPlanned(f"{k} cannot be worked out when the plan is made")

    def _nested(self, names: list[str], v, scope: dict, inner: dict, guard, st) -> None:
        """A loop over the keys of maps within maps."""
        if not isinstance(v, Record):
            raise NotPlanned("a loop over maps that only the data tell")
        for name, x in list(v.items.items()):
            own = {**inner, names[0]: lit(name)}
            if len(names) > 1:
                self._nested(names[1:], x, scope, own, guard, st)
            else:
                self._inner(st[4], scope, {**own, st[1]: x}, guard, {*st[2], st[1]})

    def _beside(self, st, scope: dict, guard) -> None:
        """What is written beside the records: texts as they are, maps as lines of JSON."""
        _, how, (op, name), things = st
        if how in ("dump", "edump") and not things:
            raise NotPlanned("a dump of what is carried from record to record")
        to = _val(self.eval(name, scope))
        texts = []
        for e in things:
            v = self.eval(e, scope)
            if how in ("tee", "emit", "dump", "edump") and isinstance(v, Record):
                cells = [F.when(x.c.isNotNull(), F.concat(F.lit(json.dumps(n) + ": "), _json_cell(x))) for n, x in ((n, _val(x)) for n, x in v.items.items())]
                texts.append(F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}")))
            else:
                texts.append(F.coalesce(fn.txt(_val(v)), F.lit("")))
        text = F.concat_ws(" ", *texts) if texts else F.lit("")
        self.beside.append((to, op == ">>", guard, text if how in ("printn", "eprintn") else F.concat(text, F.lit("\n"))))

    def _scoped(self, body, scope: dict, guard) -> None:
        """A block: its locals are its own, but it may assign those outside."""
        inner = dict(scope)
        self._inner(body, scope, inner, guard, {st[1] for st in body if st[0] == "local"})

    def _inner(self, body, outer: dict, inner: dict, guard, own: set) -> None:
        self.statements(body, inner, guard)
        for name in outer:
            if name not in own and inner.get(name) is not outer[name]:
                outer[name] = inner[name]

    def _counted(self, st, scope: dict, guard) -> None:
        """A C-style loop whose counter is known when the plan is made."""
        inner = dict(scope)
        self.statements(st[1], inner, guard)
        for turn in range(1001):
            ok = _literal_test(st[2], inner) if st[2] else True
            if ok is None:
                raise NotPlanned("a loop whose end only the data tell")
            if not ok:
                break
            if turn == 1000:
                raise NotPlanned("a loop of more than 1000 turns")
            self._inner(st[4], scope, inner, guard, set(inner) - set(scope))
            for step in st[3]:
                _literal_step(step, inner)

    def _assign(self, st, scope: dict, guard) -> None:
        _, target, op, e = st
        k = target[0]
        if k in ("field", "fieldx", "posvalue"):
            if k == "field":
                name = target[1]
            elif k == "fieldx":
                name = self._key(target[1], scope)
            else:
                at = _val(self.eval(target[1], scope)).literal
                names = list(self.fields)
                if not 1 <= at <= len(names):
                    return
                name = names[at - 1]
            old = self.fields.get(name, lit(None))
            self.fields[name] = self.held(self._guarded(old, self._assigned(old, op, e, scope), guard, True))
            if isinstance(self.fields[name], Val) and self.fields[name].kind == "absent":
                del self.fields[name]
        elif k == "posname":
            at = _val(self.eval(target[1], scope)).literal
            names, new = list(self.fields), self._key(e, scope)
            if 1 <= at <= len(names):
                self.fields = {new if i == at - 1 else n: v for i, (n, v) in enumerate(self.fields.items()) if i == at - 1 or n != new}
        elif k == "record":
            r = self.eval(e, scope)
            if not isinstance(r, Record):
                raise NotPlanned("$* takes a map whose keys are known when the plan is made")
            if guard is None:
                self.fields = dict(r.items)
            else:
                for name in list(dict.fromkeys([*self.fields, *r.items])):
                    old = self.fields.get(name, lit(None))
                    new = r.items.get(name, lit(None))
                    x, y, kk = fn.merged(_val(new), _val(old))
                    self.fields[name] = Val(F.when(guard, x).otherwise(y), kk)
        elif k == "name":
            old = scope.get(target[1], lit(None))
            scope[target[1]] = self.held(self._guarded(old, self._assigned(old, op, e, scope), guard, False))
        elif k == "index":
            self._assign_index(target, op, e, scope, guard)
        elif k == "oos":
            old = self.vars.get(target[1], lit(None))
            new = self._assigned(old, op, e, scope)
            if guard is not None or target[1] in self.early:
                raise NotPlanned(f"@{target[1]} is carried from record to record")
            self.vars[target[1]] = new
        else:
            raise SyntaxError(f"nothing can be assigned to {k}")

    def _assign_index(self, target, op: str, e, scope: dict, guard) -> None:
        """``$m["k"] = ...`` and ``m["k"] = ...`` for maps known when the plan is made."""
        base, keys = target, []
        while base[0] == "index":
            keys.insert(0, self._key(base[2], scope))
            base = base[1]
        if base[0] == "record":
            self._assign(("assign", ("field", keys[0]), op, e), scope, guard)
            return
        holder = self.fields if base[0] == "field" else scope if base[0] == "name" else self.vars
        held = holder.get(base[1], Record({}))
        if isinstance(held, Val):
            held = Record({})
        held = Record(dict(held.items))
        node = held
        for key in keys[:-1]:
            nxt = node.items.get(key)
            nxt = Record(dict(nxt.items)) if isinstance(nxt, Record) else Record({})
            node.items[key] = nxt
            node = nxt
        old = node.items.get(keys[-1], lit(None))
        node.items[keys[-1]] = self._guarded(old, self._assigned(old, op, e, scope), guard, True)
        holder[base[1]] = held

    def _unset(self, target, scope: dict, guard) -> None:
        k = target[0]
        if k == "record":
            names = list(self.fields)
        elif k in ("field", "fieldx"):
            names = [target[1] if k == "field" else self._key(target[1], scope)]
        elif k == "index" and target[1][0] == "record":
            names = [self._key(target[2], scope)]
        elif k == "name":
            scope.pop(target[1], None)
            return
        elif k == "oos":
            self.vars.pop(target[1], None)
            return
        else:
            raise NotPlanned("unset of a part of a map")
        for n in names:
            if n in self.fields:
                if guard is None:
                    del self.fields[n]
                else:
                    v = _val(self.fields[n])
                    self.fields[n] = Val(F.when(~guard, v.c), v.kind, v.type)


def _returns(body: list) -> bool:
    return any(st[0] == "return" or st[0] == "if" and (any(_returns(b) for _, b in st[1]) or _returns(st[2])) for st in body)


def _number(e, scope: dict):
    if e[0] == "lit":
        return e[1]
    if e[0] == "name" and isinstance(scope.get(e[1]), Val):
        return scope[e[1]].literal
    if e[0] == "call" and e[1] in ("+", "-", "*", "<", "<=", ">", ">=", "==", "!="):
        a = [_number(x, scope) for x in e[2]]
        if any(x is None for x in a):
            return None
        if len(a) == 1:
            return -a[0] if e[1] == "-" else a[0]
        return {
            "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
            "==": lambda x, y: x == y, "!=": lambda x, y: x != y,
        }[e[1]](*a)
    return None


def _literal_test(body, scope: dict):
    return _number(body[-1][1], scope) if body and body[-1][0] == "bare" else None


def _literal_step(st, scope: dict) -> None:
    if st[0] != "assign" or st[1][0] != "name":
        raise NotPlanned("a loop whose step only the data tell")
    name = st[1][1]
    e = st[3] if st[2] == "=" else ("call", st[2][:-1], [("name", name), st[3]])
    v = _number(e, scope)
    if v is None:
        raise NotPlanned("a loop whose step only the data tell")
    scope[name] = lit(v)


def _uses(program, name: str) -> bool:
    if isinstance(program, (list, tuple)):
        return tuple(program[:2]) == ("name", name) if isinstance(program, tuple) and len(program) == 2 and program[0] == "name" else any(_uses(x, name) for x in program)
    return False


def _with_context(s: Stream, program) -> Stream:
    """Hidden columns for what the program asks of a record's place."""
    new = {}
    if _uses(program, "NR"):
        from .ordered import running

        s = s.with_df(running(s, {}, number=f"{HIDDEN}NR").df)
    if _uses(program, "FILENAME"):
        new[f"{HIDDEN}FILENAME"] = F.input_file_name()
    if _uses(program, "FNR"):
        from pyspark.sql import Window

        new[f"{HIDDEN}FNR"] = F.row_number().over(Window.partitionBy(F.input_file_name()).orderBy(*s.by())).cast("bigint")
    if _uses(program, "FILENUM"):
        from pyspark.sql import Window

        new[f"{HIDDEN}FILENUM"] = F.dense_rank().over(Window.orderBy(F.input_file_name())).cast("bigint")
    return s.with_df(s.df.withColumns(new)) if new else s


def _shown(v) -> Column:
    v = _val(v)
    return v.c if v.kind != "absent" else F.lit(None).cast("string")


def put(s: Stream, text: str, quiet: bool = False, inverted: bool = False, presets: dict | None = None, folder: str = "redirects") -> Stream:
    """Run a program on every record: as a plan where one can express it, else by the interpreter, in one task."""
    program = Parser(text).program()
    try:
        return _planned(s, program, quiet, inverted, presets, folder)
    except NotPlanned as why:
        from .interpreter import interpreted

        logging.getLogger(__name__).warning("this program runs in one task: %s", why)
        return interpreted(s, program, quiet, inverted, presets, folder)


def _planned(s: Stream, program, quiet, inverted, presets, folder: str = "redirects") -> Stream:
    from .accumulate import accumulates, accumulated

    if accumulates(program):
        if any(st[0] == "beside" for st in _every(program)):
            raise NotPlanned("what is written beside records that are added up")
        out = accumulated(s, program, presets)
        if quiet:
            return out
        from ..operators.joins import concat

        main = [st for st in program if not accumulates([st]) and st[0] not in ("begin", "end")]
        first = _put(s, main, False, inverted, presets, folder) if main else s
        return concat(first, out)
    if any(st[0] == "end" for st in program):
        raise NotPlanned("an end block without accumulated variables")
    return _put(s, program, quiet, inverted, presets, folder)


def _every(body):
    """All statements of a program, those within blocks too."""
    for st in body:
        if isinstance(st, tuple):
            yield st
            for x in st[1:]:
                if isinstance(x, list):
                    for y in x:
                        yield from _every([y]) if isinstance(y, tuple) and y and isinstance(y[0], str) else _every(y[1]) if isinstance(y, tuple) and len(y) == 2 and isinstance(y[1], list) else ()


def _put(s: Stream, program, quiet, inverted, presets, folder: str = "redirects") -> Stream:
    s = _with_context(s, program)
    c = Compiler(s, presets)
    c.hoists = True
    c.run(program)
    if c.beside:
        _written(s, c, folder)
    if c.emitted:
        return _emitted(s, c, quiet)
    keep = c.keep
    if quiet:
        keep = F.lit(False)
    # the projection first, the filter on what it saw: one pass, and Catalyst moves the filter down
    df = c.source().withColumn("_keep", keep) if keep is not None else c.source()
    order = [x for x in s.hidden if x in {n for n, _ in s.order}]
    df = df.select(*[_shown(v).alias(n) for n, v in c.fields.items()], *map(col, order), *(["_keep"] if keep is not None else []))
    if keep is not None:
        df = df.where(~F.col("_keep") if inverted else F.col("_keep")).drop("_keep")
    return Stream(df, s.order)


def _json_cell(v: Val) -> Column:
    """A value as JSON; texts that write numbers are numbers."""
    return F.when(fn.text_double(v.c).isNotNull(), v.c).otherwise(fn.json_text(v).c) if v.kind == "any" else fn.json_text(v).c


def _written(s: Stream, c: Compiler, folder: str) -> None:
    """Deliver what the program writes beside the records."""
    from .sides import deliver

    for append in (False, True):
        parts = [(to, guard, text) for to, more, guard, text in c.beside if more == append]
        if not parts:
            continue
        rows = F.array(*[F.when(g if g is not None else F.lit(True), F.struct(F.lit(i).alias("_i"), fn.txt(to).alias("to"), text.alias("value"))) for i, (to, g, text) in enumerate(parts)])
        df = c.source().select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("_r"), *[col(x) for x, _ in s.order])
        df = df.select("_r.to", "_r.value", *[col(x) for x, _ in s.order], F.col("_r._i").alias(f"{HIDDEN}emit"))
        named = [to.literal for to, _, _ in parts]
        deliver(Stream(df, (*s.order, (f"{HIDDEN}emit", True))), None if any(n is None for n in named) else named, folder, append)


def _emitted(s: Stream, c: Compiler, quiet: bool) -> Stream:
    """Records that the program emits for each record, and the record itself."""
    records = [(g, r.items) for g, r in c.emitted]
    if not quiet:
        records.append((c.keep, c.fields))
    names = list(dict.fromkeys(n for _, r in records for n in r))
    kinds = {n: {_val(r[n]).kind for _, r in records if n in r} - {"absent"} for n in names}
    cast = {n: {"int": "bigint", "float": "double", "bool": "boolean"}.get(next(iter(k))) if len(k) == 1 else "double" if k and k <= {"int", "float"} else None for n, k in kinds.items()}

    def cell(r, n):
        if n not in r:
            return F.lit(None).cast(cast[n] or "string")
        v = _val(r[n])
        return v.c.cast(cast[n]) if cast[n] else fn.txt(v)

    rows = F.array(*[F.when(g if g is not None else F.lit(True), F.struct(F.lit(i).alias("_i"), *[cell(r, n).alias(n) for n in names])) for i, (g, r) in enumerate(records)])
    order = [x for x, _ in s.order]
    df = c.source().select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("_r"), *map(col, order))
    df = df.select(*[F.col("_r").getField(n).alias(n) for n in names], *map(col, order), F.col("_r._i").alias(f"{HIDDEN}emit"))
    return Stream(df, (*s.order, (f"{HIDDEN}emit", True)))


def where(s: Stream, text: str, inverted: bool = False, presets: dict | None = None) -> Stream:
    """Records for which the last bare boolean (or filter statement) is true; an absent one drops the record."""
    program = Parser(text).program()
    s2 = _with_context(s, program)
    c = Compiler(s2, presets)
    c.hoists = True
    c.run(program)
    p = c.keep if c.keep is not None else c.bare
    if p is None:
        return s
    df = c.source().where(~p if inverted else p)
    return Stream(df.select(*map(col, s.df.columns)), s.order)
