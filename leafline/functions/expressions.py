"""The expression language: a lexer, a Pratt parser and a compiler to Columns.

Values are dynamic. A compiled value knows its kind: "bool", "num", "str", "nil", "fv" (a VALUE struct, null where the name is
missing), "list" (an array of kind), "row" (a struct of path, type and a map of VALUEs). Comparisons go through the representation,
so that values of different types are unequal rather than an error. Decisions where the language leaves room: == and != are total
(missing is nil); ordering anything but two numbers or two strings is false; a filter takes only true.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import byte_length, slugify, trim_unicode

TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)"""
    r"""|(?P<op>\?\?|\?\.|&&|\|\||==|!=|<=|>=|\*\*|\.\.|[-+*/%<>!?:.,()\[\]{}#|=;]))"""
)
BINARY = {
    "??": 5, "||": 10, "or": 10, "&&": 15, "and": 15, "==": 20, "!=": 20, "<": 20, ">": 20, "<=": 20, ">=": 20, "in": 20, "not in": 20,
    "contains": 20, "startsWith": 20, "endsWith": 20, "matches": 20, "+": 30, "-": 30, "*": 60, "/": 60, "%": 60, "**": 100,
}


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple = ()


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {source[at:].strip()[:1]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    def __init__(self, source: str):
        self.tokens, self.at = tokens(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, text: str | None = None) -> tuple[str, str]:
        t = self.tokens[self.at]
        if text is not None and t[1] != text:
            raise ExpressionError(f"expected {text!r}, found {t[1] or 'the end'!r}")
        self.at += 1
        return t

    def parse(self) -> Node:
        node = self.ternary()
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return node

    def ternary(self) -> Node:
        cond = self.binary(0)
        if self.peek() == ("op", "?"):
            self.take()
            yes = self.ternary()
            self.take(":")
            return Node("if", None, (cond, yes, self.ternary()))
        return cond

    def operator(self) -> str | None:
        kind, text = self.peek()
        if kind not in ("op", "name"):
            return None
        if text == "not" and self.tokens[self.at + 1][1] == "in":
            return "not in"
        return text if text in BINARY else None

    def binary(self, least: int) -> Node:
        left = self.unary()
        while (op := self.operator()) and BINARY[op] >= least + (op != "**"):
            self.take()
            if op == "not in":
                self.take()
            right = self.binary(BINARY[op] - (op == "**"))
            left = Node("op", {"and": "&&", "or": "||"}.get(op, op), (left, right))
        return left

    def unary(self) -> Node:
        kind, text = self.peek()
        if text in ("!", "-", "+") and kind == "op" or (kind, text) == ("name", "not"):
            self.take()
            return Node("unary", {"not": "!"}.get(text, text), (self.binary(50 if text in ("!", "not") else 90),))
        return self.postfix(self.primary())

    def postfix(self, node: Node) -> Node:
        while True:
            kind, text = self.peek()
            if kind != "op" or text not in (".", "?.", "["):
                return node
            self.take()
            if text == "[":
                node = Node("index", None, (node, self.ternary()))
                self.take("]")
            else:
                name = self.take()[1]
                node = Node("call", name, (node, *self.arguments())) if self.peek() == ("op", "(") else Node("member", name, (node,))

    def arguments(self) -> list[Node]:
        self.take("(")
        out = []
        while self.peek() != ("op", ")"):
            out.append(self.closure() if self.peek() == ("op", "{") else self.ternary())
            if self.peek() == ("op", ","):
                self.take()
        self.take(")")
        return out

    def closure(self) -> Node:
        self.take("{")
        node = Node("closure", None, (self.ternary(),))
        self.take("}")
        return node

    def primary(self) -> Node:
        kind, text = self.take()
        if kind == "num":
            return Node("num", float(text))
        if kind == "str":
            return Node("str", text[1:-1] if text[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1]))
        if kind == "name":
            if text in ("true", "false"):
                return Node("bool", text == "true")
            if text in ("nil", "null"):
                return Node("nil")
            return Node("call", text, tuple(self.arguments())) if self.peek() == ("op", "(") else Node("name", text)
        if text == "(":
            node = self.ternary()
            self.take(")")
            return node
        if text == "[":
            out = []
            while self.peek() != ("op", "]"):
                out.append(self.ternary())
                if self.peek() == ("op", ","):
                    self.take()
            self.take("]")
            return Node("array", None, tuple(out))
        if text == "#":
            return Node("element")
        if text == ".":
            return Node("member", self.take()[1], (Node("element"),))
        raise ExpressionError(f"unexpected {text or 'the end'!r}")


def parse(source: str) -> Node:
    return Parser(source).parse()


def free_names(node: Node) -> set[str]:
    """Names that the expression reads from its record."""
    own = {node.value} if node.kind == "name" else set()
    return own.union(*(free_names(a) for a in node.args)) if node.args else own


@dataclass
class Val:
    """A compiled value."""

    kind: str
    col: Column | None = None
    of: str = ""  # kind of a list's elements
    literal: object = None


@dataclass
class Scope:
    """What names mean: a function from a name to a Val; the element of the closure; whether custom functions may be called."""

    resolve: Callable[[str], Val]
    element: Val | None = None
    custom: bool = False
    extra: dict[str, Callable] = field(default_factory=dict)


def is_nil(v: Val) -> Column:
    if v.kind == "nil":
        return F.lit(True)
    if v.kind == "fv":
        return v.col.isNull() | (v.col["repr"] == "null")
    return v.col.isNull()


def as_bool(v: Val) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind == "fv":
        return F.coalesce((v.col["repr"] == "boolean") & v.col["bool"], F.lit(False))
    return F.lit(False)


def as_num(v: Val) -> Column:
    """The number, null where it isn't one."""
    if v.kind == "num":
        return v.col
    return F.when(v.col["repr"].isin("integer", "number"), v.col["num"]) if v.kind == "fv" else F.lit(None).cast("double")


def as_str(v: Val) -> Column:
    if v.kind == "str":
        return v.col
    return F.when(v.col["repr"] == "string", v.col["text"]) if v.kind == "fv" else F.lit(None).cast("string")


def equal(a: Val, b: Val) -> Column:
    if "nil" in (a.kind, b.kind):
        return is_nil(a) & is_nil(b)
    kinds = {a.kind, b.kind}
    if kinds == {"fv"}:
        same = F.when(a.col["repr"].isin("integer", "number") & b.col["repr"].isin("integer", "number"), a.col["num"] == b.col["num"]).otherwise((a.col["repr"] == b.col["repr"]) & (a.col["text"] == b.col["text"]))
        return F.when(is_nil(a) | is_nil(b), is_nil(a) & is_nil(b)).otherwise(F.coalesce(same, F.lit(False)))
    for kind, cast in (("num", as_num), ("str", as_str)):
        if kind in kinds:
            return F.coalesce(cast(a) == cast(b), F.lit(False)) if kinds <= {kind, "fv"} else F.lit(False)
    if "bool" in kinds:
        real = [F.lit(True) if v.kind == "bool" else F.coalesce(v.col["repr"] == "boolean", F.lit(False)) for v in (a, b)]
        return real[0] & real[1] & (as_bool(a) == as_bool(b)) if kinds <= {"bool", "fv"} else F.lit(False)
    return F.lit(False)


def elements(v: Val) -> tuple[Column, str]:
    """The array of a list-like value (empty for what isn't one) and the kind of its elements."""
    if v.kind == "list":
        return v.col, v.of
    if v.kind == "fv":
        return F.coalesce(v.col["items"], F.array().cast("array<struct<repr:string,text:string,num:double,bool:boolean>>")), "fv"
    raise ExpressionError("a list is needed")


def row_field(c: Column, name: str) -> Val:
    if name in ("path", "type"):
        own = F.struct(F.lit("string").alias("repr"), c[name].alias("text"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("array<struct<repr:string,text:string,num:double,bool:boolean>>").alias("items"), F.lit(None).cast("string").alias("json"))
        return Val("fv", own)
    return Val("fv", F.try_element_at(c["fm"], F.lit(name)))


class Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    def run(self, n: Node) -> Val:
        return getattr(self, f"on_{n.kind}")(n)

    def on_num(self, n):
        return Val("num", F.lit(n.value), literal=n.value)

    def on_str(self, n):
        return Val("str", F.lit(n.value), literal=n.value)

    def on_bool(self, n):
        return Val("bool", F.lit(n.value), literal=n.value)

    def on_nil(self, n):
        return Val("nil")

    def on_name(self, n):
        return self.scope.resolve(n.value)

    def on_element(self, n):
        if self.scope.element is None:
            raise ExpressionError("# outside a closure")
        return self.scope.element

    def on_member(self, n):
        return self.member(self.run(n.args[0]), n.value)

    def member(self, v: Val, name: str) -> Val:
        if v.kind == "row":
            return row_field(v.col, name)
        if v.kind == "map":
            return Val("str", F.try_element_at(v.col, F.lit(name)))
        raise ExpressionError(f"no member {name!r}")

    def on_index(self, n):
        v = self.run(n.args[0])
        if v.kind in ("map", "row") and n.args[1].kind == "str":
            return self.member(v, n.args[1].value)
        at = as_num(self.run(n.args[1])).cast("int")
        arr, of = elements(v)
        return Val(of, F.get(arr, F.when(at < 0, F.size(arr) + at).otherwise(at)))

    def on_array(self, n):
        vals = [self.run(a) for a in n.args]
        kinds = {v.kind for v in vals}
        if len(kinds) > 1:
            return Val("tuple", literal=vals)
        kind = kinds.pop() if kinds else "str"
        return Val("list", F.array(*[v.col for v in vals]) if vals else F.array().cast("array<string>"), of=kind, literal=vals)

    def on_if(self, n):
        cond, yes, no = as_bool(self.run(n.args[0])), self.run(n.args[1]), self.run(n.args[2])
        if yes.kind == "nil" or no.kind == "nil":
            some, col = (no, F.when(~cond, no.col)) if yes.kind == "nil" else (yes, F.when(cond, yes.col))
            return Val("nil") if some.kind == "nil" else Val(some.kind, col, of=some.of)
        if yes.kind != no.kind:
            return Val("fv", F.when(cond, self.boxed(yes)).otherwise(self.boxed(no)))
        return Val(yes.kind, F.when(cond, yes.col).otherwise(no.col), of=yes.of)

    @staticmethod
    def boxed(v: Val) -> Column:
        from .values import value

        return v.col if v.kind == "fv" else value({"num": "double", "bool": "boolean", "str": "string"}[v.kind], v.col)

    def on_unary(self, n):
        v = self.run(n.args[0])
        return Val("bool", ~as_bool(v)) if n.value == "!" else Val("num", -as_num(v) if n.value == "-" else as_num(v))

    def on_op(self, n):
        op = n.value
        if op == "??":
            a, b = (self.run(x) for x in n.args)
            if a.kind == "nil":
                return b
            return a if b.kind == "nil" else Val("fv", F.when(is_nil(a), self.boxed(b)).otherwise(self.boxed(a)))
        a, b = (self.run(x) for x in n.args)
        if op in ("&&", "||"):
            return Val("bool", as_bool(a) & as_bool(b) if op == "&&" else as_bool(a) | as_bool(b))
        if op in ("==", "!="):
            return Val("bool", equal(a, b) if op == "==" else ~equal(a, b))
        if op in ("in", "not in"):
            found = self.member_of(a, b)
            return Val("bool", found if op == "in" else ~found)
        if op in ("<", "<=", ">", ">="):
            less = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
            return Val("bool", F.coalesce(less(as_num(a), as_num(b)), less(as_str(a), as_str(b)), F.lit(False)))
        if op == "contains":
            own = F.coalesce(F.contains(as_str(a), as_str(b)), F.lit(False))
            return Val("bool", own | self.member_of(b, a) if a.kind in ("fv", "list") else own)
        if op in ("startsWith", "endsWith"):
            return Val("bool", F.coalesce((F.startswith if op == "startsWith" else F.endswith)(as_str(a), as_str(b)), F.lit(False)))
        if op == "matches":
            if not isinstance(b.literal, str):
                raise ExpressionError("matches needs a literal pattern")
            return Val("bool", F.coalesce(as_str(a).rlike(b.literal), F.lit(False)))
        if op == "+":
            if "str" in (a.kind, b.kind):
                return Val("str", F.concat(as_str(a), as_str(b)))
            if a.kind == b.kind == "fv":
                return Val("fv", F.coalesce(F.when(as_num(a).isNotNull(), self.boxed(Val("num", as_num(a) + as_num(b)))), self.boxed(Val("str", F.concat(as_str(a), as_str(b))))))
        x, y = as_num(a), as_num(b)
        return Val("num", {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y), "%": lambda: F.when(y != 0, x % y), "**": lambda: F.pow(x, y)}[op]())

    def member_of(self, a: Val, b: Val) -> Column:
        if b.kind in ("tuple",) or (b.kind == "list" and b.literal is not None):
            out = F.lit(False)
            for v in b.literal:
                out = out | equal(a, v)
            return out
        if b.kind == "map":
            return F.coalesce(F.map_contains_key(b.col, as_str(a)), F.lit(False))
        arr, of = elements(b)
        return F.exists(arr, lambda x: equal(a, Val(of, x)))

    # ---- calls

    def closure(self, n: Node, of: str) -> Callable[[Column], Val]:
        body = n.args[0] if n.kind == "closure" else n
        return lambda x: Compiler(Scope(self.scope.resolve, Val(of, x), self.scope.custom, self.scope.extra)).run(body)

    def on_call(self, n):
        name, args = n.value, n.args
        if name in self.scope.extra:
            return self.scope.extra[name](self, args)
        if name in ("all", "any", "none", "one", "filter", "map", "count", "find", "sum") and args and not (name in ("sum", "count") and len(args) == 1):
            arr, of = elements(self.run(args[0]))
            f = self.closure(args[1], of)
            hit = lambda x: as_bool(f(x))
            if name in ("all", "any", "none"):
                return Val("bool", {"all": F.forall(arr, hit), "any": F.exists(arr, hit), "none": ~F.exists(arr, hit)}[name])
            if name == "map":
                probe = []
                out = F.transform(arr, lambda x: (probe.append(f(x)), probe[-1].col)[1])
                return Val("list", out, of=probe[0].kind)
            if name == "sum":
                return Val("num", F.aggregate(F.transform(arr, lambda x: F.coalesce(as_num(f(x)), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x))
            kept = F.filter(arr, hit)
            if name == "find":
                return Val(of, F.get(kept, F.lit(0)))
            if name == "one":
                return Val("bool", F.size(kept) == 1)
            return Val("list", kept, of=of) if name == "filter" else Val("num", F.size(kept).cast("double"))
        vals = [self.run(a) for a in args]
        if name == "len":
            v = vals[0]
            if v.kind in ("list",):
                return Val("num", F.size(v.col).cast("double"))
            if v.kind == "str":
                return Val("num", F.length(v.col).cast("double"))
            return Val("num", F.when(v.col["repr"] == "sequence", F.size(v.col["items"])).when(v.col["repr"] == "string", F.length(v.col["text"])).cast("double"))
        texts = {"lower": F.lower, "upper": F.upper, "trim": trim_unicode, "slugify": slugify}
        if name in texts:
            if vals[0].kind in ("num", "bool"):
                raise ExpressionError(f"{name} needs a string")
            return Val("str", texts[name](as_str(vals[0])))
        if name == "strlen":
            return Val("num", byte_length(as_str(vals[0])).cast("double"))
        if name == "concat":
            parts = []
            for v in vals:
                if v.kind == "fv":
                    ok = v.col["repr"].isin("string", "integer", "boolean")
                    parts.append(F.when(is_nil(v), F.lit("")).when(ok, v.col["text"]))
                else:
                    parts.append(F.lit("") if v.kind == "nil" else F.coalesce(F.when(v.col == F.floor(v.col), F.floor(v.col).cast("string")) if v.kind == "num" else v.col.cast("string"), F.lit("")))
            return Val("str", F.concat(*parts))
        if name in ("contains", "startsWith", "endsWith"):
            return self.on_op(Node("op", name, args))
        if name == "split":
            return Val("list", F.split(as_str(vals[0]), re.escape(str(vals[1].literal))), of="str")
        if name == "replace":
            return Val("str", F.replace(as_str(vals[0]), as_str(vals[1]), as_str(vals[2])))
        if name == "join":
            return Val("str", F.array_join(F.transform(elements(vals[0])[0], lambda x: as_str(Val(elements(vals[0])[1], x))), str(vals[1].literal if len(vals) > 1 else "")))
        if name in ("abs", "ceil", "floor", "round"):
            return Val("num", {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round}[name](as_num(vals[0])).cast("double"))
        if name in ("int", "float"):
            n_ = F.coalesce(as_num(vals[0]), as_str(vals[0]).try_cast("double"))
            return Val("num", F.floor(n_).cast("double") if name == "int" else n_)
        if name == "string":
            v = vals[0]
            return Val("str", v.col["text"] if v.kind == "fv" else v.col.cast("string"))
        if name in ("min", "max"):
            return Val("num", (F.least if name == "min" else F.greatest)(*map(as_num, vals)))
        if name == "type" and self.scope.custom:
            v = vals[0]
            names = F.when(is_nil(v), "nil").when(v.col["repr"] == "integer", "int").when(v.col["repr"] == "number", "float").when(v.col["repr"] == "boolean", "bool").when(v.col["repr"] == "sequence", "array").when(v.col["repr"] == "mapping", "map").otherwise("string") if v.kind == "fv" else F.lit({"num": "float", "str": "string", "bool": "bool", "nil": "nil", "list": "array"}[v.kind])
            return Val("str", names)
        raise ExpressionError(f"unknown function {name!r}")


def compile_value(source: str | Node, scope: Scope) -> Val:
    return Compiler(scope).run(source if isinstance(source, Node) else parse(source))


def compile_filter(source: str | Node, scope: Scope) -> Column:
    """A condition that is true or false, never null."""
    v = compile_value(source, scope)
    if v.kind not in ("bool", "fv"):
        raise ExpressionError("a condition is needed")
    return as_bool(v)
