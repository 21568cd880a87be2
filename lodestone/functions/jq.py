"""A small path-and-condition language compiled to Columns.

Paths (``.a.b``, ``."k"``), literals, ``if c then a else b end``, comparisons, ``//``, ``+ - * /``,
``|`` with ``length``, ``max``, ``min``, ``exp``, ``tostring``, arrays, string interpolation and object
constructors. Only null and false are false in a condition; values of different types compare by type
(null, false, true, number, string, array, object). Anything else is refused when compiled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnsupportedExpression(ValueError):
    """The expression is outside the language."""


_TOKEN = re.compile(r'\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<op>//|==|!=|<=|>=|[.|(){}\[\]:,<>+\-*/])|(?P<word>[A-Za-z_]\w*))')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise UnsupportedExpression(f"cannot read {text[at:]!r}")
        kind = m.lastgroup or ""
        out.append((kind, m[kind]))
        at = m.end()
    return [*out, ("end", "")]


class Value:
    """A column and its type."""

    def __init__(self, column: Column, kind: T.DataType) -> None:
        self.column, self.kind = column, kind

    @property
    def order(self) -> Column:
        """Rank of the type in comparisons."""
        k = self.kind
        if isinstance(k, T.NullType):
            return F.lit(0)
        if isinstance(k, T.BooleanType):
            rank = F.when(self.column, 2).otherwise(1)
        else:
            rank = F.lit(3 if isinstance(k, T.NumericType) else 4 if isinstance(k, T.StringType) else 5 if isinstance(k, T.ArrayType) else 6)
        return F.when(self.column.isNull(), 0).otherwise(rank)

    @property
    def true(self) -> Column:
        if isinstance(self.kind, T.NullType):
            return F.lit(False)
        if isinstance(self.kind, T.BooleanType):
            return F.coalesce(self.column, F.lit(False))
        return self.column.isNotNull()

    def number(self) -> "Value":
        if isinstance(self.kind, (T.NumericType, T.NullType)):
            return Value(self.column.cast("double"), T.DoubleType())
        raise UnsupportedExpression("a number is needed")

    def text(self) -> Column:
        if isinstance(self.kind, (T.DoubleType, T.FloatType)):
            whole = self.column == F.floor(self.column)
            return F.when(whole, self.column.cast("long").cast("string")).otherwise(self.column.cast("string"))
        return F.coalesce(self.column.cast("string"), F.lit("null"))


class _Parser:
    def __init__(self, text: str, root: Value) -> None:
        self.tokens, self.at, self.roots = _tokens(text), 0, [root]

    def peek(self, *ops: str) -> bool:
        return self.tokens[self.at][1] in ops and self.tokens[self.at][0] in ("op", "word")

    def take(self, *ops: str) -> str:
        if not self.peek(*ops):
            raise UnsupportedExpression(f"expected {' or '.join(ops)}, not {self.tokens[self.at][1]!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def pipe(self) -> Value:
        left = self.alternative()
        pushed = 0
        while self.peek("|"):
            self.take("|")
            self.roots.append(left)
            pushed += 1
            left = self.alternative()
        del self.roots[len(self.roots) - pushed :]
        return left

    def alternative(self) -> Value:
        left = self.comparison()
        while self.peek("//"):
            self.take("//")
            right = self.comparison()
            left = Value(F.when(left.true, left.column).otherwise(right.column), right.kind if isinstance(left.kind, T.NullType) else left.kind)
        return left

    def comparison(self) -> Value:
        left = self.sum()
        if self.peek("==", "!=", "<", "<=", ">", ">="):
            op = self.take("==", "!=", "<", "<=", ">", ">=")
            right = self.sum()
            same = (isinstance(left.kind, T.NumericType) and isinstance(right.kind, T.NumericType)) or left.kind == right.kind
            a, b = left.order, right.order
            if same:
                inner = {"==": left.column == right.column, "!=": left.column != right.column, "<": left.column < right.column, "<=": left.column <= right.column, ">": left.column > right.column, ">=": left.column >= right.column}[op]
            else:
                inner = F.lit(op in ("==", "<=", ">="))
            outer = {"==": a == b, "!=": a != b, "<": a < b, "<=": a < b, ">": a > b, ">=": a > b}[op]
            # Nulls on both sides have equal rank and no inner result.
            both_null = F.lit(op in ("==", "<=", ">="))
            return Value(F.when(a != b, outer).when(a == 0, both_null).otherwise(inner), T.BooleanType())
        return left

    def sum(self) -> Value:
        left = self.product()
        while self.peek("+", "-"):
            op = self.take("+", "-")
            right = self.product()
            if op == "+" and isinstance(left.kind, T.StringType) and isinstance(right.kind, T.StringType):
                left = Value(F.when(left.column.isNull(), right.column).when(right.column.isNull(), left.column).otherwise(F.concat(left.column, right.column)), left.kind)
                continue
            a, b = left.number().column, right.number().column
            if op == "+":  # null is neutral in a sum
                left = Value(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), T.DoubleType())
            else:
                left = Value(a - b, T.DoubleType())
        return left

    def product(self) -> Value:
        left = self.unary()
        while self.peek("*", "/"):
            op = self.take("*", "/")
            right = self.unary().number()
            a = left.number().column
            left = Value(a * right.column if op == "*" else a / right.column, T.DoubleType())
        return left

    def unary(self) -> Value:
        if self.peek("-"):
            self.take("-")
            return Value(-self.unary().number().column, T.DoubleType())
        return self.term()

    def term(self) -> Value:
        kind, text = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return Value(F.lit(float(text)) if re.search("[.eE]", text) else F.lit(int(text)), T.DoubleType() if re.search("[.eE]", text) else T.LongType())
        if kind == "str":
            self.at += 1
            return self.interpolated(text[1:-1])
        if self.peek("("):
            self.take("(")
            out = self.pipe()
            self.take(")")
            return out
        if self.peek("["):
            return self.array()
        if self.peek("if"):
            return self.condition()
        if self.peek("."):
            return self.path()
        if kind == "word":
            return self.word()
        raise UnsupportedExpression(f"unexpected {text!r}")

    def interpolated(self, text: str) -> Value:
        parts, at = [], 0
        for m in re.finditer(r"\\\(([^()]*(?:\([^()]*\)[^()]*)*)\)", text):
            parts += [F.lit(_unescaped(text[at : m.start()])), _Parser(m[1], self.roots[-1]).whole().text()]
            at = m.end()
        parts.append(F.lit(_unescaped(text[at:])))
        return Value(F.concat(*parts) if len(parts) > 1 else parts[0], T.StringType())

    def array(self) -> Value:
        self.take("[")
        items = [self.alternative()]
        while self.peek(","):
            self.take(",")
            items.append(self.alternative())
        self.take("]")
        kind = items[0].kind
        if any(isinstance(i.kind, T.NumericType) for i in items):
            items, kind = [i.number() for i in items], T.DoubleType()
        return Value(F.array(*(i.column for i in items)), T.ArrayType(kind))

    def condition(self) -> Value:
        self.take("if")
        test = self.pipe()
        self.take("then")
        yes = self.pipe()
        if self.peek("elif"):
            self.tokens[self.at] = ("word", "if")
            no = self.condition()
        else:
            self.take("else")
            no = self.pipe()
            self.take("end")
        return Value(F.when(test.true, yes.column).otherwise(no.column), no.kind if isinstance(yes.kind, T.NullType) else yes.kind)

    def path(self) -> Value:
        value, first = self.roots[-1], True
        while self.peek("."):
            self.take(".")
            kind, name = self.tokens[self.at]
            if kind not in ("word", "str") or (first and kind == "word" and name in ("then", "else", "end", "elif")):
                if first:
                    return value
                raise UnsupportedExpression("a name is missing after '.'")
            self.at += 1
            value, first = _field(value, name[1:-1] if kind == "str" else name), False
        return value

    def word(self) -> Value:
        name = self.take(*{t for k, t in self.tokens if k == "word"})
        root = self.roots[-1]
        if name in ("true", "false"):
            return Value(F.lit(name == "true"), T.BooleanType())
        if name == "null":
            return Value(F.lit(None), T.NullType())
        if name == "length":
            k = root.kind
            if isinstance(k, T.StringType):
                return Value(F.coalesce(F.length(root.column), F.lit(0)).cast("long"), T.LongType())
            if isinstance(k, (T.ArrayType, T.MapType)):
                return Value(F.coalesce(F.size(root.column), F.lit(0)).cast("long"), T.LongType())
            return Value(F.abs(root.number().column), T.DoubleType())
        if name in ("max", "min") and isinstance(root.kind, T.ArrayType):
            return Value((F.array_max if name == "max" else F.array_min)(root.column), root.kind.elementType)
        if name == "exp":
            return Value(F.exp(root.number().column), T.DoubleType())
        if name == "tostring":
            return Value(root.text(), T.StringType())
        raise UnsupportedExpression(f"unknown function {name!r}")

    def whole(self) -> Value:
        out = self.pipe()
        if self.tokens[self.at][0] != "end":
            raise UnsupportedExpression(f"unexpected {self.tokens[self.at][1]!r}")
        return out


def _unescaped(text: str) -> str:
    return text.replace('\\"', '"').replace("\\n", "\n").replace("\\t", "\t").replace("\\\\", "\\")


def _field(value: Value, name: str) -> Value:
    k = value.kind
    if isinstance(k, T.StructType):
        if name not in k.names:
            return Value(F.lit(None), T.NullType())
        return Value(F.col(f"`{name}`") if value.column is None else value.column[name], k[name].dataType)
    if isinstance(k, T.MapType):
        return Value(F.try_element_at(value.column, F.lit(name)), k.valueType)
    if isinstance(k, T.NullType):
        return value
    raise UnsupportedExpression(f"no field {name!r} in a {k.simpleString()}")


def compile_expression(text: str, df: DataFrame) -> Column:
    """The column of ``text`` over rows of ``df``; a blank expression is the whole row."""
    root = Value(None, df.schema)  # type: ignore[arg-type]
    if not text.strip() or text.strip() == ".":
        return F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return _Parser(text, root).whole().column


def compile_object(text: str, df: DataFrame) -> dict[str, Column]:
    """Columns by key of an object constructor ``{k: expr, ...}``; ``{a}`` is short for ``{a: .a}``."""
    p = _Parser(text, Value(None, df.schema))  # type: ignore[arg-type]
    p.take("{")
    out: dict[str, Column] = {}
    while not p.peek("}"):
        kind, name = p.tokens[p.at]
        if kind not in ("word", "str"):
            raise UnsupportedExpression(f"bad key {name!r}")
        p.at += 1
        name = name[1:-1] if kind == "str" else name
        if p.peek(":"):
            p.take(":")
            out[name] = p.alternative().column
        else:
            out[name] = _field(p.roots[-1], name).column
        if not p.peek("}"):
            p.take(",")
    p.take("}")
    if p.tokens[p.at][0] != "end":
        raise UnsupportedExpression("text after the object")
    return out


def field_or_expression(field: str | None, expression: str | None, default: str) -> str:
    """A field name stands for its path; giving both is an error."""
    if field and expression:
        raise ValueError("give a field or an expression, not both")
    return f".{field}" if field else expression or default
