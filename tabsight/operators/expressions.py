"""P5: query expressions as Spark predicates.

The expression language of tabular query strings: ``and``/``or``/``not`` (also ``&``,
``|``, ``~``), chained comparisons, ``in`` and ``not in`` over lists, arithmetic,
back-quoted column names, ``@name`` for a given value, string methods (``name.str.lower()``)
and a few column methods. Python's own parser reads the text; the tree becomes one Column,
so Catalyst sees an ordinary predicate and pushes its comparisons into the scan.

Missing values follow the reference's rules, not SQL's: a comparison with a missing value
is false, and ``!=`` and ``not in`` are true. ``not`` is pushed inwards to the comparisons,
where it also admits missing values; what is left needs no NULL test, as a filter takes
NULL for false. A NaN is missing like a NULL."""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INTEGRAL, is_numeric


class ExpressionError(ValueError):
    """The text is not a query expression, or doesn't fit the table."""


class NotAnExpression(ExpressionError):
    """The text doesn't follow the grammar."""


@dataclass
class Value:
    """A compiled operand: its column, kind (number, text, flag, time, other), and for a
    constant its Python value."""
    column: Column
    kind: str
    constant: object = None
    nullable: bool = True
    whole: bool = False

    def nan(self) -> list[Column]:
        return [F.isnan(self.column)] if self.kind == "number" and not self.whole and self.constant is None else []

    def absent(self) -> list[Column]:
        """The conditions under which the value is missing."""
        return ([self.column.isNull()] if self.nullable else []) + self.nan()


_TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?P<quoted>[^`]+)`|@(?P<given>[A-Za-z_]\w*)|(?P<op>[&|])""", re.S)

COMPARE: dict[type, tuple[Callable, type]] = {
    ast.Lt: (operator.lt, ast.GtE), ast.LtE: (operator.le, ast.Gt), ast.Gt: (operator.gt, ast.LtE),
    ast.GtE: (operator.ge, ast.Lt), ast.Eq: (operator.eq, ast.NotEq), ast.NotEq: (operator.ne, ast.Eq)}

#: Functions of one number; outside their domain the result is missing.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log": F.log, "log10": F.log10, "log1p": F.log1p,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
    "floor": F.floor, "ceil": F.ceil}


def _kind(t: T.DataType) -> str:
    if is_numeric(t):
        return "number"
    if isinstance(t, T.BooleanType):
        return "flag"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "text" if isinstance(t, (T.StringType, T.VarcharType, T.CharType)) else "other"


def _constant(v) -> Value:
    if v is None:
        return Value(F.lit(None), "other", None)
    if isinstance(v, bool):
        return Value(F.lit(v), "flag", v, False)
    if isinstance(v, (int, float)):
        return Value(F.lit(v), "number", v, False, isinstance(v, int))
    if isinstance(v, str):
        return Value(F.lit(v), "text", v, False)
    return Value(F.lit(v), "time", v, False)


class _Compiler:
    def __init__(self, df: DataFrame, given: dict):
        self.df, self.given = df, given
        self.fields = {f.name: f for f in df.schema.fields}
        self.quoted: dict[str, str] = {}

    def parse(self, text: str) -> ast.expr:
        """The tree of ``text``; back-quoted and @ names become plain ones, and & and |
        bind like ``and`` and ``or``."""
        def plain(m: re.Match) -> str:
            if m["quoted"] is not None:
                self.quoted[f"__quoted{len(self.quoted)}"] = m["quoted"]
                return f"__quoted{len(self.quoted) - 1}"
            if m["given"] is not None:
                return f"__given_{m['given']}"
            return {"&": " and ", "|": " or "}.get(m["op"], m[0])
        try:
            return ast.parse(_TOKEN.sub(plain, text.strip()), mode="eval").body
        except (SyntaxError, ValueError) as e:
            raise NotAnExpression(f"not a query expression: {text!r} ({e})") from e

    # ------------------------------------------------------------ values

    def name(self, name: str) -> Value:
        if name.startswith("__given_"):
            key = name.removeprefix("__given_")
            if key not in self.given:
                raise ExpressionError(f"no value given for @{key}")
            return _constant(self.given[key])
        name = self.quoted.get(name, name)
        field = self.fields.get(name)
        if field is None:
            raise ExpressionError(f"name {name!r} is not a column; columns: {', '.join(self.fields)}")
        c = F.col("`" + name.replace("`", "``") + "`")
        whole = isinstance(field.dataType, (*INTEGRAL, T.DecimalType))
        return Value(c, _kind(field.dataType), None, field.nullable, whole)

    def value(self, node: ast.expr) -> Value:
        if isinstance(node, ast.Constant):
            return _constant(node.value)
        if isinstance(node, ast.Name):
            return self.name(node.id)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            if isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, (int, float)):
                return _constant(-node.operand.value if isinstance(node.op, ast.USub) else node.operand.value)
            v = self.number(node.operand, "a sign")
            return Value(-v.column if isinstance(node.op, ast.USub) else v.column, "number", None, v.nullable, v.whole)
        if isinstance(node, ast.BinOp):
            return self.arithmetic(node)
        if isinstance(node, ast.Call):
            return self.call(node)
        if isinstance(node, (ast.Compare, ast.BoolOp, ast.UnaryOp)):
            return Value(F.coalesce(self.condition(node, False), F.lit(False)), "flag", None, False)
        raise ExpressionError(f"{ast.unparse(node)!r} has no place in a query expression")

    def number(self, node: ast.expr, where: str) -> Value:
        v = self.value(node)
        if v.kind != "number":
            raise ExpressionError(f"{where} needs a number, not {ast.unparse(node)!r}")
        return v

    def arithmetic(self, node: ast.BinOp) -> Value:
        a, b = self.value(node.left), self.value(node.right)
        text = ast.unparse(node)
        if isinstance(node.op, ast.Add) and a.kind == b.kind == "text":
            return Value(F.concat(a.column, b.column), "text", None, a.nullable or b.nullable)
        if a.kind != "number" or b.kind != "number":
            raise ExpressionError(f"{text!r} needs numbers")
        whole, x, y = a.whole and b.whole, a.column, b.column
        if whole:
            x, y = x.cast("long"), y.cast("long")
        else:
            x, y = x.cast("double"), y.cast("double")
        plain = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}.get(type(node.op))
        nullable = a.nullable or b.nullable
        if plain:
            return Value(plain(x, y), "number", None, nullable, whole)
        x, y = x.cast("double"), y.cast("double")
        if isinstance(node.op, ast.Pow):
            return Value(F.pow(x, y), "number", None, nullable)
        # a division by zero is infinite, or missing for zero by zero
        at_zero = F.when(x < 0, F.lit(float("-inf"))).when((x > 0) & ~F.isnan(x), F.lit(float("inf")))
        ratio = F.when(y == 0, at_zero).otherwise(x / F.nullif(y, F.lit(0.0)))
        if isinstance(node.op, ast.Div):
            return Value(ratio, "number")
        # F.floor makes whole numbers, which infinity is not
        down = F.when(F.abs(ratio) < F.lit(2.0 ** 52), F.floor(ratio).cast("double")).otherwise(ratio)
        if isinstance(node.op, ast.FloorDiv):
            return Value(down, "number")
        if isinstance(node.op, ast.Mod):  # the sign of the divisor; F.pmod takes that of neither
            rest = x % F.nullif(y, F.lit(0.0))
            return Value(F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest), "number")
        raise ExpressionError(f"unknown operator in {text!r}")

    def call(self, node: ast.Call) -> Value:
        args = [ast.literal_eval(a) for a in node.args] if not isinstance(node.func, ast.Name) else []
        options = {k.arg: ast.literal_eval(k.value) for k in node.keywords}
        if isinstance(node.func, ast.Name):
            f = FUNCTIONS.get(node.func.id)
            if f is None or len(node.args) != 1 or options:
                raise ExpressionError(f"unknown function {ast.unparse(node)!r}; known: {', '.join(FUNCTIONS)}")
            v = self.number(node.args[0], node.func.id)
            y = f(v.column) if node.func.id == "abs" else f(v.column.cast("double")).cast("double")
            return Value(y, "number", None, True, v.whole and node.func.id == "abs")
        if not isinstance(node.func, ast.Attribute):
            raise ExpressionError(f"{ast.unparse(node)!r} is no method of a column")
        of, method = node.func.value, node.func.attr
        if isinstance(of, ast.Attribute) and of.attr == "str":
            return self.text_method(self.value(of.value), method, args, options, ast.unparse(node))
        return self.column_method(self.value(of), method, args, options, ast.unparse(node))

    def text_method(self, v: Value, method: str, args: list, options: dict, text: str) -> Value:
        if v.kind != "text":
            raise ExpressionError(f"{text!r} needs a text column")
        c = v.column

        def many(f):
            some = args[0] if isinstance(args[0], tuple) else (args[0],)
            out = f(some[0])
            for x in some[1:]:
                out = out | f(x)
            return out

        if method == "contains" and args:
            regex, case = options.pop("regex", True), options.pop("case", True)
            options.pop("na", None)  # missing texts don't match, whatever is asked
            if regex:
                out = c.rlike(args[0] if case else f"(?i){args[0]}")
            else:
                out = c.contains(args[0]) if case else F.lower(c).contains(args[0].lower())
        elif method in ("match", "fullmatch") and len(args) == 1:
            out = c.rlike(f"^(?:{args[0]})" + (r"\z" if method == "fullmatch" else ""))
        elif method in ("startswith", "endswith") and len(args) == 1:
            out = many(c.startswith if method == "startswith" else c.endswith)
        else:
            made = {"lower": F.lower, "upper": F.upper, "strip": lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""),
                    "lstrip": lambda x: F.regexp_replace(x, r"^\s+", ""), "rstrip": lambda x: F.regexp_replace(x, r"\s+$", "")}.get(method)
            if made and not args and not options:
                return Value(made(c), "text")
            if method == "len" and not args and not options:
                return Value(F.length(c), "number", None, v.nullable, True)
            if method == "replace" and len(args) == 2 and options == {"regex": False} or method == "replace" and len(args) == 2 and not options:
                return Value(F.replace(c, F.lit(args[0]), F.lit(args[1])), "text")
            if method == "slice" and 1 <= len(args) <= 2 and min(args) >= 0 and not options:
                return Value(F.substring(c, args[0] + 1, (args[1] if len(args) > 1 else 1 << 30) - args[0]), "text")
            raise ExpressionError(f"unknown text method in {text!r}")
        if options:
            raise ExpressionError(f"unknown argument in {text!r}")
        return Value(out, "flag", None, v.nullable)

    def column_method(self, v: Value, method: str, args: list, options: dict, text: str) -> Value:
        if options and not (method == "between" and set(options) == {"inclusive"}):
            raise ExpressionError(f"unknown argument in {text!r}")
        if method in ("isnull", "isna", "notnull", "notna") and not args:
            out = F.lit(False)
            for c in v.absent():
                out = out | c
            return Value(out if method in ("isnull", "isna") else ~out, "flag", None, False)
        if method == "isin" and len(args) == 1:
            return Value(self.among(v, list(args[0])), "flag")
        if method == "between" and len(args) == 2:
            ends = options.get("inclusive", "both")
            if ends not in ("both", "left", "right", "neither"):
                raise ExpressionError(f"unknown argument in {text!r}")
            low = self.compared(v, ast.GtE if ends in ("both", "left") else ast.Gt, _constant(args[0]), False)
            return Value(low & self.compared(v, ast.LtE if ends in ("both", "right") else ast.Lt, _constant(args[1]), False), "flag")
        if method == "abs" and not args and v.kind == "number":
            return Value(F.abs(v.column), "number", None, v.nullable, v.whole)
        raise ExpressionError(f"unknown method in {text!r}")

    # -------------------------------------------------------- conditions

    def condition(self, node: ast.expr, negated: bool) -> Column:
        """The node as a condition in which NULL stands for false; its opposite if
        ``negated``, for rows with missing values too."""
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return self.condition(node.operand, not negated)
        if isinstance(node, ast.BoolOp):
            parts = [self.condition(v, negated) for v in node.values]
            join = operator.and_ if isinstance(node.op, ast.And) != negated else operator.or_
            out = parts[0]
            for p in parts[1:]:
                out = join(out, p)
            return out
        if isinstance(node, ast.Compare):
            left, parts = node.left, []
            for op, right in zip(node.ops, node.comparators, strict=True):
                parts.append(self.comparison(left, op, right, negated))
                left = right
            out = parts[0]
            for p in parts[1:]:
                out = out | p if negated else out & p
            return out
        v = self.value(node)
        if v.kind != "flag":
            raise ExpressionError(f"{ast.unparse(node)!r} is not a condition")
        return self.opposite(v.column, v.nullable) if negated else v.column

    @staticmethod
    def opposite(c: Column, nullable: bool = True) -> Column:
        return ~F.coalesce(c, F.lit(False)) if nullable else ~c

    def comparison(self, left: ast.expr, op: ast.cmpop, right: ast.expr, negated: bool) -> Column:
        listed = isinstance(right, (ast.List, ast.Tuple, ast.Set)) or (
            isinstance(right, ast.Name) and right.id.startswith("__given_")
            and isinstance(self.given.get(right.id.removeprefix("__given_")), (list, tuple, set)))
        if isinstance(op, (ast.In, ast.NotIn)) or listed and isinstance(op, (ast.Eq, ast.NotEq)):
            if not listed:
                raise ExpressionError(f"'in' needs a list, not {ast.unparse(right)!r}")
            if isinstance(right, ast.Name):
                items = list(self.given[right.id.removeprefix("__given_")])
            else:
                items = [self.literal(x) for x in right.elts]
            c = self.among(self.value(left), items)
            return self.opposite(c) if isinstance(op, (ast.NotIn, ast.NotEq)) != negated else c
        if type(op) not in COMPARE:
            raise ExpressionError(f"unknown comparison in {ast.unparse(left)!r} .. {ast.unparse(right)!r}")
        return self.compared(self.value(left), type(op), self.value(right), negated)

    def literal(self, node: ast.expr):
        v = self.value(node)
        if v.constant is None and not (isinstance(node, ast.Constant) and node.value is None):
            raise ExpressionError(f"a list holds constants, not {ast.unparse(node)!r}")
        return v.constant

    def among(self, v: Value, items: list) -> Column:
        """Whether the value is one of ``items``; None among them stands for missing."""
        fit = [x for x in items if x is not None and (_constant(x).kind == v.kind or v.kind == "time")]
        out = v.column.isin([self.as_time(v, x) for x in fit]) if fit else F.lit(False)
        return out | v.column.isNull() if None in items else out

    @staticmethod
    def as_time(v: Value, x):
        return F.lit(x).cast("timestamp_ntz") if v.kind == "time" and isinstance(x, str) else x

    def compared(self, a: Value, op: type, b: Value, negated: bool) -> Column:
        # constants on the left are turned round, so that the comparison reaches the scan
        if {a.kind, b.kind} == {"time", "text"} and (a.constant if a.kind == "text" else b.constant) is not None:
            a, b = (Value(F.lit(v.constant).cast("timestamp_ntz"), "time", v.constant, False) if v.kind == "text" else v for v in (a, b))
        if {a.kind, b.kind} == {"number", "flag"}:
            a, b = (Value(v.column.cast("int"), "number", v.constant, v.nullable, True) if v.kind == "flag" else v for v in (a, b))
        if "other" in (a.kind, b.kind) or a.kind != b.kind:
            if op in (ast.Eq, ast.NotEq):  # values of different kinds differ, and so does a missing one
                return F.lit((op is ast.NotEq) != negated)
            raise ExpressionError(f"a {a.kind} and a {b.kind} have no order")
        # of the comparisons with a missing value only != is true, and under not all others
        admit = (op is ast.NotEq) != negated
        c = COMPARE[COMPARE[op][1] if negated else op][0](a.column, b.column)
        for v in (a, b):
            for missing in v.absent() if admit else v.nan():  # NULL is false by itself, NaN is above all numbers to Spark
                c = c | missing if admit else c & ~missing
        return c


def expression(df: DataFrame, text: str, given: dict | None = None) -> Column:
    """The predicate that ``text`` states over the columns of ``df``, for use in a filter:
    NULL stands for false. ``given`` holds the values of ``@`` names.

    Names that are no columns, methods and operators that are unknown, orders between
    values of different kinds and texts that aren't expressions raise ``ExpressionError``."""
    c = _Compiler(df, given or {})
    return c.condition(c.parse(text), False)


def filter_expression(df: DataFrame, text: str, given: dict | None = None) -> DataFrame:
    """Rows that match a query expression."""
    return df.where(expression(df, text, given))


def expression_summary(df: DataFrame, text: str, given: dict | None = None) -> DataFrame:
    """(matched, total) of a query expression in one pass."""
    return df.agg(F.count_if(F.coalesce(expression(df, text, given), F.lit(False))).alias("matched"), F.count(F.lit(1)).alias("total"))


def expression_preview(df: DataFrame, text: str, order_by: str, n: int = 10, given: dict | None = None) -> DataFrame:
    """The first ``n`` matches by a key."""
    return filter_expression(df, text, given).orderBy(order_by).limit(n)
