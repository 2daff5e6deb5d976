"""Typed expressions over a table's columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn, functions as F

from ..errors import ExpressionTypeError
from ..types import BaseType

NUMBER, BOOL, STRING, OBJECT = BaseType.FLOAT, BaseType.BOOL, BaseType.STRING, BaseType.OBJECT


def wrap(x) -> "Expr":
    if isinstance(x, Expr):
        return x
    if isinstance(x, bool):
        return Literal(x, BOOL)
    if isinstance(x, (int, float)):
        return Literal(x, NUMBER)
    if isinstance(x, str):
        return Literal(x, STRING)
    raise ExpressionTypeError(f"{x!r} is no expression")


class Expr:
    """An expression; operators give new ones, and check their operands' types."""

    type: BaseType

    def _need(self, *types: BaseType) -> "Expr":
        if self.type not in types:
            raise ExpressionTypeError(f"{self} is {self.type.value}; needed: {', '.join(t.value for t in types)}")
        return self

    def _math(self, other, op: str, turned: bool = False) -> "Expr":
        a, b = self._need(NUMBER), wrap(other)._need(NUMBER)
        return Apply(op, (b, a) if turned else (a, b), NUMBER)

    def __add__(self, other):
        return self._math(other, "+")

    def __radd__(self, other):
        return self._math(other, "+", True)

    def __sub__(self, other):
        return self._math(other, "-")

    def __rsub__(self, other):
        return self._math(other, "-", True)

    def __mul__(self, other):
        return self._math(other, "*")

    def __rmul__(self, other):
        return self._math(other, "*", True)

    def __truediv__(self, other):
        return self._math(other, "/")

    def __rtruediv__(self, other):
        return self._math(other, "/", True)

    def __neg__(self):
        return Apply("neg", (self._need(NUMBER),), NUMBER)

    def _compare(self, other, op: str, *types: BaseType) -> "Expr":
        a, b = self._need(*types), wrap(other)._need(*types)
        if a.type != b.type:
            raise ExpressionTypeError(f"{a} is {a.type.value}, {b} is {b.type.value}")
        return Apply(op, (a, b), BOOL)

    def __eq__(self, other):  # type: ignore[override]
        return self._compare(other, "=", NUMBER, BOOL, STRING)

    def __ne__(self, other):  # type: ignore[override]
        return self._compare(other, "<>", NUMBER, BOOL, STRING)

    __hash__ = object.__hash__

    def __lt__(self, other):
        return self._compare(other, "<", NUMBER)

    def __le__(self, other):
        return self._compare(other, "<=", NUMBER)

    def __gt__(self, other):
        return self._compare(other, ">", NUMBER)

    def __ge__(self, other):
        return self._compare(other, ">=", NUMBER)

    def _logic(self, other, op: str, turned: bool = False) -> "Expr":
        a, b = self._need(BOOL), wrap(other)._need(BOOL)
        return Apply(op, (b, a) if turned else (a, b), BOOL)

    def __and__(self, other):
        return self._logic(other, "and")

    def __rand__(self, other):
        return self._logic(other, "and", True)

    def __or__(self, other):
        return self._logic(other, "or")

    def __ror__(self, other):
        return self._logic(other, "or", True)

    def __invert__(self):
        return Apply("not", (self._need(BOOL),), BOOL)

    def isnull(self):
        """True for a null; derived values exist only where all their sources do, so this is of use on extend() or in a mask."""
        return Apply("isnull", (self,), BOOL)

    def isnotnull(self):
        return Apply("isnotnull", (self,), BOOL)

    def sum(self):
        return Aggregate("sum", self._need(NUMBER), NUMBER)

    def avg(self):
        return Aggregate("avg", self._need(NUMBER), NUMBER)

    def max(self):
        return Aggregate("max", self._need(NUMBER), NUMBER)

    def min(self):
        return Aggregate("min", self._need(NUMBER), NUMBER)

    def count(self):
        """Values for each key; null, not 0, where there are none."""
        return Aggregate("count", self, NUMBER)

    def any(self):
        return Aggregate("any", self._need(BOOL), BOOL)

    def all(self):
        return Aggregate("all", self._need(BOOL), BOOL)

    def pop(self):
        """One value for each key: that of the smallest hidden keys."""
        return Aggregate("pop", self, self.type)

    def extend(self, fill):
        """The value over all combinations of its keys, fill where there is none."""
        fill = wrap(fill)
        if fill.type != self.type:
            raise ExpressionTypeError(f"{self} is {self.type.value}, {fill} is {fill.type.value}")
        return Extend(self, fill, self.type)

    def mask(self, condition):
        """The value where the condition holds; none elsewhere."""
        return Apply("mask", (self, wrap(condition)._need(BOOL)), self.type)


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    value: object
    type: BaseType

    def __str__(self) -> str:
        return repr(self.value)


@dataclass(frozen=True, eq=False)
class Ref(Expr):
    """A column of a table."""

    name: str
    type: BaseType

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True, eq=False)
class Apply(Expr):
    op: str
    children: tuple[Expr, ...]
    type: BaseType
    function: Callable[..., SparkColumn] | None = None

    def __str__(self) -> str:
        return f"{self.op}({', '.join(map(str, self.children))})"


@dataclass(frozen=True, eq=False)
class Aggregate(Expr):
    op: str
    of: Expr
    type: BaseType
    function: Callable[[SparkColumn], SparkColumn] | None = None

    def __str__(self) -> str:
        return f"{self.op}({self.of})"


@dataclass(frozen=True, eq=False)
class Extend(Expr):
    of: Expr
    fill: Expr
    type: BaseType

    def __str__(self) -> str:
        return f"extend({self.of}, {self.fill})"


def call(function: Callable[..., SparkColumn], *args, type: BaseType = OBJECT) -> Expr:
    """Any Spark function (or pandas UDF) of columns as an expression of the given type."""
    return Apply(getattr(function, "__name__", "call"), tuple(map(wrap, args)), type, function)


def fold(function: Callable[[SparkColumn], SparkColumn], x, type: BaseType = OBJECT) -> Expr:
    """Any Spark aggregate (or grouped pandas UDF) as an aggregate over hidden keys."""
    return Aggregate(getattr(function, "__name__", "fold"), wrap(x), type, function)


def _divide(a: SparkColumn, b: SparkColumn) -> SparkColumn:
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, infinite).otherwise(a / F.when(b != 0, b))


_OPS: dict[str, Callable[..., SparkColumn]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": _divide,
    "neg": lambda a: -a,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "not": lambda a: ~a,
    "isnull": lambda a: a.isNull(),
    "isnotnull": lambda a: a.isNotNull(),
    "mask": lambda a, b: F.when(b, a),
}
_MATH = {"+", "-", "*", "/", "neg"}


def to_spark(expr: Expr, column: Callable[[Expr], SparkColumn]) -> SparkColumn:
    """A Spark column; `column` gives that of each reference, aggregate and extension. Arithmetic is done in double."""
    if isinstance(expr, Literal):
        return F.lit(expr.value)
    if not isinstance(expr, Apply):
        return column(expr)
    args = [to_spark(x, column) for x in expr.children]
    if expr.function is not None:
        return expr.function(*args)
    if expr.op in _MATH:
        args = [a.cast("double") for a in args]
    return _OPS[expr.op](*args)


def leaves(expr: Expr) -> list[Expr]:
    """References, aggregates and extensions that the expression is made of, each once."""
    if isinstance(expr, Apply):
        out: list[Expr] = []
        for x in expr.children:
            out += [y for y in leaves(x) if not any(y is z for z in out)]
        return out
    return [] if isinstance(expr, Literal) else [expr]
