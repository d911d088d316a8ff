"""Typed expression trees that compile to Spark columns.

An `Expr` knows its operator, operands and how to build the Spark column. Comparisons are two-valued:
a missing value equals a missing value and is below every other; the guards for that are emitted only
where an operand can be null, so plans over required columns stay plain and are pushed down.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import ColumnNotFound, MixedAggregation, Unaggregated


@dataclass
class Context:
    """What an expression is compiled against.

    nullable: the columns of the frame and whether they can hold nulls; aggregate: builds the column of
    an `Agg` node (a native aggregate, or its value over the whole frame in a row context).
    """

    nullable: dict[str, bool]
    aggregate: Callable[[Agg], Column] | None = None


def lift(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


class Expr:
    """Base of the tree; operators build new trees, `same` compares them."""

    def children(self) -> tuple[Expr, ...]:
        return ()

    def rebuild(self, children: list[Expr]) -> Expr:
        return self

    def build(self, c: Context) -> Column:
        raise NotImplementedError

    def nullable(self, c: Context) -> bool:
        return any(x.nullable(c) for x in self.children())

    def key(self) -> tuple:
        return (type(self).__name__, self.symbol, *(x.key() for x in self.children()))

    def same(self, other: Expr) -> bool:
        return self.key() == other.key()

    def named(self, name: str) -> Named:
        return Named(name, self)

    # Arithmetic
    def __add__(self, o):
        return Binary("+", "add", self, lift(o), True, 6)

    def __radd__(self, o):
        return lift(o) + self

    def __sub__(self, o):
        return Binary("-", "sub", self, lift(o), False, 6)

    def __rsub__(self, o):
        return lift(o) - self

    def __mul__(self, o):
        return Binary("*", "mul", self, lift(o), True, 7)

    def __rmul__(self, o):
        return lift(o) * self

    def __truediv__(self, o):
        return Binary("/", "divide", self, lift(o), False, 7)

    def __rtruediv__(self, o):
        return lift(o) / self

    def __floordiv__(self, o):
        return Binary("//", "div", self, lift(o), False, 8)

    def __mod__(self, o):
        return Binary("%", "mod", self, lift(o), False, 8)

    def __pow__(self, o):
        if isinstance(o, int):
            return Binary("^^", "pow", self, Lit(o), False, 8)
        return Binary("**", "power", self, lift(o), False, 8)

    def __neg__(self):
        return Unary("negate", self)

    def __abs__(self):
        return Unary("abs", self)

    # Comparison
    def __eq__(self, o):
        return Binary("==", "eq", self, lift(o), True, 4)

    def __ne__(self, o):
        return Binary("/=", "ne", self, lift(o), True, 4)

    def __lt__(self, o):
        return Binary("<", "lt", self, lift(o), False, 4)

    def __le__(self, o):
        return Binary("<=", "le", self, lift(o), False, 4)

    def __gt__(self, o):
        return Binary(">", "gt", self, lift(o), False, 4)

    def __ge__(self, o):
        return Binary(">=", "ge", self, lift(o), False, 4)

    def __and__(self, o):
        return Binary("&&", "and", self, lift(o), True, 3)

    def __or__(self, o):
        return Binary("||", "or", self, lift(o), True, 2)

    def __invert__(self):
        return Unary("not", self)

    __hash__ = object.__hash__

    def __bool__(self):
        raise TypeError("an expression has no truth value; use & | ~ and .same()")

    def __repr__(self):
        return pretty(self)


@dataclass(eq=False, repr=False)
class Col(Expr):
    name: str

    def build(self, c):
        if self.name not in c.nullable:
            raise ColumnNotFound(self.name, c.nullable)
        return F.col(f"`{self.name}`")

    def nullable(self, c):
        return c.nullable.get(self.name, True)

    def key(self):
        return ("Col", self.name)


@dataclass(eq=False, repr=False)
class Lit(Expr):
    value: Any

    def build(self, c):
        return F.lit(self.value)

    def nullable(self, c):
        return self.value is None

    def key(self):
        return ("Lit", type(self.value).__name__, repr(self.value))


@dataclass(eq=False, repr=False)
class Unary(Expr):
    symbol: str
    arg: Expr
    make: Callable[[Column], Column] | None = None
    may_null: bool | None = None  # None: as the operand
    tag: str = ""  # tells apart nodes of one symbol with other parameters

    def children(self):
        return (self.arg,)

    def rebuild(self, children):
        return Unary(self.symbol, children[0], self.make, self.may_null, self.tag)

    def build(self, c):
        return (self.make or UNARY[self.symbol])(self.arg.build(c))

    def nullable(self, c):
        return self.arg.nullable(c) if self.may_null is None else self.may_null

    def key(self):
        return ("Unary", self.symbol, self.tag, self.arg.key())


@dataclass(eq=False, repr=False)
class Binary(Expr):
    symbol: str
    name: str
    left: Expr
    right: Expr
    commutative: bool = False
    precedence: int = 9
    make: Callable[[Column, Column], Column] | None = None

    def children(self):
        return (self.left, self.right)

    def rebuild(self, children):
        return Binary(self.symbol, self.name, *children, self.commutative, self.precedence, self.make)

    def build(self, c):
        a, b = self.left.build(c), self.right.build(c)
        if self.make:
            return self.make(a, b)
        if self.name == "pow" and isinstance(self.right, Lit):
            return int_power(a, self.right.value)
        if self.name in COMPARE:
            return COMPARE[self.name](a, b, self.left.nullable(c), self.right.nullable(c))
        return BINARY[self.name](a, b)

    def nullable(self, c):
        return False if self.name in COMPARE else super().nullable(c)


@dataclass(eq=False, repr=False)
class If(Expr):
    test: Expr
    then: Expr
    other: Expr
    symbol = "if"

    def children(self):
        return (self.test, self.then, self.other)

    def rebuild(self, children):
        return If(*children)

    def build(self, c):
        return F.when(self.test.build(c), self.then.build(c)).otherwise(self.other.build(c))

    def nullable(self, c):
        return self.then.nullable(c) or self.other.nullable(c)


@dataclass(eq=False, repr=False)
class Nary(Expr):
    """A function of any number of operands."""

    symbol: str
    args: tuple[Expr, ...]
    make: Callable[..., Column] = field(default=None)
    may_null: bool | None = None
    tag: str = ""

    def children(self):
        return self.args

    def rebuild(self, children):
        return Nary(self.symbol, tuple(children), self.make, self.may_null, self.tag)

    def build(self, c):
        return self.make(*(a.build(c) for a in self.args))

    def nullable(self, c):
        return super().nullable(c) if self.may_null is None else self.may_null

    def key(self):
        return ("Nary", self.symbol, self.tag, *(x.key() for x in self.args))


@dataclass(eq=False, repr=False)
class Agg(Expr):
    """An aggregate of a row expression; make(column) builds the native aggregate.

    ordered: needs the order of rows, make(column, row order); kind "mode" is computed by counting
    values first; fractions: it is a percentile, computed together with others of its operand.
    """

    symbol: str
    arg: Expr
    make: Callable[..., Column] | None = None
    ordered: bool = False
    may_null: bool = True
    tag: str = ""
    fractions: tuple[float, ...] = ()

    def children(self):
        return (self.arg,)

    def rebuild(self, children):
        return Agg(self.symbol, children[0], self.make, self.ordered, self.may_null, self.tag, self.fractions)

    def build(self, c):
        if c.aggregate is None:
            raise Unaggregated(f"{pretty(self)} stands where no aggregate can")
        return c.aggregate(self)

    def nullable(self, c):
        return self.may_null

    def key(self):
        return ("Agg", self.symbol, self.tag, self.arg.key())


@dataclass
class Named:
    name: str
    expr: Expr


# --- how operators compile ---------------------------------------------------------------------


def ieee_divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def floor_div(a: Column, b: Column) -> Column:
    q = F.call_function("div", a, b)
    return q - F.when(((a % b) != 0) & ((a < 0) != (b < 0)), F.lit(1)).otherwise(F.lit(0))


def floor_mod(a: Column, b: Column) -> Column:
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def int_power(a: Column, k: int) -> Column:
    if k < 0:
        raise ValueError("the exponent must not be negative")
    if k > 16:
        return F.pow(a.cast("double"), F.lit(k))
    out = None
    for _ in range(k):
        out = a if out is None else out * a
    return F.when(a.isNotNull(), F.lit(1)) if out is None else out


def ieee_log(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.log(F.when(x > 0, x)))


def _eq(a, b, an, bn):
    return a.eqNullSafe(b) if an or bn else a == b


def _below(a, b, an, bn, strict: bool):
    """a < b or a <= b, with null below all else."""
    plain = a < b if strict else a <= b
    if an and bn:
        edge = a.isNull() & b.isNotNull() if strict else a.isNull()
        return F.coalesce(plain, edge)
    if an:
        return plain | a.isNull()
    if bn:
        return plain & b.isNotNull()
    return plain


COMPARE: dict[str, Callable] = {
    "eq": _eq,
    "ne": lambda a, b, an, bn: ~_eq(a, b, an, bn),
    "lt": lambda a, b, an, bn: _below(a, b, an, bn, True),
    "le": lambda a, b, an, bn: _below(a, b, an, bn, False),
    "gt": lambda a, b, an, bn: _below(b, a, bn, an, True),
    "ge": lambda a, b, an, bn: _below(b, a, bn, an, False),
}

BINARY: dict[str, Callable] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "divide": ieee_divide,
    "div": floor_div,
    "mod": floor_mod,
    "power": lambda a, b: F.pow(a, b),
    "log_base": lambda base, x: ieee_divide(ieee_log(x), ieee_log(base)),
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "max": lambda a, b: F.greatest(a, b),
    "days_between": lambda a, b: F.datediff(a, b).cast("long"),
}

UNARY: dict[str, Callable] = {
    "negate": lambda x: -x,
    "abs": F.abs,
    "signum": F.signum,
    "not": lambda x: ~x,
    "exp": F.exp,
    "sqrt": F.sqrt,
    "log": ieee_log,
    **{f: getattr(F, f) for f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")},
}


# --- tree utilities ----------------------------------------------------------------------------


def pretty(e: Expr, outer: int = 0) -> str:
    """Text of an expression, with parentheses where precedence needs them."""
    if isinstance(e, Col):
        return e.name
    if isinstance(e, Lit):
        return repr(e.value)
    if isinstance(e, If):
        return f"if {pretty(e.test)} then {pretty(e.then)} else {pretty(e.other)}"
    if isinstance(e, Binary) and not e.symbol.isidentifier():
        text = f"{pretty(e.left, e.precedence)} {e.symbol} {pretty(e.right, e.precedence + 1)}"
        return f"({text})" if e.precedence < outer else text
    return f"{e.symbol}({', '.join(pretty(x) for x in e.children())})"


def normalize(e: Expr) -> Expr:
    """Operands of commutative operators in canonical order."""
    parts = [normalize(x) for x in e.children()]
    out = e.rebuild(parts) if parts else e
    if isinstance(out, Binary) and out.commutative and compare(out.right, out.left) < 0:
        out = out.rebuild([out.right, out.left])
    return out


def compare(a: Expr, b: Expr) -> int:
    """-1, 0 or 1 by a total structural order."""
    x, y = repr(a.key()), repr(b.key())
    return (x > y) - (x < y)


def replace(e: Expr, old: Expr, new: Expr) -> Expr:
    if e.same(old):
        return new
    parts = [replace(x, old, new) for x in e.children()]
    return e.rebuild(parts) if parts else e


def size(e: Expr) -> int:
    return 1 + sum(size(x) for x in e.children())


def columns_of(e: Expr) -> list[str]:
    """Referenced columns, each once, in order of appearance."""
    if isinstance(e, Col):
        return [e.name]
    return list(dict.fromkeys(n for x in e.children() for n in columns_of(x)))


def aggregates_of(e: Expr) -> list[Agg]:
    """Outermost aggregates."""
    if isinstance(e, Agg):
        return [e]
    return [a for x in e.children() for a in aggregates_of(x)]


def check_aggregated(e: Expr) -> None:
    """Raise unless every column reference lies inside an aggregate."""

    def bare(x: Expr) -> bool:
        return isinstance(x, Col) or not isinstance(x, Agg) and any(bare(y) for y in x.children())

    if bare(e):
        if aggregates_of(e):
            raise MixedAggregation(f"{pretty(e)} joins aggregated and unaggregated operands")
        raise Unaggregated(f"{pretty(e)} is not aggregated")
