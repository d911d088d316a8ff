"""Scalar and aggregate functions over expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.expr import Agg, Binary, Col, Expr, If, Lit, Named, Nary, Unary, lift

__all__ = ["Expr", "Named", "col", "lit"]


def col(name: str) -> Col:
    return Col(name)


def lit(value: Any) -> Lit:
    return Lit(value)


def name_of(e: Expr) -> str:
    """The name of a column reference."""
    if not isinstance(e, Col):
        raise TypeError("only a column reference has a name")
    return e.name


# Named forms of the operators
def add(a, b):
    return lift(a) + b


def sub(a, b):
    return lift(a) - b


def mult(a, b):
    return lift(a) * b


def divide(a, b):
    return lift(a) / b


def div(a, b):
    """Floor division."""
    return lift(a) // b


def mod(a, b):
    """Modulo with the sign of the divisor."""
    return lift(a) % b


def pow_int(a, k: int):
    return lift(a) ** k


def eq(a, b):
    return lift(a) == b


def lt(a, b):
    return lift(a) < b


def gt(a, b):
    return lift(a) > b


def leq(a, b):
    return lift(a) <= b


def geq(a, b):
    return lift(a) >= b


def and_(a, b):
    return lift(a) & b


def or_(a, b):
    return lift(a) | b


def not_(a):
    return ~lift(a)


def if_then_else(test, then, other) -> If:
    return If(lift(test), lift(then), lift(other))


def _unary(symbol: str) -> Callable[[Any], Unary]:
    return lambda x: Unary(symbol, lift(x))


signum, exp, sqrt, log = map(_unary, ("signum", "exp", "sqrt", "log"))
sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, asinh, acosh, atanh = map(_unary, ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh"))


def pi() -> Nary:
    return Nary("pi", (), F.pi, False)


def log_base(base, x) -> Binary:
    return Binary("log_base", "log_base", lift(base), lift(x))


def to_double(x) -> Unary:
    return Unary("to_double", lift(x), lambda c: c.cast("double"))


def relu(x) -> Unary:
    """max(0, x); missing stays missing."""
    return Unary("relu", lift(x), lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0), c)))


def min_(a, b) -> Binary:
    """Element-wise minimum; a missing value is the smallest."""
    return Binary("min", "min", lift(a), lift(b), True)


def max_(a, b) -> Binary:
    return Binary("max", "max", lift(a), lift(b), True)


# Missing values
def to_maybe(x):
    return lift(x)


def from_maybe(default, x) -> Nary:
    return Nary("from_maybe", (lift(x), lift(default)), F.coalesce, False if isinstance(default, (int, float, str, bool)) else None)


def is_just(x) -> Unary:
    return Unary("is_just", lift(x), lambda c: c.isNotNull(), False)


def is_nothing(x) -> Unary:
    return Unary("is_nothing", lift(x), lambda c: c.isNull(), False)


def from_just(x) -> Unary:
    """The value; the query fails where it is missing."""
    return Unary("from_just", lift(x), lambda c: F.when(c.isNull(), F.raise_error(F.lit("from_just: missing value"))).otherwise(c), False)


def when_present(f: Callable[[Expr], Expr], x) -> If:
    x = lift(x)
    return If(is_nothing(x), lit(None), f(x))


def when_both_present(f: Callable[[Expr, Expr], Expr], a, b) -> If:
    a, b = lift(a), lift(b)
    return If(is_nothing(a) | is_nothing(b), lit(None), f(a, b))


def bind(f: Callable[[Column], Column], x) -> Unary:
    """f on every element of a list, which gives lists, joined."""
    return Unary("bind", lift(x), lambda c: F.flatten(F.transform(c, f)), tag=str(id(f)))


# Recoding
def recode(pairs: list[tuple], x) -> Nary:
    """The value of the first pair whose key equals x, else missing."""
    return _recoded(pairs, x, None)


def recode_with_default(default, pairs: list[tuple], x) -> Nary:
    return _recoded(pairs, x, default)


def _recoded(pairs, x, default):
    def make(c):
        out = F.lit(default)
        for k, v in reversed(pairs):
            out = F.when(c.eqNullSafe(F.lit(k)), F.lit(v)).otherwise(out)
        return out

    return Nary("recode", (lift(x),), make, default is None or any(v is None for _, v in pairs), tag=repr((pairs, default)))


def recode_with_condition(fallback, cases: list[tuple[Callable[[Expr], Expr], Any]], x):
    """Value of the first case whose predicate of x holds, else fallback."""
    out = lift(fallback)
    for test, value in reversed(cases):
        out = If(test(lift(x)), lift(value), out)
    return out


# Strings and lists
def split_on(delimiter: str, x) -> Unary:
    return Unary("split_on", lift(x), lambda c: F.split(c, re.sub(r"([^\w\s])", r"\\\1", delimiter), -1), tag=delimiter)


def match(pattern: str, x) -> Unary:
    """The first whole match; none or an empty one is missing."""
    return Unary("match", lift(x), lambda c: F.nullif(F.regexp_extract(c, pattern, 0), F.lit("")), True, pattern)


def match_all(pattern: str, x) -> Unary:
    return Unary("match_all", lift(x), lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), tag=pattern)


def first_or_nothing(x) -> Unary:
    return Unary("first_or_nothing", lift(x), lambda c: F.get(c, 0), True)


def last_or_nothing(x) -> Unary:
    return Unary("last_or_nothing", lift(x), lambda c: F.try_element_at(c, F.lit(-1)), True)


# Strptime directives and their pattern letters.
_DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%-m": "M", "%d": "dd", "%-d": "d", "%H": "HH", "%-H": "H", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%"}


def java_pattern(fmt: str) -> str:
    def one(m):
        if m[0] not in _DIRECTIVES and m[0][0] == "%":
            raise ValueError(f"directive {m[0]} is not supported")
        return _DIRECTIVES.get(m[0]) or ("'" + m[0] + "'" if m[0].isalpha() else m[0])

    return re.sub(r"%-?.|[A-Za-z]+|'", lambda m: "''" if m[0] == "'" else one(m), fmt)


def parse_date(fmt: str, x) -> Unary:
    """A date; missing where the text does not fit the strptime-style format."""
    return Unary("parse_date", lift(x), lambda c: F.try_to_timestamp(c, F.lit(java_pattern(fmt))).cast("date"), True, fmt)


def days_between(a, b) -> Binary:
    """Days of a - b."""
    return Binary("days_between", "days_between", lift(a), lift(b))


# Host functions
def lift1(f: Callable, x, returns: str = "double", name: str | None = None, symbol: str | None = None) -> Unary:
    """A Python function of a pandas Series, run in Arrow batches; name and symbol decorate it."""
    def run(s: pd.Series) -> pd.Series:
        return f(s)

    return Unary(symbol or name or getattr(f, "__name__", "udf"), lift(x), F.pandas_udf(run, returns), True, (name or "") + str(id(f)))


def lift2(f: Callable, a, b, returns: str = "double", name: str | None = None, symbol: str | None = None, commutative: bool = False, precedence: int = 9) -> Binary:
    """A Python function of two pandas Series; name, symbol, commutativity and precedence decorate it."""
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return f(x, y)

    shown = symbol or name or getattr(f, "__name__", "udf")
    return Binary(shown, shown + str(id(f)), lift(a), lift(b), commutative, precedence, F.pandas_udf(run, returns))


# Aggregates
def count(x) -> Agg:
    """Rows, missing ones too."""
    return Agg("count", lift(x), lambda c: F.count(F.lit(1)), may_null=False)


def sum_(x) -> Agg:
    return Agg("sum", lift(x), F.sum)


def sum_maybe(x) -> Agg:
    """Sum of what is present, 0 if nothing is."""
    return Agg("sum_maybe", lift(x), lambda c: F.coalesce(F.sum(c), F.lit(0)), may_null=False)


def mean(x) -> Agg:
    return Agg("mean", lift(x), F.avg)


def mean_maybe(x) -> Agg:
    return Agg("mean_maybe", lift(x), F.avg)


def minimum(x) -> Agg:
    """Least value; missing if any is."""
    return Agg("minimum", lift(x), lambda c: F.when(F.count_if(c.isNull()) == 0, F.min(c)))


def maximum(x) -> Agg:
    return Agg("maximum", lift(x), F.max)


def variance(x) -> Agg:
    """Sample variance, 0 for fewer than two values."""
    return Agg("variance", lift(x), lambda c: F.when(F.count(c) < 2, F.lit(0.0)).otherwise(F.var_samp(c)), may_null=False)


def stddev(x) -> Agg:
    return Agg("stddev", lift(x), lambda c: F.when(F.count(c) < 2, F.lit(0.0)).otherwise(F.stddev_samp(c)), may_null=False)


stddev_maybe = stddev


def median(x) -> Agg:
    return Agg("median", lift(x), F.median, fractions=(0.5,))


median_maybe = median


def percentile(n: float, x) -> Agg:
    """n of 100, with linear interpolation at (count - 1) * n / 100."""
    return Agg("percentile", lift(x), lambda c: F.percentile(c, n / 100), tag=str(n), fractions=(n / 100,))


def skewness(x) -> Agg:
    """sqrt(n - 1) * m3 / m2^1.5 of central sums; 0 below three values, NaN without spread."""

    def make(c):
        n = F.count(c)
        spread = F.var_pop(c)
        return F.when(n < 3, F.lit(0.0)).when(spread == 0, F.lit(float("nan"))).otherwise(F.skewness(c) * F.sqrt((n - 1) / n))

    return Agg("skewness", lift(x), make, may_null=False)


def mode(x) -> Agg:
    """Most frequent value, of equally frequent ones the largest."""
    return Agg("mode", lift(x))


def collect(x) -> Agg:
    """The group's values, missing ones too, last row first."""

    def make(c, order):
        return F.reverse(order.values(c))

    return Agg("collect", lift(x), make, ordered=True)


def reduce(x, seed, step: Callable[[Column, Column], Column]) -> Agg:
    """A left fold over the group's values in row order."""

    def make(c, order):
        return F.reduce(order.values(c), seed if isinstance(seed, Column) else F.lit(seed), step)

    return Agg("reduce", lift(x), make, ordered=True, tag=str(id(step)))


def aggregate_with(f: Callable, x, returns: str = "double", name: str | None = None) -> Agg:
    """A Python aggregate of a group's values as a pandas Series."""
    def run(s: pd.Series) -> float:
        return f(s)

    return Agg(name or getattr(f, "__name__", "udaf"), lift(x), F.pandas_udf(run, returns), tag=str(id(f)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's as a native aggregate of two columns; NaN where one has no spread."""
    spread = F.sqrt(F.var_pop(F.when(b.isNotNull(), a))) * F.sqrt(F.var_pop(F.when(a.isNotNull(), b)))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def z_score(x) -> Binary:
    """(x - mean x) / stddev x, over the whole frame."""
    x = lift(x)
    return (x - mean(x)) / stddev(x)


