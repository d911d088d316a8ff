"""Grouping and aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import Agg, Context, Expr, Named, aggregates_of, check_aggregated, lift
from tessera.operators.frame import Frame, native_aggregate

_ORDER = "__order"


class Grouped:
    """A frame and its grouping keys; `aggregate` is all it can do."""

    def __init__(self, frame: Frame, keys: Sequence[str]):
        frame.check(*keys)
        self.frame, self.keys = frame, list(dict.fromkeys(keys))

    def aggregate(self, *named: Named) -> Frame:
        """Keys and one column for each expression; no rows give no groups, keys or not."""
        for n in named:
            check_aggregated(n.expr)
        out = aggregate_frame(self.frame, self.keys, list(named), keep_empty=False)
        required = (self.frame.required & set(self.keys)) | {n.name for n in named if not n.expr.nullable(self.frame.context())}
        return Frame(out, required)


def group_by(frame: Frame, *keys: str) -> Grouped:
    return Grouped(frame, keys)


def aggregate_frame(frame: Frame, keys: list[str], named: list[Named], keep_empty: bool) -> DataFrame:
    """One native aggregation for all expressions.

    Modes are counted by value first and joined on the keys; an aggregate of an aggregate folds the
    groups' values over all groups in a second step.
    """
    df, c = frame.unsorted, frame.context()  # ordered aggregates carry the order themselves
    nodes: dict[tuple, Agg] = {}
    for n in named:
        for a in aggregates_of(n.expr):
            nodes.setdefault(a.key(), a)
    nested = {k: a for k, a in nodes.items() if aggregates_of(a.arg)}
    plain = {k: a for k, a in nodes.items() if k not in nested}
    for a in list(nested.values()):
        for inner in aggregates_of(a.arg):
            plain.setdefault(inner.key(), inner)
    number = {k: f"__a{i}" for i, k in enumerate([*plain, *nested])}
    order = None
    if any(a.ordered for a in plain.values()):
        order = RowOrder(frame)
        df = df.withColumn(_ORDER, order.column)
    columns = [native_aggregate(a, c, order).alias(number[k]) for k, a in plain.items() if a.symbol != "mode" and not a.fractions]
    columns += _percentiles({number[k]: a for k, a in plain.items() if a.fractions}, c)
    quoted = [f"`{k}`" for k in keys]
    out = df.groupBy(*quoted).agg(*columns, F.count(F.lit(1)).alias("__rows"))
    for k, a in plain.items():
        if a.symbol == "mode":
            value = a.arg.build(Context(c.nullable))
            counted = df.groupBy(*quoted, value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
            best = counted.groupBy(*quoted).agg(F.max(F.struct("__n", "__v"))["__v"].alias(number[k]))
            out = _meet(out, best, keys)
    for k, a in nested.items():
        inner = Context(dict.fromkeys(number.values(), True), lambda x: F.col(number[x.key()]))
        value = a.arg.build(inner)
        whole = out.withColumn(_ORDER, RowOrder(None).column).agg((a.make(value, RowOrder(None)) if a.ordered else a.make(value)).alias("v"))
        out = out.withColumn(number[k], whole.scalar())
    final = Context(c.nullable, lambda a: F.col(number[a.key()]))
    if not keys and not keep_empty:
        out = out.where("__rows > 0")
    return out.select(*quoted, *(lift(n.expr).build(final).alias(n.name) for n in named))


class RowOrder:
    """The order of a frame's rows for aggregates that depend on it: the keys of its sort, then the
    place in the source."""

    def __init__(self, frame: Frame | None):
        keys = [*frame.order] if frame else []
        self.ups = [*(up for _, up in keys), True]
        self.column = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, (c, _) in enumerate(keys)), F.monotonically_increasing_id().alias(f"k{len(keys)}"))

    def values(self, c: Column) -> Column:
        """The group's values, in order."""
        kept = F.collect_list(F.struct(F.col(_ORDER).alias("o"), c.alias("v")))
        kept = F.array_sort(kept) if all(self.ups) else F.array_sort(kept, self._compare)
        return F.transform(kept, lambda s: s["v"])

    def _compare(self, a: Column, b: Column) -> Column:
        """Missing keys first going up, last going down."""
        out = F.lit(0)
        for i, up in reversed(list(enumerate(self.ups))):
            x, y, less = a["o"][f"k{i}"], b["o"][f"k{i}"], -1 if up else 1
            one = F.when(x.isNull(), F.lit(less)).when(y.isNull(), F.lit(-less)).when(x < y, F.lit(less)).otherwise(F.lit(-less))
            out = F.when(x.eqNullSafe(y), out).otherwise(one)
        return out


def _percentiles(nodes: dict[str, Agg], c: Context) -> list[Column]:
    """One exact percentile aggregate for all that ask for the same operand."""
    asked: dict[tuple, list[str]] = {}
    for name, a in nodes.items():
        asked.setdefault(a.arg.key(), []).append(name)
    out = []
    for names in asked.values():
        points = sorted({p for n in names for p in nodes[n].fractions})
        all_ = F.percentile(nodes[names[0]].arg.build(Context(c.nullable)), F.array(*(F.lit(p) for p in points)))
        out += [all_[points.index(nodes[n].fractions[0])].alias(n) for n in names]
    return out


def _meet(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join two tables of one row a group; missing keys meet."""
    if not keys:
        return a.withColumn(b.columns[0], b.scalar())
    other = b.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), b.columns[-1])
    same = [a[f"`{k}`"].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)]
    return a.join(other, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def value_counts(frame: Frame, e: Expr) -> DataFrame:
    """value, count: ascending, missing values too."""
    return frame.df.groupBy(frame.compile(e).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("value").asc_nulls_first())


def value_proportions(frame: Frame, e: Expr) -> DataFrame:
    """value, proportion of all rows."""
    total = frame.df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return value_counts(frame, e).select("value", (F.col("count") / total).alias("proportion"))


def frequencies(frame: Frame, e: Expr) -> DataFrame:
    """Two rows, Count and Percentage (%), with one text column for each value, in ascending order."""
    total = frame.df.agg(F.count(F.lit(1)).alias("n")).scalar()
    long = value_counts(frame, e).withColumn("p", F.col("count") * 100.0 / total)
    shown = F.when(F.col("p") < 0.01, F.lit("<0.01%")).otherwise(F.format_string("%.2f%%", "p"))
    cells = long.select(F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("value"), F.explode(F.array(F.struct(F.lit("Count").alias("Statistic"), F.col("count").cast("string").alias("cell")), F.struct(F.lit("Percentage (%)").alias("Statistic"), shown.alias("cell")))).alias("r"))
    values = [r[0] for r in cells.select("value").distinct().orderBy("value").collect()]  # the columns of the result
    return cells.groupBy("r.Statistic").pivot("value", values).agg(F.first("r.cell")).orderBy("Statistic")


def distinct(frame: Frame) -> Frame:
    return frame.distinct()
