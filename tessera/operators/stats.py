"""Statistics of single columns, as host values, and summaries, as frames."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import functions as fn
from tessera.errors import EmptyData, TypeMismatch, WrongQuantile
from tessera.functions.expr import Agg, Col, Expr
from tessera.operators.frame import Frame, native_aggregate
from tessera.sources.scratch import keep


def _expr(e: Expr | str) -> Expr:
    return Col(e) if isinstance(e, str) else e


def _one(frame: Frame, agg: Agg):
    return frame.df.agg(native_aggregate(agg, frame.context()).alias("v")).first()[0]


def _number(frame: Frame, e: Expr | str) -> Expr:
    e = _expr(e)
    if isinstance(e, Col) and not isinstance(frame.field(e.name).dataType, T.NumericType):
        raise TypeMismatch(f"column '{e.name}' is not numeric")
    return e


def _some(value, what: str):
    if value is None:
        raise EmptyData(f"{what} of no values")
    return value


def mean(frame: Frame, e) -> float:
    return _some(_one(frame, fn.mean(_number(frame, e))), "mean")


def median(frame: Frame, e) -> float:
    return percentile(frame, 50, e)


def percentile(frame: Frame, n: float, e) -> float:
    if not 0 <= n <= 100:
        raise WrongQuantile(f"percentile {n} is outside 0..100")
    return _some(exact_quantiles(frame, [frame.compile(_number(frame, e))], [n / 100])[0], "percentile")[0]


#: Different values of a bracket that come to the driver at most.
BRACKET = 50_000


def exact_quantiles(frame: Frame, columns: list[Column], fractions: list[float]) -> list[list[float] | None]:
    """For each column the quantiles of its present values, with linear interpolation; None for none.

    Sketches of the values bracket the places asked for; values outside the brackets are only counted,
    and those inside come to the driver by value and number. A bracket of more than BRACKET different
    values is narrowed by a sketch of its own values, so no task and not the driver holds a column.
    """
    values = [c.cast("double") for c in columns]
    slack = 1e-3
    asked = [min(1.0, max(0.0, p + d)) for p in fractions for d in (-slack, slack)]
    first = frame.df.agg(*(x for i, c in enumerate(values) for x in (F.count(c).alias(f"n{i}"), F.percentile_approx(c, asked, 2000).alias(f"q{i}")))).first()
    goals = []  # (column, fraction, low, high, values below low)
    for i in range(len(values)):
        if first[f"n{i}"]:
            goals += [(i, k, first[f"q{i}"][2 * k], first[f"q{i}"][2 * k + 1], 0) for k in range(len(fractions))]
    out: list[list[float] | None] = [[0.0] * len(fractions) if first[f"n{i}"] else None for i in range(len(values))]
    while goals:
        cells = []
        for g, (i, _, low, high, _) in enumerate(goals):
            c = values[i]
            inside = F.when((c >= low) & (c <= high), F.struct(F.lit(g).alias("g"), F.lit(0).alias("side"), c.alias("v")))
            cells += [inside, F.when(c < low, F.struct(F.lit(g).alias("g"), F.lit(-1).alias("side"), F.lit(None).cast("double").alias("v")))]
        rows = frame.df.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s")).groupBy("s.g", "s.side", "s.v").agg(F.count(F.lit(1)).alias("n"))
        found = rows.limit(BRACKET * len(goals) + 1).collect()
        if len(found) > BRACKET * len(goals):
            goals = [_narrowed(frame, values[g[0]], fractions[g[1]], first[f"n{g[0]}"], g) for g in goals]
            continue
        later = []
        for g, (i, k, low, high, _) in enumerate(goals):
            below = sum(r["n"] for r in found if r["g"] == g and r["side"] < 0)
            here = sorted((r["v"], r["n"]) for r in found if r["g"] == g and r["side"] == 0)
            place = (first[f"n{i}"] - 1) * fractions[k]
            ends = []
            for rank in (floor(place), ceil(place)):
                at = below
                for v, n in here:
                    if at <= rank < at + n:
                        ends.append(v)
                    at += n
            if len(ends) == 2:
                out[i][k] = ends[0] + (ends[1] - ends[0]) * (place - floor(place))
            else:  # the sketch was beside the place
                later.append((i, k, float("-inf"), float("inf"), 0))
        goals = [_narrowed(frame, values[g[0]], fractions[g[1]], first[f"n{g[0]}"], g) for g in later]
    return out


def _narrowed(frame: Frame, c: Column, fraction: float, n: int, goal: tuple) -> tuple:
    """A smaller bracket around the place of the fraction, by exact counts of what lies on either side."""
    i, k, low, high, _ = goal
    place = (n - 1) * fraction
    inside = F.when((c >= low) & (c <= high), c)
    steps = [s / 200 for s in range(201)]
    r = frame.df.agg(F.percentile_approx(inside, steps, 10_000).alias("q")).first()["q"]
    cuts = sorted({low, *r, high})
    counts = frame.df.agg(*(F.count_if(c <= v).alias(f"c{j}") for j, v in enumerate(cuts))).first()
    lower = max((v for j, v in enumerate(cuts) if counts[f"c{j}"] <= floor(place)), default=low)
    upper = min((v for j, v in enumerate(cuts) if counts[f"c{j}"] >= ceil(place) + 1), default=high)
    return i, k, lower, upper, 0


def quantiles(frame: Frame, q: int, e) -> list[float]:
    """The q + 1 q-quantiles, from the minimum to the maximum."""
    if q < 2:
        raise WrongQuantile(f"there are no {q}-quantiles")
    return _some(exact_quantiles(frame, [frame.compile(_number(frame, e))], [i / q for i in range(q + 1)])[0], "quantiles")


def generic_percentile(frame: Frame, n: float, e):
    """The value of any ordered type at place floor(n / 100 * (count - 1))."""
    return generic_percentiles(frame, (n,), e)[0]


def generic_percentiles(frame: Frame, ns: Sequence[float], e) -> list:
    """Several of them. Different values are counted and dealt out by ranges; only the ranges with a place
    asked for are added up value by value, so no task and not the driver holds a column."""
    for n in ns:
        if not 0 <= n <= 100:
            raise WrongQuantile(f"percentile {n} is outside 0..100")
    counts = frame.df.select(frame.compile(_expr(e)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    # Ranges are sampled, so the rows are written once, with their marks.
    counts = keep(counts.orderBy(F.col("v").asc_nulls_first()).withColumn("mark", F.monotonically_increasing_id()), "percentiles")
    part = F.shiftright("mark", 33)
    sums = sorted(counts.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).collect())  # a row for each range
    total = sum(n for _, n in sums)
    if not total:
        raise EmptyData("percentile of no values")
    asked, base = {}, 0  # place: its range, and the place in it
    places = [floor(n / 100 * (total - 1)) for n in ns]
    for p, n in sums:
        asked |= {x: (p, x - base) for x in places if base <= x < base + n}
        base += n
    upto = counts.where(part.isin({p for p, _ in asked.values()})).withColumn("upto", F.sum("n").over(Window.partitionBy(part).orderBy("mark")))
    hit = [F.when((part == p) & (F.col("upto") > x) & (F.col("upto") - F.col("n") <= x), F.lit(k)) for k, (p, x) in asked.items()]
    rows = upto.select("v", F.explode(F.filter(F.array(*hit), lambda k: k.isNotNull())).alias("k"))
    found = {r["k"]: r["v"] for r in rows.collect()}
    return [found[x] for x in places]


def variance(frame: Frame, e) -> float:
    return _one(frame, fn.variance(_number(frame, e)))


def standard_deviation(frame: Frame, e) -> float:
    return _one(frame, fn.stddev(_number(frame, e)))


def skewness(frame: Frame, e) -> float:
    return _one(frame, fn.skewness(_number(frame, e)))


def sum_(frame: Frame, e):
    return _one(frame, fn.sum_maybe(_number(frame, e)))


def correlation(frame: Frame, a, b) -> float | None:
    """Pearson's, or None below two rows or where a column is not numeric or can miss values."""
    x, y = (frame.compile(_expr(e)) for e in (a, b))
    if any(isinstance(e, Col) and not isinstance(frame.field(e.name).dataType, T.NumericType) for e in (_expr(a), _expr(b))):
        return None
    found = frame.df.agg(fn.correlation(x.cast("double"), y.cast("double")), F.count(F.lit(1)), F.count_if(x.isNull() | y.isNull())).first()
    return None if found[1] < 2 or found[2] else found[0]


def inter_quartile_range(frame: Frame, e) -> float:
    q = _some(exact_quantiles(frame, [frame.compile(_number(frame, e))], [0.25, 0.75])[0], "inter-quartile range")
    return q[1] - q[0]


SUMMARY = ("Count", "Mean", "Minimum", "25%", "Median", "75%", "Max", "StdDev", "IQR", "Skewness")


def summarize(frame: Frame) -> DataFrame:
    """Statistic, and one column for each numeric column: ten rows, rounded half-even to 2 places.

    Missing values are left out by column. The quartiles come from `exact_quantiles`, which runs at once;
    all other numbers from one aggregation.
    """
    names = [f.name for f in frame.df.schema.fields if isinstance(f.dataType, T.NumericType)]
    columns = [F.col(f"`{name}`").cast("double") for name in names]
    quartiles = exact_quantiles(frame, columns, [0.25, 0.5, 0.75]) if names else []
    aggs = []
    for i, (name, x) in enumerate(zip(names, columns)):
        c = frame.context()
        d = fn.to_double(Col(name))
        aggs += [
            F.count(x).cast("double").alias(f"v{i}_0"), F.avg(x).alias(f"v{i}_1"), F.min(x).alias(f"v{i}_2"), F.max(x).alias(f"v{i}_6"),
            native_aggregate(fn.stddev(d), c).alias(f"v{i}_7"), native_aggregate(fn.skewness(d), c).alias(f"v{i}_9"),
        ]
    one = frame.df.agg(*aggs) if aggs else frame.df.agg(F.count(F.lit(1)))

    def cell(i: int, k: int):
        q = quartiles[i]
        given = {3: 0, 4: 1, 5: 2}
        if k in given or k == 8:
            v = F.lit(None if q is None else q[2] - q[0] if k == 8 else q[given[k]]).cast("double")
        else:
            v = F.col(f"v{i}_{k}")
        return F.when(F.isnan(v), v).otherwise(F.bround(v, 2))

    rows = [F.struct(F.lit(s).alias("Statistic"), *(cell(i, k).alias(n) for i, n in enumerate(names))) for k, s in enumerate(SUMMARY)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mean_squared_error(frame: Frame, a, b) -> float:
    gap = frame.compile(_expr(a)) - frame.compile(_expr(b))
    return frame.df.agg(F.avg(gap * gap)).first()[0]


def mutual_information(frame: Frame, bins: int, a, b) -> float:
    """Mutual information of two numbers in equal-width bins; bins * bins counts leave Spark."""
    from math import log

    x, y = frame.compile(_expr(a)).cast("double"), frame.compile(_expr(b)).cast("double")
    pair = frame.df.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    r = pair.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not r[4]:
        raise EmptyData("mutual information of no values")

    def place(c: str, low: float, high: float):
        if high == low:
            return F.lit(0)
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - low) / ((high - low) / bins)).cast("int"))

    cells = pair.groupBy(place("x", r[0], r[1]).alias("i"), place("y", r[2], r[3]).alias("j")).count().collect()
    n, left, right = r[4], {}, {}
    for i, j, c in cells:
        left[i] = left.get(i, 0) + c
        right[j] = right.get(j, 0) + c
    return sum(c / n * log(c * n / (left[i] * right[j])) for i, j, c in cells)


def correlation_matrix(frame: Frame) -> DataFrame:
    """a, b, correlation of all pairs of numeric columns, in one aggregation."""
    names = [f.name for f in frame.df.schema.fields if isinstance(f.dataType, T.NumericType)]
    pairs = [(a, b) for a in names for b in names]
    one = frame.df.agg(*(fn.correlation(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("r")).select("r.*")
