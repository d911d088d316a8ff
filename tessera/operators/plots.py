"""Plots: aggregation in Spark, a few hundred numbers to the driver, text or HTML out of them.

Histogram bins are of equal width and the last one is closed; category charts keep the n most frequent
labels and sum the others up.
"""

from __future__ import annotations

import html
import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EmptyData, TypeMismatch
from tessera.operators.frame import Frame
from tessera.operators.stats import exact_quantiles

BLOCKS = " ▁▂▃▄▅▆▇█"
# Labels shown by a smart chart (up to the first number all, up to the second the first, else
# the third), labels of a pie, and percents below which a share folds and below which the rest is left out.
SMART_TOP, PIE_TOP, SHARE, LEAST_REST = (12, 20, 10), 8, 2.0, 1.0


# --- data ---------------------------------------------------------------------------------------


def histogram(frame: Frame, name: str, bins: int = 30) -> DataFrame:
    """bin, low, high, n for the bins with rows."""
    x = frame._c(name).cast("double")
    r = frame.df.agg(F.min(x), F.max(x)).first()
    if r[0] is None:
        raise EmptyData(f"column '{name}' has no values")
    low, width = r[0], (r[1] - r[0]) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((x - low) / width).cast("int"))
    found = frame.df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n").orderBy("bin")


def category_counts(frame: Frame, name: str, top: int = 10) -> DataFrame:
    """label, n of the top labels, then one row for the others, if there are any."""
    return folded(frame.df.groupBy(frame._c(name).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")), top)


def smart_top(n_labels: int) -> int:
    """All of up to 12 labels, 12 of up to 20, else 10."""
    some, many, few = SMART_TOP
    return n_labels if n_labels <= some else some if n_labels <= many else few


def market_share(frame: Frame, name: str, least: float = SHARE) -> DataFrame:
    """label, share (percent): labels under `least` percent fold into Others, unless all of those
    together have less than 1 percent."""
    counts = frame.df.groupBy(frame._c(name).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = frame.df.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = counts.withColumn("share", F.col("n") * 100.0 / total)
    big = shares.where(F.col("share") >= least).select("label", "share")
    small = shares.where(F.col("share") < least).agg(F.sum("share").alias("share")).where(F.col("share") >= LEAST_REST).select(F.lit("Others").alias("label"), "share")
    return big.unionByName(small)


def grouped_sums(frame: Frame, group: str, value: str) -> DataFrame:
    """label, n: sums of a numeric column by group, else counts by "group - value"."""
    if isinstance(frame.field(value).dataType, T.NumericType):
        return frame.df.groupBy(frame._c(group).cast("string").alias("label")).agg(F.sum(frame._c(value)).alias("n"))
    label = F.concat_ws(" - ", frame._c(group).cast("string"), frame._c(value).cast("string"))
    return frame.df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def folded(rows: DataFrame, top: int) -> DataFrame:
    """label, n of the top rows of (label, n), then one row for all others, if there are any."""
    best = rows.orderBy(F.desc("n"), F.asc_nulls_first("label")).limit(top)
    total = rows.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    mine = best.agg(F.sum("n").alias("own"), F.count(F.lit(1)).alias("own_k"))
    rest = total.withColumn("own", mine.select("own").scalar()).withColumn("own_k", mine.select("own_k").scalar()).where("k > own_k")
    return best.unionByName(rest.select(F.format_string("Other (%d items)", F.col("k") - F.col("own_k")).alias("label"), (F.col("n") - F.col("own")).alias("n")))


def stacked_sums(frame: Frame, group: str, values: Sequence[str], top: int | None = None) -> DataFrame:
    """label and the sums of the value columns; with `top` the labels of the greatest sums of all, then
    one row for all others."""
    sums = frame.df.groupBy(frame._c(group).cast("string").alias("label")).agg(*(F.sum(frame._c(v)).alias(v) for v in values))
    if top is None:
        return sums
    whole = sum((F.coalesce(F.col(f"`{v}`").cast("double"), F.lit(0.0)) for v in values), F.lit(0.0))
    best = sums.withColumn("__all", whole).orderBy(F.desc("__all"), F.asc_nulls_first("label")).limit(top)
    rest = sums.join(best.select(F.col("label").alias("__shown")), F.col("label").eqNullSafe(F.col("__shown")), "left_anti")
    one = rest.agg(F.count(F.lit(1)).alias("__k"), *(F.sum(f"`{v}`").alias(v) for v in values)).where("__k > 0")
    return best.select("label", *(f"`{v}`" for v in values)).unionByName(one.select(F.format_string("Other (%d items)", "__k").alias("label"), *(f"`{v}`" for v in values)))


def five_numbers(frame: Frame, names: Sequence[str]) -> list[tuple[str, list[float]]]:
    """Minimum, quartiles and maximum of each column."""
    found = exact_quantiles(frame, [frame._c(n) for n in names], [0.0, 0.25, 0.5, 0.75, 1.0])
    for n, q in zip(names, found):
        if q is None:
            raise EmptyData(f"column '{n}' has no values")
    return list(zip(names, found))


def points(frame: Frame, x: str, ys: Sequence[str], by: str | None = None) -> DataFrame:
    """All rows of x, ys (and by)."""
    return frame.df.select(*(frame._c(c) for c in dict.fromkeys([x, *ys, *([by] if by else [])])))


def flat_points(frame: Frame, x: str, ys: Sequence[str], by: str | None = None) -> DataFrame:
    """i, kind, x, y: a row for each finite point, with the number of its y."""

    def number(name: str):
        c = frame._c(name)
        return (c.cast("timestamp") if isinstance(frame.field(name).dataType, T.DateType) else c).cast("double")

    kind = F.coalesce(frame._c(by).cast("string"), F.lit("None")) if by else F.lit("")
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), number(y).alias("y")) for i, y in enumerate(ys)))
    flat = frame.df.select(number(x).alias("x"), kind.alias("kind"), F.explode(pairs).alias("p")).select("p.i", "kind", "x", "p.y")
    return flat.where((F.abs("x") < math.inf) & (F.abs("y") < math.inf))


def _bounds(flat: DataFrame) -> tuple[float, float, float, float]:
    """Least x, width, least y and height of the points."""
    r = flat.agg(F.min("x"), F.max("x") - F.min("x"), F.min("y"), F.max("y") - F.min("y")).first()
    if r[0] is None:
        raise EmptyData("there are no points")
    return r[0], r[1] or 1.0, r[2], r[3] or 1.0


def _place(name: str, low: float, wide: float, cells: int):
    return F.floor((F.col(name) - low) / wide * (cells - 1)).cast("int")


def point_cells(flat: DataFrame, width: int, height: int) -> tuple[tuple[float, float, float, float], list]:
    """The bounds, and i, kind, col, row, n, x and y (means) of the cells with points. All points count;
    a series has at most width * height cells."""
    x0, dx, y0, dy = _bounds(flat)
    cells = flat.groupBy("i", "kind", _place("x", x0, dx, width).alias("col"), _place("y", y0, dy, height).alias("row"))
    return (x0, dx, y0, dy), cells.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).orderBy("i", "kind", "col", "row").collect()


def line_points(flat: DataFrame, width: int) -> tuple[tuple[float, float, float, float], list]:
    """The bounds, and i, x, y of each series' first, last, lowest and highest point in each of `width` columns, by x: lines
    through them are those through all points, at that width."""
    x0, dx, y0, dy = _bounds(flat)
    ends = [f(F.struct(*(F.col(c) for c in names))).alias(f"e{k}") for k, (f, names) in enumerate(((F.min, "xy"), (F.max, "xy"), (F.min, "yx"), (F.max, "yx")))]
    found = flat.groupBy("i", _place("x", x0, dx, width).alias("col")).agg(*ends)
    rows = found.select("i", F.explode(F.array_distinct(F.array(*(F.struct(f"e{k}.x", f"e{k}.y") for k in range(4))))).alias("p")).select("i", "p.x", "p.y")
    return (x0, dx, y0, dy), rows.orderBy("i", "x", "y").collect()


def numeric_columns(frame: Frame) -> list[str]:
    return [f.name for f in frame.df.schema.fields if isinstance(f.dataType, T.NumericType)]


# --- text ---------------------------------------------------------------------------------------


def bars_text(pairs: Sequence[tuple[str, float]], width: int = 40, percent: bool = False) -> str:
    pairs = [(str(a), float(b)) for a, b in pairs]
    most, total = max((b for _, b in pairs), default=0) or 1, sum(b for _, b in pairs) or 1
    room = max((len(a) for a, _ in pairs), default=0)
    shown = lambda b: f"{b:g} ({b * 100 / total:.1f}%)" if percent else f"{b:g}"
    return "\n".join(f"{a.ljust(room)} {'█' * round(b / most * width)} {shown(b)}" for a, b in pairs)


def plot_histogram(frame: Frame, name: str, bins: int = 30) -> str:
    return bars_text([(f"{r['low']:.4g}..{r['high']:.4g}", r["n"]) for r in histogram(frame, name, bins).collect()])


def plot_all_histograms(frame: Frame, bins: int = 30) -> str:
    return "\n\n".join(f"{n}\n{plot_histogram(frame, n, bins)}" for n in numeric_columns(frame))


def _pairs(df: DataFrame) -> list[tuple[str, float]]:
    return [("null" if r[0] is None else r[0], r[1]) for r in df.collect()]


def plot_bars(frame: Frame, name: str, top: int = 10, percent: bool = False) -> str:
    return bars_text(_pairs(category_counts(frame, name, top)), percent=percent)


def plot_smart_bars(frame: Frame, name: str) -> str:
    n = frame.df.select(frame._c(name)).distinct().limit(21).count()
    return plot_bars(frame, name, smart_top(n))


def plot_categorical_summary(frame: Frame) -> str:
    text = [f.name for f in frame.df.schema.fields if isinstance(f.dataType, T.StringType)]
    return "\n\n".join(f"{n}\n{plot_bars(frame, n)}" for n in text)


def plot_grouped_bars(frame: Frame, group: str, value: str, top: int = 200) -> str:
    return bars_text(_pairs(folded(grouped_sums(frame, group, value), top)))


def plot_stacked_bars(frame: Frame, group: str, values: Sequence[str], top: int = 200) -> str:
    rows = stacked_sums(frame, group, values, top).collect()
    return "\n".join(f"{r['label']}\n{bars_text([(v, r[v] or 0) for v in values])}" for r in rows)


def pie_shares(frame: Frame, name: str, label: str | None = None, top: int = PIE_TOP) -> DataFrame:
    """label, n of a pie: counts of a text column; or the values of a numeric one, summed by the label
    column or numbered, the greatest and all others where there are many."""
    if not isinstance(frame.field(name).dataType, T.NumericType):
        return category_counts(frame, name, top)
    if label is not None:
        return folded(grouped_sums(frame, label, name), top)
    from tessera.operators.frame import POSITION

    rows = frame.positions().select(F.format_string("Item %d", F.col(POSITION) + 1).alias("label"), frame._c(name).cast("double").alias("n"))
    return folded(rows, top if frame.df.limit(11).count() > 10 else 10)


def plot_pie(frame: Frame, name: str, label: str | None = None, top: int = PIE_TOP) -> str:
    return bars_text(_pairs(pie_shares(frame, name, label, top)), percent=True)


def plot_smart_pie(frame: Frame, name: str) -> str:
    n = frame.df.select(frame._c(name)).distinct().limit(SMART_TOP[1] + 1).count()
    return plot_pie(frame, name, top=smart_top(n))


def plot_pie_grouped(frame: Frame, group: str, value: str) -> str:
    """Sums of a numeric column by group, else counts of both together."""
    numeric = isinstance(frame.field(value).dataType, T.NumericType)
    return bars_text(_pairs(folded(grouped_sums(frame, group, value), PIE_TOP if numeric else SMART_TOP[2])), percent=True)


def plot_pie_comparison(frame: Frame, names: Sequence[str]) -> str:
    """A pie of each text column that has 2 to 20 labels."""
    out = []
    for name in names:
        if isinstance(frame.field(name).dataType, T.StringType) and 1 < frame.df.select(frame._c(name)).distinct().limit(SMART_TOP[1] + 1).count() <= SMART_TOP[1]:
            out.append(f"{name}\n{plot_smart_pie(frame, name)}")
    return "\n\n".join(out)


def plot_binary_pie(frame: Frame, name: str) -> str:
    if frame.df.select(frame._c(name)).distinct().limit(3).count() != 2:
        raise TypeMismatch(f"column '{name}' has not two values")
    return plot_pie(frame, name)


def plot_market_share(frame: Frame, name: str) -> str:
    return bars_text(_pairs(market_share(frame, name).orderBy(F.desc("share"))))


def plot_box(frame: Frame, names: Sequence[str]) -> str:
    return "\n".join(f"{n}: min {v[0]:g}, 25% {v[1]:g}, median {v[2]:g}, 75% {v[3]:g}, max {v[4]:g}" for n, v in five_numbers(frame, names))


#: Columns and rows of plots of points as text, and of those in a page (its pixels by two, as marks are wider).
GRID, PIXELS = (60, 18), (290, 185)


def grid_text(marks: Sequence[tuple[int, int, str]], width: int = GRID[0], height: int = GRID[1]) -> str:
    """Marks at (column, row from below); the last of a place stays."""
    rows = [[" "] * width for _ in range(height)]
    for x, y, mark in marks:
        rows[height - 1 - y][x] = mark
    return "\n".join("".join(r).rstrip() for r in rows)


def plot_scatter(frame: Frame, x: str, y: str, by: str | None = None) -> str:
    """Where several kinds meet, the most frequent is shown."""
    cells = point_cells(flat_points(frame, x, [y], by), *GRID)[1]
    names = {k: i for i, k in enumerate(sorted({r["kind"] for r in cells}))}
    return grid_text([(r["col"], r["row"], chr(ord("a") + names[r["kind"]] % 26) if by else "•") for r in sorted(cells, key=lambda r: r["n"])])


def plot_lines(frame: Frame, x: str, ys: Sequence[str]) -> str:
    return grid_text([(r["col"], r["row"], chr(ord("a") + r["i"] % 26)) for r in point_cells(flat_points(frame, x, ys), *GRID)[1]])


def plot_heatmap(frame: Frame, most: int = 40) -> str:
    """The first rows of the numeric columns, shaded between the least and the greatest number."""
    names = numeric_columns(frame)
    rows = frame.df.select(*(f"`{n}`" for n in names)).limit(most).collect()
    flat = [v for r in rows for v in r if v is not None]
    low, high = min(flat, default=0), max(flat, default=1)
    return "\n".join("".join(" " if v is None else BLOCKS[int((v - low) / ((high - low) or 1) * 8)] * 2 for v in r) for r in rows)


def plot_correlation_matrix(frame: Frame) -> str:
    from tessera.operators.stats import correlation_matrix

    names = numeric_columns(frame)
    found = {(r["a"], r["b"]): r["correlation"] for r in correlation_matrix(frame).collect()}
    room = max(map(len, names), default=0)
    return "\n".join(f"{a.ljust(room)} " + " ".join("  NaN" if found[a, b] is None else f"{found[a, b]:5.2f}" for b in names) for a in names)


# --- HTML ---------------------------------------------------------------------------------------


def bars_html(pairs: Sequence[tuple[str, float]], title: str) -> str:
    pairs = [(a, float(b or 0)) for a, b in pairs]
    most = max((b for _, b in pairs), default=0) or 1
    bars = "".join(f'<g><text x="0" y="{20 * i + 34}">{html.escape(str(a))}</text><rect x="220" y="{20 * i + 22}" width="{max(b, 0) / most * 400:.1f}" height="14" fill="#4477aa"/><text x="{max(b, 0) / most * 400 + 226:.1f}" y="{20 * i + 34}">{b:g}</text></g>' for i, (a, b) in enumerate(pairs))
    return _page(title, [[str(a), b] for a, b in pairs], bars, 20 * len(pairs) + 40)


def histogram_html(frame: Frame, name: str, bins: int = 30) -> str:
    return bars_html([(f"{r['low']:.4g}", r["n"]) for r in histogram(frame, name, bins).collect()], name)


def categories_html(frame: Frame, name: str, top: int = 10) -> str:
    return bars_html(_pairs(category_counts(frame, name, top)), name)


def grouped_html(frame: Frame, group: str, value: str, top: int = 200) -> str:
    return bars_html(_pairs(folded(grouped_sums(frame, group, value), top)), f"{value} by {group}")


def pie_html(frame: Frame, name: str, label: str | None = None, top: int = PIE_TOP) -> str:
    """Shares as a ring of arcs."""
    pairs = [(a, abs(float(b or 0))) for a, b in _pairs(pie_shares(frame, name, label, top))]
    total, at, arcs = sum(b for _, b in pairs) or 1, 0.0, []
    around = 2 * math.pi * 80
    for i, (a, b) in enumerate(pairs):
        part = b / total * around
        text = f'<text x="240" y="{20 * i + 40}" fill="{_colour(i)}">{html.escape(str(a))} {b * 100 / total:.1f}%</text>'
        arcs.append(f'<circle cx="110" cy="130" r="80" fill="none" stroke="{_colour(i)}" stroke-width="50" stroke-dasharray="{part:.2f} {around:.2f}" stroke-dashoffset="{-at:.2f}"/>{text}')
        at += part
    return _page(name, pairs, "".join(arcs), max(260, 20 * len(pairs) + 60))


def stacked_html(frame: Frame, group: str, values: Sequence[str], top: int = 200) -> str:
    rows = stacked_sums(frame, group, values, top).collect()
    most = max((sum(abs(r[v] or 0) for v in values) for r in rows), default=0) or 1
    marks = [f'<text x="{220 + 120 * i}" y="34" fill="{_colour(i)}">{html.escape(v)}</text>' for i, v in enumerate(values)]
    for k, r in enumerate(rows):
        marks.append(f'<text x="0" y="{20 * k + 58}">{html.escape(str(r["label"]))}</text>')
        at = 220.0
        for i, v in enumerate(values):
            wide = abs(r[v] or 0) / most * 500
            marks.append(f'<rect x="{at:.1f}" y="{20 * k + 46}" width="{wide:.1f}" height="14" fill="{_colour(i)}"/>')
            at += wide
    return _page(group, [[r["label"], *(r[v] for v in values)] for r in rows], "".join(marks), 20 * len(rows) + 70)


def box_html(frame: Frame, names: Sequence[str]) -> str:
    found = five_numbers(frame, names)
    marks = []
    for k, (n, (low, q1, q2, q3, high)) in enumerate(found):
        x = lambda v, low=low, high=high: 220 + (v - low) / ((high - low) or 1) * 500
        y = 40 * k + 40
        marks.append(f'<text x="0" y="{y + 4}">{html.escape(n)}</text><path d="M{x(low):.1f} {y}H{x(q1):.1f}M{x(q3):.1f} {y}H{x(high):.1f}M{x(q2):.1f} {y - 9}V{y + 9}" stroke="#333"/><rect x="{x(q1):.1f}" y="{y - 9}" width="{x(q3) - x(q1):.1f}" height="18" fill="none" stroke="{_colour(k)}"/>')
    return _page("five numbers", found, "".join(marks), 40 * len(found) + 40)


def scatter_html(frame: Frame, x: str, y: str, by: str | None = None) -> str:
    """All points, those of one place as one mark at their mean, with their number in the data."""
    bounds, cells = point_cells(flat_points(frame, x, [y], by), *PIXELS)
    kinds = {k: i for i, k in enumerate(sorted({r["kind"] for r in cells}))}
    at = _scaled([(r["x"], r["y"]) for r in cells], bounds)
    marks = [f'<circle cx="{a:.1f}" cy="{b:.1f}" r="3" fill="{_colour(kinds[r["kind"]])}"/>' for (a, b), r in zip(at, cells)]
    marks += [f'<text x="620" y="{20 * i + 40}" fill="{_colour(i)}">{html.escape(k)}</text>' for k, i in kinds.items() if by]
    return _page(f"{y} by {x}", [[r["x"], r["y"], r["n"]] for r in cells], "".join(marks), 420)


def lines_html(frame: Frame, x: str, ys: Sequence[str]) -> str:
    bounds, rows = line_points(flat_points(frame, x, ys), 2 * PIXELS[0])
    marks = []
    for i, y in enumerate(ys):
        own = " ".join(f"{a:.1f},{b:.1f}" for a, b in _scaled([(r["x"], r["y"]) for r in rows if r["i"] == i], bounds))
        marks.append(f'<polyline points="{own}" fill="none" stroke="{_colour(i)}"/><text x="620" y="{20 * i + 40}" fill="{_colour(i)}">{html.escape(y)}</text>')
    return _page(f"lines by {x}", [[ys[r["i"]], r["x"], r["y"]] for r in rows], "".join(marks), 420)


def _scaled(pairs: Sequence[tuple[float, float]], bounds: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    x0, dx, y0, dy = bounds
    return [(20 + (a - x0) / dx * 580, 400 - (b - y0) / dy * 370) for a, b in pairs]


def _colour(i: int) -> str:
    return f"hsl({i * 137 % 360} 55% 45%)"


def _page(title: str, data, marks: str, height: int) -> str:
    """A page with an inline SVG; the data stand in it as JSON too."""
    text = json.dumps(data, default=str).replace("<", "\\u003c")
    return f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><svg xmlns="http://www.w3.org/2000/svg" width="760" height="{height}" font-family="sans-serif" font-size="12"><text x="0" y="14">{html.escape(title)}</text>{marks}</svg><script type="application/json">{text}</script>'


def write_html(text: str, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def show_in_browser(text: str, path: str) -> bool:
    """Write a page and open it in the browser of this machine, if it has one."""
    import webbrowser
    from pathlib import Path

    return webbrowser.open(Path(write_html(text, path)).absolute().as_uri())
