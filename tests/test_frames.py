import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import functions as fn
from tessera.errors import ColumnNotFound, DuplicateColumn, EmptyData, TypeMismatch, WrongQuantile
from tessera.functions import col, lit
from tessera.operators import bindings, display, joins, pipeline, plots, stats, synthesis, tree
from tessera.operators.frame import Frame, by_index_range, by_name, by_name_property, by_name_range, by_property
from tessera.operators.grouping import frequencies, group_by, value_counts, value_proportions


@pytest.fixture(scope="module")
def agg12(spark):
    return Frame.from_columns(spark, {"test1": [1, 1, 1, 2, 2, 2, 3, 3, 3, 1, 1, 1], "test2": list(range(12, 0, -1)), "test3": list(range(1, 13))})


def by_key(frame, *cols):
    return sorted(tuple(r[c] for c in cols) for r in frame.rows())


def test_aggregations(agg12):
    t = col("test2")
    got = group_by(agg12, "test1").aggregate(fn.count(t).named("n"), fn.mean(t).named("mean"), fn.mean(t + t).named("twice"), fn.maximum(t + t).named("max"))
    assert by_key(got, "test1", "n", "mean", "twice", "max") == [(1, 6, 6.5, 13.0, 24), (2, 3, 8.0, 16.0, 18), (3, 3, 5.0, 10.0, 12)]
    assert group_by(agg12.filter_where(col("test1") > 9), "test1").aggregate(fn.count(t).named("n")).n_rows() == 0
    assert group_by(agg12.filter_where(col("test1") > 9)).aggregate(fn.count(t).named("n")).n_rows() == 0
    assert group_by(agg12).aggregate(fn.count(t).named("n")).rows() == [{"n": 12}]
    with pytest.raises(ColumnNotFound):
        group_by(agg12, "test0")


def test_aggregates_with_missing_values_and_ties(spark):
    f = Frame.from_columns(spark, {"g": ["a", "a", "a", None, None], "v": [2, None, 1, 5, 5], "m": [1, 2, 3, 4, 4]})
    v = col("v")
    got = group_by(f.sort_by("m"), "g").aggregate(
        fn.count(v).named("n"), fn.sum_maybe(v).named("s"), fn.minimum(v).named("lo"), fn.mode(col("m")).named("mode"),
        fn.collect(v).named("all"), fn.variance(col("m")).named("var"), fn.reduce(col("m"), F.lit(0).cast("long"), lambda a, x: a * 10 + x).named("digits"),
    )
    rows = {r["g"]: r for r in got.rows()}
    assert rows["a"] | {"g": 0} == {"g": 0, "n": 3, "s": 3, "lo": None, "mode": 3, "all": [1, None, 2], "var": 1.0, "digits": 123}
    assert rows[None]["n"] == 2 and rows[None]["mode"] == 4 and rows[None]["var"] == 0.0 and rows[None]["lo"] == 5
    nested = group_by(f, "g").aggregate(fn.maximum(fn.sum_(col("m"))).named("x")).rows()
    assert [r["x"] for r in nested] == [8, 8]


def test_single_value_variance(spark):
    f = Frame.from_columns(spark, {"x": [4.0]})
    assert stats.variance(f, "x") == 0 and stats.skewness(f, "x") == 0


def test_statistics(spark):
    odd = Frame.from_columns(spark, {"x": [179.94, 231.94, 839.06, 534.23, 248.94]})
    even = Frame.from_columns(spark, {"x": [179.94, 231.94, 839.06, 534.23, 248.94, 276.37]})
    assert stats.median(odd, "x") == 248.94 and stats.median(even, "x") == pytest.approx(262.655)
    assert stats.quantiles(odd, 2, "x") == [179.94, 248.94, 839.06]
    q = Frame.from_columns(spark, {"x": [3, 6, 7, 8, 8, 9, 10, 13, 15, 16, 20]})
    assert stats.quantiles(q, 4, "x") == [3, 7.5, 9, 14, 20]
    assert stats.quantiles(Frame.from_columns(spark, {"x": [3, 6, 7, 8, 8, 10, 13, 15, 16, 20]}), 4, "x") == [3, 7.25, 9, 14.5, 20]
    assert stats.inter_quartile_range(q, "x") == 6.5
    assert stats.skewness(Frame.from_columns(spark, {"x": [25, 28, 26, 30, 40, 50, 40]}), "x") == pytest.approx(0.566731633676, abs=1e-12)
    assert math.isnan(stats.skewness(Frame.from_columns(spark, {"x": [42.0] * 10}), "x"))
    assert stats.generic_percentile(Frame.from_columns(spark, {"s": ["b", "a", "d", "c"]}), 50, "s") == "b"
    assert stats.correlation(Frame.from_columns(spark, {"a": [1, 2, 3], "b": [2, 4, 6]}), "a", "b") == pytest.approx(1)
    assert stats.correlation(Frame.from_columns(spark, {"a": [1, None], "b": [2, 4]}), "a", "b") is None
    assert stats.mutual_information(Frame.from_columns(spark, {"a": [0, 0, 1, 1], "b": [0, 0, 1, 1]}), 2, "a", "b") == pytest.approx(math.log(2))
    for f, error in ((lambda: stats.quantiles(q, 1, "x"), WrongQuantile), (lambda: stats.percentile(q, 101, "x"), WrongQuantile), (lambda: stats.mean(q.filter_where(col("x") > 99), "x"), EmptyData), (lambda: stats.mean(Frame.from_columns(spark, {"s": ["a"]}), "s"), TypeMismatch)):
        with pytest.raises(error):
            f()


@pytest.mark.parametrize("bracket", [8, 50_000])
def test_exact_quantiles(spark, monkeypatch, bracket):
    """Equal to numpy's, with brackets that must be narrowed, ties, missing values and an empty column."""
    import numpy as np

    monkeypatch.setattr(stats, "BRACKET", bracket)
    rng = np.random.default_rng(4)
    wide, ties = rng.normal(size=6000), rng.integers(0, 7, 6000).astype(float)
    rows = [(float(a), float(b), None, float(a) if i % 3 else None) for i, (a, b) in enumerate(zip(wide, ties))]
    f = Frame(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4))
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = stats.exact_quantiles(f, [F.col(n) for n in "abcd"], points)
    assert got[2] is None
    for found, values in ((got[0], wide), (got[1], ties), (got[3], [r[3] for r in rows if r[3] is not None])):
        assert np.allclose(found, np.quantile(values, points), rtol=0, atol=1e-12)


def test_summarize_and_describe(spark):
    f = Frame.from_columns(spark, {"A": [1, 2], "B": [1, None], "s": ["x", "y"]})
    s = {r["Statistic"]: r for r in stats.summarize(f).collect()}
    assert list(s["Count"].asDict()) == ["Statistic", "A", "B"] and len(s) == 10
    assert (s["Mean"]["A"], s["Count"]["B"], s["25%"]["A"], s["StdDev"]["A"]) == (1.5, 1.0, 1.25, 0.71)
    assert [tuple(r) for r in f.describe_columns().collect()] == [("B", 1, 1, "bigint"), ("A", 2, 0, "bigint"), ("s", 2, 0, "string")]


def test_joins(spark):
    left = Frame.from_columns(spark, {"key": [f"K{i}" for i in range(6)], "A": [f"A{i}" for i in range(6)]})
    right = Frame.from_columns(spark, {"key": ["K0", "K1", "K2"], "B": ["B0", "B1", "B2"]})
    assert by_key(joins.inner_join(["key"], right, left), "key", "A", "B") == [(f"K{i}", f"A{i}", f"B{i}") for i in range(3)]
    assert [r["B"] for r in sorted(joins.left_join(["key"], right, left).rows(), key=lambda r: r["key"])] == ["B0", "B1", "B2", None, None, None]
    assert joins.right_join(["key"], right, left).columns == ["key", "B", "A"]
    staff = Frame.from_columns(spark, {"Name": ["Kelly", "Sally", "James"], "Role": ["a", "b", "c"]})
    student = Frame.from_columns(spark, {"Name": ["James", "Mike", "Sally"], "School": ["x", "y", "z"]})
    full = joins.join("full_outer", ["Name"], student, staff)
    assert sorted((r["Name"], r["Role"], r["School"]) for r in full.rows()) == [("James", "c", "x"), ("Kelly", "a", None), ("Mike", None, "y"), ("Sally", "b", "z")]
    a = Frame.from_columns(spark, {"k": [1, None, 1], "v": [1, 2, 3]})
    b = Frame.from_columns(spark, {"k": [1, None, 4], "v": [7, 8, 9]})
    assert sorted((r["v"], r["Right_v"]) for r in joins.inner_join(["k"], b, a).rows()) == [(1, 7), (2, 8), (3, 7)]
    assert joins.full_outer_join(["k"], a, a).n_rows() == 5
    odd = Frame.from_columns(spark, {"k": [1], "__k_k": ["mine"], "__k_z": [5]})
    assert {"k": 1, "v": 1, "__k_k": "mine", "__k_z": 5} in joins.inner_join(["k"], odd, a).rows()
    for bad in ((["nope"], ColumnNotFound), ([], ValueError)):
        with pytest.raises(bad[1]):
            joins.inner_join(bad[0], b, a)


def test_merging(spark):
    a = Frame.from_columns(spark, {"A": [1, 2], "B": ["a", "b"]})
    c = Frame.from_columns(spark, {"A": [3], "C": [True]})
    assert a.union(c).select("A", "B", "C").rows() == [{"A": 1, "B": "a", "C": None}, {"A": 2, "B": "b", "C": None}, {"A": 3, "B": None, "C": True}]
    assert a.union(Frame.empty(spark)).equals(a) and Frame.empty(spark).union(a).equals(a)
    assert a.union(c.filter_where(col("A") > 9)).columns == ["A", "B"]
    clash = a.union(Frame.from_columns(spark, {"A": ["x"]}))
    assert [(r["A"]["left"], r["A"]["right"]) for r in clash.rows()] == [(1, None), (2, None), (None, "x")]
    wide = a.beside(Frame.from_columns(spark, {"B": ["z"], "R": ["r"]}))
    assert wide.columns == ["A", "B", "R"] and wide.rows() == [{"A": 1, "B": "z", "R": "r"}, {"A": 2, "B": None, "R": None}]
    assert a.insert("n", [5], default=0).values("n") == [5, 0]
    assert a.insert("n", [1, 2, 3]).rows() == [{"A": 1, "B": "a", "n": 1}, {"A": 2, "B": "b", "n": 2}, {"A": None, "B": None, "n": 3}]


@pytest.fixture
def spread(spark):
    """Eight shuffle partitions that are never merged."""
    keys = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield Frame(spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("x"), (F.col("id") % 11).alias("g")).repartition(6))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_positions_over_partitions(spread, spark):
    from tessera.operators.frame import POSITION

    want = sorted(i * 7919 % 5003 for i in range(5000))
    up, down = spread.sort_by("x"), spread.sort_by(("x", False))
    for f, order in ((up, want), (down, want[::-1])):
        assert f.df.rdd.getNumPartitions() > 1
        assert [tuple(r) for r in f.positions().select(POSITION, "x").collect()] == list(enumerate(order))
        assert f.apply_at_index(3210, lambda c: -c, "x").values("x") == [*order[:3210], -order[3210], *order[3211:]]
        assert f.insert("n", order[:4000], default=-1).select("x", "n").rows() == [{"x": x, "n": x if i < 4000 else -1} for i, x in enumerate(order)]
        assert f.row_value(77, "x") == order[77]
    both = up.beside(down.rename("x", "y").select("y")).select("x", "y").rows()
    assert both == [{"x": a, "y": b} for a, b in zip(want, want[::-1])]
    groups = group_by(spread, "g").aggregate(fn.count(col("x")).named("n"))  # rows of a shuffle without any sort
    assert sorted(r[POSITION] for r in groups.positions().collect()) == list(range(11))
    assert sorted(groups.drop_last(4).values("g") + groups.take_last(4).values("g")) == list(range(11))
    assert up.equals(spread.sort_by("x")) and not up.equals(down) and not up.equals(up.take(10)) and up.equals(down.sort_by("x"))
    with pytest.raises(EmptyData):
        up.row_value(5000, "x")


def test_descending_collect_and_reduce(spark):
    f = Frame.from_columns(spark, {"g": [1, 1, 1, 1, 2], "k": [2, None, 3, 1, 5], "s": ["b", None, "c", "a", "z"], "v": [10, 20, 30, 40, 50]})
    for key in ("k", "s"):
        for up, want in ((True, [20, 40, 10, 30]), (False, [30, 10, 40, 20])):
            g = group_by(f.sort_by((key, up)), "g").aggregate(fn.collect(col("v")).named("all"), fn.reduce(col("v"), F.lit("").cast("string"), lambda a, x: F.concat(a, F.lit("."), x.cast("string"))).named("text"))
            row = {r["g"]: r for r in g.rows()}[1]
            assert row["all"] == want[::-1] and row["text"] == "." + ".".join(map(str, want))
            assert "Sort" not in g.df._jdf.queryExecution().optimizedPlan().toString()
    ties = Frame(spark.range(100).repartition(1).select("id", (F.col("id") % 2).alias("k"))).sort_by(("k", False))
    got = group_by(ties).aggregate(fn.collect(col("id")).named("all")).rows()[0]["all"]
    assert got[::-1] == [*range(1, 100, 2), *range(0, 100, 2)]


def test_sorting(spark):
    f = Frame.from_columns(spark, {"a": [2, None, 1, 2], "b": [1, 2, 3, 4]})
    assert f.sort_by("a", ("b", False)).values("b") == [2, 3, 4, 1]
    assert f.sort_by(("a", False), "b").values("b") == [1, 4, 3, 2]
    with pytest.raises(ColumnNotFound):
        f.sort_by("c")


def test_projection(spark):
    f = Frame.from_columns(spark, {"id": [1, 2], "x1": [1.5, 2.5], "x2": [1, 2], "s": ["a", "b"]})
    assert f.select("s", "id", "s").columns == ["s", "id"] and f.exclude("s", "nope").columns == ["id", "x1", "x2"]
    assert f.select_by(by_name("s"), by_property(lambda x: isinstance(x.dataType, T.DoubleType))).columns == ["x1", "s"]
    assert f.select_by(by_name_range("x1", "x2")).columns == ["x1", "x2"] and f.select_by(by_index_range(0, 1)).columns == ["id", "x1"]
    assert f.select_by(by_name_property(lambda n: n.startswith("x"))).columns == ["x1", "x2"]
    assert f.select().columns == []
    assert f.cube(1, 2).rows() == [{"id": 1, "x1": 1.5}]
    assert f.clone_column("id", "again").values("again") == [1, 2]
    assert f.apply_at_index(1, lambda c: c * 10, "id").values("id") == [1, 20]
    assert f.apply_where(lambda c: c == "a", "s", lambda c: c + 5, "x2").values("x2") == [6, 2]
    assert isinstance(f.safe_apply(lambda c: c, "nope"), ColumnNotFound)
    assert isinstance(f.rename_safe("id", "s"), DuplicateColumn) and f.rename_safe("id", "key").columns[0] == "key"
    with pytest.raises(DuplicateColumn):
        f.rename("id", "s")
    with pytest.raises(TypeMismatch):
        f.apply_int(lambda c: c, "s")
    e, g = f.derive_with_expr("y", col("x1") * 2.0)
    assert g.derive("w", e + 1.0).values("w") == [4.0, 6.0] and g.derived["y"].same(col("x1") * 2.0)
    assert f.derive_many((col("id") + 1).named("id"), col("id").named("old")).select("id", "old").rows()[0] == {"id": 2, "old": 1}


def test_optional_filters_and_imputation(spark):
    f = Frame.from_columns(spark, {"a": [1, None, None], "b": [None, None, 2], "c": [1, 2, 3]})
    assert f.filter_just("a").n_rows() == 1 and f.filter_nothing("a").n_rows() == 2 and f.filter_nothing("c").n_rows() == 3
    assert f.filter_all_nothing().n_rows() == 1 and f.filter_all_just().n_rows() == 0
    assert f.impute("a", 9).values("a") == [1, 9, 9] and f.impute_with("b", fn.mean(col("b"))).values("b") == [2, 2, 2]
    assert f.impute("a", 9).is_numeric("a") and not f.is_numeric("a")
    assert f.has_missing("a") and not f.all_missing("a") and not f.has_missing("c")


frames = st.tuples(st.integers(0, 30), st.integers(-3, 40), st.integers(-3, 40))


@given(frames)
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_subset_laws(spark, case):
    n, k, j = case
    for f in (Frame(spark.range(n).repartition(1)), Frame(spark.range(n)).sort_by(("id", False))):
        rows = f.values("id")
        held = min(max(k, 0), n)
        assert f.take(k).values("id") == rows[:held]
        assert sorted(f.take_last(k).values("id")) == sorted(rows[n - held :])
        assert sorted(f.drop(k).values("id")) == sorted(rows[held:])
        assert sorted(f.drop_last(k).values("id")) == sorted(rows[: n - held])
        assert sorted(f.slice(k, j).values("id")) == sorted(rows[max(k, 0) : max(j, 0)])
        assert f.cube(k, 1).dimensions() == (held, 1)


def test_sampling(spark):
    f = Frame(spark.range(3000))
    a, b = f.random_split(3, 0.25)
    assert a.n_rows() + b.n_rows() == 3000 and abs(a.n_rows() - 750) < 120 and a.df.intersect(b.df).count() == 0
    folds = f.k_folds(3, 4)
    assert sum(x.n_rows() for x in folds) == 3000 and len(folds) == 4 and all(600 < x.n_rows() < 900 for x in folds)
    assert abs(f.sample(1, 0.5).n_rows() - 1500) < 150 and f.sample(1, 0.0).n_rows() == 0
    assert sorted(f.shuffle(2).values("id")) == list(range(3000)) and f.shuffle(2).values("id") != list(range(3000))


def test_counts(spark):
    f = Frame.from_columns(spark, {"s": ["b", "a", "b", None]})
    assert [tuple(r) for r in value_counts(f, col("s")).collect()] == [(None, 1), ("a", 1), ("b", 2)]
    assert [r["proportion"] for r in value_proportions(f, col("s")).collect()] == [0.25, 0.25, 0.5]
    wide = {r["Statistic"]: r for r in frequencies(f, col("s")).collect()}
    assert wide["Count"]["b"] == "2" and wide["Percentage (%)"]["a"] == "25.00%"


def test_extraction(spark):
    f = Frame.from_columns(spark, {"a": [1, 2], "b": [0.5, None]})
    assert f.matrix().tolist()[0] == [1.0, 0.5] and math.isnan(f.matrix()[1, 1]) and f.select("a").tensor("long").tolist() == [1, 2]
    assert Frame.from_columns(spark, {"x": [0.5, 1.5, 2.5]}).vector("x", "long").tolist() == [0, 2, 2]
    assert f.head_column("a") == 1
    wide = Frame(spark.range(500).repartition(4).select("id", (F.col("id") * 2).alias("twice")))
    assert all(2 * a == b for a, b in wide.matrix("long"))
    with pytest.raises(TypeMismatch):
        f.vector("b", "long")
    with pytest.raises(TypeMismatch):
        Frame.from_rows(spark, ["a"], [[1], ["x"]])


def test_pipeline(spark):
    f = Frame.from_columns(spark, {"a": [1, 2, None], "b": [1.0, 2.0, 3.0]})

    def steps(p):
        a = p.impute(col("a"), 7)
        twice = p.derive("twice", a * 2)
        p.filter_where(twice > 2)
        p.rename(twice, "double")
        return p.inspect(lambda x: x.n_rows())

    n, g = pipeline.run(f, steps)
    assert n == 2 and g.values("double") == [4, 14] and pipeline.eval_(f, steps) == 2


@pytest.mark.parametrize("name,want", [("Data", "_data_"), ("My Data", "my_data"), ("Distance (km/h)", "distance_km_h"), ("0 Age", "_0_age_"), ("camelCase$Str", "camelcase_str"), ("***", "_____")])
def test_sanitize(name, want):
    assert bindings.sanitize(name) == want


def test_bindings_and_display(spark):
    f = Frame.from_columns(spark, {"My Data": [1, None]})
    assert bindings.columns(f, "t").t_my_data.same(col("My Data"))
    assert display.to_markdown(f).splitlines()[2:] == ["| 1 |", "|  |"] and "bigint?" in display.show(f)


def test_plots(spark):
    f = Frame.from_columns(spark, {"x": [0.0, 1.0, 2.0, 10.0], "y": [1.0, 2.0, 3.0, 4.0], "s": ["a", "b", "a", "c"]})
    assert [(r["bin"], r["n"]) for r in plots.histogram(f, "x", 5).collect()] == [(0, 2), (1, 1), (4, 1)]
    assert [tuple(r) for r in plots.category_counts(f, "s", 1).collect()] == [("a", 2), ("Other (2 items)", 2)]
    assert [tuple(r) for r in plots.category_counts(f, "s", 5).collect()] == [("a", 2), ("b", 1), ("c", 1)]
    many = Frame(spark.range(1000).select(F.when(F.col("id") < 980, "big").otherwise(F.concat(F.lit("s"), "id")).alias("s")))
    assert {r[0]: round(r[1], 6) for r in plots.market_share(many, "s").collect()} == {"big": 98.0, "Others": 2.0}
    assert plots.smart_top(7) == 7 and plots.smart_top(15) == 12 and plots.smart_top(40) == 10
    for text in (plots.plot_histogram(f, "x"), plots.plot_bars(f, "s"), plots.plot_scatter(f, "x", "y", "s"), plots.plot_lines(f, "x", ["y"]), plots.plot_box(f, ["x"]), plots.plot_pie(f, "s"), plots.plot_heatmap(f), plots.plot_correlation_matrix(f), plots.plot_grouped_bars(f, "s", "x"), plots.plot_stacked_bars(f, "s", ["x", "y"]), plots.plot_categorical_summary(f), plots.plot_all_histograms(f), plots.plot_smart_bars(f, "s"), plots.plot_market_share(f, "s")):
        assert text.strip()
    assert "<svg" in plots.categories_html(f, "s") and "&lt;" in plots.bars_html([("<b>", 1)], "t")


def test_synthesis(spark):
    f = Frame.from_columns(spark, {"a": [1.0, 2.0, 3.0, 4.0, 5.0], "b": [2.0, 1.0, 4.0, 3.0, 7.0], "y": [2.0, 2.0, 12.0, 12.0, 35.0], "c": [0, 0, 1, 1, 1]})
    best = synthesis.synthesize_feature(f.exclude("c"), "y", synthesis.BeamConfig(depth=1, beam=20))
    assert synthesis.satisfies(f, best, "y")
    got = synthesis.fit_regression(f.exclude("c"), "y", depth=1, beam=20)
    assert synthesis.satisfies(f, got, "y", 1e-6)
    marked = f.derive("p", synthesis.fit_classifier(f.exclude("y"), "c", depth=1, beam=20))
    assert synthesis.f1_from_binary(marked, "c", "p") == 1.0
    assert synthesis.round_significant(123.4) == 120 and synthesis.round_significant(0.0456) == 0.046


def test_tree(spark):
    rows = [(i, (i * 7) % 10, "a" if i > 30 else "b" if (i * 7) % 10 > 5 else "c") for i in range(60)]
    f = Frame.from_rows(spark, ["x", "y", "label"], rows)
    model = tree.fit_tree(f, "label")
    assert tree.loss(f, "label", model) < 0.1 and tree.depth(model) <= 4
    assert f.derive("p", tree.prune(tree.to_expr(model))).n_rows() == 60
    assert tree.majority({"a": 2, "b": 2}) == "b" and tree.gini({"a": 0, "b": 0}) == 0 and tree.gini({"a": 3, "b": 3}) == pytest.approx(0.5)
    one = tree.fit(f.filter_where(col("label") == "a"), "label")
    assert f.derive("p", one).values("p")[0] == "a"
    with pytest.raises(TypeMismatch):
        tree.fit(Frame(spark.range(2000).select("id", (F.col("id") * 2).alias("label"))), "label")


def test_tree_counts_equal_brute_force(spark):
    """What one job counts for every test is what each test gives by itself."""
    rows = [((i * 7) % 11 - 5.0 if i % 9 else None, float(i % 4), "u" if i % 3 else "v", i % 2 == 0, int(i % 5 == 0)) for i in range(80)]
    f = Frame(spark.createDataFrame(rows, "x double, y double, s string, b boolean, label int").repartition(3))
    config = tree.TreeConfig(percentiles=(0, 25, 50, 100))
    tried = tree.candidates(f, "label", config)
    tests = tried.tests()
    assert {2 + 2 * 4} == {len(tree.numeric_terms(f, config.tests, "label"))} and any(t.symbol == "is_nothing" for t in tests)
    xs = sorted(r[0] for r in rows if r[0] is not None)
    assert dict((repr(e), v) for e, v in tried.terms)["x"] == sorted({xs[min(len(xs) - 1, p * len(xs) // 100)] for p in config.percentiles})
    own, coded = tree._counts(f, F.lit(0), F.col("label"), tried, 2)
    assert own[0].tolist() == [64, 16]
    got = tried.held(coded[0])
    want = f.df.agg(*(F.count_if(F.coalesce(f.compile(t), F.lit(False)) & (F.col("label") == k)).alias(f"c{i}_{k}") for i, t in enumerate(tests) for k in (0, 1))).first()
    assert [[want[f"c{i}_{k}"] for k in (0, 1)] for i in range(len(tests))] == got.tolist()
    some = tests[::17][:4]
    both = tree._combined(f, F.lit(0), F.col("label"), {0: some}, 2, 3)[0]
    assert len(both) == 4 + 4 * 3 * 2 + 4 * 3 * 2 * 4 * 2
    for e, counts in both[::9]:
        r = f.df.agg(*(F.count_if(F.coalesce(f.compile(e), F.lit(False)) & (F.col("label") == k)) for k in (0, 1))).first()
        assert list(r) == counts.tolist()


def test_tree_terms_and_combinations(spark):
    """A product of columns decides; a pair of tests decides where arithmetic is off."""
    rows = [(float(i % 9 - 4), float(i // 9 - 4), int((i % 9 - 4) * (i // 9 - 4) > 0)) for i in range(81)]
    f = Frame(spark.createDataFrame(rows, "x double, y double, label int"))
    model = tree.fit_tree(f, "label")
    assert tree.loss(f, "label", model) < 0.05 and "x * y" in repr(tree.to_expr(model))
    apart = tree.TestConfig(disallowed=(("x", "y"),))
    assert not any("x" in repr(e) and "y" in repr(e) for e in tree.candidates(f, "label", tree.TreeConfig(tests=apart)).tests())
    corner = Frame(spark.createDataFrame([(x, y, int(x > 0 and y > 0)) for x, y, _ in rows], "x double, y double, label int"))
    one = tree.fit_tree(corner, "label", tree.TreeConfig(max_depth=1, tests=tree.TestConfig(arithmetic=False, cross=False)))
    assert tree.loss(corner, "label", one) < 0.1 and any(s in repr(tree.to_expr(one)) for s in ("&&", "||"))


def test_whole_tables_are_joined(spark, tmp_path):
    """No cut by id: rows of high ids and the frequent missing key come out too."""
    import __spark_entry__ as entry

    spark.createDataFrame([(i, i % 3 + 1, float(i)) for i in range(1000, 1010)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 5.0), (700, 1.0), (707, 2.0), (999, 3.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1,), (2,), (3,), (4,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    rows = {tuple(r[c] for c in ("k", "x", "n", "owed")) for r in entry.queries()["full_outer_join_null_keys"](spark, str(tmp_path)).collect()}
    keyed = [(None if i % 5 == 0 else i % 3 + 1, i) for i in range(1000, 1010)]
    right = {None: (2, 3.0), 1: (1, 5.0)}
    assert rows == {(k, x, *right.get(k, (None, None))) for k, x in keyed} | {(999, None, 1, 3.0)}
    got = sorted(tuple(r) for r in entry.queries()["impute_mean"](spark, str(tmp_path)).collect())
    assert got == sorted([(i % 3 + 1, float(i)) for i in range(1000, 1010)] + [(4, 1004.5)])


def test_extraction_lies_on_disk(spark):
    """Columns, rows and matrices come by partition and in order, and aren't held in memory."""
    import tracemalloc

    import numpy as np

    n = 300_000
    f = Frame(spark.range(n, numPartitions=7).select("id", F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("half"), F.concat(F.lit("s"), "id").alias("s")))
    tracemalloc.start()
    cells, rows, m = f.values("id"), f.select("id", "half").rows(), f.select("id", "half").matrix()
    assert tracemalloc.get_traced_memory()[1] < 6_000_000  # the lists took over 9 MB a column, the matrix 5 MB
    tracemalloc.stop()
    assert len(cells) == len(rows) == n and cells[-1] == n - 1 and cells[5000:5002] == [5000, 5001] and sum(cells) == n * (n - 1) // 2
    assert rows[4] == {"id": 4, "half": 2.0} and rows[3]["half"] is None
    assert m.shape == (n, 2) and m[:, 0].tolist() == list(range(n)) and np.isnan(m[::3, 1]).all() and m[7, 1] == 3.5
    down = f.sort_by(("id", False))
    assert down.values("s")[:2] == [f"s{n - 1}", f"s{n - 2}"] and down.vector("id", "long")[0] == n - 1 and down.values("id") != cells
    m[0, 0] = 5.0  # the host's own copy
    assert m[0, 0] == 5.0 and f.take(0).values("id") == [] and f.take(0).matrix().shape == (0, 3)
    import datetime

    kinds = Frame(spark.sql("SELECT DATE '2024-02-03' AS d, TIMESTAMP '2024-02-03 04:05:06' AS t, 1.50BD AS n, named_struct('a', 1) AS s, array(1, NULL) AS l, CAST('x' AS binary) AS b"))
    assert kinds.rows() == [r.asDict() for r in kinds.df.collect()] and kinds.values("d") == [datetime.date(2024, 2, 3)]
    with pytest.raises(IndexError):
        cells[n]


def test_programs_equal_spark(spark):
    """What numpy makes of a beam is what Spark's columns are, missing values, NaN and infinities too."""
    import numpy as np

    odd = [0.0, -0.0, 1.0, -2.5, 3.25, None, math.nan, math.inf, -math.inf, 1e7]
    f = Frame(spark.createDataFrame([(a, b) for a in odd for b in odd], "a double, b double").repartition(1))
    base = [fn.to_double(col("a")), fn.to_double(col("b")), lit(2.0)]
    exprs = synthesis.grow(base, base, True)
    exprs += synthesis.grow(base[:2], exprs[:60:7], False)[::5]
    program = synthesis._Program(exprs)
    assert len(exprs) > 120 and {repr(e) for e in program.leaves} == {"to_double(a)", "to_double(b)"}
    got = f.df.select(*(f.compile(e).cast("double").alias(f"x{i}") for i, e in enumerate([*program.leaves, *exprs]))).collect()
    columns = [(np.array([0.0 if r[i] is None else r[i] for r in got]), np.array([r[i] is None for r in got])) for i in range(2)]
    with np.errstate(all="ignore"):
        for k, (e, (x, null)) in enumerate(zip(exprs, program.run(columns))):
            for r, v, lost in zip(got, x, np.zeros(len(got), bool) if null is None else null):
                want = r[k + 2]
                assert lost if want is None else not lost and (math.isnan(v) if math.isnan(want) else v == pytest.approx(want, rel=1e-12, abs=0)), (e, tuple(r[:2]), v, want)


def test_measures_equal_spark(spark):
    """Scores of a beam are those of Spark's aggregates, one program for many expressions."""
    f = Frame(spark.range(9000).select((F.col("id") % 97 / 7).alias("a"), (F.col("id") * 31 % 101 - 40).cast("int").alias("b"), F.when(F.col("id") % 50 > 0, F.col("id") % 11 - 4.5).alias("y"), F.lit(0.1).alias("c")))
    base = [fn.to_double(col(n)) for n in "abc"]
    exprs = [*base, *synthesis.grow(base, base, False)]
    y = F.col("y")
    assert len(exprs) > 50
    for loss in synthesis.Loss:
        got = {repr(e): s for e, s, _ in synthesis._measure(f, exprs, y, loss)}
        xs = {repr(e): f.compile(e).cast("double") for e in exprs}
        fine = f.df.agg(*(F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias(k) for k, x in xs.items())).first()
        aggs = {}
        for k, x in xs.items():
            tp, fp, miss = F.count_if((x > 0) & (y > 0)), F.count_if((x > 0) & ~(y > 0)), F.count_if(~(x > 0) & (y > 0))
            aggs[k] = fn.correlation(x, y) ** 2 if loss is synthesis.Loss.PEARSON else -F.avg((x - y) * (x - y)) if loss is synthesis.Loss.MSE else 2 * tp / (2 * tp + fp + miss)
        want = {}
        for s in range(0, len(aggs), 20):
            want |= f.df.agg(*(v.alias(k) for k, v in list(aggs.items())[s : s + 20])).first().asDict()
        want = {k: v for k, v in want.items() if not fine[k] and v is not None and math.isfinite(v)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items())


def test_generic_percentiles_hold_no_column(spark):
    """Places are found by counts of values, not by sorting up to the place in one task."""
    f = Frame(spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") * 7919 % 613)).alias("s"), (F.col("id") * 31 % 5003 / 4).alias("x")))
    asked = (0, 1, 14, 25, 50, 75, 99.5, 100)
    for name in ("s", "x"):
        rows = sorted((r[0] for r in f.df.select(name).collect()), key=lambda v: (v is not None, v))
        assert stats.generic_percentiles(f, asked, name) == [rows[math.floor(p / 100 * 19_999)] for p in asked]
    with pytest.raises(EmptyData):
        stats.generic_percentile(f.take(0), 50, "s")


def test_plots_show_all_points(spark):
    """No sample: every point counts in its cell, and lines keep the turns of every column."""
    import json

    n = 7000
    f = Frame(spark.range(n).select("id", F.when(F.col("id") == 4321, 1000.0).when(F.col("id") == 17, float("nan")).when(F.col("id") != 18, F.col("id") % 10 * 1.0).alias("y"), (F.col("id") % 2).alias("k")))
    assert plots.points(f, "id", ["y"]).count() == n
    data = lambda page: json.loads(page.split('application/json">')[1].split("</script>")[0])
    cells = data(plots.scatter_html(f, "id", "y"))
    assert sum(c[2] for c in cells) == n - 2 and [4321.0, 1000.0, 1] in cells and len(cells) < 600
    assert sum(c[2] for c in data(plots.scatter_html(f, "id", "y", "k"))) == n - 2
    lines = data(plots.lines_html(f, "id", ["y"]))
    assert ["y", 4321.0, 1000.0] in lines and ["y", 0.0, 0.0] in lines and ["y", 6999.0, 9.0] in lines and len(lines) <= 4 * 580
    assert [r[1] for r in lines] == sorted(r[1] for r in lines)
    top = plots.plot_scatter(f, "id", "y").splitlines()
    assert len(top) == 18 and top[0].strip() == "•" and top[0].index("•") == int(4321 / 6999 * 59) and len(top[-1]) == 60
    small = Frame.from_columns(spark, {"x": [0.0, 1.0, 1.0, 1.0], "y": [0.0, 2.0, 2.0, 2.0], "s": ["p", "q", "r", "r"]})
    assert plots.plot_scatter(small, "x", "y", "s").splitlines()[0][-1] == "c"
    with pytest.raises(EmptyData):
        plots.plot_scatter(f.take(0), "id", "y")
