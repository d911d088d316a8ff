import math

import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.errors import ColumnNotFound, MixedAggregation, NotOptional, Unaggregated
from tessera.functions import col, lit
from tessera.functions.expr import aggregates_of, columns_of, normalize, pretty, replace, size
from tessera.operators.frame import Frame
from tessera.operators.grouping import group_by


def one(spark, e, **cells):
    types = {k: "long" if isinstance(v, int) and not isinstance(v, bool) else None for k, v in cells.items()}
    f = Frame.from_columns(spark, {k: [v] for k, v in cells.items()}, {k: t for k, t in types.items() if t})
    return f.derive("out", e).values("out")[0]


def test_division_and_logarithms_are_ieee(spark):
    f = Frame.from_columns(spark, {"a": [1.0, -1.0, 0.0, 6.0, None], "b": [0.0, 0.0, 0.0, 4.0, 1.0]})
    got = f.derive("q", col("a") / col("b")).values("q")
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:] == [1.5, None]
    logs = f.derive("l", fn.log(col("a"))).values("l")
    assert logs[0] == 0 and math.isnan(logs[1]) and logs[2] == -math.inf and logs[4] is None
    assert one(spark, fn.log_base(2.0, col("x")), x=8.0) == pytest.approx(3)


@pytest.mark.parametrize("a", [-7, -6, 0, 6, 7])
@pytest.mark.parametrize("b", [-3, 3])
def test_div_and_mod_floor(spark, a, b):
    assert one(spark, col("a") // b, a=a) == a // b
    assert one(spark, col("a") % b, a=a) == a % b


def test_power_keeps_the_type(spark):
    assert one(spark, col("a") ** 3, a=-4) == -64
    assert one(spark, col("a") ** 0, a=5) == 1
    assert one(spark, col("x") ** 2, x=1.5) == 2.25
    with pytest.raises(ValueError):
        one(spark, col("a") ** -1, a=2)


def test_comparisons_of_missing_values_are_two_valued(spark):
    f = Frame.from_columns(spark, {"a": [None, None, 1, 2], "b": [None, 1, None, 1]})
    names = {"==": col("a") == col("b"), "/=": col("a") != col("b"), "<": col("a") < col("b"), "<=": col("a") <= col("b"), ">": col("a") > col("b"), ">=": col("a") >= col("b")}
    got = {k: f.derive("o", e).values("o") for k, e in names.items()}
    assert got == {
        "==": [True, False, False, False], "/=": [False, True, True, True], "<": [False, True, False, False],
        "<=": [True, True, False, False], ">": [False, False, True, True], ">=": [True, False, True, True],
    }
    assert f.filter_where(col("a") < 2).n_rows() == 3
    assert f.derive("m", fn.min_(col("a"), col("b"))).values("m") == [None, None, None, 1]
    assert f.derive("m", fn.max_(col("a"), col("b"))).values("m") == [None, 1, 1, 2]


def test_required_columns_compile_without_guards(spark):
    f = Frame(spark.range(10)).filter_where(col("id") == 3)
    plan = f.df._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan and f.n_rows() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS twice", "'x' AS pad").write.parquet(f"{tmp_path}/t")
    f = Frame(spark.read.parquet(f"{tmp_path}/t")).filter_where((col("id") > 90) & (col("twice") < 190)).select("id")
    plan = f.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(id,90)" in plan and "LessThan(twice,190)" in plan
    assert "pad" not in plan.split("ReadSchema")[1]


def test_missing_value_helpers(spark):
    f = Frame.from_columns(spark, {"a": [None, 4], "s": ["x,y", ""]})
    g = f.derive_many(
        fn.from_maybe(7, col("a")).named("d"), fn.is_just(col("a")).named("j"), fn.is_nothing(col("a")).named("n"),
        fn.when_present(lambda x: x * 2, col("a")).named("p"), fn.when_both_present(lambda x, y: x + y, col("a"), lit(1)).named("b"),
        fn.first_or_nothing(fn.split_on(",", col("s"))).named("first"), fn.last_or_nothing(fn.split_on(",", col("s"))).named("last"),
    )
    assert g.select("d", "j", "n", "p", "b", "first", "last").rows() == [
        {"d": 7, "j": False, "n": True, "p": None, "b": None, "first": "x", "last": "y"},
        {"d": 4, "j": True, "n": False, "p": 8, "b": 5, "first": "", "last": ""},
    ]
    with pytest.raises(Exception, match="missing value"):
        f.derive("x", fn.from_just(col("a"))).values("x")
    assert "d" in g.required and "p" not in g.required


def test_strings_and_dates(spark):
    f = Frame.from_columns(spark, {"s": ["a1b22", "none", None], "d": ["2024-02-29", "2023-02-29", "x"], "p": ["a.b", "a|b", ""]})
    assert f.derive("m", fn.match("[0-9]+", col("s"))).values("m") == ["1", None, None]
    assert f.derive("m", fn.match_all("[0-9]+", col("s"))).values("m") == [["1", "22"], [], None]
    days = f.derive("t", fn.parse_date("%Y-%m-%d", col("d"))).values("t")
    assert str(days[0]) == "2024-02-29" and days[1:] == [None, None]
    assert f.derive("p", fn.split_on(".", col("p"))).values("p") == [["a", "b"], ["a|b"], [""]]
    assert f.derive("p", fn.split_on("|", col("p"))).values("p")[1] == ["a", "b"]
    assert fn.java_pattern("%d/%m/%Y at %H:%M") == "dd/MM/yyyy 'at' HH:mm"


def test_recode(spark):
    f = Frame.from_columns(spark, {"a": [1, 2, None]})
    assert f.derive("r", fn.recode([(1, "one"), (1, "again")], col("a"))).values("r") == ["one", None, None]
    assert f.derive("r", fn.recode_with_default("?", [(2, "two")], col("a"))).values("r") == ["?", "two", "?"]
    assert f.derive("r", fn.recode_with_condition(0, [(lambda x: x > 1, 9)], col("a"))).values("r") == [0, 9, 0]


def test_aggregates_are_broadcast_in_rows(spark):
    f = Frame.from_columns(spark, {"A": list(range(1, 11))})
    assert f.derive("s", fn.sum_(col("A"))).values("s") == [55] * 10
    assert f.filter_where(fn.to_double(col("A")) > fn.mean(col("A"))).n_rows() == 5
    z = f.derive("z", fn.z_score(col("A"))).values("z")
    assert sum(z) == pytest.approx(0) and z[0] == pytest.approx(-4.5 / 3.0276503540974917)


def test_tree_utilities():
    e = (col("b") + col("a")) * lit(2) / fn.sum_(col("c"))
    assert pretty(e) == "(b + a) * 2 / sum(c)"
    assert normalize(col("b") + col("a")).same(col("a") + col("b"))
    assert not normalize(col("b") / col("a")).same(col("a") / col("b"))
    assert size(e) == 8 and columns_of(e) == ["b", "a", "c"] and len(aggregates_of(e)) == 1
    assert replace(e, col("a"), lit(1)).same((col("b") + lit(1)) * lit(2) / fn.sum_(col("c")))
    assert not fn.min_(col("a"), col("b")).same(fn.max_(col("a"), col("b")))
    with pytest.raises(TypeError):
        bool(col("a") == 1)


def test_errors(spark):
    f = Frame.from_columns(spark, {"population": [1, 2]})
    with pytest.raises(ColumnNotFound, match="Did you mean 'population'"):
        f.select("popluation")
    with pytest.raises(ColumnNotFound):
        f.derive("x", col("nope"))
    with pytest.raises(Unaggregated):
        group_by(f, "population").aggregate((col("population") + 1).named("x"))
    with pytest.raises(MixedAggregation):
        group_by(f, "population").aggregate((col("population") + fn.sum_(col("population"))).named("x"))
    with pytest.raises(NotOptional):
        f.impute("population", 0)


def test_host_functions(spark):
    f = Frame.from_columns(spark, {"a": [1, 2, 3], "g": ["x", "x", "y"]})
    assert f.derive("d", fn.lift1(lambda s: s * 10, col("a"), "long")).values("d") == [10, 20, 30]
    assert f.derive("d", fn.lift2(lambda a, b: a + b, col("a"), col("a"), "long", symbol="plus")).values("d") == [2, 4, 6]
    got = group_by(f, "g").aggregate(fn.aggregate_with(lambda s: float(s.max()), col("a")).named("m")).rows()
    assert {r["g"]: r["m"] for r in got} == {"x": 2.0, "y": 3.0}
    assert f.derive("b", fn.bind(lambda x: F.array(x, x), fn.split_on(",", lit("p,q")))).values("b")[0] == ["p", "p", "q", "q"]
