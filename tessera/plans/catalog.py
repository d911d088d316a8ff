"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.functions import col, lit
from tessera.operators import bindings, joins, pipeline, plots, stats
from tessera.operators.frame import Frame, by_index_range, by_name_property, by_property
from tessera.operators.grouping import frequencies, group_by, value_counts, value_proportions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def out(frame: Frame, **rounded: int) -> DataFrame:
    """The frame's rows, with some columns rounded."""
    return frame.df.withColumns({c: F.round(c, n) for c, n in rounded.items()}) if rounded else frame.df


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q1_pricing_summary(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem").filter_just("l_shipdate").filter_where(col("l_shipdate") <= lit(_day("1998-09-02")))
    f = f.derive("paid", col("l_extendedprice") * (1 - col("l_discount")))
    g = group_by(f, "l_returnflag", "l_linestatus").aggregate(fn.sum_(col("l_quantity")).named("sum_qty"), fn.sum_(col("paid")).named("revenue"), fn.mean(col("l_discount")).named("avg_disc"), fn.count(col("l_quantity")).named("n"))
    return out(g.sort_by("l_returnflag", "l_linestatus"), revenue=2, avg_disc=6)


def _day(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 20")
def filter_derive_ratio(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem").filter_where((col("l_discount") > 0.05) & ~fn.is_nothing(col("l_quantity")) & (col("l_quantity") < 20.0))
    return out(f.derive("unit_price", col("l_extendedprice") / col("l_quantity")).select("l_orderkey", "l_linenumber", "unit_price"))


@query("SELECT c_custkey AS id, c_name, c_acctbal AS balance FROM customer")
def select_exclude_rename(spark, sf_dir):
    return t(spark, sf_dir, "customer").exclude("c_mktsegment").select("c_custkey", "c_name", "c_acctbal").rename_many([("c_custkey", "id"), ("c_acctbal", "balance")]).df


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_by_criteria(spark, sf_dir):
    from pyspark.sql import types as T

    f = t(spark, sf_dir, "part").select_by(by_property(lambda x: isinstance(x.dataType, T.NumericType)), by_index_range(0, 0), by_name_property(lambda n: n.endswith("size")))
    return f.df


@query("SELECT c_custkey, c_acctbal, c_acctbal * 2 AS doubled, if(c_acctbal < 0, 0.0, c_acctbal) AS floored FROM customer")
def derive_many_apply_where(spark, sf_dir):
    f = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    f = f.derive_many((col("c_acctbal") * 2.0).named("doubled"), col("c_acctbal").named("floored"))
    return f.apply_where(lambda c: c < 0, "c_acctbal", lambda c: F.lit(0.0), "floored").df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 25")
def sort_topk(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").sort_by(("o_totalprice", False), "o_orderkey").take(25).df


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_custkey DESC, o_orderkey OFFSET 40 LIMIT 60")
def sort_slice(spark, sf_dir):
    f = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return f.sort_by("o_orderstatus", ("o_custkey", False), "o_orderkey").slice(40, 100).df


@query("""
WITH s AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part)
SELECT p_partkey, 'last' AS kind FROM s WHERE r > n - 7 UNION ALL SELECT p_partkey, 'rest' FROM s WHERE r <= n - 1900 AND r > 5""")
def take_last_drop(spark, sf_dir):
    f = t(spark, sf_dir, "part").select("p_partkey", "p_retailprice").sort_by("p_retailprice", "p_partkey")
    rest = f.drop_last(1900).drop(5)
    return f.take_last(7).derive("kind", lit("last")).select("p_partkey", "kind").df.unionByName(rest.derive("kind", lit("rest")).select("p_partkey", "kind").df)


@query("SELECT s_suppkey, if(row_number() OVER (ORDER BY s_suppkey) = 4, -1.0, s_acctbal) AS s_acctbal FROM supplier")
def apply_at_index(spark, sf_dir):
    f = t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").sort_by("s_suppkey")
    return f.apply_at_index(3, lambda c: F.lit(-1.0), "s_acctbal").df


@query("SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").rename("c_custkey", "o_custkey")
    return joins.inner_join(["o_custkey"], c, t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).df


@query("SELECT c_custkey AS k, c_name AS name, o_totalprice AS price FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_join(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name").rename_many([("c_custkey", "k"), ("c_name", "name")])
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").rename_many([("o_custkey", "k"), ("o_totalprice", "price")])
    return joins.left_join(["k"], o, c).df


@query("SELECT n_nationkey AS k, n_name AS name, s_name AS \"Right_name\" FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def right_join(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name").rename_many([("n_nationkey", "k"), ("n_name", "name")])
    s = t(spark, sf_dir, "supplier").filter_where(col("s_acctbal") > 5000.0).select("s_nationkey", "s_name").rename_many([("s_nationkey", "k"), ("s_name", "name")])
    return joins.join("right", ["k"], n, s).df


@query("""
WITH a AS (SELECT if(o_orderkey % 5 = 0, NULL, o_custkey) AS k, o_orderkey AS x FROM orders),
b AS (SELECT if(s_suppkey % 7 = 0, NULL, s_suppkey) AS k, count(*) AS n, round(sum(s_acctbal), 2) AS owed FROM supplier GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, x, n, owed FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def full_outer_join_null_keys(spark, sf_dir):
    """All orders, a fifth of them with no key, and all suppliers, grouped by key before the join."""
    a = t(spark, sf_dir, "orders").filter_just("o_orderkey").derive("k", fn.if_then_else(col("o_orderkey") % 5 == 0, lit(None), col("o_custkey"))).rename("o_orderkey", "x").select("k", "x")
    b = t(spark, sf_dir, "supplier").filter_just("s_suppkey").derive("k", fn.if_then_else(col("s_suppkey") % 7 == 0, lit(None), col("s_suppkey")))
    b = group_by(b, "k").aggregate(fn.count(col("s_suppkey")).named("n"), fn.sum_(col("s_acctbal")).named("owed"))
    return out(joins.full_outer_join(["k"], b, a), owed=2)


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_rows(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_type", "user_id").distinct().df


@query("SELECT r_regionkey AS k, r_name AS name, NULL::INT AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_by_name(spark, sf_dir):
    r = t(spark, sf_dir, "region").rename_many([("r_regionkey", "k"), ("r_name", "name")])
    n = t(spark, sf_dir, "nation").rename_many([("n_nationkey", "k"), ("n_name", "name"), ("n_regionkey", "region")])
    return r.union(n).select("k", "name", "region").df


@query("SELECT r_regionkey AS as_number, NULL::VARCHAR AS as_text FROM region UNION ALL SELECT NULL, n_name FROM nation")
def union_type_clash(spark, sf_dir):
    r = t(spark, sf_dir, "region").select("r_regionkey").rename("r_regionkey", "v")
    n = t(spark, sf_dir, "nation").select("n_name").rename("n_name", "v")
    return r.union(n).df.select(F.col("v.left").alias("as_number"), F.col("v.right").alias("as_text"))


@query("""
WITH a AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS p, n_name FROM nation),
b AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS p, r_name FROM region) SELECT n_name, r_name FROM a FULL JOIN b USING (p)""")
def horizontal_merge(spark, sf_dir):
    a = t(spark, sf_dir, "nation").sort_by("n_nationkey").select("n_name", "n_nationkey")
    b = t(spark, sf_dir, "region").sort_by("r_regionkey").select("r_name", "r_regionkey")
    return a.beside(b).select("n_name", "r_name").df


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def group_count_sum(spark, sf_dir):
    v = col("value")
    return group_by(t(spark, sf_dir, "events"), "event_type").aggregate(fn.count(v).named("n"), fn.sum_(v).named("total"), fn.minimum(v).named("lo"), fn.maximum(v).named("hi")).df.withColumn("total", F.round("total", 3))


@query("""
SELECT l_linestatus, round(sum(l_extendedprice) / count(*), 4) AS per_row, round(avg(l_quantity + l_tax), 6) AS mean_both,
       if(count(*) > 100, 'many', 'few') AS size, sum(if(l_returnflag = 'R', 1, 0))::BIGINT AS returned
FROM lineitem GROUP BY l_linestatus""")
def agg_of_exprs(spark, sf_dir):
    e, q = col("l_extendedprice"), col("l_quantity")
    g = group_by(t(spark, sf_dir, "lineitem"), "l_linestatus").aggregate(
        (fn.sum_(e) / fn.count(e)).named("per_row"), fn.mean(q + col("l_tax")).named("mean_both"),
        fn.if_then_else(fn.count(e) > 100, "many", "few").named("size"), fn.sum_(fn.if_then_else(col("l_returnflag") == "R", 1, 0)).named("returned"),
    )
    return out(g, per_row=4, mean_both=6)


@query("WITH g AS (SELECT event_type, sum(value) AS s FROM events GROUP BY event_type) SELECT event_type, round((SELECT max(s) FROM g), 4) AS best FROM g")
def nested_aggregate(spark, sf_dir):
    return out(group_by(t(spark, sf_dir, "events"), "event_type").aggregate(fn.maximum(fn.sum_(col("value"))).named("best")), best=4)


@query("SELECT count(*) AS n FROM events HAVING count(*) < 0")
def empty_aggregate(spark, sf_dir):
    return group_by(t(spark, sf_dir, "events").filter_where(col("event_id") < -5).filter_just("event_id")).aggregate(fn.count(col("value")).named("n")).df


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(median(l_quantity), 4) AS med,
       round(quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25), 6) AS iqr FROM lineitem GROUP BY l_returnflag""")
def percentile_median_iqr(spark, sf_dir):
    tax = col("l_tax")
    g = group_by(t(spark, sf_dir, "lineitem"), "l_returnflag").aggregate(fn.percentile(90, col("l_extendedprice")).named("p90"), fn.median(col("l_quantity")).named("med"), (fn.percentile(75, tax) - fn.percentile(25, tax)).named("iqr"))
    return out(g, p90=4, med=4, iqr=6)


@query("SELECT list_sort(list(p_brand))[1 + floor(0.3 * (count(*) - 1))::INT] AS brand, list_sort(list(p_size))[1 + floor(0.85 * (count(*) - 1))::INT] AS size FROM part")
def generic_percentile(spark, sf_dir):
    f = t(spark, sf_dir, "part")
    return spark.createDataFrame([(stats.generic_percentile(f, 30, "p_brand"), stats.generic_percentile(f, 85, "p_size"))], "brand string, size int")


@query("WITH c AS (SELECT l_returnflag, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, arg_max(v, (n, v)) AS most FROM c GROUP BY l_returnflag")
def mode_tie_max(spark, sf_dir):
    return group_by(t(spark, sf_dir, "lineitem"), "l_returnflag").aggregate(fn.mode(col("l_linenumber")).named("most")).df


@query("""
WITH m AS (SELECT l_linenumber, count(*) AS n, avg(l_extendedprice) AS a FROM lineitem GROUP BY l_linenumber),
d AS (SELECT l_linenumber, any_value(n) AS n, sum(pow(l_extendedprice - a, 2)) AS m2, sum(pow(l_extendedprice - a, 3)) AS m3 FROM lineitem JOIN m USING (l_linenumber) GROUP BY l_linenumber)
SELECT l_linenumber, round(m2 / (n - 1), 2) AS var, round(sqrt(m2 / (n - 1)), 4) AS sd, round(sqrt(n - 1) * m3 / pow(m2, 1.5), 6) AS skew FROM d""")
def variance_stddev_skewness(spark, sf_dir):
    e = col("l_extendedprice")
    g = group_by(t(spark, sf_dir, "lineitem"), "l_linenumber").aggregate(fn.variance(e).named("var"), fn.stddev(e).named("sd"), fn.skewness(e).named("skew"))
    return out(g, var=2, sd=4, skew=6)


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, round(avg(pow(l_tax - l_discount, 2)), 8) AS mse FROM lineitem")
def correlation_pair(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem")
    gap = stats.mean_squared_error(f, "l_tax", "l_discount")
    return spark.createDataFrame([(round(stats.correlation(f, "l_quantity", "l_extendedprice"), 8), round(gap, 8))], "r double, mse double")


@query("""
WITH s AS (SELECT s_acctbal AS x FROM supplier), m AS (SELECT count(*) AS n, avg(x) AS a FROM s),
d AS (SELECT sum(pow(x - a, 2)) AS m2, sum(pow(x - a, 3)) AS m3, any_value(n) AS n FROM s, m),
one AS (SELECT count(x)::DOUBLE AS c, avg(x) AS a, min(x) AS lo, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, max(x) AS hi, stddev_samp(x) AS sd FROM s)
SELECT unnest(['Count', 'Mean', 'Minimum', '25%', 'Median', '75%', 'Max', 'StdDev', 'IQR', 'Skewness']) AS "Statistic",
       unnest([round_even(c, 2), round_even(a, 2), round_even(lo, 2), round_even(q1, 2), round_even(q2, 2), round_even(q3, 2), round_even(hi, 2), round_even(sd, 2), round_even(q3 - q1, 2), round_even(sqrt(n - 1) * m3 / pow(m2, 1.5), 2)]) AS s_acctbal
FROM one, d""")
def summarize_supplier(spark, sf_dir):
    return stats.summarize(t(spark, sf_dir, "supplier").select("s_acctbal", "s_name"))


@query("""
SELECT 'c_custkey' AS name, count(c_custkey) AS n_present, count(*) - count(c_custkey) AS n_missing, 'bigint' AS type FROM customer
UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(*) - count(c_mktsegment), 'string' FROM customer""")
def describe_columns(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").describe_columns()


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY event_type")
def value_counts_events(spark, sf_dir):
    return value_counts(t(spark, sf_dir, "events"), col("event_type"))


@query("SELECT event_type AS value, round(count(*) / (SELECT count(*) FROM events), 8) AS proportion FROM events GROUP BY event_type")
def value_proportions_events(spark, sf_dir):
    return value_proportions(t(spark, sf_dir, "events"), col("event_type")).withColumn("proportion", F.round("proportion", 8))


@query("""
WITH c AS (SELECT l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT sum(n) AS t FROM c)
SELECT 'Count' AS "Statistic", max(n::VARCHAR) FILTER (v = 'A') AS "A", max(n::VARCHAR) FILTER (v = 'N') AS "N", max(n::VARCHAR) FILTER (v = 'R') AS "R" FROM c
UNION ALL SELECT 'Percentage (%)', max(printf('%.2f%%', n * 100.0 / t)) FILTER (v = 'A'), max(printf('%.2f%%', n * 100.0 / t)) FILTER (v = 'N'), max(printf('%.2f%%', n * 100.0 / t)) FILTER (v = 'R') FROM c, s""")
def frequencies_wide(spark, sf_dir):
    return frequencies(t(spark, sf_dir, "lineitem"), col("l_returnflag"))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z FROM part")
def zscore_broadcast(spark, sf_dir):
    return out(t(spark, sf_dir, "part").derive("z", fn.z_score(col("p_retailprice"))).select("p_partkey", "z"), z=6)


@query("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def filter_above_mean(spark, sf_dir):
    p = col("p_retailprice")
    return t(spark, sf_dir, "part").filter_where(p > fn.mean(p)).select("p_partkey").df


@query("""
WITH j AS (SELECT c_custkey, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
SELECT c_custkey, round(coalesce(p, (SELECT avg(p) FROM j)), 4) AS p FROM j""")
def impute_mean(spark, sf_dir):
    """Customers without any order have no price."""
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").rename_many([("o_custkey", "c_custkey"), ("o_totalprice", "p")])
    j = joins.left_join(["c_custkey"], o, t(spark, sf_dir, "customer").select("c_custkey"))
    return out(j.impute_with("p", fn.mean_maybe(col("p"))), p=4)


@query("""
WITH j AS (SELECT n_nationkey AS k, s_acctbal AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000)
SELECT k, 'nothing' AS kind FROM j WHERE b IS NULL UNION ALL SELECT k, 'just' FROM j WHERE b IS NOT NULL
UNION ALL SELECT k, 'below' FROM j WHERE b IS NULL OR b < 9500 UNION ALL SELECT k, 'filled' FROM j WHERE coalesce(b, 0) < 1""")
def optional_filters(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").filter_just("s_acctbal").filter_where(col("s_acctbal") > 9000.0).select("s_nationkey", "s_acctbal").rename_many([("s_nationkey", "k"), ("s_acctbal", "b")])
    j = joins.left_join(["k"], s, t(spark, sf_dir, "nation").select("n_nationkey").rename("n_nationkey", "k"))
    kinds = [("nothing", j.filter_nothing("b")), ("just", j.filter_just("b")), ("below", j.filter_where(col("b") < 9500.0)), ("filled", j.impute("b", 0.0).filter_where(col("b") < 1.0))]
    parts = [f.derive("kind", lit(n)).select("k", "kind").df for n, f in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS urgency,
       CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size FROM orders""")
def recode_values(spark, sf_dir):
    f = t(spark, sf_dir, "orders").derive_many(
        fn.recode([("F", "finished"), ("O", "open"), ("F", "never")], col("o_orderstatus")).named("status"),
        fn.recode_with_default(9, [("1-URGENT", 1), ("2-HIGH", 2)], col("o_orderpriority")).named("urgency"),
        fn.recode_with_condition("small", [(lambda x: x > 200000.0, "large"), (lambda x: x > 50000.0, "middle")], col("o_totalprice")).named("size"),
    )
    return f.select("o_orderkey", "status", "urgency", "size").df


@query("""
SELECT page_id, nullif(regexp_extract(url, '[0-9]+', 0), '') AS number, len(regexp_extract_all(url, '[aeiou]')) AS vowels,
       string_split(url, '/')[3] AS host, string_split(url, '/')[-1] AS tail FROM pages""")
def regex_and_split(spark, sf_dir):
    u = col("url")
    f = t(spark, sf_dir, "pages").derive_many(fn.match("[0-9]+", u).named("number"), fn.match_all("[aeiou]", u).named("found"), fn.split_on("/", u).named("parts"), fn.last_or_nothing(fn.split_on("/", u)).named("tail"))
    return f.df.select("page_id", "number", F.size("found").alias("vowels"), F.get("parts", F.lit(2)).alias("host"), "tail")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS text, strftime(o_orderdate, '%Y-%m-%d') AS day, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS since FROM orders""")
def parse_date_days_between(spark, sf_dir):
    f = Frame(t(spark, sf_dir, "orders").df.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("text")))
    f = f.derive("day", fn.parse_date("%d/%m/%Y", col("text")))
    return f.derive("since", fn.days_between(col("day"), fn.parse_date("%Y-%m-%d", lit("1995-01-01")))).apply(lambda c: c.cast("string"), "day").df


@query("SELECT o_custkey, array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderkey DESC), ',') AS orders, sum(o_orderkey)::BIGINT AS folded FROM orders GROUP BY o_custkey")
def collect_and_reduce(spark, sf_dir):
    k = col("o_orderkey")
    f = t(spark, sf_dir, "orders").sort_by("o_orderkey")
    g = group_by(f, "o_custkey").aggregate(fn.collect(k).named("orders"), fn.reduce(k, F.lit(0).cast("long"), lambda acc, v: acc + v).named("folded"))
    return g.df.withColumn("orders", F.array_join(F.transform("orders", lambda x: x.cast("string")), ","))


@query("""
SELECT event_id, round(CASE WHEN value = 0 THEN NULL ELSE ln(abs(value)) END, 6) AS l, round(sqrt(abs(value)) + sin(value) * cosh(0.5), 6) AS m,
       (event_id - 50) // 7 - ((event_id - 50) % 7 <> 0 AND event_id < 50)::INT AS d, (((event_id - 50) % 7) + 7) % 7 AS r, pow(user_id, 2)::BIGINT AS p, greatest(0.0, value - 50) AS relu
FROM events""")
def scalar_math(spark, sf_dir):
    v, i = col("value"), col("event_id")
    f = t(spark, sf_dir, "events").derive_many(
        fn.if_then_else(v == 0.0, lit(None), fn.log(abs(v))).named("l"), (fn.sqrt(abs(v)) + fn.sin(v) * fn.cosh(lit(0.5))).named("m"),
        ((i - 50) // 7).named("d"), ((i - 50) % 7).named("r"), (col("user_id") ** 2).named("p"), fn.relu(v - 50.0).named("relu"),
    )
    return out(f.select("event_id", "l", "m", "d", "r", "p", "relu"), l=6, m=6)


@query("SELECT event_id, user_id * 2 + 1 AS u, concat(event_type, '-', user_id) AS tag FROM events")
def host_functions(spark, sf_dir):
    f = t(spark, sf_dir, "events").derive("u", fn.lift1(lambda s: s * 2 + 1, col("user_id"), "long"))
    return f.derive("tag", fn.lift2(lambda a, b: a + "-" + b.astype(str), col("event_type"), col("user_id"), "string")).select("event_id", "u", "tag").df


@query("SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY o_orderpriority")
def host_aggregate(spark, sf_dir):
    return out(group_by(t(spark, sf_dir, "orders"), "o_orderpriority").aggregate(fn.aggregate_with(lambda s: float(s.max() - s.min()), col("o_totalprice")).named("spread")), spread=2)


@query("SELECT floor((least(l_quantity, 49.999999) - 1) / ((50.0 - 1) / 10))::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_bins(spark, sf_dir):
    return plots.histogram(t(spark, sf_dir, "lineitem"), "l_quantity", 10).select("bin", "n")


@query("""
WITH c AS (SELECT p_type AS label, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS k FROM c)
SELECT label, n FROM r WHERE k <= 3 UNION ALL SELECT 'Other (' || count(*) || ' items)', sum(n)::BIGINT FROM r WHERE k > 3 HAVING count(*) > 0""")
def bars_top_n(spark, sf_dir):
    return plots.category_counts(t(spark, sf_dir, "part"), "p_type", 3)


@query("""
SELECT 'l_quantity' AS a, 'l_tax' AS b, round(corr(l_quantity, l_tax), 8) AS correlation FROM lineitem UNION ALL SELECT 'l_tax', 'l_quantity', round(corr(l_tax, l_quantity), 8) FROM lineitem
UNION ALL SELECT 'l_tax', 'l_tax', round(corr(l_tax, l_tax), 8) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_quantity', round(corr(l_quantity, l_quantity), 8) FROM lineitem""")
def correlation_matrix(spark, sf_dir):
    return stats.correlation_matrix(t(spark, sf_dir, "lineitem").select("l_quantity", "l_tax")).withColumn("correlation", F.round("correlation", 8))


@query("SELECT o_orderkey, o_totalprice AS price, o_totalprice / 2 AS half FROM orders WHERE o_totalprice > 100000 AND o_totalprice / 2 < 90000")
def monadic_pipeline(spark, sf_dir):
    def steps(p):
        price = p.rename(p.filter_just(col("o_totalprice")), "price")
        p.filter_where(price > 100000.0)
        half = p.derive("half", price / 2.0)
        p.filter_where(half < 90000.0)
        p.modify(lambda f: f.select("o_orderkey", "price", "half"))

    return pipeline.exec_(t(spark, sf_dir, "orders"), steps).df


@query("SELECT c_custkey, c_acctbal * 1.1 AS raised FROM customer WHERE c_acctbal * 1.1 > 5000")
def lazy_parquet(spark, sf_dir):
    from tessera.streaming import scan_parquet

    lazy = scan_parquet(spark, f"{sf_dir}/customer.parquet").derive("raised", col("c_acctbal") * 1.1).select("c_custkey", "raised").filter(col("raised") > 5000.0)
    return lazy.run().df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    """Written as CSV, read back and typed again."""
    from tessera.sources import csv
    from tessera.sources.scratch import scratch

    path = scratch(spark, "csv")
    csv.write_csv(t(spark, sf_dir, "nation"), path)
    f = csv.read_csv(spark, path)
    return f.df.withColumns({n: F.col(n).cast("int") for n in ("n_nationkey", "n_regionkey")})


@query("SELECT r_regionkey::DOUBLE AS r_regionkey, r_name FROM region")
def json_round_trip(spark, sf_dir):
    from tessera.sources.json import read_json
    from tessera.sources.scratch import scratch

    path = scratch(spark, "json")
    t(spark, sf_dir, "region").df.write.mode("overwrite").json(path)
    return read_json(spark, path, lines=True).df


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3")
def bound_columns(spark, sf_dir):
    f = t(spark, sf_dir, "region").filter_just("r_regionkey")
    c = bindings.columns(f)
    return f.filter_where(c.r_regionkey < 3).df
