"""More registered queries: sources and sinks, construction, scalar forms, statistics, plots' numbers."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import functions as F

from tessera import errors
from tessera import functions as fn
from tessera.functions import col, lit
from tessera.functions.expr import columns_of, compare, normalize, replace, size
from tessera.operators import bindings, display, pipeline, plots, stats, synthesis, tree
from tessera.operators.frame import Frame, by_name, by_name_range
from tessera.operators.grouping import group_by
from tessera.plans.catalog import ORACLES, QUERIES, out, query, t
from tessera.sources import csv, jdbc, parquet
from tessera.sources import json as tjson
from tessera.sources.scratch import scratch
from tessera.streaming import scan_csv

__all__ = ["ORACLES", "QUERIES"]  # the catalog's, with those registered here

# --- sources and sinks ----------------------------------------------------------------------------


@query("""
SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, 'numbered' AS kind FROM nation
UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'named' FROM nation""")
def csv_headers_and_types(spark, sf_dir):
    """Files without a header, cut at semicolons: positions as names, or given ones; types as given."""
    path = scratch(spark, "csv-plain")
    t(spark, sf_dir, "nation").df.select("n_nationkey", "n_name", "n_regionkey").write.option("sep", ";").csv(path)
    types = csv.SpecifyTypes(("long", "string", "long"))
    a = csv.read_separated(spark, path, csv.ReadOptions(separator=";", header=csv.NoHeader(), types=types))
    b = csv.read_separated(spark, path, csv.ReadOptions(separator=";", header=csv.ProvideNames(("k", "name")), types=types))
    a = a.rename_many([("0", "k"), ("1", "name"), ("2", "region")]).derive("kind", lit("numbered"))
    return a.union(b.rename("2", "region").derive("kind", lit("named"))).select("k", "name", "region", "kind").df


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def tsv_round_trip(spark, sf_dir):
    path = scratch(spark, "tsv")
    csv.write_tsv(t(spark, sf_dir, "customer"), path)
    return csv.read_tsv(spark, path).df


@query("SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def csv_without_inference(spark, sf_dir):
    path = scratch(spark, "csv-text")
    csv.write_csv(t(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    return csv.read_csv(spark, path, csv.ReadOptions(types=csv.NoInference())).df


@query("SELECT page_id, trim(html, E' \\t\\n\\r') AS html FROM pages")
def csv_cells_with_line_feeds(spark, sf_dir):
    """Raw pages hold line feeds, commas and quotes; a first look at the files finds that out."""
    path = scratch(spark, "csv-pages")
    csv.write_csv(Frame(t(spark, sf_dir, "pages").df.select("page_id", "html")), path)
    f = csv.read_csv(spark, path)
    return f.df.select("page_id", F.trim("html", F.lit(" \t\n\r")).alias("html"))


@query("""
SELECT event_id, if(user_id % 7 = 0, NULL, user_id) AS whole, value AS part, event_id % 2 = 0 AS flag,
       strftime(ts, '%Y-%m-%d') AS day, if(event_id % 3 = 0, NULL, 'x' || event_id) AS word FROM events""")
def csv_cell_kinds(spark, sf_dir):
    """Stray blanks, tokens that stand for nothing, truth values, numbers and dates, typed by their cells."""
    text = t(spark, sf_dir, "events").df.select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("user_id") % 7 == 0, "NA").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("whole"),
        F.col("value").cast("string").alias("part"), F.when(F.col("event_id") % 2 == 0, "True").otherwise("false").alias("flag"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_id") % 3 == 0, "Nothing").otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("word"),
    )
    f = csv.type_columns(text, csv.ReadOptions())
    assert [x.dataType.simpleString() for x in f.df.schema.fields] == ["bigint", "bigint", "double", "boolean", "date", "string"]
    return f.apply(lambda c: c.cast("string"), "day").df


@query("SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, true AS refused FROM nation")
def json_array(spark, sf_dir):
    """One array of objects; a file that is none comes back as an error."""
    path, bad = scratch(spark, "json-array"), scratch(spark, "json-bad")
    rows = t(spark, sf_dir, "nation").df.select("n_nationkey", "n_name")
    rows.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).coalesce(1).write.text(path)
    spark.createDataFrame([("{nope",)], "value string").coalesce(1).write.text(bad)
    refused = isinstance(tjson.read_json_either(spark, bad), Exception)
    return tjson.read_json_either(spark, path).derive("refused", lit(refused)).df


@query("""
SELECT p_partkey, p_size, NULL::VARCHAR AS p_brand, NULL::DOUBLE AS price FROM part
UNION ALL SELECT p_partkey, NULL, p_brand, round(p_retailprice, 2) FROM part""")
def parquet_files(spark, sf_dir):
    """Folders of differing columns and codecs are padded; short decimals become doubles."""
    path, p = scratch(spark, "parquet"), t(spark, sf_dir, "part").df
    p.select("p_partkey", "p_size").write.option("compression", "gzip").parquet(f"{path}/a")
    p.select("p_partkey", "p_brand", F.col("p_retailprice").cast("decimal(12,2)").alias("price")).write.option("compression", "zstd").parquet(f"{path}/b")
    return out(parquet.read_parquet_files(spark, f"{path}/*", decimals_as_double=True).select("p_partkey", "p_size", "p_brand", "price"), price=2)


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, o_totalprice::FLOAT::DOUBLE AS price, o_orderstatus = 'F' AS done FROM orders")
def parquet_physical_types(spark, sf_dir):
    """Booleans, floats, dictionaries and old 96-bit timestamps, uncompressed, written and read again."""
    path, key = scratch(spark, "parquet-types"), "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(key)
    spark.conf.set(key, "INT96")
    try:
        rows = t(spark, sf_dir, "orders").df.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").cast("float").alias("price"), (F.col("o_orderstatus") == "F").alias("done"))
        rows.write.option("compression", "none").parquet(path)
    finally:
        spark.conf.set(key, before)
    f = parquet.read_parquet(spark, path).derive("price", fn.to_double(col("price")))
    return f.df.select("o_orderkey", F.unix_timestamp(F.col("at").cast("timestamp")).alias("seconds"), "price", "done")


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal * 2 > 1000")
def lazy_csv(spark, sf_dir):
    """A scanned CSV, its verbs, and the rows written without being gathered."""
    source, sink = scratch(spark, "lazy-in"), scratch(spark, "lazy-out")
    csv.write_csv(t(spark, sf_dir, "customer"), source)
    scan_csv(spark, source).derive("twice", col("c_acctbal") * 2.0).select("c_custkey", "twice").filter(col("twice") > 1000.0).write_csv(sink)
    return csv.read_csv(spark, sink).df


@query("SELECT n_nationkey AS \"K\", n_name AS \"NAME\" FROM nation WHERE n_nationkey > 3")
def database_round_trip(spark, sf_dir):
    """Appended to a table of the embedded database, and read with a filter that it applies."""
    options = jdbc.JdbcOptions(f"jdbc:derby:{tempfile.mkdtemp(prefix='tessera-')}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, id_column="K", lower=0, upper=25, partitions=2)
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name").rename_many([("n_nationkey", "K"), ("n_name", "NAME")])
    jdbc.write_table(n, options, "NATIONS")
    return jdbc.read_table(spark, options, "NATIONS", ["K > 3"]).df


@query("""
SELECT '| r_regionkey<br>int? | r_name<br>string? |' || chr(10) || '| --- | --- |' || chr(10)
       || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS text, max(r_regionkey) + 5 AS lines FROM region""")
def markdown_and_show(spark, sf_dir):
    f = t(spark, sf_dir, "region").select("r_regionkey", "r_name").sort_by("r_regionkey")
    return spark.createDataFrame([(display.to_markdown(f, 20), len(display.show(f, 20).splitlines()))], "text string, lines int")


# --- construction, metadata, projection -------------------------------------------------------------


@query("""
SELECT * FROM (VALUES ('columns', 1, 'a'), ('columns', 2, NULL), ('unnamed', 3, 'x'), ('unnamed', 4, 'y'), ('rows', 5, 'p'), ('rows', 6, 'q'), ('cloned', 7, '7'), ('empty', 0, '0')) AS v(kind, k, word)""")
def construct_frames(spark, sf_dir):
    a = Frame.from_columns(spark, {"k": [1, 2], "word": ["a"]}).derive("kind", lit("columns"))
    b = Frame.from_unnamed(spark, [[3, 4], ["x", "y"]]).rename_many([("0", "k"), ("1", "word")]).derive("kind", lit("unnamed"))
    c = Frame.from_rows(spark, ["k", "word"], [[5, "p"], [6, "q"]]).derive("kind", lit("rows"))
    d = Frame.from_columns(spark, {"k": [7]}).clone_column("k", "word").apply(lambda x: x.cast("string"), "word").derive("kind", lit("cloned"))
    none = Frame.empty(spark)
    e = Frame.from_columns(spark, {"k": [none.n_rows()], "word": [str(none.n_columns())]}).derive("kind", lit("empty"))
    f = a.union(b).union(c).union(d).union(e).union(none)
    return f.select("kind", "k", "word").df.withColumn("k", F.col("k").cast("int"))


@query("""
WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS p FROM nation)
SELECT n_name, if(p <= 20, (p - 1) * (p - 1), -1)::BIGINT AS squares, if(p <= 3, 'first', NULL) AS word FROM n""")
def insert_columns(spark, sf_dir):
    f = t(spark, sf_dir, "nation").select("n_name").sort_by("n_name")
    return f.insert("squares", [i * i for i in range(20)], default=-1).insert("word", ["first"] * 3).df


@query("""
SELECT count(*) AS n_rows, 5 AS n_columns, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS names, count(*) > count(c_name) AS has_missing,
       count(c_name) = 0 AS all_missing, true AS numeric_key, false AS numeric_name, true AS has_type, round(sum(c_acctbal), 2) AS folded, true AS same, true AS differs FROM customer""")
def frame_facts(spark, sf_dir):
    f = t(spark, sf_dir, "customer").filter_just("c_custkey").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    rows, columns = f.dimensions()
    doubled = f.fold(lambda name, g: g.apply(lambda c: c * 2, name), ["c_acctbal", "c_nationkey"])
    same = f.sort_by("c_custkey").equals(f.sort_by("c_custkey"))
    facts = (rows, columns, ",".join(f.columns), f.has_missing("c_name"), f.all_missing("c_name"), f.is_numeric("c_custkey"), f.is_numeric("c_name"), f.has_type("c_acctbal", "double"), round(stats.sum_(doubled, "c_acctbal") / 2, 2), same, not doubled.equals(f))
    return spark.createDataFrame([facts], "n_rows long, n_columns int, names string, has_missing boolean, all_missing boolean, numeric_key boolean, numeric_name boolean, has_type boolean, folded double, same boolean, differs boolean")


@query("""
WITH p AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
SELECT p_partkey, p_name, 'cube' AS kind FROM p WHERE r <= 12 UNION ALL SELECT p_partkey, p_name, 'range' FROM p""")
def cube_and_name_range(spark, sf_dir):
    f = t(spark, sf_dir, "part").sort_by(("p_retailprice", False), "p_partkey")
    named = f.select_by(by_name_range("p_partkey", "p_name"), by_name("p_name"))
    return f.cube(12, 2).derive("kind", lit("cube")).df.unionByName(named.derive("kind", lit("range")).df)


@query("""
SELECT l_orderkey * 2 AS l_orderkey, l_linenumber + 1 AS l_linenumber, round(l_tax * 10, 6) AS l_tax, round(l_discount * 10, 6) AS l_discount, round(l_tax * 10 + l_discount * 10, 6) AS both, true AS refused FROM lineitem""")
def apply_forms(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    f = f.apply_int(lambda c: c * 2, "l_orderkey").apply_many(lambda c: c * 10, ["l_tax"]).apply_double(lambda c: c * 10, "l_discount")
    refused = isinstance(f.safe_apply(lambda c: c, "nope"), errors.ColumnNotFound) and isinstance(f.rename_safe("l_tax", "l_discount"), errors.DuplicateColumn)
    both, f = f.safe_apply(lambda c: c + 1, "l_linenumber").derive_with_expr("both", col("l_tax") + col("l_discount"))
    return out(f.derive("both", both).derive("refused", lit(refused)), l_tax=6, l_discount=6, both=6)


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST) AS r FROM orders)
SELECT o_orderkey, if(r = 7001, -1.0, o_totalprice) AS o_totalprice FROM o""")
def apply_at_index_orders(spark, sf_dir):
    f = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").sort_by(("o_totalprice", False), "o_orderkey")
    return f.apply_at_index(7000, lambda c: F.lit(-1.0), "o_totalprice").df


@query("""
WITH l AS (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice NULLS FIRST) AS r FROM lineitem),
o AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST) AS r FROM orders)
SELECT r - 1 AS place, l_extendedprice, o_totalprice FROM l FULL JOIN o USING (r)""")
def beside_lineitem_orders(spark, sf_dir):
    """Two sorted tables side by side, and where each row of both ends up."""
    from tessera.operators.frame import POSITION

    a = t(spark, sf_dir, "lineitem").select("l_extendedprice").sort_by("l_extendedprice")
    b = t(spark, sf_dir, "orders").select("o_totalprice").sort_by(("o_totalprice", False))
    return a.beside(b).positions().withColumnRenamed(POSITION, "place")


# --- filters, order, sampling -----------------------------------------------------------------------


@query("""
WITH j AS (SELECT c_custkey AS k, s_acctbal AS b FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)
SELECT k, 'just' AS kind FROM j WHERE b IS NOT NULL AND k IS NOT NULL UNION ALL SELECT k, 'nothing' FROM j WHERE b IS NULL
UNION ALL SELECT k, 'test' FROM j WHERE k % 5 = 0 UNION ALL SELECT k, 'by' FROM j WHERE k + 1 > 100""")
def filter_forms(spark, sf_dir):
    from tessera.operators import joins

    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").rename_many([("s_suppkey", "k"), ("s_acctbal", "b")])
    j = joins.left_join(["k"], s, t(spark, sf_dir, "customer").filter_just("c_custkey").select("c_custkey").rename("c_custkey", "k"))
    kinds = {"just": j.filter_all_just(), "nothing": j.filter_all_nothing(), "test": j.filter("k", lambda c: c % 5 == 0), "by": j.filter_by(lambda c: c > 100, col("k") + 1)}
    parts = [f.derive("kind", lit(n)).select("k", "kind").df for n, f in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""
SELECT count(*) AS n, true AS split_is_whole, true AS split_is_apart, true AS folds_are_whole, true AS folds_are_apart, true AS sample_fits, true AS shuffle_is_whole FROM orders""")
def sampling_laws(spark, sf_dir):
    """Parts that miss nothing, share nothing and are about as large as asked for."""
    f = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n, near = f.n_rows(), lambda got, want: abs(got - want) <= 6 * math.sqrt(want) + 1
    a, b = f.random_split(7, 0.3)
    folds = f.k_folds(7, 3)
    sizes = [x.n_rows() for x in folds]
    whole = a.n_rows() + b.n_rows() == n and near(a.n_rows(), 0.3 * n)
    apart = a.df.join(b.df, "o_orderkey", "left_semi").isEmpty()
    folds_apart = folds[0].df.join(folds[1].union(folds[2]).df, "o_orderkey", "left_semi").isEmpty()
    moved = f.shuffle(3)
    facts = (n, whole, apart, sum(sizes) == n and all(near(s, n / 3) for s in sizes), folds_apart, near(f.sample(7, 0.5).n_rows(), 0.5 * n), moved.df.exceptAll(f.df).isEmpty() and moved.n_rows() == n)
    return spark.createDataFrame([facts], "n long, split_is_whole boolean, split_is_apart boolean, folds_are_whole boolean, folds_are_apart boolean, sample_fits boolean, shuffle_is_whole boolean")


# --- aggregation and statistics ---------------------------------------------------------------------


@query("""
SELECT if(l_linenumber = 3, NULL, l_discount) AS d, count(*) AS n, coalesce(sum(if(l_quantity > 40, NULL, l_quantity)), 0) AS some,
       if(count(*) FILTER (l_quantity > 45) = 0, min(if(l_quantity > 45, NULL, l_quantity)), NULL) AS least, max(if(l_quantity > 45, NULL, l_quantity)) AS most,
       round(avg(if(l_quantity > 40, NULL, l_quantity)), 6) AS mean, round(coalesce(stddev_samp(if(l_quantity > 40, NULL, l_quantity)), 0), 6) AS sd,
       median(if(l_quantity > 40, NULL, l_quantity)) AS middle
FROM lineitem GROUP BY 1""")
def group_null_and_double_keys(spark, sf_dir):
    """A double key with missing values, and aggregates that meet missing values."""
    q = col("l_quantity")
    f = t(spark, sf_dir, "lineitem").select("l_linenumber", "l_discount", "l_quantity").derive_many(
        fn.if_then_else(col("l_linenumber") == 3, lit(None), col("l_discount")).named("d"), fn.if_then_else(q > 40.0, lit(None), q).named("x"), fn.if_then_else(q > 45.0, lit(None), q).named("y"),
    )
    x, y = col("x"), col("y")
    g = group_by(f, "d").aggregate(fn.count(x).named("n"), fn.sum_maybe(x).named("some"), fn.minimum(y).named("least"), fn.maximum(y).named("most"), fn.mean_maybe(x).named("mean"), fn.stddev_maybe(x).named("sd"), fn.median_maybe(x).named("middle"))
    return out(g, mean=6, sd=6)


@query("""
WITH x AS (SELECT l_extendedprice AS v FROM lineitem), m AS (SELECT count(*) AS n, avg(v) AS a FROM x),
d AS (SELECT any_value(n) AS n, sum(pow(v - a, 2)) AS m2, sum(pow(v - a, 3)) AS m3 FROM x, m)
SELECT round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr,
       round(quantile_cont(v, 0.2), 4) AS first_fifth, round(max(v), 4) AS last_fifth, round(any_value(m2) / (any_value(n) - 1), 0) AS variance, round(sqrt(any_value(m2) / (any_value(n) - 1)), 4) AS sd,
       round(sqrt(any_value(n) - 1) * any_value(m3) / pow(any_value(m2), 1.5), 6) AS skew, round(sum(v), 0) AS total, true AS refused FROM x, d""")
def standalone_statistics(spark, sf_dir):
    f, v = t(spark, sf_dir, "lineitem"), "l_extendedprice"

    def raises(error, act) -> bool:
        try:
            act()
        except error:
            return True
        return False

    refused = raises(errors.WrongQuantile, lambda: stats.quantiles(f, 1, v)) and raises(errors.WrongQuantile, lambda: stats.percentile(f, 101, v)) and raises(errors.EmptyData, lambda: stats.median(f.take(0), v))
    fifths = stats.quantiles(f, 5, v)
    facts = (round(stats.mean(f, v), 4), round(stats.median(f, v), 4), round(stats.percentile(f, 90, v), 4), round(stats.inter_quartile_range(f, v), 4), round(fifths[1], 4), round(fifths[-1], 4), round(stats.variance(f, v), 0), round(stats.standard_deviation(f, v), 4), round(stats.skewness(f, v), 6), round(stats.sum_(f, v), 0), refused)
    return spark.createDataFrame([facts], "mean double, median double, p90 double, iqr double, first_fifth double, last_fifth double, variance double, sd double, skew double, total double, refused boolean")


@query("""
WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS d, count(*) AS n FROM lineitem),
p AS (SELECT least(4, floor((l_quantity - a) / ((b - a) / 5)))::INT AS i, least(4, floor((l_tax - c) / ((d - c) / 5)))::INT AS j FROM lineitem, r),
k AS (SELECT i, j, count(*) AS n FROM p GROUP BY ALL), li AS (SELECT i, sum(n) AS n FROM k GROUP BY i), lj AS (SELECT j, sum(n) AS n FROM k GROUP BY j)
SELECT round(sum(k.n / r.n * ln(k.n * r.n / (li.n * lj.n))), 8) AS information FROM k JOIN li USING (i) JOIN lj USING (j), r""")
def mutual_information(spark, sf_dir):
    return spark.createDataFrame([(round(stats.mutual_information(t(spark, sf_dir, "lineitem"), 5, "l_quantity", "l_tax"), 8),)], "information double")


# --- expressions ------------------------------------------------------------------------------------


@query("""
SELECT event_id, event_id + 2 AS a, event_id - 2 AS s, event_id * 2 AS m, round(value / 4, 8) AS q, event_id // 3 AS d, event_id % 3 AS r, event_id * event_id AS p, -event_id AS neg,
       sign(value - 50)::INT AS sg, event_id = 5 AS e, event_id < 5 AS l, event_id > 5 AS g, event_id <= 5 AS le, event_id >= 5 AS ge, event_id > 5 AND value > 50 AS both, event_id > 5 OR value > 50 AS one,
       NOT event_id > 5 AS no, least(event_id, user_id) AS lo, greatest(event_id, user_id) AS hi, user_id::DOUBLE AS real, isinf(value / 0) OR isnan(value / 0) AS unbounded FROM events""")
def scalar_named_forms(spark, sf_dir):
    i, v, u = col("event_id"), col("value"), col("user_id")
    f = t(spark, sf_dir, "events").filter_just("event_id").filter_just("value").filter_just("user_id").derive("zero", v - v)
    f = f.derive_many(
        fn.add(i, 2).named("a"), fn.sub(i, 2).named("s"), fn.mult(i, 2).named("m"), fn.divide(v, 4.0).named("q"), fn.div(i, 3).named("d"), fn.mod(i, 3).named("r"), fn.pow_int(i, 2).named("p"), (-i).named("neg"), fn.signum(v - 50.0).named("sg"),
        fn.eq(i, 5).named("e"), fn.lt(i, 5).named("l"), fn.gt(i, 5).named("g"), fn.leq(i, 5).named("le"), fn.geq(i, 5).named("ge"), fn.and_(i > 5, v > 50.0).named("both"), fn.or_(i > 5, v > 50.0).named("one"), fn.not_(i > 5).named("no"),
        fn.min_(i, u).named("lo"), fn.max_(i, u).named("hi"), fn.to_double(u).named("real"), (v / col("zero")).named("ratio"),
    )
    f = f.pipe(lambda g: g.exclude("ts", "event_type", "props", "user_id", "zero"))
    df = f.df.withColumn("unbounded", F.isnan("ratio") | (F.abs("ratio") == float("inf"))).drop("ratio", "value")
    return df.withColumns({"q": F.round("q", 8), "p": F.col("p").cast("long"), "sg": F.col("sg").cast("int")})


@query("""
SELECT event_id, round(exp(value / 100), 6) AS e, round(pow(value + 1, 0.5), 6) AS p, round(log(value + 1) / log(2), 6) AS b, round(pi(), 6) AS pi, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(tan(value / 200), 6) AS t,
       round(asin(value / 1000), 6) AS asin_, round(acos(value / 1000), 6) AS acos_, round(atan(value), 6) AS atan_, round(sinh(value / 100), 6) AS sinh_, round(cosh(value / 100), 6) AS cosh_, round(tanh(value / 100), 6) AS tanh_,
       round(asinh(value), 6) AS asinh_, round(acosh(value + 1), 6) AS acosh_, round(atanh(value / 1000), 6) AS atanh_ FROM events WHERE value BETWEEN 0 AND 900""")
def scalar_transcendental(spark, sf_dir):
    v = col("value")
    f = t(spark, sf_dir, "events").filter_just("value").filter_where((v >= 0.0) & (v <= 900.0))
    made = {"e": fn.exp(v / 100.0), "p": (v + 1.0) ** lit(0.5), "b": fn.log_base(2.0, v + 1.0), "pi": fn.pi(), "s": fn.sin(v), "c": fn.cos(v), "t": fn.tan(v / 200.0), "asin_": fn.asin(v / 1000.0), "acos_": fn.acos(v / 1000.0), "atan_": fn.atan(v), "sinh_": fn.sinh(v / 100.0), "cosh_": fn.cosh(v / 100.0), "tanh_": fn.tanh(v / 100.0), "asinh_": fn.asinh(v), "acosh_": fn.acosh(v + 1.0), "atanh_": fn.atanh(v / 1000.0)}
    return out(f.derive_many(*(e.named(n) for n, e in made.items())).select("event_id", *made), **dict.fromkeys(made, 6))


@query("""
WITH j AS (SELECT c_custkey AS k, s_acctbal AS b, s_nationkey AS n FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)
SELECT k, coalesce(b, -1.0) AS filled, b + 1 AS present, b + n AS both, b AS maybe, coalesce(b, 0) AS sure FROM j""")
def optional_scalars(spark, sf_dir):
    from tessera.operators import joins

    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").rename_many([("s_suppkey", "k"), ("s_acctbal", "b"), ("s_nationkey", "n")])
    j = joins.left_join(["k"], s, t(spark, sf_dir, "customer").select("c_custkey").rename("c_custkey", "k"))
    b, n = col("b"), col("n")
    return j.derive_many(
        fn.from_maybe(-1.0, b).named("filled"), fn.when_present(lambda x: x + 1.0, b).named("present"), fn.when_both_present(lambda x, y: x + y, b, n).named("both"),
        fn.to_maybe(b).named("maybe"), fn.from_just(fn.from_maybe(0.0, b)).named("sure"),
    ).select("k", "filled", "present", "both", "maybe", "sure").df


@query("""
SELECT page_id, string_split(url, '/')[1] AS first, array_to_string(flatten(list_transform(string_split(url, '/'), lambda x: string_split(x, '.'))), '+') AS words FROM pages""")
def list_functions(spark, sf_dir):
    parts = fn.split_on("/", col("url"))
    f = t(spark, sf_dir, "pages").derive_many(fn.first_or_nothing(parts).named("first"), fn.bind(lambda x: F.split(x, r"\."), parts).named("words"))
    return f.df.select("page_id", "first", F.concat_ws("+", "words").alias("words"))


@query("SELECT event_id, user_id * 3 AS tripled, value + user_id AS summed, 'triple(user_id)' AS shown, 'value <+> user_id' AS joined FROM events")
def decorated_host_functions(spark, sf_dir):
    a = fn.lift1(lambda s: s * 3, col("user_id"), "long", name="triple")
    b = fn.lift2(lambda x, y: x + y, col("value"), col("user_id"), "double", name="plus", symbol="<+>", commutative=True, precedence=6)
    return t(spark, sf_dir, "events").derive_many(a.named("tripled"), b.named("summed"), lit(repr(a)).named("shown"), lit(repr(b)).named("joined")).select("event_id", "tripled", "summed", "shown", "joined").df


@query("""
SELECT '(a + b) * 2' AS shown, true AS same, true AS normal, -1 AS less, 0 AS equal, '(a + c) * 2' AS replaced, 5 AS size, 'a,b' AS columns, true AS literal, true AS conditional,
       120.0 AS rounded, 0.5 AS f1, true AS fits""")
def expression_utilities(spark, sf_dir):
    a, b = col("a"), col("b")
    e = (a + b) * 2
    f = Frame.from_columns(spark, {"a": [1, 2], "b": [3, 4], "y": [8.0, 12.0]})
    facts = (
        repr(e), e.same((a + b) * 2) and not e.same((b + a) * 2), normalize(a + b).same(normalize(b + a)), compare(a, b), compare(e, (a + b) * 2), repr(replace(e, b, col("c"))), size(e), ",".join(columns_of(e)),
        synthesis.is_literal(lit(3)) and not synthesis.is_literal(a), synthesis.is_conditional(fn.if_then_else(a > 1, 1, 2)), synthesis.round_significant(123.4), synthesis.f1_from_counts(1, 1, 1), synthesis.satisfies(f, e, "y"),
    )
    return spark.createDataFrame([facts], "shown string, same boolean, normal boolean, less int, equal int, replaced string, size int, columns string, literal boolean, conditional boolean, rounded double, f1 double, fits boolean")


# --- extraction and pipelines -----------------------------------------------------------------------


@query("""
SELECT count(*) AS n, 2 AS width, round(sum(l_quantity), 2) AS from_matrix, sum(l_linenumber)::BIGINT AS from_vector, round(sum(l_quantity) + sum(l_linenumber), 2) AS lined_up, count(*) AS n_list, 1 AS dims,
       max(l_quantity) AS head, max(l_quantity) AS cell FROM lineitem""")
def host_extraction(spark, sf_dir):
    f = t(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber")
    m = f.matrix()
    top = f.sort_by(("l_quantity", False))
    facts = (m.shape[0], m.shape[1], round(float(m[:, 0].sum()), 2), int(f.vector("l_linenumber", "long").sum()), round(float(m.sum()), 2), len(f.values("l_quantity")), f.select("l_quantity").tensor("float").ndim, top.head_column("l_quantity"), top.row_value(0, "l_quantity"))
    return spark.createDataFrame([facts], "n long, width int, from_matrix double, from_vector long, lined_up double, n_list long, dims int, head double, cell double")


@query("""
WITH j AS (SELECT c_custkey AS k, coalesce(s_acctbal, 0.0) AS b FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)
SELECT k, b, b * 2 AS twice FROM j ORDER BY k LIMIT 40""")
def pipeline_steps(spark, sf_dir):
    """Imputing, sampling everything, taking rows; what the steps return is used too."""
    from tessera.operators import joins

    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").rename_many([("s_suppkey", "k"), ("s_acctbal", "b")])
    j = joins.left_join(["k"], s, t(spark, sf_dir, "customer").filter_just("c_custkey").select("c_custkey").rename("c_custkey", "k"))

    def steps(p):
        b = p.impute(col("b"), 0.0)
        p.sample(1, 1.0)
        p.derive("twice", b * 2.0)
        p.modify(lambda f: f.sort_by("k"))
        p.take(40)
        return p.inspect(lambda f: f.n_columns())

    n, f = pipeline.run(j, steps)
    assert n == 3 and pipeline.eval_(j, steps) == 3
    return f.df


@query("SELECT r_regionkey, r_name, '_data_' AS clean, true AS hinted, 'r_regionkey,r_name' AS names FROM region")
def bindings_and_errors(spark, sf_dir):
    """References made of a CSV's and a Parquet file's columns; an unknown name gets the nearest one."""
    path = scratch(spark, "csv-names")
    f = t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    csv.write_csv(f, path)
    a, b = bindings.columns_of_csv(spark, path), bindings.columns_of_parquet(spark, f"{sf_dir}/region.parquet")
    try:
        f.select("r_nam")
        hinted = False
    except errors.ColumnNotFound as error:
        hinted = "'r_name'" in str(error)
    names = f"{a.r_regionkey.name},{b.r_name.name}"
    return f.derive_many(lit(bindings.sanitize("Data")).named("clean"), lit(hinted).named("hinted"), lit(names).named("names")).df


# --- synthesis and trees ----------------------------------------------------------------------------


@query("SELECT 1.0 AS fit, true AS uses_both, count(*) AS n FROM part")
def synthesized_feature(spark, sf_dir):
    """The default search finds the product that a target is made of."""
    f = t(spark, sf_dir, "part").select("p_size", "p_retailprice").derive("target", col("p_size") * (col("p_retailprice") + 1.0))
    e = synthesis.synthesize_feature(f, "target", synthesis.BeamConfig())
    found = f.derive("made", e)
    r = stats.correlation(found, "made", "target")
    return spark.createDataFrame([(round(r * r, 6), sorted(columns_of(e)) == ["p_retailprice", "p_size"], found.n_rows())], "fit double, uses_both boolean, n long")


@query("SELECT true AS regression_fits, 1.0 AS classifier_f1, count(*) AS n FROM part")
def regression_and_classifier(spark, sf_dir):
    f = t(spark, sf_dir, "part").select("p_size", "p_retailprice").derive_many((col("p_retailprice") - col("p_size")).named("target"), fn.if_then_else(col("p_size") * 40 > col("p_retailprice"), 1, 0).named("large"), (col("p_size") * 40).named("scaled"))
    e = synthesis.fit_regression(f.exclude("large", "scaled"), "target", depth=1, beam=20)
    c = synthesis.fit_classifier(f.select("scaled", "p_retailprice", "large"), "large", depth=1, beam=20)
    marked = f.derive("guess", c)
    return spark.createDataFrame([(synthesis.satisfies(f, e, "target", 1e-6), round(synthesis.f1_from_binary(marked, "large", "guess"), 6), marked.n_rows())], "regression_fits boolean, classifier_f1 double, n long")


@query("SELECT 0.0 AS loss, true AS shallow, count(*) AS n, count(*) FILTER (l_quantity > 25 OR l_returnflag = 'R') AS predicted FROM lineitem")
def decision_tree_default(spark, sf_dir):
    """The default tree finds a rule that joins a threshold and a text value."""
    f = t(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag").filter_all_just()
    # Whole quantities and the two values of the flag that percentiles meet.
    f = f.derive("label", fn.if_then_else((col("l_quantity") > 25.0) | (col("l_returnflag") == "R"), 1, 0))
    config = tree.TreeConfig(percentiles=tuple(range(0, 101, 2)))
    model = tree.fit_tree(f, "label", config)
    e = tree.prune(tree.to_expr(model))
    marked = f.derive("predicted", e)
    return spark.createDataFrame([(round(tree.loss(f, "label", model), 6), tree.depth(model) <= config.max_depth, marked.n_rows(), marked.filter_where(col("predicted") == 1).n_rows())], "loss double, shallow boolean, n long, predicted long")


# --- plots --------------------------------------------------------------------------------------------


@query("""
WITH g AS (SELECT o_orderstatus AS label, round(sum(o_totalprice), 2) AS n FROM orders GROUP BY 1), c AS (SELECT o_orderstatus || ' - ' || o_orderpriority AS label, count(*)::DOUBLE AS n FROM orders GROUP BY 1)
SELECT 'sums' AS kind, label, n FROM g UNION ALL SELECT 'counts', label, n FROM c""")
def grouped_bars(spark, sf_dir):
    f = t(spark, sf_dir, "orders")
    a = plots.grouped_sums(f, "o_orderstatus", "o_totalprice").select(F.lit("sums").alias("kind"), "label", F.round("n", 2).alias("n"))
    return a.unionByName(plots.grouped_sums(f, "o_orderstatus", "o_orderpriority").select(F.lit("counts").alias("kind"), "label", F.col("n").cast("double").alias("n")))


@query("""
WITH s AS (SELECT p_brand AS label, sum(p_size)::BIGINT AS p_size, round(sum(p_retailprice), 2) AS p_retailprice, row_number() OVER (ORDER BY sum(p_size) + sum(p_retailprice) DESC, p_brand) AS r FROM part GROUP BY 1)
SELECT label, p_size, p_retailprice FROM s WHERE r <= 4 UNION ALL SELECT 'Other (' || count(*) || ' items)', sum(p_size)::BIGINT, round(sum(p_retailprice), 2) FROM s WHERE r > 4 HAVING count(*) > 0""")
def stacked_bars(spark, sf_dir):
    return plots.stacked_sums(t(spark, sf_dir, "part"), "p_brand", ["p_size", "p_retailprice"], 4).withColumn("p_retailprice", F.round("p_retailprice", 2))


@query("""
WITH s AS (SELECT p_brand AS label, round(sum(p_retailprice), 2) AS n, row_number() OVER (ORDER BY sum(p_retailprice) DESC, p_brand) AS r FROM part GROUP BY 1)
SELECT label, n FROM s WHERE r <= 8 UNION ALL SELECT 'Other (' || count(*) || ' items)', round(sum(n), 2) FROM s WHERE r > 8 HAVING count(*) > 0""")
def pie_of_labelled_values(spark, sf_dir):
    return plots.pie_shares(t(spark, sf_dir, "part"), "p_retailprice", "p_brand").select("label", F.round("n", 2).alias("n"))


@query("""
WITH c AS (SELECT p_type AS label, count(*) * 100.0 / (SELECT count(*) FROM part) AS share FROM part GROUP BY 1)
SELECT label, round(share, 6) AS share FROM c WHERE share >= 2 UNION ALL SELECT 'Others', round(sum(share), 6) FROM c WHERE share < 2 HAVING sum(share) >= 1""")
def market_share(spark, sf_dir):
    return plots.market_share(t(spark, sf_dir, "part"), "p_type").withColumn("share", F.round("share", 6))


@query("""
SELECT unnest(['l_quantity', 'l_extendedprice']) AS name, unnest([min(l_quantity), min(l_extendedprice)]) AS low, unnest([round(quantile_cont(l_quantity, 0.25), 4), round(quantile_cont(l_extendedprice, 0.25), 4)]) AS q1,
       unnest([round(median(l_quantity), 4), round(median(l_extendedprice), 4)]) AS q2, unnest([round(quantile_cont(l_quantity, 0.75), 4), round(quantile_cont(l_extendedprice, 0.75), 4)]) AS q3, unnest([max(l_quantity), max(l_extendedprice)]) AS high FROM lineitem""")
def box_plot_numbers(spark, sf_dir):
    found = plots.five_numbers(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(n, v[0], *(round(x, 4) for x in v[1:4]), v[4]) for n, v in found], "name string, low double, q1 double, q2 double, q3 double, high double")


@query("""
SELECT 18 AS scatter, 18 AS lines, count(DISTINCT s_nationkey) AS categories, 2 AS correlations, true AS pages, count(*) AS shown FROM supplier""")
def plots_as_text(spark, sf_dir):
    """Lines of the text plots, whether the pages hold a picture, and how many rows a scatter plot shows."""
    f = t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    named = f.derive("nation", col("s_nationkey")).apply(lambda c: c.cast("string"), "nation")
    pages = [plots.scatter_html(f, "s_suppkey", "s_acctbal"), plots.lines_html(f, "s_suppkey", ["s_acctbal"]), plots.box_html(f, ["s_acctbal"]), plots.pie_html(named, "nation"), plots.stacked_html(named, "nation", ["s_acctbal"]), plots.grouped_html(named, "nation", "s_acctbal"), plots.histogram_html(f, "s_acctbal"), plots.categories_html(named, "nation")]
    texts = [plots.plot_scatter(f, "s_suppkey", "s_acctbal"), plots.plot_lines(f, "s_suppkey", ["s_acctbal"]), plots.plot_grouped_bars(named, "nation", "s_acctbal"), plots.plot_correlation_matrix(f.select("s_suppkey", "s_acctbal"))]
    facts = (*(len(x.splitlines()) for x in texts), all("<svg" in p for p in pages) and all(x.strip() for x in (plots.plot_all_histograms(f), plots.plot_categorical_summary(named), plots.plot_heatmap(f), plots.plot_smart_bars(named, "nation"), plots.plot_smart_pie(named, "nation"))), plots.points(f, "s_suppkey", ["s_acctbal"]).count())
    return spark.createDataFrame([facts], "scatter int, lines int, categories long, correlations int, pages boolean, shown long")

