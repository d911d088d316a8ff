"""`Frame`: verbs over a Spark table with an expression language, optional columns and row order.

A frame keeps which columns are required (free of missing values), the expressions that derived
columns, and the keys it was last sorted by. Positional verbs follow that order; without one they
follow the order of the source (see `positions`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ColumnNotFound, DuplicateColumn, EmptyData, EngineError, NotOptional, TypeMismatch
from tessera.functions.expr import Agg, Col, Context, Expr, Lit, Named, aggregates_of, lift
from tessera.operators.values import Values, spooled
from tessera.sources.scratch import keep

POSITION = "__position"


def native_aggregate(node: Agg, c: Context, order: Any = None) -> Column:
    """The Spark aggregate of a node whose operand is a row expression; see `grouping.RowOrder`."""
    inner = node.arg.build(Context(c.nullable))
    return node.make(inner, order) if node.ordered else node.make(inner)


class Frame:
    """`unsorted`: the same rows before a sort that was the last verb, for what carries its own order."""

    def __init__(self, df: DataFrame, required: Iterable[str] = (), derived: dict[str, Expr] | None = None, order: Sequence[tuple[str, bool]] = (), unsorted: DataFrame | None = None):
        self.df = df
        self.unsorted = df if unsorted is None else unsorted
        self.required = frozenset(required) | {f.name for f in df.schema.fields if not f.nullable}
        self.derived = dict(derived or {})
        self.order = tuple(order)

    # --- construction ---------------------------------------------------------------------------

    @classmethod
    def empty(cls, spark: SparkSession) -> Frame:
        return cls(spark.createDataFrame([], T.StructType([])))

    @classmethod
    def from_columns(cls, spark: SparkSession, columns: dict[str, list] | Sequence[tuple[str, list]], types: dict[str, str] | None = None) -> Frame:
        """From named lists; shorter ones are padded with missing values."""
        columns = dict(columns)
        n = max((len(v) for v in columns.values()), default=0)
        rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(n)]
        types = types or {}
        schema = T.StructType([T.StructField(k, T._parse_datatype_string(types[k]) if k in types else _kind_of(v), len(v) < n or any(x is None for x in v)) for k, v in columns.items()])
        return cls(spark.createDataFrame(rows, schema))

    @classmethod
    def from_unnamed(cls, spark: SparkSession, columns: Sequence[list]) -> Frame:
        return cls.from_columns(spark, {str(i): c for i, c in enumerate(columns)})

    @classmethod
    def from_rows(cls, spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> Frame:
        """From rows; cells of one column must be of one type."""
        for i, name in enumerate(names):
            kinds = {type(r[i]) for r in rows if r[i] is not None}
            if len(kinds) > 1:
                raise TypeMismatch(f"column '{name}' has cells of types {sorted(k.__name__ for k in kinds)}")
        return cls.from_columns(spark, {n: [r[i] for r in rows] for i, n in enumerate(names)})

    def with_(self, df: DataFrame, **changes) -> Frame:
        kept = set(df.columns)
        state = {"required": self.required & kept, "derived": {k: v for k, v in self.derived.items() if k in kept}, "order": self.order if {c for c, _ in self.order} <= kept else ()}
        return Frame(df, **(state | changes))

    # --- metadata -------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def is_null(self) -> bool:
        """Whether the frame has no columns."""
        return not self.df.columns

    def n_rows(self) -> int:
        return self.df.count()

    def n_columns(self) -> int:
        return len(self.df.columns)

    def dimensions(self) -> tuple[int, int]:
        return self.n_rows(), self.n_columns()

    def has_missing(self, name: str) -> bool:
        return self.df.where(self._c(name).isNull()).limit(1).count() > 0

    def all_missing(self, name: str) -> bool:
        return self.df.where(self._c(name).isNotNull()).limit(1).count() == 0

    def is_numeric(self, name: str) -> bool:
        """Required and of a number type."""
        return name in self.required and isinstance(self.field(name).dataType, T.NumericType)

    def has_type(self, name: str, kind: str) -> bool:
        return self.field(name).dataType.simpleString() == kind

    def field(self, name: str) -> T.StructField:
        self.check(name)
        return self.df.schema[name]

    def check(self, *names: str) -> None:
        for n in names:
            if n not in self.df.columns:
                raise ColumnNotFound(n, self.df.columns)

    def _c(self, name: str) -> Column:
        self.check(name)
        return F.col(f"`{name}`")

    def describe_columns(self) -> DataFrame:
        """name, n_present, n_missing, type: one row a column, by n_present; one pass over the data."""
        cs = self.df.columns
        one = self.df.agg(*(F.count(f"`{c}`").alias(f"p{i}") for i, c in enumerate(cs)), F.count(F.lit(1)).alias("n"))
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"p{i}").alias("n_present"), (F.col("n") - F.col(f"p{i}")).alias("n_missing"), F.lit(self.df.schema[c].dataType.simpleString()).alias("type")) for i, c in enumerate(cs))))
        return one.select(rows.alias("r")).select("r.*").orderBy("n_present", "name")

    def pipe(self, f: Callable[..., Any], *args, **kwargs):
        return f(self, *args, **kwargs)

    def fold(self, f: Callable[[Any, Frame], Frame], items: Iterable) -> Frame:
        return reduce(lambda frame, x: f(x, frame), items, self)

    # --- expressions ----------------------------------------------------------------------------

    def context(self) -> Context:
        return Context({c: c not in self.required for c in self.df.columns})

    def compile(self, e: Expr) -> Column:
        """A row expression; aggregates in it stand for their value over the whole frame."""
        c = self.context()
        c.aggregate = self._whole
        return lift(e).build(c)

    def _whole(self, node: Agg) -> Column:
        """The aggregate over all rows as an uncorrelated scalar subquery: one row, no window."""
        from tessera.operators.grouping import aggregate_frame

        return aggregate_frame(self, [], [Named("value", node)], keep_empty=True).scalar()

    # --- projection -----------------------------------------------------------------------------

    def select(self, *names: str) -> Frame:
        self.check(*names)
        return self.with_(self.df.select(*(f"`{n}`" for n in dict.fromkeys(names))))

    def exclude(self, *names: str) -> Frame:
        return self.with_(self.df.drop(*names))

    def select_by(self, *criteria: Callable[[Frame], list[str]]) -> Frame:
        """Columns that any criterion picks, in the frame's order."""
        picked = {n for c in criteria for n in c(self)}
        return self.select(*(n for n in self.df.columns if n in picked))

    def cube(self, rows: int, cols: int) -> Frame:
        """The first rows of the first columns."""
        return self.take(rows).select(*self.df.columns[: max(cols, 0)])

    def derive(self, name: str, e: Expr) -> Frame:
        e = lift(e)
        required = self.required - {name} | (set() if e.nullable(self.context()) else {name})
        return self.with_(self.df.withColumn(name, self.compile(e)), required=required, derived=self.derived | {name: e})

    def derive_with_expr(self, name: str, e: Expr) -> tuple[Expr, Frame]:
        return Col(name), self.derive(name, e)

    def derive_many(self, *named: Named) -> Frame:
        """All expressions see the frame as it is now."""
        c = self.context()
        required = self.required - {n.name for n in named} | {n.name for n in named if not n.expr.nullable(c)}
        return self.with_(self.df.withColumns({n.name: self.compile(n.expr) for n in named}), required=required, derived=self.derived | {n.name: n.expr for n in named})

    def apply(self, f: Callable[[Column], Column], name: str) -> Frame:
        return self.apply_many(f, [name])

    def apply_many(self, f: Callable[[Column], Column], names: Sequence[str]) -> Frame:
        return self.with_(self.df.withColumns({n: f(self._c(n)) for n in names}), required=self.required - set(names))

    def apply_int(self, f: Callable[[Column], Column], name: str) -> Frame:
        return self._apply_typed(f, name, T.IntegralType)

    def apply_double(self, f: Callable[[Column], Column], name: str) -> Frame:
        return self._apply_typed(f, name, T.DoubleType)

    def _apply_typed(self, f, name, kind) -> Frame:
        if not isinstance(self.field(name).dataType, kind):
            raise TypeMismatch(f"column '{name}' is {self.field(name).dataType.simpleString()}")
        return self.apply(f, name)

    def safe_apply(self, f: Callable[[Column], Column], name: str) -> Frame | Exception:
        """The changed frame, or the error instead of raising it."""
        try:
            out = self.apply(f, name)
            _ = out.df.schema
            return out
        except Exception as error:  # handed to the caller
            return error

    def apply_where(self, test: Callable[[Column], Column], on: str, f: Callable[[Column], Column], name: str) -> Frame:
        return self.with_(self.df.withColumn(name, F.when(test(self._c(on)), f(self._c(name))).otherwise(self._c(name))), required=self.required - {name})

    def apply_at_index(self, i: int, f: Callable[[Column], Column], name: str) -> Frame:
        placed = self.positions()
        order = () if name in {c for c, _ in self.order} else self.order  # the rows stay where they are
        return self.with_(placed.withColumn(name, F.when(F.col(POSITION) == i, f(self._c(name))).otherwise(self._c(name))).drop(POSITION), required=self.required - {name}, order=order)

    def rename(self, old: str, new: str) -> Frame:
        self.check(old)
        if new in self.df.columns and new != old:
            raise DuplicateColumn(f"column '{new}' exists")
        names = {old: new}
        return Frame(self.df.withColumnRenamed(old, new), {names.get(c, c) for c in self.required}, {names.get(k, k): v for k, v in self.derived.items()}, [(names.get(c, c), a) for c, a in self.order])

    def rename_many(self, pairs: Sequence[tuple[str, str]]) -> Frame:
        return reduce(lambda f, p: f.rename(*p), pairs, self)

    def rename_safe(self, old: str, new: str) -> Frame | Exception:
        """The renamed frame, or the error instead of raising it."""
        try:
            return self.rename(old, new)
        except EngineError as error:  # handed to the caller
            return error

    def clone_column(self, source: str, name: str) -> Frame:
        return self.with_(self.df.withColumn(name, self._c(source)), required=self.required | ({name} if source in self.required else set()))

    # --- filters --------------------------------------------------------------------------------

    def filter_where(self, e: Expr) -> Frame:
        return self.with_(self.df.where(self.compile(e)))

    def filter(self, e: Expr | str, test: Callable[[Column], Column]) -> Frame:
        """Rows where test(column of e) holds."""
        return self.with_(self.df.where(test(self.compile(Col(e) if isinstance(e, str) else e))))

    def filter_by(self, test: Callable[[Column], Column], e: Expr | str) -> Frame:
        return self.filter(e, test)

    def filter_just(self, name: str) -> Frame:
        """Rows where the column is present; it becomes required."""
        return self.with_(self.df.where(self._c(name).isNotNull()), required=self.required | {name})

    def filter_nothing(self, name: str) -> Frame:
        """Rows where the column is missing; all rows if it is required."""
        self.check(name)
        return self if name in self.required else self.with_(self.df.where(self._c(name).isNull()))

    def filter_all_just(self) -> Frame:
        return reduce(lambda f, c: f.filter_just(c), self.df.columns, self)

    def filter_all_nothing(self) -> Frame:
        """Rows where every optional column is missing."""
        return reduce(lambda f, c: f.filter_nothing(c), self.df.columns, self)

    # --- order and position ---------------------------------------------------------------------

    def sort_by(self, *keys: tuple[str, bool] | str) -> Frame:
        """Sort by column names or (name, ascending); missing values first when ascending."""
        order = [(k, True) if isinstance(k, str) else k for k in keys]
        self.check(*(n for n, _ in order))
        return self.with_(self.unsorted.orderBy(*_sort_columns(order)), order=order, unsorted=self.unsorted)

    def shuffle(self, seed: int) -> Frame:
        return self.with_(self.df.orderBy(F.rand(seed)), order=())

    def positions(self) -> DataFrame:
        """The rows in order, with a dense POSITION from 0.

        Rows are counted by partition, one number each, and the partitions' bases are added to the
        places inside them, so no partition is gathered. Plans that shuffle may deal their rows out
        differently each time they run (ranges are sampled, partitions merged), so their rows are
        written once, with their marks, and counted and placed from there.
        """
        spark = self.df.sparkSession
        marked = self.df.withColumn("__mark", F.monotonically_increasing_id())
        moved = "Exchange" in marked._jdf.queryExecution().executedPlan().toString()
        if moved:
            marked = keep(marked, "positions")
        part = F.shiftright("__mark", 33)
        bases, base = [], 0
        for p, n in sorted(marked.groupBy(part.alias("p")).count().collect()):  # a row for each partition
            bases.append((p, base))
            base += n
        bases = F.broadcast(spark.createDataFrame(bases, "__part long, __base long"))
        placed = marked.join(bases, part == F.col("__part")).withColumn(POSITION, F.col("__base") + F.col("__mark").bitwiseAND(F.lit((1 << 33) - 1)))
        placed = placed.drop("__mark", "__part", "__base")
        return placed.orderBy(POSITION) if moved else placed

    def take(self, n: int) -> Frame:
        return self.with_(self.df.limit(max(n, 0)))

    def drop(self, n: int) -> Frame:
        return self.slice(n, None)

    def take_last(self, n: int) -> Frame:
        n = max(n, 0)
        if self.order:
            back = self.df.orderBy(*_sort_columns([(c, not up) for c, up in self.order])).limit(n)
            return self.with_(back.orderBy(*_sort_columns(self.order)))
        return self._by_position(lambda total: (max(total - n, 0), total))

    def drop_last(self, n: int) -> Frame:
        return self._by_position(lambda total: (0, max(total - max(n, 0), 0)))

    def slice(self, start: int, end: int | None) -> Frame:
        """Rows start .. end - 1, held to what there is."""
        start = max(start, 0)
        if self.order:
            out = self.df.offset(start)
            return self.with_(out if end is None else out.limit(max(end - start, 0)))
        return self._by_position(lambda total: (start, total if end is None else max(end, start)))

    def _by_position(self, bounds: Callable[[int], tuple[int, int]]) -> Frame:
        a, b = bounds(self.df.count())
        if self.order:
            return self.with_(self.df.offset(a).limit(b - a))
        placed = self.positions()
        return self.with_(placed.where((F.col(POSITION) >= a) & (F.col(POSITION) < b)).drop(POSITION))

    # --- sampling -------------------------------------------------------------------------------

    def sample(self, seed: int, p: float) -> Frame:
        return self.with_(self.df.where(F.rand(seed) >= 1 - p))

    def random_split(self, seed: int, p: float) -> tuple[Frame, Frame]:
        """Disjoint parts of about p and 1 - p of the rows, by a hash of the row and the seed: the same
        row falls into the same part however often it is computed."""
        u = self._uniform(seed)
        return self.with_(self.df.where(u <= p)), self.with_(self.df.where(u > p))

    def k_folds(self, seed: int, n: int) -> list[Frame]:
        """n disjoint folds, the last first."""
        fold = F.floor(self._uniform(seed) * n)
        return [self.with_(self.df.where(fold == i)) for i in reversed(range(n))]

    def _uniform(self, seed: int) -> Column:
        bits = F.xxhash64(F.lit(seed), *(f"`{c}`" for c in self.df.columns))
        return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))

    # --- merging --------------------------------------------------------------------------------

    def union(self, other: Frame) -> Frame:
        """All rows of both by column name; a column of one side only is missing in the other, one of
        two types becomes struct<left, right> with one side present. A frame without rows counts only
        if the other has none either."""
        from tessera.operators.merging import union

        return union(self, other)

    def beside(self, other: Frame) -> Frame:
        """Rows of both by position; columns of `other` replace those of the same name."""
        from tessera.operators.merging import beside

        return beside(self, other)

    def insert(self, name: str, values: Sequence, default: Any = None, type_: str | None = None) -> Frame:
        """Attach a list by position, padded with `default`; the frame grows if the list is longer."""
        own = Frame.from_columns(self.df.sparkSession, {name: list(values)}, {name: type_} if type_ else None)
        out = self.beside(own)
        return out if default is None else Frame(out.df.fillna({name: default}), out.required | {name}, out.derived)

    def distinct(self) -> Frame:
        return self.with_(self.df.dropDuplicates(), order=())

    # --- missing values -------------------------------------------------------------------------

    def impute(self, name: str, value: Any) -> Frame:
        """Fill an optional column; it becomes required."""
        if isinstance(value, Expr) and not isinstance(value, Lit):
            return self.impute_with(name, value)
        self.check(name)
        if name in self.required:
            raise NotOptional(f"column '{name}' has no missing values to fill")
        value = value.value if isinstance(value, Lit) else value
        filled = F.coalesce(self._c(name), F.lit(value).cast(self.field(name).dataType))
        return self.with_(self.df.withColumn(name, filled), required=self.required | {name})

    def impute_with(self, name: str, aggregate: Expr) -> Frame:
        """Fill with an aggregate of the column's present values."""
        if name in self.required:
            raise NotOptional(f"column '{name}' has no missing values to fill")
        if not aggregates_of(aggregate):
            raise TypeMismatch("imputation needs an aggregate")
        present = self.filter_just(name)
        value = present.compile(aggregate)
        return self.with_(self.df.withColumn(name, F.coalesce(self._c(name), value)), required=self.required | {name})

    # --- extraction -----------------------------------------------------------------------------

    def values(self, name: str) -> Values:
        """The cells of a column, as a list that lies on the driver's disk."""
        return Values(self.df.select(self._c(name)), cells=True)

    def vector(self, name: str, kind: str = "double"):
        """A numpy array: to integers half-even, missing as NaN in floating kinds."""
        return self.select(name).matrix(kind)[:, 0]

    def matrix(self, kind: str = "double"):
        """Row-major matrix of all columns, mapped from a file of the driver's disk: it is filled by
        partition, and pages of it come to memory as they are used."""
        import tempfile

        import numpy as np

        width, kept = len(self.df.columns), np.dtype(_HOST_KINDS[kind])
        if not width:
            return np.zeros((0, 0))
        numbers = self.df.select(*(self._number(n, kind).alias(str(i)) for i, n in enumerate(self.df.columns)))
        with tempfile.TemporaryFile() as file:
            for lost, data in spooled(numbers.mapInArrow(_packed(_HOST_KINDS[kind]), "lost long, data binary")):
                if lost:
                    raise TypeMismatch("a column has missing values")
                file.write(data)
            file.flush()
            n = file.tell() // (width * kept.itemsize)
            return np.asarray(np.memmap(file, kept, "r+", shape=(n, width))) if n else np.zeros((0, width), kept)

    def _number(self, name: str, kind: str) -> Column:
        c = self._c(name)
        if kind == "long":
            return (F.bround(c) if isinstance(self.field(name).dataType, (T.FloatType, T.DoubleType)) else c).cast("long")
        return F.coalesce(c.cast("double"), F.lit(float("nan")))

    def tensor(self, kind: str = "double"):
        """A vector for one column, else a matrix."""
        m = self.matrix(kind)
        return m[:, 0] if m.shape[1] == 1 else m

    def rows(self) -> Values:
        """The rows by column name, as a list that lies on the driver's disk."""
        return Values(self.df)

    def row_value(self, i: int, name: str):
        """The cell of one row, by position."""
        found = self.slice(i, i + 1).df.select(self._c(name)).collect() if i >= 0 else []
        if not found:
            raise EmptyData(f"there is no row {i}")
        return found[0][0]

    def head_column(self, name: str):
        found = self.df.select(self._c(name)).limit(1).collect()
        if not found:
            raise EmptyData(f"column '{name}' is empty")
        return found[0][0]

    def equals(self, other: Frame) -> bool:
        """Columns by name, rows in order; rows of one position are compared in Spark."""
        names = sorted(self.df.columns)
        if names != sorted(other.df.columns):
            return False
        if not names or self.df.count() != other.df.count():
            return not names
        a, b = (f.positions().select(F.col(POSITION).alias(f"p{i}"), *(F.col(f"`{n}`").alias(f"c{i}_{k}") for k, n in enumerate(names))) for i, f in enumerate((self, other)))
        if [f.dataType for f in a.schema.fields] != [f.dataType for f in b.schema.fields]:
            return False
        same = reduce(lambda x, y: x & y, (F.col(f"c0_{k}").eqNullSafe(F.col(f"c1_{k}")) for k in range(len(names))))
        return a.join(b, F.col("p0") == F.col("p1")).where(~same).isEmpty()


_HOST_KINDS = {"long": "int64", "double": "float64", "float": "float32"}


def _packed(kind: str) -> Callable:
    """For each batch its missing cells, and its numbers row by row as bytes of the kind."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lost = sum(c.null_count for c in b.columns)
            data = b"" if lost else np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(kind).tobytes()
            yield pa.RecordBatch.from_pydict({"lost": [lost], "data": pa.array([data], pa.binary())})

    return pack


def _sort_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() if up else F.col(f"`{c}`").desc_nulls_last() for c, up in order]


def _kind_of(values: list) -> T.DataType:
    present = [v for v in values if v is not None]
    if not present:
        return T.StringType()
    if isinstance(present[0], bool):
        return T.BooleanType()
    if all(isinstance(v, int) for v in present):
        return T.LongType()
    if all(isinstance(v, (int, float)) for v in present):
        return T.DoubleType()
    return T._infer_type(present[0])


# --- criteria of select_by ----------------------------------------------------------------------


def by_name(name: str):
    return lambda f: [n for n in f.columns if n == name]


def by_property(test: Callable[[T.StructField], bool]):
    return lambda f: [x.name for x in f.df.schema.fields if test(x)]


def by_name_property(test: Callable[[str], bool]):
    return lambda f: [n for n in f.columns if test(n)]


def by_name_range(first: str, last: str):
    """Columns from one to the other, by position."""

    def pick(f: Frame) -> list[str]:
        f.check(first, last)
        return f.columns[f.columns.index(first) : f.columns.index(last) + 1]

    return pick


def by_index_range(i: int, j: int):
    """Columns i to j, j too."""
    return lambda f: f.columns[max(i, 0) : j + 1]
