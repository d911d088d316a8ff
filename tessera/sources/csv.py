"""Separated text: reading with our own type inference, and writing.

Columns are read as text, cleaned and typed by one aggregation over all rows: a column gets the first
of bool, long, double, date and string that all its present cells parse as. So types do not depend on
the sample of `InferFromSample(n)`: it only rules out kinds that some of its cells fail already, which
all rows then need not be tried for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import java_pattern
from tessera.operators.frame import Frame

# Cells that stand for nothing, and for truth values.
NULLISH = ("Nothing", "NULL", "", " ", "nan", "null", "N/A", "NaN", "NAN", "NA")
TRUE, FALSE = ("True", "true", "TRUE"), ("False", "false", "FALSE")

_INT = r"^[+-]?[0-9]+$"
_DOUBLE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class NoHeader:
    pass


@dataclass(frozen=True)
class UseFirstRow:
    pass


@dataclass(frozen=True)
class ProvideNames:
    names: tuple[str, ...]


@dataclass(frozen=True)
class InferFromSample:
    rows: int = 100


@dataclass(frozen=True)
class SpecifyTypes:
    types: tuple[str, ...]


@dataclass(frozen=True)
class NoInference:
    pass


@dataclass(frozen=True)
class ReadOptions:
    """safe_read: all NULLISH cells are missing, else empty ones only; missing: further such cells;
    multi_line: cells may hold line feeds, so a file is read by one task; False: they don't, so files are
    split; None: a first look at the quotes of all lines tells (see `has_open_lines`)."""

    header: NoHeader | UseFirstRow | ProvideNames = field(default_factory=UseFirstRow)
    types: InferFromSample | SpecifyTypes | NoInference = field(default_factory=InferFromSample)
    safe_read: bool = True
    date_format: str = "%Y-%m-%d"
    separator: str = ","
    max_rows: int | None = None
    missing: tuple[str, ...] = ()
    multi_line: bool | None = None


def read_csv(spark: SparkSession, path: str | Sequence[str], options: ReadOptions | None = None) -> Frame:
    return read_separated(spark, path, options or ReadOptions())


def read_tsv(spark: SparkSession, path: str | Sequence[str], options: ReadOptions | None = None) -> Frame:
    from dataclasses import replace

    return read_separated(spark, path, replace(options or ReadOptions(), separator="\t"))


def read_separated(spark: SparkSession, path: str | Sequence[str], options: ReadOptions) -> Frame:
    many = has_open_lines(spark, path) if options.multi_line is None else options.multi_line
    reader = spark.read.options(sep=options.separator, quote='"', escape='"', multiLine=many, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="", emptyValue="")
    df = reader.csv(path, header=isinstance(options.header, UseFirstRow), inferSchema=False)
    if isinstance(options.header, NoHeader):
        df = df.toDF(*(str(i) for i in range(len(df.columns))))
    elif isinstance(options.header, ProvideNames):
        given = options.header.names[: len(df.columns)]
        df = df.toDF(*given, *(str(i) for i in range(len(given), len(df.columns))))
    if df.columns and df.columns[0].startswith("﻿"):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿").strip('"'))
    if options.max_rows is not None:
        df = df.limit(options.max_rows)
    return type_columns(df, options)


def has_open_lines(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether some line has an odd number of quotes: only then can a cell hold a line feed."""
    lines = spark.read.text(path)
    return not lines.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def cleaned(c: Column, options: ReadOptions) -> Column:
    text = F.trim(c)
    gone = {"", *options.missing} | (set(NULLISH) if options.safe_read else set())
    return F.when(~text.isin(*sorted(gone)), text)


def parsed(c: Column, kind: str, date_format: str) -> Column:
    """The cleaned text as a value of the kind, missing where it is none."""
    if kind == "boolean":
        return F.when(c.isin(*TRUE), F.lit(True)).when(c.isin(*FALSE), F.lit(False))
    if kind == "long":
        return F.when(c.rlike(_INT), c.try_cast("long"))
    if kind == "double":
        return F.when(c.rlike(_DOUBLE), c.try_cast("double"))
    if kind == "date":
        return F.try_to_timestamp(c, F.lit(java_pattern(date_format))).cast("date")
    return c


LATTICE = ("boolean", "long", "double", "date")


def type_columns(df: DataFrame, options: ReadOptions) -> Frame:
    """Clean the text columns of df and give them types."""
    clean = df.select(*(cleaned(F.col(f"`{n}`"), options).alias(n) for n in df.columns))
    if isinstance(options.types, NoInference):
        return Frame(clean)
    if isinstance(options.types, SpecifyTypes):
        kinds = [*options.types.types, *["string"] * len(df.columns)][: len(df.columns)]
        return Frame(clean.select(*((parsed(F.col(f"`{n}`"), k, options.date_format) if k in LATTICE else F.col(f"`{n}`").try_cast(k)).alias(n) for n, k in zip(df.columns, kinds))))
    names = clean.columns
    if not names:
        return Frame(clean)

    def counted(rows: DataFrame, kinds: dict[str, list[str]]):
        cells = [F.count(F.lit(1)).alias("rows")]
        for i, n in enumerate(names):
            c = F.col(f"`{n}`")
            cells += [F.count(c).alias(f"p{i}"), *(F.count(parsed(c, k, options.date_format)).alias(f"{k}{i}") for k in kinds[n])]
        return rows.agg(*cells).first()

    possible = {n: list(LATTICE) for n in names}
    for rows in (clean.limit(max(options.types.rows, 1)), clean):
        found = counted(rows, possible)
        possible = {n: [k for k in possible[n] if found[f"{k}{i}"] == found[f"p{i}"]] for i, n in enumerate(names)}
    shown, required = [], set()
    for i, n in enumerate(names):
        kind = possible[n][0] if possible[n] and found[f"p{i}"] else "string"
        shown.append(parsed(F.col(f"`{n}`"), kind, options.date_format).alias(n))
        if found[f"p{i}"] == found["rows"]:
            required.add(n)
    return Frame(clean.select(*shown), required)


def write_csv(frame: Frame, path: str) -> None:
    write_separated(frame, path, ",")


def write_tsv(frame: Frame, path: str) -> None:
    write_separated(frame, path, "\t")


def write_separated(frame: Frame, path: str, separator: str) -> None:
    """Header and rows, quoted where a cell needs it, missing cells empty."""
    frame.df.write.options(sep=separator, header=True, quote='"', escape='"', nullValue="", emptyValue='""').mode("overwrite").csv(path)
