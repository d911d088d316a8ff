"""JSON: a top-level array of objects, or one object a line."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ParseFailure
from tessera.operators.frame import Frame


def read_json(spark: SparkSession, path: str, lines: bool = False) -> Frame:
    """Numbers become doubles; a column of mixed kinds becomes its JSON text; an absent key is missing."""
    df = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").option("primitivesAsString", False).json(path)
    if df.columns == ["_corrupt_record"]:
        raise ParseFailure(f"{path} is not an array of objects")
    whole = {f.name: _doubles(f.dataType) for f in df.schema.fields}
    return Frame(df.select(*(F.col(f"`{n}`").cast(t).alias(n) for n, t in whole.items())))


def read_json_either(spark: SparkSession, path: str) -> Frame | Exception:
    """The frame, or the error instead of raising it."""
    try:
        return read_json(spark, path)
    except Exception as error:  # handed to the caller
        return error


def _doubles(t: T.DataType) -> T.DataType:
    if isinstance(t, T.NumericType):
        return T.DoubleType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_doubles(t.elementType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _doubles(f.dataType), True) for f in t.fields])
    return t
