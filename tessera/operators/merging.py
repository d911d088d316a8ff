"""Vertical and horizontal merging of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.frame import POSITION, Frame


def union(a: Frame, b: Frame) -> Frame:
    if a.is_null():
        return b
    if b.is_null():
        return a
    left, right = a.df, b.df
    if sorted((f.name, f.dataType.simpleString()) for f in left.schema.fields) != sorted((f.name, f.dataType.simpleString()) for f in right.schema.fields):
        a_empty, b_empty = left.isEmpty(), right.isEmpty()  # only then do the rows decide about the columns
        if a_empty != b_empty:
            return b if a_empty else a
    for name in set(left.columns) & set(right.columns):
        x, y = left.schema[name].dataType, right.schema[name].dataType
        if x != y:
            kind = f"struct<left:{x.simpleString()},right:{y.simpleString()}>"
            left = left.withColumn(name, F.struct(F.col(f"`{name}`").alias("left"), F.lit(None).cast(y).alias("right")).cast(kind))
            right = right.withColumn(name, F.struct(F.lit(None).cast(x).alias("left"), F.col(f"`{name}`").alias("right")).cast(kind))
    out = left.unionByName(right, allowMissingColumns=True)
    return Frame(out, (a.required & b.required))


def beside(a: Frame, b: Frame) -> Frame:
    """In the order of the positions."""
    if a.is_null():
        return b
    if b.is_null():
        return a
    right = b.positions().withColumnRenamed(POSITION, "__other")
    keep = [c for c in a.columns if c not in b.columns]
    left = a.positions()
    both = left.select(*(f"`{c}`" for c in keep), POSITION).join(right, F.col(POSITION) == F.col("__other"), "full")
    names = [*a.columns, *(c for c in b.columns if c not in a.columns)]
    return Frame(both.orderBy(F.coalesce(POSITION, "__other")).select(*(f"`{c}`" for c in names)))
