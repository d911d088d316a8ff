"""Parquet: files, folders and globs; columns of differing schemas are padded with missing values."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.frame import Frame


def read_parquet(spark: SparkSession, path: str, decimals_as_double: bool = False) -> Frame:
    return Frame(_decimals(spark.read.parquet(path), decimals_as_double))


def read_parquet_files(spark: SparkSession, path: str, decimals_as_double: bool = False) -> Frame:
    return Frame(_decimals(spark.read.option("mergeSchema", True).parquet(path), decimals_as_double))


def _decimals(df, wanted: bool):
    short = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType) and f.dataType.precision <= 18]
    return df.withColumns({n: F.col(f"`{n}`").cast("double") for n in short}) if wanted and short else df


def write_parquet(frame: Frame, path: str) -> None:
    frame.df.write.mode("overwrite").parquet(path)
