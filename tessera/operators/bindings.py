"""Column references as attributes, under identifiers made of the columns' names."""

from __future__ import annotations

import keyword
import re
from types import SimpleNamespace

from pyspark.sql import SparkSession

from tessera.functions.expr import Col
from tessera.operators.frame import Frame


def sanitize(name: str) -> str:
    """Lower-case identifier: odd characters become underscores, those at the end of a name with
    letters or digits go, and a name that starts badly or is a keyword gets one at either end."""
    text = re.sub(r"[^\w]", "_", name.strip(), flags=re.ASCII)
    if re.search(r"[A-Za-z0-9]", text):
        text = re.sub(r"_+", "_", text).strip("_").lower()
    if text[:1].isdigit() or keyword.iskeyword(text) or text in ("data", "type", "where", "let", "of", "then", "module", "instance", "newtype", "case", "do", "deriving", "infix", "infixl", "infixr"):
        return f"_{text}_"
    return text if re.search(r"[a-z0-9]", text) else f"_{text}_"


def columns(frame: Frame, prefix: str = "") -> SimpleNamespace:
    return SimpleNamespace(**{(prefix + "_" if prefix else "") + sanitize(n): Col(n) for n in frame.columns})


def columns_of_csv(spark: SparkSession, path: str, options=None) -> SimpleNamespace:
    from tessera.sources.csv import read_csv

    return columns(read_csv(spark, path, options))


def columns_of_parquet(spark: SparkSession, path: str) -> SimpleNamespace:
    return columns(Frame(spark.read.parquet(path)))
