"""Lazy scans, and the same row-local verbs over a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions.expr import Expr
from tessera.operators.frame import Frame
from tessera.sources.csv import ReadOptions, read_csv, write_separated


@dataclass(frozen=True)
class LazyFrame:
    """A source and the verbs to run over it; Spark plans them as one query when it runs."""

    source: Callable[[], Frame]
    steps: tuple[Callable[[Frame], Frame], ...] = ()

    def derive(self, name: str, e: Expr) -> LazyFrame:
        return replace(self, steps=(*self.steps, lambda f: f.derive(name, e)))

    def select(self, *names: str) -> LazyFrame:
        return replace(self, steps=(*self.steps, lambda f: f.select(*names)))

    def filter(self, e: Expr) -> LazyFrame:
        return replace(self, steps=(*self.steps, lambda f: f.filter_where(e)))

    def write_csv(self, path: str, separator: str = ",") -> None:
        """Run, and write the rows as they come, without gathering them."""
        write_separated(self.run(), path, separator)

    def run(self) -> Frame:
        """Aggregates in expressions are over the whole source."""
        frame = self.source()
        for step in self.steps:
            frame = step(frame)
        return frame


def scan_csv(spark: SparkSession, path: str, options: ReadOptions | None = None) -> LazyFrame:
    return LazyFrame(lambda: read_csv(spark, path, options))


def scan_parquet(spark: SparkSession, path: str) -> LazyFrame:
    return LazyFrame(lambda: Frame(spark.read.parquet(path)))


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType | str) -> LazyFrame:
    """Files that arrive in a folder, as a stream; row-local verbs only."""
    return LazyFrame(lambda: Frame(spark.readStream.schema(schema).parquet(path)))


def write_stream(frame: Frame, path: str, checkpoint: str, once: bool = True):
    """Start writing a streamed frame as Parquet; with `once` it ends when all there is has been read."""
    writer = frame.df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def is_streaming(frame: Frame | DataFrame) -> bool:
    return (frame.df if isinstance(frame, Frame) else frame).isStreaming
