"""Shared storage: tables and files that every executor and the driver can see.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only on one machine, as in tests,
a folder of our own is made and set where that is unset.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back: the lineage ends there, so a lost executor
    costs nothing that is already written, and the shuffle files of the work so far can go."""
    return store(df, name)[0]


def parquet_options(block: int | None = None, level: int | None = None) -> dict:
    """Of compressed files. block: bytes of a row group, for tables of large cells; level: of the
    compression."""
    given = {"parquet.block.size": block, "parquet.compression.codec.zstd.level": level}
    return {"compression": "zstd"} | {k: v for k, v in given.items() if v}


def store(df: DataFrame, name: str, block: int | None = None, level: int | None = None) -> tuple[DataFrame, str]:
    """`materialise`, and the path, for `drop` once nothing reads the table any more; see `parquet_options`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**parquet_options(block, level)).parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    out = spark.read.schema(schema).parquet(path)
    release(spark)
    return out, path


def release(spark: SparkSession) -> None:
    """Ask for the removal of shuffle files whose plans are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of shared storage."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
