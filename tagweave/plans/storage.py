"""Tables between jobs, in the folder that the whole cluster sees."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), a temporary one.
    On a cluster an unset folder is an error: executors would write to folders of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        found = "file://" + tempfile.mkdtemp(prefix="tagweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends in good order."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; it must be cheap to count (a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def filesystem(uri: str):
    """pyarrow's file system and path for a URI (file, hdfs, s3, gs) or a path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there, and lost executors cost nothing that is done."""
    spark, uri = df.sparkSession, fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(uri)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(uri)
