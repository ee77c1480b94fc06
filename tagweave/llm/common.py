"""What the operators of this subpackage share: tables and files in the folder that the whole cluster sees, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import fresh_dir, shared_dir, written

__all__ = ["WORD", "bounded", "filesystem", "fresh_dir", "input_bytes", "ranges_for", "shared_dir", "sliced", "texts_of", "with_columns", "written"]

#: A word: what stands between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; it must be cheap to count (a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of a batch that goes to a Python worker; Spark's own default is 64 MB, of which several are held at a time.
BATCH_BYTES = 8 << 20


def with_columns(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: Iterable[T.StructField]) -> DataFrame:
    """mapInArrow with a schema of these fields. The session's batches are made no larger than BATCH_BYTES."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":  # a size that somebody chose stays
        conf.set(key, f"{BATCH_BYTES}b")
    return df.mapInArrow(fn, T.StructType(list(fields)))


#: Bytes of stored input for each range of a sort; compressed text is about a third of its size.
RANGE_BYTES = 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Stored bytes of the tables that df reads, as far as they are known before they are read."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # what has no size of its own counts as the largest number there is


def ranges_for(df: DataFrame, each: int = RANGE_BYTES) -> int:
    """Ranges for a sort of df: as many as the session's shuffles have, and more where the tables that it reads are larger."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // each))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return pc.fill_null(batch.column(column), "").cast(pa.binary()).to_pylist()


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        begun, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held + size > limit and i > begun:
                yield batch.slice(begun, i - begun)
                begun, held = i, 0
            held += size
        yield batch.slice(begun)


def filesystem(uri: str):
    """pyarrow's file system and path for a URI of the shared folder (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
