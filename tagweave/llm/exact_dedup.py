"""Exact duplicates by sorting contents: sampled splitters, an external sort, full comparisons of neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded, ranges_for, sliced, written

#: Leading bytes of a text in the sort key. Texts that share them are told apart by a digest before all their bytes, so
#: splitters stay this small however long the texts are, and texts with one opening spread over many ranges.
LEADING = 64
#: Runs at the edges of partitions, up to which their table is broadcast; beyond, the join shuffles.
EDGES = 20_000


def content_sort(docs: DataFrame, keep: str = "largest", normalise: Callable[[Column], Column] | None = None, partitions: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of docs; other columns are left out.

    Texts are equal when normalise makes them the same string; null counts as empty. Of equal texts the row with the
    largest (or smallest) doc_id stays, and of rows equal in that, too, just one. Null ids come before all others; a group
    of null ids alone has keep_id null and keeps one row. No rows give no rows."""
    return _grouped(docs, keep, normalise, (), False, partitions)


def distinct_texts(docs: DataFrame, keep: str = "largest", normalise: Callable[[Column], Column] | None = None, partitions: int | None = None) -> DataFrame:
    """The rows of docs that content_sort keeps, with all their columns, whatever their names. A null text that stays is
    null again. Of the rows with one text a task holds one, however many there are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = _grouped(docs, keep, normalise, others, True, partitions).where("kept")
    name = lambda c: c if c == "doc_id" else "__own_text" if c == "text" else f"__c{others.index(c)}"
    return kept.select(*(F.col(name(c)).alias(c) for c in docs.columns))


def _grouped(docs: DataFrame, keep: str, normalise: Callable[[Column], Column] | None, carry: Sequence[str], only_kept: bool, partitions: int | None) -> DataFrame:
    """What content_sort returns; only_kept: leaves out rows that go, and adds the row's own text as __own_text and the
    columns carry as __c0, __c1 and so on.

    Rows are range-partitioned and sorted by (leading bytes, digest, text, doc_id), whose splitters Spark samples: equal
    texts stand next to each other, and a group that holds a third of all rows is cut between many partitions by its ids.
    Each row's full text is compared with its neighbour's. What a run at either edge of a partition lacks is gathered in a
    table of two rows a partition, by full text."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep: {keep}")
    id_type, up = docs.schema["doc_id"].dataType, keep == "largest"
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = normalise(text) if normalise else text
    by_id = F.col("doc_id").asc_nulls_first() if up else F.col("doc_id").desc_nulls_first()
    # a text goes through the shuffle once: its own form goes with it only where another one is compared
    own = [F.col("text").alias("__raw")] if only_kept and normalise else [F.col("text").isNull().alias("__none")] if only_kept else []
    sorted_rows = (
        docs.select("doc_id", norm.alias("__text"), *own, *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)))
        .withColumn("text_sha256", F.sha2(F.col("__text"), 256))
        .withColumn("__lead", F.substring(F.encode("__text", "UTF-8"), 1, LEADING))
    )
    ranged = sorted_rows.repartitionByRange(partitions or ranges_for(docs), "__lead", "text_sha256", by_id)
    ranged = ranged.sortWithinPartitions("__lead", "text_sha256", "__text", by_id).drop("__lead")
    carried = [f for f in ranged.schema.fields if f.name.startswith("__c") or f.name in ("__raw", "__none")]
    if only_kept and not normalise:
        carried.append(T.StructField("__text", T.StringType()))
    fields = [
        T.StructField("doc_id", id_type),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("__run", T.LongType()),
        T.StructField("__edge", T.BooleanType()),
        T.StructField("keep_id", id_type),
        T.StructField("group_size", T.LongType()),
        T.StructField("__last", T.BooleanType()),
        T.StructField("__edge_text", T.StringType()),
        *carried,
    ]
    names, carried_names = [f.name for f in fields], [f.name for f in carried]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a sorted partition with their runs. Of the run that is still open its size, its last row and its text are
        held, and the ids of its rows if they are all wanted; the text of a run at an edge goes with its last row."""
        base = TaskContext.get().partitionId() << 40
        run, open_text, open_ids, open_last, open_size = 0, None, [], None, 0

        def emit(part: pa.RecordBatch, sizes: np.ndarray, edge: bool, edge_text: str | None) -> pa.RecordBatch:
            """Rows of closed runs, of these sizes; part has all their rows, or with only_kept the last one of each."""
            of = np.arange(len(sizes)) if only_kept else np.repeat(np.arange(len(sizes)), sizes)
            last = np.arange(len(sizes)) if only_kept else np.cumsum(sizes) - 1
            at_end = np.zeros(part.num_rows, bool)
            at_end[last] = True
            first_run = of == 0
            texts = [None] * part.num_rows
            if edge:
                texts[last[0]] = edge_text
            out = {
                "doc_id": part.column("doc_id"),
                "text_sha256": part.column("text_sha256"),
                "__run": pa.array(base + run + of, pa.int64()),
                "__edge": pa.array(first_run & edge),
                "keep_id": part.column("doc_id").take(pa.array(last[of])),
                "group_size": pa.array(sizes[of], pa.int64()),
                "__last": pa.array(at_end),
                "__edge_text": pa.array(texts, pa.string()),
            } | {c: part.column(c) for c in carried_names}
            return pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

        def held(slim: pa.RecordBatch) -> None:
            nonlocal open_last, open_size
            open_last, open_size = slim.take(pa.array([slim.num_rows - 1])), open_size + slim.num_rows  # a copy: the batch may go
            if not only_kept:
                open_ids.append(slim.column("doc_id"))

        def closed(edge: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_last, open_size, run
            if only_kept:
                yield emit(open_last, np.array([open_size]), edge, open_text)
            else:
                ids = pa.chunked_array(open_ids).combine_chunks()
                sha = pa.repeat(open_last.column("text_sha256")[0], open_size)
                yield emit(pa.RecordBatch.from_arrays([ids, sha], names=["doc_id", "text_sha256"]), np.array([open_size]), edge, open_text)
            open_last, open_size, run = None, 0, run + 1
            open_ids.clear()

        for b in sliced(batches, "__text", 1 << 23):
            t = b.column("__text").cast(pa.large_string()) if not pa.types.is_large_string(b.column("__text").type) else b.column("__text")
            slim = b.select(["doc_id", "text_sha256", *carried_names])
            new = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                new[1:] = np.asarray(pc.not_equal(t.slice(1), t.slice(0, b.num_rows - 1)))
            if open_size:
                new[0] = t[0].as_py() != open_text
            heads = np.flatnonzero(new)
            k = int(heads[0]) if len(heads) else b.num_rows  # rows that go on with the open run
            if k:
                held(slim.slice(0, k))
            if not len(heads):
                continue
            if open_size:
                yield from closed(run == 0)
            if run == 0 and len(heads) > 1:  # the partition's first run is at its edge
                open_text = t[k].as_py()
                held(slim.slice(k, int(heads[1]) - k))
                yield from closed(True)
                k, heads = int(heads[1]), heads[1:]
            last = int(heads[-1])
            if last > k:
                whole = slim.slice(k, last - k)
                sizes = np.diff(heads)
                yield emit(whole.take(pa.array(np.cumsum(sizes) - 1)) if only_kept else whole, sizes, False, None)
                run += len(sizes)
            open_text = t[last].as_py()
            held(slim.slice(last))
        if open_size:
            yield from closed(True)

    local = written(ranged.mapInArrow(runs, T.StructType(fields)), "content-sort")
    group = Window.partitionBy("__edge_text")
    best = F.max if up else F.min
    ends = local.where("__edge_text is not null").select("__run", "__edge_text", "keep_id", "group_size")
    joined = ends.select("__run", best("keep_id").over(group).alias("__keep"), F.sum("group_size").over(group).alias("__size"), F.max("__run").over(group).alias("__final"))
    joined = bounded(written(joined, "content-sort-edges"), EDGES)
    whole = local.drop("__edge_text").join(joined, "__run", "left")
    return whole.select(
        "doc_id",
        F.when(F.col("__edge"), F.col("__keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("__size", "group_size").alias("group_size"),
        (F.col("__last") & (~F.col("__edge") | (F.col("__run") == F.col("__final")))).alias("kept"),
        "text_sha256",
        *([(F.col("__raw") if normalise else F.when(~F.col("__none"), F.col("__text"))).alias("__own_text")] if only_kept else []),
        *(f"__c{i}" for i in range(len(carry))),
    )


def op5_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


def exact_dedup_sql(documents: str = "documents") -> str:
    return f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM {documents} WINDOW w AS (PARTITION BY coalesce(text, ''))"""
