"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written

#: Links that a task looks at together before they are stored.
LINKS = 1 << 18


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number of its component for each of n numbers, that links a, b join."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        # the root of either end gets the lesser one, so whole components move at once
        for end in (a, b):
            np.minimum.at(new, root[end], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components: of those that a task meets together, one for each node but the first."""

    def fewer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids = pa.chunked_array([c for k in (0, 1) for c in table.column(k).chunks]).combine_chunks().dictionary_encode()
        code = ids.indices.to_numpy().astype(np.int64)
        root = roots(code[: table.num_rows], code[table.num_rows :], len(ids.dictionary))
        other = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(root[other])), ids.dictionary.take(pa.array(other))], schema=held[0].schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= LINKS:
                yield fewer(held)
                held, rows = [], 0
        if held:
            yield fewer(held)

    return links.select("a", "b").mapInArrow(run, links.select("a", "b").schema)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the smaller ones and itself, in small stars) become neighbours of the least of them."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node and component (the smallest node reachable) for every node of links (a, b) that has a neighbour.

    Loops and repeated links don't matter; no links give no rows. Each round is a few shuffles of the links, and rounds grow
    as the logarithm of a component's width. Minima are summed before they are shuffled, and joins on a node with very many
    links can be split."""
    now = written(links.select("a", "b").where("a <> b").distinct(), label)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    old = None
    while (found := mark(now)) != old and found[0]:
        old = found
        now = written(_star(_star(now, True), False), label)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
