"""Near-duplicate documents by min-max hashing of word shingles, with links confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import bounded, sliced, texts_of, with_columns, written
from .textvec import _ODD, mix, ngrams, words

#: Words in a shingle and the similarity in hundredths, unless a caller says otherwise.
SHINGLE, SIMILARITY = 5, 80
#: Values in a band and bands. A pair at the limit of 0.8 shares no band with a chance of (1 - 0.8 ** 6) ** 56 = 4e-8.
ROWS, BANDS = 6, 56
PERMUTATIONS = ROWS * BANDS // 2
_RNG = np.random.default_rng(7)
_A = (_RNG.integers(0, 2**31, (PERMUTATIONS, 1), dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 2**32, (PERMUTATIONS, 1), dtype=np.uint64).astype(np.uint32)
_CHUNK = 512
#: A pair whose values agree in a smaller share isn't compared in full: at a similarity of 0.8 that is 5 standard deviations off.
LEAST_SHARE = 0.69
#: Members of a bucket that are compared with each other in one group of rows.
BLOCK = 512
#: Ids, up to which a table of them is broadcast; beyond, the join shuffles.
IDS = 100_000


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles; with fewer than n words the whole sequence is one."""
    w = words(texts)
    grams, out = ngrams(w.hashes, n), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            h = np.sort(grams[a : b - n + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(ngrams(w.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def extremes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value under each permutation."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), _CHUNK):
        v = _A * x[i : i + _CHUNK]
        v += _B
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """A key for each band, of minima and of maxima under other permutations."""
    half = rows // 2
    v = np.concatenate([low.reshape(bands, half), np.roll(high, PERMUTATIONS // 2).reshape(bands, half)], axis=1).astype(np.uint64)
    key = (v * _ODD[:rows]).sum(axis=1, dtype=np.uint64)
    return mix(key + np.arange(bands, dtype=np.uint64) * _ODD[rows])


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _bands(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key and bands of each row; without words the last two are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(texts_of(b), n)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([band_keys(*extremes(s)).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )

    fields = [docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return with_columns(docs.select("doc_id", "text"), run, fields)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """node, its full set, its minima and maxima, the set's size and the last byte of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(texts_of(b), n)
            values = [np.concatenate(extremes(s)) for s in sets]
            columns = [
                b.column("node"),
                pa.array([s.tobytes() for s in sets], pa.binary()),
                pa.array([v.tobytes() for v in values], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([v.astype(np.uint8).tobytes() for v in values], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    binary = lambda c: T.StructField(c, T.BinaryType())
    fields = [docs.schema["node"], binary("hashes"), binary("extremes"), T.StructField("size", T.LongType()), binary("sketch")]
    names = [f.name for f in fields]
    return with_columns(docs, run, fields)


def _similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= similarity * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                good.append(_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return with_columns(joined.select("a", "b", "x", "y"), run, [pairs.schema["a"], pairs.schema["b"]])


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the block left, those that they meet, and a number for each component."""
    _, comp = np.unique(pdf["component"].to_numpy(), return_inverse=True)
    one, rest = np.flatnonzero(pdf["first"].to_numpy()), np.flatnonzero(~pdf["first"].to_numpy())
    return one, rest if len(rest) else one, comp


def _partners(i: int, some: np.ndarray, values: np.ndarray, sizes: np.ndarray, similarity: int, share: float) -> Iterator[np.ndarray]:
    """Those of some whose sizes allow the similarity and whose values agree with row i's in at least the share."""
    for k in range(0, len(some), 2048):
        j = some[k : k + 2048]
        j = j[100 * np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i])]
        yield j[(values[j] == values[i]).sum(axis=1) >= share * values.shape[1]]


def _meeting(rows: DataFrame, similarity: int, share: float) -> DataFrame:
    """The rows (key, left, other, node) that have a partner in another component in their group of rows (key, left, other,
    first, node, component, size, sketch). A byte of each value is enough: equal values are never missed."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, rest, comp = _sides(pdf)
        values, sizes = np.stack([np.frombuffer(x, np.uint8) for x in pdf["sketch"]]), pdf["size"].to_numpy()
        hit = np.zeros(len(pdf), bool)
        for i in one:
            for j in _partners(i, rest[comp[rest] != comp[i]], values, sizes, similarity, share):
                hit[j] = True
                hit[i] |= len(j) > 0
        return pdf.loc[hit, ["key", "left", "other", "node"]]

    names = ["key", "left", "other", "node"]
    return rows.groupBy("key", "left", "other").applyInPandas(compare, T.StructType([rows.schema[c] for c in names]))


def _linking(rows: DataFrame, similarity: int, share: float) -> DataFrame:
    """Links (a, b) between components in groups (key, left, other) of rows (key, left, other, first, node, component,
    hashes, extremes). first: whether a row is of the block left; the others belong to the block other.

    A pair is compared in the first bucket that it shares, if its minima and maxima agree in at least the share, and in
    full. A group returns links that join what its others haven't joined, so fewer than it has rows."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, rest, comp = _sides(pdf)
        values = np.stack([np.frombuffer(x, np.uint32) for x in pdf["extremes"]])
        keys = np.stack([band_keys(x[:PERMUTATIONS], x[PERMUTATIONS:]) for x in values])
        here = keys == np.array([pdf["key"].iloc[0]], np.int64).view(np.uint64)[0]
        sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        sizes, node, found = np.array([len(x) for x in sets]), pdf["node"].to_numpy(), []
        for i in one:
            for j in _partners(i, rest[comp[rest] != comp[i]], values, sizes, similarity, share):
                shared = keys[j] == keys[i]
                for x in j[here[j, shared.argmax(axis=1)] & shared.any(axis=1)]:
                    if comp[x] != comp[i] and _similar(sets[i], sets[x], similarity):
                        found.append((min(node[i], node[x]), max(node[i], node[x])))
                        comp[comp == comp[x]] = comp[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype=node.dtype)

    kind = rows.schema["node"].dataType
    return rows.groupBy("key", "left", "other").applyInPandas(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _cross_links(members: DataFrame, comps: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between components that meet in a bucket of three nodes or more, found in blocks.

    The component of a bucket's least node is its main one. Rows of other components are dealt into blocks and meet each
    other and the blocks of the main one; rows of the main one needn't meet. So a group of any size that is mostly one
    component costs its size times the number of blocks of the rest, and no group of rows is larger than two blocks. What a
    row takes along to its blocks is a byte for each of its values; only rows with a likely partner take their full sets."""
    rows = members.join(comps, "node", "left").select("key", "hub", "node", F.coalesce("component", "node").alias("component"))
    main = rows.where("node = hub").select("key", F.col("component").alias("main"))
    sizes = (
        rows.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("component").alias("c1"), F.max("component").alias("c2"))
        .where("n > 2 and c1 <> c2")
        .join(main, "key")
    )
    own = rows.join(sizes.select("key", "main"), "key")
    counts = own.groupBy("key").agg(F.ceil(F.sum((F.col("component") != F.col("main")).cast("long")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.sum((F.col("component") == F.col("main")).cast("long")) / BLOCK).cast("int").alias("mains"))
    own = own.join(counts, "key").withColumn("left_row", F.col("component") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.when(F.col("left_row"), F.col("lefts")).otherwise(F.col("mains"))).cast("int"))
    # groups of two blocks of the rest (left <= other) and of a block of the rest with one of the main component (other < 0)
    group = lambda left, other, first: F.struct(left.cast("int").alias("left"), other.cast("int").alias("other"), first.alias("first"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    of_rest = F.concat(
        F.transform(upto(F.col("lefts")), lambda j: group(F.least(F.col("block"), j), F.greatest(F.col("block"), j), F.col("block") <= j)),
        F.transform(upto(F.col("mains")), lambda j: group(F.col("block"), -1 - j, F.lit(True))),
    )
    of_main = F.transform(upto(F.col("lefts")), lambda j: group(j, -1 - F.col("block"), F.lit(False)))
    dealt = own.withColumn("g", F.explode(F.when(F.col("left_row"), of_rest).otherwise(of_main))).select("key", "g.left", "g.other", "g.first", "node", "component")
    dealt = written(dealt, "minmax-dealt")
    likely = written(_meeting(dealt.join(sets.select("node", "size", "sketch"), "node"), similarity, LEAST_SHARE), "minmax-likely")
    met = dealt.join(bounded(likely, IDS), ["key", "left", "other", "node"])
    return _linking(met.join(sets.select("node", "hashes", "extremes"), "node"), similarity, LEAST_SHARE)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Words are lower-cased (A-Z) runs without ASCII white space; a text's set holds its distinct runs of shingle words, or
    with fewer words the whole text as one. Texts with 100 * common >= similarity * union are linked; component_id is the
    smallest doc_id that links reach. Null and empty texts have no set and no links. Rows that share a doc_id are one
    document with the links of all its texts; a null doc_id has no links and is kept. No rows give no rows.

    Rows with equal sets are one node. Each node has a key for every band of its min-max values; nodes of a bucket are
    compared in full with its least node, and what that leaves in several components is compared in blocks, by the share of
    values that agree and then in full. So a pair that shares a bucket is missed only if it is linked through others
    anyway, or if its values are far off its similarity."""
    base = written(_bands(docs, shingle), "minmax-bands")
    named = base.where("doc_id is not null and set_key is not null")
    classes = bounded(written(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("n > 1").drop("n"), "minmax-classes"), IDS)
    nodes = named.join(classes, "set_key", "left").where("node is null or node = doc_id").select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    hubs = nodes.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").drop("last")
    members = written(nodes.join(hubs, "key").select("key", "hub", "node").distinct(), "minmax-members")
    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    wanted = bounded(written(members.select("node").distinct(), "minmax-nodes"), IDS)
    sets = written(_sets(docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node"), shingle), "minmax-sets")
    links = written(confirmed(stars, sets, similarity), "minmax-links")
    comps = components(links, "minmax-first")
    more = written(_cross_links(members, comps, sets, similarity), "minmax-more")
    if more.limit(1).count():
        comps = components(links.union(more), "minmax-final")
    final = bounded(written(comps, "minmax-components"), IDS)
    out = base.drop("bands").join(classes, "set_key", "left").withColumn("node", F.coalesce("node", F.when(F.col("set_key").isNotNull(), F.col("doc_id"))))
    out = out.join(final, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)


def near_dedup_sql(documents: str = "documents", shingle: int = 4, similarity: int = SIMILARITY) -> str:
    """The same rows in DuckDB's SQL: every pair of texts that share a shingle is counted in full."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle} - 1], ' ')) END) AS sh FROM d),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {similarity} * (p.n + q.n - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.to_id = u.a),
m AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m USING (doc_id)"""
