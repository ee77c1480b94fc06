"""Language-model scores by deleted interpolation of unigrams and bigrams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, filesystem, fresh_dir, input_bytes, sliced, texts_of, with_columns, written
from .textvec import _ODD, mix, words

#: Bytes of text in a chunk, which is counted and scored as one; bytes of text for each bucket of n-gram keys. Each chunk
#: sends a block to each bucket, so both grow with the text's root, up to four times this, from where this is its size on.
CHUNK_BYTES, BUCKET_BYTES, GROWS_FROM = 4 << 20, 24 << 20, 64 << 30
#: Chunks, up to which the table of their files is broadcast; beyond, the join shuffles.
FILES = 100_000
#: Buckets of context counts by powers of 2; bins of probabilities by half powers of 2, the first for 0.
CONTEXTS, BINS = 48, 100
EM_ROUNDS = 60
_END = np.uint64(0x5DEECE66D5DEECE6)
_START = np.uint64(0x2545F4914F6CDD1D)
_BLOB = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("blob", T.BinaryType())])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _packed(values: np.ndarray) -> bytes:
    """64-bit values in planes of bytes, most of which are zero."""
    return len(values).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n), np.uint8).reshape(8, n) if n else np.zeros((8, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys, as differences, and counts."""
    gaps = _packed(np.diff(keys, prepend=np.uint64(0)))
    return len(gaps).to_bytes(8, "little") + gaps + _packed(counts)


def _of_block(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = 8 + int.from_bytes(blob[:8], "little")
    return np.cumsum(_unpacked(blob[8:n]), dtype=np.uint64), _unpacked(blob[n:]).astype(np.int64)


class Chunk:
    """Tokens of a list of texts: words in lower case (A-Z), then one end a text. Keys of unigrams are even, of bigrams odd."""

    def __init__(self, texts: list[bytes]) -> None:
        w = words(texts)
        n = w.counts()
        #: The first token of each text, and their number.
        self.first = np.concatenate([[0], np.cumsum(n + 1)])
        token = np.full(self.first[-1], _END, np.uint64)
        inside = np.ones(len(token), bool)
        inside[self.first[1:] - 1] = False
        token[inside] = w.hashes
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first[:-1]] = _START
        even, one = ~np.uint64(1), np.uint64(1)
        bigram = mix(before * _ODD[0] + token * _ODD[1])
        # a context counts as often as its word; the start, as often as the end
        before[self.first[:-1]] = _END
        self.token, self.context, self.bigram = token & even, before & even, bigram | one
        self.doc = np.repeat(np.arange(len(texts)), n + 1)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of all texts, and how often they stand in those to learn from."""
        keys, at = np.unique(np.concatenate([self.token, self.bigram]), return_inverse=True)
        weight = np.tile(train[self.doc], 2)
        return keys, np.bincount(at, weight, len(keys)).astype(np.int64)


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """A row a chunk: ids, whether they are held out, and texts; written, so that a chunk has the same texts in each pass."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, ids, held, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], [], 0

        def packed() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            values = ([base + n], [ids], [held], [[len(t) for t in texts]], [size], [blob])
            return pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(values, kinds, strict=True)], names=[f.name for f in fields])

        for b in sliced(batches, "text", chunk_bytes):
            kinds = [pa.int64(), pa.list_(b.column("doc_id").type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            for doc_id, out, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), texts_of(b), strict=True):
                if texts and size + len(text) > chunk_bytes:
                    yield packed()
                    n, ids, held, texts, size = n + 1, [], [], [], 0
                ids.append(doc_id)
                held.append(out)
                texts.append(text)
                size += len(text)
        if texts:
            yield packed()

    fields = [
        T.StructField("chunk", T.LongType()),
        T.StructField("ids", T.ArrayType(kind)),
        T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("size", T.LongType()),
        T.StructField("blob", T.BinaryType()),
    ]
    return written(with_columns(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), run, fields), "lm-chunks")


def _texts(sizes: list[int], blob: bytes) -> list[bytes]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob, max_output_size=sum(sizes)) if sum(sizes) else b"", 0, []
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return out


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Of each chunk the values of these columns, which texts are held out, and its tokens."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda c: batch.column(c)[k]  # noqa: B023, E731
            texts = _texts(get("sizes").as_py(), get("blob").as_py())
            yield [get(c).as_py() if c != "ids" else get(c).values for c in columns], np.array(get("held").as_py(), bool), Chunk(texts)


def _gather(chunks: DataFrame, uri: str, buckets: int) -> tuple[DataFrame, int, int]:
    """Sums the counts of all chunks and writes a file for each chunk: what the others add to each of its keys, in order.
    Returns chunks with their files, and the number of tokens and of distinct tokens learnt from. Each attempt of a task
    writes files of its own; the table of files, which Spark commits once a task, names those that count.

    A chunk sends each key once, however often it has it, in one block a bucket; a bucket's blocks meet in one group. What
    goes back has no keys, as a chunk knows its own."""
    shift = np.uint64(64 - 40)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), held, c in _rows(batches, "chunk"):
            keys, counts = c.counts(~held)
            cuts = np.searchsorted((keys >> shift).astype(np.int64), np.arange(buckets + 1) * ((1 << 40) // buckets + 1))
            found = [(i, _block(keys[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([chunk] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], names=_BLOB.names)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_of_block(b) for b in pdf["blob"]]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)
        unigram = (keys & np.uint64(1)) == 0
        out = [(-1, _packed(np.array([sums[unigram].sum(), (sums[unigram] > 0).sum()])))]
        begun = 0
        for chunk, (k, own) in zip(pdf["chunk"], parts, strict=True):
            out.append((chunk, _packed(sums[at[begun : begun + len(k)]] - own)))
            begun += len(k)
        return pd.DataFrame({"bucket": np.int32(pdf["bucket"].iloc[0]), "chunk": [c for c, _ in out], "blob": [b for _, b in out]})

    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, pdf = int(pdf["chunk"].iloc[0]), pdf.sort_values("bucket")
        parts = [_unpacked(b) for b in pdf["blob"]]
        if chunk < 0:
            return pd.DataFrame({"chunk": [chunk], "file": [None], "tokens": [sum(int(x[0]) for x in parts)], "types": [sum(int(x[1]) for x in parts)]})
        fs, path = filesystem(uri)
        fs.create_dir(path, recursive=True)
        own = f"{uri}/{chunk}-{uuid.uuid4().hex}"
        with fs.open_output_stream(filesystem(own)[1], compression=None) as f:
            f.write(_packed(np.concatenate(parts)))  # buckets are ranges of keys
        return pd.DataFrame({"chunk": [chunk], "file": [own], "tokens": [0], "types": [0]})

    sent = with_columns(chunks.select("chunk", "held", "sizes", "blob"), send, _BLOB)
    answers = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(total, _BLOB)
    stored = answers.repartition(buckets, "chunk").groupBy("chunk").applyInPandas(store, "chunk long, file string, tokens long, types long")
    files = written(stored, "lm-files")
    sums = files.agg(F.sum("tokens"), F.sum("types")).first()
    return chunks.join(bounded(files.where("file is not null").select("chunk", "file"), FILES), "chunk"), sums[0] or 0, sums[1] or 0


def _sums(c: Chunk, held: np.ndarray, file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token how often it, its context and both together were learnt."""
    keys, counts = c.counts(~held)
    fs, path = filesystem(file)
    with fs.open_input_stream(path, compression=None) as f:
        counts = counts + _unpacked(f.read()).astype(np.int64)
    get = lambda x: counts[np.searchsorted(keys, x)]
    return get(c.token), get(c.context), get(c.bigram)


def _context(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 0) + 1).astype(np.int64), CONTEXTS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        b = np.floor(-2 * np.log2(p))
    return np.where(p > 0, 1 + np.clip(b, 0, BINS - 2), 0).astype(np.int64)


def _deleted(chunks: DataFrame, n_tokens: int) -> DataFrame:
    """Each learnt token, as if it alone were held out: how often its estimates fall into a cell of context count and
    probabilities, and the sums of the estimates. The table has a fixed number of cells, however many tokens there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file,), held, c in _rows(batches, "file"):
            own = ~held[c.doc]
            if not own.any():
                continue
            word, context, both = (x[own] for x in _sums(c, held, file))
            two, one = (both - 1) / np.maximum(context - 1, 1), (word - 1) / max(n_tokens - 1, 1)
            cell, at = np.unique((_context(context - 1) * BINS + _bin(two)) * BINS + _bin(one), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(at), pa.int64()), pa.array(np.bincount(at, two)), pa.array(np.bincount(at, one))], names=["cell", "n", "two", "one"])

    cells = with_columns(chunks.select("file", "held", "sizes", "blob"), run, [T.StructField("cell", T.LongType()), T.StructField("n", T.LongType()), T.StructField("two", T.DoubleType()), T.StructField("one", T.DoubleType())])
    return cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "two", "one")))


def weights(cells: pd.DataFrame, n_types: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """By bucket of context counts the weights of bigram, unigram and uniform estimates, by expectation-maximisation. A
    bucket without tokens has the weights of the nearest smaller one that has some; contexts never seen have no bigrams."""
    cells = cells.sort_values("cell")
    n = cells["n"].to_numpy(np.float64)
    p = np.column_stack([cells["two"] / cells["n"], cells["one"] / cells["n"], np.full(len(cells), 1 / (n_types + 1))]).astype(np.float64)
    bucket = cells["cell"].to_numpy(np.int64) // (BINS * BINS)
    w = np.full((CONTEXTS, 3), 1 / 3)
    w[0] = 0, 0.5, 0.5
    for _ in range(rounds):
        share = p * w[bucket]
        share *= (n / share.sum(axis=1))[:, None]
        new = np.column_stack([np.bincount(bucket, share[:, k], CONTEXTS) for k in range(3)]) + np.array([1e-3, 1e-3, 1e-3])
        new[0, 0] = 0
        w = new / new.sum(axis=1, keepdims=True)
    seen = np.bincount(bucket, n, CONTEXTS) > 0
    for k in range(1, CONTEXTS):
        if not seen[k] and k > 1:
            w[k] = w[k - 1]
    return w


def language_model(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Tokens are lower-cased (A-Z) words and one end a text; null and empty texts are just an end. Counts come from all rows
    whose crc32(doc_id) mod 7 isn't 2 (a null id counts as ""). base_score adds log10((c + 1) / (N + V + 1)); score adds
    log10(w2 c(hw) / c(h) + w1 c(w) / N + w0 / (V + 1)), with weights by the context's count. Repeated rows count as often as
    they stand there. Without rows to learn from all estimates are uniform. No rows give no rows; other columns are left out.

    Texts are dealt into chunks. Chunks send their distinct n-grams with counts, sums go back to the chunks that have other
    counts, and each chunk is scored by itself; the weights are learnt from cells of a fixed number."""
    kind = docs.schema["doc_id"].dataType
    grow = min(4.0, max(1.0, (input_bytes(docs) / GROWS_FROM) ** 0.5))
    chunks, uri = _chunks(docs, int(chunk_bytes * grow)), fresh_dir(docs.sparkSession, "lm-sums")
    size = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // int(bucket_bytes * grow)))
    chunks, n_tokens, n_types = _gather(chunks, uri, buckets)
    w = weights(_deleted(chunks, n_tokens).toPandas(), n_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, ids), held, c in _rows(batches, "file", "ids"):
            word, context, both = _sums(c, held, file)
            k = w[_context(context)]
            p = k[:, 0] * both / np.maximum(context, 1) + k[:, 1] * word / max(n_tokens, 1) + k[:, 2] / (n_types + 1)
            add = lambda x: np.add.reduceat(x, c.first[:-1])  # noqa: B023, E731
            base = np.log10((word + 1) / (n_tokens + n_types + 1))
            known, train = add((word > 0).astype(np.int64)), np.full(len(ids), n_tokens, np.int64)
            columns = [pa.array(held), pa.array(np.diff(c.first)), pa.array(known), pa.array(train), pa.array(add(base)), pa.array(add(np.log10(p)))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    fields = [T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]
    names = [f.name for f in fields]
    return with_columns(chunks.select("file", "ids", "held", "sizes", "blob"), run, fields)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
