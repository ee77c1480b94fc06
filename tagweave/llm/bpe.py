"""Byte-level BPE with the tiktoken library and a local rank file: texts to ids, ids to bytes."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, with_columns

RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than so many characters are encoded in pieces.
LONG = 1 << 15
#: A single space between two characters that aren't white space: the pre-split pattern always begins a match there, so
#: pieces cut before it have the same matches as the whole. Python's \S is narrower than the pattern's, never wider.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token and rank in each line), without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = LONG) -> Iterator[str]:
    """text cut at safe boundaries into pieces of about limit characters; a stretch without such a boundary stays whole."""
    begun = 0
    while len(text) - begun > limit:
        cut = _SAFE.search(text, begun + limit)
        if not cut:
            break
        yield text[begun : cut.start()]
        begun = cut.start()
    yield text[begun:] if begun else text


def encode_text(text: str, path: str, limit: int = LONG) -> list[int]:
    e = encoding(path)
    if len(text) <= limit:
        return e.encode_ordinary(text)
    return [i for piece in pieces(text, limit) for i in e.encode_ordinary(piece)]


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """df with ids_col, the ids of each whole text (array<int>); null and empty texts have none. Other columns stay;
    a column that has the name ids_col is replaced. Rows are independent: repeated rows get equal ids."""
    path = path or public_tokenizers.path(RANKS)
    fields = [f for f in df.schema.fields if f.name != ids_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text_col):
            ids = [encode_text(t or "", path) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, ids_col])

    return with_columns(df.select(*(F.col(f"`{n}`") for n in names)), run, [*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col, the raw bytes of the ids, which need not be valid UTF-8; null ids count as none."""
    path = path or public_tokenizers.path(RANKS)
    fields = [f for f in df.schema.fields if f.name != bytes_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                out = [e.decode_bytes(ids or []) for ids in b.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.select(names).columns, pa.array(out, pa.binary())], names=[*names, bytes_col])

    return with_columns(df.select(*(F.col(f"`{n}`") for n in names)), run, [*fields, T.StructField(bytes_col, T.BinaryType())])


def encode_decode(df: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """encode and then decode in one pass through a worker. Columns of the two names are replaced; text_col goes."""
    path = path or public_tokenizers.path(RANKS)
    fields = [f for f in df.schema.fields if f.name not in (text_col, ids_col, bytes_col)]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for b in sliced(batches, text_col):
            ids = [encode_text(t or "", path) for t in b.column(text_col).to_pylist()]
            out = [pa.array(ids, pa.list_(pa.int32())), pa.array([e.decode_bytes(i) for i in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.select(names).columns, *out], names=[*names, ids_col, bytes_col])

    more = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(bytes_col, T.BinaryType())]
    return with_columns(df.select(*(F.col(f"`{n}`") for n in [*names, text_col])), run, [*fields, *more])


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of documents."""
    return encode_decode(docs.select("doc_id", "text"), path=path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
