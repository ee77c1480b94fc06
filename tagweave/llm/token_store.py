"""Token ids in binary shards with a minimal perfect hash index: keyed access in constant time."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import filesystem, fresh_dir, ranges_for, sliced, texts_of, with_columns, written
from .textvec import mix

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MAGIC, VERSION = b"TWTOKENS", 1
#: magic, version, bytes an id, documents, ids, keys; then where ids, offsets, keys, levels, slots and prints begin.
_HEAD = struct.Struct("<8sIIQQQ6Q")
#: Pieces of text whose ids a worker remembers, none longer than PIECE bytes; above this many the half goes that was not
#: met for longest.
REMEMBERED, PIECE = 250_000, 32
#: Bytes of text that are encoded in one go; memory is about 30 times this.
BATCH = 1 << 20
#: White space on both sides of a cut, or at it, would join matches of the pre-split pattern.
_JOINED = re.compile(r"\s | \s").search
_SPACE, _BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(6)
# ASCII by the pre-split pattern's classes; the two bytes of U+00C0 to U+027F are letters but for two signs, which are odd
# like the apostrophe (contractions) and all other characters
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[32], _KIND[9:14], _KIND[39] = _SPACE, _BLANK, _ODD
_KIND[48:58], _KIND[65:91], _KIND[97:123] = _DIGIT, _LETTER, _LETTER
_KIND[0x80:0xC0], _KIND[0xC0:], _KIND[0xC3:0xCA] = _LETTER, _ODD, _LETTER
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Known:
    """Ids of pieces that were met before, by the pieces' own bytes: four words of eight bytes and the length."""

    def __init__(self, dtype: np.dtype) -> None:
        self.keys, self.words, self.at = np.zeros(0, np.uint64), np.zeros((0, 4), np.uint64), np.zeros(1, np.int64)
        self.ids, self.met, self.turn = np.zeros(0, dtype), np.zeros(0, np.int64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of distinct keys, -1 of those that aren't known."""
        at = pd.Index(self.keys).get_indexer(keys)
        self.turn += 1
        self.met[at[at >= 0]] = self.turn
        return at

    def add(self, keys: np.ndarray, words: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.keys, self.words = np.concatenate([self.keys, keys]), np.concatenate([self.words, words])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), self.ids.dtype, int(sizes.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.met = np.concatenate([self.met, np.full(len(ids), self.turn)])

    def forget(self, most: int) -> None:
        """Above so many pieces the half goes that was not met for longest."""
        if len(self.keys) > most:
            keep = np.sort(np.argsort(self.met, kind="stable")[-(most // 2) :])
            sizes = np.diff(self.at)[keep]
            self.ids = self.ids[_ranges(self.at[keep], sizes)]
            self.keys, self.words, self.met, self.at = self.keys[keep], self.words[keep], self.met[keep], np.concatenate([[0], np.cumsum(sizes)])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on for each start, as often as its size says."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Ids of texts by the tokenizers library.

    Byte-level pre-splitting always begins a match at a single space between two characters that aren't white space; between
    two such spaces, where neither an apostrophe nor a character beyond U+027F stands, a match ends where letters, digits,
    white space and all other signs part. So a text's ids are those of its pieces, which numpy finds for many texts at once,
    and each distinct piece goes through the library's model once; what lies between two spaces and holds another character
    goes through the library's pre-splitting as well.

    added_tokens: text that reads like an added token of the file (<|endoftext|>) becomes that token's id, as the library does
    by itself, and a text that holds one goes through it whole; else it is encoded like other text."""

    def __init__(self, path: str, added_tokens: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = self.tokenizer.get_added_tokens_decoder().values()
        # of other added tokens the library makes ids with either setting
        found = [re.escape(t.content.encode()) for t in added if added_tokens or not t.special]
        self.added = re.compile(b"|".join(found)).search if found else lambda text: None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.width = self.dtype.itemsize
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(kept)]
        self.alphabet = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.known = Known(self.dtype)

    def _ids(self, piece: bytes, odd: bool) -> list[int]:
        parts = [p for p, _ in self.split(piece.decode())] if odd else [piece.decode("latin-1").translate(self.alphabet)]
        return [t.id for p in parts for t in self.model.tokenize(p)]

    def _pieces(self, data: np.ndarray, texts: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin in data, which of them are odd, and which are whole texts."""
        kind = _KIND[data]
        kind[:-1][(data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))] = _ODD
        begins = np.zeros(len(data), bool)
        begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        of = lambda at: np.searchsorted(bounds, at, "right") - 1
        runs = 1 + np.flatnonzero((kind[1:] <= _BLANK) & (kind[:-1] <= _BLANK) & ~begins[1:])
        whole = np.zeros(len(texts), bool)
        whole[of(runs[(kind[runs] == _SPACE) | (kind[runs - 1] == _SPACE)])] = True
        strange = np.zeros(len(texts), bool)
        odd_at = np.flatnonzero(kind == _ODD)
        strange[of(odd_at[data[odd_at] >= 128])] = True
        for i in np.flatnonzero(strange & ~whole):
            whole[i] = _JOINED(texts[i].decode()) is not None
        for i in np.flatnonzero(~whole):
            whole[i] = self.added(texts[i]) is not None
        start = begins | (kind == _SPACE)
        between = np.cumsum(start, dtype=np.int32) - 1  # what stands between two spaces
        odd = np.zeros(int(between[-1]) + 1, bool)
        odd[between[odd_at]] = True
        odd[between[runs]] = True
        change = 1 + np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE))
        start[change[~odd[between[change]]]] = True
        for i in np.flatnonzero(whole):
            start[bounds[i] + 1 : bounds[i + 1]] = False
        at = np.flatnonzero(start)
        return at, odd[between[at]], whole[of(at)]

    def encode_many(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each followed by end, and how many each text has."""
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        last = [] if end is None else [end]
        if not bounds[-1]:
            return np.array(last * len(texts), self.dtype), np.full(len(texts), len(last))
        data = np.frombuffer(b"".join([*texts, bytes(PIECE)]), np.uint8)
        at, odd, whole = self._pieces(data[: bounds[-1]], texts, bounds)
        size = np.diff(at, append=bounds[-1])
        small = np.flatnonzero((size <= PIECE) & ~whole)
        words, eight = np.zeros((len(small), 4), np.uint64), np.lib.stride_tricks.sliding_window_view(data, 8)
        own = size[small]
        key = own.astype(np.uint64)
        for k in range(4):
            some = np.flatnonzero(own > 8 * k) if k else np.arange(len(small))
            words[some, k] = eight[at[small[some]] + 8 * k].view("<u8").ravel() & _MASK[np.minimum(own[some] - 8 * k, 8)]
            key[some] = mix(key[some] * np.uint64(0x9E3779B97F4A7C15) + words[some, k])
        code, distinct = pd.factorize(key)
        place = self.known.find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            first = np.full(len(distinct), len(code))
            np.minimum.at(first, code, np.arange(len(code)))
            rows = first[new]
            place[new] = len(self.known.keys) + np.arange(len(new))
            self.known.add(distinct[new], words[rows], [self._ids(data[at[i] : at[i] + size[i]].tobytes(), odd[i]) for i in small[rows]])
        place = place[code]
        starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[small], sizes[small] = self.known.at[place], np.diff(self.known.at)[place]
        # longer pieces, whole texts, and a piece whose key is that of another one are encoded by themselves
        alone = np.ones(len(at), bool)
        alone[small] = (self.known.words[place] != words).any(axis=1)
        more, begun = [], len(self.known.ids)
        for i in np.flatnonzero(alone):
            piece = data[at[i] : at[i] + size[i]].tobytes()
            ids = self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids if whole[i] else self._ids(piece, odd[i])
            more.append(ids)
            starts[i], sizes[i] = begun, len(ids)
            begun += len(ids)
        pool = np.concatenate([self.known.ids, np.array([*chain.from_iterable(more), *last], self.dtype)])
        if last:
            after = np.searchsorted(at, bounds[1:])
            starts, sizes = np.insert(starts, after, begun), np.insert(sizes, after, 1)
            at = np.insert(at, after, bounds[1:] - 1)
        total = np.concatenate([[0], np.cumsum(sizes)])
        upto = np.searchsorted(at, bounds[1:]) if not last else after + np.arange(1, len(texts) + 1)
        self.known.forget(REMEMBERED)
        return pool[_ranges(starts, sizes)], np.diff(total[upto], prepend=0)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text.encode()])[0].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, added_tokens: bool = False) -> Encoder:
    return Encoder(path, added_tokens)


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64))


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys. At each level the keys that have a place to themselves in a bit array
    of twice their number stay there, and the others go on. A key's slot is the number of set bits before its own."""

    levels: list[np.ndarray] = field(default_factory=list)  # of bits, packed in 64-bit words
    ranks: list[np.ndarray] = field(default_factory=list)  # set bits before each word

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        out, left, level = cls(), keys, 0
        while len(left):
            words = max(1, (2 * len(left) + 63) // 64)
            at = (_hash(left, level) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * words) == 1
            out.levels.append(np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel())
            left, level = left[~alone[at]], level + 1
            if level > 200:
                raise ValueError("keys aren't distinct")
        out.rank()
        return out

    def rank(self) -> None:
        before, self.ranks = 0, []
        for bits in self.levels:
            n = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(before + np.cumsum(n) - n)
            before += int(n.sum())

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where no level has a bit. Of keys that weren't in the set most get a slot, too."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _hash(keys[left], level) % np.uint64(64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (rank[word] + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def tobytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(x)) + x.tobytes() for x in self.levels)

    @classmethod
    def frombytes(cls, data: bytes) -> PerfectHash:
        out, at = cls(), 4
        for _ in range(struct.unpack_from("<I", data)[0]):
            n = struct.unpack_from("<Q", data, at)[0]
            out.levels.append(np.frombuffer(data, "<u8", n, at + 8))
            at += 8 + 8 * n
        out.rank()
        return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 977) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Ids of documents in order, then their offsets, keys and index, then a header at the end, with where each part begins."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.n_ids = out, width, 0
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, keys: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of several documents, one after the other, and how many each of them has."""
        self.out.write(ids.tobytes())
        self.keys += keys
        self.sizes += sizes.tolist()
        self.n_ids += len(ids)

    def close(self) -> int:
        offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype("<u8")
        none = np.array([k is None for k in self.keys])
        keys = np.array([k or 0 for k in self.keys], "<i8")
        distinct, first = np.unique(keys[~none], return_index=True)  # a repeated key leads to its first document
        first = np.flatnonzero(~none)[first]
        found = PerfectHash.build(distinct)
        slots, prints = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
        at = found.slots(distinct)
        slots[at], prints[at] = first, _prints(distinct)
        places, begun = [0], self.n_ids * self.width
        for part in (offsets.tobytes(), keys.tobytes() + np.packbits(none).tobytes(), found.tobytes(), slots.tobytes(), prints.tobytes()):
            self.out.write(part)
            places.append(begun)
            begun += len(part)
        self.out.write(_HEAD.pack(MAGIC, VERSION, self.width, len(keys), self.n_ids, len(distinct), *places))
        self.out.close()
        return begun + _HEAD.size


class Shard:
    """A shard that is open for keyed access."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        magic, version, self.width, self.n_docs, self.n_ids, self.n_keys, *at = _HEAD.unpack(self._read(size - _HEAD.size, _HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("no shard of token ids")
        at = [*at, size - _HEAD.size]
        parts = [self._read(a, b - a) for a, b in zip(at[1:-1], at[2:], strict=True)]
        self.offsets = np.frombuffer(parts[0], "<u8").astype(np.int64)
        self.keys = np.frombuffer(parts[1], "<i8", self.n_docs)
        self.none = np.unpackbits(np.frombuffer(parts[1], np.uint8, offset=8 * self.n_docs), count=self.n_docs).astype(bool)
        self.index, self.slots, self.prints = PerfectHash.frombytes(parts[2]), np.frombuffer(parts[3], "<u4"), np.frombuffer(parts[4], "<u4")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key; -1 where there is none, but for one foreign key in 2**32."""
        keys = np.asarray(keys, np.int64)
        if not self.n_keys:
            return np.full(len(keys), -1, np.int64)
        slots = self.index.slots(keys)
        there = (slots >= 0) & (self.prints[slots] == _prints(keys))
        return np.where(there, self.slots[slots].astype(np.int64), -1)

    def ids(self, doc: int, until: int | None = None) -> np.ndarray:
        """Ids of a document, or of all from doc to before until."""
        a, b = self.offsets[doc], self.offsets[doc + 1 if until is None else until]
        return np.frombuffer(self._read(int(a) * self.width, int(b - a) * self.width), f"<u{self.width}")

    def get(self, key: int) -> np.ndarray | None:
        doc = int(self.find(np.array([key]))[0])
        return None if doc < 0 else self.ids(doc)


def open_shard(uri: str) -> Shard:
    fs, path = filesystem(uri)
    file = fs.open_input_file(path)
    return Shard(file, file.size())


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, uri: str | None = None, shards: int | None = None, added_tokens: bool = False) -> DataFrame:
    """Writes the ids of all whole texts, each followed by end_id, to shards in ascending doc_id order and returns their
    manifest: shard, uri, docs, ids, first_key, last_key, bytes and start (ids in the shards before).

    doc_id must be a whole number; null ids come first and aren't in the index; rows that share a doc_id stand in the order
    of their texts, and the index leads to the first of them. Null texts count as empty. No rows give no shards. Other columns are left out.
    added_tokens: as Encoder has it.

    Spark samples the splitters of doc_id and sorts within ranges, so that no task holds more than a range. Each attempt of a
    task writes a file of its own; the manifest, which Spark commits once a task, names those that count."""
    spark = docs.sparkSession
    path, uri = path or public_tokenizers.path(TOKENIZER), uri or fresh_dir(spark, "tokens")
    n = shards or ranges_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, out = encoder(path, added_tokens), TaskContext.get().partitionId(), None
        for b in sliced(batches, "text", BATCH):
            if out is None:
                fs, where = filesystem(uri)
                fs.create_dir(where, recursive=True)
                name = f"{uri}/{shard:06d}-{uuid.uuid4().hex}.tok"
                out = ShardWriter(fs.open_output_stream(filesystem(name)[1], compression=None), e.width)
            out.add(b.column("doc_id").to_pylist(), *e.encode_many(texts_of(b), end_id))
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((shard, pa.int64()), (name, pa.string()), (len(out.keys), pa.int64()), (out.n_ids, pa.int64()), (out.keys[0], pa.int64()), (out.keys[-1], pa.int64()), (size, pa.int64()))], names=names)

    names = ["shard", "uri", "docs", "ids", "first_key", "last_key", "bytes"]
    manifest = written(with_columns(ranged, run, [T.StructField(c, T.StringType() if c == "uri" else T.LongType()) for c in names]), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: keys are looked up in the index, and the
    ids at the offset that it leads to are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                s = open_shard(uri)
                at = np.arange(s.n_docs)
                own = np.flatnonzero(~s.none)
                found = s.find(s.keys[own])
                repeat = own - found  # further documents of a repeated key stand behind the first
                if (found < 0).any() or (s.keys[found] != s.keys[own]).any():
                    raise ValueError(f"{uri}: a key isn't in the index")
                at[own] = found + repeat
                for a in range(0, s.n_docs, 512):
                    docs = at[a : a + 512]
                    ids, base = s.ids(int(docs[0]), int(docs[-1]) + 1).astype("<u4"), s.offsets[docs[0]]
                    crc = [zlib.crc32(ids[i - base : j - base].tobytes()) for i, j in zip(s.offsets[docs], s.offsets[docs + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.keys[docs], mask=s.none[docs]), pa.array(start + s.offsets[docs]), pa.array(s.offsets[docs + 1] - s.offsets[docs]), pa.array(crc, pa.int64())], names=names
                    )

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return with_columns(manifest.select("uri", "start").repartition(max(1, manifest.count())), run, [T.StructField(c, T.LongType()) for c in names])


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), added_tokens=True))
