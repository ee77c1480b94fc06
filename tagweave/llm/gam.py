"""Quality classifier: a generalised additive model with pairwise interactions, boosted feature by feature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, texts_of, with_columns
from .quality_rules import by_text, duplicate_lines, repeated
from .textvec import words

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their ids.
MAX_ROWS = 20_000
THRESHOLD = 0.3


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_SYMBOL, _STOP, _BANG, _COMMA, _BAR = _class(b"#*$%&<>@^~+=_\\{}[]"), _class(b".?"), _class(b"!"), _class(b",;:"), _class(b"|")
_LETTER = _UPPER | _class(bytes(range(97, 123))) | _class(bytes(range(128, 256)))
FEATURES = ["log_words", "word_length", "upper", "digit", "symbol", "stop", "bang", "comma", "bar", "ends_odd", "distinct", "dup_lines", "repeats", "short_words", "line_words", "long_words", "high_bytes", "alternation"]


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each whole text, a column for each of FEATURES; all finite, of empty texts 0."""
    w = words(texts, lower=False)
    size = np.maximum(1, np.diff(w.bounds) - 1)
    n = np.maximum(1, w.counts())
    length = (w.ends - w.starts).astype(np.int64)
    per_word = lambda flags: by_text(flags, w.first) / n
    per_byte = lambda table: by_text(table[w.data], w.bounds) / size
    last = w.data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    doc = w.doc()
    order = np.lexsort((w.hashes, doc))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        new[1:] = (w.hashes[a] != w.hashes[b]) | (doc[a] != doc[b])
    lines = by_text(w.data == 10, w.bounds)
    changes = np.zeros(len(w.data), bool)
    changes[1:] = _LETTER[w.data[1:]] != _LETTER[w.data[:-1]]
    changes[w.bounds[:-1]] = False  # a text's features don't depend on the text before it
    columns = [
        np.log1p(w.counts()),
        by_text(length, w.first) / n,
        per_byte(_UPPER),
        per_byte(_DIGIT),
        per_byte(_SYMBOL),
        per_byte(_STOP),
        per_byte(_BANG),
        per_byte(_COMMA),
        per_byte(_BAR),
        per_word(_SYMBOL[last] | _BANG[last] | _BAR[last]),
        by_text(new, w.first) / n,
        np.array([duplicate_lines(t)[0] for t in texts]) / lines.clip(1),
        per_word(repeated(w, 5)),
        per_word(length <= 3),
        np.log1p(w.counts() / lines.clip(1)),
        per_word(length > 15),
        by_text(w.data >= 128, w.bounds) / size,
        by_text(changes, w.bounds) / size,
    ]
    return np.column_stack([np.asarray(c, np.float64) for c in columns]).reshape(len(texts), len(FEATURES))


@dataclass
class Gam:
    """Cut points and a lookup table for each feature, coarse tables for pairs of features."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The sum of what each feature's bin and each pair's cell adds, as a probability."""
        s = np.full(len(x), self.intercept)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            s += table[np.searchsorted(cut, x[:, j], "right")]
        if self.pairs:
            coarse = np.column_stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)])
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                s += table[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """The step of a tree with up to so many leaves over ordered bins, given sums of gradients and hessians."""
    edges = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + smooth)
    while len(edges) <= leaves:
        best, at = 1e-9, None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                k = np.arange(a + 1, b)
                v = gain(a, k) + gain(k, b) - gain(a, b)
                i = int(np.argmax(v))
                if v[i] > best:
                    best, at = v[i], int(k[i])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """The step of the best tree that cuts both features of a pair once, and its gain."""
    corner = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = corner(g), corner(h)
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            gs = [cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]]
            hs = [ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]]
            v = sum(a * a / (b + smooth) for a, b in zip(gs, hs, strict=True))
            if v > best:
                best, out = v, np.zeros_like(g)
                for p, a, b in zip(parts, gs, hs, strict=True):
                    out[p] = a / (b + smooth)
    return out, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 6, n_pairs: int = 6, rounds: int = 160, pair_rounds: int = 30, rate: float = 0.08, leaves: int = 3, smooth: float = 5.0) -> Gam:
    """Boosts one small tree a feature and round, in turn, then one a pair and round. With labels of one kind, or none, all
    texts score the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    k = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Gam([np.zeros(0)] * k, [np.zeros(1)] * k, base)
    cuts = [_cuts(x[:, j], bins) for j in range(k)]
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    s = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(k):
            p = 1 / (1 + np.exp(-s))
            step = rate * _tree(np.bincount(at[j], y - p, len(tables[j])), np.bincount(at[j], p * (1 - p), len(tables[j])), leaves, smooth)
            tables[j] += step
            s += step[at[j]]
    pair_cuts = [_cuts(x[:, j], pair_bins) for j in range(k)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(pair_cuts)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)
        cell, p = coarse[a] * shape[1] + coarse[b], 1 / (1 + np.exp(-s))
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_quadrants(*sums(a, b), smooth)[1], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    pairs = [(a, b) for v, a, b in gains[:n_pairs] if v > 0]
    pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in pairs]
    for _ in range(pair_rounds):
        for i, (a, b) in enumerate(pairs):
            step = rate * _quadrants(*sums(a, b), smooth)[0]
            pair_tables[i] += step
            s += step[coarse[a], coarse[b]]
    return Gam(cuts, tables, base, pairs, pair_cuts, pair_tables)


def held_out() -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """A model of labels.quality, fitted on at most max_rows labelled documents that aren't held out, taken by a hash of the
    id. An id with several labels counts as its smallest, one with several texts as that with the least features; null ids and
    labels are left out. The sample has a fixed size, so it is broadcast to the documents and its features, one row an id
    however often that is repeated, come to the driver."""
    own = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("__label"))
    sample = own.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("__label").cast("double"))
    names = ["doc_id", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = features(texts_of(b))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, b.column("__label")], names=names)

    fields = [rows.schema["doc_id"], T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.DoubleType())]
    got = with_columns(rows, run, fields).groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    y = got["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # sums then don't depend on the order in which rows came
    return fit(x[order], (y[order] > 0).astype(np.float64))


def score(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row. Texts are whole; null counts as empty and gets the score of an
    empty text. Repeated rows have equal scores; no rows give no rows; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(features(texts_of(b))))], names=["doc_id", "score"])

    scored = with_columns(docs.select("doc_id", "text"), run, [docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose texts score threshold or more, with all their columns, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array(model.score(features(texts_of(b))) >= threshold))

    return with_columns(docs, run, docs.schema.fields)


def op4_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
