"""Repetition rules: rolling hashes of several n-gram lengths, and the characters that lie inside repeats."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import sliced, texts_of, with_columns
from .textvec import Words, mix, ngrams, words

#: By n-gram length, the largest share of a text's word characters that may lie inside n-grams found twice or more, first
#: places included. The base rule's 20 % of words in 5-grams bounds what is left, so limits must be below that to add to it.
NGRAM_SHARES: Mapping[int, float] = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The same for lines that equal an earlier line.
LINE_SHARE = 0.20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def by_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(w: Words, n: int) -> np.ndarray:
    """Of each word whether it lies in a run of n words that is found twice or more in its text."""
    covered = np.zeros(len(w.hashes), bool)
    h = ngrams(w.hashes, n)
    if not len(h):
        return covered
    doc = w.doc()
    own = np.flatnonzero(doc[: len(h)] == doc[n - 1 :])
    if len(own) < 2:
        return covered
    g = h[own] ^ mix(doc[own].astype(np.uint64) + np.uint64(1))
    order = np.argsort(g)
    same = g[order[1:]] == g[order[:-1]]
    hit = np.zeros(len(own), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at, size = own[hit], len(covered) + 1
    return np.cumsum(np.bincount(at, minlength=size) - np.bincount(at + n, minlength=size))[:-1] > 0


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the code points of their words."""
    if b"\n" not in text:
        return 0, 0
    seen, n, chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                n += 1
                chars += len(b"".join(line.split()).decode("utf-8", "replace"))
            else:
                seen.add(line)
    return n, chars


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """What the rules are about, for each text."""
    w = words(texts, lower=False)
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.starts], inside[w.ends] = 1, -1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    points = inside & ((w.data & 0xC0) != 0x80)
    at = np.concatenate([[0], np.cumsum(points, dtype=np.int64)])
    chars = at[w.ends] - at[w.starts]
    lines = [duplicate_lines(t) for t in texts]
    out = {
        "n_words": w.counts(),
        "word_chars": at[w.bounds[1:]] - at[w.bounds[:-1]],
        "n_symbols": by_text(_SYMBOL[w.data], w.bounds),
        "n_dup_lines": np.array([x[0] for x in lines], np.int64),
        "dup_line_chars": np.array([x[1] for x in lines], np.int64),
    }
    for n in sorted({5, *NGRAM_SHARES}):
        hit = repeated(w, n)
        if n == 5:
            out["n_repeat_words"] = by_text(hit, w.first)
        out[f"dup_chars_{n}"] = by_text(np.where(hit, chars, 0), w.first)
    return out


def verdict(m: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether a text fails the base rules, and whether it is kept."""
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    good = m["dup_line_chars"] <= LINE_SHARE * m["word_chars"]
    for n, share in NGRAM_SHARES.items():
        good &= m[f"dup_chars_{n}"] <= share * m["word_chars"]
    return failed, good & ~failed


_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_SHARES)]


def repetition_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the measures of each whole text, base_failed and kept. Words are raw; lines stand between line feeds.

    Null and empty texts have no words and fail. Rows are independent, so repeated rows have equal results; no rows give no
    rows; other columns are left out. A text kept passes the base rules, and of its word characters no more than LINE_SHARE
    lie in lines that equal an earlier one, no more than NGRAM_SHARES[n] in n-grams found twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            m = measures(texts_of(b))
            failed, kept = verdict(m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(m[k].astype(np.int64)) for k in _LONGS), pa.array(failed), pa.array(kept)], names=["doc_id", *_LONGS, "base_failed", "kept"])

    fields = [docs.schema["doc_id"], *(T.StructField(k, T.LongType()) for k in _LONGS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return with_columns(docs.select("doc_id", "text"), run, fields)


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
