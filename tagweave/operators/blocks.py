"""Pairs of the rows of each block, made and compared in Arrow batches: rows are shuffled, pairs never."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pairwise import CHUNK, Texts
from ..plans.storage import bounded, written

#: Rows of blocks that are looked at together, and pairs of these at a time.
ROWS, PAIRS = 8192, 1 << 17
#: Blocks larger than a part, up to which their table is broadcast.
LARGE = 10_000
#: Blocks of so many rows are sifted in tiles, of about so many pairs each, which stay in a core's cache.
TILED, TILE = 48, 1 << 15
#: In blocks of so many rows, what rows of one length and beginning need is kept.
CACHED = 1024
#: Where blocks have several parts, their rows go to so many times more tasks than a shuffle has, as pairs take longer than rows.
TASKS = 8


class Rows:
    """Rows of one large block or of several small ones, by their places."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        self._codes: dict[str, tuple[np.ndarray, list]] = {}
        self._texts: dict[str, Texts] = {}
        self._tables: dict[tuple, np.ndarray] = {}

    def values(self, column: str) -> pa.Array:
        found = self.table.column(column)
        return found.chunk(0) if found.num_chunks == 1 else pa.concat_arrays(found.chunks)

    def _coded(self, column: str) -> tuple[np.ndarray, list]:
        if column not in self._codes:
            coded = self.values(column).dictionary_encode()
            self._codes[column] = (pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist())
        return self._codes[column]

    def codes(self, column: str) -> np.ndarray:
        """A number for each value, -1 for null."""
        return self._coded(column)[0]

    def texts(self, column: str) -> Texts:
        """The column's values, by their numbers."""
        if column not in self._texts:
            self._texts[column] = Texts(self._coded(column)[1])
        return self._texts[column]

    def table_of(self, column: str, score: Callable[[Texts, np.ndarray, np.ndarray], np.ndarray], most: int) -> np.ndarray | None:
        """score of every two values, by their numbers; None if these are more than most, and weren't asked for before."""
        texts, key = self.texts(column), (column, score)
        n = len(texts.texts)
        if key not in self._tables:
            if not 0 < n * n <= most:
                return None
            self._tables[key] = score(texts, *(k.ravel() for k in np.indices((n, n)))).reshape(n, n)
        return self._tables[key]

    def equal(self, column: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        c = self.codes(column)
        return (c[i] == c[j]) & (c[i] >= 0)

    def differ(self, column: str, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Both have a value, and not the same."""
        c = self.codes(column)
        x, y = c[i], c[j]
        return (x != y) & (x >= 0) & (y >= 0)

    def scores(self, column: str, i: np.ndarray, j: np.ndarray, score: Callable[[Texts, np.ndarray, np.ndarray], np.ndarray]) -> np.ma.MaskedArray:
        """score of each pair's values, once for equal pairs of them; masked where one is null."""
        c = self.codes(column)
        x, y = c[i], c[j]
        if (c >= 0).all() and self.table_of(column, score, len(x)) is None:
            return np.ma.masked_array(score(self.texts(column), x, y))
        out = np.ma.masked_array(np.zeros(len(i)), mask=(x < 0) | (y < 0))
        some = np.flatnonzero(~out.mask)
        x, y = x[some], y[some]
        texts, table = self.texts(column), self.table_of(column, score, len(x))
        if table is not None:
            out[some] = table[x, y]
        elif len(x):  # most values are the rows' own
            out[some] = score(texts, x, y)
        return out

    def batch(self, i: np.ndarray, j: np.ndarray, both: Sequence[str], more: dict[str, np.ma.MaskedArray], schema: pa.Schema) -> pa.RecordBatch:
        """id1, id2, both values of each column, and more."""
        side = {1: pa.array(i), 2: pa.array(j)}
        found = [self.values("record_id").take(side[k]) for k in (1, 2)] + [self.values(c).take(side[k]) for c in both for k in (1, 2)]
        found += [pa.array(np.asarray(x), mask=None if np.ma.getmask(x) is np.ma.nomask else np.ma.getmaskarray(x)) for x in more.values()]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(found, schema, strict=True)], schema=schema)


class Sift:
    """Which pairs may have at least so much Jaro-Winkler similarity in a column, or are equal in another; for blocks whole
    tiles of pairs are looked at, without a place for each pair."""

    def __init__(self, rows: Rows, column: str, same: str, least: float):
        self.rows, self.column, self.same, self.least = rows, column, same, least
        code, texts = rows.codes(column), rows.texts(column)
        bag, rest = texts.bags()
        # a last text of no characters is for nulls
        at, pad = np.where(code < 0, len(texts.texts), code), lambda x: np.r_[x, np.zeros((1, *x.shape[1:]), x.dtype)]
        self.kind = np.uint32 if rest is not None else np.uint8 if len(bag) < 4 else np.uint16
        self.never = int(np.iinfo(self.kind).max)
        self.bag = [pad(word)[at] for word in bag]
        self.rest = None if rest is None else pad(rest)[at].astype(self.kind)
        self.length, self.front, self.null = pad(texts.length)[at], pad(texts.front)[at], code < 0
        self.nulls, self.tables = bool(self.null.any()), None
        equal = rows.codes(same)
        self.repeated = bool((np.bincount(equal[equal >= 0]) > 1).any())
        self.equal = np.where(equal < 0, -1, equal).astype(np.int32), np.where(equal < 0, -2, equal).astype(np.int32)

    def block(self, low: int, high: int) -> None:
        """Pairs are of these rows from now on."""
        self.low, self.high, self.needs = low, high, {}

    def _least(self, a: np.ndarray, b: np.ndarray, front: np.ndarray | int) -> np.ndarray:
        """How many characters texts of lengths a and b must have in common, as may_reach has it."""
        f = np.asarray(front) * 0.1
        least = (3 * (self.least - f) / (1 - f) - 1) * a * b / np.maximum(a + b, 1)
        return np.clip(np.ceil(least - 1e-6) - self.rows.texts(self.column).common, 0, self.never - 1).astype(self.kind)

    def _need(self, i: int) -> np.ndarray:
        """What row i needs with each row of the block."""
        f = self.front
        key = (int(self.length[i]), int(f[i, 0]), int(f[i, 1]))
        if key not in self.needs:
            if len(self.needs) * (self.high - self.low) > 1 << 24:
                self.needs = {}
            part = slice(self.low, self.high)
            first = (f[part, 0] == key[1]) & (key[1] > 0)
            second = first & (f[part, 1] == key[2]) & (key[2] > 0)
            self.needs[key] = self._least(key[0], self.length[part], np.where(second, 4, first.astype(np.int64)))
        return self.needs[key]

    def _tile_needs(self, at: int, to: int, low: int) -> np.ndarray:
        one, other, f = slice(at, to), slice(low, self.high), self.front
        if self.tables is None and self.high - self.low < CACHED:
            lengths, self.sizes = np.unique(self.length, return_inverse=True)
            self.tables = [self._least(lengths[:, None], lengths[None, :], k) for k in (0, 1, 4)] if len(lengths) <= 256 else ()
        if not self.tables or self.high - self.low >= CACHED:
            found = np.stack([self._need(i)[low - self.low :] for i in range(at, to)])
        else:
            none, some, all_four = (t.take(self.sizes[one], 0).take(self.sizes[other], 1) for t in self.tables)
            first, second = ((f[one, k, None] == f[None, other, k]) & (f[one, k, None] > 0) for k in (0, 1))
            found = np.where(first, np.where(second, all_four, some), none)
        if self.nulls:
            found[self.null[one]] = self.never
            found[:, self.null[other]] = self.never
        return found

    def tile(self, at: int, to: int, low: int) -> np.ndarray:
        """For rows at to to, and those of the block from low on."""
        one, other = slice(at, to), slice(low, self.high)
        m = None
        for word in self.bag:
            found = np.bitwise_count(word[one, None] & word[None, other])
            m = found.astype(self.kind, copy=False) if m is None else np.add(m, found, out=m)
        if self.rest is not None:
            m += np.minimum(self.rest[one, None], self.rest[None, other])
        ok = m >= self._tile_needs(at, to, low)
        if self.repeated:
            ok |= self.equal[0][one, None] == self.equal[1][None, other]
        return ok

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        code, ok = self.rows.codes(self.column), self.rows.equal(self.same, i, j)
        some = np.flatnonzero(~ok & ~self.null[i] & ~self.null[j])
        for k in range(0, len(some), CHUNK):
            s = some[k : k + CHUNK]
            ok[s] = self.rows.texts(self.column).may_reach(code[i[s]], code[j[s]], self.least)
        return ok


Compare = Callable[[Rows, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _pairs(rows: Rows, first: np.ndarray, sift: Sift | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of both rows of each pair that sift lets through, the one with the smaller record_id before; first: where blocks
    begin."""
    n = rows.table.num_rows
    number = lambda c: rows.values(c).to_numpy(zero_copy_only=False)
    p, q, part = number("__p"), number("__q"), number("__part")
    size = np.diff(np.r_[first, n])
    block = np.repeat(np.arange(len(first)), size)
    end = np.r_[first[1:], n][block]
    second = (p < q) & (part == q)
    own = np.bincount(block[~second], minlength=len(first))
    low = np.where(p < q, first[block] + own[block], np.arange(n) + 1)
    count = np.where(second, 0, end - low)
    order = pc.rank(rows.values("record_id"), tiebreaker="dense").to_numpy().astype(np.int64)

    def turned(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        turn = order[i] > order[j]
        i, j = np.where(turn, j, i), np.where(turn, i, j)
        some = order[i] != order[j]
        if some.any():
            yield (i, j) if some.all() else (i[some], j[some])

    if sift:
        held, total = [], 0
        for k in np.flatnonzero(size >= TILED).tolist():
            at, high = int(first[k]), int(first[k] + size[k])
            to = at + int(own[k])
            count[at:high] = 0
            sift.block(at, high)
            while at < to and (begin := int(low[at])) < high:
                rest = min(to, at + max(1, TILE // (high - begin)))
                i, j = np.nonzero(sift.tile(at, rest, begin))
                i, j = i + at, j + begin
                some = j >= low[i]
                held.append((i[some], j[some]))
                total, at = total + len(held[-1][0]), rest
                if total >= PAIRS:
                    yield from turned(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, total = [], 0
        if held:
            yield from turned(*(np.concatenate(x) for x in zip(*held, strict=True)))
    upto, at = np.cumsum(count), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = np.repeat(low[at:to], c) + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        if sift and len(i):
            some = sift.pairs(i, j)
            i, j = i[some], j[some]
        yield from turned(i, j)
        at = to


def in_blocks(known: DataFrame, key: Sequence[str], part: int, compare: Compare, fields: Sequence[T.StructField], sift: Callable[[Rows], Sift] | None = None) -> DataFrame:
    """What compare makes of the pairs of each block, or of those that sift lets through; known has record_id and the columns of key, none of them null.

    Larger blocks are dealt into parts, and every two parts meet, so no task holds more than two parts."""
    large = written(known.groupBy(*key).agg(F.ceil(F.count("*") / part).cast("int").alias("__parts")).where("__parts > 1"), "large-blocks")
    rows = known.join(bounded(large, LARGE), list(key), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("record_id"), F.col("__parts")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    rows = rows.withColumns({"__p": F.least("__part", "__other"), "__q": F.greatest("__part", "__other")}).drop("__parts", "__other")
    group = [*key, "__p", "__q"]
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")) * (TASKS if large.limit(1).count() else 1)
    rows = rows.repartition(tasks, *group).sortWithinPartitions(*group, "__part")

    def made(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.r_[first, table.num_rows])
        if not (size > 1).all():  # rows that stand alone have no pairs
            table, size = table.filter(pa.array(np.repeat(size > 1, size))), size[size > 1]
            first = np.cumsum(size) - size
        if not len(size):
            return
        held = Rows(table)
        for i, j in _pairs(held, first, sift(held) if sift else None):
            yield from compare(held, i, j)

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows - 1, bool)
        for c in group:
            x = table.column(c).combine_chunks()
            new |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
        return np.r_[0, np.flatnonzero(new) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(k, ROWS))
                if sum(b.num_rows for b in held) >= ROWS:
                    table = pa.Table.from_batches(held).combine_chunks()
                    first = begins(table)
                    last = int(first[-1])  # the last block may go on
                    if last:
                        yield from made(table.slice(0, last), first[:-1])
                    held = table.slice(last).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from made(table, begins(table))

    return rows.mapInArrow(run, T.StructType(list(fields)))
