"""Similarities of many pairs of texts at once, in numpy: a text of up to 64 characters is a word of bits for each character."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .similarity import jaro_winkler_similarity

#: Pairs that are compared at a time; their arrays stay in a core's cache.
CHUNK = 16_384
#: Characters of a text, and different characters of all texts, that the words of bits are for; others are compared one by one.
WIDTH, LETTERS = 64, 255
#: Words of bits that hold which characters a text has, and how often.
BAG = 4
_ONE = np.uint64(1)


def _levenshtein(a: str, b: str) -> int:
    """Edits between two texts of any length."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Texts:
    """Texts that pairs are made of, by their places."""

    def __init__(self, texts: Sequence[str]):
        self.texts = list(texts)
        n = len(self.texts)
        points = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.fromiter((len(t) for t in self.texts), np.int64, n)
        begin = np.cumsum(self.length) - self.length
        row, at = np.repeat(np.arange(n), self.length), np.arange(len(points)) - np.repeat(begin, self.length)
        letters, code = np.unique(points, return_inverse=True)
        code = code + 1
        self.plain = len(letters) < LETTERS
        self.short = (self.length <= WIDTH) & self.plain
        front = np.zeros((n, 4), np.int64)
        few = at < 4
        front[row[few], at[few]] = code[few]
        self.front = front
        self._points, self.bag = (row, code), None
        if self.plain:
            inside = at < WIDTH
            row, at, code = row[inside], at[inside], code[inside]
            self.width = int(at.max(initial=-1)) + 1
            self.codes = np.zeros((n, WIDTH), np.uint8)
            self.codes[row, at] = code
            self._after = np.pad(self.codes, ((0, 0), (0, 1))).ravel()
            # a character's places in all texts stand together, as pairs are mostly of one text and those after it
            self.columns = np.ascontiguousarray(self.codes[:, : self.width].T.astype(np.int64) * n)
            self.letters = len(letters) + 1
            self.places = np.zeros(n * self.letters, np.uint64)
            np.bitwise_or.at(self.places, code * n + row, _ONE << at.astype(np.uint64))

    def _bags(self) -> None:
        """A bit for each character and number of times that some texts have it and others don't; what finds no place in the
        words is a count that is compared as a whole."""
        (row, code), n = self._points, len(self.texts)
        top = int(code.max(initial=0)) + 1
        both = np.sort(row * top + code)
        r, c = both // top, both % top
        new = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])] if len(r) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        times = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        kinds, kind, count = np.unique(c * (int(times.max(initial=0)) + 1) + times, return_inverse=True, return_counts=True)
        self.common = int((count == n).sum())
        place = np.full(len(kinds), -1)
        some = np.flatnonzero(count < n)
        some = some[np.argsort(-count[some], kind="stable")]
        place[some] = np.arange(len(some))
        where = place[kind]
        self.bag = np.zeros((BAG, n), np.uint64)
        bit = (where >= 0) & (where < 64 * BAG)
        np.bitwise_or.at(self.bag, (where[bit] // 64, r[bit]), _ONE << (where[bit] % 64).astype(np.uint64))
        self.bag = self.bag[: max(1, min(BAG, -(-len(some) // 64)))]
        self.rest = np.bincount(r[where >= 64 * BAG], minlength=n) if len(some) > 64 * BAG else None

    def bags(self) -> tuple[np.ndarray, np.ndarray | None]:
        """Words of bits, and what is only counted or None; besides, all texts have so many as common says in common."""
        if self.bag is None:
            self._bags()
        return self.bag, self.rest

    def same_front(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many of the first four characters are equal."""
        equal, out = np.ones(len(i), bool), np.zeros(len(i), np.int64)
        for k in range(4):
            column = self.front[:, k]
            equal = equal & (column[i] == column[j]) & (column[i] > 0)
            out += equal
        return out

    def may_reach(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """Whether Jaro-Winkler similarity may be least: no more characters meet than both texts have."""
        bag, rest = self.bags()
        m = np.full(len(i), self.common, np.int64)
        for word in bag:
            m += np.bitwise_count(word[i] & word[j])
        if rest is not None:
            m += np.minimum(rest[i], rest[j])
        a, b = self.length[i], self.length[j]
        # a margin for rounding; with a common front of four the bound is the lowest, so most pairs need no look at theirs
        bound = (m / np.maximum(a, 1) + m / np.maximum(b, 1) + 1) / 3 + 1e-9
        ok = (bound + 0.4 * (1 - bound) >= least) | (a + b == 0)
        some = np.flatnonzero(ok)
        front = self.same_front(i[some], j[some])
        ok[some] = (bound[some] + front * 0.1 * (1 - bound[some]) >= least) | (a[some] + b[some] == 0)
        return ok

    def jaro_winkler(self, i: np.ndarray, j: np.ndarray, least: float | None = None) -> np.ndarray:
        """The similarity of each pair, to the bit that of similarity.jaro_winkler_similarity; with least, what is surely
        below it may be 0."""
        out = np.zeros(len(i))
        for k in range(0, len(i), CHUNK):
            out[k : k + CHUNK] = self._jaro_winkler(i[k : k + CHUNK], j[k : k + CHUNK], least)
        return out

    def _jaro_winkler(self, i: np.ndarray, j: np.ndarray, least: float | None) -> np.ndarray:
        out = np.zeros(len(i))
        quick = self.short[i] & self.short[j]
        for k in np.flatnonzero(~quick).tolist():
            out[k] = jaro_winkler_similarity(self.texts[i[k]], self.texts[j[k]])
        some = np.flatnonzero(quick)
        if not len(some):
            return out
        i, j = i[some], j[some]
        a, b = self.length[i], self.length[j]
        reach = np.maximum(0, np.maximum(a, b) // 2 - 1)
        step = np.arange(WIDTH + 1)
        free, met = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64)
        upto = np.r_[(_ONE << np.arange(WIDTH, dtype=np.uint64)) - _ONE, ~np.uint64(0)]  # the first k bits
        at, found, inside = np.empty(len(i), np.int64), np.empty(len(i), np.uint64), np.empty(len(i), np.uint64)
        for p in range(int(a.max(initial=0))):
            window = upto[np.minimum(WIDTH, p + step + 1)] & ~upto[np.maximum(0, p - step)]
            np.add(j, self.columns[p].take(i), out=at)
            self.places.take(at, out=found, mode="clip")
            found &= free
            found &= window.take(reach, out=inside, mode="clip")
            np.negative(found, out=inside)
            found &= inside
            free ^= found
            np.not_equal(found, 0, out=inside, casting="unsafe")
            inside <<= np.uint64(p)
            met |= inside
        m, taken, front = np.bitwise_count(met).astype(np.int64), ~free, self.same_front(i, j)
        score = self._score(a, b, m, np.zeros(len(i), np.int64), front)
        look = np.flatnonzero(m > 1) if least is None else np.flatnonzero((m > 1) & (score >= least))
        swaps = np.zeros(len(i), np.int64)
        left, x, y, bi, bj, differ = look, met[look], taken[look], i[look] * (WIDTH + 1), j[look] * (WIDTH + 1), np.zeros(len(look), np.int64)
        most = None
        if least is not None:  # places that may differ, one or two more for rounding
            k, high = m[look], (least - front[look] * 0.1) / (1 - front[look] * 0.1)
            most = 2 * np.floor(k * (k / a[look] + k / b[look] + 1 - 3 * high) + 1e-6).astype(np.int64) + 2
        for step in range(int(m[look].max(initial=0))):
            if most is not None and step % 8 == 0:  # what is surely below least isn't looked at further
                fine = differ <= most
                if fine.sum() < 0.8 * len(fine):
                    swaps[left[~fine]] = differ[~fine] // 2
                    left, x, y, bi, bj, differ, most = (z[fine] for z in (left, x, y, bi, bj, differ, most))
            # when all are looked at, both words are 0, and both look behind the last place
            u, v = x - _ONE, y - _ONE
            s = self._after.take(bi + np.bitwise_count(u & ~x))
            differ += s != self._after.take(bj + np.bitwise_count(v & ~y))
            x &= u
            y &= v
        swaps[left] = differ // 2
        out[some] = self._score(a, b, m, swaps, front)
        return out

    @staticmethod
    def _score(a: np.ndarray, b: np.ndarray, m: np.ndarray, swaps: np.ndarray, front: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(m > 0, (m / a + m / b + (m - swaps) / m) / 3, 0.0)
        s = np.where((a == 0) & (b == 0), 1.0, s)
        return np.where(s > 0.7, s + front * 0.1 * (1 - s), s)

    def levenshtein(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int32)
        for k in range(0, len(i), CHUNK):
            out[k : k + CHUNK] = self._levenshtein(i[k : k + CHUNK], j[k : k + CHUNK])
        return out

    def _levenshtein(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Myers' columns of differences: a bit for each character of the first text, a step for each of the second."""
        out = np.zeros(len(i), np.int32)
        quick = self.short[i] & self.short[j]
        for k in np.flatnonzero(~quick).tolist():
            out[k] = _levenshtein(self.texts[i[k]], self.texts[j[k]])
        some = np.flatnonzero(quick)
        if not len(some):
            return out
        i, j = i[some], j[some]
        a, b = self.length[i], self.length[j]
        up, down, score = np.full(len(i), ~np.uint64(0)), np.zeros(len(i), np.uint64), a.copy()
        last = np.maximum(a - 1, 0).astype(np.uint64)
        for p in range(int(b.max(initial=0))):
            equal = self.places[i + self.columns[p][j]]
            x = equal | down
            h = (((equal & up) + up) ^ up) | equal
            plus, minus = down | ~(h | up), up & h
            change = ((plus >> last) & _ONE).astype(np.int64) - ((minus >> last) & _ONE).astype(np.int64)
            score += np.where(p < b, change, 0)
            plus, minus = (plus << _ONE) | _ONE, minus << _ONE
            up, down = minus | ~(x | plus), plus & x
        out[some] = np.where(a == 0, b, score)
        return out
