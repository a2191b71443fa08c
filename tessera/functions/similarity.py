"""Similarities of two values: Column expressions where Spark has the parts, Arrow functions for the edit-based ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, plus a tenth per common leading character (four at most) of what is missing to 1 where it exceeds 0.7. 1 for equal strings, 0 if one is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, of_a = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                of_a.append(c)
                break
    m = len(of_a)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(of_a, (c for c, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return jaro + 0.1 * lead * (1 - jaro)


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for c in b:
        x = row | at.get(c, 0)
        row = x & ~(x - ((row << 1) | 1)) & full
    return row.bit_count()


def ratio_of(a: str, b: str) -> float:
    """2 * common / (both lengths); 1 for two empty strings."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort_of(a: str, b: str) -> float:
    return ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    """The best ratio of the common words and each side's whole set; 1 if one set holds the other, 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio_of(one, two), ratio_of(both, one) if both else 0.0, ratio_of(both, two) if both else 0.0)


def partial_of(a: str, b: str) -> float:
    """The best ratio of the shorter string and a window of the longer one, windows at its ends may be shorter; 1 for two empty strings, 0 for one."""
    if not a or not b:
        return float(not a and not b)
    short, long = sorted((a, b), key=len)
    n = len(short)
    return max(ratio_of(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def _alike(a: list[str], b: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs in groups of like lengths: places, lengths, and characters as small codes, a pair a column; what is filled up equals nothing."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    size = -(-la // 16) * 1_000_003 + -(-lb // 16)
    order = np.argsort(size, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        m, n = int(la[same].max(initial=0)), int(lb[same].max(initial=0))
        step = max(1, min(2048, 4_000_000 // (m + n + 1)))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            flat = np.frombuffer("".join([a[i] for i in some] + [b[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32)
            code = np.zeros(int(flat.max(initial=0)) + 1, np.uint32)
            code[flat] = 1
            known = np.flatnonzero(code)
            code[known] = np.arange(2, len(known) + 2)
            codes = code.astype(np.uint8 if len(known) < 250 else np.uint32)[flat]
            sides, start = [], 0
            for lengths, width, fill in ((la[some], m, 0), (lb[some], n, 1)):
                side = np.full((len(some), width), fill, codes.dtype)
                side[np.arange(width) < lengths[:, None]] = codes[start : start + lengths.sum()]
                start += lengths.sum()
                sides.append(side)
            yield some, la[some], lb[some], *sides


def _combed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of strings, for each end in b the start (-1: before b) from which on that character adds nothing to the common subsequence.

    The longest one of a and b[i:j] is j - i less the ends from i to j - 1 whose start is i or more: semi-local comparison by
    braids, a diagonal of cells of all pairs at a time.
    """
    m, n = a.shape[1], b.shape[1]
    kind = np.uint8 if m + n < 256 else np.uint16 if m + n < 65_536 else np.int64
    a, b = np.ascontiguousarray(a.T[::-1]), np.ascontiguousarray(b.T)
    h, v = (np.repeat(np.arange(x, y, dtype=kind)[:, None], b.shape[1], axis=1) for x, y in ((0, m), (m, m + n)))
    for d in range(m + n - 1):
        j, till = max(0, d - m + 1), min(n, d + 1)
        x, y = slice(j + m - 1 - d, till + m - 1 - d), slice(j, till)
        same = a[x] == b[y]
        low, high = np.minimum(h[x], v[y]), np.maximum(h[x], v[y])
        across, down = np.where(same, v[y], low), np.where(same, h[x], high)
        h[x], v[y] = across, down
    return np.maximum(v.astype(np.int32) - m, -1)


def _partials_of_long(short: list[str], long: list[str]) -> np.ndarray:
    """``partial_of`` for pairs of a shorter and a longer text: all windows from one comparison."""
    out = np.zeros(len(short))
    for at, n, size, x, y in _alike(short, long):
        if not len(at):
            continue
        start, end = _combed(x, y), np.arange(1, y.shape[1] + 1)[:, None]
        lead = np.where(end <= np.minimum(n - 1, size), 2 * (end - np.cumsum(start >= 0, axis=0)) / (n + end), 0.0)
        best = lead.max(axis=0)
        for i in range(y.shape[1]):
            till = np.minimum(size, i + n)
            rows = slice(i, i + x.shape[1])
            idle = ((start[rows] >= i) & (end[rows] <= till)).sum(axis=0)
            best = np.where(i < size, np.maximum(best, 2 * (till - i - idle) / np.maximum(n + till - i, 1)), best)
        out[at] = best
    return out


#: Pairs that are compared at a time.
_STEP = 8192
_ALL = np.uint64(2**64 - 1)


class Texts:
    """Texts by number, their characters as small codes from 1 on; pairs of them are two arrays of numbers."""

    def __init__(self, texts: list[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
        code[flat] = 1
        known = np.flatnonzero(code)
        code[known] = np.arange(1, len(known) + 1)
        self.flat, self.letters = np.append(code[flat], 0), len(known) + 1

    def rows(self, which: np.ndarray, back: bool = False) -> np.ndarray:
        """Codes of some texts, a text a column, from its begin or end on, 0 after that."""
        size = self.size[which]
        place = np.arange(int(size.max(initial=0)))[:, None]
        return self.flat[np.where(place < size, self.start[which] + (size - 1 - place if back else place), len(self.flat) - 1)]

    def masks(self, which: np.ndarray, words: int, back: bool = False) -> np.ndarray:
        """Where in each of some texts a character is, as bits: words of bits, then a text's characters one after the other."""
        out, base = np.zeros((words, len(which) * self.letters), np.uint64), np.arange(len(which)) * self.letters
        for p, row in enumerate(self.rows(which, back)):
            out[p // 64][base + row] |= np.uint64(1 << p % 64)
        out[:, base] = 0
        return out

    def alike(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs in groups of like lengths: places, codes of their first texts, masks of the second ones, where a pair's masks begin; with ``back`` codes and masks from the end on, too."""
        words = np.maximum(1, -(-self.size[b] // 64))
        order = np.lexsort((b, self.size[a] // 8, words))
        for same in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
            if len(same):
                w = int(words[same[0]])
                step = max(1, min(_STEP, 4_000_000 // (self.letters * w)))
                for at in range(0, len(same), step):
                    some = same[at : at + step]
                    (x, i), (y, j) = (np.unique(n[some], return_inverse=True) for n in (a, b))
                    yield some, self.rows(x).take(i, axis=1), self.masks(y, w), j * self.letters, *((self.rows(x, True).take(i, axis=1), self.masks(y, w, True)) if back else ())


def _matched(v: list[np.ndarray], masks: list[np.ndarray]) -> None:
    """A character more of the longest common subsequence: ``masks`` are the places of the other text that have it; 0 bits of ``v`` count."""
    carry = None
    for k, m in enumerate(masks):
        u = v[k] & m
        s = v[k] + u
        over = s < u
        if carry is not None:
            s += carry
            over |= s < carry
        v[k], carry = s | (v[k] ^ u), over


def commons(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of pairs, by bits."""
    out, shorter = np.zeros(len(a), np.int64), t.size[a] < t.size[b]
    for some, rows, masks, base in t.alike(np.where(shorter, b, a), np.where(shorter, a, b)):
        v = [np.full(len(some), _ALL) for _ in masks]
        for row in rows:
            at = base + row
            _matched(v, [m[at] for m in masks])
        out[some] = sum(np.bitwise_count(~x).astype(np.int64) for x in v)
    return out


def ratios(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = t.size[a] + t.size[b]
    return np.where(both > 0, 2 * commons(t, a, b) / np.maximum(both, 1), 1.0)


def distances(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs, by bits."""
    out, shorter = np.zeros(len(a), np.int64), t.size[a] < t.size[b]
    first, second = np.where(shorter, b, a), np.where(shorter, a, b)
    for some, rows, masks, base in t.alike(first, second):
        n, m = t.size[first[some]], t.size[second[some]]
        up, down, score = [np.full(len(some), _ALL) for _ in masks], [np.zeros(len(some), np.uint64) for _ in masks], m.copy()
        word, bit = np.maximum(m - 1, 0) // 64, (np.maximum(m - 1, 0) % 64).astype(np.uint64)
        for p, row in enumerate(rows):
            at, carry, more, less = base + row, np.zeros(len(some), np.uint64), np.uint64(1), np.uint64(0)
            live = (n > p) & (m > 0)
            for k, mask in enumerate(masks):
                eq = mask[at]
                u = eq & up[k]
                s = u + up[k]
                over = s < u
                s += carry
                over |= s < carry
                carry = over.astype(np.uint64)
                same = (s ^ up[k]) | eq | down[k]
                plus, minus = down[k] | ~(same | up[k]), same & up[k]
                here = live & (word == k)
                score += here * (((plus >> bit) & np.uint64(1)).astype(np.int64) - ((minus >> bit) & np.uint64(1)).astype(np.int64))
                more, plus = plus >> np.uint64(63), (plus << np.uint64(1)) | more
                less, minus = minus >> np.uint64(63), (minus << np.uint64(1)) | less
                up[k], down[k] = minus | ~(same | plus), plus & same
        out[some] = np.where(m > 0, score, n)
    return out


def jaro_winklers(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``jaro_winkler_of`` for pairs of different texts, each of which is there once."""
    out = ((a == b) & (t.size[a] > 0)).astype(float)
    other = np.flatnonzero((a != b) & (t.size[a] > 0) & (t.size[b] > 0))
    a, b = a[other], b[other]
    for some, rows, masks, base in t.alike(a, b):
        la, lb = t.size[a[some]], t.size[b[some]]
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        spans = [(1 << r + 1) - 1 for r in range(int(reach.max()) + 1)]
        near = [np.array([x >> 64 * k & 2**64 - 1 for x in spans], np.uint64)[reach] for k in range(len(masks))]
        free, hits = [np.full(len(some), _ALL) for _ in masks], np.zeros(rows.shape, bool)
        for p, row in enumerate(rows):
            at, found, low = base + row, False, (reach >= p).astype(np.uint64)
            for k, mask in enumerate(masks):
                if p:
                    low, near[k] = near[k] >> np.uint64(63), (near[k] << np.uint64(1)) | low
                x = mask[at] & near[k] & free[k]
                free[k] ^= np.where(found, np.uint64(0), x & -x) if k else x & -x
                found = found | (x != 0)
            hits[p] = found
        taken, moved = [~x for x in free], np.zeros(len(some), np.int64)
        for row, hit in zip(rows, hits):
            at, rest, same = base + row, hit, False
            for k, mask in enumerate(masks):
                x = np.where(rest, taken[k] & -taken[k], np.uint64(0))
                taken[k] ^= x
                same = same | ((x & mask[at]) != 0)
                rest = rest & (x == 0)
            moved += hit & ~same
        m, moved = hits.sum(axis=0), moved // 2
        jaro = np.where(m > 0, (m / la + m / lb + (m - moved) / np.maximum(m, 1)) / 3, 0.0)
        lead, still = np.zeros(len(some), np.int64), True
        for q in range(4):
            x, y = (t.flat[np.where(size > q, t.start[n[some]] + q, len(t.flat) - 1)] for n, size in ((a, la), (b, lb)))
            still = still & (x == y) & (x > 0)
            lead += still
        out[other[some]] = np.where(jaro <= 0.7, jaro, jaro + 0.1 * lead * (1 - jaro))
    return out


def _numbered(a: list[str], b: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, each once, and the pairs' numbers among them."""
    at: dict[str, int] = {}
    x, y = (np.fromiter((at.setdefault(v, len(at)) for v in side), np.int64, len(side)) for side in (a, b))
    return list(at), x, y


def token_sort_all(a: list[str], b: list[str]) -> np.ndarray:
    """``token_sort_of`` for many pairs."""
    texts, x, y = _numbered(a, b)
    return ratios(Texts([" ".join(sorted(t.split())) for t in texts]), x, y)


class WordSets(Texts):
    """The sets of words of texts, as a text of their sorted words, a blank before each."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        self.words = [sorted(set(t.split())) for t in texts]
        super().__init__(["".join(" " + w for w in ws) for ws in self.words])
        self.count = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.of = [np.array([known.setdefault(w, len(known)) for w in ws], np.int64) for ws in self.words]
        self.ends = [np.cumsum([len(w) + 1 for w in ws], dtype=np.int64) for ws in self.words]


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    """Rows of unequal length, one a column."""
    out = np.full((max(map(len, rows), default=0), len(rows)), fill, np.int64)
    for k, r in enumerate(rows):
        out[: len(r), k] = r
    return out


#: Words of a set up to which all of a pair are held against each other.
_WORDS = 48


def token_sets(t: WordSets, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``token_set_of`` for pairs. What both begin with is common, so only the rests are compared, where they stand."""
    out = np.zeros(len(a))
    fits = (t.count[a] > 0) & (t.count[b] > 0)
    many = np.flatnonzero(fits & ((t.count[a] > _WORDS) | (t.count[b] > _WORDS)))
    few = np.flatnonzero(fits & (t.count[a] <= _WORDS) & (t.count[b] <= _WORDS))
    for some, rows, masks, base in t.alike(a[few], b[few]):
        sides = []
        for n, width in ((a[few[some]], -(-len(rows) // 64)), (b[few[some]], len(masks))):
            one, at = np.unique(n, return_inverse=True)
            ends = padded([t.ends[k] for k in one], 0)
            starts = np.vstack([np.zeros((1, len(one)), np.int64), ends[:-1]])
            below = [np.array([(1 << e) - 1 >> 64 * k & 2**64 - 1 for e in range(64 * width + 1)], np.uint64) for k in range(width)]
            sides.append((padded([t.of[k] for k in one], -1 - len(sides)).take(at, axis=1), np.where(ends > 0, ends - starts, 0).take(at, axis=1), [np.where(ends > 0, x[ends] ^ x[starts], np.uint64(0)).take(at, axis=1) for x in below]))
        (x, x_size, x_bits), (y, y_size, y_bits) = sides
        in_x, in_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        for k, w in enumerate(x):
            same = y == w
            in_y |= same
            in_x[k] = same.any(axis=0)
        common, (left, right) = (x_size * in_x).sum(axis=0), ((s * ~i).sum(axis=0) for s, i in ((x_size, in_x), (y_size, in_y)))
        kept = []
        for bits, shared in ((x_bits, in_x), (y_bits, in_y)):
            words = [np.bitwise_or.reduce(np.where(shared, np.uint64(0), w), axis=0) for w in bits]
            found = np.zeros(len(some), bool)
            for w in words:  # without the rest's first blank
                first = np.where(found, np.uint64(0), w & -w)
                w ^= first
                found |= first != 0
            kept.append(words)
        v = [np.full(len(some), _ALL) for _ in masks]
        for p, row in enumerate(rows):
            at, here = base + row, -(kept[0][p // 64] >> np.uint64(p % 64) & np.uint64(1))
            _matched(v, [m[at] & w & here for m, w in zip(masks, kept[1])])
        lcs = sum(np.bitwise_count(~w).astype(np.int64) for w in v)
        out[few[some]] = _set_ratio(common - 1, left - 1, right - 1, lcs)
    if len(many):
        shared = [set(t.words[x]) & set(t.words[y]) for x, y in zip(a[many], b[many])]
        lefts, rights = ([" ".join(w for w in t.words[x] if w not in s) for x, s in zip(n[many], shared)] for n in (a, b))
        texts, x, y = _numbered(lefts, rights)
        one = Texts(texts)
        head = np.array([sum(map(len, s)) + len(s) - 1 for s in shared])
        left, right = (np.where(one.size[n] > 0, one.size[n], -1) for n in (x, y))
        out[many] = _set_ratio(head, left, right, commons(one, x, y))
    return out


def _set_ratio(head: np.ndarray, left: np.ndarray, right: np.ndarray, lcs: np.ndarray) -> np.ndarray:
    """From the lengths of the common words and of both rests, -1 for none."""
    whole = (head > 0) & ((left < 0) | (right < 0))
    one, two = head + 1 + np.maximum(left, 0), head + 1 + np.maximum(right, 0)
    value = 2 * (head + 1 + lcs) / np.maximum(one + two, 1)
    for size in (one, two):
        value = np.where(head > 0, np.maximum(value, 2 * head / np.maximum(head + size, 1)), value)
    return np.where(whole, 1.0, value)


def _by_width(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of lists of like sizes: places, members of both lists, a pair a column, where none fills up, and the rows of these columns."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    wide = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    kind = wide[a] * 64 + wide[b]
    order = np.argsort(kind, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        m, n = (int(size[x[same]].max(initial=0)) for x in (a, b))
        step = max(1, min(_STEP, 8_000_000 // (m + n + 1)))
        for k in range(0, len(same), step):
            some = same[k : k + step]
            (x, i), (y, j) = (np.unique(z[some], return_inverse=True) for z in (a, b))
            yield some, padded([sets[v] for v in x], -1).take(i, axis=1), padded([sets[v] for v in y], -2).take(j, axis=1), a[some], b[some]


def shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members pairs of sets share."""
    out = np.zeros(len(a), np.int64)
    for some, x, y, _, _ in _by_width(sets, a, b):
        x, y = x.astype(np.int32), y.astype(np.int32)
        count = np.zeros(len(some), np.int64)
        for row in x:
            if len(y):
                count += (y == row).any(axis=0)
        out[some] = count
    return out


def weighted(sets: list[np.ndarray], weights: list[np.ndarray], first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``weighted_jaccard`` of two sets a row, which follow one another in its list, the ``first`` members being the first one's.

    A member weighs what any of b's list gives it, else what a's does; nan is none.
    """
    out = np.zeros((2, len(a)))
    for some, x, y, s, c in _by_width(sets, a, b):
        def heavy(rows, height):
            one, at = np.unique(rows, return_inverse=True)
            w = np.full((height, len(one)), np.nan)
            for k, r in enumerate(one):
                w[: len(weights[r]), k] = weights[r]
            return w.take(at, axis=1)

        wx, wy = heavy(s, len(x)), heavy(c, len(y))
        for row, w in zip(x, wx):  # what b says of a's members
            for other, v in zip(y, wy):
                w[:] = np.where((row == other) & ~np.isnan(v), v, w)
        wx, wy = np.nan_to_num(wx), np.nan_to_num(wy)
        place_x, place_y = np.arange(len(x))[:, None], np.arange(len(y))[:, None]
        for k in range(2):
            in_x, in_y = ((x >= 0) & ((p < first[r]) == (k == 0)) for x, p, r in ((x, place_x, s), (y, place_y, c)))
            p, q = np.where(in_x, x, -1), np.where(in_y, y, -2)
            common, union, lone, none = np.zeros(len(some)), np.zeros(len(some)), in_y.copy(), ~(in_x.any(axis=0) | in_y.any(axis=0))
            for row, w, own in zip(p, wx, in_x):
                met = q == row
                lone &= ~met
                common += np.where(met.any(axis=0), w, 0.0)
                union += np.where(own, w, 0.0)
            for w, own in zip(wy, lone):
                union += np.where(own, w, 0.0)
            out[k, some] = np.where(none, 1.0, common / np.maximum(union, 1e-9))
    return out[0], out[1]


def token_set_all(a: list[str], b: list[str]) -> np.ndarray:
    """``token_set_of`` for many pairs."""
    texts, x, y = _numbered(a, b)
    return token_sets(WordSets(texts), x, y)


def partials(t: Texts, texts: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``partial_of`` for pairs: windows of short texts by bits, all windows of long ones from one comparison."""
    out = ((t.size[a] == 0) & (t.size[b] == 0)).astype(float)
    full = np.flatnonzero((t.size[a] > 0) & (t.size[b] > 0))
    swap = t.size[b[full]] < t.size[a[full]]
    short, long = np.where(swap, b[full], a[full]), np.where(swap, a[full], b[full])
    far = (t.size[short] > 64) | (t.size[long] - t.size[short] > 48)
    if far.any():
        out[full[far]] = _partials_of_long([texts[k] for k in short[far]], [texts[k] for k in long[far]])
    full, short, long = full[~far], short[~far], long[~far]
    for some, rows, (mask,), base, tail, (last,) in t.alike(long, short, True):
        n, size = t.size[short[some]], t.size[long[some]]
        codes = np.vstack([rows, np.zeros((64, len(some)), rows.dtype)])
        best, v, w = np.zeros(len(some)), np.full(len(some), _ALL), np.full(len(some), _ALL)
        for p in range(int(n.max()) - 1):  # the shorter windows at both ends
            for x, row, of in ((v, rows[p], mask), (w, tail[p], last)):
                u = x & of[base + row]
                x[:] = (x + u) | (x ^ u)
                best = np.maximum(best, np.where(p + 1 < n, 2 * np.bitwise_count(~x).astype(np.int64) / (n + p + 1), 0.0))
        most, least = int(n.max()), int(n.min())
        for i in range(int((size - n).max()) + 1):
            live = np.flatnonzero(size - n >= i)
            begin, till, v = base[live], n[live], np.full(len(live), _ALL)
            sub = codes[i : i + most].take(live, axis=1) if len(live) < len(some) else codes[i : i + most]
            for p, row in enumerate(sub):
                u = v & mask[begin + row]
                if p >= least:
                    u &= -(till > p).astype(np.uint64)
                v = (v + u) | (v ^ u)
            best[live] = np.maximum(best[live], 2 * np.bitwise_count(~v).astype(np.int64) / (2 * till))
        out[full[some]] = best
    return out


def partial_all(a: list[str], b: list[str]) -> np.ndarray:
    """``partial_of`` for many pairs."""
    texts, x, y = _numbered(a, b)
    return partials(Texts(texts), texts, x, y)


def jaro_winkler_all(a: list[str], b: list[str]) -> np.ndarray:
    """``jaro_winkler_of`` for many pairs."""
    texts, x, y = _numbered(a, b)
    return jaro_winklers(Texts(texts), x, y)


def _by_pair(of_all):
    """A column function of two texts; null is empty. Pairs that a batch repeats are compared once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        at: dict[tuple[str, str], int] = {}
        places = [at.setdefault((x or "", y or ""), len(at)) for x, y in zip(a, b)]
        return pd.Series(of_all([x for x, _ in at], [y for _, y in at])[places] if places else [], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


jaro_winkler = _by_pair(jaro_winkler_all)
token_sort_ratio = _by_pair(token_sort_all)
token_set_ratio = _by_pair(token_set_all)
partial_ratio = _by_pair(partial_all)


def levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_of_sets(a: Column, b: Column, both_empty: float) -> Column:
    """``jaccard`` of two arrays without repeats, which needs no union."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(both_empty)).otherwise(common / union)


def weighted_jaccard(a: Column, b: Column, weight: Column) -> Column:
    """Of two arrays as sets whose members weigh ``weight`` (a map); unknown ones weigh 0; 1 for two empty arrays."""
    total = lambda words: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(weight, w), F.lit(0.0)))
    union = F.array_union(a, b)
    return F.when(F.size(union) == 0, 1.0).otherwise(total(F.array_intersect(a, b)) / F.greatest(total(union), F.lit(1e-9)))


def equal(a: Column, b: Column) -> Column:
    """1 if equal and not empty, else 0; null is never equal."""
    return F.coalesce((a == b) & (a != ""), F.lit(False)).cast("int")


def dot(a: Column, b: Column, missing: float = -2.0) -> Column:
    """The inner product of two arrays, ``missing`` if one is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), F.lit(missing))


def legal_state(a: Column, b: Column) -> Column:
    """0 neither has a legal form, 1 the same, 2 one has none, 3 they differ."""
    return F.when((a == "") & (b == ""), 0).when(a == b, 1).when((a == "") | (b == ""), 2).otherwise(3)


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def acronym_match(a: Column, b: Column, a_words: Column, b_words: Column) -> Column:
    """1 if the acronyms agree or one is the initials of the other's words (stop words count there), else 0."""
    return ((a != "") & ((a == b) | (a == initials(b_words))) | (b != "") & (b == initials(a_words))).cast("int")
