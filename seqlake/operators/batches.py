"""Alignments of many pairs of letter sequences at once: tables are worked out for all pairs of a batch together.

Sequences stand in flat arrays; a batch is two tables of letters (places x pairs), shorter ones padded by letters that
match nothing. Pairs are dealt to batches by their lengths. All results equal those of `align` pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .align import MATCH, MISMATCH, LongTable, letter_scores, paired
from .structure import alternative_z

#: Cells of one row of all tables of a batch, and cells of whole tables that a batch holds.
ROW, WHOLE = 1 << 15, 1 << 21
#: Letters that stand for nothing, of either side.
NO_A, NO_B = -1, -2
#: A step back that is none, as the score there isn't positive.
END = np.iinfo(np.int16).max
#: Longest sequences whose ways back are found in batches; those of longer ones are found pair by pair.
LONGEST = 1 << 11


class Letters:
    """Sequences in one flat array, of which each begins at its offset."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.starts[k] : self.starts[k] + self.lengths[k]]

    def table(self, which: np.ndarray, none: int) -> np.ndarray:
        """(places, sequences): the letters of some sequences, padded."""
        place = np.arange(max(1, int(self.lengths[which].max())))[:, None]
        at = np.minimum(self.starts[which] + place, max(0, len(self.flat) - 1))
        return np.where(place < self.lengths[which], self.flat[at] if len(self.flat) else none, none).astype(np.int16 if self.small else np.int32)

    @cached_property
    def small(self) -> bool:
        return not len(self.flat) or (self.flat.min() >= 0 and self.flat.max() < 1 << 15)


def batches(m: np.ndarray, n: np.ndarray, row: int, whole: int | None = None) -> Iterator[np.ndarray]:
    """Places of pairs of lengths (m, n) in batches of alike ones: a row of all tables has `row` cells, all of them `whole`."""
    order = np.lexsort((n, m))
    start = 0
    while start < len(order):
        some = order[start : start + max(1, row // max(1, int(n[order[start]])))]
        widths, heights = np.maximum.accumulate(n[some]), np.maximum.accumulate(m[some])
        count = np.arange(1, len(some) + 1)
        fits = count * np.maximum(1, widths) <= row
        if whole is not None:
            fits &= count * (widths + heights) * heights <= whole
        most = max(1, int(np.flatnonzero(fits)[-1]) + 1 if fits.any() else 1)
        yield some[:most]
        start += most


def _whole_numbers(most: int):
    return np.int16 if most <= 30_000 else np.int32


def gapless_scores(a: Letters, b: Letters, ai: np.ndarray, bi: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH) -> np.ndarray:
    """The score of the best local alignment without gaps of each pair (ai, bi)."""
    out = np.zeros(len(ai), np.int32)
    for some in batches(a.lengths[ai], b.lengths[bi], ROW):
        x, y = a.table(ai[some], NO_A), b.table(bi[some], NO_B)
        kind = _whole_numbers(max(match, -mismatch, 1) * (min(len(x), len(y)) + 1))
        row, fresh = np.zeros((2, len(y) + 1, len(some)), kind)
        best, add, same = np.zeros(y.shape, kind), np.empty(y.shape, kind), np.empty(y.shape, bool)
        for letters in x:
            np.equal(y, letters, out=same)
            np.multiply(same, kind(match - mismatch), out=add)
            add += row[:-1]
            add += kind(mismatch)
            np.maximum(add, 0, out=fresh[1:])
            row, fresh = fresh, row
            np.maximum(best, row[1:], out=best)
        out[some] = best.max(axis=0)
    return out


def gapless_places(a: Letters, b: Letters, ai: np.ndarray, bi: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH) -> np.ndarray:
    """(pairs, 4): score, end in a, end in b and length of the best local alignment without gaps; of several the first by row."""
    out = np.zeros((len(ai), 4), np.int32)
    for some in batches(a.lengths[ai], b.lengths[bi], ROW):
        x, y = a.table(ai[some], NO_A), b.table(bi[some], NO_B)
        row, best, i, j = np.zeros((len(y) + 1, len(some)), np.int32), *np.zeros((3, len(some)), np.int32)
        for k, letters in enumerate(x):
            row[1:] = np.maximum(0, row[:-1] + np.where(y == letters, match, mismatch))
            most = row.max(axis=0)
            better = np.flatnonzero(most > best)
            if len(better):
                best[better], i[better], j[better] = most[better], k + 1, row[:, better].argmax(axis=0)
        length, left, on = np.zeros(len(some), np.int32), best.copy(), np.flatnonzero(best > 0)
        while len(on):  # back along the diagonal to where the sum begins
            p, q = i[on] - length[on] - 1, j[on] - length[on] - 1
            left[on] -= np.where(x[p, on] == y[q, on], match, mismatch)
            length[on] += 1
            on = on[left[on] > 0]
        out[some] = np.stack([best, i, j, length], axis=1)
    return out


def diagonal_scores(a: Letters, b: Letters, ai: np.ndarray, bi: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH) -> np.ndarray:
    """gapless_scores() by running sums along each diagonal: the greatest that one has gained since its least."""
    out = np.zeros(len(ai), np.int32)
    for some in batches(a.lengths[ai], b.lengths[bi], ROW):
        x, y = a.table(ai[some], NO_A), b.table(bi[some], NO_B)
        m, n = len(x), len(y)
        # by place j - i + m - 1 of a diagonal; a cell adds to the sum of its own diagonal, row by row
        total, least, best = np.zeros((3, m + n - 1, len(some)), np.int32)
        for i, letters in enumerate(x):
            on = slice(m - 1 - i, m - 1 - i + n)
            total[on] += np.where(y == letters, np.int32(match), np.int32(mismatch))
            np.maximum(best[on], total[on] - least[on], out=best[on])
            np.minimum(least[on], total[on], out=least[on])
        out[some] = best.max(axis=0)
    return out


def affine_scores(a: Letters, b: Letters, ai: np.ndarray, bi: np.ndarray, open_: float, widen: float, local: bool) -> np.ndarray:
    """Scores of alignments with affine gaps, worked out in whole ten-thousandths (or coarser, where these are as exact)."""
    out = np.zeros(len(ai))
    unit = next(u for u in (1, 10, 100, 1000, 10_000) if all(abs(v * u - round(v * u)) < 1e-9 for v in (open_, widen)) or u == 10_000)
    match, mismatch, opening, widening = (round(v * unit) for v in (MATCH, MISMATCH, open_, widen))
    for some in batches(a.lengths[ai], b.lengths[bi], ROW):
        x, y = a.table(ai[some], NO_A), b.table(bi[some], NO_B)
        m, n, width = len(x), len(y), len(some)
        kind = _whole_numbers(max(match * (min(m, n) + 1), opening + 2 * widening if local else 1 << 20))
        none = -20_000 if kind is np.int16 else -(1 << 30)
        back = np.ascontiguousarray(y[::-1])
        two, one, now = np.zeros((3, m + 2, width), kind)
        down, right = np.full((2, m + 2, width), none, kind)
        now_down, now_right = np.full((2, m + 2, width), none, kind)
        best, add, same = np.zeros((m + 2, width), kind), np.empty((m + 2, width), kind), np.empty((m + 2, width), bool)
        last, own_m, own_n, every = np.zeros(width, kind), a.lengths[ai[some]], b.lengths[bi[some]], np.arange(width)
        for d in range(2, m + n + 1):
            lo, hi = max(1, d - n), min(m, d - 1)
            here, up = slice(lo, hi + 1), slice(lo - 1, hi)
            s, e = add[here], same[here]
            np.subtract(down[up], kind(widening), out=now_down[here])
            np.subtract(one[up], kind(opening), out=s)
            np.maximum(now_down[here], s, out=now_down[here])
            np.subtract(right[here], kind(widening), out=now_right[here])
            np.subtract(one[here], kind(opening), out=s)
            np.maximum(now_right[here], s, out=now_right[here])
            np.equal(x[up], back[n - d + lo : n - d + hi + 1], out=e)
            np.multiply(e, kind(match - mismatch), out=s)
            s += kind(mismatch)
            s += two[up]
            np.maximum(s, now_down[here], out=s)
            np.maximum(s, now_right[here], out=now[here])
            if local:
                np.maximum(now[here], 0, out=now[here])
                np.maximum(best[here], now[here], out=best[here])
            else:
                for i, ends in ((own_m, (d - own_m >= 1) & (d - own_m <= own_n)), (d - own_n, (d - own_n >= 1) & (d - own_n <= own_m))):
                    p = every[ends]
                    last[p] = np.maximum(last[p], now[i[p], p])
            if hi == d - 1:
                now[d], now_down[d], now_right[d] = 0, none, none
            two, one, now = one, now, two
            down, now_down, right, now_right = now_down, down, now_right, right
        out[some] = (best.max(axis=0) if local else last) / unit
    return out


class Steps:
    """Cells of ways back through the tables of pairs, which go one step further at a time."""

    def __init__(self) -> None:
        self.pair, self.i, self.j = [], [], []

    def add(self, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        self.pair.append(pair), self.i.append(i), self.j.append(j)

    def joined(self, count: int, between: str) -> pa.Array:
        """Each pair's cells in the order of its steps as text."""
        pair, i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.pair, self.i, self.j))
        order = np.argsort(pair, kind="stable")
        i, j = i[order].astype(np.int64), j[order].astype(np.int64)
        cells, which = np.unique(i << 32 | j, return_inverse=True)
        words = pa.array([f"{c >> 32}{between}{c & 0xFFFFFFFF}" for c in cells.tolist()], pa.string())
        offsets = np.append(0, np.cumsum(np.bincount(pair, minlength=count))).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(which))), " ")


def placed_texts(a: Letters, b: Letters, ai: np.ndarray, bi: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """gapless_places()' scores and their cells `i:j`, from the end to the start."""
    found = gapless_places(a, b, ai, bi)
    steps, on = Steps(), np.flatnonzero(found[:, 3] > 0)
    k = 0
    while len(on):
        steps.add(on, found[on, 1] - k, found[on, 2] - k)
        k += 1
        on = on[found[on, 3] > k]
    return found[:, 0], steps.joined(len(ai), ":")


def linear_texts(a: Letters, b: Letters, ai: np.ndarray, bi: np.ndarray, indel: int = -5) -> pa.Array:
    """The cells of each pair's linear_cells(), all separated by spaces."""
    every = Steps()
    for some in batches(a.lengths[ai], b.lengths[bi], ROW, WHOLE):
        x, y = a.table(ai[some], NO_A), b.table(bi[some], NO_B)
        m, n, width = len(x), len(y), len(some)
        kind = _whole_numbers(MATCH * (min(m, n) + 1))
        back = np.ascontiguousarray(y[::-1])
        h = np.zeros((m + n + 1, m + 2, width), kind)  # by diagonal and row
        best, at = np.zeros((m + 2, width), kind), np.zeros((m + 2, width), np.int32)
        for d in range(2, m + n + 1):
            lo, hi = max(1, d - n), min(m, d - 1)
            here, up = slice(lo, hi + 1), slice(lo - 1, hi)
            value = h[d, here]
            np.multiply(x[up] == back[n - d + lo : n - d + hi + 1], kind(MATCH - MISMATCH), out=value)
            value += kind(MISMATCH)
            value += h[d - 2, up]
            np.maximum(value, np.maximum(h[d - 1, up], h[d - 1, here]) + kind(indel), out=value)
            np.maximum(value, 0, out=value)
            better = value > best[here]
            np.copyto(best[here], value, where=better)
            np.copyto(at[here], d, where=better)
        i = best.argmax(axis=0)
        p = np.arange(width)
        j = at[i, p] - i
        on = p[best[i, p] > 0]
        while len(on):
            r, c = i[on], j[on]
            every.add(some[on], r, c)
            value, d = h[r + c, r, on], r + c
            rise = value == h[d - 1, r - 1, on] + indel
            left = ~rise & (value == h[d - 1, r, on] + indel)
            i[on], j[on] = r - ~left, c - ~rise
            on = on[h[i[on] + j[on], i[on], on] > 0]
    return every.joined(len(ai), " ")


#: Figures of a pair's alignment: its score, aligned positions, equal ones, gaps, letters in gaps.
FIGURES = ("score", "length", "same", "gaps", "wide")


def affine_paths(a: Letters, b: Letters, ai: np.ndarray, bi: np.ndarray, open_: float, widen: float, local: bool = True) -> dict[str, np.ndarray]:
    """FIGURES of the best alignment with affine gaps of each pair, local or global, with the ties of align.alignments()."""
    out = {name: np.zeros(len(ai), float if name == "score" else np.int64) for name in FIGURES}
    short = np.maximum(a.lengths[ai], b.lengths[bi]) <= LONGEST
    for k in np.flatnonzero(~short).tolist():
        x, y = a[ai[k]], b[bi[k]]
        score, pairs = paired([(x, y)], None, open_, widen, local)[0]
        gaps = [g - 1 for (i, j), (p, q) in zip(pairs, pairs[1:]) for g in (p - i, q - j) if g > 1]
        for name, value in zip(FIGURES, (score, len(pairs), sum(int(x[i] == y[j]) for i, j in pairs), len(gaps), sum(gaps))):
            out[name][k] = value
    short = np.flatnonzero(short)
    for some in map(short.__getitem__, batches(a.lengths[ai[short]], b.lengths[bi[short]], ROW // 2, WHOLE)):
        x, y = a.table(ai[some], NO_A), b.table(bi[some], NO_B)
        m, n, width = len(x), len(y), len(some)
        back = np.ascontiguousarray(y[::-1])
        two, one, now = np.zeros((3, m + 2, width))
        down, right, now_down, now_right = np.full((4, m + 2, width), -np.inf)
        down_n, right_n, now_down_n, now_right_n = np.zeros((4, m + 2, width), np.int16)
        steps = np.full((m + n + 1, m + 2, width), END, np.int16)
        best, at = np.zeros((m + 2, width)), np.zeros((m + 2, width), np.int32)
        own, ends = (a.lengths[ai[some]], b.lengths[bi[some]]), np.zeros((2, 2, width))  # of the last row and column: score, diagonal
        ends[0, 1], ends[1, 1] = own
        for d in range(2, m + n + 1):
            lo, hi = max(1, d - n), min(m, d - 1)
            here, up = slice(lo, hi + 1), slice(lo - 1, hi)
            opened, longer = one[up] - open_, down[up] - widen
            np.maximum(longer, opened, out=now_down[here])
            now_down_n[here] = down_n[up] * (longer > opened) + np.int16(1)
            opened, longer = one[here] - open_, right[here] - widen
            np.maximum(longer, opened, out=now_right[here])
            now_right_n[here] = right_n[here] * (longer >= opened) + np.int16(1)
            value = two[up] + np.where(x[up] == back[n - d + lo : n - d + hi + 1], float(MATCH), float(MISMATCH))
            step = (now_down[here] > value) * now_down_n[here]
            np.maximum(value, now_down[here], out=value)
            np.copyto(step, -now_right_n[here], where=now_right[here] > value)
            np.maximum(value, now_right[here], out=value)
            if local:
                np.copyto(step, END, where=value <= 0)
                np.maximum(value, 0, out=value)
                better = value > best[here]
                np.copyto(best[here], value, where=better)
                np.copyto(at[here], d, where=better)
            steps[d, here], now[here] = step, value
            if not local:
                for side, rows in enumerate((own[0], d - own[1])):
                    there = np.flatnonzero((rows >= 1) & (rows <= own[0]) & (d - rows >= 1) & (d - rows <= own[1]))
                    there = there[now[rows[there], there] > ends[side, 0, there]]
                    ends[side, :, there] = np.stack([now[rows[there], there], np.full(len(there), d)], axis=1)
            if hi == d - 1:
                now[d], now_down[d], now_right[d] = 0, -np.inf, -np.inf
            two, one, now = one, now, two
            down, now_down, right, now_right = now_down, down, now_right, right
            down_n, now_down_n, right_n, now_right_n = now_down_n, down_n, now_right_n, right_n
        p = np.arange(width)
        i = best.argmax(axis=0)
        j = at[i, p] - i
        if not local:
            row = ends[0, 0] >= ends[1, 0]
            i = np.where(row, own[0], ends[1, 1] - own[1]).astype(np.int64)
            j = np.where(row, ends[0, 1] - own[0], own[1]).astype(np.int64)
            best[0] = ends[:, 0].max(axis=0)
        length, same, gaps, wide, rose, went = np.zeros((6, width), np.int64)
        on = p[best[i, p] > 0] if local else p[(i > 0) & (j > 0)]
        while len(on):
            r, c = i[on], j[on]
            step = steps[r + c, r, on].astype(np.int64)
            go = step != END
            on, r, c, step = on[go], r[go], c[go], step[go]
            even = step == 0
            q = on[even]
            again = q[length[q] > 0]
            gaps[again] += (rose[again] > 0).astype(np.int64) + (went[again] > 0)
            wide[again] += rose[again] + went[again]
            rose[q], went[q] = 0, 0
            length[q] += 1
            same[q] += x[r[even] - 1, q] == y[c[even] - 1, q]
            rose[on] += np.maximum(step, 0)
            went[on] += np.maximum(-step, 0)
            i[on] = r - np.where(even, 1, np.maximum(step, 0))
            j[on] = c - np.where(even, 1, np.maximum(-step, 0))
            on = on[(i[on] > 0) & (j[on] > 0)]
        for name, found in zip(FIGURES, (best.max(axis=0), length, same, gaps, wide)):
            out[name][some] = found
    return out


@lru_cache(128)
def _ranked(before: int, n: int, rounds: int, seed: int) -> np.ndarray:
    """(rounds, n): the rank of each of a round's random numbers, as structure draws them behind those of `before` places."""
    random = np.random.default_rng(seed)
    random.bit_generator.advance(rounds * before)
    order = np.argsort(random.random((rounds, n)), axis=1, kind="stable")
    ranks = np.empty((rounds, n), np.int16)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(n, dtype=np.int16), order.shape), axis=1)
    return ranks


@lru_cache(32)
def _choice(before: int, n: int, length: int, rounds: int, seed: int) -> np.ndarray:
    """(rounds * length): the places that structure._chosen() has, in order."""
    return np.flatnonzero(_ranked(before, n, rounds, seed) < length) % n


def path_scores(a: Letters, b: Letters, ai: np.ndarray, bi: np.ndarray, score: np.ndarray, length: np.ndarray, rounds: int = 1000, seed: int = 0) -> np.ndarray:
    """structure.alternative_z() of pairs whose letters match or don't; pairs of equal lengths share their random paths."""
    m, n, out = a.lengths[ai], b.lengths[bi], np.zeros(len(ai))
    for k in np.lexsort((length, n, m)).tolist():
        size = int(length[k])
        if not size:
            continue
        if max(m[k], n[k]) > LONGEST:
            out[k] = alternative_z(float(score[k]), LongTable(a[ai[k]], b[bi[k]], letter_scores()), [(0, 0)] * size, rounds, seed)
            continue
        rows, columns = _choice(0, int(m[k]), size, rounds, seed), _choice(int(m[k]), int(n[k]), size, rounds, seed)
        same = (a[ai[k]][rows] == b[bi[k]][columns]).reshape(rounds, size)
        hits = np.bincount(np.count_nonzero(same, axis=1)) if size > 255 else np.bincount(same.view(np.uint8).sum(axis=1, dtype=np.uint8))
        value = np.arange(len(hits)) * (MATCH - MISMATCH) + MISMATCH * size
        first, second = int(hits @ value), int(hits @ (value * value))
        mean, varies = first / rounds, rounds * second - first * first
        sd = (varies / (rounds * (rounds - 1))) ** 0.5
        out[k] = (score[k] - mean) / sd if sd > 1e-12 * max(1.0, abs(mean)) else 0.0
    return out
