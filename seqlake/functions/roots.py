"""Roots of many functions of one variable at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def bracketed_roots(f: Callable[[np.ndarray, np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, tolerance: float = 1e-12, rounds: int = 100) -> tuple[np.ndarray, int]:
    """A root of each function between low and high, and how many times f was asked; NaN where the ends don't differ in sign.

    f(which, x) gives the values at x of the functions of those numbers. Brent's way: a step goes to where the inverse
    parabola through the last three points, or the line through two, meets zero; it is halved into the bracket where
    that leads out of it or doesn't shorten the step before last by half. Functions that are done are asked no more.
    """
    low, high = np.array(low, float), np.array(high, float)
    every = np.arange(len(low))
    best, other = high.copy(), low.copy()
    f_best, f_other = f(every, best), f(every, other)
    asked = 2
    out = np.full(len(low), np.nan)
    out[f_best == 0], out[(f_other == 0) & (f_best != 0)] = best[f_best == 0], other[(f_other == 0) & (f_best != 0)]
    open_ = np.flatnonzero(np.sign(f_best) * np.sign(f_other) < 0)
    last, f_last = other.copy(), f_other.copy()
    step = best - other
    before = step.copy()
    for _ in range(rounds):
        if not len(open_):
            break
        b, c, fb, fc = best[open_], other[open_], f_best[open_], f_other[open_]
        a, fa = last[open_], f_last[open_]
        swap = np.abs(fc) < np.abs(fb)  # the better end of the bracket goes on
        a, fa = np.where(swap, b, a), np.where(swap, fb, fa)
        b, c, fb, fc = np.where(swap, c, b), np.where(swap, b, c), np.where(swap, fc, fb), np.where(swap, fb, fc)
        room = 2 * np.finfo(float).eps * np.abs(b) + tolerance / 2
        half = (c - b) / 2
        over = (np.abs(half) <= room) | (fb == 0)
        out[open_[over]] = b[over]
        go = ~over
        open_, a, b, c, fa, fb, fc, room, half = open_[go], a[go], b[go], c[go], fa[go], fb[go], fc[go], room[go], half[go]
        if not len(open_):
            break
        with np.errstate(all="ignore"):
            s, q, r = fb / fa, fa / fc, fb / fc
            line = a == c
            p = np.where(line, 2 * half * s, s * (2 * half * q * (q - r) - (b - a) * (r - 1)))
            q = np.where(line, 1 - s, (q - 1) * (r - 1) * (s - 1))
        p, q = np.where(p > 0, p, -p), np.where(p > 0, -q, q)
        good = (np.abs(before[open_]) >= room) & (np.abs(fa) > np.abs(fb)) & (2 * p < np.minimum(3 * half * q - np.abs(room * q), np.abs(before[open_] * q)))
        with np.errstate(all="ignore"):
            move = np.where(good, p / np.where(q == 0, 1, q), half)
        before[open_] = np.where(good, step[open_], half)
        step[open_] = move
        at = b + np.where(np.abs(move) > room, move, np.copysign(room, half))
        value = f(open_, at)
        asked += 1
        crossed = np.sign(value) * np.sign(fc) > 0  # then the root lies between the two last points
        last[open_], f_last[open_] = b, fb
        best[open_], f_best[open_] = at, value
        other[open_], f_other[open_] = np.where(crossed, b, c), np.where(crossed, fb, fc)
        fresh = open_[crossed]
        step[fresh] = before[fresh] = best[fresh] - last[fresh]
    out[open_] = best[open_]
    return out, asked
