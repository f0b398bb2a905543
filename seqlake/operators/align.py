"""Alignment scores of pairs of letter arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType
from pyspark.sql.window import Window

from .long_align import Score, long_alignment

MATCH, MISMATCH = 3, -2
#: Cells up to which a pair's tables are held, and those of several pairs at a time; cells of a longer pair at a time.
TABLE, PLACES = 1 << 22, 1 << 14


def gapless(a: np.ndarray, b: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH) -> tuple[int, int, int, int]:
    """(score, end in a, end in b, length) of the best local alignment without gaps; of several the first by row."""
    best = (0, 0, 0, 0)
    row, run = np.zeros(len(b) + 1, np.int32), np.zeros(len(b) + 1, np.int32)
    for i, letter in enumerate(a):
        score = np.where(b == letter, match, mismatch)
        fresh, length = np.zeros_like(row), np.zeros_like(run)
        fresh[1:] = np.maximum(0, row[:-1] + score)
        length[1:] = np.where(fresh[1:] > 0, run[:-1] + 1, 0)
        row, run = fresh, length
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j, int(run[j]))
    return best


def gapless_best(a: np.ndarray, b: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH) -> int:
    """gapless()'s score by running sums along all diagonals together; a pair whose table has over TABLE cells goes row by row."""
    m, n = len(a), len(b)
    if not m or not n or m * (m + n) > TABLE:
        return gapless(a, b, match, mismatch)[0]
    table = np.zeros((m, m + n), np.int32)
    table[:, :n] = np.where(a[:, None] == b[::-1], match, mismatch)
    sums = table.ravel()[: m * (m + n - 1)].reshape(m, m + n - 1).cumsum(axis=0)  # a column is a diagonal
    return int((sums - np.minimum(np.minimum.accumulate(sums), 0)).max())


def _pairs(function, kind: DataType):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([function(np.asarray(x), np.asarray(y)) for x, y in zip(a, b)])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def gapless_batch(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 20, match: int = MATCH, mismatch: int = MISMATCH) -> np.ndarray:
    """gapless()'s score of many pairs, a row of all pairs' tables at a time; `cells` bounds what is held."""
    out = np.zeros(len(pairs), np.int32)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    start = 0
    while start < len(order):
        width, stop = max(1, len(pairs[order[start]][1])), start + 1
        while stop < len(order) and (stop + 1 - start) * max(1, len(pairs[order[stop]][1])) <= cells and len(pairs[order[stop]][1]) <= 2 * width:
            stop += 1
        some = [pairs[k] for k in order[start:stop]]
        m, n = max(len(a) for a, _ in some), max(len(b) for _, b in some)
        a, b = np.full((len(some), m), -1, np.int32), np.full((len(some), n), -2, np.int32)
        for k, (x, y) in enumerate(some):
            a[k, : len(x)], b[k, : len(y)] = x, y
        row, best = np.zeros((len(some), n + 1), np.int32), np.zeros(len(some), np.int32)
        for i in range(m):
            fresh = np.zeros_like(row)
            np.add(row[:, :-1], np.where(b == a[:, i : i + 1], match, mismatch), out=fresh[:, 1:])
            np.maximum(fresh, 0, out=fresh)
            row = fresh
            np.maximum(best, row.max(axis=1), out=best)
        out[order[start:stop]] = best
        start = stop
    return out


def gapless_score(match: int = MATCH, mismatch: int = MISMATCH):
    """A function of two letter columns: their gapless score, Arrow batch by batch."""

    @F.pandas_udf(IntegerType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(gapless_batch([(np.asarray(x), np.asarray(y)) for x, y in zip(a, b)], match=match, mismatch=mismatch))

    return score


gapless_place = _pairs(lambda x, y: list(gapless(x, y)), ArrayType(IntegerType()))


def gapless_by_diagonals(pairs: DataFrame, match: int = MATCH, mismatch: int = MISMATCH) -> DataFrame:
    """(query_id, target_id, swscore) of pairs(query_id, target_id, a, b) by running sums along each diagonal."""
    cells = pairs.select("query_id", "target_id", "b", F.posexplode("a").alias("i", "x")).select("query_id", "target_id", "i", "x", F.posexplode("b").alias("j", "y"))
    line = Window.partitionBy("query_id", "target_id", F.col("i") - F.col("j")).orderBy("i")
    summed = cells.withColumn("p", F.sum(F.when(F.col("x") == F.col("y"), match).otherwise(mismatch)).over(line))
    gain = F.col("p") - F.least(F.lit(0), F.coalesce(F.min("p").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return summed.withColumn("gain", gain).groupBy("query_id", "target_id").agg(F.greatest(F.lit(0), F.max("gain")).cast("int").alias("swscore"))


def letter_table(a: np.ndarray, b: np.ndarray, matrix: np.ndarray | None = None) -> np.ndarray:
    """Scores of all pairs of two sequences' letters: the matrix's, whose last letter stands for all beyond it, or MATCH and MISMATCH."""
    if matrix is None:
        return np.where(a[:, None] == b[None, :], float(MATCH), float(MISMATCH))
    return matrix[np.ix_(*(np.minimum(x, len(matrix) - 1) for x in (a, b)))]


def profile_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all pairs of two profiles' positions: the products of their class probabilities, added up."""
    return a @ b.T


class LongTable:
    """The score table of a pair that is too long for one: its cells are worked out when they are asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray, score: Score):
        self.a, self.b, self.score, self.shape = a, b, score, (len(a), len(b))

    def __len__(self) -> int:
        return len(self.a)

    def __getitem__(self, at: tuple) -> np.ndarray:
        i, j = (np.asarray(x) for x in at)
        flat = [self.score(self.a[i.flat[k : k + PLACES]], self.b[j.flat[k : k + PLACES]]) for k in range(0, i.size, PLACES)]
        return np.concatenate(flat).reshape(i.shape) if flat else np.zeros(i.shape)


def profile_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of profiles position by position, as profile_table() has them."""
    return np.einsum("ij,ij->i", a, b)


def affine_tables(scores: list[np.ndarray], open_: float, widen: float, local: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best scores h and last steps of alignments with affine gaps (Gotoh) for many score tables at once.

    h[k, i, j] is that of the first i and j places of pair k. Steps are the length of a gap down, the negative one of a gap
    to the right, or 0. The tables are filled by anti-diagonals, whose cells don't depend on each other, over all pairs
    together; smaller ones are padded.
    """
    m, n = max(x.shape[0] for x in scores), max(x.shape[1] for x in scores)
    padded = np.zeros((len(scores), m, n))
    for k, x in enumerate(scores):
        padded[k, : x.shape[0], : x.shape[1]] = x
    h, back = np.zeros((len(scores), m + 1, n + 1)), np.zeros((len(scores), m + 1, n + 1), np.int32)
    # by the row i of a cell on the last anti-diagonal: the best scores that end in a gap, and the gap's length
    down, right = np.full((2, len(scores), m + 1), -np.inf)
    down_n, right_n = np.zeros((2, len(scores), m + 1), np.int32)
    for d in range(2, m + n + 1):
        i = np.arange(max(1, d - n), min(m, d - 1) + 1)
        j = d - i
        opened, longer = h[:, i - 1, j] - open_, down[:, i - 1] - widen
        go = longer > opened
        now_down, now_down_n = np.where(go, longer, opened), np.where(go, down_n[:, i - 1] + 1, 1)
        opened, longer = h[:, i, j - 1] - open_, right[:, i] - widen
        go = longer >= opened
        now_right, now_right_n = np.where(go, longer, opened), np.where(go, right_n[:, i] + 1, 1)
        value, step = h[:, i - 1, j - 1] + padded[:, i - 1, j - 1], np.zeros((len(scores), len(i)), np.int32)
        go = now_down > value
        value, step = np.where(go, now_down, value), np.where(go, now_down_n, step)
        go = now_right > value
        value, step = np.where(go, now_right, value), np.where(go, -now_right_n, step)
        if local:
            step[value < 0] = 0
            value = np.maximum(value, 0.0)
        h[:, i, j], back[:, i, j] = value, step
        down, right = np.full((2, len(scores), m + 1), -np.inf)
        down[:, i], right[:, i], down_n[:, i], right_n[:, i] = now_down, now_right, now_down_n, now_right_n
    return h, back


def traced(h: np.ndarray, back: np.ndarray, local: bool) -> tuple[float, list[tuple[int, int]]]:
    """Score and aligned positions of the best alignment in one pair's tables of affine_tables()."""
    m, n = h.shape[0] - 1, h.shape[1] - 1
    if local:
        i, j = map(int, np.unravel_index(int(h.argmax()), h.shape))
    else:
        i, j = (m, int(h[m].argmax())) if h[m].max() >= h[:, n].max() else (int(h[:, n].argmax()), n)
    total, pairs = float(h[i, j]), []
    while i > 0 and j > 0 and not (local and h[i, j] <= 0):
        step = int(back[i, j])
        if step > 0:
            i -= step
        elif step < 0:
            j += step
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return total, pairs[::-1]


def alignments(scores: list[np.ndarray], open_: float, widen: float, local: bool, cells: int = 1 << 20) -> list[tuple[float, list[tuple[int, int]]]]:
    """Score and aligned positions for many score tables, local or global; `cells` bounds what is held at a time.

    A gap of n letters costs open_ + (n - 1) * widen; end gaps of a global alignment are free.
    """
    out: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])] * len(scores)
    order = sorted((k for k, x in enumerate(scores) if x.size), key=lambda k: scores[k].shape)
    start = 0
    while start < len(order):
        stop, m, n = start, 0, 0
        while stop < len(order):
            a, b = max(m, scores[order[stop]].shape[0]), max(n, scores[order[stop]].shape[1])
            if stop > start and (stop + 1 - start) * a * b > cells:
                break
            stop, m, n = stop + 1, a, b
        some = order[start:stop]
        h, back = affine_tables([scores[k] for k in some], open_, widen, local)
        for row, k in enumerate(some):
            part = slice(scores[k].shape[0] + 1), slice(scores[k].shape[1] + 1)
            out[k] = traced(h[row][part], back[row][part], local)
        start = stop
    return out


def letter_scores(matrix: np.ndarray | None = None) -> Score:
    """Scores of letters one by one, as letter_table() has them."""
    return lambda a, b: np.where(a == b, float(MATCH), float(MISMATCH)) if matrix is None else matrix[np.minimum(a, len(matrix) - 1), np.minimum(b, len(matrix) - 1)]


def paired(pairs: list[tuple[np.ndarray, np.ndarray]], matrix: np.ndarray | None, open_: float, widen: float, local: bool) -> list[tuple[float, list[tuple[int, int]]]]:
    """alignments() of letter sequences by a matrix, or MATCH and MISMATCH; pairs of over TABLE cells without their tables."""
    out: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])] * len(pairs)
    short = []
    for k, (a, b) in enumerate(pairs):
        if len(a) * len(b) > TABLE:
            out[k] = long_alignment(a, b, letter_scores(matrix), open_, widen, local)
        else:
            short.append(k)
    some, cells = [], 0
    for n, k in enumerate(short):
        some.append(k)
        cells += len(pairs[k][0]) * len(pairs[k][1])
        if cells > TABLE or n + 1 == len(short):  # tables of so many cells at a time
            for q, done in zip(some, alignments([letter_table(*pairs[q], matrix) for q in some], open_, widen, local)):
                out[q] = done
            some, cells = [], 0
    return out


def affine(a: np.ndarray, b: np.ndarray, open_: float, widen: float, local: bool, table: np.ndarray | None = None) -> tuple[float, list[tuple[int, int]]]:
    """paired() of one pair of letter sequences; `table` scores pairs of letters, else they score MATCH or MISMATCH."""
    return paired([(a, b)], table, open_, widen, local)[0]


def linear_cells(a: np.ndarray, b: np.ndarray, indel: int = -5) -> tuple[int, list[int]]:
    """Local alignment with a linear gap cost: score and its cells, end to start, 1-based and flat.

    The way back prefers up, then left, then the diagonal.
    """
    if not len(a) or not len(b):
        return 0, []
    h = affine_tables([letter_table(a, b)], -indel, -indel, True)[0][0].astype(np.int64)
    i, j = map(int, np.unravel_index(int(h.argmax()), h.shape))
    best, cells = int(h[i, j]), []
    while h[i, j] > 0:
        cells += [i, j]
        if h[i, j] == h[i - 1, j] + indel:
            i -= 1
        elif h[i, j] == h[i, j - 1] + indel:
            j -= 1
        else:
            i, j = i - 1, j - 1
    return best, cells


def weighted_distance(a: np.ndarray, b: np.ndarray, indel: int = 1, substitution: int | np.ndarray = 1) -> int:
    """Edit distance with given costs; those of substitutions may be a matrix by letters. Equal letters cost nothing."""
    gaps = np.arange(len(b) + 1) * indel
    row = gaps.copy()
    for i, x in enumerate(a, 1):
        dear = substitution if np.isscalar(substitution) else substitution[x, b]
        fresh = np.append(i * indel, np.minimum(row[1:] + indel, row[:-1] + np.where(b == x, 0, dear)))
        row = np.minimum.accumulate(fresh - gaps) + gaps  # gaps to the right, from the best place before
    return int(row[-1])


def _all_pairs(local: bool, open_: float, widen: float):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            done = paired([(np.asarray(x), np.asarray(y)) for x, y in zip(a, b)], None, open_, widen, local)
            yield pd.Series([round(score, 4) for score, _ in done], dtype=float)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())


gapped_local = _all_pairs(True, 8.94, 0.88)
gapped_global = _all_pairs(False, 3.25, 0.8942)
traceback_cells = _pairs(lambda x, y: linear_cells(x, y)[1], ArrayType(IntegerType()))
weighted_edits = _pairs(lambda x, y: weighted_distance(x, y, 2, 3), IntegerType())


def unit_edits(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
