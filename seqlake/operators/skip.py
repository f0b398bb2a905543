"""Exact search that skips: a pattern moved over flat buffers by its bad-letter and good-suffix tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Places that a lane of the search covers, and the greatest letter up to which bad letters are looked up in one table.
LANE, DENSE = 2048, 1 << 16


def suffix_lengths(pattern: np.ndarray) -> list[int]:
    """For each place j the length of the longest common suffix of the pattern up to j and the whole pattern."""
    p = pattern[::-1].tolist()
    n = len(p)
    z, left, right = [n] + [0] * (n - 1), 0, 0  # of the reversed pattern, what each place shares with the beginning
    for k in range(1, n):
        same = min(z[k - left], right - k) if k < right else 0
        while k + same < n and p[same] == p[k + same]:
            same += 1
        z[k] = same
        if k + same > right:
            left, right = k, k + same
    return z[::-1]


def good_shifts(pattern: np.ndarray) -> np.ndarray:
    """For each place i from 0 to the length: the least shift after the letters from i on matched and the one before didn't."""
    n, same = len(pattern), suffix_lengths(pattern)
    shift = np.full(n + 1, n, np.int64)
    for j in range(n - 1):  # a beginning that is an ending: from the shortest, it serves all places that leave it room
        if same[j] == j + 1:
            shift[: n - j] = n - 1 - j
    for j in range(n - 1):  # the same letters further left, with another one before them; the last such place is the nearest
        at = n - same[j]
        shift[at] = min(shift[at], n - 1 - j)
    return shift


class Pattern:
    """A pattern of letters and its tables."""

    def __init__(self, letters: np.ndarray):
        self.letters, self.good = letters, good_shifts(letters)
        self.known, at = np.unique(letters[::-1], return_index=True)
        self.last = len(letters) - 1 - at  # of each of its letters the last place
        self.table = None
        if self.known[0] >= 0 and self.known[-1] < DENSE:
            self.table = np.full(int(self.known[-1]) + 2, -1, np.int64)
            self.table[self.known] = self.last

    def last_of(self, letters: np.ndarray) -> np.ndarray:
        """The last place in the pattern of each letter, -1 for others."""
        if self.table is not None:
            top = len(self.table) - 1
            return self.table[np.where((letters < 0) | (letters > top), top, letters)]
        at = np.minimum(np.searchsorted(self.known, letters), len(self.known) - 1)
        return np.where(self.known[at] == letters, self.last[at], -1)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pattern stands within the parts [start, end) of data, in order, overlapping places too.

        The places of each part are cut into lanes of LANE, all of which move on at once, each by its own shift; letters
        are compared from the pattern's end, in the lanes that still agree.
        """
        m, p = len(self.letters), self.letters
        room = np.maximum(ends - starts - m + 1, 0)
        lanes = -(-room // LANE)
        part = np.repeat(np.arange(len(starts)), lanes)
        at = starts[part] + LANE * (np.arange(len(part)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(at + LANE, starts[part] + room[part])
        found: list[np.ndarray] = []
        while len(at):
            shift = np.empty(len(at), np.int64)
            agreeing = np.arange(len(at))
            for j in range(m - 1, -1, -1):
                letter = data[at[agreeing] + j]
                same = letter == p[j]
                differs = agreeing[~same]
                shift[differs] = np.maximum(self.good[j + 1], j - self.last_of(letter[~same]))
                agreeing = agreeing[same]
                if not len(agreeing):
                    break
            found.append(at[agreeing])
            shift[agreeing] = self.good[0]
            at = at + shift
            going = at < stop
            at, stop = at[going], stop[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters, or the bytes of texts, of a column one after another, and the edges of its rows; null is empty."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
        offsets = column.offsets.to_numpy().astype(np.int64)
        return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_all(rows: DataFrame, column: str, pattern: str | Sequence[int], *keep: str) -> DataFrame:
    """(keep..., pos): every place from 0 at which a pattern stands in a column of texts or letter arrays.

    Overlapping places count; those of texts are in characters, though bytes are searched, for UTF-8 cannot be
    mistaken; characters are counted once a batch, and only where one isn't ASCII. An empty pattern stands nowhere, nor
    does any in null. Whole texts are searched where they lie, in time that falls with the pattern's length.
    """
    letters = np.frombuffer(pattern.encode(), np.uint8) if isinstance(pattern, str) else np.array(pattern, np.int64)
    text = isinstance(pattern, str)
    kept = rows.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "pos int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Pattern(letters) if len(letters) else None
        for batch in batches:
            data, edges = flattened(batch.column(column))
            at = search.places(data, edges[:-1], edges[1:]) if search is not None else np.zeros(0, np.int64)
            row = np.searchsorted(edges, at, side="right") - 1
            first = edges[row]
            if text and len(at) and (data > 127).any():
                begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                at, first = begun[at], begun[first]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keep), pa.array((at - first).astype(np.int32))], names=[*keep, "pos"])

    return rows.select(*keep, *([] if column in keep else [column])).mapInArrow(run, schema)
