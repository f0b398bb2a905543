"""Pattern ranges through fences and common prefixes from ranks against sorting by hand."""

import random
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators import fences, suffixes


def frame(spark, sequences):
    return spark.createDataFrame(list(enumerate(sequences)), "seq_id long, letters array<int>").repartition(3)


def in_order(sequences):
    return sorted((s[p:], k, p) for k, s in enumerate(sequences) for p in range(len(s)))


def ranges_by_hand(sequences, patterns):
    keys = [x[0] for x in in_order(sequences)]
    out = {}
    for p in patterns:
        a, b = bisect_left(keys, p), bisect_right(keys, p, key=lambda s: s[: len(p)]) - 1
        out[tuple(p)] = (a, b) if a <= b else (1, 0)
    return out


@pytest.mark.parametrize("fence,depth,crowd", [(64, 32, 100_000), (2, 2, 1), (5, 1, 3)])
def test_pattern_ranges(spark, monkeypatch, fence, depth, crowd):
    for name, value in (("FENCE", fence), ("DEPTH", depth), ("CROWD", crowd)):
        monkeypatch.setattr(fences, name, value)
    r = random.Random(fence)
    sequences = [[r.randint(1, 2) for _ in range(r.choice([0, 1, 9, 40]))] for _ in range(10)] + [[1] * 90, [2, 1] * 30]
    cut = lambda s: s[(p := r.randrange(len(s))) : p + r.randint(1, 70)]
    patterns = [[], [1], [2], [3], [0], [1] * 89, [1] * 91, [1, 2, 2**31 - 1]] + [cut(r.choice([s for s in sequences if s])) for _ in range(40)]
    patterns += [p + [r.randint(0, 3)] for p in patterns[8:20]]
    given = spark.createDataFrame([(p,) for p in patterns] + [(None,), ([1],)], "pattern array<int>")
    got = Counter((None if p is None else tuple(p), a, b) for p, a, b in fences.pattern_ranges(frame(spark, sequences), given).collect())
    want = ranges_by_hand(sequences, patterns)
    assert got == Counter([(tuple(p), *want[tuple(p)]) for p in [*patterns, [1]]] + [(None, 1, 0)])


def test_a_long_pattern_over_fences(spark):
    r = random.Random(3)
    repeat = [r.randint(1, 4) for _ in range(5000)]
    sequences = [repeat + [1, 1], repeat + [2], [3, 3] + repeat, [r.randint(1, 4) for _ in range(900)]]
    patterns = [repeat, repeat + [1], repeat[:-1] + [9], repeat[2500:], repeat[4000:] + [2]]
    got = {tuple(p): (a, b) for p, a, b in fences.pattern_ranges(frame(spark, sequences), spark.createDataFrame([(p,) for p in patterns], "pattern array<int>")).collect()}
    assert got == ranges_by_hand(sequences, patterns)


def test_no_suffixes_and_no_patterns(spark):
    some = spark.createDataFrame([([1],)], "pattern array<int>")
    assert [tuple(x)[1:] for x in fences.pattern_ranges(frame(spark, [[]]), some).collect()] == [(1, 0)]
    assert fences.pattern_ranges(frame(spark, [[1]]), some.limit(0)).count() == 0


def test_binary_search_skips_what_both_ends_share():
    r = random.Random(4)
    heads = sorted([r.randint(1, 2) for _ in range(r.randint(0, 12))] for _ in range(60))
    for _ in range(300):
        key = [r.randint(0, 3) for _ in range(r.randint(0, 13))]
        assert fences.before([np.array(h, np.int32) for h in heads], np.array(key, np.int32)) == bisect_left(heads, key)


def test_compared(spark):
    rows = spark.createDataFrame([([1, 2], [1, 2, 3]), ([1, 2], [1]), ([1, 2], [1, 3]), ([1, 2], [1, 1, 9]), ([], []), ([1], [])], "p array<int>, s array<int>")
    assert [tuple(x.c) for x in rows.select(fences.compared(F.col("p"), F.col("s")).alias("c")).collect()] == [(2, 0), (1, 1), (1, -1), (1, 1), (0, 0), (0, 1)]


@pytest.mark.parametrize("whole,first", [(256, 32), (4, 2), (4, 3)])
def test_common_prefixes(spark, monkeypatch, whole, first):
    monkeypatch.setattr(suffixes, "WHOLE", whole)
    monkeypatch.setattr(suffixes, "FIRST", first)
    r = random.Random(5)
    block = [r.randint(1, 3) for _ in range(90)]
    sequences = [block, block[10:] + [2], [1] * 30, [], block, [r.randint(1, 2) for _ in range(25)], [3]]
    order = in_order(sequences)
    want = Counter()
    for rank, (suffix, k, p) in enumerate(order):
        last = order[rank - 1][0] if rank else []
        want[k, p, rank, next((n for n, (x, y) in enumerate(zip(suffix, last)) if x != y), min(len(suffix), len(last)))] += 1
    assert Counter(map(tuple, suffixes.neighbour_prefixes(frame(spark, sequences)).collect())) == want


@pytest.mark.parametrize("cell", [1 << 16, 3])
def test_last_before_carries_over_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(suffixes, "CELL", cell)
    r = random.Random(8)
    keys = sorted(r.sample(range(-50, 2000), 40))
    asked = [r.randint(-100, 2100) for _ in range(200)]
    got = suffixes.last_before(spark.createDataFrame([(k, f"k{k}") for k in keys], "v long, name string"), spark.createDataFrame([(a,) for a in asked], "v long"), "name")
    want = Counter((a, next((f"k{k}" for k in reversed(keys) if k <= a), None)) for a in asked)
    assert Counter(map(tuple, got.collect())) == want
