"""Skip search against plain search."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.functions.text import good_suffix
from seqlake.operators import skip


def all_places(text, pattern):
    return [k for k in range(len(text) - len(pattern) + 1) if text[k : k + len(pattern)] == pattern] if len(pattern) else []


@pytest.mark.parametrize("lane", [2048, 1, 7])
def test_places(monkeypatch, lane):
    monkeypatch.setattr(skip, "LANE", lane)
    r = random.Random(lane)
    for n in range(200):
        letters = r.choice([[1, 2], [1, 2, 3], [-5, 2, 2**40], list(range(30))])
        parts = [[r.choice(letters) for _ in range(r.choice([0, 1, 5, 60]))] for _ in range(4)]
        pattern = [r.choice(letters) for _ in range(r.randint(1, 6))]
        edges = np.cumsum([0, *map(len, parts)])
        got = skip.Pattern(np.array(pattern)).places(np.array(sum(parts, []), np.int64), edges[:-1], edges[1:])
        assert got.tolist() == [int(e) + k for e, part in zip(edges, parts) for k in all_places(part, pattern)], (parts, pattern)


def test_shifts_equal_their_definition(spark):
    r = random.Random(1)
    patterns = ["a", "aa", "ab", "anan", "abcabc"] + ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(40)]
    rows = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", good_suffix(F.col("p")).alias("s")).collect()
    for p, s in rows:
        assert skip.good_shifts(np.frombuffer(p.encode(), np.uint8)).tolist() == s, p


def test_it_skips():
    """Letters that the pattern lacks are passed at its length: few are looked at."""
    looked = 0

    class Watched(np.ndarray):
        def __getitem__(self, key):
            nonlocal looked
            looked += np.size(key)
            return np.asarray(self)[key]

    data = np.zeros(1_000_000, np.int64).view(Watched)
    assert len(skip.Pattern(np.arange(1, 101)).places(data, np.array([0]), np.array([len(data)]))) == 0
    assert looked < 30_000


def test_texts_and_letters(spark):
    texts = [None, "", "ana", "ananana", "ña🙂ananñana", "x" * 5000 + "ana", "an"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("pos", F.lit("clash")).repartition(2)
    want = Counter((k, p) for k, t in enumerate(texts) for p in all_places(t or "", "ana"))
    assert Counter(map(tuple, skip.find_all(rows, "text", "ana", "id").collect())) == want
    assert skip.find_all(rows, "text", "", "id").count() == 0
    assert Counter(map(tuple, skip.find_all(rows, "text", "🙂a", "id").collect())) == {(4, 2): 1}
    assert [tuple(x) for x in skip.find_all(rows.filter("id = 2"), "text", "na", "id", "text").collect()] == [(2, "ana", 1)]
    letters = spark.createDataFrame([(1, [2, 2, 2]), (2, []), (3, None), (4, [2, 1, 2, 2])], "id long, letters array<int>")
    assert Counter(map(tuple, skip.find_all(letters, "letters", [2, 2], "id").collect())) == {(1, 0): 1, (1, 1): 1, (4, 2): 1}
