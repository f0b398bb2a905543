"""The data source, ranks with ties and root finding."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.functions.roots import bracketed_roots
from seqlake.operators.ties import close_ranks
from seqlake.sources import records


@pytest.fixture(scope="module")
def rows(spark):
    records.register(spark)
    data = [(k, f"/db/s{k:03d}.seq", f"döme {k}" if k % 2 else None, "t", [k, 70_000] * (k % 5), [0, k] * (k % 5)) for k in range(40)]
    return spark.createDataFrame(data, "seq_id long, url string, description string, alphabet string, letters array<int>, info array<int>")


def test_records_are_a_data_source(spark, rows, tmp_path):
    path = str(tmp_path / "seqs")
    rows.repartition(3).write.format("seq").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "seqs").iterdir()) == [f"s{k:03d}.seq" for k in range(40)]
    read = spark.read.format("seq").option("split", 8 * records.OPENING).load(path)
    assert read.rdd.getNumPartitions() == 5  # eight files each
    got = {r.seq_id: r for r in read.collect()}
    assert sorted(got) == list(range(40))
    for r in rows.collect():
        x = got[r.seq_id]
        assert (x.url, x.description, x.alphabet, x.letters, x.info, x.length) == (r.url, r.description or "", r.alphabet, r.letters, r.info, len(r.letters))
    heads = spark.read.format("seq").schema("length int, url string").load(path)
    assert Counter(map(tuple, heads.collect())) == Counter((len(r.letters), r.url) for r in rows.collect())
    assert spark.read.format("seq").load(f"{path}/s003.seq").first().letters == [3, 70_000] * 3
    rows.limit(2).write.format("seq").mode("overwrite").save(path)
    assert spark.read.format("seq").load(path).count() == 2


def test_a_failed_write_leaves_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "seqs")
    rows.filter("seq_id < 3").write.format("seq").mode("append").save(path)
    before = sorted(p.name for p in (tmp_path / "seqs").iterdir())
    broken = rows.filter("seq_id > 5").withColumn("letters", F.when(F.col("seq_id") < 30, F.col("letters"))).repartition(4)
    with pytest.raises(Exception, match="letters"):
        broken.write.format("seq").mode("append").save(path)
    with pytest.raises(Exception, match="one name"):
        rows.filter("seq_id = 1").write.format("seq").mode("append").save(path)
    assert sorted(p.name for p in (tmp_path / "seqs").iterdir()) == before
    with pytest.raises(Exception, match="no colour"):
        spark.read.format("seq").schema("colour string").load(path).collect()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("seq").load(str(tmp_path / "nowhere")).collect()


def ranks_by_hand(values, epsilon):
    chain, rank, out, last = -1, 0, [], None
    for n, v in enumerate(sorted(values)):
        if last is None or v - last > epsilon:
            chain, rank = chain + 1, n + 1
        out.append((v, chain, rank))
        last = v
    return out


@pytest.mark.parametrize("epsilon", [0.0, 0.4, 100.0])
def test_close_ranks(spark, epsilon):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), round(r.uniform(0, 60), 1) if r.random() < 0.95 else None, r.randint(0, 1)) for _ in range(400)] + [("c", 1.0, 0)] * 3
    frame = spark.createDataFrame(data, "g string, v double, part int").repartition(5)
    got = Counter((x.g, x.v, x.chain, x.rank) for x in close_ranks(frame, "v", epsilon, "g").collect())
    want = Counter((g, v, None, None) for g, v, _ in data if v is None)
    for g in ("a", "b", "c", None):
        want.update((g, *x) for x in ranks_by_hand([v for h, v, _ in data if h == g and v is not None], epsilon))
    assert got == want
    whole = Counter((x.v, x.chain, x.rank) for x in close_ranks(frame, "v", epsilon).filter("v is not null").collect())
    assert whole == Counter(ranks_by_hand([v for _, v, _ in data if v is not None], epsilon))
    assert close_ranks(frame.limit(0), "v", epsilon, "g").count() == 0


def test_roots():
    powers = np.array([1.0, 2.0, 3.0, 5.0, 9.0])
    found, asked = bracketed_roots(lambda k, x: x ** powers[k] - 2, np.zeros(5), np.full(5, 3.0))
    assert np.allclose(found, 2 ** (1 / powers), atol=1e-11, rtol=0) and asked < 30
    shifts = np.linspace(-0.9, 0.9, 200)
    found, asked = bracketed_roots(lambda k, x: np.arctan(20 * (x - shifts[k])), np.full(200, -1.0), np.full(200, 1.0))
    assert np.allclose(found, shifts, atol=1e-10, rtol=0) and asked < 40
    found, _ = bracketed_roots(lambda k, x: x * x + 1, np.array([-1.0]), np.array([1.0]))
    assert math.isnan(found[0])
    found, _ = bracketed_roots(lambda k, x: x - np.array([0.0, 1.0])[k], np.zeros(2), np.ones(2))
    assert found.tolist() == [0.0, 1.0]  # ends that are roots
    assert bracketed_roots(lambda k, x: x, np.zeros(0), np.zeros(0))[0].tolist() == []


def test_slots(spark):
    from seqlake.plans.slots import EMIT, SKIP, STOP, accumulated, handled

    class Sum:
        def __init__(self):
            self.total, self.seen = 0, []

        def add(self, row):
            self.total += row["i"]
            self.seen.append(row["i"])

        def results(self):
            if self.total:
                yield self.total, self.seen == sorted(self.seen)
                yield -self.total, True

    r = random.Random(2)
    hits = [(r.randint(0, 3), r.randint(0, 3), r.randint(0, 5)) for _ in range(200)] + [(9, 9, 0)]
    frame = spark.createDataFrame(hits, "query_id long, target_id int, i int").repartition(4)
    sums = Counter()
    for q, t, i in hits:
        sums[q, t] += i
    want = {(q, t, s, True) for (q, t), s in sums.items() if s} | {(q, t, -s, True) for (q, t), s in sums.items() if s}
    assert set(map(tuple, accumulated(frame, Sum, "total int, ordered boolean", "i").collect())) == want
    assert accumulated(frame.limit(0), Sum, "total int, ordered boolean").count() == 0
    ranked = spark.createDataFrame([(q, n, "x" * n) for q in range(3) for n in range(1, 30)], "query_id long, rank int, text string").repartition(5)
    out = handled(ranked, lambda row: STOP if row["rank"] > 7 + row["query_id"] else SKIP if row["rank"] % 2 else EMIT)
    assert set(map(tuple, out.collect())) == {(q, n, "x" * n) for q in range(3) for n in range(1, 8 + q) if n % 2 == 0}
    with pytest.raises(Exception, match="perhaps"):
        handled(ranked, lambda row: "perhaps").collect()
