"""Properties and hand-worked cases of the search library."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake import progress
from seqlake.config import SearchConfig, from_arguments
from seqlake.functions import codes, numbers, text
from seqlake.operators import align, stats, structure, suffixes
from seqlake.operators.rank import select
from seqlake.operators.seeds import array_windows, seed_hits
from seqlake.plans.search import COLUMNS, HEADER_LINE, aligned, report, search, write_results
from seqlake.sources import files


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def sequences(spark):
    r = random.Random(3)
    rows = [(i, [r.randint(1, 4) for _ in range(r.randint(0, 60))]) for i in range(25)]
    return spark.createDataFrame(rows, "seq_id long, letters array<int>"), dict(rows)


def test_occurrences_overlap(spark):
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit("aa")))[0] == [0, 1, 2]
    assert one(spark, text.occurrences(F.lit("a"), F.lit("aa")))[0] == []


def test_windows_leave_the_last_out(spark):
    for n, want in ((3, 0), (4, 1), (5, 2)):
        df = spark.createDataFrame([(0, list(range(n)))], "seq_id long, letters array<int>")
        assert array_windows(df, 3, drop_last=True).count() == want


def test_seed_hits_equal_brute_force(sequences):
    df, rows = sequences
    found = {tuple(r) for r in seed_hits(df, df, 4, 30).collect()}
    windows = [(t, j, tuple(s[j : j + 4])) for t, s in rows.items() for j in range(len(s) - 3)]
    count = {}
    for *_, w in windows:
        count[w] = count.get(w, 0) + 1
    want = {(q, t, i, j) for q, s in rows.items() for i in range(len(s) - 4) for t, j, w in windows if w == tuple(s[i : i + 4]) and count[w] <= 30}
    assert found == want


def test_text_seeds_equal_brute_force(spark):
    texts = [(0, "abcabcabx"), (1, None), (2, "xabcab"), (3, "naïve naïve")]
    df = spark.createDataFrame(texts, "seq_id long, text string")
    want = {(q, t, i, j) for q, a in texts for t, b in texts if a and b for i in range(len(a) - 3) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]}
    assert {tuple(r) for r in seed_hits(df, df, 3, 100).collect()} == want


def test_gapless_scores_agree(spark):
    r = np.random.default_rng(0)
    pairs = [(r.integers(1, 5, r.integers(1, 40)), r.integers(1, 5, r.integers(1, 40))) for _ in range(60)]
    want = [align.gapless(a, b)[0] for a, b in pairs]
    assert align.gapless_batch(pairs, 300).tolist() == want
    df = spark.createDataFrame([(k, k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(pairs)], "query_id int, target_id int, a array<int>, b array<int>")
    assert {x["query_id"]: x["swscore"] for x in align.gapless_by_diagonals(df).collect()} == dict(enumerate(want))
    for (a, b), score in zip(pairs, want):
        assert align.affine(a, b, 5.0, 1.0, True)[0] >= score
        assert align.gapless(a, a)[0] == 3 * len(a)


def test_search_ranks_self_first_and_thresholds_are_safe(sequences):
    df, rows = sequences
    config = SearchConfig(minimal_length=4, minimal_seed=3, maximal_match=10_000)
    found = search(df, df, config, 4).collect()
    assert found and all(r["target_id"] == r["query_id"] for r in found if r["rank"] == 1)
    assert all(r["n_seeds"] > 3 for r in found)
    for how in ("score", "blast", "score_sw", "blast_sw"):
        other = search(df, df, SearchConfig(minimal_length=4, minimal_seed=3, maximal_match=10_000, select=how), 4).collect()
        assert {(r["query_id"], r["target_id"]) for r in other} == {(r["query_id"], r["target_id"]) for r in found}


def test_hit_limit(sequences):
    df, _ = sequences
    found = search(df, df, SearchConfig(minimal_length=2, minimal_seed=1, maximal_match=10_000, maximal_hits=2))
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] == 3


def test_report_has_21_columns(sequences):
    df, _ = sequences
    config = SearchConfig(kind="sequence", minimal_length=4, minimal_seed=3, maximal_match=10_000)
    rows = report(search(df, df, config), df, df, config)
    assert tuple(rows.columns) == COLUMNS and len(COLUMNS) == 21
    own = rows.filter("`sequence a` = `sequence b`").collect()
    assert own and all(r["salami_id"] == 1.0 and r["salami_sw_cvr"] == 1.0 for r in own)


def test_affine_and_distance():
    a = np.array([1, 2, 3, 4, 5, 6])
    assert align.affine(a, a, 3.25, 0.9, False)[0] == 18
    score, pairs = align.affine(a, np.array([1, 2, 3, 9, 9, 4, 5, 6]), 3.25, 0.9, True)
    assert score == pytest.approx(18 - 3.25 - 0.9) and len(pairs) == 6
    assert align.weighted_distance(a, a[1:], 2, 3) == 2 and align.weighted_distance(a, a + 10, 2, 3) == 18
    assert align.linear_cells(a, a) == (18, [x for k in range(6, 0, -1) for x in (k, k)])


def test_cantor(spark):
    values = [one(spark, codes.pair(F.lit(i), F.lit(i)))[0] for i in (1, 2, 3)]
    assert values == [4, 12, 24]
    ids = spark.range(3000).withColumn("p", codes.unpair(F.col("id")))
    assert ids.filter(codes.pair(F.col("p.i"), F.col("p.j")) != F.col("id")).count() == 0
    assert one(spark, codes.fold(F.array(F.lit(7))))[0] == 7


def test_structure_closed_forms():
    a = np.random.default_rng(1).normal(size=(30, 3))
    turn = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    b = a @ turn + 5
    assert structure.rmsd(a, b) == pytest.approx(0, abs=1e-9) and structure.tm_score(a, b) == pytest.approx(1)
    assert structure.within_distance(a, b) == 1 and structure.within_distance(a[:5], b[:5]) == 0
    assert structure.alternative_z(3.0, np.ones((3, 3)), [(0, 0)]) == 0


def test_decay_root():
    p, q = np.array([0.5, 0.3, 0.2]), np.array([0.2, 0.3, 0.5])
    s = 10 * np.log(q / p)
    root = stats.decay(p, s)
    assert root == pytest.approx(0.1, abs=1e-6) and (p * np.exp(root * s)).sum() == pytest.approx(1)
    assert 0 < stats.prefactor(p, s, root) < 1
    assert stats.decay(p, np.abs(s)) == 0


def test_numbers(spark):
    row = one(spark, numbers.gcd(F.lit(84), F.lit(-36)), numbers.power(F.lit(0.0), F.lit(-1)), numbers.next_permutation(F.array(F.lit(1), F.lit(3), F.lit(2))), numbers.determinant(F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4)))))
    assert row[0] == 12 and row[1] == 1e200 and row[2] == [2, 1, 3] and row[3] == pytest.approx(-2)



def test_hashes_by_hand(spark):
    """The two hashes of bytes with 64 bits that wrap, worked out one operation after another."""
    wrap = 2**64

    def turned(key):
        h = len(key)
        for x in key:
            h = (h * 2**5 % wrap) ^ (h // 2**27) ^ x
        return h

    def one_at_a_time(key):
        h = 0
        for x in key:
            h = (h + x) % wrap
            h = (h + h * 2**10) % wrap
            h ^= h // 2**6
        h = (h + h * 2**3) % wrap
        h ^= h // 2**11
        return (h + h * 2**15) % wrap

    assert turned([3]) == (1 << 5) ^ 3 and turned([]) == 0
    r = random.Random(2)
    for n in (0, 1, 2, 9, 60):
        key = [r.randint(0, 255) for _ in range(n)]
        column = F.lit(key) if key else F.array().cast("array<int>")
        found = one(spark, numbers.shift_xor_hash(column), numbers.one_at_a_time_hash(column))
        assert [x % wrap for x in found] == [turned(key), one_at_a_time(key)]


def test_large_pairs(spark):
    for i, j in ((200000001, 200000003), (2 * 10**9, 10**9), (0, 3 * 10**9), (3 * 10**9, 0)):
        code = (i + j) * (i + j + 1) // 2 + j
        assert one(spark, codes.pair(F.lit(i), F.lit(j)))[0] == code
        assert tuple(one(spark, codes.unpair(F.lit(code)))[0]) == (i, j)
    values = [5, 0, 9, 2]
    assert one(spark, codes.unfold(codes.fold(F.lit(values)), 4))[0] == values and one(spark, codes.unfold(F.lit(8), 1))[0] == [8]


def test_two_phases_keep_all_targets(spark):
    """1,500 targets: the first phase gives 1,000 of them a gapless score, all are ranked and reported."""
    letters = [1, 2, 3, 1, 2]
    database = spark.createDataFrame([(t, letters) for t in range(1500)], "seq_id long, letters array<int>")
    queries = spark.createDataFrame([(0, letters)], "seq_id long, letters array<int>")
    hits = spark.createDataFrame([(0, t, 1 + t % 3, float(t), float(-t)) for t in range(1500)], "query_id long, target_id long, n_seeds int, score double, blast double")
    for how, first in (("score_sw", range(500, 1500)), ("blast_sw", range(1000))):
        found = select(hits, queries, database, how, 1, 10_000).collect()
        assert {r["target_id"] for r in found} == {t for t in range(1500) if t % 3}
        assert {r["target_id"] for r in found if r["swscore"] == 15} == {t for t in first if t % 3}
        assert {r["swscore"] for r in found} == {0, 15}
        by_rank = [(-r["swscore"], -r["n_seeds"], r["target_id"]) for r in sorted(found, key=lambda r: r["rank"])]
        assert by_rank == sorted(by_rank)


@pytest.mark.parametrize("whole", [256, 0])
def test_suffix_order_equals_sorting(spark, monkeypatch, whole):
    """All suffixes sorted at once, and by prefix doubling."""
    monkeypatch.setattr(suffixes, "WHOLE", whole)
    r = random.Random(1)
    rows = [(i, [r.randint(1, 2) for _ in range(r.randint(0, 70))]) for i in range(12)] + [(20, [1] * 60), (21, [1] * 60)]
    df = spark.createDataFrame(rows, "seq_id long, letters array<int>")
    order = sorted((s[p:], i, p) for i, s in rows for p in range(len(s)))
    ranks, _ = suffixes.suffix_ranks(df)
    assert {(x["seq_id"], x["pos"]): x["rank"] for x in ranks.collect()} == {(i, p): k for k, (_, i, p) in enumerate(order)}
    shared = {}
    for k, (s, i, p) in enumerate(order):
        before = order[k - 1][0] if k else []
        shared[i, p] = next((n for n, (x, y) in enumerate(zip(s, before)) if x != y), min(len(s), len(before)))
    assert {(x["seq_id"], x["pos"]): x["lcp"] for x in suffixes.neighbour_prefixes(df).collect()} == shared


def test_good_suffix_shifts_lose_no_occurrence(spark):
    """Searching with the shifts alone finds every occurrence, for all short patterns of two letters."""
    from itertools import product

    patterns = ["".join(p) for n in range(1, 6) for p in product("ab", repeat=n)]
    rows = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", text.good_suffix(F.col("p")).alias("s")).collect()
    where = "".join(random.Random(4).choice("ab") for _ in range(200))
    for p, shifts in rows:
        at, found = 0, []
        while at <= len(where) - len(p):
            j = len(p)
            while j and where[at + j - 1] == p[j - 1]:
                j -= 1
            if not j:
                found.append(at)
            at += shifts[j]
        assert found == [k for k in range(len(where)) if where.startswith(p, k)]
    assert dict(rows)["abab"] == [2, 2, 2, 4, 1]


def test_printing():
    assert text.printed_alignment([1, 22, 3], [3, 22], [3, 1], 9) == "    0\t  1 22\n    1\t  -  -\n\n    2\t  3\n    1\t  3\n"
    assert progress.bar("x", 10, 5, 4) == "x ##.. 50% (5 of 10)" and progress.bar("x", 0, 0, 2) == "x ## 100% (0 of 0)" and progress.bar("x", 4, 9, 2) == "x ## 100% (9 of 4)"


def test_required(spark):
    rows = spark.range(5)
    assert progress.required(rows, F.col("id") < 5, "no").count() == 5
    with pytest.raises(Exception, match="too large"):
        progress.required(rows, F.col("id") < 4, "too large").collect()


def test_alignment_report_by_hand(spark):
    """One pair of each kind of search, whose blocks are small enough to work out."""
    matrix = np.full((128, 128), -4.0)
    np.fill_diagonal(matrix, 5.0)
    a, b = [1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 9, 9, 5, 6, 7, 8]
    schema = "seq_id long, letters array<int>, probs array<array<double>>, xyz array<struct<x:double,y:double,z:double>>"
    r = np.random.default_rng(1)
    point = {k: r.normal(size=3) * 9 for k in range(1, 10)}
    rows = lambda s: [(0, s, [[float(k == x) for k in range(10)] for x in s], [tuple(point[x] for x in s)[n].tolist() for n in range(len(s))])]
    target, query = spark.createDataFrame(rows(a), schema), spark.createDataFrame(rows(b), schema)
    hits = spark.createDataFrame([(0, 0)], "query_id long, target_id long")
    al = aligned(hits, query, target, "sequence", matrix).first()["al"]
    assert (al["identity"], al["sw_length"], al["sw_raw"], al["cvr"]) == (1.0, 8, 8, 1.0)
    assert al["sw_score"] == al["nw_score"] == pytest.approx(40 - 8.94 - 0.88) and al["sw_smpl"] == 40
    from itertools import combinations

    others = [sum(matrix[x, b[j]] for x, j in zip(a, columns)) for columns in combinations(range(10), 8)]  # all paths of eight cells
    assert al["sw_tot"] == pytest.approx(40 - 3.25 - 0.8942) and al["z"] == pytest.approx((al["sw_tot"] - np.mean(others)) / np.std(others), rel=0.1)
    al = aligned(hits, query, target, "structure").first()["al"]
    # a gap costs more than four products of one: globally the later half is aligned without any, locally not at all
    assert (al["identity"], al["nw_length"], al["nw_score"], al["sw_length"], al["sw_score"], al["cvr"]) == (0.5, 8, 4.0, 4, 4.0, 0.5)
    assert al["rmsd"] == pytest.approx(0, abs=1e-6) and al["dme"] == 0.0 and 0 < al["tm"] <= 0.4 + 1e-9


def test_matrix_file(spark, tmp_path):
    (tmp_path / "m.mat").write_text("# scores\n   A  R  *\nA  4 -1 -4\nR -1  5 -4\n* -4 -4  1\n")
    m = files.read_matrix(spark, str(tmp_path / "m.mat"))
    assert m[ord("A"), ord("R")] == -1 and m[ord("r"), ord("R")] == 5 and m[ord("Z"), ord("A")] == -4 and m[ord("Z"), ord("?")] == 1
    assert align.letter_table(np.array([65, 8364]), np.array([65, 70_000]), m).tolist() == [[4, -4], [-4, 1]]
    assert align.letter_scores(m)(np.array([8364, 65]), np.array([70_000, 65])).tolist() == [1, 4]


def test_result_lines(sequences, tmp_path):
    df, _ = sequences
    config = SearchConfig(minimal_length=4, minimal_seed=3, maximal_match=10_000)
    rows = report(search(df, df, config), df, df, config, ranked=True)
    write_results(rows, str(tmp_path / "out"))
    lines = [x for part in sorted((tmp_path / "out").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines[0] == HEADER_LINE and lines[0].startswith("CSV;picture;sequence a;") and len(lines) > 1
    assert all(x.startswith("CSV;[") and x.split(";")[1].endswith("]") and len(x.split(";")) == 22 for x in lines[1:])
    assert [x.split(";")[2:4] for x in lines[1:]] == [list(x) for x in rows.orderBy("query_id", "rank").select("sequence a", "sequence b").collect()]


def test_random_paths_are_alike_likely():
    from itertools import combinations

    import numpy as np

    from seqlake.operators.structure import alternative_z, random_paths

    rng = np.random.default_rng(1)
    i, j = random_paths(4, 5, 2, 60_000, rng)
    assert (np.diff(i, axis=1) > 0).all() and (np.diff(j, axis=1) > 0).all()
    met = Counter(map(tuple, np.hstack([i, j]).tolist()))
    assert set(met) == {(*a, *b) for a in combinations(range(4), 2) for b in combinations(range(5), 2)}
    assert sum((n - 1000) ** 2 / 1000 for n in met.values()) < 100  # 59 degrees of freedom
    whole = random_paths(3, 3, 3, 5, rng)
    assert (whole[0] == [0, 1, 2]).all() and (whole[1] == [0, 1, 2]).all()
    table = rng.normal(size=(30, 40))
    pairs = [(k, k + 3) for k in range(20)]
    every = [table[list(a), list(b)].sum() for a in combinations(range(4), 3) for b in combinations(range(4), 3)]
    z = alternative_z(2.0, table[:4, :4], pairs[:3], rounds=40_000)
    assert abs(z - (2.0 - np.mean(every)) / np.std(every)) < 0.05
    assert alternative_z(1.0, table, []) == 0.0 and alternative_z(1.0, table[:2, :2], pairs[:2]) == 0.0
    assert alternative_z(1.0, table, pairs, seed=3) == alternative_z(1.0, table, pairs, seed=3)


def test_records_round_trip(spark, tmp_path):
    row = {"seq_id": 0, "url": "/a/1abcA", "description": "döme", "alphabet": "t", "letters": [1, 2, 70000], "info": [0, 5, 6]}
    df = spark.createDataFrame([row], "seq_id long, url string, description string, alphabet string, letters array<int>, info array<int>")
    data = bytes(files.records(df).first()["record"])
    (tmp_path / "a.seq").write_bytes(data)
    back = files.read_records(spark, str(tmp_path)).drop("path").first().asDict()
    assert back == row | {"length": 3}


def test_files(spark, tmp_path):
    (tmp_path / "list").write_text("/x/1abcA.seq\n\n/x/2defB.seq\n")
    assert files.read_list(spark, str(tmp_path / "list")).count() == 2
    (tmp_path / "abc.csv").write_text('character,mapdomain\n"2",12\n1,4\n')
    assert [tuple(r) for r in files.read_alphabet(spark, str(tmp_path / "abc.csv")).collect()] == [(1, 4), (2, 12)]
    (tmp_path / "res").write_text("noise\nCSV;picture;a;b;tm_score\nCSV;--;/q/x;/q/y;0.5\n")
    assert [tuple(r) for r in files.edges_of_results(str(tmp_path / "res"), spark).collect()] == [("x", "y", 0.5)]
    atoms = spark.createDataFrame([(k, f"ATOM  {k:5d}  CA  {r} A{k:4d}") for k, r in enumerate(["GLY", "ALA", "TRP"])], "n int, value string")
    assert files.chains_of_coordinates(atoms, "p").first()["fasta"] == ">p | chain A | 3 aa\nGAW"


def test_options(tmp_path):
    assert SearchConfig().kind == "structure"
    (tmp_path / "c.cnf").write_text("[limits]\nminimal_length = 15\n[result]\noutput = /o.csv\n[sources]\nalphabet = x.csv\n")
    config = from_arguments(["-c", str(tmp_path / "c.cnf"), "-S", "-M", "4", "--maxresults", "7", "-q", "q.seq", "--percent", "2.5"])
    assert (config.kind, config.minimal_length, config.select, config.match, config.mismatch, config.maximal_hits, config.percent) == ("structure", 15, "score", 4, -2, 7, 2.5)
    assert config.report == "/o.csv" and config.sources == {"alphabet": "x.csv", "query": "q.seq"} and from_arguments([]).select == "sw"


def test_config(tmp_path):
    (tmp_path / "c.cnf").write_text("[common]\ntype = salami\n[limits]\nminimal_length = 15\n[sources]\nalphabet = x.csv\n")
    config = from_arguments(["-c", str(tmp_path / "c.cnf")])
    assert (config.kind, config.minimal_length, config.minimal_seed, config.maximal_match, config.maximal_hits) == ("structure", 15, 4, 50, 10_000)


def test_stream(spark, sequences, tmp_path):
    from seqlake.streaming.search import search_stream

    df, _ = sequences
    df.write.parquet(str(tmp_path / "in"))
    config = SearchConfig(minimal_length=4, minimal_seed=3, maximal_match=10_000)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    search_stream(stream, df, config, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == search(df, df, config).count()


def test_entry_and_queries(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_six_decimals_are_those_of_c(spark):
    """Halves go to the even digit, by the exact value of a float."""
    values = [k / 128 for k in range(-9, 10)] + [0.1, -0.1, -1e-9, 1e-7, 16777216.5, 3e9, 123456789.0, 8e9, 5e10, -2.0**62, 2.0**-20, 0.9999996, float("inf"), float("-inf"), float("nan"), -0.0]
    values = [float(np.float32(x)) for x in values] + np.random.default_rng(1).normal(size=500).astype(np.float32).tolist()
    df = spark.createDataFrame([(n, x) for n, x in enumerate(values)] + [(-1, None)], "n int, x float")
    found = {r["n"]: r["s"] for r in df.select("n", text.six_decimals(F.col("x")).alias("s")).collect()}
    assert found == {n: "%.6f" % x for n, x in enumerate(values)} | {-1: None}


def test_lines_are_numbered_block_by_block(spark, tmp_path):
    """Files of many blocks, whose lines keep their numbers, and of which no task reads a whole one."""
    texts = {"a.txt": "".join(f"line {k}\r\n" if k % 3 else "\n" for k in range(900)) + "end", "b.txt": "\n\nx\rx\n", "c.txt": ""}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        lines = files.read_places(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        found = sorted((r["path"].rsplit("/", 1)[1], r["n"], r["value"]) for r in lines.collect())
        codes = files.labels_of_report(spark.createDataFrame([("p", n, f"/db/{n:04d}A") for n in range(300)], "path string, n int, value string"))
        assert sorted(map(tuple, codes.collect())) == [(n + 1, f"{n:04d}A") for n in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    import re

    assert found == sorted((name, n, x) for name, content in texts.items() for n, x in enumerate(re.split("\r?\n", content)) if x)
