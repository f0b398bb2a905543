"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import chat, common, components, decontaminate, language, licenses, packing, quality, sharding, simhash, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, spans string, shard string"


def prose(seed: int, n: int, words: int = 400) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 9000)
    shared = prose(2, 80)
    texts = [None, "", "   ", "one two", prose(3, 60), prose(3, 60), prose(3, 60) + " tail", long, prose(4, 30) + " " + shared, shared + " " + prose(5, 30), "ä" * 300 + " ö", "ab" * 400, "ñandú " + prose(6, 50)]
    out = [(i, t, ["en", "de", None][i % 3], [None, "s1"][i % 2], None, "x", "y", "z") for i, t in enumerate(texts)]
    return out + [out[4], (None, prose(3, 60), "en", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, rows, empty):
    assert simhash.near_duplicates(empty).count() == 0
    found = simhash.near_duplicates(docs).collect()
    prints = [int(simhash.fingerprint((r[1] or "").encode())[0]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    want = Counter((r[0], format(p, "016x"), least[g]) for r, p, g in zip(rows, prints, group))
    assert Counter(map(tuple, found)) == want


def test_fingerprint_by_its_definition():
    """Words, shingles, XXH64 and majority, spelled out."""
    import re

    import xxhash

    r = random.Random(4)
    for n in (0, 1, 3, 4, 5, 40):
        text = "".join(r.choice(["Ab", "É", "x\u00a0y", "\u2003"]) + r.choice([" ", "\n", "\t\x0b", "\r\x0c "]) for _ in range(n))
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(simhash.fingerprint(text.encode())[0]) == want


def test_first_shingles_meet():
    """Two sets of the similarity have one of their first shingles in common, whichever are late."""
    r = np.random.default_rng(8)
    met = 0
    for _ in range(400):
        base = np.unique(r.integers(0, 2**63, r.integers(1, 60), np.uint64))
        late = np.unique(r.choice(base, r.integers(0, len(base) + 1), replace=False))
        two = [np.unique(np.concatenate([base[r.random(len(base)) >= 0.1], r.integers(0, 2**63, r.integers(0, 4), np.uint64)])) for _ in range(2)]
        common, either = len(np.intersect1d(*two)), len(np.union1d(*two))
        if either and common >= 0.8 * either:
            met += 1
            assert len(np.intersect1d(*(simhash.first_shingles(x, 0.8, late) for x in two)))
    assert met > 50


def test_link_shard_equals_all_pairs():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 40, np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, 60, np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60, np.uint64)) for b in base]))[:, None]
    links = simhash.Links(len(fps))
    x, y = np.nonzero(simhash._distances(fps, fps) <= 4)
    links.add(x, y)
    assert len(fps) > simhash.LEAF and (simhash.link_shard(fps, 4) == links.root).all()


def test_crowded_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 50)
    r = np.random.default_rng(1)
    fps = np.unique(np.concatenate([r.integers(0, 2**20, 400), r.integers(0, 2**62, 50)]))
    nodes = spark.createDataFrame([(int(f), int(f)) for f in fps], "node long, f0 long")
    cells = simhash._routed(nodes, simhash.EXACT).groupBy("shard").agg(F.sum((~F.col("asking")).cast("int")).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 50
    roots = dict(map(tuple, components.connected_components(simhash.near_links(nodes)).collect()))
    want = simhash.link_shard(fps.view(np.uint64)[:, None], 4)
    assert all(roots.get(int(f), int(f)) == int(fps[w]) for f, w in zip(fps, want))


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r[0] for r in kept.collect() if r[0] is not None)
    assert ids.count(4) == 1 and 5 not in ids and 6 not in ids and 7 in ids and 0 in ids and 1 not in ids


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    a, b, c, d = (prose(800 + k, 60) for k in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a + " tail"), (None, c), (None, d), (None, b + " end"), (5, c + " end")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, a), (1, b), (None, d), (5, c + " end")])


def test_nearest_equals_all_pairs():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 9, np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, 90, np.uint64)) for b in base] + [base]))[:, None]
    roots = np.arange(len(fps)) // 2
    d = simhash._distances(fps, fps)
    for most in (1, 3, 1000):
        one, two, more = simhash.nearest(fps, roots, 4, most)
        want, further = set(), False
        for i in range(len(fps)):
            near = sorted((int(d[i, j]), j) for j in range(len(fps)) if d[i, j] <= 4 and roots[i] != roots[j])
            want.update((i, j) for _, j in near[:most])
            further |= len(near) > most
        assert set(zip(one.tolist(), two.tolist())) == want and more == further


def test_components_equal_union_find(spark):
    r = np.random.default_rng(6)
    edges = [*zip(range(60), range(1, 61)), *((100, n) for n in range(101, 160)), *((n, 300) for n in range(201, 260)), *map(tuple, r.integers(400, 700, (150, 2)).tolist()), (5, 5), (None, 7), (-3, 2), (-3, 2)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert sorted(map(tuple, found)) == sorted(root.items())
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parity_maps_deny_no_similar_pair():
    r = np.random.default_rng(5)
    base = [r.integers(0, 2**63, int(n), np.uint64) for n in (1, 5, 40, 200, 3000)]
    sets = [np.zeros(0, np.uint64)]
    for b in base:
        for share in (0, 0.02, 0.08, 0.1, 0.12, 0.2, 0.5):
            kept = b[r.random(len(b)) >= share]
            sets += [np.unique(kept), np.unique(np.concatenate([kept, r.integers(0, 2**63, len(b) - len(kept), np.uint64)]))]
    sizes, maps = np.array([len(s) for s in sets]), np.stack([simhash.parity_map(s) for s in sets])
    one, two = np.triu_indices(len(sets), 1)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(one, two)])
    alike = common >= 0.8 * (sizes[one] + sizes[two] - common)
    able = simhash.similar_enough(one, two, sizes, maps, 0.8)
    assert able[alike].all() and alike.any() and not able.all()


def test_whole_maps_tell_long_sets_apart():
    """Sets of thousands of shingles, which maps of 1,024 bits can't: none of over 0.8 is denied, all under 0.7 are."""
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 20_000, np.uint64)
    sets = [np.unique(np.concatenate([base[:n][r.random(n) >= share], r.integers(0, 2**63, int(share * n), np.uint64)])) for n in (900, 4000, 4500, 16_000, 20_000) for share in (0, 0.05, 0.1, 0.3, 1)]
    sizes = np.array([len(s) for s in sets])
    maps = simhash.Maps([simhash.whole_map(s).tobytes() for s in sets])
    assert (maps.least() == np.stack([simhash.parity_map(s) for s in sets])).all()
    one, two = np.triu_indices(len(sets), 1)
    common = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(one, two)])
    alike = common / (sizes[one] + sizes[two] - common)
    able = maps.similar_enough(one, two, sizes, 0.8)
    assert able[alike >= 0.8].all() and not able[alike < 0.7].any()
    assert simhash.similar_enough(one, two, sizes, maps.least(), 0.8)[alike < 0.7].any()


@pytest.mark.parametrize("crowd", [None, 3])
def test_unlike_long_texts_move_no_sets(spark, monkeypatch, crowd):
    """Texts of thousands of shingles, two thirds of them common to all, are no candidates once their maps are seen."""
    asked = []
    held = simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda pairs, *rest: asked.append(pairs.count()) or held(pairs, *rest))
    if crowd:
        monkeypatch.setattr(simhash, "CROWD", crowd)
    common = prose(70, 4000, 5000)
    texts = [f"{common} {prose(71 + k, 2000, 5000)}" for k in range(9)] + [f"{common} {prose(71, 2000, 5000)} end"]
    found = dict(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), simhash.SIMILAR).select("doc_id", "component_id").collect())
    assert found == {k: k % 9 for k in range(10)} and sum(asked) == 1


@pytest.mark.parametrize("crowd", [None, 3])
def test_similar_texts_equal_brute_force(spark, monkeypatch, crowd):
    """Texts with a few words changed, some 0.8 alike and some not, and a crowd that needs several rounds.

    Held against all pairs, of which the prints' blocks alone would miss some; also with shingles that are late choices.
    """
    r = random.Random(5)
    texts = []
    for k in range(12):
        words = prose(100 + k, 120 + 40 * k).split()
        for _ in range(60 if k == 0 else 5):
            changed = list(words)
            for _ in range(r.randint(0, len(words) // 30)):
                changed[r.randrange(len(words))] = f"new{r.random()}"
            texts.append(" ".join(changed))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group, missed = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
                one, two = (simhash.fingerprint(t.encode(), 5, 4) for t in (texts[i], texts[j]))
                differ = [int(x) ^ int(y) for x, y in zip(one, two)]
                missed += all(differ[n] >> at & (1 << bits) - 1 for n, at, bits in simhash.SIMILAR.blocks)
    if crowd:
        monkeypatch.setattr(simhash, "CROWD", crowd)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = dict(simhash.near_duplicates(docs, simhash.SIMILAR).select("doc_id", "component_id").collect())
    assert 12 < len(set(group)) < len(texts) - 12 and missed
    assert [found[i] for i in range(len(texts))] == group


def test_repeated_phrases_leave_candidates(spark):
    """Texts of nearly one set of shingles that repeat a phrase a different number of times."""
    texts = []
    for k in range(8):
        words, phrase = prose(40 + k, 800, 5000), prose(90 + k, 10, 5000)
        texts += [f"{words} {phrase}", " ".join([words, *[phrase] * 20])]
    found = dict(simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), simhash.SIMILAR).select("doc_id", "component_id").collect())
    assert found == {i: i // 2 * 2 for i in range(16)}


def brute_spans(texts: list[bytes], n: int) -> list[list[bool]]:
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        cover = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                cover[i : i + n] = [True] * n
        out.append(cover)
    return out


@pytest.mark.parametrize("shard,crowd", [(1 << 20, 10_000), (2000, 10_000), (1 << 20, 1)])
def test_repeats(docs, rows, monkeypatch, shard, crowd):
    monkeypatch.setattr(suffix, "SHARD", shard)
    monkeypatch.setattr(suffix, "CROWD", crowd)
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, cover in zip(rows, texts, brute_spans(texts, 200)):
        kept = bytes(b for b, c in zip(t, cover) if not c)
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        want[r[0], len(t), sum(cover), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, suffix.remove_repeats(docs).collect())) == want


def test_repeats_texts(docs, empty):
    left = suffix.remove_repeats(docs, texts=True)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert {r["text"] for r in left.filter("doc_id in (3, 4)").collect()} == {"one two", ""}
    assert suffix.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("copies", [1, 2, 2000])
def test_equal_rows_cost_what_one_costs(spark, copies):
    text, other = prose(8, 160), prose(9, 90)
    rows = [(1, text, copies)] * copies + [(None, text[:500], 0), (2, other, 1), (3, None, 1), (3, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rows long").repartition(3)
    texts = [t.encode() for t in (text, text[:500], other)]
    cover = brute_spans(texts + texts[:1] * (copies > 1), 200)
    want = Counter()
    for doc, t, c, n in zip((1, None, 2), texts, cover, (copies, 1, 1)):
        kept = bytes(b for b, gone in zip(t, c) if not gone)
        spans = sum(gone and not (i and c[i - 1]) for i, gone in enumerate(c))
        want[doc, len(t), sum(c), spans, hashlib.sha256(kept).hexdigest()] += n
    want[3, 0, 0, 0, hashlib.sha256().hexdigest()] += 2
    assert Counter(map(tuple, suffix.remove_repeats(docs).collect())) == want


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(3)
    data = np.concatenate([r.integers(97, 99, 500), np.tile(r.integers(97, 120, 60), 8)]).astype(np.uint8)
    raw = data.tobytes()
    order = suffix.suffix_array(data, len(data))
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = suffix.common_prefixes(data, order, 10**6)
    for rank in range(1, len(raw)):
        a, b = raw[order[rank - 1] :], raw[order[rank] :]
        assert shared[rank] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_quality_base(docs, rows, empty):
    assert quality.judge(empty).count() == 0
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs).collect())
    want = Counter()
    for r in rows:
        t = r[1] or ""
        ws = t.encode().split()
        windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        again = {j for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        want[r[0], len(ws), sum(len(w.decode()) for w in ws), sum(t.count(c) for c in "#*$%&|<>"), 0, len(again), len(ws) < 20 or 100 * len(again) > 30 * len(ws)] += 1
    assert found == want


def test_quality_rejects_outliers_alone(spark):
    good = [(i, prose(i, 80).capitalize() + ".", "en", "s") for i in range(150)]
    bad = [(1000 + i, " | ".join(prose(i, 80).split()), "en", "s") for i in range(8)] + [(2000, prose(7, 80).upper().replace(" ", "!! "), "en", "s")]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert kept == {i for i, *_ in good}
    assert {r[0] for r in quality.keep_good(docs).select("doc_id").collect()} == kept


@pytest.mark.parametrize("copies", [True, False])
def test_quality_rejects_a_third_of_junk(spark, copies):
    good = [(i, prose(i, 80).capitalize() + ".", "en", "s") for i in range(160)]
    junk = [(1000 + i, " | ".join(prose(0 if copies else i, 80).upper().split()), "en", "s") for i in range(80)]
    kept = quality.judge(spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string")).filter("kept")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in good}


def test_quality_equals_plain_estimate(spark):
    """The verdict against minimum-covariance-determinant by sorting whole distances from many random starts."""
    r = np.random.default_rng(3)
    texts = []
    for i in range(260):
        words = prose(i, int(r.integers(30, 200))).split()
        texts.append(" ".join(w + "," * (r.random() < 0.1) for w in words) + ".")
    for i in range(0, 260, 26):
        texts[i] = [texts[i].upper(), texts[i].replace(" ", " # $ "), " ".join(c for w in texts[i].split() for c in (w, w, w)), texts[i].replace("a", "7").replace("e", "4")][i // 26 % 4]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    judged = {x["doc_id"]: x for x in quality.judge(docs).collect()}
    usable = [i for i in judged if not judged[i]["base_failed"]]
    names = list(quality.FEATURES)
    x = quality.statistics(docs).select("doc_id", *(c.alias(n) for n, c in quality._features().items())).toPandas().set_index("doc_id").loc[usable, names].to_numpy()
    floors, h, best = np.diag(np.array(list(quality.FEATURES.values())) ** 2), -(-len(x) // 2), None
    for _ in range(40):
        rows = r.choice(len(x), 12, replace=False)
        for _ in range(30):
            cov = np.cov(x[rows].T, bias=True) * quality._CONSISTENT + floors
            off = x - x[rows].mean(axis=0)
            d2 = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
            rows = np.argsort(d2, kind="stable")[:h]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, d2
    far = {i for i, d in zip(usable, best[1]) if d > quality.CUTOFF**2}
    close = {i for i, d in zip(usable, best[1]) if 0.8 < d / quality.CUTOFF**2 < 1.25}
    out = {i for i in usable if not judged[i]["kept"]}
    assert len(far) >= 5 and out ^ far <= close


def test_quality_counts_capitals_beside_any_letter():
    assert quality.counts(("A" * 30 + " \u0130x").encode())[5] == 31


def test_token_counts():
    pieces = {"▁": -1.0, "▁a": -2.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁ab": -7.5, "aba": -4.5, "c": -9.0}
    trie = tokens.Trie(pieces)
    words = ["".join(random.Random(k).choice("abcdß") for _ in range(k % 9 + 1)) for k in range(300)] + ["a" * 3000]
    trie.insert(w.encode() for w in words)
    for w in words:
        text, best = "▁" + w, [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = [(best[s][0] + pieces[text[s:end]], -best[s][1] - 1) for s in range(max(0, end - 4), end) if text[s:end] in pieces]
            if text[end - 1] not in pieces:
                size = len(text[end - 1].encode())
                options.append((best[end - 1][0] + size * trie.unknown, -best[end - 1][1] - size))
            value, count = max(options)
            best.append((value, -count))
        assert trie.count[w.encode()] == best[-1][1]


def test_token_count_rows(docs, empty):
    assert tokens.count_tokens(empty).count() == 0
    found = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokens.count_tokens(docs).collect()}
    assert found[0] == found[1] == found[2] == (0, 0) and found[7][0] == 9000 and found[3][1] >= 2


def test_tries_end_with_their_stage(spark, docs):
    """The stages after a count run in the same Python processes."""

    def held(batches):
        import gc

        import pyarrow as pa

        gc.collect()
        tries = sum(isinstance(x, tokens.Trie) for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tries] * batch.num_rows, pa.int64())], names=["tries"])

    tokens.count_tokens(docs).collect()
    assert {r["tries"] for r in spark.range(64, numPartitions=16).mapInArrow(held, "tries long").collect()} == {0}


def test_trie_is_shared_by_the_tasks_of_a_stage(spark):
    pieces = spark.sparkContext.broadcast({"▁a": -1.0})
    assert tokens.trie_of(pieces) is tokens.trie_of(pieces)


def test_packing():
    for seed in range(20):
        r = random.Random(seed)
        lengths = [r.choice([0, 1, 5, 30, 64, 100, r.randint(0, 128)]) for _ in range(r.randint(0, 300))]
        bins, places, sizes = packing.pack(lengths, (32, 64, 128), 4)
        used = Counter()
        for b, p, n in sorted(zip(bins, places, lengths)):
            assert n == 0 or p == used[b]
            used[b] += n
        assert all(used[b] <= s and (s == 32 or used[b] > s // 2) for b, s in enumerate(sizes))
        assert sum(sizes) <= sum(lengths) * 1.3 + 128


def test_packing_costs():
    """Against every way to pack a few pieces, and against packing the largest size and downsizing."""
    sizes, cost = (32, 64, 128), lambda n: packing.bin_cost(next(s for s in (32, 64, 128) if s >= n), 4, 384)

    def least(pieces, held=()):
        if not pieces:
            return sum(map(cost, held))
        n, rest = pieces[0], pieces[1:]
        options = [least(rest, (*held[:k], h + n, *held[k + 1 :])) for k, h in enumerate(held) if h + n <= 128]
        return min([*options, least(rest, (*held, n))])

    total = best = 0
    for seed in range(60):
        r = random.Random(seed)
        lengths = [r.choice([r.randint(1, 128), r.randint(1, 40)]) for _ in range(r.randint(1, 7))]
        found = sum(cost(s) for s in packing.pack(lengths, sizes, 4, 384)[2])
        assert found <= 1.5 * least(lengths)
        total, best = total + found, best + least(lengths)
    assert total <= 1.06 * best
    for draw in (lambda r: min(8192, int(r.expovariate(1 / 500)) + 1), lambda r: r.choice([r.randint(600, 1100), r.randint(2100, 3000)])):
        r = random.Random(1)
        lengths = [draw(r) for _ in range(3000)]
        joint = packing.pack(lengths)[2]
        used = Counter()
        for b, n in zip(packing.pack(lengths, (8192,))[0], lengths):
            used[b] += n
        downsized = [next(s for s in packing.SIZES if s >= n) for n in used.values()]
        assert sum(map(packing.bin_cost, joint)) < 0.98 * sum(map(packing.bin_cost, downsized)) and len(set(joint)) > 1


def test_best_fit_equals_plain_search():
    """Each piece in the fullest open bin that has room, by looking at all of them; and sizes as good as any choice of them."""
    from itertools import product

    permitted = [32, 64, 128]
    for seed in range(30):
        r = random.Random(seed)
        lengths = [r.choice([1, 5, 30, 64, 100, r.randint(1, 128)]) for _ in range(r.randint(0, 60))]
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        costs = []
        for sizes in product(permitted, repeat=3):
            opening = dict(zip(permitted, sizes))
            if any(s < k for k, s in opening.items()):
                continue
            rooms, bins = [], [0] * len(lengths)
            for i in order:
                fits = [(room - lengths[i], k) for k, room in enumerate(rooms) if room >= lengths[i]]
                if not fits:
                    rooms.append(opening[next(s for s in permitted if s >= lengths[i])])
                    fits = [(0, len(rooms) - 1)]
                bins[i] = min(fits)[1]
                rooms[bins[i]] -= lengths[i]
            found = packing.best_fit(lengths, order, permitted, opening)
            assert found[0] == bins
            costs.append(sum(packing.bin_cost(next(s for s in permitted if s >= u), 4, 384) for u in found[2]))
        total = sum(packing.bin_cost(s, 4, 384) for s in packing.pack(lengths, tuple(permitted), 4, 384)[2])
        assert total <= 1.02 * min(costs) + 1e-9


@pytest.mark.parametrize("shard", [20_000, 40])
def test_packed_items_of_many_groups(spark, monkeypatch, shard):
    """Items longer than any bin, nulls, repeats and clashing columns, in one group and in several."""
    monkeypatch.setattr(packing, "SHARD", shard)
    r = random.Random(5)
    items = [(r.choice([None, 1, k]), r.choice([None, 0, -3, 1, 700, r.randint(1, 30_000)])) for k in range(150)] + [(7, 8192 * 3)] * 5
    frame = spark.createDataFrame(items, "doc_id long, n_tokens long").withColumns({"shard": F.lit(1), "bin": F.lit(2), "At": F.lit(3)}).repartition(4)
    found = packing.pack_items(frame).collect()
    total, bins = Counter(), {}
    for x in found:
        total[x.doc_id] += x.length
        bins.setdefault(x.bin, []).append(x)
        assert x.start == x.piece * 8192 and x.bin_start + x.length <= x.bin_size
    want = Counter()
    for doc, n in items:
        want[doc] += max(0, n or 0)
    assert +total == +want and {x.doc_id for x in found} == {doc for doc, _ in items}
    assert sum(x.piece == 0 for x in found) == len(items)
    for rows in bins.values():
        used = 0
        for x in sorted(rows, key=lambda x: (x.bin_start, x.length)):
            assert not x.length or x.bin_start == used
            used += x.length
        assert {x.bin_size for x in rows} == {next(s for s in packing.SIZES if s >= used)}
    assert packing.pack_items(frame.limit(0)).count() == 0


def test_packing_rows(docs, rows, empty):
    assert packing.pack_documents(empty).count() == 0
    found = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in found) == sum(r["n_tokens"] for r in tokens.count_tokens(docs).collect()) > 0
    assert Counter(r["doc_id"] for r in found if r["piece"] == 0) == Counter(r[0] for r in rows)


def test_sharding(docs, rows, empty):
    assert sharding.assign_shards(empty).count() == 0
    found = sharding.assign_shards(docs, limit=2000).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    total = Counter()
    for r in found:
        total[r["shard"]] += r["n_bytes"]
    assert all(total[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= 2000 or r["shard_bytes"] == r["n_bytes"]) for r in found)


def test_sharding_equals_splitting_by_hand(spark):
    """Buckets of rows split bit by bit until they fit; copies of one row and rows over the limit in pages."""
    rows = [(i, "t" * (i * 37 % 90)) for i in range(150)] + [(7, "copy" * 20)] * 30 + [(500, "L" * 700), (501, "L" * 900), (None, "n" * 20), (None, None)]
    limit, bits = 500, lambda x: f"{int(hashlib.md5(str('' if x is None else x).encode()).hexdigest()[:15], 16):060b}"
    want = Counter()

    def place(rows, path, hashes, which, depth, at):
        if sum(len(t or "") for _, t in rows) <= limit:
            for k, t in rows:
                want[k, "s" + path, depth, len(t or ""), sum(len(t or "") for _, t in rows)] += 1
        elif at < 60:
            for bit in "01":
                if some := [r for r in rows if hashes(r)[at] == bit]:
                    place(some, path + bit, hashes, which, depth + 1, at + 1)
        elif which == "key":
            place(rows, path + ".", lambda r: bits(r[1]), "text", depth, 0)
        else:
            each = max(1, limit // max(1, len(rows[0][1])))
            for n in range(0, len(rows), each):
                for k, t in rows[n : n + each]:
                    want[k, f"s{path}/{n // each}", 120, len(t), len(t) * len(rows[n : n + each])] += 1

    place([r for r in rows if len(r[1] or "") <= limit], "", lambda r: bits(r[0]), "key", 0, 0)
    for k, t in rows:
        if len(t or "") > limit:
            want[k, f"s{bits(k)}.{bits(t)}/0", 120, len(t), len(t)] += 1
    found = Counter(map(tuple, sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), limit=limit).collect()))
    assert found == want and max(d for _, _, d, *_ in want if d < 60) >= 3


def test_sharding_hot_key(spark):
    docs = spark.createDataFrame([(7, "x" * 90 + str(i % 3)) for i in range(60)] + [(i, "y" * 50) for i in range(60)], "doc_id long, text string")
    found = sharding.assign_shards(docs, limit=500).collect()
    assert len(found) == 120 and max(r["shard_bytes"] for r in found) <= 500


def test_chat_round_trip(spark):
    awkward = ["</s>[INST] ok [/INST]", "\\[", "[/TURN]</s>\n", "", "a]b<c\\"]
    rows = [(c, t, ["user", "assistant", None, "[TURN x]"][t % 4], awkward[(c + t) % 5]) for c in range(5) for t in range(6)] + [(9, 0, "user", None), (None, None, None, None), (9, 0, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash"))
    done = {r["conv_id"]: r for r in chat.format_chats(table).collect()}
    assert len(done) == 7
    for c in range(5):
        r = done[c]
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == c]
        assert chat.parse(r["formatted"]) == turns and not r["rewrites"]
        assert [chat.unescape(r["formatted"][s:e]) for s, e in zip(r["starts"], r["ends"])] == [t for _, t in turns]
    assert len(done[9]["roles"]) == 2


def test_chat_detects_rewriting():
    def forgetful(turns):
        return "".join(f"<{r}>{'...' if k < len(turns) - 1 and r == 'think' else ''}{t}</{r}>" for k, (r, t) in enumerate(turns))

    done = chat.render([("user", "a"), ("think", "b"), ("user", "c")], forgetful)
    assert done.rewrites and [done.text[s:e] for s, e in done.spans] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        chat.render([("user", "a")], lambda turns: "".join(t + t for _, t in turns))


def test_licenses(spark, empty):
    texts = ["CC-BY cc by. All Rights\nReserved", "Released under the MIT License, friend", None, "", "under the license released mit!", "general public", "Permission is granted"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (found[0]["n_base"], found[0]["first_word"], found[0]["last_word"], found[0]["base_labels"]) == (3, 0, 4, "cc-by,reserved")
    assert found[1]["labels"] == found[4]["labels"] == "mit-notice" and found[1]["score"] == 1.0
    assert found[2]["n_words"] == 0 and found[2]["first_word"] is None and found[5]["labels"] == found[6]["labels"] == ""
    assert licenses.scan(empty).count() == 0


def test_wrapped_licenses(spark):
    """Each template wrapped, with and without blank lines and comment marks; text without a notice gets no label."""
    rows = []
    for label, text in licenses.TEMPLATES.items():
        ws = text.split()
        for between in ("\n", "\n# ", "\n\n"):
            wrapped = between.join(" ".join(ws[i : i + 4]) for i in range(0, len(ws), 4))
            rows.append((label, f"{prose(len(rows), 50)}\n{wrapped}\n{prose(len(rows) + 99, 50)}"))
    rows.append(("", "\n".join([prose(7, 9), "permission to use", prose(8, 90), "software without", prose(9, 90), "restriction"])))
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert all(label in found[i]["labels"].split(",") and (found[i]["score"] == 1.0) == bool(label) for i, (label, _) in enumerate(rows))


def test_license_sql_looks_across_lines(spark, tmp_path):
    """Notices wrapped over lines, and words of one scattered too far, by the query and by its SQL."""
    import duckdb

    texts = [None, "", "one\ntwo"]
    for notice in licenses.TEMPLATES.values():
        words = notice.split()
        texts += ["\n".join(" ".join(words[k : k + 4]) for k in range(0, len(words), 4)), "x y\n" + " z z z z ".join(words), "\n".join(words[: len(words) // 2]), "a\nb " + notice]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = licenses.op8_license_scan(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({licenses.op8_sql()})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(want) and sum(bool(x[6]) for x in want) >= 2 * len(licenses.TEMPLATES)


def test_license_join_equals_all_pairs():
    r = random.Random(5)
    known = sorted(frozenset().union(*licenses.vocabulary().values()))
    for seed in range(5):
        join = licenses.Join({w: random.Random(seed).randint(0, 99) for w in known})
        for _ in range(300):
            base = r.choice(list(licenses.vocabulary().values()))
            block = [w for w in base if r.random() < 0.85] + r.sample(known, 3)
            want = {label: len(ws & set(block)) / len(ws) for label, ws in licenses.vocabulary().items() if len(ws & set(block)) >= licenses.needed(len(ws))}
            assert join.match(block) == want


def test_subsequence():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.subsequence(a, b) == table[-1][-1]


def test_leaks(spark, empty):
    items = [(i, prose(100 + i, 20 + i)) for i in range(30)] + [(98, None), (99, "")]
    docs = [(i, prose(500 + i, 200) + " " + (items[i][1] + " " if i < 20 else "") + prose(900 + i, 100)) for i in range(60)] + [(77, None), (78, "")]
    swapped = items[25][1].split()
    for k in range(0, len(swapped) * 3 // 4, 4):
        swapped[k] = "paraphrased"
    docs.append((61, prose(1, 90) + " " + " ".join(swapped) + " " + prose(2, 90)))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(table, benchmark).collect()}
    assert found == {(i, i) for i in range(20)} | {(61, 25)}
    assert decontaminate.drop_leaks(table, benchmark).count() == len(docs) - 21
    assert decontaminate.find_leaks(empty, benchmark).count() == 0 and decontaminate.find_leaks(table, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_leaks_equal_brute_force(spark, monkeypatch, small):
    """All windows of all documents against all items; passages in 1, 10, 50 and 90 % of them, whole and reworded."""
    if small:
        for name, n in (("WORDS", 64), ("CHUNK", 200), ("BLOCK", 120)):
            monkeypatch.setattr(decontaminate, name, n)
    r = random.Random(2)
    vocabulary = prose(1, 900, 900).split()
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(18 + 7 * k)) for k in range(8)] + [(50, items_ := text(25)), (50, items_), (60, "one"), (61, None)]
    docs = []
    for i in range(120):
        parts = [text(r.randint(0, 60))]
        for k, share in enumerate((0.01, 0.1, 0.5, 0.9)):
            if i % 100 < share * 100:
                parts += [items[k][1], text(r.randint(0, 40))]
        reworded = [w if n % 4 or n > 12 else r.choice(vocabulary) for n, w in enumerate(items[4 + i % 4][1].split())]
        docs.append((i, " ".join([*parts, *([*reworded, text(20)] if i % 3 == 0 else [])])))
    docs += [(None, items[0][1]), (7, items[1][1]), (7, items[1][1]), (200, None), (201, "")]
    words = {k: decontaminate.split(t.encode()) for k, t in items if t}
    want = Counter()
    for d, t in docs:
        ws = decontaminate.split((t or "").encode())
        for k, t in items:
            if t:
                half = decontaminate._width(words[k]) // 2
                want[d, k] += any(decontaminate.verdict(words[k], ws[max(0, b - half) : b + 3 * half])[1] for b in range(0, len(ws), half) if ws[b : b + 2 * half])
    found = Counter((x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert found == +want and len(found) > 150


def test_latent_basis_equals_plain_svd(spark):
    r = np.random.default_rng(5)
    passages = [" ".join(f"w{int(x)}" for x in r.choice(40, 32, p=np.arange(1, 41) / 820)) for _ in range(300)]
    known = sorted(f"w{k}".encode() for k in range(40))
    coded = decontaminate.encode(spark.createDataFrame([(k, k, p) for k, p in enumerate(passages)], "doc_id long, h long, text string"), known)
    weight, items = np.ones(40), [[0, 1, 2], [5]]
    vectors, values = decontaminate.latent_basis(coded, items, np.arange(40, dtype=np.int32), weight, 6)
    rows = np.array([[p.split().count(w.decode()) for w in known] for p in passages], float)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    own = np.array([[float(k in item) for k in range(40)] for item in items])
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    assert vectors.shape == (40, 6) and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-4)
    whole = rows.T @ rows / np.trace(rows.T @ rows)
    assert np.linalg.norm(whole @ vectors[:, :1]) > 0.9 * np.linalg.eigvalsh(whole)[-1] and (np.diff(values) <= 1e-9).all()


def test_leaks_of_common_words(spark):
    """A passage in a third of the documents, whose words all get common by that, and one of words that stand everywhere."""
    leaked, frequent = prose(40, 38), "we go on and so do they as it was to be that it is as we do go so on they be"
    filler = lambda i: " ".join(x + " " + y for x, y in zip(prose(700 + i, 60).split(), frequent.split() * 3))
    docs = [(i, prose(300 + i, 70) + " " + (leaked + " " if i % 3 == 0 else "") + (frequent + " " if i == 50 else filler(i)) + prose(600 + i, 70)) for i in range(120)]
    others = [(k, " ".join(docs[k][1].split()[:30])) for k in range(2, 120, 3)]
    benchmark = spark.createDataFrame([(1000, leaked), (1001, frequent), *others], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert {d for d, i in found if i == 1000} == set(range(0, 120, 3))
    assert (50, 1001) in found and {(k, k) for k, _ in others} <= found


def test_rare_words_are_in_every_leak():
    r = random.Random(3)
    for _ in range(300):
        item = [r.choice("abcdefghijklmnopqrstuvwxyz").encode() for _ in range(r.randint(1, 40))]
        seen = {w: r.randint(0, 9) for w in item}
        region = [w for w in item if r.random() < r.choice([0.5, 0.7, 0.9])] + [b"?"]
        if decontaminate.verdict(item, region)[1]:
            assert not decontaminate.rare_words(item, seen).isdisjoint(region) and decontaminate.possible(item, set(region))


def test_language(spark, empty):
    words = {"aa": ["banana", "anagram", "cabana"], "bb": ["mitring", "sprint", "wind"], "cc": ["köln", "übör", "föhn"]}
    r = random.Random(1)
    text = lambda *langs: " ".join(r.choice(words[x]) for x in langs for _ in range(40))
    docs = spark.createDataFrame([(i, text(x), x) for i, x in enumerate(["aa", "bb", "cc"] * 10)] + [(90, None, "aa"), (91, "12 34", "bb"), (92, "x", None)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert [names for names, _ in model] == [["aa", "bb", "cc"]]
    asked = spark.createDataFrame([(0, text("aa")), (1, text("aa", "cc")), (2, None), (3, "1 2 !"), (4, text("bb", "bb", "aa"))], "doc_id long, text string")
    found = {x["doc_id"]: x for x in language.identify(asked, model).collect()}
    assert (found[0]["lang_pred"], found[0]["score"]) == ("aa", 1.0)
    assert found[1]["languages"] == "aa,cc" and abs(found[1]["score"] - 0.5) < 0.05
    assert found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[3]["score"] == 0.0
    assert found[4]["lang_pred"] == "bb" and abs(found[4]["score"] - 2 / 3) < 0.05
    assert language.identify(empty, model).count() == 0
    clash = asked.withColumns({"languages": F.lit(1), "score": F.lit("x"), "lang": F.lit("zz")}).unionAll(asked.withColumns({"languages": F.lit(1), "score": F.lit("x"), "lang": F.lit(None)}))
    assert Counter(map(tuple, language.identify(clash, model).collect())) == Counter([*map(tuple, found.values())] * 2)
    assert language.learn(empty)[0][0] == [] and {x["lang_pred"] for x in language.identify(asked, language.learn(empty)).collect()} == {"und"}


@pytest.mark.parametrize("most", [256, 7])
def test_every_label_is_learned(spark, monkeypatch, most):
    """Thirty languages, one of them with a single text, in one part and in several."""
    monkeypatch.setattr(language, "LANGUAGES", most)
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(r.choice(letters) for _ in range(6)) for _ in range(8)] for k in range(30)}
    text = lambda x: " ".join(r.choice(words[x]) for _ in range(40))
    docs = spark.createDataFrame([(i, text(x), x) for i, x in enumerate([*words] * 4)] + [(999, "żółw gżegżółka " * 20, "pl")], "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert sorted(x for names, _ in model for x in names) == [*sorted(words), "pl"] and max(len(names) for names, _ in model) <= most
    asked = spark.createDataFrame([(i, text(x), x) for i, x in enumerate(words)] + [(50, "gżegżółka żółw", "pl"), (51, None, "und"), (51, None, "und")], "doc_id long, text string, row string")
    found = [tuple(x)[:2] for x in language.identify(asked, model).collect()]
    assert Counter(found) == Counter(tuple(x) for x in asked.select("doc_id", "row").collect())


def test_language_query_by_its_quarters(spark, tmp_path):
    """The query on a small table: the held-out quarter, what is learned from the rest alone, and undetermined texts."""
    import zlib

    r = random.Random(6)
    words = {"aa": ["banana", "anagram", "cabana"], "bb": ["mitring", "sprint", "wind"]}
    rows = [(k, " ".join(r.choice(words[x]) for _ in range(30)), x) for k, x in enumerate(["aa", "bb"] * 20)]
    out = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    rows = [(k, t, "only-held-out" if k in out else x) for k, t, x in rows] + [(100, None, "aa"), (101, " 1 ", None), (None, "banana cabana", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {x["doc_id"]: x for x in language.op10_language_mixture(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) and all(found[k]["held_out"] == (zlib.crc32(("" if k is None else str(k)).encode()) % 4 == 2) for k in found)
    for k, t, _ in rows:
        assert found[k]["lang_pred"] == ("und" if not t or t == " 1 " else "aa" if set(t.split()) <= set(words["aa"]) else "bb")


def test_mixture_of_many_languages():
    """A text of six languages; and every set of three languages, by brute force, for texts of up to three."""
    from itertools import combinations

    r = np.random.default_rng(2)
    logs = np.full((language.BUCKETS, 6), np.log(1e-6), np.float32)
    alphabets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    word = lambda k: "".join(r.choice(list(alphabets[k]), 5))
    for k in range(6):
        bucket, *_ = language.trigrams([" ".join(word(k) for _ in range(4000))])
        counts = np.bincount(bucket, minlength=language.BUCKETS) + 0.1
        logs[:, k] = np.log(counts / counts.sum())
    six = " ".join(word(k) for k in range(6) for _ in range(30))
    assert (language.mixtures([six], logs)[0][0] > 0.1).all()
    for langs in combinations(range(6), 3):
        text = " ".join(word(k) for k in langs[: 1 + sum(langs) % 3] for _ in range(20))
        found = language.mixtures([text], logs)[0][0]
        assert set(np.flatnonzero(found > 0)) == set(langs[: 1 + sum(langs) % 3])


def test_many_license_hits_count_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "cc by " * 200_000)], "doc_id long, text string")
    found = licenses.scan(docs).first()
    assert (found["n_base"], found["first_word"], found["last_word"], found["n_words"]) == (200_000, 0, 399_998, 400_000)


def test_own_license_templates(spark):
    templates = {"mine": "you may copy this thing as long as you say who made it", "none": "..."}
    docs = spark.createDataFrame([(1, "so: you may copy this thing, as long as you say who made it!"), (2, "you may not"), (2, "you may not"), (None, "")], "doc_id long, text string").withColumn("labels", F.lit(1))
    assert Counter((r["doc_id"], r["labels"]) for r in licenses.scan(docs, templates).collect()) == {(1, "mine"): 1, (2, ""): 2, (None, ""): 1}


def test_long_texts_are_cut_alike(spark, monkeypatch):
    """Repeats in texts that are taken in pieces."""
    monkeypatch.setattr(suffix, "CHUNK", 256)
    monkeypatch.setattr(suffix, "PIECE", 700)
    shared = prose(31, 90)
    texts = [prose(32, 900) + " " + shared + " " + prose(33, 700) + " " + shared, prose(34, 10) + shared, "ab" * 3000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    want = [bytes(b for b, c in zip(t, cover) if not c) for t, cover in zip(raw, brute_spans(raw, 200))]
    assert [r["kept_sha256"] for r in suffix.remove_repeats(docs).orderBy("doc_id").collect()] == [hashlib.sha256(w).hexdigest() for w in want]


def test_batches_of_long_texts_are_bounded(spark):
    """A partition of 48 MB comes to Python in parts; a smaller limit of the session's stays."""

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        docs = common.stage(spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 16_000).alias("text")))
        found = [r["n"] for r in docs.coalesce(1).mapInArrow(sizes, "n long").collect()]
        assert sum(found) >= 48_000_000 and max(found) <= 1.1 * common.BATCH
        spark.conf.set(name, "2m")
        common.bounded_batches(spark)
        assert spark.conf.get(name) == "2m"
    finally:
        spark.conf.set(name, before)


def test_stage_forms_take_any_columns(spark):
    """Columns that clash with helpers' names, or aren't plain names; null and repeated ids; empty tables."""
    names = ["doc_id", "text", "lang", "source", "_id", "_h", "_", "a.b", "bad_id", "bad_hash", "text_hash", "h", "k", "k2", "rest", "c0", "kept", "out", "BAD_ID_"]
    rows = [(i, prose(400 + i, 40), "en", "s", *range(len(names) - 4)) for i in range(6)]
    rows += [rows[0], (None, prose(400, 40), "en", "s", *[None] * (len(names) - 4)), (None, None, None, None, *[None] * (len(names) - 4)), (9, prose(411, 200) + " " + prose(412, 40), "en", "s", *range(len(names) - 4))]
    kinds = ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string' if n in ('text', 'lang', 'source') else 'int'}" for n in names)
    docs, benchmark = spark.createDataFrame(rows, kinds), spark.createDataFrame([(1, prose(412, 40)), (None, None)], "item_id long, text string")
    stages = {"good": lambda d: quality.keep_good(d), "one": lambda d: simhash.keep_one(d), "repeats": lambda d: suffix.remove_repeats(d, texts=True), "leaks": lambda d: decontaminate.drop_leaks(d, benchmark)}
    for name, step in stages.items():
        done = step(docs)
        assert done.columns == names, name
        assert {"good": 9, "one": 8, "repeats": 10, "leaks": 9}[name] == done.count(), name
        assert step(docs.limit(0)).count() == 0, name
    assert decontaminate.drop_leaks(docs, benchmark.limit(0)).count() == len(rows)
