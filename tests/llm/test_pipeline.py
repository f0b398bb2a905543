"""The pipeline's stages on the smallest tables, and the whole of it against brute force."""

import random
from collections import Counter

import corpus_pipeline
from seqlake.llm import decontaminate, tokens
from seqlake.llm.common import stage


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n, tokens_before = docs.columns, docs.count(), None
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        if k + 1 == len(corpus_pipeline.STAGES):
            tokens_before = tokens.count_tokens(docs).selectExpr("sum(n_tokens)").first()[0]
        docs = stage(step(spark, docs, sf_dir))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            assert 0 < docs.count() <= n, name
            n = docs.count()
    assert docs.selectExpr("sum(length)").first()[0] == tokens_before


def _prose(seed: int, n: int, vocabulary: list[str]) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."


def _planted() -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Clean documents, junk, short and stuttering ones, copies and near copies, a passage in many, leaked items."""
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    docs = [_prose(k, 60 + k % 70, vocabulary) for k in range(170)]
    passage, items = _prose(900, 70, vocabulary), [(k, _prose(1000 + k, 24 + k, vocabulary)) for k in range(6)]
    for k in range(20, 32):
        docs[k] += " " + passage
    for k in range(40, 46):
        docs[k] += " " + items[k % 6][1] + " " + _prose(2000 + k, 10, vocabulary)
    docs += [docs[3], docs[4]]
    for k in range(50, 60):
        words = docs[k].split()
        for _ in range(1 + k % 3):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        docs.append(" ".join(words))
    docs += ["too short", "", " | ".join(_prose(7, 80, vocabulary).upper().split()), " ".join([_prose(8, 10, vocabulary)] * 9)]
    return list(enumerate(docs)), items


def test_run_equals_brute_force(spark, tmp_path):
    """Each stage in plain loops over the planted documents, down to every document's tokens."""
    docs, items = _planted()
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def passes(text):
        words = text.split()
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(words) >= 20 and 100 * len(again) <= 30 * len(words) and "|" not in text  # the planted outlier

    left = {i: t for i, t in docs if passes(t)}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in left.items())}
    group = {i: i for i in left}
    for i in left:
        for j in left:
            if i < j and group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                least, other = sorted((group[i], group[j]))
                group = {k: least if g == other else g for k, g in group.items()}
    assert len(set(group.values())) < len(left) - 6
    left = {i: left[i].encode() for i in left if group[i] == i}
    seen = Counter(t[k : k + 200] for t in left.values() for k in range(len(t) - 199))
    for i, t in list(left.items()):
        gone = {b for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1 for b in range(k, k + 200)}
        left[i] = bytes(x for k, x in enumerate(t) if k not in gone)
    asked = [decontaminate.split(t.encode()) for _, t in items]

    def leaks(text):
        words = decontaminate.split(text)
        return any(decontaminate.verdict(a, words[k : k + len(a) + 8])[1] for a in asked for k in range(len(words)))

    leaked = {i for i, t in left.items() if leaks(t)}
    assert leaked == set(range(40, 46))
    want = {i: t for i, t in left.items() if i not in leaked}
    trie = tokens.Trie(tokens.load(tokens.VOCABULARY))
    trie.insert(w for t in want.values() for w in t.split())
    assert {r["doc_id"]: r["length"] for r in found} == {i: sum(trie.count[w] for w in t.split()) for i, t in want.items()}
    used = Counter()
    for r in found:
        used[r["bin"], r["bin_size"]] += r["length"]
    assert len({b for b, _ in used}) == len(used) and all(n <= size for (_, size), n in used.items())
