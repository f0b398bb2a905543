"""Merkle manifests, conversation repair and sentencepiece encoding against brute force and the library."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqlake.llm import manifest, pieces, repair


def sha(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str | None, bool]]]]:
    paths, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [(nodes[k : k + 2], under[k : k + 2]) for k in range(0, len(nodes), 2)]
        for run, leaves in runs:
            for side, mine in enumerate(leaves):
                for leaf in mine:
                    paths[leaf].append((run[1 - side] if len(run) == 2 else None, side == 1))
        nodes, under = [sha(*run) for run, _ in runs], [sum(leaves, []) for _, leaves in runs]
    return nodes[0], paths


def by_hand(rows: list[tuple]) -> Counter:
    """manifest.verified() of rows(doc_id, source, lang, n_chars, text), spelled out."""
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    langs = {}
    for doc, source, lang, n, text in rows:
        changed = n + 1 if n is not None and doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 else n
        langs.setdefault(lang, []).append((doc, *(sha(*map(coded, (doc, source, lang, x, text))) for x in (n, changed))))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    below = {x: tree([r[1] for r in langs[x]]) for x in names if langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1])) is None}
    out = Counter()
    root, above = tree([below[x][0] for x in names]) if names else ("", [])
    for name, top in zip(names, above):
        for (doc, leaf, shown), path in zip(langs[name], below[name][1]):
            fold = shown
            for other, left in path + top:
                fold = sha(fold) if other is None else sha(other, fold) if left else sha(fold, other)
            out[(doc, leaf, below[name][0], root, sha(*(o for o, _ in path + top if o)), fold, fold == root)] += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 700])
def test_manifest_equals_hand_made_trees(spark, n):
    r = random.Random(n)
    rows = [(r.choice([None, 1, 7, k]), r.choice(["s", None, ""]), r.choice(["en", "en", "é", None, ""]), r.choice([None, 5, 2**63 - 1]), r.choice([None, "", "ä", "x" * 5000, str(k)])) for k in range(n)]
    rows += rows[:1] * 40 if n > 3 else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.withColumns({"grp": F.lit(1), "idx": F.lit(2), "h": F.lit("x"), "apart": F.lit(3), "Path": F.lit(4)}).repartition(3)
    assert Counter(map(tuple, manifest.verified(manifest.manifest(docs, manifest.tampering())).collect())) == by_hand(rows)


def test_manifest_of_several_rounds(spark, monkeypatch):
    """Blocks of two leaves: every level is a round of its own."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    rows = [(k, None, "en" if k % 3 else None, k, "t") for k in range(21)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(map(tuple, manifest.verified(manifest.manifest(docs, manifest.tampering())).collect())) == by_hand(rows)


def cheapest(signature: str) -> tuple[int, str]:
    """By search over all edits, cheapest first."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, audit, row, out = heapq.heappop(heap)
        if row == len(signature) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        if (audit, row, out) in seen:
            continue
        seen.add((audit, row, out))
        steps = [(2, "I", row, "u"), (2, "I", row, "a")] if len(out) < len(signature) + 3 else []
        if row < len(signature):
            kind = signature[row]
            steps.append((3, "D", row + 1, ""))
            if kind != "x":
                worse = kind.isupper() or kind == "+"
                steps += [(2 + worse, "R", row + 1, "u"), (2 + worse, "R", row + 1, "a")]
                steps += [(worse, "K", row + 1, kind.lower())] if kind.lower() in "sua" else []
        for more, letter, then, role in steps:
            if re.fullmatch("s?(ua)*u?", out + role):
                heapq.heappush(heap, (cost + more, audit + letter, then, out + role))


def test_solver_equals_search():
    for n in range(4):
        for signature in map("".join, itertools.product("suaUS-+x", repeat=n)):
            assert repair.solve(signature) == cheapest(signature), signature
    r = random.Random(1)
    for _ in range(60):
        signature = "".join(r.choice("suaUA-x") for _ in range(r.randint(4, 6)))
        assert repair.solve(signature) == cheapest(signature), signature


def test_solver_takes_long_conversations():
    cost, audit = repair.solve("ua" * 20_000 + "xs-")
    assert (cost, len(audit)) == (7, 40_003)


def repaired_by_hand(rows: list[tuple]) -> Counter:
    text_of = lambda v: " " if v is None else str(v)
    found = {}
    for conv, turn, role, text in rows:
        kept = found.setdefault(conv, [])
        role, text, kind = text_of(role), text_of(text), zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = Counter()
    for conv, kept in found.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, signature, faults = set(), "", Counter()
        for _, role, text in kept:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            known = role[:1] in ("s", "u", "a")
            signature += "x" if fault in ("blank", "duplicate") else role[0].upper() if fault and known else "+" if fault else role[0] if known else "-"
        cost, audit = cheapest(signature)
        turns = [t for t, _, _ in kept if t is not None]
        left, said, expected = iter(kept), [], "user"
        for letter in audit:
            _, role, text = (None, expected, "") if letter == "I" else next(left)
            if letter != "D":
                role = expected if letter == "R" else role
                said.append(f"{role}:{text}")
                expected = "assistant" if role[0] == "u" else "user"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[(conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(said)))] += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 500])
def test_repair_equals_hand_made(spark, tmp_path, n):
    r = random.Random(n)
    texts, roles = ["ok.", "ok", "", " ", None, "a!\n", "b?c", "é.", "\0", "x" * 9000], ["user", "assistant", "system", "user", "assistant", "", None, "tool", "User"]
    rows = [(r.choice([None, *range(120)]), r.choice([None, 0, 1, 2, 3, 7, -(2**40)]), r.choice(roles), r.choice(texts)) for _ in range(n)]
    rows = [x for x in rows if x[0] is not None or r.random() < 0.9]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.withColumns({"key": F.lit(1), "at": F.lit(1), "kind": F.lit(0), "Copy": F.lit(2)}).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert Counter(map(tuple, repair.op12_structure_repair(spark, str(tmp_path)).collect())) == repaired_by_hand(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (2, 0, "user", "a."), (2, 1, "user", "a.")]
    repaired, plans = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.key: (r.cost, r.audit) for r in plans.collect()} == {"1": (5, "IKD"), "2": (5, "KDI")}
    for key in ("1", "2"):
        roles = "".join(r.role[0] for r in repaired.filter(F.col("key") == key).collect())
        assert re.fullmatch("(s?(ua)+)?", roles)


ALPHABET = " \t\n\0aeiotnhsrABC,.▁Ａﬁé́ñ日本🙂①　 ­"


def varint(n: int) -> bytes:
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


@pytest.mark.parametrize("rule", [None, "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("switches", [b"", b"\x20\x01", b"\x18\x00\x20\x01"])  # as is; squeezing; without a space before
def test_pieces_and_spans_equal_the_library(rule, switches):
    import sentencepiece

    with open(pieces.MODEL, "rb") as file:
        raw = file.read()
    if rule:  # the same model with another compiled character map
        spec = dict(pieces.fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
        raw += b"\x1a" + varint(len(spec)) + spec
    raw += b"\x1a" + varint(len(switches)) + switches
    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.parse(raw)
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    r = random.Random(2)
    texts = ["", " ", "  ", "▁", " ▁ ", "<s>x</s><0x41>", "the " * 300 + "x" * 200] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 40))) for _ in range(400)]
    for text in texts:
        ids, starts, ends = encoder.encode(text.encode())
        want = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces], text
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want.pieces], text
        assert decoder.decode(ids.tolist()).decode() == library.decode(ids.tolist())


def test_decoding_any_ids_equals_the_library():
    import sentencepiece

    library, decoder = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.coder(pieces.MODEL)[1]
    r = random.Random(3)
    for _ in range(300):
        ids = [r.choice([1, 2, 28705, r.randrange(3, 259), r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randint(0, 12))]
        assert decoder.decode(ids).decode() == library.decode(ids), ids


def test_long_texts_and_both_ways_of_merging_agree(monkeypatch):
    encoder = pieces.Encoder(pieces.load(pieces.MODEL))
    text = ("wonderful things, unbelievable. " * 50).encode()
    whole = encoder.encode(text)
    monkeypatch.setattr(pieces, "LONGEST", 0)  # by the heap
    monkeypatch.setattr(pieces, "STRETCH", 10)
    again = pieces.Encoder(pieces.load(pieces.MODEL)).encode(text)
    assert all((a == b).all() for a, b in zip(whole, again))


def test_encoded_rows(spark, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [None, "", " ", "one two", "one two", "ä" * 70_000, "a\0b\n", "▁x"]
    rows = [(k if k % 3 else None, t, "x", "y") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, starts string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        want[(doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), len((text or "").encode()))] += 1
    assert Counter(map(tuple, pieces.op13_sentencepiece_spans(spark, str(tmp_path)).collect())) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert pieces.op13_sentencepiece_spans.__doc__ and pieces.encode_documents(docs.limit(0)).count() == 0
    back = pieces.decode_documents(pieces.encode_documents(docs).select("doc_id", "ids"))
    assert Counter(map(tuple, back.collect())) == Counter((d, (t or "").replace("▁", " ")) for d, t, *_ in rows)


def test_a_byte_of_no_character_is_one_character():
    text, at = pieces.characters(b"a\xffb\xc3\xa9\xe3\x81")
    assert (text, at.tolist()) == ("a�bé��", [0, 1, 2, 3, 5, 6, 7])
