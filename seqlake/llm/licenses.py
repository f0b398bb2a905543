"""License phrases and license templates in texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, table

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Share of a template's different words that a block must contain.
CONTAINMENT = 0.8
#: Fixed texts of well-known license notices by label.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "Released under the MIT License",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "as-is": "The software is provided as is, without warranty of any kind, express or implied",
    "reserved-notice": "All rights reserved",
}

_KEEP = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP or c >= 128 else 32 for c in range(256))
_FOLD_LINES = _FOLD[:10] + b"\n" + _FOLD[11:]


def words(text: str) -> frozenset[bytes]:
    return frozenset(text.encode().translate(_FOLD).split())


def vocabulary(templates: dict[str, str] = TEMPLATES) -> dict[str, frozenset[bytes]]:
    """Each template's different words; templates of none match nothing and are left out."""
    return {label: found for label, text in templates.items() if (found := words(text))}


def window_words(templates: dict[str, str] = TEMPLATES) -> dict[str, int]:
    """Words of the windows that are held against each template: its own, and as many more as it may lack."""
    return {label: math.ceil(len(text.encode().translate(_FOLD).split()) / CONTAINMENT) for label, text in templates.items()}


def needed(size: int) -> int:
    """Words of a template of `size` words that a block must contain."""
    return math.ceil(CONTAINMENT * size - 1e-9)


def word_counts(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(word, n): in how many blocks of all texts each word of the templates stands; words in none are left out."""
    known = frozenset().union(*vocabulary(templates).values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(known, 0)
        for batch in batches:
            for text in blobs(batch.column(0)):
                for block in text.translate(_FOLD_LINES).split(b"\n"):
                    for word in known.intersection(block.split()):
                        seen[word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


class Join:
    """Containment join of a block with the templates: prefix, length and positional filters over one word order.

    Words stand in the order of their frequency, rarest first; those of no template are never ranked. A block that
    contains `needed` of a template's words contains one of its first size - needed + 1 words, and has one among its
    own first words, all but the least needed number less one (prefix filters). It has `needed` ranked words or more
    (length filter), and from the first common word on, at places p of the template and q of the block, both have
    `needed` words left (positional filter).
    """

    def __init__(self, frequency: dict[bytes, int], templates: dict[str, frozenset[bytes]] | None = None):
        templates = vocabulary() if templates is None else templates
        self.known = frozenset().union(*templates.values())
        self.rank = {w: k for k, w in enumerate(sorted(self.known, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets = templates
        self.index: dict[int, list[tuple[str, int, int]]] = {}
        for label, ws in templates.items():
            ranks = sorted(map(self.rank.__getitem__, ws))
            for place, rank in enumerate(ranks[: len(ranks) - needed(len(ranks)) + 1]):
                self.index.setdefault(rank, []).append((label, place, len(ranks)))
        self.keys = frozenset(w for w, k in self.rank.items() if k in self.index)
        self.least = min((needed(len(ws)) for ws in templates.values()), default=1)

    def candidates(self, inside: frozenset[bytes]) -> list[str]:
        """The templates that pass the filters for a block that has these words of theirs."""
        ranks = sorted(map(self.rank.__getitem__, inside))
        met, found = set(), []
        for q, rank in enumerate(ranks[: max(0, len(ranks) - self.least + 1)]):
            for label, place, size in self.index.get(rank, ()):
                if label not in met:
                    met.add(label)
                    if min(size - place, len(ranks) - q) >= needed(size):
                        found.append(label)
        return found

    def match(self, block: list[bytes]) -> dict[str, float]:
        """The containment of each template that reaches the threshold."""
        if self.keys.isdisjoint(block):
            return {}
        inside = self.known.intersection(block)
        shares = {label: len(inside & self.sets[label]) for label in self.candidates(inside)}
        return {label: n / len(self.sets[label]) for label, n in shares.items() if n >= needed(len(self.sets[label]))}


def across(flat: list[bytes], join: Join, spans: dict[str, int]) -> dict[str, float]:
    """The best containment of each template that reaches the threshold in a window of its span's words, wherever lines end."""
    found: dict[str, float] = {}
    for label in join.candidates(join.known.intersection(flat)):
        ws = join.sets[label]
        held: dict[bytes, int] = {}
        places = [(k, w) for k, w in enumerate(flat) if w in ws]
        first = best = 0
        for k, w in places:
            held[w] = held.get(w, 0) + 1
            while places[first][0] <= k - spans[label]:
                gone = places[first][1]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                first += 1
            best = max(best, len(held))
        if best >= needed(len(ws)):
            found[label] = best / len(ws)
    return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row's whole text.

    Blocks are the lines of a text and, over all its lines, the windows of a template's length and a quarter more
    (spans), so a notice is found however it is wrapped; a template's label is given if one block contains CONTAINMENT of its different
    words. score is the best containment of any template in any block, 1 where a base phrase stands, rounded to 6
    digits; templates under the threshold score 0. The frequencies that order the words come from every block of
    docs, but results don't depend on them. `templates` maps labels to texts; it goes to every task, so it is for
    hundreds of notices, not for a corpus. A null text has no words and null places; repeated rows repeat; ties don't
    matter; an empty table gives no rows; other columns are ignored.
    """
    frequency = {r["word"].encode(): r["n"] for r in word_counts(docs, templates).collect()}  # at most the templates' words
    phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join, spans = Join(frequency, vocabulary(templates)), window_words(templates)
        for batch in batches:
            rows = []
            for text in blobs(batch.column("text")):
                folded = text.translate(_FOLD_LINES)
                flat = folded.split()
                joined = b" " + b" ".join(flat) + b" "
                places, base = [], set()
                for phrase, label in phrases:
                    at, last, n = joined.find(phrase), 0, 0
                    while at >= 0:
                        n += joined.count(b" ", last, at)  # each stretch is counted once
                        places.append(n)
                        base.add(label)
                        at, last = joined.find(phrase, at + 1), at
                found: dict[str, float] = {}
                if not join.keys.isdisjoint(flat):
                    lines = [*map(bytes.split, folded.split(b"\n"))]
                    matches = [*map(join.match, lines), *[across(flat, join, spans)] * (len(lines) > 1)]
                    for label, share in chain.from_iterable(x.items() for x in matches):
                        found[label] = max(share, found.get(label, 0.0))
                score = 1.0 if base else round(max(found.values(), default=0.0), 6)
                rows.append((len(flat), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *found})), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents; nulls, ties, repeats and empty tables as there."""
    return scan(table(spark, sf_dir, "documents"))


def op8_sql() -> str:
    """The same by plain counting: every line, and every window over several lines, against every template."""
    spans = window_words(TEMPLATES)
    templates = ", ".join(f"('{label}', '{text.replace(chr(39), chr(39) * 2)}', {spans[label]})" for label, text in TEMPLATES.items())
    phrases = ", ".join(f"({list(p.split())}, '{label}')" for p, label in PHRASES.items())
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pick = lambda x: f"list_filter(regexp_split_to_array({lower(x)}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH templates AS (SELECT label, span, list_distinct({pick('text')}) AS ws FROM (VALUES {templates}) t(label, text, span)),
phrases AS (SELECT * FROM (VALUES {phrases}) t(ws, label)),
docs AS (SELECT doc_id, text, {pick("coalesce(text, '')")} AS ws FROM documents),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(docs.ws)), lambda i: docs.ws[i + 1] = phrases.ws[1] AND docs.ws[i + 1:i + len(phrases.ws)] = phrases.ws)) AS place
  FROM docs, phrases WHERE list_contains(docs.ws, phrases.ws[1])),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
blocks AS (SELECT doc_id, {pick('block')} AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS block FROM docs)),
windows AS (
  SELECT doc_id, label, tws, len(list_intersect(tws, dws[i + 1:i + span])) AS common FROM (
    SELECT doc_id, label, span, templates.ws AS tws, docs.ws AS dws, unnest(range(0, len(docs.ws))) AS i FROM docs, templates
    WHERE contains(text, chr(10)) AND len(list_intersect(templates.ws, docs.ws)) >= ceil({CONTAINMENT} * len(templates.ws) - 1e-9))),
compared AS (
  SELECT doc_id, label, templates.ws AS tws, len(list_intersect(templates.ws, blocks.ws)) AS common FROM blocks, templates
  UNION ALL SELECT * FROM windows),
hits AS (SELECT doc_id, label, max(common / len(tws)) AS share FROM compared WHERE common >= ceil({CONTAINMENT} * len(tws) - 1e-9) GROUP BY ALL),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hits) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE round(coalesce(share, 0)::DOUBLE, 6) END AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""
