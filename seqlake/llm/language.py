"""Language identification as a mixture of languages within each text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage, table

#: Hash buckets of letter trigrams, what is added to each one's count, and bytes of text times languages in a chunk.
BUCKETS, SMOOTH, CHUNK = 1 << 16, 0.1, 1 << 22
#: Rounds of expectation-maximisation, and the penalty's weight.
ROUNDS, PENALTY = 12, 1.5
#: Languages of one part of a model: BUCKETS numbers each are what comes to the driver and goes to tasks at a time.
LANGUAGES = 256

#: The languages of a model's part, sorted, and their log probabilities of each bucket.
Part = tuple[list[str], np.ndarray]


@cache
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, text) of each letter: its trigram's bucket and the numbers of its word and text.

    A trigram is a lower-case letter with its neighbours, of which those that are no letters count alike.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    clean = np.where(letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    mixed = (clean[at - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (clean[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (clean[at + 1] * np.uint64(0x165667B19E3779F9))
    mixed *= np.uint64(0xFF51AFD7ED558CCD)
    bucket = (mixed >> np.uint64(48)).astype(np.int64)
    word = np.cumsum(~letter[at - 1]) - 1
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[at - 1]
    return bucket, word, text


def learn(docs: DataFrame) -> list[Part]:
    """A model of the languages of docs(text, lang), in parts of LANGUAGES languages, those of most texts first.

    Counts cover all rows and every lang, however many there are: of each a name, and a part at a time BUCKETS numbers,
    come to the driver. Null langs and texts teach nothing; repeated rows teach as often; an empty table teaches no
    language (one part without any); other columns are ignored.
    """
    taught = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null")
    names = [r["lang"] for r in taught.groupBy("lang").count().orderBy(F.desc("count"), "lang").toLocalIterator()]
    parts = [names[k : k + LANGUAGES] for k in range(0, len(names), LANGUAGES)] or [[]]
    return [_learn(taught if len(parts) == 1 else taught.filter(F.col("lang").isin(part))) for part in parts]


def _learn(taught: DataFrame) -> Part:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", CHUNK // 4):
            langs = batch.column("lang").to_pylist()
            bucket, _, text = trigrams(batch.column("text").to_pylist())
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])[text] if len(text) else np.zeros(0, np.int64)
            for k, name in enumerate(names):
                seen.setdefault(name, np.zeros(BUCKETS, np.int64))
                seen[name] += np.bincount(bucket[code == k], minlength=BUCKETS)
        for name, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    summed = taught.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    place = {x: k for k, x in enumerate(names)}
    counts[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return names, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)


def _maximise(likelihood: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's proportions of its allowed languages by expectation-maximisation over its words, and its log likelihood."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = likelihood * np.repeat(share, size, axis=0)
        joint /= joint.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(joint, first) / size[:, None]
    total = np.log((likelihood * np.repeat(share, size, axis=0)).sum(axis=1) + 1e-300)
    return share, np.add.reduceat(total, first)


def mixtures(texts: list[str], logs: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """The proportions of the languages that each text is found to have, None without letters, and their penalised likelihoods.

    Words are the mixture's observations: a word's likelihood in a language is that of its trigrams. Texts start with
    all languages; then the likelihood of their most likely k languages, less PENALTY * (k - 1) * log(words), chooses
    k, out of every number up to that of the languages with a share of note. Equal values go to fewer languages.
    """
    bucket, word, text = trigrams(texts)
    out: list[np.ndarray | None] = [None] * len(texts)
    values = np.full(len(texts), -np.inf)
    if not len(bucket) or not logs.shape[1]:
        return out, values
    begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    scores = np.add.reduceat(logs[bucket], begins).astype(np.float64)
    peak = scores.max(axis=1)
    likelihood = np.maximum(np.exp(scores - peak[:, None]), 1e-12)
    owner = text[begins]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    present, size = owner[first], np.diff(np.append(first, len(owner)))
    languages = logs.shape[1]
    share, _ = _maximise(likelihood, first, size, np.ones((len(first), languages)))
    singles = np.add.reduceat(np.log(likelihood), first)
    order = np.argsort(-share, axis=1, kind="stable")
    best = np.zeros_like(share)
    alone = singles.argmax(axis=1)
    best[np.arange(len(best)), alone] = 1.0
    value = singles.max(axis=1)
    of_note = (share > (0.5 / np.maximum(size, 25))[:, None]).sum(axis=1)
    for k in range(2, int(of_note.max()) + 1):
        tried_at = np.flatnonzero(of_note >= k)
        allowed = np.zeros((len(tried_at), languages))
        np.put_along_axis(allowed, order[tried_at, :k], 1.0, axis=1)
        rows = np.concatenate([np.arange(first[d], first[d] + size[d]) for d in tried_at])
        sizes = size[tried_at]
        tried, total = _maximise(likelihood[rows], np.cumsum(sizes) - sizes, sizes, allowed)
        total = total - PENALTY * (k - 1) * np.log(sizes + 1)
        better = total > value[tried_at]
        value[tried_at[better]] = total[better]
        best[tried_at[better]] = tried[better]
    for k, d in enumerate(present):
        out[d] = best[k]
    values[present] = value + np.add.reduceat(peak, first)
    return out, values


def identify(docs: DataFrame, model: list[Part]) -> DataFrame:
    """(doc_id, lang_pred, score, languages) of every row's whole text under a model of learn().

    lang_pred is the language of the largest proportion, the first by name of several; `und` if a text is null or has
    no letter, or nothing was learnt. score is its proportion, 0 for `und`; languages lists all of the chosen set. A
    model of several parts is a pass over the texts for each, whose languages are sought alone; the part whose choice
    has the greatest penalised likelihood counts, the first of equals. Repeated rows repeat; an empty table gives no
    rows; lang and source, like other columns, are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judged(rows: DataFrame, part: Part) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(part)  # BUCKETS numbers a language, LANGUAGES at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, logs = shared.value
            for batch in slices(batches, "text", max(1 << 16, CHUNK // max(4, len(names)))):
                found, values = mixtures([t or "" for t in batch.column("text").to_pylist()], logs)
                pred = ["und" if x is None else names[int(x.argmax())] for x in found]
                score = [0.0 if x is None else min(1.0, float(x.max())) for x in found]
                several = ["" if x is None else ",".join(names[k] for k in np.flatnonzero(x > 0)) for x in found]
                arrays = [pa.array(pred), pa.array(score), pa.array(several), pa.array(values)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, batch.column("row")], names=["doc_id", "lang_pred", "score", "languages", "value", "row"])

        return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages string, value double, row long")

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if len(model) == 1:
        return judged(rows.withColumn("row", F.lit(0).cast("long")), model[0]).drop("value", "row")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    every = [judged(rows, part).withColumn("part", F.lit(-k)) for k, part in enumerate(model)]
    best = F.max(F.struct("value", "part", "doc_id", "lang_pred", "score", "languages")).alias("best")
    return reduce(DataFrame.unionByName, every).groupBy("row").agg(best).select("best.doc_id", "best.lang_pred", "best.score", "best.languages")


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() for all documents, by what three quarters of them teach; nulls, ties, repeats and empty tables as there.

    A null doc_id counts as an empty one when the quarters are told apart.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return identify(docs, learn(docs.filter(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")
