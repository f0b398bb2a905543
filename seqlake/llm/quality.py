"""Quality rules: fixed limits, then robust multivariate outliers within each language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blobs, drop_rows, stage, table, text_hash, unstage

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Transformed statistics of a text, and the least standard deviation that each is taken to have.
FEATURES = {"x_length": 0.6, "x_words": 0.08, "x_symbols": 0.06, "x_lines": 0.1, "x_repeats": 0.1, "x_upper": 0.08, "x_marks": 0.12, "x_digits": 0.1, "x_stutter": 0.1}
#: A group of fewer texts is pooled with its language's, and then with all such.
GROUP = 100
#: Share of a group's different statistics that the determinant is minimised over, concentration steps of each start,
#: by how much the best start's log determinant has to fall for another step, and the distance that rejects.
SHARE, STEPS, FALL, CUTOFF = 0.5, 2, 1e-3, 7.0

#: Estimates (about 1 KB each) that are broadcast to the rows; more of them are joined, a hot group's rows dealt to SALTS keys.
MODELS, SALTS = 10_000, 64

_SYMBOLS = b"#*$%&|<>"
_NO_SYMBOL = bytes(range(256))


def _repeated(words: list[bytes], size: int) -> int:
    """Words inside windows of `size` words that stand twice or more in the text, the first time included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper, marks, digits, stutter) of a whole text."""
    words = text.split()
    joined = b"".join(words)
    readable = joined.decode()
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = len(text) - len(text.translate(_NO_SYMBOL, _SYMBOLS))
    lower = readable.replace("\u0130", "i").lower()  # the one letter whose lower case is longer
    upper = sum(map(str.__ne__, readable, lower)) if readable != lower else 0
    marks = len(joined) - len(joined.translate(_NO_SYMBOL, b"!?;:^~_=+/\\()[]{}\"'`@"))
    digits = len(joined) - len(joined.translate(_NO_SYMBOL, b"0123456789"))
    return len(words), len(readable), symbols, len(lines) - len(set(lines)), _repeated(words, WINDOW), upper, marks, digits, sum(map(bytes.__eq__, words, words[1:]))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper", "marks", "digits", "stutter")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, pos and the counts of every row's whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t) for t in blobs(batch.column("text"))]
            arrays = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), batch.column("h"), *arrays], names=["doc_id", "lang", "source", "h", *_COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), text_hash().alias("h"))
    return found.mapInArrow(run, f"doc_id {kind}, lang string, source string, h long, " + ", ".join(f"{c} long" for c in _COUNTS))


def _features() -> dict[str, Column]:
    """Transformations that make clean texts' statistics about normal, on a grid so that sums come out alike."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = {
        "x_length": F.log(words),
        "x_words": F.log(chars / words),
        "x_symbols": F.sqrt(F.col("n_symbols") / words),
        "x_lines": F.sqrt(F.col("n_dup_lines") / words * 10),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
        "x_upper": F.sqrt(F.col("upper") / chars),
        "x_marks": F.sqrt(F.col("marks") / words),
        "x_digits": F.sqrt(F.col("digits") / chars),
        "x_stutter": F.sqrt(F.col("stutter") / words),
    }
    return {name: F.round(x * 1024) / 1024 for name, x in raw.items()}


def _quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of a grid-valued column by key, from counts of its values."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    within = Window.partitionBy(*keys)
    ranked = n.withColumn("below", F.sum("n").over(within.orderBy(value))).withColumn("all", F.sum("n").over(within))
    return ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("below") >= F.col("all") * q, F.col(value))).alias(a) for a, q in shares.items()))


def _start(df: DataFrame) -> DataFrame:
    """(g, s, m, p): the starts s of each group, its quartiles, and the inverse of a diagonal covariance from them."""
    names = list(FEATURES)
    long = df.select("g", F.posexplode(F.array(*names)).alias("f", "x"))
    found = _quantiles(long, ["g", "f"], "x", {"low": 0.25, "mid": 0.5, "high": 0.75})
    floors = F.array(*(F.lit(x) for x in FEATURES.values()))
    sd = F.greatest((F.col("high") - F.col("low")) / 1.349, floors[F.col("f")])
    by = found.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("f", "low", "mid", "high", sd.alias("sd")))).alias("a"))
    n = range(len(names))
    diagonal = F.array(*(F.when(F.lit(i == j), 1 / F.col("a")[i]["sd"] ** 2).otherwise(0.0) for i in n for j in n))
    starts = F.array(*(F.col(f"a.{x}") for x in ("mid", "low", "high")))
    return by.select("g", F.posexplode(starts).alias("s", "m"), diagonal.alias("p"))


def _beside(df: DataFrame, other: DataFrame, key: str, n: int) -> DataFrame:
    """df beside the rows of other (n of them, staged) of the same key: broadcast if they are few, else joined by salted keys."""
    other = other.withColumnRenamed(key, "_key")
    if n <= MODELS:
        return df.join(F.broadcast(other), F.col(key) == F.col("_key")).drop("_key")
    salted = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int")
    return df.withColumn("_own", own).join(salted, (F.col(key) == F.col("_key")) & (F.col("_own") == F.col("_salt"))).drop("_key", "_own", "_salt")


def _distance(df: DataFrame, models: DataFrame, size: int) -> DataFrame:
    """df with d2, the squared Mahalanobis distance from its group's estimate, of which there are `size`."""
    n = len(FEATURES)
    off = ", ".join(f"{x} - m[{i}]" for i, x in enumerate(FEATURES))
    terms = " + ".join(f"{1 if i == j else 2} * o[{i}] * o[{j}] * p[{i * n + j}]" for i in range(n) for j in range(i, n))
    return _beside(df, models, "g", size).withColumn("o", F.expr(f"array({off})")).withColumn("d2", F.expr(f"greatest(0.0D, {terms})")).drop("o", "m", "p")


def _concentrate(df: DataFrame, models: DataFrame, size: int) -> DataFrame:
    """A concentration step of each start: (g, s, det, m, p) of the SHARE of each group that is nearest by the last estimate.

    One pass adds up counts, sums and products by group, start and distance (in bins of a thirty-second of its
    logarithm, whose ties share a fate); the nearest bins' make the estimate. The covariance is scaled by what makes
    the nearest half of a normal sample consistent; the floors of FEATURES are added to its diagonal, so that
    statistics which don't vary (no symbols at all) can be inverted. det is the logarithm of its determinant.
    """
    names = list(FEATURES)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = ["count(*) AS n", *(f"sum({x}) AS t{i}" for i, x in enumerate(names)), *(f"sum({names[i]} * {names[j]}) AS q{k}" for k, (i, j) in enumerate(pairs))]
    binned = _distance(df, models, size).withColumn("bin", F.expr("floor(ln(d2 + 1e-6) * 32)")).groupBy("g", "s", "bin").agg(*map(F.expr, sums))
    near = binned.withColumns({"upto": F.expr("sum(n) OVER (PARTITION BY g, s ORDER BY bin)"), "all": F.expr("sum(n) OVER (PARTITION BY g, s)")}).filter(f"upto - n < {SHARE} * all")
    moments = [f"t{i}" for i in range(len(names))], [f"q{k}" for k in range(len(pairs))]
    kept = near.groupBy("g", "s").agg(F.expr("sum(n) AS n"), *(F.expr(f"array({', '.join(f'sum({c})' for c in columns)}) AS {name}") for name, columns in zip(("t", "ss"), moments)))
    floors = np.array(list(FEATURES.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            means, inverses, dets = [], [], []
            for r in rows:
                mean = np.array(r["t"]) / r["n"]
                second = np.zeros((len(names), len(names)))
                for (i, j), x in zip(pairs, r["ss"]):
                    second[i, j] = second[j, i] = x / r["n"]
                cov = (second - np.outer(mean, mean)) * _CONSISTENT + np.diag(floors**2)
                means.append(mean.tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
                inverses.append(np.linalg.inv(cov).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("s"), pa.array(dets, pa.float64()), pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], names=["g", "s", "det", "m", "p"])

    return kept.mapInArrow(run, "g string, s int, det double, m array<double>, p array<double>")


def _estimate(grouped: DataFrame) -> DataFrame:
    """(g, s, det, m, p) of each group of the least determinant that concentration finds from several starts.

    Equal statistics, those of copies, count once. Every start takes STEPS steps; the best of each group goes on until
    no group's determinant falls any more.
    """

    def best(models: DataFrame) -> DataFrame:
        return models.groupBy("g").agg(F.min(F.struct("det", "s", "m", "p")).alias("x")).select("g", "x.s", "x.det", "x.m", "x.p")

    once = stage(grouped.select("g", *FEATURES).distinct())
    model = stage(_start(once))
    size = model.count()
    for _ in range(STEPS):
        model = stage(_concentrate(once, model, size))
    model = stage(best(model))
    while True:
        nearer = stage(best(model.unionByName(_concentrate(once, model, size))))
        falls = nearer.alias("a").join(model.alias("b"), "g").filter(F.col("a.det") <= F.col("b.det") - FALL)
        if falls.isEmpty():
            unstage(once)
            return nearer
        model = nearer


#: What the covariance of the nearest half of a 9-dimensional normal sample is to be multiplied by.
_CONSISTENT = 1.57


def judge(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, h (hash of the text), counts, base_failed and kept.

    base_failed: fewer than LEAST_WORDS words, or over MOST_REPEATED % of the words in repeated windows. The rest are
    held against minimum-covariance-determinant estimates of half of their language and source: coordinate-wise medians
    and quartiles start it, concentration steps follow (_estimate), copies count once, all by distributed sums and
    histograms (no group is gathered), and a Mahalanobis distance over CUTOFF rejects. Groups of under GROUP texts are pooled. A null
    lang or source is a group value like another; null texts fail; ties share a histogram bin and so one fate;
    repeated rows are judged alike; an empty table gives no rows.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = stage(statistics(docs).withColumn("base_failed", base))
    usable = counted.filter("not base_failed").select("doc_id", "h", "lang", "source", *(x.alias(name) for name, x in _features().items()))
    lang, source = F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))
    named = usable.withColumns({"gl": lang, "gs": F.concat_ws("\1", lang, source)})
    sizes = named.groupBy("gl", "gs").agg(F.count("*").alias("n"))
    small = F.sum(F.when(F.col("n") < GROUP, F.col("n")).otherwise(0)).over(Window.partitionBy("gl"))
    groups = stage(sizes.select("gs", F.when(F.col("n") >= GROUP, F.col("gs")).when(small >= GROUP, F.col("gl")).otherwise("\2").alias("g")))
    grouped = stage(_beside(named, groups, "gs", groups.count()).select("doc_id", "h", "g", *FEATURES))
    models = _estimate(grouped)
    far = _distance(grouped, models, models.count()).filter(F.col("d2") > CUTOFF**2).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct().withColumn("out", F.lit(True))
    joined = counted.join(far, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return joined.select("doc_id", "h", *_COUNTS[:5], "base_failed", (~F.col("base_failed") & F.col("out").isNull()).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names.

    Null texts go, as they fail the base rules; rows of equal (or null) doc_id and text share a fate; ties and empty
    tables are as in judge().
    """
    return drop_rows(docs, judge(docs).filter("not kept"))


def op3_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all documents; nulls, ties, repeats and empty tables as there."""
    return judge(table(spark, sf_dir, "documents")).drop("h")
