"""Patterns of any length searched in a suffix order, through fences that part it into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .suffixes import kept, shared_prefix, suffix_ranks

#: Every FENCE-th suffix in order is a fence; fences and patterns are compared by DEPTH letters first, then by DEEPER times
#: as many wherever these don't tell; and a block that over CROWD patterns come to is given to several tasks.
FENCE, DEPTH, DEEPER, CROWD = 64, 32, 4, 100_000
#: A letter after all others.
LAST = 2**31 - 1


def compared(pattern: Column, suffix: Column) -> Column:
    """(lcp, sign): the letters that a pattern and a suffix share, and -1, 0 or 1 as the pattern comes before the suffix, begins it, or comes after it."""
    lcp = shared_prefix(pattern, suffix)
    sign = F.when(lcp == F.size(pattern), 0).when(lcp == F.size(suffix), 1).when(F.get(pattern, lcp) < F.get(suffix, lcp), -1).otherwise(1)
    return F.struct(lcp.cast("int").alias("lcp"), sign.alias("sign"))


def cut(sequences: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, head) of wanted(seq_id, pos, n, key): up to n letters of a sequence from pos on; each sequence is moved once."""
    asked = wanted.groupBy("seq_id").agg(F.collect_list(F.struct("pos", "n", "key")).alias("asked"))
    heads = F.transform("asked", lambda a: F.struct(a["key"].alias("key"), F.slice("letters", a["pos"] + 1, a["n"]).alias("head")))
    return sequences.select("seq_id", "letters").join(asked, "seq_id").select(F.explode(heads).alias("cut")).select("cut.*")


def _counted(rows: DataFrame) -> DataFrame:
    """rows(run, v, tie, ...) with `below`, the fences (tie 1) that come before each in its run, by v, then tie, then no.

    Rows are put in order over range partitions; what each partition has of each run is one row of a small table.
    """
    order = ("run", "v", "tie", "no")
    parts = kept(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    is_fence = (F.col("tie") == 1).cast("long")
    sums = parts.groupBy("run", "part").agg(F.sum(is_fence).alias("n"))
    before = sums.select("run", "part", (F.sum("n").over(Window.partitionBy("run").orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum(is_fence).over(Window.partitionBy("run", "part").orderBy("v", "tie", "no"))
    return parts.withColumn("within", within).join(before, ["run", "part"]).withColumn("below", F.col("before") + F.col("within"))


def routed(sequences: DataFrame, fences: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, side, key, below): how many of fences(no, seq_id, pos) come before each of keys(id, side, key).

    Both are cut to DEPTH letters and put in one order. A key that is longer and equals fences as far as that is between
    the first and the last of them; only these fences and keys are looked at again, with DEEPER times as many letters.
    """
    found, depth = None, DEPTH
    n = fences.count()
    open_ = keys.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(n).cast("long")})
    near = fences.withColumn("run", F.lit(0).cast("long"))
    while True:
        heads = cut(sequences, near.select("seq_id", "pos", F.lit(depth).alias("n"), F.struct("run", "no").alias("key")))
        fence = heads.select("key.run", F.col("head").alias("v"), F.lit(1).alias("tie"), "key.no", F.lit(None).cast(keys.select(F.struct("id", "side")).schema[0].dataType).alias("of"))
        asked = open_.select(F.col("low").alias("run"), F.slice("key", 1, depth).alias("v"), F.explode(F.array(F.lit(0), F.lit(2))).alias("tie"), F.lit(None).cast("long").alias("no"), F.struct("id", "side").alias("of"))
        counted = _counted(fence.unionByName(asked)).filter("of is not null")
        ends = counted.groupBy("of").agg(F.max(F.when(F.col("tie") == 0, F.col("below"))).alias("first"), F.max(F.when(F.col("tie") == 2, F.col("below"))).alias("last")).select("of.id", "of.side", "first", "last")
        told = kept(open_.join(ends, ["id", "side"]).select("id", "side", "key", (F.col("low") + F.col("first")).alias("low"), (F.col("low") + F.col("last")).alias("high")))
        settled = (F.size("key") <= depth) | (F.col("low") == F.col("high"))
        done = told.filter(settled).select("id", "side", "key", F.col("low").alias("below"))
        found = done if found is None else found.unionByName(done)
        open_ = told.filter(~settled)
        if open_.isEmpty():
            return found
        runs = open_.select("low", "high").distinct()  # fences alike so far, so no two overlap
        near = fences.join(runs.select(F.col("low").alias("run"), F.explode(F.sequence("low", F.col("high") - 1)).alias("no")), "no")
        depth *= DEEPER


def before(heads: list[np.ndarray], key: np.ndarray) -> int:
    """How many of the sorted heads come before the key; what both ends of the search share with it is skipped."""
    low, high, left, right = 0, len(heads), 0, 0
    while low < high:
        middle = (low + high) // 2
        head, same = heads[middle], min(left, right)
        size = min(len(head), len(key))
        differs = np.flatnonzero(head[same:size] != key[same:size])
        same = same + int(differs[0]) if len(differs) else size
        if head[same] < key[same] if same < size else len(head) < len(key):
            low, left = middle + 1, same
        else:
            high, right = middle, same
    return low


def _placed(rows: DataFrame) -> DataFrame:
    """(id, side, at): where keys belong among the suffixes of their block; a block's heads come before its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, heads = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            letters = batch.column("letters")
            for n, (block, part, rank, key, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "part", "rank", "id", "side")))):
                if mine != (block, part):
                    mine, heads = (block, part), []
                value = letters[n].values.to_numpy(zero_copy_only=False)
                if rank is not None:
                    heads.append(value)
                else:
                    out.append((key, side, block * FENCE + 1 + before(heads, value)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64()))], names=["id", "side", "at"])

    return rows.mapInArrow(run, "id long, side int, at long")


def pattern_ranges(sequences: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, a, b): the ranks of the suffixes that begin with each pattern(pattern) of any length; (1, 0) if none does.

    A pattern's range is where it and itself with a LAST letter belong in the suffix order. Every FENCE-th suffix is a
    fence; routed() finds the block between two fences to which each belongs, without any list of fences in one place,
    and a binary search in that block's suffixes, cut to the length of the longest pattern that comes to it, the place.
    Blocks that many patterns come to are dealt to several tasks. An empty pattern begins all suffixes, a null one none.
    """
    ranks = kept(suffix_ranks(sequences)[0].select("seq_id", "pos", "rank"))
    asked = kept(patterns.select("pattern").filter("pattern is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    letters = F.col("pattern").cast("array<int>")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), letters.alias("key")), F.struct(F.lit(1).alias("side"), F.concat(letters, F.array(F.lit(LAST))).alias("key")))).alias("one")
    keys = asked.select("id", sides).select("id", "one.side", "one.key")
    fences = ranks.filter(F.col("rank") % FENCE == 0).select((F.col("rank") / FENCE).cast("long").alias("no"), "seq_id", "pos")
    found = kept(routed(sequences, fences, keys))
    first = found.filter("below = 0").select("id", "side", F.lit(0).cast("long").alias("at"))
    inner = found.filter("below > 0").withColumn("block", F.col("below") - 1)
    blocks = kept(inner.groupBy("block").agg(F.max(F.size("key")).alias("n"), F.ceil(F.count("*") / CROWD).cast("int").alias("parts")))
    within = ranks.filter(F.col("rank") % FENCE != 0).withColumn("block", F.floor(F.col("rank") / FENCE)).join(blocks, "block")
    heads = cut(sequences, within.select("seq_id", "pos", "n", F.struct("block", "rank", "parts").alias("key")))
    each = F.explode(F.sequence(F.lit(0), F.col("key.parts") - 1)).alias("part")
    rows = heads.select("key.block", each, "key.rank", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("side"), F.col("head").alias("letters"))
    dealt = inner.join(blocks.select("block", "parts"), "block").select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(None).cast("long").alias("rank"), "id", "side", F.col("key").alias("letters"))
    together = rows.unionByName(dealt).repartition("block", "part").sortWithinPartitions("block", "part", F.col("rank").asc_nulls_last())
    at = _placed(together).unionByName(first)
    ends = at.groupBy("id").agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("at") - 1)).alias("b"))
    known = asked.join(ends.filter("a <= b"), "id")
    return patterns.join(known.select("pattern", "a", "b"), "pattern", "left").select("pattern", F.coalesce("a", F.lit(1)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
