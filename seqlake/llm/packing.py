"""Best-fit packing of token runs into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, runs, stage, table
from .tokens import VOCABULARY, count_tokens

#: Permitted sequence lengths in tokens, what a sequence costs besides its length, and the length at which attention
#: costs as much again as all that goes by the token.
SIZES, OVERHEAD, ATTENTION = (1024, 2048, 4096, 8192), 64, 24_576
#: Pieces that are packed together, about.
SHARD = 20_000


def bin_cost(size: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    """What a sequence of `size` tokens costs, in tokens: an overhead, the tokens, and attention, which goes by their square."""
    return overhead + size + size * size / attention


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """(bin, place in the bin) of each piece, and the size of each bin.

    Best fit, the longest piece first: a piece goes into the open bin whose free room it fills best, of several the
    first. Where none has the room, a bin is opened, of a size that goes by the least permitted size that holds the piece.
    These sizes are optimised together: from the largest pieces' to the smallest's, each is set to the permitted size
    with which all pieces, packed whole, cost least by bin_cost(), every bin downsized to the smallest permitted size
    for its contents; a tie goes to the smaller size. Pieces are at most the largest size long; those of one length go
    by position; pieces of no tokens join the first bin.
    """
    permitted = sorted(sizes)
    fitting = lambda n: permitted[bisect_left(permitted, n)]
    order = sorted((i for i in range(len(lengths)) if lengths[i]), key=lambda i: -lengths[i])

    def cost(opening: dict[int, int]) -> tuple[float, tuple[list[int], list[int], list[int]]]:
        packed = best_fit(lengths, order, permitted, opening)
        return sum(bin_cost(fitting(u), overhead, attention) for u in packed[2]), packed

    opening = {s: s for s in permitted}
    best = cost(opening)
    for least in sorted({fitting(lengths[i]) for i in order}, reverse=True):
        for size in permitted[permitted.index(least) + 1 :]:
            tried = cost(opening | {least: size})
            if tried[0] < best[0] - 1e-9:
                best, opening = tried, opening | {least: size}
    bins, places, used = best[1]
    return bins, places, [fitting(u) for u in used or [0] * bool(lengths)]


def best_fit(lengths: list[int], order: list[int], permitted: list[int], opening: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """(bin, place in the bin) of each piece and the tokens of each bin, pieces taken in the given order.

    `opening` says, by the least permitted size that holds a piece, of which size a bin is opened for it.
    """
    bins, places, used = [0] * len(lengths), [0] * len(lengths), []
    rooms: list[tuple[int, int]] = []  # free room and bin of every open bin, in order
    for i in order:
        n = lengths[i]
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            room, number = opening[permitted[bisect_left(permitted, n)]], len(used)
            used.append(0)
        bins[i], places[i] = number, used[number]
        used[number] += n
        if room > n:
            insort(rooms, (room - n, number))
    return bins, places, used


def pack_items(items: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> DataFrame:
    """Pieces of items(doc_id, n_tokens) with their bins: doc_id, piece, start, length, bin, bin_start, bin_size.

    An item longer than the largest size is cut into pieces of that size and a rest. The pieces are written down and
    dealt, by a hash of the place where they stand there, into groups of about SHARD, whose number follows their
    number, so items of one id and length spread like any others; each group is packed by pack(), and a group's last
    bins are all that the cut into groups costs. Items of no tokens (and null ones) are a piece of length 0; repeated
    rows are items of their own; an empty table gives no rows; other columns are ignored.
    """
    most, kind = max(sizes), items.schema["doc_id"].dataType.simpleString()
    whole = items.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(most).cast("long"))
    cut = whole.select("doc_id", "n", F.posexplode(starts).alias("piece", "start")).select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(most)).alias("length"))
    pieces = stage(cut.withColumn("at", F.monotonically_increasing_id()))
    groups = pieces.count() // SHARD + 1
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs(batches, "shard"):
            bins, places, found = pack(rows.column("length").to_pylist(), sizes, overhead, attention)
            extra = pa.table({"bin": [f"{shard}-{b}" for b in bins], "bin_start": pa.array(places, pa.int64()), "bin_size": pa.array([found[b] for b in bins], pa.int64())})
            for name in extra.column_names:
                rows = rows.append_column(name, extra.column(name))
            yield from rows.drop_columns(["shard", "at"]).combine_chunks().to_batches()

    ordered = dealt.repartition(min(groups, 8 * partitions(items.sparkSession)), "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "at")
    return ordered.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, bin string, bin_start long, bin_size long")


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, vocabulary: str = VOCABULARY) -> DataFrame:
    """pack_items() for the token counts that count_tokens() gives docs(doc_id, text); nulls, ties, repeats and empty tables as there."""
    return pack_items(count_tokens(docs, vocabulary), sizes)


def op5_variable_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() for all documents; nulls, ties, repeats and empty tables as in pack_items()."""
    return pack_documents(table(spark, sf_dir, "documents"))
