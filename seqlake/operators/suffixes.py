"""Suffix order and places in concatenated sequences."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed letters between concatenated sequences, and at their end.
DELIMITER, SENTINEL = 4000, 4001


#: Letters up to which whole suffixes are compared at once; and, where a sequence is longer, those of the first
#: comparison, each later one being of twice as many.
WHOLE, FIRST = 256, 32


def kept(df: DataFrame) -> DataFrame:
    """df worked out once and written to the session's checkpoint folder, so that lost executors cost no more than a read.

    A session of one machine that has none gets one of its own; a cluster without one is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their number from 0 by the given columns.

    Range partitions are counted first, so that no task sees all rows.
    """
    parts = kept(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")  # a row a partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.withColumn("within", within).join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("within") - 1).drop("part", "within", "before")


def openings(sequences: DataFrame, depth: int) -> DataFrame:
    """(seq_id, pos, rest, head) of every position: how many letters there are from it on, and the first `depth` of them."""
    cut = F.transform(F.sequence(F.lit(0), F.size("letters") - 1), lambda p: F.slice("letters", p + 1, F.lit(depth)))
    rows = sequences.filter(F.size("letters") > 0).select("seq_id", F.size("letters").alias("n"), F.posexplode(cut).alias("pos", "head"))
    return rows.select("seq_id", "pos", (F.col("n") - F.col("pos")).alias("rest"), "head")


def suffix_ranks(sequences: DataFrame, levels: list[tuple[int, DataFrame]] | None = None) -> tuple[DataFrame, int]:
    """(seq_id, pos, rest, place, rank) of every position, and the letters after which no order changes.

    rank, from 0, is by suffix, seq_id and pos; place is alike for equal suffixes of over WHOLE letters. Prefix doubling:
    positions placed by their first h letters are placed by 2h with the place h further on, until that parts none any
    more, so a row holds two numbers, however long its suffix is. `levels`, if given, takes (h, places) of each h.
    """
    longest = sequences.agg(F.max(F.size("letters"))).first()[0] or 1
    if longest <= WHOLE:
        ranks = numbered(openings(sequences, longest), "rank", "head", "seq_id", "pos")
        return ranks.select("seq_id", "pos", "rest", F.col("rank").alias("place"), "rank"), longest
    rows, h = openings(sequences, FIRST), FIRST
    places = numbered(rows.select("head").distinct(), "place", "head")
    rows = kept(rows.join(places, "head").select("seq_id", "pos", "rest", "place"))
    different = rows.select("place").distinct().count()
    while True:
        if levels is not None:
            levels.append((h, rows))
        then = F.coalesce(F.lead("place", h).over(Window.partitionBy("seq_id").orderBy("pos")), F.lit(-1))
        both = rows.withColumn("then", then)
        places = numbered(both.select("place", "then").distinct(), "finer", "place", "then")
        finer = kept(both.join(places, ["place", "then"]).select("seq_id", "pos", "rest", F.col("finer").alias("place")))
        rows, now = finer, finer.select("place").distinct().count()
        h *= 2
        if now == different:
            return numbered(rows, "rank", "place", "seq_id", "pos"), h
        different = now


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(a, i) != F.element_at(b, i))
    return F.coalesce(F.array_min(differs) - 1, n)


def neighbour_prefixes(sequences: DataFrame) -> DataFrame:
    """(seq_id, pos, rank, lcp): what each suffix shares with the one before it in rank; equal ones share all they have, the first nothing.

    The levels of the prefix doubling are descended: two suffixes that are placed alike by their first h letters share
    those, and go on h letters further at the next lower level. So rows hold numbers, but for the FIRST letters that the
    lowest level leaves, however long a repeat is.
    """
    levels: list[tuple[int, DataFrame]] = []
    ranks, depth = suffix_ranks(sequences, levels)
    if not levels:  # whole suffixes, of WHOLE letters at most
        rows = kept(ranks.join(openings(sequences, depth).select("seq_id", "pos", "head"), ["seq_id", "pos"]))
        before = rows.select((F.col("rank") + 1).alias("rank"), F.col("head").alias("last"))
        lcp = F.when(F.col("last").isNull(), 0).otherwise(shared_prefix(F.col("head"), F.col("last")))
        return rows.join(before, "rank", "left").select("seq_id", "pos", "rank", lcp.cast("int").alias("lcp"))
    before = ranks.select((F.col("rank") + 1).alias("rank"), F.col("seq_id").alias("last_id"), F.col("pos").alias("last_pos"), F.col("place").alias("last_place"))
    pairs = ranks.join(before, "rank", "left")
    equal = F.col("place") == F.col("last_place")  # wholly
    pairs = pairs.withColumn("lcp", F.when(F.col("last_id").isNull(), 0).when(equal, F.col("rest"))).select("seq_id", "pos", "rank", "last_id", "last_pos", "lcp")
    done = pairs.filter("lcp is not null").select("seq_id", "pos", "rank", F.col("lcp").cast("int").alias("lcp"))
    open_ = kept(pairs.filter("lcp is null").select("seq_id", "pos", "rank", "last_id", "last_pos", F.lit(0).alias("lcp")))

    def beside(rows: DataFrame, there: DataFrame, value: str) -> DataFrame:
        """rows with `mine` and `theirs`, what `there`(seq_id, pos, value) has as far on in the two suffixes as they agree."""
        for key, place, name in (("seq_id", "pos", "mine"), ("last_id", "last_pos", "theirs")):
            found = there.select(F.col("seq_id").alias("key"), F.col("pos").alias("at"), F.col(value).alias(name))
            rows = rows.join(found, (F.col(key) == F.col("key")) & (F.col(place) + F.col("lcp") == F.col("at")), "left").drop("key", "at")
        return rows

    for h, places in reversed(levels):
        agreed = F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False))  # past an end there is nothing
        open_ = kept(beside(open_, places, "place").withColumn("lcp", F.col("lcp") + F.when(agreed, h).otherwise(0)).drop("mine", "theirs"))
    none = F.array().cast("array<int>")
    rest = shared_prefix(F.coalesce("mine", none), F.coalesce("theirs", none))
    last = beside(open_, openings(sequences, FIRST), "head").select("seq_id", "pos", "rank", (F.col("lcp") + rest).cast("int").alias("lcp"))
    return done.unionByName(last)


def starts(sequences: DataFrame) -> DataFrame:
    """(seq_id, start, end): the places of sequences in their concatenation by seq_id, each with a delimiter after it."""
    sizes = kept(sequences.select("seq_id", (F.size("letters") + 1).cast("long").alias("n")).repartitionByRange("seq_id").withColumn("part", F.spark_partition_id()))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))  # a row a partition
    end = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("seq_id"))
    return sizes.join(F.broadcast(before), "part").select("seq_id", (end - F.col("n")).alias("start"), (end - 2).alias("end"))


#: Places that an as-of lookup takes together; an interval is carried on from cell to cell.
CELL = 1 << 16


def last_before(keys: DataFrame, asked: DataFrame, carried: str) -> DataFrame:
    """asked(v, ...) with the column `carried` of the row of keys(v, carried) of the greatest v that isn't over its own; else null.

    Both sides are put in one order, cell by cell of CELL values; the last key of each cell is carried on to the next one
    of CELL cells, and the last of those to the next such.
    """
    extra = [c for c in asked.columns if c != "v"]
    both = keys.select("v", F.struct("v", carried).alias("key"), F.lit(None).cast(asked.select(F.struct(*asked.columns)).schema[0].dataType).alias("row"))
    both = both.unionByName(asked.select("v", F.lit(None).cast(both.schema["key"].dataType).alias("key"), F.struct(*asked.columns).alias("row"))).withColumn("cell", F.floor(F.col("v") / CELL))
    within = F.last("key", ignorenulls=True).over(Window.partitionBy("cell").orderBy("v", F.col("key").isNull()))
    tops = both.groupBy("cell").agg(F.max("key").alias("top")).withColumn("block", F.floor(F.col("cell") / CELL))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = tops.groupBy("block").agg(F.max("top").alias("last"))
    blocks = blocks.select("block", F.max("last").over(so_far(Window.orderBy("block"))).alias("last"))  # a row for CELL ** 2 values
    inner = F.max("top").over(so_far(Window.partitionBy("block").orderBy("cell")))
    before = tops.withColumn("inner", inner).join(blocks, "block").select("cell", F.coalesce("inner", "last").alias("earlier"))
    found = both.withColumn("own", within).join(before, "cell").filter("row is not null")
    return found.select("row.v", *(f"row.{c}" for c in extra), F.coalesce("own", "earlier")[carried].alias(carried))


def locate(places: DataFrame, at: DataFrame) -> DataFrame:
    """(place, seq_id, pos): the sequence that owns each place, the last that starts before it; delimiters own nothing."""
    keys = at.select(F.col("start").alias("v"), F.struct("seq_id", "start", "end").alias("owner"))
    found = last_before(keys, places.select(F.col("place").cast("long").alias("v")), "owner")
    return found.filter("v <= owner.end").select(F.col("v").alias("place"), "owner.seq_id", (F.col("v") - F.col("owner.start")).alias("pos"))


def concatenated(sequences: DataFrame) -> DataFrame:
    """(place, letter) of all sequences after each other, delimiters between them and the sentinel at the end."""
    at = starts(sequences)
    last = at.agg(F.max("start").alias("last"))
    ended = F.concat("letters", F.array(F.when(F.col("start") == F.col("last"), SENTINEL).otherwise(DELIMITER)))
    return sequences.join(at, "seq_id").crossJoin(F.broadcast(last)).select("start", F.posexplode(ended).alias("i", "letter")).select((F.col("start") + F.col("i")).alias("place"), "letter")
