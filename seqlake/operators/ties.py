"""Ranks of numbers that count as equal when they are close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .suffixes import kept


def close_ranks(rows: DataFrame, value: str, epsilon: float, *by: str) -> DataFrame:
    """rows with `chain` and `rank` of their value, from 0 and 1, among the rows of the same `by`.

    Values in order make a chain as long as each is at most epsilon more than the one before it; the rows of a chain are
    tied, and their rank is one more than the number of rows before the chain. Rows without a value have neither; nulls
    in `by` are a value like others. No task sees all rows of a group: they are put in order over range partitions, and
    of each partition and group its ends, its number of rows and chains, and where its last chain begins are carried on.
    """
    order = [F.col(c).asc_nulls_first() for c in (*by, value)]
    real = rows.filter(F.col(value).isNotNull())
    parts = kept(real.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*by, "_part").orderBy(value)
    before, ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), [F.col(c) for c in by]
    ends = parts.groupBy(*by, "_part").agg(F.max(value).alias("_top"), F.count("*").alias("_n"))
    ends = ends.select(*ahead, "_part", F.max("_top").over(before).alias("_under"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"))
    same = lambda a, b: _all(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_part"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        more = [c for c in right.columns if c not in by and c != "_part"]
        return left.alias("a").join(right.alias("b"), same(left, right)).select("a.*", *(f"b.{c}" for c in more))

    last = F.coalesce(F.lag(value).over(here), F.col("_under"))
    opens = F.when(last.isNull() | (F.col(value) - last > epsilon), 1).otherwise(0)
    marked = kept(beside(parts, ends).withColumn("_opens", opens).withColumn("_place", F.col("_rows") + F.row_number().over(here)))
    starts = marked.groupBy(*by, "_part").agg(F.sum("_opens").alias("_chains"), F.max(F.when(F.col("_opens") == 1, F.col("_place"))).alias("_start"))
    starts = starts.select(*ahead, "_part", F.coalesce(F.sum("_chains").over(before), F.lit(0)).alias("_chains"), F.max("_start").over(before).alias("_start"))
    along = Window.partitionBy(*by, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.max(F.when(F.col("_opens") == 1, F.col("_place"))).over(along)
    done = beside(marked, starts).withColumns({"chain": F.col("_chains") + F.sum("_opens").over(along) - 1, "rank": F.coalesce(own, F.col("_start"))})
    none = rows.filter(F.col(value).isNull()).withColumns({"chain": F.lit(None).cast("long"), "rank": F.lit(None).cast("long")})
    return done.select(*rows.columns, "chain", "rank").unionByName(none)


def _all(conditions) -> F.Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
