"""Shards of bounded size by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table, unstage

#: Bits of a hash, and bytes of a shard at most, by default and in the registered query (whose shards are small for its small tables).
BITS, LIMIT, QUERY_LIMIT = 60, 16 << 20, 256 << 10
#: Bits that a later round adds for buckets that are still too large.
STEP = 12


def hash_bits(value: Column) -> Column:
    """The first BITS bits of a string's MD5 as a long; null hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h: str, depth: int | Column) -> Column:
    return F.expr(f"shiftrightunsigned({h}, {BITS} - {depth})") if isinstance(depth, int) else F.call_function("shiftrightunsigned", F.col(h), F.lit(BITS) - depth)


def _bits(value: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(value), depth, "0"))


def _leaves(rows: DataFrame, h: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (with path, n_bytes, h) with their bucket's bits added to path, depth and shard_bytes; and rows left over.

    A round sums bytes by path and the hash's first `to` bits (a cell), then those sums by each shorter prefix. A bucket
    is a prefix that fits the limit while the prefix one bit shorter does not; cells find theirs by joining on each of
    their prefixes, so no bucket's cells ever meet in one row. Only rows of cells that don't fit go on to the next
    round. What is left over agrees in every bit.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done: list[DataFrame] = []
    start, to = 0, min(BITS, math.ceil(math.log2(max(1, total / limit))) + 4)
    while True:
        cells = stage(rows.groupBy("path", _prefix(h, to).alias("cell")).agg(F.sum("n_bytes").alias("n")))
        levels = cells.select("path", "cell", "n", F.explode(F.sequence(F.lit(start), F.lit(to))).alias("d")).withColumn("bucket", F.call_function("shiftrightunsigned", F.col("cell"), F.lit(to) - F.col("d")))
        sums = stage(levels.groupBy("path", "d", "bucket").agg(F.sum("n").alias("shard_bytes")))
        split = sums.filter((F.col("shard_bytes") > limit) & (F.col("d") < to)).select("path", (F.col("d") + 1).alias("d"), F.col("bucket").alias("above"))
        fits = sums.filter(F.col("shard_bytes") <= limit).withColumn("above", F.call_function("shiftrightunsigned", F.col("bucket"), F.lit(1)))
        leaves = fits.filter(F.col("d") == start).drop("above").unionByName(fits.filter(F.col("d") > start).join(split, ["path", "d", "above"], "left_semi").drop("above"))
        found = levels.select("path", "cell", "d", "bucket").join(leaves, ["path", "d", "bucket"]).select("path", "cell", F.struct("d", "bucket", "shard_bytes").alias("leaf"))
        directory = stage(cells.select("path", "cell").join(found, ["path", "cell"], "left"))
        unstage(cells, sums)
        placed = rows.withColumn("cell", _prefix(h, to)).join(directory, ["path", "cell"])
        leaf = placed.filter("leaf is not null").withColumns({"path": F.concat("path", _bits(F.col("leaf.bucket"), F.col("leaf.d"))), "depth": F.col("depth") + F.col("leaf.d"), "shard_bytes": F.col("leaf.shard_bytes")})
        done.append(leaf.drop("cell", "leaf"))
        if directory.filter("leaf is null").isEmpty():
            rows = None
            break
        rows = stage(placed.filter("leaf is null").drop("cell", "leaf"))
        if to == BITS:
            break
        start, to = to, min(BITS, to + STEP)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole, rows


def _numbered(pages: DataFrame) -> DataFrame:
    """pages with `nth`, their number from 0 among the rows of one h and t, by their place `at` in the staged rows.

    Rows are numbered within the partition they were written from, and partitions by their counts, so many copies of
    one row never meet in one task.
    """
    placed = pages.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("h", "t", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("h", "t").orderBy("part")) - F.col("n")).drop("n")
    own = placed.withColumn("own", F.row_number().over(Window.partitionBy("h", "t", "part").orderBy("at")) - 1)
    return own.join(before, ["h", "t", "part"]).withColumn("nth", F.col("before") + F.col("own")).drop("own", "before", "part")


def assign_shards(docs: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(key, shard, depth, n_bytes, shard_bytes) for every row of docs(key, text).

    The directory is indexed by leading bits of the key's hash, and only a bucket over `limit` bytes of text is split
    on another bit. Rows of one key, whose bits never differ, are split on further bits of their text's hash; rows
    that agree in both, and single rows over the limit, are dealt to pages of as many rows as fit, one at least.
    Every shard fits the limit, but for a page that is one row. Null and empty texts have 0 bytes; a null key hashes as
    the empty one; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
    """
    hashed = docs.select(F.col(key).alias("key"), hash_bits(F.col(key)).alias("h"), hash_bits(F.col("text")).alias("t"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit("").alias("path"), F.lit(0).alias("depth"))
    rows = stage(hashed.withColumn("at", F.monotonically_increasing_id()))
    found, same_key = _leaves(rows.filter(F.col("n_bytes") <= limit), "h", limit)
    pages = rows.filter(F.col("n_bytes") > limit)
    if same_key is not None:
        marked = same_key.withColumns({"path": F.concat(_bits(F.col("h"), F.lit(BITS)), F.lit(".")), "depth": F.lit(BITS)})
        more, same_row = _leaves(marked, "t", limit)
        found = found.unionByName(more)
        pages = pages if same_row is None else pages.unionByName(same_row)
    one = F.concat(_bits(F.col("h"), F.lit(BITS)), F.lit("."), _bits(F.col("t"), F.lit(BITS)))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    paged = _numbered(pages).withColumns({"path": F.concat(one, F.lit("/"), F.floor(F.col("nth") / each)), "depth": F.lit(2 * BITS)})
    sizes = paged.groupBy("path").agg(F.sum("n_bytes").alias("shard_bytes"))
    paged = paged.join(sizes, "path").select(*found.columns)
    return found.unionByName(paged).select(F.col("key").alias(key), F.concat(F.lit("s"), "path").alias("shard"), "depth", "n_bytes", "shard_bytes")


def op7_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """assign_shards() of all documents, with shards of QUERY_LIMIT bytes; nulls, ties, repeats and empty tables as there."""
    return assign_shards(table(spark, sf_dir, "documents"), limit=QUERY_LIMIT)


OP7_SQL = f"""
WITH rows AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
sums AS (SELECT d, h >> ({BITS} - d) AS bucket, sum(n_bytes) AS n FROM rows, range(0, 31) r(d) WHERE n_bytes <= {QUERY_LIMIT} GROUP BY ALL),
leaf AS (SELECT doc_id, min(d) AS d FROM rows, sums WHERE n_bytes <= {QUERY_LIMIT} AND h >> ({BITS} - d) = bucket AND n <= {QUERY_LIMIT} GROUP BY doc_id),
pages AS (SELECT doc_id, 's' || lpad(bin(h), {BITS}, '0') || '.' || lpad(bin(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT)), {BITS}, '0') || '/0' AS shard, {2 * BITS} AS depth, n_bytes, n_bytes AS shard_bytes
  FROM rows JOIN documents USING (doc_id) WHERE n_bytes > {QUERY_LIMIT})
SELECT doc_id, 's' || CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - d)), CAST(d AS INTEGER), '0') END AS shard, CAST(d AS INTEGER) AS depth, n_bytes, CAST(n AS BIGINT) AS shard_bytes
FROM rows JOIN leaf USING (doc_id) JOIN sums USING (d) WHERE h >> ({BITS} - d) = bucket
UNION ALL SELECT * FROM pages
"""
