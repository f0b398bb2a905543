"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that a task hands to Python at a time; twice in its memory for a while, there and in the JVM's.
BATCH = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset, the folder that setCheckpointDir() was given. A session of one JVM that has neither gets a
    folder of its own; a cluster without one is an error, for its machines share no temporary folder.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not where and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return where or sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The files go with unstage(), at the latest when the driver's JVM ends. Shuffles that nothing refers to any more
    go at once: Spark's cleaner waits for the driver's garbage collection, which a large job may never see. From then
    on the session's tasks, also those that read what is staged, hand BATCH bytes to Python at a time, or what the
    session sets if that is less.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    jvm = spark.sparkContext._jvm
    path = f"{shared_dir(spark)}/seqlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    jvm.System.gc()
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = at
    return staged


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes at most, in this session from now on; a smaller limit of the session's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < limit <= BATCH:
        spark.conf.set(name, str(BATCH))


def unstage(*staged: DataFrame) -> None:
    """Delete the files of stage()'s results that nothing will read again."""
    for df in staged:
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        df.staged_at.getFileSystem(conf).delete(df.staged_at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to differ from all columns of df, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def text_hash() -> Column:
    """What tells texts of one doc_id apart; a null text has a hash as well."""
    return F.xxhash64(F.col("text").cast("string"))


def drop_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id and text_hash() are not in bad(doc_id, h); nulls are equal."""
    key, value = unused(docs, "bad_id", "bad_hash")
    marked = bad.select(F.col("doc_id").alias(key), F.col("h").alias(value)).distinct()
    return docs.join(marked, F.col("doc_id").eqNullSafe(F.col(key)) & (text_hash() == F.col(value)), "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blobs(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    return pc.fill_null(column, "").cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and the offsets of its texts; null becomes empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text at a time, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """One table for each run of equal keys, in rows that arrive sorted by `key` (never null)."""
    held: list[pa.RecordBatch] = []
    mine = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, stop in zip(edges, edges[1:]):
            if held and keys[start] != mine:
                yield mine, pa.Table.from_batches(held)
                held = []
            mine = keys[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield mine, pa.Table.from_batches(held)
