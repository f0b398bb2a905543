"""File formats: lists, delimited text, alphabets, sequence records, coordinate text, series, results."""

from __future__ import annotations

import re
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import base_name, tokens, trim_quotes
from ..operators.suffixes import numbered

#: Fixed layout of a sequence record's header: three lengths, padding, five pointers, the number of letters, padding.
HEADER = struct.Struct("<3I4x5QI4x")
#: Fixed three-letter codes of residues.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}
RECORD = "seq_id long, url string, description string, alphabet string, letters array<int>, info array<int>, length int"


def scratch(spark: SparkSession) -> str:
    """A new folder's path for files of this session alone: in spark.checkpoint.dir, where that is set, or else on this machine.

    It is deleted when the session ends. A cluster without the setting is an error, for its machines share no such folder.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{where or tempfile.mkdtemp(prefix='files-')}/files-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a list file that aren't empty."""
    return spark.read.text(path).filter("value <> ''")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, value): the lines of text files with their numbers from 0, those that are empty left out.

    Files are read in blocks, whose lines are counted first, so that no task holds a file.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    blocks = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))  # the lines of a block follow each other
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("block")) - F.col("lines")
    shift = blocks.select("path", "block", (before - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(shift), ["path", "block"]).select("path", (F.col("at") + F.col("shift")).cast("int").alias("n"), "value").filter("value <> ''")


def load_sequences(spark: SparkSession, list_path: str, folder: str, loader: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """RECORD rows of the sequences that a list file names, numbered in its order, from the files of a folder.

    Names are told by what follows their last slash; one that the folder lacks is an error. `loader` reads the folder
    (read_records, unless given).
    """
    names = read_places(spark, list_path).select("n", base_name(F.col("value")).alias("name"))
    order = names.withColumn("place", F.row_number().over(Window.orderBy("n")).cast("long") - 1)  # a list of names
    found = (loader or read_records)(spark, folder).drop("seq_id").withColumn("name", base_name(F.col("path")))
    joined = order.join(found, "name", "left").withColumn("seq_id", F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no such sequence: "), "name"))).otherwise(F.col("place")))
    return joined.select("seq_id", "url", "description", "alphabet", "letters", "info", "length")


def read_fields(spark: SparkSession, path: str, delimiters: str) -> DataFrame:
    """(fields): lines split at any of the delimiters; empty fields and lines vanish."""
    return spark.read.text(path).select(tokens(F.col("value"), delimiters).alias("fields")).filter(F.size("fields") > 0)


def read_alphabet(spark: SparkSession, path: str) -> DataFrame:
    """(character, mapdomain) of an alphabet file with a header, in the order of mapdomain.

    Two columns are a character (its row number if it isn't a number) and a code, one column is codes by row.
    """
    lines = read_fields(spark, path, ",").withColumn("line", F.monotonically_increasing_id())
    rows = lines.withColumn("row", F.row_number().over(Window.orderBy("line")) - 2).filter("row >= 0")  # an alphabet is small
    number = trim_quotes(F.col("fields")[0]).try_cast("int")
    character = F.when(F.size("fields") == 1, F.col("row")).otherwise(F.coalesce(number, F.col("row")))
    return rows.select(character.cast("int").alias("character"), F.element_at("fields", -1).cast("int").alias("mapdomain")).orderBy("mapdomain")


def encode_record(row: dict) -> bytes:
    """A sequence as a binary record."""
    names = [(row.get(k) or "").encode() for k in ("description", "alphabet", "url")]
    letters, info = row["letters"], row.get("info") or [0] * len(row["letters"])
    head = HEADER.pack(*map(len, names), *[0] * 5, len(letters))
    return head + b"".join(n + b"\0" for n in names) + struct.pack(f"<{2 * len(letters)}I", *letters, *info)


def decode_record(data: bytes) -> dict:
    """The sequence of a binary record."""
    d, a, u, *_, n = HEADER.unpack_from(data)
    at, names = HEADER.size, []
    for size in (d, a, u):
        names.append(data[at : at + size].decode())
        at += size + 1
    values = struct.unpack_from(f"<{2 * n}I", data, at)
    return {"description": names[0], "alphabet": names[1], "url": names[2], "letters": list(values[:n]), "info": list(values[n:]), "length": n}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of binary sequence files, with their path, numbered by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p} | decode_record(c) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("path", pa.string()), ("url", pa.string()), ("description", pa.string()), ("alphabet", pa.string()), ("letters", pa.list_(pa.int32())), ("info", pa.list_(pa.int32())), ("length", pa.int32())])
    listed = spark.read.format("binaryFile").load(path)
    read = listed.select("path", "content").mapInArrow(run, "path string, url string, description string, alphabet string, letters array<int>, info array<int>, length int")
    order = numbered(listed.select("path"), "seq_id", "path")  # paths alone, without their files' contents
    return read.join(order, "path").select("seq_id", "path", "url", "description", "alphabet", "letters", "info", "length")


def with_residues(sequences: DataFrame, chains: DataFrame) -> DataFrame:
    """RECORD rows whose letters are the char codes of their chain's residues, chains(code, residues) by the url's last part.

    The numbers that follow a record's names are its info, however many letters there are, and `length` is theirs.
    """
    coded = sequences.withColumn("code", base_name(F.col("url"))).join(chains.select("code", "residues"), "code")
    letters = residue_letters(F.col("residues"))
    return coded.select("seq_id", "url", "description", "alphabet", letters.alias("letters"), F.col("letters").alias("info"), F.size(letters).alias("length"))


def chain_residues(lines: DataFrame) -> DataFrame:
    """(chain, residues, length) of coordinate lines(n, value): the one-letter residues of alpha carbons, in their order."""
    atom = lines.filter(F.substring("value", 1, 4) == "ATOM").filter(F.trim(F.substring("value", 13, 4)) == "CA")
    codes = F.create_map(*(F.lit(x) for pair in RESIDUES.items() for x in pair))
    residue = F.coalesce(F.try_element_at(codes, F.substring("value", 18, 3)), F.lit("X"))
    rows = atom.select("n", F.substring("value", 22, 1).alias("chain"), residue.alias("r"))
    joined = rows.groupBy("chain").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n", "r")))["r"], "").alias("residues"))
    return joined.select("chain", "residues", F.length("residues").alias("length"))


def write_records(sequences: DataFrame, folder: str) -> DataFrame:
    """(seq_id, path): a binary record file for each of sequences, named by its url's last part, in a folder that all machines reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            rows, paths = batch.to_pylist(), []
            for row in rows:
                paths.append(f"{root}/{row['url'].rsplit('/', 1)[-1]}")
                with where.open_output_stream(paths[-1]) as out:
                    out.write(encode_record(row))
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(paths, pa.string())], names=["seq_id", "path"])

    return sequences.select("seq_id", "url", "description", "alphabet", "letters", "info").mapInArrow(run, "seq_id long, path string")


def records(sequences: DataFrame) -> DataFrame:
    """(seq_id, record): binary records of sequences, for a sink that writes a file for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array([encode_record(r) for r in rows], pa.binary())], names=["seq_id", "record"])

    return sequences.select("seq_id", "url", "description", "alphabet", "letters", "info").mapInArrow(run, "seq_id long, record binary")


def residue_letters(text: F.Column) -> F.Column:
    """The char codes of a residue string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)


def chains_of_coordinates(lines: DataFrame, name: str) -> DataFrame:
    """(chain, fasta) of coordinate lines(n, value): the residues of alpha carbons by chain, wrapped at 60."""
    head = F.concat(F.lit(f">{name} | chain "), "chain", F.lit(" | "), F.col("length").cast("string"), F.lit(" aa\n"))
    return chain_residues(lines).select("chain", F.concat(head, F.regexp_replace("residues", "(.{60})(?=.)", "$1\n")).alias("fasta"))


#: Fixed forms of the lines of a plain-text report: a query's path, a numbered target's path, a deviation, a score, the end of a target.
PLAIN_REPORT = {"query": r"^/\S*/([0-9a-z]{4}[A-Z0-9])", "target": r"[0-9]+\s+/\S*/([0-9a-z]{4}[A-Z0-9a-z])\s+", "rmsd": r"rmsd: (\d+\.\d+), ", "tm": r"tm_scr (\d+\.\d+)", "end": r"^1-exp\(-HSS"}


def edges_of_report(lines: DataFrame) -> DataFrame:
    """(n, a, b, tm) of the lines(path, n, value) of plain-text reports: an edge for each target's end line.

    An edge has the last query, target and score before it; a query's line takes the score back to 0. Loops and edges of no
    score are left out. Lines are carried on within a file.
    """
    so_far = Window.partitionBy("path").orderBy("n")
    part = lambda name: F.nullif(F.regexp_extract("value", PLAIN_REPORT[name], 1), F.lit(""))
    query, target = part("query"), F.when(part("query").isNull(), part("target"))
    tm = F.when(query.isNotNull(), "0").when(target.isNull() & part("rmsd").isNull(), part("tm"))
    rows = lines.select("path", "n", "value", query.alias("q"), target.alias("t"), tm.alias("s"))
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    done = rows.select("n", "value", last("q").alias("a"), last("t").alias("b"), last("s").alias("tm"))
    return done.filter(F.col("value").rlike(PLAIN_REPORT["end"]) & (F.col("a") != F.col("b")) & (F.col("tm") != "0")).select("n", "a", "b", F.col("tm").cast("double").alias("tm"))


def labels_of_report(lines: DataFrame) -> DataFrame:
    """(label, code): the queries of plain-text reports, numbered from 1 by their lines."""
    codes = lines.select("path", "n", F.regexp_extract("value", PLAIN_REPORT["query"], 1).alias("code")).filter("code <> ''")
    return numbered(codes, "place", "path", "n").select((F.col("place") + 1).cast("int").alias("label"), "code")


def edges_of_results(path: str, spark: SparkSession) -> DataFrame:
    """(a, b, tm) of a tagged result file: its fields 2, 3 and 4, without the header."""
    fields = F.split("value", ";")
    return spark.read.text(path).filter(F.col("value").startswith("CSV;")).select(base_name(fields[2]).alias("a"), base_name(fields[3]).alias("b"), fields[4].try_cast("double").alias("tm")).filter("tm is not null")


def write_series(df: DataFrame, column: str, path: str) -> None:
    """An array column as lines of index and value."""
    df.select(F.posexplode(column).alias("i", "value")).write.option("sep", "\t").csv(path)


def read_matrix(spark: SparkSession, path: str, size: int = 128) -> np.ndarray:
    """A substitution matrix by char codes, from text with comments after #, a row of letters, and a row of scores for each.

    Letters that it lacks, and lower-case ones, take the scores of their upper case, then of `*`, then 0.
    """
    lines = [x["value"].split("#")[0].split() for x in spark.read.text(path, wholetext=False).select("value").toLocalIterator()]
    lines = [x for x in lines if x]
    letters, found = lines[0], {}
    for row in lines[1:]:
        found.update({(row[0], b): float(x) for b, x in zip(letters, row[1:])})
    known = {c: c if c in letters else c.upper() if c.upper() in letters else "*" for c in map(chr, range(size))}
    return np.array([[found.get((known[chr(a)], known[chr(b)]), 0.0) for b in range(size)] for a in range(size)])


def export(spark: SparkSession, copies: dict[str, str]) -> bool:
    """Copy files from a path to another, whatever store they are in; False, and nothing copied, if one isn't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pairs = [[jvm.org.apache.hadoop.fs.Path(x) for x in pair] for pair in copies.items()]
    if not all(source.getFileSystem(conf).exists(source) for source, _ in pairs):
        return False
    return all(jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf) for a, b in pairs)
