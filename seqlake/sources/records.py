"""Sequence record files as a Spark data source: spark.read.format("seq"), rows.write.format("seq")."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import HEADER, RECORD, decode_record, encode_record

#: Bytes of files that make a partition, what opening one counts for, and files read at a time.
SPLIT, OPENING, BATCH = 64 << 20, 64 << 10, 256
_TYPES = {"seq_id": pa.int64(), "path": pa.string(), "url": pa.string(), "description": pa.string(), "alphabet": pa.string(), "letters": pa.list_(pa.int32()), "info": pa.list_(pa.int32()), "length": pa.int32()}


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    """Files of one task, and the number of the first of them."""

    def __init__(self, first: int, paths: list[str]):
        super().__init__(first)
        self.first, self.paths = first, paths


class SeqReader(DataSourceReader):
    """Files are numbered by path when they are listed, and dealt to partitions of `split` bytes; each is read once.

    Only the columns of the schema are made: without letters and info no more than a file's head is read.
    """

    def __init__(self, path: str, schema: StructType, split: int = SPLIT):
        self.path, self.columns, self.split = path, schema.names, split
        if unknown := set(self.columns) - set(_TYPES):
            raise ValueError(f"a record has no {', '.join(sorted(unknown))}")

    def partitions(self) -> list[Files]:
        where, root = place_of(self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = [info] if info.is_file else where.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda x: any(part[:1] in "._" for part in x.path[len(root) :].split("/") if part)
        files = sorted((x.path, x.size) for x in listed if x.is_file and not hidden(x))
        parts: list[Files] = []
        size = self.split
        for number, (path, length) in enumerate(files):
            if size >= self.split:
                parts.append(Files(number, []))
                size = 0
            parts[-1].paths.append(path)
            size += length + OPENING
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where = place_of(self.path)[0]
        whole = not {"letters", "info"}.isdisjoint(self.columns)
        schema = pa.schema([(c, _TYPES[c]) for c in self.columns])
        for start in range(0, len(partition.paths), BATCH):
            rows = []
            for number, path in enumerate(partition.paths[start : start + BATCH], partition.first + start):
                with where.open_input_file(path) as file:
                    row = decode_record(file.read()) if whole else self._head(file)
                rows.append(row | {"seq_id": number, "path": path})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    @staticmethod
    def _head(file: pa.NativeFile) -> dict:
        head = file.read(HEADER.size)
        *sizes, n = (HEADER.unpack(head)[k] for k in (0, 1, 2, -1))
        names = file.read(sum(sizes) + 3)
        at = [0, sizes[0] + 1, sizes[0] + sizes[1] + 2]
        description, alphabet, url = (names[a : a + size].decode() for a, size in zip(at, sizes))
        return {"description": description, "alphabet": alphabet, "url": url, "length": n}


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class SeqWriter(DataSourceWriter):
    """A file for each row, named by its url's last part, of which none is seen before all tasks have written theirs.

    Tasks write into folders of their own under a hidden one; commit moves the files, abort deletes them. Rows of one
    name are an error, and so is a name that is there already, unless the folder is overwritten.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staged = path, overwrite, f"_staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        where, root = place_of(self.path)
        folder, names = f"{root}/{self.staged}/{uuid.uuid4().hex}", []
        where.create_dir(folder, recursive=True)
        for row in rows:
            record = row.asDict()
            name = (record.get("url") or "").rsplit("/", 1)[-1]
            if not name or record.get("letters") is None:
                raise ValueError("a record needs a url and letters")
            with where.open_output_stream(f"{folder}/{name}") as out:
                out.write(encode_record(record))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = place_of(self.path)
        moves = [(f"{m.folder}/{name}", name) for m in messages if m for name in m.names]
        there = {x.base_name for x in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.is_file}
        if len({name for _, name in moves}) < len(moves) or not self.overwrite and not there.isdisjoint(name for _, name in moves):
            self.abort(messages)
            raise ValueError("records of one name")
        if self.overwrite:
            for name in there:
                where.delete_file(f"{root}/{name}")
        for source, name in moves:
            where.move(source, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = place_of(self.path)
        if where.get_file_info(f"{root}/{self.staged}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.staged}")


class SeqSource(DataSource):
    """Binary sequence records, a file each, in the folder `path` that all machines reach; `split` is a partition's bytes."""

    @classmethod
    def name(cls) -> str:
        return "seq"

    def schema(self) -> str:
        return RECORD.replace("seq_id long,", "seq_id long, path string,")

    def reader(self, schema: StructType) -> SeqReader:
        return SeqReader(self.options["path"], schema, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> SeqWriter:
        return SeqWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format "seq" known to a session."""
    spark.dataSource.register(SeqSource)
