"""Queries on a stream against a database that stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import SearchConfig
from ..operators.index import WordIndex
from ..plans.search import search


def search_stream(queries: DataFrame, database: DataFrame, config: SearchConfig, path: str, checkpoint: str, index: WordIndex | None = None) -> StreamingQuery:
    """Search each micro-batch of queries(seq_id, letters) and append the reported targets to a Parquet folder.

    A batch is a folder of its own, written over when it is run again, so results stand once. With an index of the
    database no batch reads or cuts the database's words anew.
    """

    def batch(rows: DataFrame, number: int) -> None:
        search(rows, database, config, index=index).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(sequences: DataFrame, index: WordIndex, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch of sequences(seq_id, letters or text) to an index, once however often it is run."""

    def batch(rows: DataFrame, number: int) -> None:
        index.append(rows, f"{checkpoint}#{number}")

    return sequences.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
