"""Places in a search where a caller's own code goes: what is made of a pair's rows, and which results go on."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import SkipRestOfInputTableException

#: What a handler may say of a row: it goes on, it doesn't, or it and all that follow it of its query don't.
EMIT, SKIP, STOP = "emit", "skip", "stop"


class Accumulator(Protocol):
    """What a filter slot takes: made once a pair, given its rows one by one, asked for its results in the end."""

    def add(self, row: Row) -> None: ...

    def results(self) -> Iterable[tuple]: ...


def accumulated(rows: DataFrame, accumulator: Callable[[], Accumulator], schema: str, *order: str) -> DataFrame:
    """(query_id, target_id, schema...): what a caller's accumulator makes of each pair's rows, in the given order.

    The rows are a partitioned argument of a table function, so pairs are spread by their keys, each is a stream of rows
    of which only the accumulator's state is held, and a pair with no results vanishes.
    """

    class Filter:
        def __init__(self) -> None:
            self.own, self.key = None, None

        def eval(self, row: Row):
            if self.own is None:
                self.own, self.key = accumulator(), (row["query_id"], row["target_id"])
            self.own.add(row)

        def terminate(self):
            if self.own is not None:
                for result in self.own.results():
                    yield (*self.key, *result)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query_id", "target_id"))
    table = rows.asTable().partitionBy("query_id", "target_id")
    return udtf(Filter, returnType=f"{kinds}, {schema}")(table.orderBy(*order) if order else table)


def handled(ranked: DataFrame, handler: Callable[[Row], str]) -> DataFrame:
    """The rows of ranked(query_id, rank, ...) that a caller's handler emits, asked query by query in the order of ranks.

    After STOP nothing more of a query is read. Handlers see one row at a time, and queries are spread by their ids.
    """
    schema: StructType = ranked.schema

    class Handler:
        def eval(self, row: Row):
            said = handler(row)
            if said == STOP:
                raise SkipRestOfInputTableException("the handler stopped")
            if said == EMIT:
                yield tuple(row)
            elif said != SKIP:
                raise ValueError(f"a handler says {EMIT}, {SKIP} or {STOP}, not {said!r}")

    return udtf(Handler, returnType=schema)(ranked.asTable().partitionBy("query_id").orderBy("rank"))
