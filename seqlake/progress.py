"""What a run says of itself: log lines, a progress bar, conditions that must hold."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logger(path: str | None = None, name: str = "seqlake", level: int = logging.INFO) -> logging.Logger:
    """The log of a name, to a file or else to standard error, with times and levels."""
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        handler = logging.FileHandler(path) if path else logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s", "%Y-%m-%d %H:%M:%S"))
        log.addHandler(handler)
    return log


def bar(message: str, complete: int, processed: int, size: int) -> str:
    """What is done of a message's work: a share in per cent and as `size` marks, and the numbers; nothing to do is done."""
    share = min(1.0, processed / complete) if complete > 0 else 1.0
    full = round(share * size)
    return f"{message} {'#' * full}{'.' * (size - full)} {share:.0%} ({processed} of {complete})"


def required(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """rows, whose reading fails with the message at the first for which the condition doesn't hold."""
    holds = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return rows.filter(holds)
