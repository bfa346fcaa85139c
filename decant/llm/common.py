"""What the corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what separates words everywhere in this package (space and the controls 9 to 13).
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
#: Rows a table may have before it is joined by shuffle instead of being sent to every task.
BROADCAST_ROWS = 10_000


def word_list(text: Column) -> Column:
    """Words of a text; null and texts without words give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def join_checked(left: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a table that is sent to every task only after its rows were counted.

    ``small`` should be cheap to read twice (a written table). Beyond ``BROADCAST_ROWS`` it is an ordinary
    shuffle join whose skewed partitions adaptive execution splits.
    """
    return left.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and inside whatever lambda ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def few(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: what a task holds follows the longest documents, not their number."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
