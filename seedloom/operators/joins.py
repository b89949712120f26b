"""Which side of a join is small enough to be sent to all machines, and how many tasks rows are dealt to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast, tables of ids and names of some 100 bytes a row.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which are counted no further than that; else for a join :func:`by_key`."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else by_key(df)


#: Rows that one task is dealt by :func:`spread`.
TASK_ROWS = 20_000


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side that a join exchanges and sorts by key, never one that goes to all machines.

    Spark takes a table that is exploded or made of compressed numbers for as small as the file it comes from, and would send it whole through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of some ``rows`` rows each, which one pass counts.

    Few bytes are many rows where each is exploded or walked: Spark cuts small files into few parts and joins small parts into one. Rows made of these
    stay with their keys, so that they are gathered by key without another exchange.
    """
    return df.repartition(max(1, -(-df.count() // rows)), *keys)
