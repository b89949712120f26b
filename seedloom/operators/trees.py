"""Python steps over whole trees, many of them a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.operators.joins import by_key

#: Nodes that one task is dealt, and trees that one batch to Spark holds.
TASK_NODES, BATCH_TREES = 50_000, 500


def map_trees(edges: DataFrame, columns: tuple[str, ...], change: Callable[..., list[tuple]], schema: str, more: DataFrame | None = None) -> DataFrame:
    """``query_id`` and the rows of ``schema`` that ``change`` makes of each tree's nodes (dicts of ``columns``, by node).

    A tree is one row of the exchange and workers take many trees a batch, so that a small tree costs its own steps and not a group's; as many
    tasks as a count of nodes asks for. ``more`` has one further value a tree, ``query_id`` and a column that ``change`` gets; trees without one are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = edges.schema["query_id"].dataType.simpleString()
    target = to_arrow_schema(StructType.fromDDL(f"query_id {kind}, {schema}"))
    trees = edges.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    if more is not None:
        trees = trees.join(by_key(more), "query_id")
    trees = trees.repartition(max(1, -(-edges.count() // TASK_NODES)), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TREES):
                held = [c.to_pylist() for c in batch.slice(at, BATCH_TREES).columns]
                out = [(q, *r) for q, *tree in zip(*held) for r in change(*tree)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return trees.mapInArrow(run, f"query_id {kind}, {schema}")
