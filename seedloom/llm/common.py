"""Pieces that the text operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The ASCII white space that the contracts split words at.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_SQL = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the test data, whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cuts(batch: pa.RecordBatch, rows: int, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Start and length of slices of at most ``rows`` rows and, beyond one row, ``max_bytes`` bytes of text or binary."""
    sizes = [0] * batch.num_rows
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes = [a + b for a, b in zip(sizes, pc.fill_null(pc.binary_length(column), 0).to_pylist())]
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= rows or held + n > max_bytes):
            yield at, i - at
            at, held = i, 0
        held += n
    if batch.num_rows > at:
        yield at, batch.num_rows - at


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, rows: int = 1000, max_bytes: int = 16_000_000) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows and ``max_bytes`` bytes; it returns columns by name.

    The slices bound what a worker holds beside the batch it was sent: a text longer than ``max_bytes`` is a slice of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def column(found) -> Callable:
        return lambda kind: found.cast(kind) if isinstance(found, pa.Array) else pa.array(found, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in cuts(batch, rows, max_bytes):
                found = fn(batch.slice(at, n))
                yield pa.RecordBatch.from_arrays([column(found[f.name])(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def scratch(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it read back, its lineage cut.

    Uses the folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset,
    a local master (tests) gets a temporary folder and any other raises ``ValueError``: other
    machines wouldn't see it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if context.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="seedloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
