"""Batch and stream scoring with a caller's model."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, StructField, StructType

from seedloom.functions.arrays import encode_pair_grid
from seedloom.functions.sequence import normalize_padded, normalize_strict

ScoreRows = Callable[[pd.DataFrame], pd.Series]


def score_rows(df: DataFrame, load: Callable[[], ScoreRows], column: str = "prediction") -> DataFrame:
    """``df`` with a probability column by a model that ``load`` gives once a task; raises ``ValueError`` if it has the column already.

    A model that leaves cycles behind, such as pandas' ``.str`` accessors, would keep whole batches: bytes and strings alone start no garbage collection, so each batch does.
    """
    if column in df.columns:
        raise ValueError(f"the input already has a column {column}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield frame.assign(**{column: model(frame).astype("float64")})
            del frame
            gc.collect()

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(column, DoubleType())]))


def embed_unique(df: DataFrame, column: str, load: Callable[[], Callable[[pd.Series], pd.Series]], to: str = "vector") -> DataFrame:
    """``df`` with the encoder's vector of each sequence, run once for each distinct one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for frame in frames:
            yield pd.DataFrame({"_seq": frame["_seq"], to: encode(frame["_seq"])})
            del frame
            gc.collect()

    unique = df.select(F.col(column).alias("_seq")).where("_seq is not null").distinct().mapInPandas(run, f"_seq string, {to} array<double>")
    return df.join(unique, F.col(column) == F.col("_seq"), "left").drop("_seq")


def encode_rows(df: DataFrame) -> DataFrame:
    """Rows with normalised sequences and their pair grid: the same stateless step for batches and streams."""
    named = df.withColumn("gene", normalize_padded(F.col("gene"), 50)).withColumn("mirna", normalize_padded(F.col("mirna"), 28))
    return named.withColumn("grid", encode_pair_grid("mirna", "gene"))


def scoring_errors(id_col: str = "id", gene: str = "gene", mirna: str = "mirna") -> Column:
    """Names of what keeps a row from being scored: an empty id, an absent sequence, or letters that are none of a sequence's."""
    rules = [(F.col(id_col).isNull() | (F.trim(F.col(id_col).cast("string")) == ""), "empty_id")]
    for name, c in (("gene", F.col(gene)), ("mirna", F.col(mirna))):
        absent = c.isNull() | (F.trim(c) == "")
        rules += [(absent, f"{name}_missing"), (~absent & normalize_strict(c).isNull(), f"{name}_letters")]
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)))


def stream_encode_and_score(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, load: Callable[[], ScoreRows], profiles: DataFrame | None = None, column: str = "prediction",
    rejected: str | None = None, errors: Column | None = None, watermark: tuple[str, str] | None = None, id_col: str = "id", files_a_batch: int | None = None,
) -> StreamingQuery:
    """Rows of Parquet files that arrive in ``source``: checked, encoded, joined to static profiles by ``mature_id``, scored, added to ``target``.

    Runs over what is there and stops; started again with the same ``checkpoint`` it goes on behind the last finished batch. With ``rejected`` two sinks are
    written: rows without ``errors`` (an array column, :func:`scoring_errors` unless given) go on to the model, the others with their errors
    to that folder. Each batch replaces its own folder ``batch=<number>`` in both, so that one that failed half-way leaves no row
    twice when it is run again. Without ``rejected`` nothing is checked and rows are appended.

    ``watermark`` names a time column and a delay, such as ``("arrived", "1 hour")``: of rows that share an id within the delay the first
    stays. Without it ids are not compared, for that would be unbounded state. ``files_a_batch`` bounds a batch. Raises ``ValueError`` if the
    schema has the prediction column already.
    """
    if column in StructType.fromDDL(schema).names:
        raise ValueError(f"the input already has a column {column}")
    reader = spark.readStream.schema(schema)
    rows = (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).parquet(source)
    if watermark is not None:
        rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark([id_col])

    def scored(df: DataFrame) -> DataFrame:
        joined = df if profiles is None else df.join(profiles, "mature_id", "left")
        return score_rows(encode_rows(joined), load, column).drop("grid")

    if rejected is None:
        writer = scored(rows).writeStream.format("parquet").option("path", target).outputMode("append")
    else:
        marked = rows.withColumn("errors", scoring_errors(id_col) if errors is None else errors)

        def both(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                scored(batch.where(F.size("errors") == 0).drop("errors")).write.mode("overwrite").parquet(f"{target}/batch={number}")
                batch.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            finally:
                batch.unpersist()

        writer = marked.writeStream.foreachBatch(both).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
