"""Writers of scores, shards, predictions and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.operators.metrics import hard_prediction
from seedloom.operators.tolerance import FILE_NAMES


def write_scores(scores: DataFrame, path: str) -> None:
    """Rows of ``tolerance.score_table`` as CSV, partitioned by normalisation, scheme and leaf mode, columns ``Pos/NT, A, T, G, C``.

    Folders name a scheme as score files do, ``max05_Gauss`` for ``X``. Rows are dealt by query, so that a task writes a few files of each folder.
    """
    name = F.col("param")
    for param, file in FILE_NAMES.items():
        name = F.when(F.col("param") == param, file).otherwise(name)
    out = scores.withColumn("param", name).repartition("query_id").sortWithinPartitions("norm", "param", "leaf_mode", "query_id", "site").select("query_id", "norm", "param", "leaf_mode", F.col("site").alias("Pos/NT"), "A", "T", "G", "C")
    out.write.partitionBy("norm", "param", "leaf_mode").mode("overwrite").csv(path, header=True)


def write_feature_shards(df: DataFrame, path: str, shard_size: int) -> DataFrame:
    """Feature rows as Parquet partitioned by ``shard``, and the manifest of counts read from it."""
    df.repartitionByRange("shard").write.partitionBy("shard").option("maxRecordsPerFile", shard_size).mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.count("*").alias("row_count"), F.sum(F.col("label").cast("bigint")).alias("positive_rows"))


def store_position_scores(scores: DataFrame, table: str, path: str, buckets: int, key: str = "row_id", split: str = "split", dealt: bool = False) -> None:
    """Long position scores as a Parquet table under ``path``, partitioned by split and bucketed and sorted by row.

    Tables of equal ``buckets`` are joined and gathered by row without an exchange, and a split is read alone. Each task writes one bucket of every split.
    ``dealt`` says that ``scores`` were made of rows dealt by ``key`` to as many tasks as buckets, so that the long rows are not exchanged.
    """
    ordered = (scores if dealt else scores.repartition(buckets, key)).sortWithinPartitions(split, key)
    ordered.write.format("parquet").partitionBy(split).bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(table)


def prediction_rows(df: DataFrame, probability: str = "probability") -> DataFrame:
    """``id, prediction, probability_0, probability_1`` and the label if there is one."""
    p = F.col(probability)
    extra = ["label"] if "label" in df.columns else []
    return df.select("id", hard_prediction(p).alias("prediction"), (1 - p).alias("probability_0"), p.alias("probability_1"), *extra)


def write_predictions(df: DataFrame, path: str, probability: str = "probability") -> None:
    prediction_rows(df, probability).write.mode("overwrite").csv(path, header=True)


def write_annotated(df: DataFrame, path: str) -> None:
    """Annotated rows as one tab-separated table."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def species_rows(species: DataFrame) -> DataFrame:
    """``3_letter_code, common_name, taxid`` by code, an unknown taxid empty."""
    return species.select(F.col("code").alias("3_letter_code"), "common_name", F.coalesce(F.col("taxid").cast("string"), F.lit("")).alias("taxid")).orderBy("3_letter_code")


def write_species_table(species: DataFrame, path: str) -> None:
    species_rows(species).coalesce(1).write.mode("overwrite").csv(path, header=True)


def bed_rows(df: DataFrame) -> DataFrame:
    """``chr, start, end`` with the start counted from 0."""
    return df.select("chr", (F.col("start").cast("bigint") - 1).alias("start"), F.col("end").cast("bigint").alias("end"))


def export_bed(df: DataFrame, path: str) -> None:
    """BED lines under ``path/bed`` and the table counted from 1 under ``path/tsv``."""
    bed_rows(df).write.mode("overwrite").csv(f"{path}/bed", sep="\t")
    df.select("chr", "start", "end").write.mode("overwrite").csv(f"{path}/tsv", sep="\t", header=True)


def split_to_normalised(df: DataFrame) -> dict[str, DataFrame]:
    """One array table as samples, labels, candidates, distinct miRNA profiles and target positions."""
    from seedloom.functions.names import profile_id

    keyed = df.withColumn("mature_id", profile_id(F.col("mirna"), F.col("mirna_scores")))
    position = lambda values: F.posexplode(values).alias("place", "s")
    profiles = keyed.groupBy("mature_id").agg(F.first("mirna_scores").alias("mirna_scores"))
    return {
        "samples": keyed.select("id", "gene", F.col("mirna").alias("noncodingRNA"), "feature", "dominant_region"),
        "labels": keyed.select("id", "label"),
        "candidates": keyed.select("id", F.lit(0).alias("candidate_index"), F.lit(1).alias("candidate_count"), "mature_id", F.lit(1).alias("has_profile")),
        "mirna_positions": profiles.select("mature_id", position(F.col("mirna_scores"))).select("mature_id", (F.col("place") + 1).alias("position"), "s"),
        "target_positions": keyed.select("id", "gene", position(F.col("target_scores"))).select("id", (F.col("place") + 1).alias("position"), F.substring("gene", F.col("place") + 1, F.lit(1)).alias("actual_nt"), "s"),
    }
