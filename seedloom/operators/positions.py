"""Long position-score tables turned into arrays by row, and their joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.functions.arrays import BASES, once
from seedloom.operators.joins import if_small


def position_arrays(positions: DataFrame, keys: list[str], position: str, values: dict[str, Column], length: int) -> DataFrame:
    """One array of ``length`` per value and key, null at absent positions.

    Each key gathers at most its positions inside 1..length; repeated positions keep the largest value.
    """
    rows = gathered(positions.where(F.col(position).between(1, length)), keys, position, values, length)
    return rows.withColumns({n: F.col("_rows")[f"_v_{n}"] for n in values}).drop("_rows")


def gathered(positions: DataFrame, keys: list[str], position: str, values: dict[str, Column], length: int) -> DataFrame:
    """Keys and ``_rows``: ``length`` structs ``_at, _v_<name>`` in order, null at absent positions; of repeated positions the largest value of each name.

    Positions outside 1..length are left out, but not their keys.
    """
    entry = F.struct(F.col(position).cast("int").alias("_at"), *(v.alias(f"_v_{n}") for n, v in values.items()))
    kept = positions.select(*keys, F.when(F.col(position).between(1, length), entry).alias("_row"))
    rows = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    # Where each position is there once, the ordered rows are the array; only others are searched for each position.
    every = F.slice(F.sequence(F.lit(0), F.lit(length)), 2, length)
    rows = rows.withColumn("_whole", F.col("_rows")["_at"] == every)
    largest = lambda n, own: F.array_max(F.transform(own, _value(n))).alias(f"_v_{n}")
    at = lambda i: once(F.filter("_rows", lambda r: r["_at"] == i), lambda own: F.struct(i.alias("_at"), *(largest(n, own) for n in values)))
    return rows.withColumn("_rows", F.when(F.col("_whole"), F.col("_rows")).otherwise(F.transform(F.sequence(F.lit(1), F.lit(length)), at))).drop("_whole")


def _value(name: str):
    return lambda r: r[f"_v_{name}"]


#: Profiles up to this number are broadcast (an array of 28 scores each, some MB in all); more are joined by shuffle.
BROADCAST_PROFILES = 20_000


def attach_position_scores(rows: DataFrame, mirna: DataFrame, target: DataFrame, key: str = "row_id", broadcast_profiles: int = BROADCAST_PROFILES) -> DataFrame:
    """Rows with the arrays of both axes and ``missing``: the axes without any score.

    Both score tables are arrays by key already, so each side of a join is exchanged once on the key, or not at all where rows and scores are
    bucketed by it; keys without a row are left out. miRNA scores by ``mature_id`` are broadcast if a count shows that they are few.
    """
    joined = rows.join(target, key, "left")
    if key in mirna.columns:
        joined = joined.join(mirna, key, "left")
    else:
        joined = joined.join(if_small(mirna, broadcast_profiles), "mature_id", "left")
    sides = F.array(F.when(F.col("target_scores").isNull(), F.lit("target")), F.when(F.col("mirna_scores").isNull(), F.lit("mirna")))
    return joined.withColumn("missing", F.array_compact(sides))


def missing_position_counts(positions: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """Positions, and those whose scores are all missing, by group."""
    missing = F.col(scores[0]).isNull()
    for s in scores[1:]:
        missing = missing & F.col(s).isNull()
    return positions.groupBy(*by).agg(F.count("*").alias("n_positions"), F.count_if(missing).alias("n_missing"))


def actual_features(positions: DataFrame, actual: str, prefix: str) -> DataFrame:
    """Adds ``actual``, the mean of the other three, and their difference; null unless all are there."""
    scores = {b.upper(): F.col(f"{prefix}{b}") for b in BASES}
    total = sum(scores.values(), F.lit(0.0))
    own = F.lit(None).cast("double")
    for letter, s in scores.items():
        own = F.when(F.upper(F.col(actual)) == letter, s).otherwise(own)
    return positions.withColumn("actual_score", F.when(total.isNotNull(), own)).withColumn("other_mean", (total - F.col("actual_score")) / 3).withColumn("difference", F.col("actual_score") - F.col("other_mean"))
