"""Fitted scalers and vocabularies, candidates and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions.arrays import once
from seedloom.functions.names import MISSING, normalize_category
from seedloom.operators.joins import if_small
from seedloom.operators.splits import written

LEAST_VARIANCE = 1e-12
NO_INDEX = 10**9


def finite(x: Column) -> Column:
    """The value where it is a finite number, else null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fit_columns(df: DataFrame, columns: list[str], weight: Column | None = None) -> DataFrame:
    """``source, n, mean, std`` of columns: population std over finite values, 1 where the variance is 1e-12 or less.

    ``weight`` counts a row so many times; squares are then summed around the means in a second pass, so that large means
    cost no digits. Columns without a finite value have mean 0 and std 1.
    """
    finished = df.select(*(finite(F.col(c)).cast("double").alias(f"x_{i}") for i, c in enumerate(columns)), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    places = range(len(columns))
    if weight is None:
        row = finished.agg(*(v for i in places for v in (F.count(f"x_{i}").cast("double").alias(f"n_{i}"), F.avg(f"x_{i}").alias(f"m_{i}"), F.var_pop(f"x_{i}").alias(f"v_{i}"))))
    else:
        live = [F.when(F.col(f"x_{i}").isNotNull(), F.col("w")).otherwise(0.0) for i in places]
        means = finished.agg(*(v for i in places for v in (F.sum(live[i]).alias(f"n_{i}"), (F.sum(F.col("w") * F.col(f"x_{i}")) / F.nullif(F.sum(live[i]), F.lit(0.0))).alias(f"m_{i}"))))
        # One row of means.
        around = finished.join(F.broadcast(means))
        row = around.agg(
            *(v for i in places for v in (F.max(f"n_{i}").alias(f"n_{i}"), F.max(f"m_{i}").alias(f"m_{i}"), (F.sum(F.col("w") * (F.col(f"x_{i}") - F.col(f"m_{i}")) ** 2) / F.nullif(F.max(f"n_{i}"), F.lit(0.0))).alias(f"v_{i}")))
        )
    entries = F.array(*(F.struct(F.lit(c).alias("source"), F.coalesce(f"n_{i}", F.lit(0.0)).alias("n"), F.coalesce(f"m_{i}", F.lit(0.0)).alias("mean"), F.coalesce(f"v_{i}", F.lit(0.0)).alias("v")) for i, c in enumerate(columns)))
    packed = row.select(F.explode(entries).alias("r")).select("r.*")
    return packed.select("source", "n", "mean", F.when(F.col("v") <= LEAST_VARIANCE, 1.0).otherwise(F.sqrt("v")).alias("std"))


def fit_position_scaler(df: DataFrame, tracks: list[str]) -> DataFrame:
    """:func:`fit_columns` over all positions of array columns."""
    exploded = df.select(F.explode(F.arrays_zip(*tracks)).alias("p")).select("p.*")
    return fit_columns(exploded, tracks)


def fit_mirna_scaler(profiles: DataFrame, selected: DataFrame, columns: list[str], key: str = "mature_id") -> DataFrame:
    """Scaler over profile positions, each profile weighted by how many samples selected it."""
    counts = written(selected.groupBy(key).agg(F.count("*").alias("n_selected")))
    return fit_columns(profiles.join(if_small(counts), key), columns, F.col("n_selected"))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """``(x - mean) / std`` in place; values that aren't finite become 0. The scaler has a row a column."""
    wide = scaler.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("mean", "std")))).alias("_scaler"))
    joined = df.join(F.broadcast(wide))
    for c in columns:
        own = F.element_at("_scaler", F.lit(c))
        joined = joined.withColumn(c, F.coalesce((finite(F.col(c)) - own["mean"]) / own["std"], F.lit(0.0)))
    return joined.drop("_scaler")


def fit_vocab(df: DataFrame, column: str, least: int = 100) -> DataFrame:
    """``token, n, index``: missing is 0 and other 1; tokens of at least ``least`` rows follow by (-n, token)."""
    counts = df.select(normalize_category(F.col(column)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    kept = counts.where((F.col("n") >= least) & (F.col("token") != MISSING))
    numbered = kept.withColumn("index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")) + 1)
    fixed = df.sparkSession.createDataFrame([(MISSING, 0), ("__OTHER__", 1)], "token string, index int")
    return fixed.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"), "index").unionByName(numbered.select("token", "n", "index"))


def encode_category(df: DataFrame, vocab: DataFrame, column: str, to: str) -> DataFrame:
    """Adds the vocabulary index of a category, 1 for tokens it lacks; a vocabulary beyond a counted bound is joined by shuffle."""
    table = if_small(vocab.select(F.col("token").alias("_token"), F.col("index").alias(to)))
    return df.join(table, normalize_category(F.col(column)) == F.col("_token"), "left").drop("_token").withColumn(to, F.coalesce(to, F.lit(1)))


def select_candidate(candidates: DataFrame, key: str = "id") -> DataFrame:
    """The candidate of least index with a profile and a mature id, the first in source order among equals."""
    usable = candidates.where((F.col("has_profile") == 1) & F.col("mature_id").isNotNull() & (F.trim("mature_id") != ""))
    order = Window.partitionBy(key).orderBy("candidate_index", "source_order")
    return usable.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def rank_candidates(candidates: DataFrame, k: int = 3, key: str = "id") -> DataFrame:
    """Slots 0..k-1 of usable candidates by index, then source order; an index that isn't a number comes last."""
    usable = candidates.where((F.col("has_profile") == 1) & F.col("mature_id").isNotNull() & (F.trim("mature_id") != ""))
    index = F.coalesce(F.col("candidate_index").cast("string").try_cast("bigint"), F.lit(NO_INDEX))
    slot = F.row_number().over(Window.partitionBy(key).orderBy(index, "source_order")) - 1
    return usable.withColumn("slot", slot).where(F.col("slot") < k)


def candidate_summary(candidates: DataFrame, k: int = 3, key: str = "id") -> DataFrame:
    """Rows, samples, most candidates of a sample, samples with a selection, and candidates kept and cut by ``k`` slots."""
    usable = F.count_if((F.col("has_profile") == 1) & F.col("mature_id").isNotNull())
    by_sample = candidates.groupBy(key).agg(F.count("*").alias("n"), F.max("candidate_count").alias("most"), usable.alias("usable"))
    return by_sample.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_samples"), F.max("most").alias("max_candidate_count"), F.count_if(F.col("usable") > 0).alias("n_selected"),
        F.sum(F.least("usable", F.lit(k))).alias("n_retained"), F.sum(F.greatest(F.col("usable") - k, F.lit(0))).alias("n_truncated"),
    )


def attach_profiles(ranked: DataFrame, profiles: DataFrame, k: int = 3, key: str = "id") -> DataFrame:
    """``key, profiles, slot_mask``: k ordered profile arrays of each sample, null and 0 in absent slots."""
    joined = ranked.join(profiles, "mature_id", "left").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "profile"))).alias("_by_slot"))
    slots = F.sequence(F.lit(0), F.lit(k - 1))
    return joined.select(
        key,
        F.transform(slots, lambda i: F.try_element_at("_by_slot", i)).alias("profiles"),
        F.transform(slots, lambda i: F.when(F.try_element_at("_by_slot", i).isNotNull(), 1).otherwise(0)).alias("slot_mask"),
    )


def attach_embeddings(rows: DataFrame, vectors: DataFrame, left: str, right: str) -> DataFrame:
    """Adds ``[m, t, |m - t|, m * t]`` of the vectors of two sequence columns; ``vectors`` has ``seq, vector``."""
    m = vectors.select(F.col("seq").alias(left), F.col("vector").alias("_m"))
    t = vectors.select(F.col("seq").alias(right), F.col("vector").alias("_t"))
    joined = rows.join(m, left, "left").join(t, right, "left")
    gap = F.zip_with("_m", "_t", lambda x, y: F.abs(x - y))
    product = F.zip_with("_m", "_t", lambda x, y: x * y)
    return joined.withColumn("embedding", F.concat("_m", "_t", gap, product)).drop("_m", "_t")


def pool_tokens(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; null without any."""

    def mean(kept: Column) -> Column:
        n = F.size(kept)
        total = F.aggregate(kept, F.transform(F.get(kept["v"], F.lit(0)), lambda x: F.lit(0.0)), lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q))
        return F.when(n > 0, F.transform(total, lambda x: x / n))

    return once(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), mean)
