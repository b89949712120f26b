"""Checks of interaction rows and position tables; each gives the rows that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions.sequence import normalize_strict

COMPACT_LIMIT = 65504.0
GENE_LENGTH = 50


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself; raises ``ValueError`` that lists all absent columns."""
    if absent := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def row_errors(label: Column, gene: Column, mirna: Column, tracks: dict[str, tuple[Column, float | None, float | None]] | None = None) -> Column:
    """Names of the rules that a row breaks; ``tracks`` maps a name to its array and its bounds."""
    rules = [
        (gene.isNull() | normalize_strict(gene).isNull(), "gene_letters"),
        (F.length(normalize_strict(gene)) != GENE_LENGTH, "gene_length"),
        (mirna.isNull() | normalize_strict(mirna).isNull(), "mirna_letters"),
        (label.isNull() | ~label.isin(0, 1), "label"),
    ]
    for name, (values, low, high) in (tracks or {}).items():
        rules.append((F.size(values) != GENE_LENGTH, f"{name}_length"))
        rules.append((F.exists(values, lambda x: F.abs(x) == float("inf")), f"{name}_infinite"))
        if low is not None:
            rules.append((F.exists(values, _outside(low, high)), f"{name}_range"))
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in rules)))


def _outside(low: float, high: float):
    return lambda x: x.isNotNull() & ~F.isnan(x) & ~x.between(low, high)


def validate_interactions(df: DataFrame, id_col: str = "id", gene: str = "gene", mirna: str = "mirna", label: str = "label", tracks: dict | None = None) -> DataFrame:
    """``df`` with ``errors``: empty or repeated ids, letters, lengths, labels and track rules; good rows have none.

    Repeats are counted by an aggregation that combines before it shuffles, and joined back.
    """
    own = row_errors(F.col(label), F.col(gene), F.col(mirna), tracks)
    empty = F.col(id_col).isNull() | (F.trim(F.col(id_col).cast("string")) == "")
    repeats = df.groupBy(F.col(id_col).alias("repeated_id")).agg(F.count("*").alias("times")).where("times > 1 and repeated_id is not null").drop("times")
    marked = df.join(repeats, F.col(id_col) == F.col("repeated_id"), "left")
    first = F.array_compact(F.array(F.when(empty, F.lit("empty_id")), F.when(F.col("repeated_id").isNotNull(), F.lit("duplicate_id"))))
    return marked.withColumn("errors", F.concat(first, own)).drop("repeated_id")


def reject_counts(validated: DataFrame) -> DataFrame:
    """``rule, n_rows`` of a validated table."""
    return validated.select(F.explode("errors").alias("rule")).groupBy("rule").agg(F.count("*").alias("n_rows"))


def check_ascending(df: DataFrame, order: str, value: str, within: str) -> DataFrame:
    """Rows whose ``value`` isn't larger than that before it in ``order``, inside each ``within`` group."""
    before = F.lag(value).over(Window.partitionBy(within).orderBy(order))
    return df.withColumn("before", before).where(F.col("before") >= F.col(value))


def check_positions_complete(positions: DataFrame, key: str, position: str, length: int) -> DataFrame:
    """Per key: counts of distinct, repeated and out-of-range positions, and of missing ones; complete keys too."""
    inside = F.col(position).between(1, length)
    once = positions.groupBy(key, position).agg(F.count("*").alias("times"))
    return once.groupBy(key).agg(
        F.count_if(inside).alias("n_positions"),
        F.coalesce(F.sum(F.when(inside, F.col("times") - 1)), F.lit(0)).alias("n_repeated"),
        F.coalesce(F.sum(F.when(~inside, F.col("times"))), F.lit(0)).alias("n_outside"),
    ).withColumn("n_missing", F.lit(length) - F.col("n_positions"))


def check_partial_missing(df: DataFrame, scores: list[str]) -> DataFrame:
    """Rows where some of the scores, but not all, are missing."""
    missing = sum((F.col(s).isNull().cast("int") for s in scores), F.lit(0))
    return df.where(missing.between(1, len(scores) - 1))


def check_compact_range(df: DataFrame, scores: list[str], limit: float = COMPACT_LIMIT) -> DataFrame:
    """Rows with a score beyond half-precision range."""
    return df.where(F.greatest(*(F.abs(F.col(s)) for s in scores), F.lit(0.0)) > limit)


def missing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def check_same_shape(manifests: DataFrame, split: str = "split", fields: tuple[str, ...] = ("length", "channels"), reference: str = "train") -> DataFrame:
    """Splits whose manifest fields differ from those of the reference split."""
    base = manifests.where(F.col(split) == reference).select(*(F.col(f).alias(f"base_{f}") for f in fields)).limit(1)
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"base_{f}"))
    return manifests.join(F.broadcast(base)).where(differs).select(split)
