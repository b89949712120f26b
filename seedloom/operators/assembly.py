"""The feature vector and tensors that models take, and the checks on what they are made of."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.functions import arrays, sequence
from seedloom.operators.features import finite, fit_columns
from seedloom.operators.joins import by_key
from seedloom.operators.metrics import ranking_metrics
from seedloom.operators.positions import BROADCAST_PROFILES, gathered
from seedloom.operators.splits import written

# Names of the 104 features in the order that models expect.
BASE_FEATURES = ("gene_len", "mirna_len", "gene_gc_frac", "mirna_gc_frac", "seed_max_contiguous_rc_match_len_2_8", "seed6_rc_match_count_2_7", "seed7_rc_match_count_2_8")
SUMMARY_STATS = ("mean", "std", "min", "max", "median", "q25", "q75", "finite_fraction", "empty_indicator")
FLAGS = ("candidate_count", "has_selected_profile", "has_target_scores")
WINDOW_NAMES = tuple(f"{segment}_{feature}" for segment, _, _ in sequence.WINDOW_SEGMENTS for feature in sequence.WINDOW_FEATURES)
BASES = ("A", "C", "G", "T")


def feature_names(tracks: tuple[str, ...]) -> list[str]:
    """Names of :func:`assemble_features`'s values, in order."""
    exact = [f"{name}_rc_count" for name, _, _ in sequence.EXACT_SEGMENTS]
    return [*BASE_FEATURES, *(f"{t}_{s}" for t in tracks for s in SUMMARY_STATS), *FLAGS, *exact, *WINDOW_NAMES]


def assemble_features(df: DataFrame, gene: str = "gene", mirna: str = "mirna", tracks: tuple[str, ...] = ("phylop", "phastcons"), flags: tuple[str, ...] = FLAGS) -> DataFrame:
    """Adds ``features``: 7 sequence values, 9 of each track, the flags, 4 exact counts and 72 window values.

    Sequences are sanitized here; null flags count as 0, null tracks as empty.
    """
    clean = df.withColumn("_g", sequence.sanitize_dna(F.col(gene))).withColumn("_m", sequence.sanitize_dna(F.col(mirna)))
    g, m = F.col("_g"), F.col("_m")
    seeds = sequence.seed_counts(g, m)
    base = [F.length(g), F.length(m), sequence.gc_fraction(g), sequence.gc_fraction(m), sequence.seed_max_match(g, m), seeds["seed6"], seeds["seed7"]]
    summaries = []
    for t in tracks:
        clean = clean.withColumn(f"_s_{t}", F.struct(*(v.alias(n) for n, v in arrays.vector_summary(F.coalesce(F.col(t), F.array().cast("array<double>"))).items())))
        summaries += [F.col(f"_s_{t}")[n] if n != "empty_indicator" else F.when(F.col(f"_s_{t}")["finite_fraction"] > 0, 0.0).otherwise(1.0) for n in SUMMARY_STATS]
    numbers = [*base, *summaries, *(F.coalesce(F.col(f), F.lit(0)) for f in flags), *sequence.exact_rc_counts(g, m).values()]
    windows = sequence.window_alignment("_g", "_m")
    made = clean.withColumn("features", F.concat(F.array(*(x.cast("double") for x in numbers)), windows))
    return made.drop("_g", "_m", *(f"_s_{t}" for t in tracks))


def candidates_of_samples(samples: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """All samples with their candidates; one without any stays, with nulls and ``candidate_count`` 0."""
    joined = samples.join(candidates.withColumn("_found", F.lit(1)), key, "left")
    count = F.coalesce("candidate_count", F.lit(0)) if "candidate_count" in candidates.columns else F.coalesce("_found", F.lit(0))
    return joined.withColumn("candidate_count", count).drop("_found")


def profile_matrix(profiles: DataFrame, scores: list[str], length: int, key: str = "mature_id", position: str = "pos") -> DataFrame:
    """``key, matrix, mask``: an array of ``length`` for each score, and 1 where any score of a position is finite, counted from 1.

    Values that aren't finite are 0, and so are absent positions; of repeated positions the largest value stays.
    """
    held = gathered(profiles, [key], position, {s: finite(F.col(s)) for s in scores}, length)
    rows = F.array(*(F.transform("_rows", _held(s)) for s in scores))
    any_score = lambda r: F.when(F.coalesce(*(r[f"_v_{s}"] for s in scores)).isNotNull(), 1).otherwise(0)
    return held.select(key, rows.alias("matrix"), F.transform("_rows", any_score).alias("mask"))


def _held(score: str):
    return lambda r: F.coalesce(r[f"_v_{score}"].cast("double"), F.lit(0.0))


def standardize_matrix(df: DataFrame, scores: list[str], scaler: DataFrame, matrix: str = "matrix", mask: str = "mask") -> DataFrame:
    """``matrix`` as ``(x - mean) / std`` where the mask is 1, 0 elsewhere, with the mask as a last channel.

    ``scaler`` has ``source, mean, std`` rows, one for each score.
    """
    wide = scaler.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("mean", "std")))).alias("_scaler"))
    # One row of as many entries as scores.
    joined = df.join(F.broadcast(wide))

    def channel(i: int, score: str) -> Column:
        own = F.element_at("_scaler", F.lit(score))
        return F.zip_with(F.get(matrix, F.lit(i)), mask, lambda x, live: F.when(live == 1, F.coalesce(finite((x - own["mean"]) / own["std"]), F.lit(0.0))).otherwise(0.0))

    channels = [channel(i, s) for i, s in enumerate(scores)]
    return joined.withColumn(matrix, F.array(*channels, F.transform(mask, lambda x: x.cast("double")))).drop("_scaler")


def attach_selected_profile(samples: DataFrame, selected: DataFrame, profiles: DataFrame, channels: int, length: int, key: str = "id") -> DataFrame:
    """Samples with ``profile``, the standardized matrix of the selected candidate's ``mature_id``; zeros where there is none.

    Matrices meet the samples last, so that none is exchanged with a sample where the selected ids are few; those of other ids are left out before.
    """
    ids = written(selected.select("mature_id").distinct().limit(BROADCAST_PROFILES + 1))
    few = ids.count() <= BROADCAST_PROFILES
    own = profiles.select("mature_id", F.col("matrix").alias("profile"))
    own = F.broadcast(own.join(F.broadcast(ids), "mature_id", "left_semi")) if few else by_key(own)
    chosen = samples.join(by_key(selected.select(key, "mature_id")), key, "left").join(own, "mature_id", "left")
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), length), channels)
    return chosen.drop("mature_id").withColumn("profile", F.coalesce("profile", zeros))


# Names of the target channels.
TARGET_CHANNELS = ("score_A", "score_C", "score_G", "score_T", "actual_score", "nonactual_mean", "actual_minus_nonactual_mean")


def target_values(positions: DataFrame, scores: dict[str, str], actual: str = "actual_nt", *keep: str) -> DataFrame:
    """Columns ``keep`` and the seven channels of each position: the four ``scores`` (by base) where finite, the actual base's, the mean of the others and their difference.

    The last three are null unless all four are finite and the base is A, C, G or T. Each step names those before it by column: put into one
    another, their expressions grow to more than Spark compiles, and a score is tested anew wherever it is named.
    """
    four = dict(zip(BASES, TARGET_CHANNELS))
    rows = positions.select(*keep, F.upper(F.col(actual)).alias("_base"), *(finite(F.col(scores[b])).cast("double").alias(n) for b, n in four.items()))
    own = F.lit(None).cast("double")
    for b, n in four.items():
        own = F.when(F.col("_base") == b, F.col(n)).otherwise(own)
    rows = rows.select(*keep, *four.values(), sum(map(F.col, four.values()), F.lit(0.0)).alias("_total"), own.alias("_own"))
    rows = rows.select(*keep, *four.values(), "_own", ((F.col("_total") - F.col("_own")) / 3).alias("_rest"))
    last = (F.when(F.col("_rest").isNotNull(), F.col("_own")), F.col("_rest"), F.col("_own") - F.col("_rest"))
    return rows.select(*keep, *four.values(), *(v.alias(n) for v, n in zip(last, TARGET_CHANNELS[4:])))


def target_matrix(positions: DataFrame, scores: dict[str, str], length: int, key: str = "row_id", position: str = "pos", actual: str = "actual_nt") -> DataFrame:
    """``key, matrix, mask, has_any``: four scores, the actual base's, the mean of the others and their difference.

    A position counts if its base is A, C, G or T and all four ``scores`` (by base) are finite; others are 0 and not in the mask.
    """
    values = target_values(positions, scores, actual, key, position)
    # The actual base's score is there only where all four are.
    whole = F.col("actual_score").isNotNull()
    rows = values.select(key, position, *(F.when(whole, F.col(n)).alias(n) for n in TARGET_CHANNELS))
    return profile_matrix(rows, list(TARGET_CHANNELS), length, key, position).withColumn("has_any", F.array_contains("mask", 1).cast("int"))


@dataclass(frozen=True)
class TargetScaler:
    """Mean and deviation of the seven target channels: fitted on one split's positions, applied to those of any."""

    #: channel: (number of values, mean, deviation)
    stats: dict[str, tuple[float, float, float]]
    scores: dict[str, str]
    length: int
    position: str = "pos"
    actual: str = "actual_nt"

    @classmethod
    def fit(cls, positions: DataFrame, scores: dict[str, str], length: int, position: str = "pos", actual: str = "actual_nt") -> TargetScaler:
        """One aggregation over the positions inside 1 to ``length``.

        The four score channels count every finite score; the actual base's score, the mean of the others and their difference only
        positions with four finite scores and a base that is A, C, G or T. ``scores`` maps bases to columns. The driver gets seven rows.
        """
        rows = target_values(positions.where(F.col(position).between(1, length)), scores, actual)
        return cls({r["source"]: (r["n"], r["mean"], r["std"]) for r in fit_columns(rows, list(TARGET_CHANNELS)).collect()}, dict(scores), length, position, actual)

    def rows(self, spark: SparkSession) -> DataFrame:
        """``source, n, mean, std``: the scaler as a table."""
        return spark.createDataFrame([(c, *self.stats[c]) for c in TARGET_CHANNELS], "source string, n double, mean double, std double")

    def transform(self, positions: DataFrame, key: str = "row_id") -> DataFrame:
        """``key, tensor, has_any``: seven channels and the mask, each ``length`` long; standardized where the mask is 1, else 0."""
        found = target_matrix(positions, self.scores, self.length, key, self.position, self.actual)

        def scaled(i: int, channel: str) -> Column:
            _, mean, std = self.stats[channel]
            return F.zip_with(F.get("matrix", F.lit(i)), F.col("mask"), lambda x, m: F.when(m == 1, (x - mean) / std).otherwise(0.0))

        planes = [scaled(i, c) for i, c in enumerate(TARGET_CHANNELS)] + [F.transform("mask", lambda m: m.cast("double"))]
        return found.select(key, F.array(*planes).alias("tensor"), "has_any")


def select_channels(mode: str, mirna: Column, target: Column) -> Column:
    """The channels of one axis (``mirna`` or ``target``), or of ``both``, miRNA first; raises ``ValueError`` for another mode."""
    if mode not in ("mirna", "target", "both"):
        raise ValueError(f"unknown channel mode {mode!r}")
    return {"mirna": mirna, "target": target}.get(mode, F.concat(mirna, target))


def safe_name(model: str) -> str:
    """A model's name as columns may carry it. Fixed values: ``p`` for a dot, one ``_`` for other runs of characters."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", model.replace(".", "p"))


def resolve_score_models(columns: list[str], models: list[str], prefix: str, fallback: str | None = "score") -> dict[str, list[str]]:
    """Columns ``<prefix>_<model>_<base>`` of each model, by its name or its :func:`safe_name`.

    Where no column has the prefix, a single model takes ``<fallback>_<base>`` in either case. Raises ``ValueError`` that lists
    all models without their four columns, and those there are.
    """
    pattern = re.compile(rf"{re.escape(prefix)}_(?P<model>.+)_(?P<base>[{''.join(BASES)}])")
    header: dict[str, dict[str, str]] = {}
    for m in filter(None, map(pattern.fullmatch, columns)):
        header.setdefault(m["model"], {})[m["base"]] = m[0]
    complete = {name: [own[b] for b in BASES] for name, own in header.items() if len(own) == len(BASES)}
    if not models:
        raise ValueError("at least one model is required")
    if fallback and not any(c.startswith(f"{prefix}_") for c in columns):
        lower = {c.lower(): c for c in sorted(columns, reverse=True)}
        plain = [lower.get(f"{fallback}_{b}".lower()) for b in BASES]
        if None in plain or len(models) > 1:
            raise ValueError(f"several models need columns named {prefix}_<model>_<base>")
        return {models[0]: plain}
    asked = {m: m.removeprefix(f"{prefix}_") for m in models}
    named = {m: raw if raw in complete else safe_name(raw) for m, raw in asked.items()}
    if absent := [m for m, name in named.items() if name not in complete]:
        raise ValueError(f"no columns of: {', '.join(absent)}; there are {', '.join(sorted(header))}")
    return {name: complete[name] for name in named.values()}


def attach_sample_weights(rows: DataFrame, weights: DataFrame, key: str = "row_id", weight: str = "weight") -> DataFrame:
    """Rows with their weight; raises ``ValueError`` unless each row has exactly one, finite and not negative."""
    counts = weights.groupBy(key).agg(F.count("*").alias("_n"), F.first(weight).cast("double").alias(weight))
    joined = rows.join(counts, key, "left")
    ok = finite(F.col(weight)).isNotNull() & (F.col(weight) >= 0)
    bad = joined.agg(F.count_if(F.coalesce(F.col("_n"), F.lit(0)) != 1).alias("count"), F.count_if(F.col("_n").isNotNull() & ~F.coalesce(ok, F.lit(False))).alias("value")).first()
    if bad["count"] or bad["value"]:
        raise ValueError(f"weights: {bad['count']} rows without exactly one, {bad['value']} not finite or negative")
    return joined.drop("_n")


def metrics_by_shift(predictions: dict[int, DataFrame], by: list[str]) -> DataFrame:
    """:func:`~seedloom.operators.metrics.ranking_metrics` of predictions made with each target shift."""
    shifted = [df.withColumn("shift", F.lit(k)) for k, df in predictions.items()]
    every = shifted[0]
    for df in shifted[1:]:
        every = every.unionByName(df)
    return ranking_metrics(every, ["shift", *by])
