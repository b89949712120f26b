import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedloom.functions import arrays, names, sequence
from seedloom.functions.sequence import WINDOW_SEGMENTS, window_table


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<double>'}" for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("text", "strict", "padded"), [(" acgu ", "ACGT", "NACGTNNN"), ("ACGX", None, "ACGNNNNN"), ("", None, "NNNNNNNN"), (None, None, "NNNNNNNN"), ("ACGTACGTACGT", "ACGTACGTACGT", "ACGTACGT")])
def test_normalisation(spark, text, strict, padded):
    assert one(spark, sequence.normalize_strict(F.col("s")), s=text) == strict
    assert one(spark, sequence.normalize_padded(F.col("s"), 8), s=text) == padded


def test_reverse_complement_twice_is_the_sequence(spark):
    assert one(spark, sequence.reverse_complement(sequence.reverse_complement(F.col("s"))), s="AACGTNG") == "AACGTNG"
    assert one(spark, sequence.reverse_complement(F.col("s")), s="aacu") == "AGTT"


@pytest.mark.parametrize(("text", "pattern", "n"), [("AAAA", "AA", 3), ("ACAC", "", 0), ("", "A", 0), ("ACACA", "ACA", 2)])
def test_overlapping_counts(spark, text, pattern, n):
    assert one(spark, sequence.count_overlapping(F.col("t"), F.col("p")), t=text, p=pattern) == n


def test_longest_run(spark):
    flags = F.array(*map(F.lit, (True, True, False, True, True, True, False)))
    assert spark.range(1).select(sequence.longest_true_run(flags)).first()[0] == 3


def windows_by_hand(gene, mirna, first, end):
    size = end - first
    if len(mirna) < end or len(gene) < size:
        return [0.0] * 12
    wc = {("A", "T"), ("T", "A"), ("C", "G"), ("G", "C")}
    wobble = {("G", "T"), ("T", "G")}
    rows = []
    for s in range(len(gene) - size + 1):
        pairs = [(mirna[end - 1 - k], gene[s + k]) for k in range(size)]
        strong, weak = [p in wc for p in pairs], [p in wobble for p in pairs]

        def run(flags):
            return max((len(x) for x in "".join("1" if f else "0" for f in flags).split("0")), default=0)

        rows.append((sum(strong) + 0.5 * sum(weak), sum(strong), sum(weak), run(strong), run([a or b for a, b in zip(strong, weak)])))
    scores = [r[0] for r in rows]
    best = scores.index(max(scores))
    top = sorted(scores, reverse=True)[:3]
    return [
        1.0, max(r[1] for r in rows) / size, max(r[2] for r in rows) / size, max(r[1] + r[2] for r in rows) / size, max(scores) / size, max(r[3] for r in rows) / size, max(r[4] for r in rows) / size,
        sum(top) / len(top) / size, sum(s / size >= 0.75 for s in scores) / len(scores), sum(s / size >= 0.85 for s in scores) / len(scores), best / 49, abs(best + (size - 1) / 2 - (len(gene) - 1) / 2) / 25,
    ]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ACGTN", max_size=50), st.text("ACGTN", max_size=28)), min_size=1, max_size=5))
def test_window_features_equal_a_walk_over_windows(rows):
    got = window_table(pd.Series([g for g, _ in rows]), pd.Series([m for _, m in rows]))
    for (gene, mirna), own in zip(rows, got):
        want = [x for _, a, b in WINDOW_SEGMENTS for x in windows_by_hand(gene, mirna, a, b)]
        assert np.allclose(own, want)


def test_score_arrays(spark):
    assert one(spark, arrays.parse_score_array(F.col("s")), s="[0.5, NaN, null]") == [0.5, None, None]
    assert one(spark, arrays.parse_score_array(F.col("s")), s="NA") is None
    assert one(spark, arrays.parse_score_array(F.col("s")), s="[[1]]") is None
    assert one(spark, arrays.parse_vector_lenient(F.col("s")), s="[1, x, 2.5]") == [1.0, None, 2.5]
    assert one(spark, arrays.parse_vector_lenient(F.col("s")), s="") == []
    assert one(spark, arrays.parse_track_lenient(F.col("s"), "phylop", 4), s="[20, -5, 3]") == [1.0, -0.5, 0.3, 0.0]
    assert one(spark, arrays.parse_track_lenient(F.col("s"), "phastcons", 3), s="[0.1, nan]") == [0.5] * 3


@pytest.mark.parametrize(("kind", "actual", "want"), [("actual_margin", "a", [0.25]), ("alt_mean", "A", [0.375]), ("actual_margin", "N", [0.0]), ("alt_mean", "N", [0.5]), ("nucleotide", "N", [0.75, 0.5, 0.25, 0.375])])
def test_reductions(spark, kind, actual, want):
    scores = [F.lit(x) for x in (0.75, 0.5, 0.25, 0.375)]
    assert spark.range(1).select(arrays.reduce_scores(kind, F.lit(actual), *scores)).first()[0] == want
    missing = [F.lit(None).cast("double"), *scores[1:]]
    assert spark.range(1).select(arrays.reduce_scores(kind, F.lit(actual), *missing)).first()[0][0] == (0.0 if kind == "actual_margin" else 0.5)


def test_shifts_undo_each_other_inside(spark):
    values = F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0)))
    there = arrays.shift_target(values, 1, 0.5)
    assert spark.range(1).select(there).first()[0] == [0.5, 1.0, 2.0, 3.0]
    assert spark.range(1).select(arrays.shift_target(there, -1, 0.5)).first()[0] == [1.0, 2.0, 3.0, 0.5]


def test_summary_of_nothing(spark):
    found = spark.range(1).select(*(c.alias(n) for n, c in arrays.vector_summary(F.array().cast("array<double>")).items())).first().asDict()
    assert found["empty_indicator"] == 1.0 and found["mean"] == 0.0 and found["finite_fraction"] == 0.0


def test_grid_padding(spark):
    row = spark.createDataFrame([("AU", "AC")], "m string, g string").select(arrays.encode_pair_grid("m", "g").alias("x")).first()["x"]
    assert len(row) == 1400 and list(row[:3]) == [0, 2, 17] and list(row[50:53]) == [4, 6, 17] and set(row[100:]) == {17}


def test_names(spark):
    assert one(spark, names.parse_mature_id(F.col("s")), s="Hsa-Let-7-P1b_5p* , Hsa-X_3p") == "Hsa-Let-7-P1b"
    assert one(spark, names.parse_reference_id(F.col("s")), s="Hsa-Mir-10-v2_3p") == "Hsa-Mir-10"
    assert one(spark, names.parse_mature_header(F.col("s")), s="Hsa-Let-7_3p")["arm"] == "3p"
    assert one(spark, names.parse_species_name(F.col("s")), s="Rat (brown) (Rattus norvegicus)").asDict() == {"common_name": "Rat (brown)", "scientific_name": "Rattus norvegicus"}
    assert one(spark, names.normalize_category(F.col("s")), s=" nan ") == names.MISSING
    assert one(spark, names.lineage_array(F.col("s")), s=" a ;; b;") == ["a", "b"]
