"""The feature vector, tensors and checks of models' inputs, by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedloom.functions import sequence
from seedloom.operators import assembly, splits


def summary(values):
    x = np.array([v for v in values if v is not None and math.isfinite(v)])
    if not len(x):
        return [0.0] * 7 + [0.0, 1.0]
    return [x.mean(), x.std(), x.min(), x.max(), np.median(x), *np.quantile(x, (0.25, 0.75)), len(x) / len(values), 0.0]


def test_assembled_features_row_by_row(spark):
    rows = [(1, "ACGTACGTTGCAACGTNACGTACGATCGATCGATTACGGATC", "UACGUACGAUCGAUCGAUCGAU", [1.0, 2.0, None, 4.0], [0.5] * 3, 3, 1, 1), (2, "GGGCCCAT", "", [None, float("nan")], None, None, 0, None), (3, None, "ACGTA", [], [0.25], 0, 0, 0)]
    df = spark.createDataFrame(rows, "row_id int, gene string, mirna string, phylop array<double>, phastcons array<double>, candidate_count int, has_selected_profile int, has_target_scores int")
    names = assembly.feature_names(("phylop", "phastcons"))
    assert len(names) == len(set(names)) == 104
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    clean = lambda s: "".join(c if c in "ACGT" else "N" for c in (s or "").upper().replace("U", "T"))
    count = lambda g, p: sum(g.startswith(p, i) for i in range(len(g))) if p and "N" not in p else 0
    gc = lambda s: sum(c in "GC" for c in s) / len(s) if s else 0.0
    for r in assembly.assemble_features(df).collect():
        g, m = clean(r["gene"]), clean(r["mirna"])
        part = lambda a, b, m=m: rc(m[a:b]) if len(m) >= b else ""
        seed = rc(m[1:8])
        longest = max([k for k in range(1, len(seed) + 1) for i in range(len(seed) - k + 1) if seed[i : i + k] in g], default=0)
        want = [len(g), len(m), gc(g), gc(m), longest, count(g, part(1, 7)), count(g, part(1, 8)), *summary(r["phylop"] or []), *summary(r["phastcons"] or [])]
        want += [r[c] or 0 for c in assembly.FLAGS] + [count(g, part(a, b)) for _, a, b in sequence.EXACT_SEGMENTS] + list(sequence.window_table(pd.Series([g]), pd.Series([m]))[0])
        assert np.allclose(r["features"], want), [(n, a, b) for n, a, b in zip(names, r["features"], want) if not math.isclose(a, b, abs_tol=1e-9)]


def test_profiles_of_selected_candidates(spark):
    profiles = spark.createDataFrame([("m", 1, 2.0, float("nan")), ("m", 3, None, None), ("m", 2, 4.0, 1.0), ("m", 9, 5.0, 5.0), ("n", 9, 1.0, 1.0)], "mature_id string, pos int, a double, c double")
    made = assembly.profile_matrix(profiles, ["a", "c"], 3)
    assert {r["mature_id"]: (r["matrix"], r["mask"]) for r in made.collect()} == {"m": ([[2.0, 4.0, 0.0], [0.0, 1.0, 0.0]], [1, 1, 0]), "n": ([[0.0] * 3] * 2, [0, 0, 0])}
    scaler = spark.createDataFrame([("a", 2.0, 2.0), ("c", 1.0, 0.5)], "source string, mean double, std double")
    scaled = assembly.standardize_matrix(made, ["a", "c"], scaler)
    whole = assembly.attach_selected_profile(spark.createDataFrame([("x",), ("y",), ("z",)], "id string"), spark.createDataFrame([("x", "m"), ("z", "unknown")], "id string, mature_id string"), scaled, 3, 3)
    assert {r["id"]: r["profile"] for r in whole.collect()} == {"x": [[0.0, 1.0, 0.0], [-2.0, 0.0, 0.0], [1.0, 1.0, 0.0]], "y": [[0.0] * 3] * 3, "z": [[0.0] * 3] * 3}


def test_target_matrix(spark):
    rows = [(1, 1, "A", 4.0, 1.0, 2.0, 3.0), (1, 2, "N", 1.0, 1.0, 1.0, 1.0), (1, 3, "g", 1.0, 1.0, 7.0, 1.0), (2, 1, "C", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id int, pos int, actual_nt string, score_a double, score_c double, score_g double, score_t double")
    got = {r["row_id"]: r for r in assembly.target_matrix(df, {b: f"score_{b.lower()}" for b in "ACGT"}, 3).collect()}
    assert got[1]["matrix"] == [[4.0, 0.0, 1.0], [1.0, 0.0, 1.0], [2.0, 0.0, 7.0], [3.0, 0.0, 1.0], [4.0, 0.0, 7.0], [2.0, 0.0, 1.0], [2.0, 0.0, 6.0]] and got[1]["mask"] == [1, 0, 1]
    assert got[1]["has_any"] == 1 and got[2]["has_any"] == 0 and got[2]["mask"] == [0, 0, 0]


def test_score_models_and_channels():
    columns = ["id", *(f"s_a1p5_{b}" for b in "ACGT"), *(f"s_raw.x_{b}" for b in "ACGT")]
    assert assembly.resolve_score_models(columns, ["a1.5", "raw.x"], "s") == {"a1p5": columns[1:5], "raw.x": columns[5:]}
    assert assembly.resolve_score_models([f"score_{b}" for b in "acgt"], ["any"], "s") == {"any": [f"score_{b}" for b in "acgt"]}
    with pytest.raises(ValueError, match="no columns of: b, c; there are a1p5, raw.x"):
        assembly.resolve_score_models(columns, ["b", "raw.x", "c"], "s")
    for bad in ((columns, ["b"]), ([f"score_{b}" for b in "ACGT"], ["a", "b"]), (columns, [])):
        with pytest.raises(ValueError):
            assembly.resolve_score_models(*bad, "s")
    with pytest.raises(ValueError):
        assembly.select_channels("none", F.lit(1), F.lit(2))


def test_weights_candidates_and_shifts(spark):
    rows = spark.range(3).withColumnRenamed("id", "row_id")
    frame = lambda x: spark.createDataFrame(x, "row_id bigint, weight double")
    assert sorted(map(tuple, assembly.attach_sample_weights(rows, frame([(0, 1.0), (1, 0.0), (2, 2.5)])).collect())) == [(0, 1.0), (1, 0.0), (2, 2.5)]
    for bad in ([(0, 1.0), (1, 1.0)], [(0, 1.0), (1, -1.0), (2, 1.0)], [(0, 1.0), (1, float("inf")), (2, 1.0)], [(0, 1.0), (1, None), (2, 1.0)], [(0, 1.0), (0, 1.0), (1, 1.0), (2, 1.0)]):
        with pytest.raises(ValueError):
            assembly.attach_sample_weights(rows, frame(bad))
    found = assembly.candidates_of_samples(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "m", 1)], "id string, mature_id string, candidate_count int"))
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == ["('a', 'm', 1)", "('b', None, 0)"]
    assert [tuple(r) for r in spark.range(1).select(assembly.select_channels("both", F.array(F.lit(1)), F.array(F.lit(2)))).collect()] == [([1, 2],)]
    scored = spark.createDataFrame([("s", 1, 0.9), ("s", 0, 0.1)], "split string, label int, probability_1 double")
    worse = spark.createDataFrame([("s", 0, 0.9), ("s", 1, 0.1)], "split string, label int, probability_1 double")
    assert {r["shift"]: r["auroc"] for r in assembly.metrics_by_shift({0: scored, 2: worse}, ["split"]).collect()} == {0: 1.0, 2: 0.0}


def test_numbers_do_not_rest_on_reused_exchanges(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(0, 400_000, 1, 8).select(F.xxhash64("id").alias("x"))
        got = splits.numbered(df, [F.col("x")], "n", 50).agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
        assert tuple(got) == (400_000, 1, 400_000)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
