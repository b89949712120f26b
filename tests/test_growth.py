"""Steps whose figures grew faster than their input: their plans, and results on rows that the small tables lack."""

import functools
import gc
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedloom.functions import arrays
from seedloom.operators import alignment, annotation, assembly, tolerance
from seedloom.plans import catalog, inputs, records, tensors, views  # noqa: F401
from seedloom.streaming import scoring
from tests.oracle import connect, same


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.mark.parametrize("name", ("collect_orthologues", "gap_aware_posterior", "tolerance_scores", "score_table"))
def test_sides_of_unknown_size_are_not_sent_to_all_machines(name, spark, small):
    """these tables are as small as their files to Spark, and their rows millions."""
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, small))


def test_profiles_and_substrings_are_not_sent_to_all_machines(spark, small):
    """what is broadcast is counted; positions and substrings are on the other side."""
    for name in ("fit_mirna_scaler", "match_sequences"):
        text = plan(catalog.QUERIES[name](spark, small))
        assert not any("Generate" in part.split("BroadcastHashJoin")[0] for part in text.split("BroadcastExchange")[1:])


@pytest.mark.parametrize("name", ("unroot_trees", "prune_trees", "pruned_trees", "unrooted_edges"))
def test_trees_are_walked_in_batches(name, spark, small):
    """F16, F17, F18, F22."""
    text = plan(catalog.QUERIES[name](spark, small))
    assert "MapInArrow" in text and "FlatMapGroupsInPandas" not in text


@pytest.mark.parametrize("name", ("check_partial_missing", "check_compact_range"))
def test_a_filter_hashes_no_position_again(name, spark, small):
    """F9, F27."""
    assert plan(catalog.QUERIES[name](spark, small), "optimizedPlan").count("md5(") == 1


def test_an_array_is_ordered_once(spark):
    """the mean of a track was computed for each of its values."""
    made = spark.range(1).select(F.array(*map(F.lit, (3.0, 1.0, 2.0))).alias("x"))
    summary = arrays.vector_summary(F.col("x"))
    df = made.select(*(summary[n].alias(n) for n in ("mean", "std", "median")))
    assert plan(df, "analyzed").count("sort_array") == 3
    assert df.first().asDict() == pytest.approx({"mean": 2.0, "std": (2 / 3) ** 0.5, "median": 2.0})


def test_ends_of_a_mark_are_found_once_a_row(spark):
    """F10, F11."""
    df = spark.range(1).select(F.concat(F.lit(".."), F.col("id").cast("string"), F.lit("AB.")).alias("t"))
    text = plan(df.select(alignment.region_boundaries(alignment.flanking_mask(F.concat("t", F.lit(".")))).alias("e")), "analyzed")
    assert text.count("instr(") == 3


@pytest.mark.parametrize("name", ("vector_summary", "standardize", "pool_tokens", "parse_arrays", "concat_missingness", "outer_interactions"))
def test_tracks_are_made_without_an_exchange(name, spark, small):
    """F13, F26, F30, F31, F33, F34."""
    assert "Exchange hashpartitioning" not in plan(catalog.QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ("zip_score_quartet", "target_matrix"))
def test_positions_are_gathered_where_they_are_made(name, spark, small):
    """rows are dealt once, before they are taken apart."""
    text = plan(catalog.QUERIES[name](spark, small))
    assert "ENSURE_REQUIREMENTS" not in text and text.count("REPARTITION_BY_NUM") == 1 and text.index("REPARTITION_BY_NUM") > text.index("Generate")


@pytest.mark.parametrize("name", ("axis_grid", "decoded_pair_grids", "rc_pair_grid"))
def test_grids_are_not_written(name, spark, small):
    """Grids are 1400 bytes to 45 kB a row."""
    made = []
    keep = tensors.splits.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tensors.splits, "written", lambda df: made.append(df.columns) or keep(df))
        catalog.QUERIES[name](spark, small)
    assert not any("grid" in columns for columns in made)


def test_an_arm_that_is_its_own_reverse_complement(spark):
    """the 3p arm stands behind the 5p arm, even if they are equal."""
    made = spark.createDataFrame([("Hsa-M1_pre", "NNACGTNACGTN"), ("Hsa-M2_pre", "NTTTACGT")], "header string, seq string")
    arms = spark.createDataFrame([("Hsa", "M1", a, "ACGT") for a in ("5p", "3p")] + [("Hsa", "M2", "5p", "ACGT"), ("Hsa", "M2", "3p", "TTT")], "species string, precursor_id string, arm string, seq string")
    found = {r["precursor_id"]: (r["start_5p"], r["start_3p"], r["anchors"]) for r in annotation.anchor_strings(annotation.locate_mature_arms(made, arms)).collect()}
    assert found == {"M1": (2, 7, "..AAAA.BBBB."), "M2": (4, 1, ".BBBAAAA")}


def test_profiles_with_repeated_and_outside_positions(spark):
    """of repeated positions the largest value stays, and keys without a position inside have zeros."""
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, None), ("b", 9, 1.0)], "mature_id string, pos int, x double")
    found = {r["mature_id"]: (r["matrix"], r["mask"]) for r in assembly.profile_matrix(rows, ["x"], 2).collect()}
    assert found == {"a": ([[3.0, 0.0]], [1, 0]), "b": ([[0.0, 0.0]], [0, 0])}


def test_a_shift_orders_row_numbers_alone(spark, small):
    """tracks are exchanged once, and none is written."""
    made = []
    keep = tensors.splits.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tensors.splits, "written", lambda df: made.append(df.columns) or keep(df))
        catalog.QUERIES["random_target_shift"](spark, small)
    assert made and all(set(c) == {"row_id", "_part"} for c in made)


def test_buckets_grow_with_the_rows(spark, small, monkeypatch):
    """scores are stored in as many buckets as rows ask for, and equal their SQL."""
    monkeypatch.setattr(tensors, "BUCKET_ROWS", 40)
    same(catalog.QUERIES["bucketed_position_scores"](spark, small), connect(small), catalog.ORACLES["bucketed_position_scores"])


def test_arrays_that_are_zipped_are_made_once_a_row(spark):
    """an array named inside a lambda was made again for each position."""
    own = F.reverse(F.array(F.lit(1.0), F.lit(2.0)))
    df = spark.range(1).select(arrays.zip_score_quartet(own, own, own, own, 2).alias("q"))
    text = plan(df, "analyzed")
    assert text.index("reverse(") < text.index("sequence(")
    assert [r["A"] for r in df.first()["q"]] == [2.0, 1.0]


def test_a_model_that_leaves_cycles_keeps_no_batches(spark):
    """``.str`` accessors hold their frame in a cycle, and workers grew with their rows."""

    def load():
        import weakref

        import pandas as pd

        class Held:
            pass

        seen = []

        def score(frame):
            held = Held()
            held.own, held.frame = held, frame
            alive = sum(r() is not None for r in seen)
            seen.append(weakref.ref(held))
            return pd.Series([float(alive)] * len(frame), index=frame.index)

        return score

    df = spark.range(0, 200, 1, 1).select(F.col("id").cast("string").alias("id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        alive = [r["prediction"] for r in scoring.score_rows(df, load).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(alive) == 200 and max(alive) <= 1


def test_codes_of_a_batch_leave_no_cycle():
    """a batch's letters stayed in memory until the next garbage collection."""
    made = pd.Series(["acg", None, "UXT"])
    gc.collect()
    gc.disable()
    try:
        codes = arrays._pair_codes(made, 4)
        assert gc.collect() == 0
    finally:
        gc.enable()
    assert codes.tolist() == [[0, 2, 3, -1], [-1] * 4, [1, -1, 1, -1]]


@pytest.mark.parametrize("name", ("check_positions_complete", "uneven_positions"))
def test_profiles_are_checked_in_tasks_of_even_size(name, spark, small, monkeypatch):
    """as many tasks as rows ask for, and positions are not exchanged again."""
    monkeypatch.setattr(views, "spread", functools.partial(views.spread, rows=20))
    text = plan(catalog.QUERIES[name](spark, small))
    assert int(re.search(r"hashpartitioning\(mature_id#\d+, (\d+)\), REPARTITION_BY_NUM", text)[1]) >= 10
    assert all(text.index("Generate") < at.start() for at in re.finditer("Exchange", text))
    same(catalog.QUERIES[name](spark, small), connect(small), catalog.ORACLES[name])


def test_scores_meet_where_their_rows_are_dealt(spark, small, monkeypatch):
    """states, letters and nodes are exchanged once by query and range, neither weights nor sums again; as many tasks as letters ask for."""
    monkeypatch.setattr(tolerance, "TASK_LETTERS", 1000, raising=False)
    text = plan(catalog.QUERIES["score_table"](spark, small))
    dealt = [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\(([^)]*\bspan\b[^)]*)\), (?=REPARTITION_BY_NUM)", text)]
    others = {re.sub(r"#\d+L?|, \d+$", "", keys) for keys in re.findall(r"hashpartitioning\(([^)]*\bspan\b[^)]*)\)", text)}
    assert len(dealt) == 1 and int(dealt[0].split(", ")[-1]) > 1 and others == {"query_id, span"}
    same(catalog.QUERIES["score_table"](spark, small), connect(small), catalog.ORACLES["score_table"])


def test_a_position_is_tested_once_for_all_its_channels(spark, small, monkeypatch):
    """F1: seven channels, each put together anew from the four scores and the base, were more than Spark compiles."""
    fitted = []
    keep = assembly.fit_columns
    monkeypatch.setattr(assembly, "fit_columns", lambda df, columns: fitted.append(df) or keep(df, columns))
    made = [catalog.QUERIES[name](spark, small) for name in ("target_matrix", "target_tensor")]
    assert len(fitted) == 1
    for df in made + fitted:
        text = plan(df, "optimizedPlan")
        assert text.count("upper(") == 1 and len(text) < 20_000


def test_target_channels_of_uneven_positions(spark):
    """F1: positions in any order, repeated, absent or outside, scores that are missing or no numbers, in one step with the others."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 2, "a", 4.0, 1.0, 2.0, 3.0), (1, 1, "T", 4.0, 1.0, 2.0, 8.0), (1, 1, "T", 6.0, 1.0, 2.0, 3.0), (1, 9, "A", 1.0, 1.0, 1.0, 1.0), (1, None, "A", 1.0, 1.0, 1.0, 1.0),
        (2, 1, "A", nan, 1.0, 1.0, 1.0), (2, 2, "C", 1.0, 1.0, inf, 1.0), (2, 3, None, 1.0, 1.0, 1.0, 1.0), (3, 0, "G", 1.0, 1.0, 1.0, 1.0), (4, 3, "G", 0.0, 0.0, 0.0, 0.0), (4, 2, "C", 0.0, 3.0, 0.0, 0.0), (4, 1, "A", 1e308, 1e308, 1e308, 1e308),
    ]
    df = spark.createDataFrame(rows, "row_id int, pos int, actual_nt string, score_a double, score_c double, score_g double, score_t double")
    found = {r["row_id"]: (r["matrix"], r["mask"], r["has_any"]) for r in assembly.target_matrix(df, tensors.SCORES, 3).collect()}
    none = ([[0.0] * 3] * 7, [0] * 3, 0)
    # Of a repeated position each channel keeps its largest value; a sum beyond all numbers leaves its mean and difference 0.
    first = ([[6.0, 4.0, 0.0], [1.0, 1.0, 0.0], [2.0, 2.0, 0.0], [8.0, 3.0, 0.0], [8.0, 4.0, 0.0], [3.0, 2.0, 0.0], [8.0 - 7 / 3, 2.0, 0.0]], [1, 1, 0], 1)
    last = ([[1e308, 0.0, 0.0], [1e308, 3.0, 0.0], [1e308, 0.0, 0.0], [1e308, 0.0, 0.0], [1e308, 3.0, 0.0], [0.0] * 3, [0.0, 3.0, 0.0]], [1, 1, 1], 1)
    assert found == {1: first, 2: none, 3: none, 4: last}
