import random

import pytest
from pyspark.sql import functions as F

from seedloom.operators import alignment, annotation, features, metrics, positions, species, splits, tolerance, validation
from seedloom.plans import catalog


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_validation_names_every_rule(spark):
    good = "ACGT" * 12 + "AC"
    data = [("1", good, "ACG", 1), ("1", good, "ACG", 0), (None, good, "ACG", 1), ("2", good[:-1], "AX", 2), ("3", good.lower(), "acu", 0)]
    df = spark.createDataFrame(data, "id string, gene string, mirna string, label int")
    found = {r["id"]: r["errors"] for r in validation.validate_interactions(df).collect()}
    assert found == {"1": ["duplicate_id"], None: ["empty_id"], "2": ["gene_length", "mirna_letters", "label"], "3": []}
    with pytest.raises(ValueError, match="a, b"):
        validation.require_columns(df, ["id", "a", "b"])


def test_positions_are_reported(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 4), ("b", 1), ("b", 2), ("b", 3)], "k string, pos int")
    assert rows(validation.check_positions_complete(df, "k", "pos", 3)) == [("a", 1, 1, 1, 2), ("b", 3, 0, 0, 0)]


def test_annotation_steps(spark):
    cat = spark.createDataFrame([("A_5p", "AAAA", 0), ("B_3p", "AAAA", 1), ("C_5p", "CCCCGG", 2), ("D_5p", "CCCCTT", 3), ("E_5p", "", 4)], "header string, seq string, input_pos int")
    got = {r["row_seq"]: (r["header"], r["step"], r["n_ambiguous"]) for r in annotation.match_sequences(spark.createDataFrame([(s,) for s in ("AAAA", "TAAAAT", "CCCC", "CCCG", "GGGG")], "seq string"), cat).collect()}
    assert got == {"AAAA": ("B_3p", 1, 0), "TAAAAT": ("B_3p", 2, 0), "CCCC": (None, 0, 1), "CCCG": ("C_5p", 3, 0), "GGGG": (None, 0, 0)}


def test_containment_equals_brute_force_without_a_nested_loop(spark):
    rng = random.Random(2)
    table = [(f"H{i}_5p", "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 9))), i) for i in range(300)]
    seqs = sorted({"".join(rng.choice("ACGT") for _ in range(rng.randint(2, 12))) for _ in range(120)})
    found = annotation.match_sequences(spark.createDataFrame([(s,) for s in seqs], "seq string"), spark.createDataFrame(table, "header string, seq string, input_pos int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    last = {s: h for h, s, _ in table}
    for r in found.collect():
        q, want = r["row_seq"], (None, 0)
        for step, near in ((1, [s for s in last if s == q]), (2, [s for s in last if s in q]), (3, [s for s in last if q in s])):
            least = min((abs(len(s) - len(q)) for s in near), default=0)
            best = [last[s] for s in near if abs(len(s) - len(q)) == least]
            if len(best) == 1 and not want[1]:
                want = (best[0], step)
        assert (r["header"], r["step"]) == want


def test_match_query_reads_the_whole_catalogue(spark, small):
    assert "< 400" not in catalog.QUERIES["match_sequences"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_orthologues_prefer_primary_records(spark):
    main = spark.createDataFrame([("Hsa-1",)], "name string")
    links = spark.createDataFrame([("Hsa-1", "Mmu-1"), ("Hsa-1", "Rno-1")], "name string, orthologue string")
    pri = spark.createDataFrame([("Hsa-1_pri", "AC"), ("Mmu-1-pri", "GG")], "header string, seq string")
    pre = spark.createDataFrame([("Mmu-1_pre", "TT"), ("rno-1", "CC")], "header string, seq string")
    assert rows(annotation.collect_orthologues(main, links, pri, pre)) == [("Hsa-1", "Hsa-1_pre", "AC"), ("Hsa-1", "Mmu-1-pri", "GG"), ("Hsa-1", "rno-1", "CC")]


def test_gap_only_sequences_go(spark):
    df = spark.createDataFrame([("q", "a", "A*C", 1), ("q", "b", "--n", 2), ("q", "c", "", 3)], "query_id string, seq_id string, aligned string, input_pos int")
    assert [r["aligned"] for r in alignment.filter_gap_only(df).collect()] == ["A-C"]


def test_missing_species_follow_in_order(spark):
    df = spark.createDataFrame([("q", "Hsa", "AC", 1), ("q", "Mmu-2", "A-", 2)], "query_id string, seq_id string, aligned string, input_pos int")
    tree = spark.createDataFrame([("q", c) for c in ("Rno", "Hsa", "Mmu", "Bta")], "query_id string, code string")
    assert rows(alignment.add_missing_species(df, tree)) == [("q", "Bta", "--", 3), ("q", "Hsa", "AC", 1), ("q", "Mmu-2", "A-", 2), ("q", "Rno", "--", 4)]


def test_structures_and_masks(spark):
    row = spark.range(1)
    assert row.select(alignment.project_structure(F.lit("A--CG"), F.lit("(."))).first()[0] == "(...."
    assert row.select(alignment.flanking_mask(F.lit("..AB."))).first()[0] == [True, True, False, False, True]
    assert row.select(alignment.flanking_mask(F.lit("..A.."))).first()[0] is None
    assert row.select(alignment.region_boundaries(alignment.flanking_mask(F.lit("..AB.")))).first()[0] == [2, 4]
    assert row.select(alignment.binarize_alignment(F.lit("A-nt"))).first()[0] == "10-1"


def test_tolerance_of_a_small_tree(spark):
    # One inner node u over the query and one other leaf: only the node's own term, the query's and the leaf's remain.
    edges = spark.createDataFrame([(1, 1, None, 0.0, 0, 0), (1, 2, 1, 1.0, 1, 1), (1, 3, 1, 2.0, 1, 0)], "query_id long, node int, parent int, branch_length double, is_leaf int, is_query int")
    post = spark.createDataFrame([(1, 1, 1, 0.5, 0.25, 0.125, 0.125)], "query_id long, node int, site int, p_a double, p_c double, p_g double, p_t double")
    msa = spark.createDataFrame([(1, 2, 1, "A"), (1, 3, 1, "C")], "query_id long, leaf int, site int, nt string")
    walked = tolerance.leaf_distances(edges)
    assert {r["node"]: (r["distance"], r["hops"]) for r in walked.collect()} == {2: (0.0, 0), 1: (1.0, 1), 3: (3.0, 1)}
    raw = tolerance.tolerance_scores(edges, walked, post, msa, "Equal", "raw").first().asDict()
    assert raw["wol_a"] == 1.0 and raw["wol_c"] == 0.25 and raw["wl_c"] == 1.0 and raw["wl_a"] == 1.0
    nn = tolerance.tolerance_scores(edges, walked, post, msa, "Equal", "NN").first().asDict()
    assert nn["wl_c"] == pytest.approx(raw["wl_c"] / 3) and nn["wol_c"] == raw["wol_c"]
    fn = tolerance.tolerance_scores(edges, walked, post, msa, "Equal", "FN").first().asDict()
    assert fn["wl_c"] == raw["wl_c"]
    with pytest.raises(ValueError):
        tolerance.distance_weights(walked, "MinThreshold")


@pytest.mark.parametrize("param", tolerance.PARAMS)
def test_weights_are_defined(spark, small, param):
    from seedloom.plans import views

    walked = tolerance.leaf_distances(views.trees(spark, small))
    assert tolerance.distance_weights(walked, param).where("weight is null or weight < 0").count() == 0


def test_metrics_of_one_class_and_ties(spark):
    one = spark.createDataFrame([("x", 1, 0.5), ("x", 1, 0.7)], "g string, label int, probability_1 double")
    assert metrics.ranking_metrics(one, ["g"]).first()["auroc"] is None
    ties = spark.createDataFrame([("x", 1, 0.5), ("x", 0, 0.5), ("x", 1, 0.9), ("x", 0, 0.1)], "g string, label int, probability_1 double")
    got = metrics.ranking_metrics(ties, ["g"]).first()
    assert got["auroc"] == pytest.approx(0.875) and got["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    scaled = ties.withColumn("probability_1", F.col("probability_1") / 2)
    assert metrics.ranking_metrics(scaled, ["g"]).first()["average_precision"] == pytest.approx(got["average_precision"])
    history = spark.createDataFrame([(1, 0.5, 0.2), (2, 0.6, 0.3), (3, 0.6, 0.3)], "epoch int, auprc double, log_loss double")
    assert metrics.best_checkpoint(history).first()["epoch"] == 2


def test_splits_are_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    for fraction in (0.0, 0.137, 1.0):
        assert splits.random_row_split(df, "k", fraction, 3).where("is_validation").count() == int(1000 * fraction)
    manifests = spark.createDataFrame([("a", 1, 1000, 0), ("b", 2, 1000, 0)], "dataset string, width int, row_count bigint, positive_rows bigint")
    with pytest.raises(ValueError, match="width"):
        splits.union_compatible({"a": df, "b": df}, manifests, ("width",))
    with pytest.raises(ValueError, match="1 samples without"):
        splits.attach_labels(df.limit(2).withColumnRenamed("k", "id"), df.limit(1).withColumnRenamed("k", "id").withColumn("label", F.lit(1)))


def test_candidates_and_vocabulary(spark):
    df = spark.createDataFrame([("a", 1, 0, "M1", 1), ("a", 0, 1, "M2", 1), ("a", 0, 2, "M3", 1), ("a", 2, 3, None, 1), ("b", 0, 0, "M1", 0)], "id string, candidate_index int, source_order int, mature_id string, has_profile int")
    assert [r["mature_id"] for r in features.select_candidate(df).collect()] == ["M2"]
    ranked = features.rank_candidates(df, 2)
    assert rows(ranked.select("id", "slot", "mature_id")) == [("a", 0, "M2"), ("a", 1, "M3")]
    words = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2 + [("na",)], "c string")
    assert rows(features.fit_vocab(words, "c", 2).select("index", "token")) == [(0, "__MISSING__"), (1, "__OTHER__"), (2, "x"), (3, "y")]
    constant = spark.createDataFrame([(1.0,), (1.0,), (float("nan"),)], "v double")
    assert features.fit_columns(constant, ["v"]).first().asDict() == {"source": "v", "n": 2.0, "mean": 1.0, "std": 1.0}


def test_relatives_without_common_taxa(spark):
    have = spark.createDataFrame([("p", ["x", "y"]), ("q", ["x", "z"])], "name string, lineage array<string>")
    lost = spark.createDataFrame([("m", ["x", "z", "w"]), ("n", ["o"])], "name string, lineage array<string>")
    assert rows(species.closest_relative(lost, have)) == [("m", 2, ["q"]), ("n", 0, ["q", "p"])]


def test_listings_of_tied_relatives(spark):
    have = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["x", "y"]), ("c", ["x", "y"]), ("d", ["z"]), ("e", None)], "name string, lineage array<string>")
    lost = spark.createDataFrame([("m", ["x", "y", "w"]), ("n", ["q"]), ("o", None), ("m", ["x", "y", "w"])], "name string, lineage array<string>")
    found = {r["name"]: (r["depth"], r["shown"], r["n_tied"]) for r in species.best_match_listing(lost, have, 2).collect()}
    assert found == {"m": (2, ["c", "b"], 2), "n": (0, ["e", "d"], 5), "o": (0, ["e", "d"], 5)}
    assert rows(species.best_match_listing(lost, have.limit(0))) == [("m", 0, [], 0), ("n", 0, [], 0), ("o", 0, [], 0)]


def test_scalers_keep_digits_of_large_means(spark):
    df = spark.createDataFrame([(1e9 + 1, 1), (1e9 + 3, 3), (None, 5), (float("nan"), 1)], "v double, w int")
    assert features.fit_columns(df, ["v"]).first().asDict() == {"source": "v", "n": 2.0, "mean": 1e9 + 2, "std": 1.0}
    weighted = features.fit_columns(df, ["v"], F.col("w")).first()
    assert weighted["n"] == 4.0 and weighted["mean"] == 1e9 + 2.5 and abs(weighted["std"] - 0.75**0.5) < 1e-9
    assert features.fit_columns(df.where("v is null"), ["v"], F.col("w")).first().asDict() == {"source": "v", "n": 0.0, "mean": 0.0, "std": 1.0}


def test_repeated_positions_do_not_shift_arrays(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 2, 5.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 2.0), (2, 3, 3.0)], "k int, pos int, v double")
    found = positions.position_arrays(df, ["k"], "pos", {"v": F.col("v")}, 3)
    assert rows(found) == [(1, [1.0, 5.0, None]), (2, [1.0, 2.0, 3.0])]


def test_query_leaves_by_tree(spark):
    msa = spark.createDataFrame([(1, 3, 1, "A"), (1, 4, 1, "A"), (1, 5, 1, "C"), (2, 3, 1, "A"), (2, 4, 1, "C"), (2, 5, 1, "C")], "query_id int, leaf int, site int, nt string")
    leaves = spark.createDataFrame([(1, 3), (2, 5)], "query_id int, leaf int")
    assert rows(tolerance.query_nt_count(msa, leaves)) == [(1, 1, 2), (2, 1, 2)] and rows(tolerance.query_nt_count(msa, 3)) == [(1, 1, 2), (2, 1, 1)]
