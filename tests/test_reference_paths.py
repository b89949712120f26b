"""Row numbers in file order, score tables, bucketed scores, checked streams, shifts, grids, unions and deep trees."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seedloom.functions import arrays
from seedloom.operators import assembly, positions, splits, tolerance
from seedloom.plans import tensors
from seedloom.plans import views as V
from seedloom.sources import readers, writers
from seedloom.streaming import scoring


@pytest.fixture
def lines(spark, tmp_path):
    """A table of five files of uneven length, cut into many small blocks."""
    n, rows = 0, []
    for f in range(5):
        with (tmp_path / f"part{f}.csv").open("w") as handle:
            handle.write("gene,note\n")
            for i in range((700 * (f + 1)) % 1500 + 3):
                handle.write(f"g{n},{'x' * (i % 17)}\n")
                rows.append(f"g{n}")
                n += 1
    return str(tmp_path), rows


@pytest.mark.parametrize("block", ["3k", "64k", "128m"])
@pytest.mark.parametrize("few", [0, 10**5])
def test_rows_are_numbered_as_they_stand(spark, lines, block, few):
    path, rows = lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        scan = readers.read_interactions(spark, path)
        got = {r["row_id"]: r["gene"] for r in splits.add_row_id(scan, broadcast_blocks=few).collect()}
        assert got == dict(enumerate(rows, 1))
        assert {r["id"]: r["gene"] for r in splits.default_ids(scan).collect()} == {str(i): g for i, g in enumerate(rows, 1)}
        plan = splits.add_row_id(scan)._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Sort [gene" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_given_ids_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,gene\n 7 ,A\nx,C\n")
    assert sorted(r["id"] for r in splits.default_ids(readers.read_interactions(spark, str(tmp_path / "a.csv"))).collect()) == ["7", "x"]


def test_raw_rows_and_scores_need_their_columns(spark, tmp_path):
    (tmp_path / "raw.tsv").write_text("\t".join(readers.RAW_COLUMNS) + "\n" + "\t".join("1" for _ in readers.RAW_COLUMNS) + "\n")
    assert "mirna" in readers.read_raw_rows(spark, str(tmp_path / "raw.tsv")).columns and len(readers.RAW_COLUMNS) == 18
    (tmp_path / "less.tsv").write_text("gene\tnoncodingRNA\tlabel\nA\tC\t1\n")
    with pytest.raises(ValueError, match="noncodingRNA_name.*gene_phastCons"):
        readers.read_raw_rows(spark, str(tmp_path / "less.tsv"))
    assert readers.read_raw_rows(spark, str(tmp_path / "less.tsv"), ("gene", "noncodingRNA", "label")).first()["mirna"] == "C"
    (tmp_path / "scores.tsv").write_text("split\trow_id\tpos\tactual_nt\ntrain\t1\t1\tA\ntest\t2\t1\tC\n")
    assert [r["row_id"] for r in readers.read_position_scores(spark, str(tmp_path / "scores.tsv"), "test").collect()] == ["2"]
    with pytest.raises(ValueError, match="score_a, score_c"):
        readers.read_position_scores(spark, str(tmp_path / "scores.tsv"), "test", ("split", "score_a", "score_c"))


def test_numbers_don_t_depend_on_buckets(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "k int")
    for rows in (1, 10, 10**6):
        assert all(r["place"] == r["k"] + 1 for r in splits.numbered(df, [F.col("k")], "place", rows).collect())


def test_split_summary(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    assert splits.split_summary(splits.random_row_split(df, "k", 0.25, 3), 0.25).first().asDict() == {"row_count": 103, "train_rows": 78, "val_rows": 25, "expected_val_rows": 25, "matches": True, "val_fraction": 0.25}


def made_tree(n_inner, seed, sites):
    """A random tree of one query: edges, states of its inner nodes and letters of its leaves; leaf 1000 is the query."""
    rng = random.Random(seed)
    edges, open_nodes = [(1, None, None, 0)], [1]
    for n in range(2, n_inner + 1):
        edges.append((n, rng.choice(open_nodes), rng.randint(1, 64) / 64, 0))
        open_nodes.append(n)
    leaves = [(1000 + i, n, rng.randint(1, 64) / 64, 1) for i, n in enumerate(rng.choice(open_nodes) for _ in range(2 * n_inner))]
    edges += leaves
    states, letters = [], []
    for s in range(1, sites + 1):
        for n in open_nodes:
            p = [rng.random() for _ in range(4)]
            states.append((n, s, *(x / sum(p) for x in p)))
        letters += [(leaf[0], s, rng.choice("ACGTacgt-N")) for leaf in leaves]
    return edges, states, letters


PARAMS = [(p, None) for p in tolerance.PARAMS] + [("2.5", None), ("MinThreshold", 0.1), ("MinThreshold_Gauss", 0.2)]


def frames(spark, made):
    edges = spark.createDataFrame([(1, *e, int(e[0] == 1000)) for e in made[0]], "query_id bigint, node int, parent int, branch_length double, is_leaf int, is_query int")
    states = spark.createDataFrame([(1, *s) for s in made[1]], "query_id bigint, node int, site int, p_a double, p_c double, p_g double, p_t double")
    return edges, splits.written(tolerance.leaf_distances(edges)), states, spark.createDataFrame([(1, *x) for x in made[2]], "query_id bigint, leaf int, site int, nt string")


def rounded(rows):
    return {k: [None if v is None else float(f"{v:.9g}") for v in vs] for k, vs in rows.items()}


def test_score_table_equals_single_schemes(spark):
    edges, distances, states, msa = frames(spark, made_tree(9, 3, 5))
    whole = rounded({(r["site"], r["param"], r["norm"], r["leaf_mode"]): [r["A"], r["C"], r["G"], r["T"]] for r in tolerance.score_table(edges, distances, states, msa, PARAMS, range_sites=2).collect()})
    assert len(whole) == 5 * len(PARAMS) * 3 * 2
    for param, least in PARAMS:
        for norm in tolerance.NORMS if param in ("mean", "X") else ("FN",):
            for r in tolerance.tolerance_scores(edges, distances, states, msa, param, norm, least).collect():
                for mode in tolerance.LEAF_MODES:
                    want = rounded({0: [r[f"{mode}_{b}"] for b in "acgt"]})[0]
                    assert whole[r["site"], param, norm, mode] == pytest.approx(want, rel=1e-8, abs=1e-12), (param, norm, mode)


@pytest.mark.parametrize("span", [7, 10**6])
def test_site_ranges_don_t_change_scores(spark, span):
    edges, distances, states, msa = frames(spark, made_tree(4, 8, 30))
    read = lambda n: rounded({tuple(r)[:5]: list(r)[5:] for r in tolerance.score_table(edges, distances, states, msa, [("mean", None), ("Equal", None)], range_sites=n).collect()})
    got, want = read(span), read(3)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-8) for k in want)


@pytest.mark.parametrize("span", [1, 4, 256])
def test_a_site_without_states_has_the_query_s_own_letter(spark, span):
    """such sites were left out unless another site of their range had states; single schemes have them all."""
    edges, states, letters = made_tree(3, 6, 6)
    made = edges, [s for s in states if s[1] not in (2, 6)], letters
    edges, distances, states, msa = frames(spark, made)
    single = tolerance.tolerance_scores(edges, distances, states, msa, "mean", "raw").collect()
    got = rounded({r["site"]: [r["A"], r["C"], r["G"], r["T"]] for r in tolerance.score_table(edges, distances, states, msa, [("mean", None)], ("raw",), span).where("leaf_mode = 'wl'").collect()})
    want = rounded({r["site"]: [r[f"wl_{b}"] for b in "acgt"] for r in single})
    assert got.keys() == set(range(1, 7)) and all(got[k] == pytest.approx(want[k], rel=1e-8) for k in got)


def test_sums_of_scores_have_one_order(spark, monkeypatch):
    """however rows are dealt, reruns agree in the last bit."""
    edges, distances, states, msa = frames(spark, made_tree(9, 4, 20))
    read = lambda s, m, n: {tuple(r) for r in tolerance.score_table(edges, distances, s, m, [("mean", None), ("0_MinNode_Mix", None)], range_sites=n).collect()}
    first = read(states, msa, 4)
    monkeypatch.setattr(tolerance, "TASK_LETTERS", 50, raising=False)
    assert all(read(states.repartition(k), msa.orderBy(F.desc("leaf")).repartition(k + 1), 7) == first for k in (2, 5))


def test_one_long_query_runs_in_even_tasks(spark):
    """10^4 sites of one tree: the rows that meet in a join are spread, though all are of one query."""
    nodes = spark.createDataFrame([(1, n, n // 2 or None, 0.5, int(n >= 8), int(n == 8)) for n in range(1, 16)], "query_id bigint, node int, parent int, branch_length double, is_leaf int, is_query int")
    sites = spark.range(1, 10_001).select(F.lit(1).cast("bigint").alias("query_id"), F.col("id").cast("int").alias("site"))
    inner, leaves = nodes.where("is_leaf = 0").select("query_id", "node"), nodes.where("is_leaf = 1").select("query_id", F.col("node").alias("leaf"))
    states = sites.join(inner, "query_id").select("query_id", "node", "site", *(F.lit(0.25).alias(f"p_{b}") for b in "acgt"))
    msa = sites.join(leaves, "query_id").withColumn("nt", F.lit("A"))
    table = tolerance.score_table(nodes, splits.written(tolerance.leaf_distances(nodes)), states, msa, [("mean", None)], ("NN",))
    assert table.count() == 20_000
    spread = states.repartition(8, "query_id", tolerance.site_range("site", tolerance.RANGE_SITES), "node").groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    assert len(spread) == 8 and spread.max() < 2 * spread.mean()
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and not [x for x in plan.split("hashpartitioning(")[1:] if "span" not in x.split(")")[0] and "site" in x.split(")")[0]]


def test_score_files(spark, tmp_path):
    edges, distances, states, msa = frames(spark, made_tree(3, 5, 4))
    table = tolerance.score_table(edges, distances, states, msa, [("X", None), ("0", None)], ("NN", "raw"))
    writers.write_scores(table, str(tmp_path / "scores"))
    read = spark.read.option("header", True).csv(str(tmp_path / "scores"))
    assert {(r["norm"], r["param"], r["leaf_mode"]) for r in read.select("norm", "param", "leaf_mode").distinct().collect()} == {(n, p, m) for n in ("NN", "raw") for p in ("max05_Gauss", "0") for m in ("wl", "wol")}
    assert set(read.columns) == {"query_id", "Pos/NT", "A", "T", "G", "C", "norm", "param", "leaf_mode"} and read.count() == 4 * 8
    with pytest.raises(ValueError):
        tolerance.score_table(edges, distances, states, msa, [("X", None)], ("ZZ",))


def test_bucketed_scores_are_joined_without_an_exchange(spark, small):
    names = tensors.bucketed_tables(spark, small)
    found = tensors.attached_from_tables(spark, names, "train")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("PartitionFilters: [isnotnull(split") == 3 and f"SelectedBucketsCount: {tensors.BUCKETS} out of" in plan
    rows = V.interactions(spark, small).where("split = 'train'")
    assert found.count() == rows.count() and found.where("size(missing) > 0").count() == 0
    for name in names:
        spark.sql(f"drop table {name}")


def test_profiles_beyond_the_bound_are_shuffled(spark, small):
    rows = V.interactions(spark, small)
    target = positions.position_arrays(V.target_positions(spark, small), ["row_id"], "pos", {"target_scores": F.col("score_a")}, 50)
    mirna = positions.position_arrays(V.mirna_positions(spark, small), ["mature_id"], "pos", {"mirna_scores": F.col("param_1_a")}, 28)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        few, many = positions.attach_position_scores(rows, mirna, target), positions.attach_position_scores(rows, mirna, target, broadcast_profiles=1)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString() and "[mature_id" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, few.select("row_id", "mirna_scores", "missing").collect())) == sorted(map(str, many.select("row_id", "mirna_scores", "missing").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


STREAM = "id string, gene string, mirna string, mature_id string, arrived timestamp"


def stream_rows(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = [(str(i), "ACGU" * 12, "acg", "M1", now) for i in range(9)] + [("", "ACGU", "ACG", "M1", now), ("x", "AXGU", None, "M1", now), (None, " ", "A", "M1", now), ("3", "ACGU" * 12, "acg", "M1", now), ("y", "acgn", "uuu", None, now)]
    return spark.createDataFrame(rows, STREAM)


def load():
    return lambda frame: pd.Series([0.75] * len(frame), index=frame.index)


def run(spark, folder, model=load, **more):
    query = scoring.stream_encode_and_score(spark, f"{folder}/in", f"{folder}/out", f"{folder}/log", STREAM, model, rejected=f"{folder}/bad", files_a_batch=1, **more)
    query.awaitTermination(120)
    return query


def test_stream_sets_bad_rows_apart(spark, tmp_path):
    stream_rows(spark).repartition(3).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path)
    bad = {r["id"]: r["errors"] for r in spark.read.parquet(f"{tmp_path}/bad").collect()}
    assert bad == {"": ["empty_id"], "x": ["gene_letters", "mirna_missing"], None: ["empty_id", "gene_missing"]}
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted([*map(str, range(9)), "3", "y"])


def test_stream_goes_on_after_a_failure_without_doubles(spark, tmp_path):
    stream_rows(spark).repartition(4).write.parquet(f"{tmp_path}/in")
    flag = tmp_path / "broken"
    flag.write_text("yes")
    marker = str(flag)

    def fragile():
        import os

        def score(frame):
            if os.path.exists(marker) and (frame["id"] == "3").any():
                raise RuntimeError("the model broke")
            return pd.Series([0.75] * len(frame), index=frame.index)

        return score

    with pytest.raises(Exception, match="the model broke"):
        run(spark, tmp_path, fragile)
    flag.unlink()
    run(spark, tmp_path, fragile)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted([*map(str, range(9)), "3", "y"])
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 3
    # Files that come later are added; those read before aren't read again.
    stream_rows(spark).where("id = '5'").write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path, fragile)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12


def test_stream_drops_repeated_ids_if_asked(spark, tmp_path):
    stream_rows(spark).repartition(3).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path, watermark=("arrived", "1 hour"))
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted([*map(str, range(9)), "y"])
    with pytest.raises(ValueError):
        scoring.stream_encode_and_score(spark, "in", "out", "log", STREAM + ", prediction double", load)


@pytest.mark.parametrize("k", [-60, -50, -3, 0, 4, 50, 61])
def test_shifts_by_a_column(spark, k):
    values = [float(i) for i in range(50)]
    text = "".join("ACGT"[i % 4] for i in range(50))
    df = spark.createDataFrame([(values, text, k)], "v array<double>, s string, k int")
    row = df.select(arrays.shifted(F.col("v"), F.col("k"), F.lit(-1.0)).alias("v"), arrays.shifted_text(F.col("s"), F.col("k")).alias("s")).first()
    assert row["v"] == [values[i - k] if 0 <= i - k < 50 else -1.0 for i in range(50)]
    assert row["s"] == "".join(text[i - k] if 0 <= i - k < 50 else "N" for i in range(50))


def test_shifts_are_one_a_batch(spark):
    draws = spark.range(5000).select(arrays.random_shift(1, 2, F.col("id"), 3).alias("k")).groupBy("k").count().collect()
    assert {r["k"] for r in draws} == set(range(-3, 4)) and all(500 < r["count"] < 950 for r in draws)


def test_planes_of_a_grid(spark):
    df = spark.createDataFrame([("UGACGT", "ACGTTN"), ("", "A"), (None, None)], "mirna string, gene string")
    grids = df.select(arrays.rc_pair_grid("mirna", "gene").alias("g"), arrays.rc_pair_features("mirna", "gene").alias("n"))
    for r in grids.select("n", *(arrays.grid_plane(c)("g").alias(c) for c in arrays.PAIR_CHANNELS)).collect():
        assert [sum(r[c]) for c in arrays.PAIR_CHANNELS] == r["n"] and all(len(r[c]) == 1400 for c in arrays.PAIR_CHANNELS)


def test_standardize_leaves_no_infinity(spark):
    df = spark.createDataFrame([([1.0, None, float("inf"), float("-inf"), float("nan"), 3.0],)], "v array<double>")
    assert df.select(arrays.standardize(F.col("v"), F.lit(1.0), F.lit(2.0)).alias("v")).first()["v"] == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_target_scaler_counts_by_two_rules(spark):
    rows = [(1, 1, "A", 1.0, 2.0, 3.0, 4.0), (1, 2, "N", 5.0, 2.0, 3.0, 4.0), (1, 3, "c", 3.0, None, 3.0, 4.0), (1, 4, "C", 3.0, float("inf"), 3.0, 4.0), (1, 99, "A", 9.0, 9.0, 9.0, 9.0), (2, 1, "U", None, None, None, None)]
    df = spark.createDataFrame(rows, "row_id int, pos int, actual_nt string, a double, c double, g double, t double")
    scaler = assembly.TargetScaler.fit(df, dict(zip("ACGT", "acgt")), 50)
    assert scaler.stats["score_A"] == (4.0, 3.0, pytest.approx(2**0.5)) and scaler.stats["score_C"][0] == 2.0 and scaler.stats["actual_score"] == (1.0, 1.0, 1.0)
    got = {r["row_id"]: r for r in scaler.transform(df).collect()}
    assert got[2]["has_any"] == 0 and all(x == 0.0 for plane in got[2]["tensor"] for x in plane)
    assert len(got[1]["tensor"]) == 8 and got[1]["tensor"][7] == [1.0] + [0.0] * 49 and got[1]["tensor"][0][0] == pytest.approx((1 - 3) / 2**0.5)


def test_unions_name_what_differs(spark):
    manifests = spark.createDataFrame([("a", 50, ["x"], 10, 1), ("b", 50, ["x"], 20, 2), ("c", 49, ["y"], 5, 5), ("d", None, ["x"], 1, 1)], "dataset string, target_length int, phact_models array<string>, row_count bigint, positive_rows bigint")
    parts = {n: spark.range(3) for n in "abcd"}
    rows, manifest = splits.union_compatible({n: parts[n] for n in "ab"}, manifests)
    assert rows.count() == 6 and manifest.first().asDict() == {"target_length": 50, "phact_models": ["x"], "datasets": ["a", "b"], "row_count": 30, "positive_rows": 3}
    with pytest.raises(ValueError, match="c differs from a in: phact_models, target_length; d differs from a in: target_length"):
        splits.union_compatible(parts, manifests)
    with pytest.raises(ValueError, match="no manifest of: e"):
        splits.union_compatible({"a": parts["a"], "e": parts["a"]}, manifests)


def newick(node, children, length):
    """Text of a tree, built from its leaves up so that chains of any depth do."""
    text = {}
    for n in sorted(children, reverse=True):
        inside = ",".join(text.pop(c) for c in children[n])
        own = f"({inside})" if children[n] else f"s{n}"
        text[n] = own + (f":{length[n]}" if n != node else "")
    return text[node] + ";"


def all_pairs_from(start, parent, length):
    """Distances and nodes on the way from one leaf, by comparing the ways to the root."""
    def up(n):
        way = [n]
        while parent[way[-1]] is not None:
            way.append(parent[way[-1]])
        return way

    own = up(start)
    place = {n: i for i, n in enumerate(own)}
    found = {}
    for n in parent:
        way = up(n)
        meet = next(i for i, x in enumerate(way) if x in place)
        found[n] = (sum(length[x] for x in way[:meet]) + sum(length[x] for x in own[: place[way[meet]]]), meet + place[way[meet]])
    return found


@pytest.mark.parametrize("kind", ["random", "chain"])
@pytest.mark.parametrize("leaves", [114, 470, 3000])
def test_deep_and_wide_trees(spark, tmp_path, kind, leaves):
    rng = random.Random(leaves)
    if kind == "chain" and leaves == 3000:
        leaves = 1500
    children, parent, length, n = {1: []}, {1: None}, {1: 0.0}, 1

    def add(p):
        nonlocal n
        n += 1
        children[n], parent[n], length[n] = [], p, rng.randint(1, 16) / 16
        children[p].append(n)
        return n

    if kind == "chain":
        top = 1
        for _ in range(leaves - 2):
            add(top)
            top = add(top)
        add(top), add(top)
    else:
        tips = [add(1), add(1), add(1)]
        while len(tips) < leaves:
            p = tips.pop(rng.randrange(len(tips)))
            tips += [add(p), add(p)]
    (tmp_path / "t.nwk").write_text(newick(1, children, length))
    trees = readers.read_newick(spark, str(tmp_path / "t.nwk"))
    names = [f"s{x}" for x in children if not children[x]]
    assert trees.where("is_leaf = 1").count() == len(names) == leaves
    query = names[-1]
    # The parser's numbers of nodes are its own: leaves are compared by name.
    label = {r["node"]: r["label"] for r in trees.collect()}
    want = all_pairs_from(int(query[1:]), parent, length)
    got = tolerance.tree_distances(trees, spark.createDataFrame([("t", query)], "query_id string, seq_id string")).where("is_leaf = 1").collect()
    assert len(got) == leaves
    for r in got:
        d, steps = want[int(label[r["node"]][1:])]
        assert r["distance"] == pytest.approx(d) and (label[r["node"]] == query or r["hops"] == steps - 1)
    kept = sorted(rng.sample(names, 40))
    pruned = readers.change_trees(trees, spark.createDataFrame([("t", x) for x in kept], "query_id string, seq_id string"))
    rows = pruned.collect()
    assert sorted(r["label"] for r in rows if r["is_leaf"]) == kept and len([r for r in rows if r["parent"] is None]) == 1
    start = int(kept[0][1:])
    own = {r["node"]: r for r in rows}
    first = next(r["node"] for r in rows if r["label"] == kept[0])
    between = all_pairs_from(first, {k: v["parent"] for k, v in own.items()}, {k: v["branch_length"] or 0.0 for k, v in own.items()})
    whole = all_pairs_from(start, parent, length)
    for r in rows:
        if r["is_leaf"]:
            assert between[r["node"]][0] == pytest.approx(whole[int(r["label"][1:])][0])


def test_query_leaves_are_named_exactly(spark, tmp_path):
    (tmp_path / "a.nwk").write_text("((Hsa:1,Hsa-2:2):1,Mmu:3);")
    (tmp_path / "b.nwk").write_text("((Hsa:1,Hsa:2):1,Mmu:3);")
    trees = readers.read_newick(spark, str(tmp_path / "a.nwk"))
    got = {r["distance"] for r in tolerance.tree_distances(trees, spark.createDataFrame([("a", "Hsa")], "query_id string, seq_id string")).where("is_leaf = 1").collect()}
    assert got == {0.0, 3.0, 5.0}
    for file, name in (("a", "Rno"), ("b", "Hsa")):
        with pytest.raises(ValueError, match=f"{file}"):
            tolerance.tree_distances(readers.read_newick(spark, str(tmp_path / f"{file}.nwk")), spark.createDataFrame([(file, name)], "query_id string, seq_id string"))


def test_writers_of_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 0)], "id string, probability double, label int")
    writers.write_predictions(df, str(tmp_path / "p"))
    got = {r["id"]: (r["prediction"], r["probability_0"], r["label"]) for r in spark.read.csv(str(tmp_path / "p"), header=True).collect()}
    assert got == {"a": ("1", "0.5", "1"), "b": ("0", "0.75", "0")}
    writers.write_annotated(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True, sep="\t").count() == 2
    writers.write_species_table(spark.createDataFrame([("mmu", "mouse", None)], "code string, common_name string, taxid int"), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first()["3_letter_code"] == "mmu"
