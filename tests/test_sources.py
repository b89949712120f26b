import pandas as pd
import pytest

from seedloom.sources import readers, writers
from seedloom.streaming import scoring


def test_tables(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿id\tgene\n1\tA,C\n")
    (tmp_path / "b.csv").write_text('id,gene\n1,"A,C"\n')
    for f in ("a.tsv", "b.csv"):
        assert [tuple(r) for r in readers.read_interactions(spark, str(tmp_path / f)).collect()] == [("1", "A,C")]
    (tmp_path / "c.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_interactions(spark, str(tmp_path / "c.csv"))


def test_split_tables(spark, tmp_path):
    for name, text in {
        "samples.tsv": "id\tgene\n1\tNA\n", "labels.csv": "id,label,numeric_label\n1,x,1\n", "sample_mirna_candidates.tsv": "id\tcandidate_index\thas_some_profile\n1\t0\t1\n",
        "some_mirna_positions.tsv": "mature_id\tpos\nM\t1\n", "some_target_positions.tsv": "id\tpos\n1\t2\n",
    }.items():
        (tmp_path / name).write_text(text)
    got = readers.read_split(spark, str(tmp_path))
    assert tuple(got["samples"].first()) == ("1", "NA") and tuple(got["labels"].first()) == ("1", "1")
    assert got["candidates"].columns[-1] == "has_profile" and got["target_positions"].first()["pos"] == "2" and got["mirna_positions"].first()["pos"] == "1"


def test_fasta_and_clustal(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACG\nU\n>b\n\n>c\nGG\n")
    assert sorted((r["header"], r["seq"]) for r in readers.read_fasta(spark, str(tmp_path / "x.fa")).collect()) == [("a one", "ACGU"), ("c", "GG")]
    (tmp_path / "q1.aln").write_text("CLUSTAL W\n\nHsa  UC-\nMmu  A--\n #A1 ...\n\nHsa  GG\nMmu  -u\n")
    got = readers.read_clustal(spark, str(tmp_path / "q1.aln")).collect()
    assert sorted((r["query_id"], r["seq_id"], r["aligned"]) for r in got) == [("q1", "Hsa", "TC-GG"), ("q1", "Mmu", "A---t")]


def test_newick(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("((a:1,b:2)x:0.5,(c:1,'d e':3):0.5);")
    trees = readers.read_newick(spark, str(tmp_path / "t.nwk"))
    got = {r["label"]: (r["branch_length"], r["is_leaf"]) for r in trees.collect() if r["label"]}
    assert got == {"a": (1.0, 1), "b": (2.0, 1), "x": (0.5, 0), "c": (1.0, 1), "d e": (3.0, 1)}
    taxa = spark.createDataFrame([("t", "a"), ("t", "c"), ("t", "d e")], "query_id string, seq_id string")
    pruned = {r["label"]: r["branch_length"] for r in readers.change_trees(trees, taxa).collect() if r["is_leaf"]}
    assert pruned == {"a": 1.5, "c": 1.0, "d e": 3.0}
    assert readers.change_trees(trees, unroot=True).where("parent is null").count() == 1
    assert readers.change_trees(trees, unroot=True).count() == 6


def test_states_stockholm_and_xml(spark, tmp_path):
    (tmp_path / "q.state").write_text("# note\nNode\tSite\tState\tp_A\tp_C\tp_G\tp_T\nN1\t1\tA\t0.5\t0.25\t0.25\t0\n")
    assert readers.read_states(spark, str(tmp_path / "q.state")).first().asDict() == {"query_id": "q", "node": "N1", "site": 1, "p_a": 0.5, "p_c": 0.25, "p_g": 0.25, "p_t": 0.0}
    (tmp_path / "q.sto").write_text("# STOCKHOLM\nx ACG\n#=GC cA1 .A\n#=GC SS_cons ((\n#=GC cA1 B.\n#=GC SS_cons ))\n//\n")
    assert tuple(readers.read_stockholm(spark, str(tmp_path / "q.sto")).first()) == ("q", ".AB.", "(())")
    (tmp_path / "t.xml").write_text("<S><Taxon><TaxId>1</TaxId><ScientificName>Homo sapiens</ScientificName><Rank>species</Rank><Lineage>a; b</Lineage><LineageEx><Taxon><ScientificName>Homo</ScientificName><Rank>genus</Rank></Taxon></LineageEx></Taxon></S>")
    assert readers.read_taxonomy_xml(spark, str(tmp_path / "t.xml")).first()["name"] == "Homo sapiens"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, i // 4) for i in range(10)], "row_id int, label int, shard int")
    manifest = writers.write_feature_shards(df, str(tmp_path / "shards"), 4)
    assert sorted(tuple(r) for r in manifest.collect()) == [(0, 4, 2), (1, 4, 2), (2, 2, 1)]
    scores = spark.createDataFrame([("q", "NN", "mean", "wl", 1, 0.1, 0.2, 0.3, 0.4)], "query_id string, norm string, param string, leaf_mode string, site int, A double, T double, G double, C double")
    writers.write_scores(scores, str(tmp_path / "scores"))
    assert spark.read.csv(str(tmp_path / "scores"), header=True).first()["Pos/NT"] == "1"
    species = spark.createDataFrame([("mmu", "mouse", None), ("hsa", "human", 9606)], "code string, common_name string, taxid int")
    assert [tuple(r) for r in writers.species_rows(species).collect()] == [("hsa", "human", "9606"), ("mmu", "mouse", "")]


def load():
    return lambda frame: pd.Series([0.75] * len(frame), index=frame.index)


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    df = spark.createDataFrame([(str(i), "ACGU" * 3, "acg", "M1") for i in range(5)], "id string, gene string, mirna string, mature_id string")
    df.write.parquet(str(tmp_path / "in"))
    profiles = spark.createDataFrame([("M1", 0.5)], "mature_id string, score double")
    query = scoring.stream_encode_and_score(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), "id string, gene string, mirna string, mature_id string", load, profiles)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = scoring.score_rows(scoring.encode_rows(df.join(profiles, "mature_id", "left")), load).drop("grid")
    assert sorted(map(tuple, got.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    with pytest.raises(ValueError):
        scoring.score_rows(got, load)
