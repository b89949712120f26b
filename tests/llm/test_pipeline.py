"""The pipeline's stages against what they are made of and by hand."""

import collections
import re

import corpus_pipeline
from tests.llm.test_operators import components_by_hand


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\r\x0b\x0c"))


def test_stages_in_turn(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], small).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    start, clean, lines, single, mixed, packed = kept
    assert all(df.columns == columns for df in kept[:-1])
    labels = spark.read.parquet(f"{small}/labels.parquet")
    gone = {r["doc_id"] for r in start.join(clean, "doc_id", "left_anti").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert not [d for d in gone if truth.get(d) == 0] and len(gone) >= 0.6 * sum(truth.values())

    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    holders = collections.defaultdict(set)
    for d, t in before.items():
        for x in t.split("\n"):
            if len(key_of(x)) >= 40:
                holders[key_of(x)].add(d)
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()}
    for d, t in before.items():
        keep = "\n".join(x for x in t.split("\n") if not (len(h := holders.get(key_of(x), ())) >= 5 and max(h) != d))
        assert after[d] == (keep, len(keep))

    groups = components_by_hand({d: t for d, (t, _) in after.items()}, 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in groups.items() if c == d}
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in single.collect()}
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2
    first = collections.Counter(r["doc_id"] for r in packed.where("start = 0").collect())
    assert first == copies


def test_registered_as_a_query():
    assert corpus_pipeline.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "packing"]
