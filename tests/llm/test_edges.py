"""Null, empty, long, repeated and clashing rows through every operator."""

import pytest
from pyspark.sql import functions as F

from seedloom.llm import html_text, jaccard, language, line_dedup, media, mixing, packing, pii, quality, secret_scan, toxicity

LINE = "This line of more than forty characters repeats in documents"
LONG = " ".join(f"word{i % 5000} und{i}" for i in range(15000))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "one two", None, "a"), (4, f"{LINE}\nshort", "en", "b"), (5, f" {LINE.upper()} ", "de", "b"), (6, LINE, "de", "b"), (7, LINE, "fr", "b"), (8, LINE, "fr", "b"),
    (9, LONG, "en", "a"), (10, LONG, "en", "a"), (None, "kein Schlüssel steht hier, a@b.co", "de", None), (3, "one two", None, "a"), (12, "   \n\t ", "es", "c"), (13, "mail x@y.org or 10.0.0.1", "es", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    for name in ("digest", "digests", "class", "rank", "bin", "salt", "node", "size", "target", "lost_id", "copies", "words", "part", "base", "spans", "batch", "row_key", "text_key", "keeper", "hub", "label", "fold", "lang_pred", "held_out", "credentials", "kind", "u", "v", "m"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 0, 0), (None, 1, 1), (9, 1, 0), (6, 1, None)], "doc_id bigint, quality int, toxic int")


def field(documents):
    return language.train(documents)


RUNS = {
    "html": lambda d, n: html_text.extract_main_text(d, "doc_id", "source", "text"),
    "media": lambda d, n: media.media_digest(media.text_to_media(d)),
    "probe": lambda d, n: media.probe_media(media.text_to_media(d)),
    "language": lambda d, n: language.identify(d, language.train(d)),
    "toxicity": toxicity.classify_toxicity,
    "quality": lambda d, n: quality.quality_rules(d),
    "lines": lambda d, n: line_dedup.dedup_lines(d),
    "pii": lambda d, n: pii.digest(pii.find_personal_data(d)),
    "secrets": lambda d, n: secret_scan.digest(secret_scan.find_secrets(d)),
    "packing": lambda d, n: packing.pack_documents(d),
    "mixing": lambda d, n: mixing.mix_sources(d),
    "jaccard": lambda d, n: jaccard.similar_documents(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_a_result(name, docs, labels):
    found = RUNS[name](docs, labels).collect()
    ids = [r[0] for r in found]
    if name == "packing":
        assert set(ids) == {r[0] for r in ROWS}
    else:
        assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables_give_empty_results(name, docs, labels):
    assert RUNS[name](docs.where("1 = 0"), labels.where("1 = 0")).collect() == []


def test_null_and_empty_texts(docs, labels):
    by = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[2]["kept"]
    by = {r["doc_id"]: r for r in language.identify(docs, language.train(docs)).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[12]["lang_pred"] == "und" and by[1]["score"] == 0.0
    by = {r["doc_id"]: r for r in media.media_digest(media.text_to_media(docs)).collect()}
    assert by[1]["n_bytes"] == 0 and by[1]["payload_bytes"] == 192 and by[1]["payload_sha256"] == by[2]["payload_sha256"]
    by = {r["doc_id"]: r for r in jaccard.similar_documents(docs).collect()}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[2]["component_id"] == 2 and by[12]["component_id"] == 12
    assert by[10]["component_id"] == 9 and by[3]["component_id"] == 3 and by[7]["component_id"] == 4
    by = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert by[1]["n_lines"] == 1 and by[4]["kept_text"] == "short" and by[5]["kept_text"] == "" and by[8]["kept_text"] == LINE
    pieces = packing.pack_documents(docs).where("doc_id in (1, 2)").collect()
    assert {(r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in pieces} == {(1, 0, 1, 1), (2, 0, 1, 1)}


def test_stages_keep_columns_and_clean_rows(docs, labels):
    assert toxicity.drop_toxic(docs, toxicity.train(docs, labels)).columns == docs.columns
    lines = line_dedup.dedup_documents(docs)
    assert lines.columns == docs.columns and lines.count() == len(ROWS) and lines.where("digest = 'clash'").count() == len(ROWS)
    joined = line_dedup.dedup_documents(docs, broadcast_keys=0)
    assert joined.columns == docs.columns and sorted(map(str, joined.collect())) == sorted(map(str, lines.collect()))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 3, 9, 12, 13, None} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (5, 6, 7, 8, 10)").count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("doc_id = 1").count() <= 2


def test_mixing_takes_each_row_by_its_own_copies(spark):
    ids = [None] * 30 + [7] * 10 + list(range(100, 110)) + [7, None]
    rows = [(d, " ".join(f"w{i}x{j}" for j in range(3 + i % 5)), "ab"[i % 2], 1) for i, d in enumerate(ids)]
    rows[-2:] = [rows[30], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars int").repartition(3)
    plan = mixing.mix_sources(docs).collect()
    mixed = [(r["doc_id"], r["text"], r["source"]) for r in mixing.mixed_documents(docs).collect()]
    for s in "ab":
        wanted = next(r["target"] for r in plan if r["source"] == s)
        assert abs(sum(len(t.split()) for _, t, o in mixed if o == s) - wanted) <= max(r["size"] for r in plan) / 2
    assert {x for x in mixed} <= {r[:3] for r in rows}
    whole = {r["source"]: int(r["target"] // r["source_size"]) for r in plan}
    for d, text, source, _ in rows:
        assert whole[source] <= mixed.count((d, text, source)) <= (whole[source] + 1) * [r[:3] for r in rows].count((d, text, source))
    assert sorted(map(str, mixed)) == sorted(str((r["doc_id"], r["text"], r["source"])) for r in mixing.mixed_documents(docs.repartition(5)).collect())


@pytest.mark.parametrize("keys", [0, 10**6])
def test_lines_of_rows_without_or_with_shared_ids(spark, keys):
    rows = [(None, LINE), (None, f"{LINE}\nmore"), (1, LINE), (1, f"own\n{LINE}"), (2, LINE), (3, LINE), (3, f"{LINE}\nlast")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted(((r["doc_id"], r["kept_text"]) for r in line_dedup.dedup_lines(docs, min_docs=4, broadcast_keys=keys).collect()), key=str)
    assert found == sorted([(None, ""), (None, "more"), (1, ""), (1, "own"), (2, ""), (3, LINE), (3, f"{LINE}\nlast")], key=str)
    assert all(r["n_dropped"] == 0 for r in line_dedup.dedup_lines(docs, min_docs=5, broadcast_keys=keys).collect())
