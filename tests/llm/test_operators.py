"""Operators against brute force, SQL, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from seedloom.llm import html_text, jaccard, language, line_dedup, media, mixing, packing, pii, quality, queries
from tests.oracle import connect, same

MIDDLE = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, spark, small):
    same(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name])


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=1>Menu one</a></li><li><a href=2>Menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and more cookies, for all of you.</div>
<div id=page><article><h1>A &amp; B</h1><p>First  paragraph, with <b>bold</b> and a <a href=x>link</a>,
more than enough words to count.<p>Second &#233;t&eacute; paragraph<br>on two lines, unclosed<form><button>Send</button></form>
<div class="ad">Buy now, it is cheap, really cheap.</div><p>Third.</p></article>
<aside>Related, related, related, and more related stories.</aside>
<div id="comments"><p>Reader comment, long enough to be scored, with commas, and commas.</p></div></div>
<footer>Contact</footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(PAGE).split("\n\n") == ["A & B", "First paragraph, with bold and a link, more than enough words to count.", "Second été paragraph on two lines, unclosed", "Third."]


def test_container_without_article_tag():
    page = "<body><div class=top><a href=1>a</a> <a href=2>b</a></div><div><div>" + "".join(f"<p>Paragraph {i}, of some length, that holds a few commas, and words.</p>" for i in range(4)) + "</div></div></body>"
    assert len(html_text.main_text(page).split("\n\n")) == 4


PARAGRAPH = "<p>" + ("word, " * 5 + "word " * 80)[:400] + "</p>"


@pytest.mark.parametrize("n", [1, 3, 12, 60])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_article_is_whole_at_any_length(n, tag):
    page = f"<body><nav><a href=1>Menu</a></nav><div><{tag}><h1>Title</h1><div>{PARAGRAPH * n}</div><section>{PARAGRAPH}<ul><li>Point</li></ul></section><blockquote>Quote</blockquote><table><tr><td>Cell</td></tr></table></{tag}></div><footer>End</footer></body>"
    found = html_text.main_text(page).split("\n\n")
    assert found[0] == "Title" and found[-3:] == ["Point", "Quote", "Cell"] and len(found) == n + 5


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>"])
def test_sections_of_a_whole_page_without_article_tag(wrap):
    sections = "".join(f"<section><h2>Part {i}</h2>{PARAGRAPH * n}</section>" for i, n in enumerate((8, 1, 1, 1)))
    page = "<body><div class=top><a href=1>a</a> <a href=2>b</a></div>" + wrap.format(f"<h1>Title</h1>{sections}") + "<div><p><a href=3>Home</a> <a href=4>About</a></p></div><footer>End</footer></body>"
    found = html_text.main_text(page).split("\n\n")
    assert found[0] == "Title" and [x for x in found if x.startswith("Part")] == ["Part 0", "Part 1", "Part 2", "Part 3"] and len(found) == 16


def test_scoring_decides_on_doubtful_names():
    page = f"""<body><nav><a href=1>Menu</a></nav><article><h1>Work</h1>{PARAGRAPH}<div class="social-history"><p>The union grew, slowly, over many years of quiet work.</p></div>
    <section id="notice-period"><p>The term is four weeks, or eight after two years of work.</p></section><div class="related-stories-rail"><a href=1>One, two, three</a> <a href=2>Four, five, six</a></div>
    <div class="share-buttons">Tell your friends, all of them, about this page now.</div><div class="site-notice">We have a new policy, and a new look, since last week.</div></article>
    <div class="reader-comments"><p>Nice, very nice, and long enough to be scored, I think.</p></div></body>"""
    assert [x[:9] for x in html_text.main_text(page).split("\n\n")] == ["Work", "word, wor", "The union", "The term "]


BESIDE = (
    "reader-comments user-comments blog-comments author-comments comment-thread disqus_thread ad-slot-mpu advert-leaderboard google-ads privacy-notice legal-notice gdpr-dialog newsletter-callout "
    "related-posts related-articles promo-card share-tools subscribe-cta breaking-alert"
).split()


@pytest.mark.parametrize("tag", ["main", "article", "div"])
def test_the_head_of_a_name_decides(tag):
    text = "<p>The river runs from the hills, past the old mill, and down to the sea.</p>"
    more = "<p>Great read, thanks for this one. I liked it, really, and so did my friends.</p>"
    page = lambda name, inner=more: html_text.main_text(f'<html><body><{tag}>{text * 4}<div class="{name}">{inner}</div></{tag}></body></html>')
    assert [n for n in BESIDE if "Great read" in page(n)] == []
    for name in ("social-history", "notice-period", "comment-culture", "banner-year"):
        assert "Great read" in page(name) and "Short one." in page(name, "<p>Short one.</p>")


def test_reference_lists_stay_and_menus_go():
    text = "<p>The river runs from the hills, past the old mill, and down to the sea.</p>" * 3
    links = "<ul><li><a href=x>Smith 2001, A book of rivers</a></li><li><a href=y>Jones 2003</a></li></ul>"
    assert html_text.main_text(f"<body><article>{text}<h2>References</h2>{links}</article></body>").endswith("References\n\nSmith 2001, A book of rivers\n\nJones 2003")
    for page in (f"<body><main>{links}<article>{text}</article></main></body>", f"<body><article>{text}<h3>Related articles</h3>{links}</article></body>", f'<body><article>{text}<p>See also.</p><div class="related-links">{links}</div></article></body>'):
        assert "Smith" not in html_text.main_text(page)


@pytest.mark.parametrize("page", ["", "<", "<p", "plain text only", "<a '", "</p></div>", "<p>a<!-- b", "<script>x", "<div>" * 3000 + "deep"])
def test_broken_pages(page):
    html_text.main_text(page)


def test_every_page_gives_its_article(spark, small):
    for r in queries.op1_html_extraction(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=500))
def test_media_round_trip(text):
    size, payload = media.padded(text)
    stored = media.write_container(payload)
    found = media.probe(stored)
    assert media.read_payload(stored, found["samples"]) == payload and payload[:size] == text.encode() and len(payload) % 192 == 0
    assert found["duration"] == len(payload) and found["codec"] == "raw " and len(found["samples"]) == len(payload) // 192
    for at, n in found["keyframes"].tolist():
        start = at - found["samples"][0, 0]
        assert stored[at : at + n] == payload[start : start + n]


def test_media_tables_of_other_writers():
    stbl = media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78))), media.full(b"stts", struct.pack(">III", 1, 3, 10)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)),
        media.full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 6, 7)), media.full(b"stco", struct.pack(">III", 2, 1000, 2000)), media.full(b"stss", struct.pack(">III", 2, 1, 3)),
    )
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 90, 30)), media.box(b"minf", stbl))
    found = media.probe(media.box(b"moov", media.box(b"trak", mdia)))
    assert found["codec"] == "avc1" and found["samples"].tolist() == [[1000, 5], [1005, 6], [2000, 7]] and found["keyframes"].tolist() == [[1000, 5], [2000, 7]]
    assert found["keyframe_times"].tolist() == [0, 20] and found["duration"] == 30
    sound = media.write_container(bytes(192))[len(media.box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")) :]
    trak = next(bytes(sound[a - 8 : b]) for path, a, b in media.walk(memoryview(sound)) if path == "/moov/trak")
    both = media.tracks(media.box(b"moov", media.box(b"trak", mdia), trak))
    assert [t["codec"] for t in both] == ["avc1", "raw "] and [len(t["samples"]) for t in both] == [3, 1]
    for broken in (struct.pack(">I4s", 999, b"moov"), media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd"), media.box(b"minf", stbl))))):
        with pytest.raises(ValueError):
            media.probe(broken)


def test_media_without_bytes(spark):
    table = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"")), (3, 5, bytearray(struct.pack(">I4s", 999, b"moov")))], "doc_id bigint, n_bytes bigint, media binary")
    assert [(r["n_tracks"], r["codec"], r["keyframes"], r["payload"]) for r in media.probe_media(table).collect()] == [(0, None, [], b"")] * 3
    digest = media.media_digest(table.where("doc_id < 3")).collect()
    assert [(r["media_bytes"], r["payload_bytes"], r["media_sha256"] is None) for r in digest] == [(0, 0, True), (0, 0, False)]


def test_media_digests(spark, small, texts):
    for r in queries.op2_media_columns(spark, small).collect():
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 4, 0, 3])
    emit, step = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, at = language.marginals(emit, lengths, step), 0
    for n in lengths.tolist():
        paths = np.array(np.meshgrid(*[[0, 1]] * n)).reshape(n, -1).T if n else np.zeros((0, 0), int)
        weights = [np.exp(sum(emit[at + i, p[i]] for i in range(n)) + sum(step[p[i - 1], p[i]] for i in range(1, n))) for p in paths]
        for i in range(n):
            want = sum(w for w, p in zip(weights, paths) if p[i] == 1) / sum(weights)
            assert got[at + i, 1] == pytest.approx(want)
        at += n
    for n in (31, 32, 33, 100):
        emit = rng.normal(size=(n, 3))
        step = rng.normal(size=(3, 3))
        dense, _ = language.padded_marginals(emit[None], np.ones((1, n), bool), step)
        assert np.allclose(dense[0], language.marginals(emit, np.array([n]), step))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    found = queries.op3_language_id(spark, MIDDLE).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97
    field = language.train(docs)
    words, marginal, _ = language.label_texts(["the and of this with that is in for " * 3 + "und der die nicht auf mit sich das " * 3], field)
    labels = [field.labels[i] for i in marginal.argmax(1)]
    assert collections.Counter(labels[:20]).most_common(1)[0][0] == "en" and collections.Counter(labels[-20:]).most_common(1)[0][0] == "de"


def test_every_letter_and_only_letters_count():
    assert language.words_of("½ ² ③ Ⅷ 12 _ 7b") == ["b"] and language.words_of("Don’t x") == ["don’t", "x"]
    run = "".join(chr(0x4E00 + i) for i in range(100))
    assert "".join(language.words_of(run)) == run and max(map(len, language.words_of(run))) == language.WIDTH
    owner, _ = language.features(language.words_of(run), {})
    assert set(owner.tolist()) == set(range(5))


def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    from seedloom.llm import toxicity

    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    held = "doc_id % 4 = 1"
    chain = toxicity.train(docs, labels.where(f"not ({held})"))
    found = toxicity.score(docs, chain).join(labels.where(held).withColumnRenamed("toxic", "truth"), "doc_id").collect()
    clean = [r for r in found if not r["truth"]]
    bad = [r for r in found if r["truth"]]
    assert sum(r["toxic"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["toxic"] for r in bad) >= 0.6 * len(bad)


def test_chain_uses_out_of_fold_probabilities():
    from seedloom.llm import toxicity

    rng = np.random.default_rng(1)
    x = (rng.random((400, 6)) < 0.3).astype(np.float32)
    first = x[:, 0] > 0
    chain = toxicity.fit_chain(toxicity.Sparse.of(x), np.stack([first, first], 1).astype(float), list("abcdef"), ("one", "two"), np.arange(400) % 5)
    p = chain.probabilities(x)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][6] > 0
    assert ((p[:, 1] > 0.5) == first).mean() > 0.99


def test_chain_by_hand():
    """The chain against dense logistic regressions, fold by fold, with features of their own."""
    from seedloom.llm import toxicity

    rng = np.random.default_rng(4)
    x = rng.random((60, 5)) * (rng.random((60, 5)) < 0.6)
    labels = np.stack([x[:, 0] + rng.normal(0, 0.2, 60) > 0.4, x[:, 1] > 0.5], 1).astype(float)
    fold = rng.integers(0, 3, 60)
    chosen = {(c, f): rng.random(5) < 0.7 for c in (0, 1) for f in (-1, 0, 1, 2)}

    def fit(x, y):
        rate, w = 4.0 / (2 * (1 + (x**2).sum() / len(x)) + 1e-3), np.zeros(x.shape[1] + 1)
        v = w.copy()
        for step in range(300):
            e = (1 / (1 + np.exp(-(x @ v[:-1] + v[-1]))) - y) / len(x)
            after = v - rate * np.append(x.T @ e + 1e-3 * v[:-1], e.sum())
            v, w = after + step / (step + 3) * (after - w), after
        return w

    want, wide = [], x
    for c in (0, 1):
        outside = np.zeros(60)
        for f in (0, 1, 2, -1):
            seen = wide * np.append(chosen[c, f], np.ones(c))
            w = fit(seen[fold != f], labels[fold != f, c])
            if f >= 0:
                outside[fold == f] = 1 / (1 + np.exp(-(seen[fold == f] @ w[:-1] + w[-1])))
        want.append(w)
        wide = np.hstack([wide, outside[:, None]])
    chain = toxicity.fit_chain(toxicity.Sparse.of(x), labels, list("abcde"), ("one", "two"), fold, chosen)
    used = chosen[0, -1] | chosen[1, -1]
    assert chain.features == [f for f, u in zip("abcde", used) if u]
    for w, own in zip(want, chain.weights):
        assert np.allclose(np.concatenate((w[:5][used], w[5:])), own)


def test_copies_are_in_one_fold_and_folds_choose_their_features(spark):
    from seedloom.llm import toxicity

    rows = [(i, f"word{i % 40} zebra" if i % 2 else f"Word{i % 40},  quiet") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels).collect()
    assert len(sample) == 40 and len({r["fold"] for r in sample}) > 1 and all(r["is_toxic"] == ("zebra" in r["text"]) for r in sample)
    chosen = toxicity.select_features(spark.createDataFrame(sample), ["low_quality", "toxic"])
    assert all(c == 1 for c, _ in chosen) and " zebra " in chosen[1, -1]
    for fold in range(toxicity.FOLDS):
        outside = [r["text"].lower() for r in sample if r["fold"] != fold and r["is_toxic"]]
        assert all(sum(f" {t} ".count(x) > 0 for t in outside) >= toxicity.LEAST_DOCS for x in chosen.get((1, fold), []))


def test_quality_counts(spark, small, texts):
    for r in queries.op5_quality_rules(spark, small).collect():
        text = texts[r["doc_id"]] or ""
        words = WORD.findall(text)
        triples = collections.Counter(zip(words, words[1:], words[2:]))
        inside = {j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = text.split("\n")
        again = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_compression_bands_reject_noise_and_repeats(spark):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(200))
    loop = " ".join(f"item {i % 7} of the same list with value {i % 5}" for i in range(2000))
    found = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame([(1, noise), (2, loop)], "doc_id bigint, text string")).collect()}
    assert found[1]["band_failed"] and found[2]["band_failed"] and found[1]["ratio"] < 1.5 and found[2]["ratio"] > 4


def test_fitted_bands_on_held_out_documents(spark):
    """Recall of documents labelled as bad, and good ones kept, on the labels that didn't fit the bands; and noise of other kinds."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality.train(docs, labels.where("doc_id % 2 = 0"))
    found = quality.quality_rules(docs, fitted=fitted).where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n[0, False] >= 0.55 * (n[0, False] + n[0, True]), n
    rng = random.Random(5)
    prose = max((r["text"] for r in docs.join(labels.where("quality = 1 and toxic = 0"), "doc_id").select("text").collect()), key=len)
    for size in (2000, 5000, 12000):
        hexes = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(3, 10))) for _ in range(size))[:size]
        digits = " ".join(str(rng.randrange(10 ** rng.randint(2, 7))) for _ in range(size))[:size]
        noisy = prose[: size * 6 // 10] + base64.b64encode(rng.randbytes(size)).decode()[: size * 4 // 10]
        verdicts = [quality.band_verdict(x.encode(), zstandard.ZstdCompressor(level=3), fitted=fitted)[3] for x in (prose[:size], hexes, digits, noisy)]
        assert verdicts == [True, size < 3000 and verdicts[1], False, False], (size, verdicts)


def test_bands_without_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int")) == quality.Bands() == quality.train(docs.where("1 = 0"), spark.read.parquet(f"{small}/labels.parquet"))


def test_op5_keeps_what_its_bands_and_base_rules_keep(spark, small, texts):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality.train(docs, labels)
    for r in queries.op5_quality_rules(spark, small).collect():
        data = (texts[r["doc_id"]] or "").encode()
        verdict = quality.band_verdict(data, zstandard.ZstdCompressor(level=3), fitted=fitted)
        assert (r["ratio"], r["n_chunks"], r["n_bad_chunks"], not r["band_failed"]) == verdict and r["kept"] == (verdict[3] and not r["base_failed"])


def test_chunks_cover_every_byte():
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    prose = " ".join(rng.choice(words) for _ in range(4000)).encode()
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(4000)).encode()
    verdict = lambda data: quality.band_verdict(data, zstandard.ZstdCompressor(level=3))
    for good, bad in ((4096, 4000), (6000, 3500), (2048, 1000), (1024, 500), (512, 256)):
        assert verdict(prose[: good + bad])[2:] == (0, True)
        for data in (prose[:good] + noise[:bad], noise[:bad] + prose[:good]):
            assert verdict(data)[2] > 0 and not verdict(data)[3]
    assert verdict(prose[:8192] + noise[:256])[1:] == (3, 1, True)
    for n in (130, 170, 210, 250):
        assert verdict(prose[:n])[3] and not verdict(bytes(rng.randrange(33, 127) for _ in range(n)))[3]
    assert [verdict(prose[:n])[1] for n in (8192, 4095, 4097, 200)] == [2, 7, 2, 1]


@pytest.mark.parametrize(("bits", "keys"), [(1 << 18, 0), (None, 10**6)])
def test_lines_with_a_full_or_an_ample_filter(spark, bits, keys):
    rng = random.Random(5)
    pool = [f"line {i} that is certainly longer than forty characters, all in all" for i in range(60)]
    rows = [(d, "\n".join(rng.choice((str.upper, str, lambda s: f"\t{s} "))(rng.choice(pool)) for _ in range(4)) + "\nshort") for d in range(80)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), filter_bits=bits, broadcast_keys=keys).collect()}
    holders = collections.defaultdict(set)
    for d, text in rows:
        for line in text.split("\n"):
            if len(key := line.strip(" \t").lower()) >= 40:
                holders[key].add(d)
    for d, text in rows:
        keep = [x for x in text.split("\n") if not (len(h := holders.get(x.strip(" \t").lower(), ())) >= 5 and max(h) != d)]
        assert got[d]["kept_text"] == "\n".join(keep) and got[d]["n_dropped"] == 5 - len(keep)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    def luhn(d):
        points = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in points) % 10 == 0

    found = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_personal_data_base_spans(spark, small, texts):
    rng = random.Random(9)
    made = {10**6 + i: "".join(rng.choice(("a@b.c", "1.2.3.4", "+", "4111 1111 1111 1111", "-", " ", "é", "(030) ", "12", "x", "_", ".", "@")) for _ in range(30)) for i in range(300)}
    made[10**7] = "x" * 20000 + "@y.zz" + "1 " * 9000 + "+1" + " " * 3000 + "2"
    frame = spark.createDataFrame(list((texts | made).items()), "doc_id bigint, text string")
    for r in pii.find_personal_data(frame).collect():
        want = base_spans((texts | made)[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == want
        assert set(want) <= {tuple(s) for s in r["spans"]}
        added = {tuple(s) for s in r["spans"]} - set(want)
        assert not [a for a in added for b in want if a[0] < b[2] and b[0] < a[2]]
    digest = pii.digest(pii.find_personal_data(frame)).where("doc_id = 1000000").first()
    names = "email ip card phone".split()
    assert digest["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base_spans(made[10**6])).encode()).hexdigest()


def test_reliabilities_of_labelers():
    rows = [(0, (1, 1, 0, 0, 0), 90.0), (0, (1, 1, 1, 0, 0), 60.0), (0, (0, -1, -1, 0, -1), 80.0), (0, (0, -1, 0, 0, 0), 50.0), (3, (1, -1, 0, 0, 0), 40.0), (3, (-1, 1, -1, 0, -1), 40.0)]
    posterior, tables = pii.expectation_maximisation(rows)
    assert posterior[0] > 0.9 and posterior[1] > 0.9 and posterior[2] < 0.1 and posterior[3] < 0.1
    assert tables["email"]["valid"][1][1] > 0.9 and tables["email"]["valid"][0][-1] > 0.9
    assert posterior[4] > 0.9 > 0.1 > posterior[5] and tables["phone"]["valid"][1][-1] > 0.8


def test_added_spans(spark):
    """Precision and recall of the spans that the method adds, on planted ones among look-alikes."""
    rng = random.Random(6)
    n = lambda a, b: rng.randint(a, b)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(n(2, 8)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    true = (
        lambda: ("phone", f"({n(200, 999)}) {n(200, 999)}-{n(1000, 9999)}"), lambda: ("phone", f"{n(200, 999)}-{n(200, 999)}-{n(1000, 9999)}"),
        lambda: ("email", f"{word()}{n(1, 99)} (at) {word()} (dot) com"), lambda: ("secret", hexes(40)), lambda: ("ip", f"{n(1, 223)}[.]{n(0, 255)}[.]{n(0, 255)}[.]{n(1, 254)}"),
    )
    false = (lambda: f"{n(100, 999)}.{n(100, 999)}.{n(100, 999)}", lambda: f"v{n(100, 999)}.{n(100, 999)}.{n(1000, 9999)}.{n(1, 9)}", lambda: "/".join(word() + str(n(1, 9)) for _ in range(6)), lambda: f"{hexes(32)}{word()}/{word()}")
    base = (lambda: f"+1 ({n(100, 999)}) 555-{n(1000, 9999)}", lambda: f"{word()}.{n(1, 99)}@mail{n(1, 9)}.example.com", lambda: f"{n(1, 223)}.{n(0, 255)}.{n(0, 255)}.{n(1, 254)}")
    rows, wanted = [], {}
    for d in range(900):
        text, spans = " ".join(word() for _ in range(n(3, 30))), []
        for _ in range(n(0, 2)):
            which = n(0, 9)
            if which < 4:
                kind, found = rng.choice(true)()
                lead = {"secret": 'token = "', "phone": rng.choice(("", "call "))}.get(kind, "")
                start = len(text) + 1 + len(lead)
                spans.append((kind, start, start + len(found)))
                text += f" {lead}{found}" + ('"' if kind == "secret" else "")
            else:
                text += " " + rng.choice(false if which < 7 else base)()
            text += " " + word()
        rows.append((d, text))
        wanted[d] = set(spans)
    hit = extra = total = 0
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect():
        assert all(s["kind"] < 4 for s in r["spans"]) and all(s["kind"] == 4 for s in r["credentials"])
        whole = sorted((s["start"], s["stop"]) for s in set(r["spans"] + r["credentials"]) - set(r["base"]))
        assert all(a[1] <= b[0] for a, b in zip(whole, whole[1:]))
        added = {(pii.KINDS[s["kind"]], s["start"], s["stop"]) for s in r["spans"] + r["credentials"]} - {(pii.KINDS[s["kind"]], s["start"], s["stop"]) for s in r["base"]}
        hit += len(added & wanted[r["doc_id"]])
        extra += len(added - wanted[r["doc_id"]])
        total += len(wanted[r["doc_id"]])
    assert total > 200 and hit >= 0.95 * total and extra <= 0.05 * hit, (hit, extra, total)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\ta.bé'1%ß漢 <|endoftext|>"), max_size=40), max_size=6))
def test_token_ids(texts):
    whole = packing.whole_tokenizer(None)
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)] if texts else []
    assert [x.tolist() for x in packing.encode_texts(texts)] == want


def test_added_tokens_in_texts_are_single_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b\nc", "two  spaces <|endoftext|>", "<|endoftext| >", "plain words\nonly"]
    assert [x.tolist() for x in packing.encode_texts(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.encode_texts(texts)[0].tolist() == [3826, 220, 50256, 994]


def test_packing(spark, small, texts):
    whole = packing.whole_tokenizer(None)
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    found = queries.op8_packing(spark, small).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in pieces.items():
        assert [s for s, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) == len(ids[d])
    assert len(pieces) == len(ids)
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    total = sum(map(len, ids.values()))
    assert total / (2048 * len(sequences)) > 0.96


def test_patterns_cover_the_demand():
    rng = random.Random(4)
    for sizes in ({1: 5}, {128: 7, 3: 2}, dict(collections.Counter(rng.randint(1, 128) for _ in range(3000)))):
        runs = packing.plan_runs(sizes, 128)
        for s, n in sizes.items():
            own = sorted((a, b) for c, a, b, _, _ in runs if c == s)
            assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))
        load = collections.Counter()
        for s, a, b, each, first in runs:
            for i in range(b - a):
                load[first + i // each] += s
        assert max(load.values()) <= 128
        assert len(load) <= 1.02 * sum(s * n for s, n in sizes.items()) / 128 + 3


def test_mixture_is_near_its_targets(spark, small):
    found = mixing.mix_sources(spark.read.parquet(f"{small}/documents.parquet")).collect()
    by = collections.defaultdict(list)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(1, 0.006 * own[0]["target"])
    assert sum(r["target"] for own in by.values() for r in own[:1]) == pytest.approx(1.5 * sum(r["size"] for r in found))


def test_mixing_many_sources_by_shuffle(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix_sources(docs, broadcast_sources=0, bins=8).collect()))


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def components_by_hand(texts, n, percent):
    sets = {d: shingles(t, n) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(size)] for size in (3, 8, 12, 20, 45, 90, 200, 400)]
    made = {}
    for d in range(400):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 9))):
            at = rng.randrange(len(words) or 1)
            words[at : at + 1] = rng.choice(([], [f"n{rng.randint(0, 9)}"], [*words[at : at + 1], "x"]))
        made[d * 3 + 1] = " ".join(words).upper() if d % 5 == 0 else " ".join(words)
    frame = spark.createDataFrame(list(made.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(frame, n=n, percent=percent).collect()}
    assert got == components_by_hand(made, n, percent)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.sampled_from((80, 85)), st.integers(0, 10**6))
def test_similar_sets_share_a_signature(size, changes, percent, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    drop = int(rng.integers(0, min(changes, size) + 1))
    b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, changes - min(drop, changes), dtype=np.uint64))))
    shared = len(np.intersect1d(a, b))
    if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
        table = jaccard.bands(max(len(a), len(b)))
        assert len(np.intersect1d(jaccard.signatures(a, percent, table), jaccard.signatures(b, percent, table)))


def test_common_signatures_and_shuffled_texts(spark, small, texts, monkeypatch):
    for name, value in (("COMMON", 1), ("HELD", 5000), ("BLOCK_DOCS", 3), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs, n=4, percent=85).collect()}
    assert got == components_by_hand(texts, 4, 85)


@pytest.mark.parametrize("block", [4, 1000])
def test_members_of_one_group_that_do_not_link_with_its_least(spark, monkeypatch, block):
    """Any grouping of candidates gives the components of all links inside the groups."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rng = np.random.default_rng(2)
    sets, members = {}, []
    for g in range(6):
        cores = rng.integers(0, 2**63, (3, 200), dtype=np.uint64)
        for i in range(25):
            own = np.unique(np.concatenate((cores[i % 3][: int(rng.integers(180, 201))], rng.integers(0, 2**63, int(rng.integers(0, 12)), dtype=np.uint64))))
            node = int(rng.integers(-(2**62), 2**62))
            sets[node] = own
            members.append((g, node))
    groups = spark.createDataFrame(members, "key bigint, node bigint")
    table = spark.createDataFrame([(k, len(v), bytearray(jaccard.sketch(v).tobytes())) for k, v in sets.items()], "node bigint, size int, sketch binary")
    packed = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "node bigint, shingles binary")
    got = {r["node"]: r["component"] for r in jaccard.linked_components(groups, table, lambda rows: packed.join(rows, "node", "left_semi"), 90).collect()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for g, a in members:
        for h, b in members:
            if g == h and a < b and jaccard.alike(sets[a], sets[b], 90):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {k: got.get(k, k) for k in sets} == {k: root(k) for k in sets}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 200), st.sampled_from((80, 85)), st.integers(0, 10**6))
def test_sketches_keep_every_link(size, changes, percent, seed):
    rng = np.random.default_rng(seed)
    scale = 2**63 if seed % 2 else 8 * size  # small numbers crowd into few bins
    sets = [np.unique(rng.integers(0, scale, size, dtype=np.uint64))]
    for _ in range(5):
        base = sets[int(rng.integers(len(sets)))]
        sets.append(np.unique(np.concatenate((base[int(rng.integers(0, changes + 1)) :], rng.integers(0, scale, int(rng.integers(0, changes + 1)), dtype=np.uint64)))))
    sets = [x for x in sets if len(x)]
    every = list(range(len(sets)))
    close = jaccard.near(np.array([len(x) for x in sets]), [jaccard.sketch(x) for x in sets], np.arange(len(sets)), every, every, percent)
    for i in every:
        for j in every[:i]:
            assert not jaccard.alike(sets[i], sets[j], percent) or close[i] and close[j]


def test_texts_that_share_an_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, one), (5, two), (7, f"{one} more"), (9, f"{two} more"), (None, f"{two} else"), (None, "alone"), (5, one)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()), key=str)
    assert found == [(5, 5)] * 3 + [(7, 5), (9, 5), (None, 5), (None, None)]
    assert sorted(map(str, (tuple(r) for r in jaccard.keep_one(docs).collect()))) == sorted(map(str, [(5, one), (5, two), (None, "alone")]))


def test_hubs_are_not_shuffled_to(spark, monkeypatch):
    from seedloom.llm import graph

    monkeypatch.setattr(graph, "HUB_EDGES", 3)
    rng = random.Random(8)
    edges = [(1, i) for i in range(2, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)] + [(59, 230)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in parent}
