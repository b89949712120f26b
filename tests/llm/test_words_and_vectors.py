"""Spelling variants, secrets and whitening against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seedloom.llm import secret_scan, spelling, whitening
from seedloom.llm.words import counted, letter_runs


def near(a, b):
    """Whether one inserted, deleted or replaced letter makes ``b`` out of ``a``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def variants(rows):
    """The result of ``spelling_variants`` by looking at all pairs."""
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if c >= 2 and len(w) >= 7}
    about = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in about.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    root = {}
    for w in n:
        last = w
        while form[last]:
            last = form[last]
        root[w] = last
    return sorted((w, form[w], root[w], n[w], len(about[w]), n.get(form[w])) for w in n)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = result(spelling.spelling_variants(docs))
    # All pairs of thousands of words take long in plain Python; words that share no half of seven letters' width can't be near.
    assert found == variants_by_deletions([tuple(r) for r in docs.select("doc_id", "text").collect()])


def variants_by_deletions(rows):
    counts = Counter()
    for d, text in rows:
        counts.update({w.decode("latin-1"): k for w, k in spelling.run_counts(d, text or "").items()})
    n = {w: c for w, c in counts.items() if c >= 2}
    by = {}
    for w in n:
        for i in range(len(w)):
            by.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    about = {}
    for w in n:
        keys = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}
        about[w] = {v for k in keys for v in by.get(k, set()) | ({k} & n.keys()) if near(w, v)}
    form = {w: min(vs, key=lambda v: (-n[v], v)) if vs else None for w, vs in about.items()}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(about[w]), n.get(form[w])) for w in n)


def made_texts(seed):
    rng = random.Random(seed)
    letters = "abé" if seed % 2 else "abcdefgh×ÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(60)]
    chain = ["ababababa"] * 3 + ["ababababb"] * 40 + ["abababbbb"] * 500
    rows = []
    for d in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        own += [w[:i] + rng.choice(letters) + w[i + 1 :] for w in own[:6] for i in (rng.randrange(len(w)),)]
        rows.append((d, " ".join(own).title() + "中" + "x1y"))
    rows += [(100, " ".join(chain)), (None, "Abcdefgh abcdefgh"), (100, " ".join(chain)), (101, None), (102, ""), (103, "ÉtÉllllll étéllllll " * 3)]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_spelling_equals_all_pairs(spark, seed):
    rows = made_texts(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(3)
    assert result(spelling.spelling_variants(docs)) == variants(rows)


@pytest.mark.parametrize("hot", [4, 10**6])
def test_hot_halves_are_split_without_doubles(spark, hot):
    rows = [("".join(p), 2 + i % 50) for i, p in enumerate(itertools.product("ab", repeat=7))] + [("".join(p) + "c", 7) for p in itertools.product("ab", repeat=6)] + [("ab" * 4, 9)]
    found = spelling.near_words(spark.createDataFrame(rows, "word string, n bigint"), index_size=500, hot=hot).collect()
    counts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        about = [v for v in counts if near(r["word"], v)]
        best = min(about, key=lambda v: (-counts[v], v))
        assert (r["n"], r["n_near"], -r["best"]["less"], r["best"]["word"]) == (counts[r["word"]], len(about), counts[best], best)


def test_long_words(spark):
    long = "xyz" * 700
    rows = [(1, f"{long} {long}"), (2, f"{long}q {long}q"), (3, f"{long[:1000]}{long[1001:]} " * 30)]
    found = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sorted(map(len, found)) == sorted(len(x[0]) for x in variants(rows))
    assert result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"))) == variants(rows)


def test_wide_intervals_and_roots(spark):
    words = sorted({"".join(p) + "tail" for p in itertools.product("abcdefghij", repeat=3)})
    index = spelling.RankIndex.of([w.encode() for w in words])
    owner, found = spelling.one_error(index, [w.encode()[::-1] for w in words], [4] * len(words))
    assert Counter(owner.tolist()) == {i: 27 for i in range(len(words))} and all(near(words[a], words[b]) for a, b in zip(owner, found))
    forms = [(f"w{i}", f"w{i + 1}") for i in range(9)]
    assert {r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {"w9"}


def test_empty_vocabulary(spark):
    empty = spark.createDataFrame([(1, "one two"), (None, None)], "doc_id bigint, text string")
    assert spelling.spelling_variants(empty).collect() == [] and spelling.spelling_variants(empty.where("1 = 0")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZÀÿ×Ā中ſK 1-\n"), max_size=30))
def test_runs_of_letters(text):
    want = [re.sub("[A-Z]", lambda m: m.group().lower(), r) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [r.decode("latin-1") for r in letter_runs(text)] == want


def test_counts_are_handed_on_when_many_are_held(spark):
    rows = [(i, " ".join(f"{'abcdefghij'[j % 10]}{'klmnop'[j % 6]}" for j in range(i, i + 50))) for i in range(200)]
    found = {r["word"]: r["n"] for r in counted(spark.createDataFrame(rows, "i bigint, t string"), lambda _, t: letter_runs(t), held=5).collect()}
    assert found == Counter(w for _, t in rows for w in t.split())


ASSIGN = re.compile("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secrets_base_spans(spark, small):
    rng = random.Random(4)
    parts = ("token", "PassWord", "api_key", "APIKEY", "secret", "paſswd", "toKen", "=", ":", " ", '"', "'", "abc123", "x.y-z/", "AKIA", "AKIA" + "Z9" * 9, "0a" * 12, "f" * 23, "é", "\n", "pwd", "=>", "://u:", "@")
    made = [(i, "".join(rng.choice(parts) for _ in range(24))) for i in range(600)] + [(9000, "a" * 50000 + " secret" + " " * 40000 + "= x"), (9001, None), (9002, "")]
    rows = made + [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id") + 10**5, "text").collect()]
    texts = dict(rows)
    found = secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    for r in found.collect():
        want = base_secrets(texts[r["doc_id"]] or "")
        assert [(s["start"], s["kind"], s["stop"]) for s in r["base"]] == want
        spans = [(s["start"], s["kind"], s["stop"]) for s in r["spans"]]
        assert spans == sorted(spans) and set(want) <= set(spans)
        added = sorted(set(spans) - set(want))
        assert all(a[2] <= b[0] for a, b in zip(added, added[1:])) and not [a for a in added for b in want if a[0] < b[2] and b[0] < a[2]]
    names = ("assign", "access", "hex")
    for r in secret_scan.digest(found).where("doc_id < 50").collect():
        want = base_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]


COSTS = {w: 1.0 + i for i, w in enumerate("password the and correct horse battery staple summer required monkey".split())}


def bits_by_all_segmentations(value, costs):
    """The least cost over all ways to cut ``value``, each piece priced by itself."""
    def piece(part, before_brute):
        kinds = [secret_scan.word_bits(part, costs) if len(part) >= 3 else None]
        spans = [secret_scan.guess_bits(part, costs)] if len(part) > 1 else []
        kinds += [bits - 1.0 for bits, cut in spans if len(cut) == 1 and cut[0][0] != "brute"]
        brute = sum(map(secret_scan.character_bits, part))
        best = min([k + 1.0 for k in kinds if k is not None], default=float("inf"))
        return (best, False), (brute + (0.0 if before_brute else 1.0), True)

    best = float("inf")
    for cuts in itertools.product((0, 1), repeat=len(value) - 1):
        parts, start = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(value[start:i])
                start = i
        options = [(0.0, False)]
        for p in parts:
            options = [(t + cost, brute) for t, was in options for cost, brute in piece(p, was)]
            options = [min((o for o in options if o[1] == b), default=(float("inf"), b)) for b in (False, True)]
        best = min(best, *(o[0] for o in options))
    return best


@pytest.mark.parametrize("value", ["password1", "P4ssword", "aaaaab", "abcabcabc", "qwerty12", "19870412x", "horse!ha", "x7Kq9!m", "zzz1999", "thethe1", "1", ""])
def test_guess_cost_is_least_over_all_segmentations(value):
    bits, spans = secret_scan.guess_bits(value, COSTS)
    assert "".join(value[a:b] for _, a, b in spans) == value
    if value:
        assert bits == pytest.approx(bits_by_all_segmentations(value, COSTS))


def test_easy_values_cost_less_than_hard_ones():
    bits = lambda v: secret_scan.guess_bits(v, COSTS)[0]
    for easy in ("password", "P4ssw0rd1", "qwertyuiop", "aaaaaaaaaa", "abcabcabc", "1987-04-12", "12345678", "correcthorsebatterystaple", "Summer2024!", "required", "monkeymonkey"):
        assert bits(easy) < secret_scan.LEAST_BITS, easy
    for hard in ("x7Kq9!mZ2pLw", "04dbebab91ab85687d33", "wJalrXUtnFEMI", "Tr0ub4dor&3zQ"):
        assert bits(hard) > secret_scan.LEAST_BITS, hard


def test_lexicon_ends_between_counts(spark):
    text = " ".join(w for w, n in (("often", 40), ("some", 20), ("same", 20), ("rare", 6), ("once", 1)) for _ in range(n))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    own = lambda k: {w for w in secret_scan.lexicon(docs, words=k) if w not in secret_scan.COMMON}
    assert [own(k) for k in (0, 1, 2, 3, 9)] == [set(), {"often"}, {"often"}, {"often", "some", "same"}, {"often", "some", "same", "rare"}]
    assert secret_scan.lexicon(docs, words=3)["often"] == 1.0


def test_added_secrets(spark):
    """Precision and recall of the values that the method adds, planted among look-alikes in credential contexts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 7)))
    vocabulary = [word() for _ in range(300)]
    symbols = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    strong = lambda: "".join(rng.choice(symbols) for _ in range(rng.randint(12, 30))) + rng.choice(("", "!x", "#7", "$Q"))
    weak = lambda: rng.choice((rng.choice(vocabulary) * 2, "password", "changeme", "qwerty123", "12345678", "19990101", "aaaaaaaa", rng.choice(vocabulary) + rng.choice(vocabulary)))
    lead = ("pwd: {}", 'passphrase = "{}"', "Authorization: Bearer {}", "client-secret => {}", "the passcode is {}", "access key: `{}`", "postgres://bob:{}@db.local/x", "credentials -> {}")
    rows, wanted = [], {}
    for d in range(800):
        text, spans = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))), set()
        for _ in range(rng.randint(0, 2)):
            template, good = rng.choice(lead), rng.random() < 0.5
            value = strong() if good else weak()
            at = len(text) + 1 + template.index("{}")
            if good:
                spans.add(at + len(value))
            text += f" {template.format(value)} " + " ".join(rng.choice(vocabulary) for _ in range(3))
        rows.append((d, text))
        wanted[d] = spans
    hit = extra = total = 0
    for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect():
        added = {s["stop"] for s in r["spans"]} - {s["stop"] for s in r["base"]}
        hit, extra, total = hit + len(added & wanted[r["doc_id"]]), extra + len(added - wanted[r["doc_id"]]), total + len(wanted[r["doc_id"]])
    assert total > 300 and hit >= 0.97 * total and extra <= 0.03 * hit, (hit, extra, total)


MATRICES = ("random", "identity", "one", "equal", "near", "blocks", "zero", "tiny")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 150])
@pytest.mark.parametrize("kind", MATRICES)
def test_leading_components(n, kind):
    rng = np.random.default_rng(n)
    square = rng.standard_normal((n, n))
    turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
    near_values = np.array([5.0, 5.0 - 1e-12, 5.0 - 1e-9, 5.0 - 1e-6] * 50)[:n]
    a = {
        "random": square @ square.T, "identity": 3 * np.eye(n), "one": np.outer(square[0], square[0]), "equal": turn @ np.diag(([5.0, 5.0, 5.0, 1.0] * 50)[:n]) @ turn.T,
        "near": turn @ np.diag(near_values) @ turn.T, "blocks": np.kron(np.eye(2), [[2.0, 1.0], [1.0, 2.0]]), "zero": np.diag([2.0, *[0.0] * (n - 1)]), "tiny": square @ square.T * 1e-200,
    }[kind]
    a = (a + a.T) / 2
    values, vectors = whitening.leading_components(a, 4)
    size, k = np.abs(a).max(), len(values)
    true = np.linalg.eigvalsh(a)[::-1][:4]
    assert k == (1 if kind in ("one", "zero") else min(4, len(a))) and np.allclose(values / size, true[:k] / size, rtol=1e-11, atol=0)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size * len(a) and np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-12


def brute_whitening(vectors):
    x = np.array([[int(np.floor(256 * np.float64(c))) for c in v] for v in vectors], object)
    fit = [list(r) for r in {tuple(r) for r in x.tolist()}]
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[float(v) - s / n for v, s in zip(r, sums)] for r in fit])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    own = np.array([[float(v) - s / n for v, s in zip(r, sums)] for r in x.tolist()])
    deviation = [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]
    return n, deviation, own @ directions / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def check(found, vectors, k=4):
    n, deviation, white, explained = brute_whitening([v for _, v in vectors])
    rows = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(vectors) * k
    for c in range(k):
        own = np.array([rows[i, c + 1]["whitened"] for i, _ in vectors])
        assert np.abs(own * np.sign(own @ white[:, c]) - white[:, c]).max() < 1e-6
        for (i, _), d in zip(vectors, deviation):
            r = rows[i, c + 1]
            assert r["n"] == n and r["deviation"] == d and r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-6


def test_whitening_of_the_small_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").repartition(5)
    check(whitening.whiten(table.withColumn("x", F.lit("clash")).withColumn("component", F.lit(0))).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_whitening_leaves_out_unusable_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.standard_normal(3) * (1, 5, 0.2) + 7]) for i in range(60)] + [(100, [-0.0, 0.0, -1e-9]), (101, [0.0, -0.0, -1e-9])]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 0.0, 0.0]), (204, [1e300, 0.0, 0.0]), (205, [1.0]), (206, [])]
    table = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").repartition(4)
    check(whitening.whiten(table).collect(), good, 3)
    twice = whitening.whiten(table.unionByName(table.limit(0)).unionByName(spark.createDataFrame(good[:7], table.schema))).collect()
    assert len(twice) == 3 * (len(good) + 7) and {r["n"] for r in twice} == {61}


def test_whitening_without_variance(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(table).collect() == [] and whitening.whiten(table.where("1 = 0")).collect() == [] and whitening.whiten(table.where("vec_id is null")).collect() == []
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [5.0, 2.0])], "vec_id bigint, embedding array<float>")
    found = whitening.whiten(flat).collect()
    assert len(found) == 3 and {r["component"] for r in found} == {1} and all(r["explained"] == pytest.approx(1.0) for r in found) and {r["vec_id"] for r in found} == {1, 2, None}


def test_large_entries_are_exact():
    rows = [(i, [float(3 * 10**14 + 10**9 * i), float(-i)]) for i in range(40)]
    centre = whitening.Centre(40, tuple(sum(int(256 * r[1][d]) for r in rows) for d in (0, 1)))
    x = np.array([[int(256 * v) for v in r[1]] for r in rows])
    want = [sum((40 * int(v) - s) ** 2 for v, s in zip(r, centre.sums)) for r in x.tolist()]
    assert centre.deviations(x) == [v if v < 1 << 63 else None for v in want]


def test_sums_of_many_tasks_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "GROUPS", 2)
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(70)]
    frame = spark.createDataFrame(rows, "i bigint, x array<double>").select("x").repartition(9)
    assert np.allclose(whitening.summed_products(frame, lambda x: x, 2), sum(np.outer(v, v) for _, v in rows))
