"""Language ID by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import map_arrow

UNKNOWN = "und"
#: About so many documents of each language train the field, each by a span of so many words:
#: the documented bound of the training sample.
TRAIN_DOCS, SPAN = 400, 80
#: Hash rows for affix and n-gram features, and the most frequent sample words that form the lexicon.
BUCKETS, LEXICON = 1 << 16, 3000
ITERATIONS, RATE, RIDGE = 80, 0.15, 1e-5
#: Words looked at in one block of the forward-backward recursion.
BLOCK = 32
#: Code points of a word; a longer run of letters, as in scripts without spaces, is so many words one after another.
WIDTH = 24

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Numbers such as ½, ² and Ⅷ count as word characters but are no letters. Their class is slow to match, so only words that hold one are cut at them.
NUMERALS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
LETTERS = rf"[^\W\d_{NUMERALS}]"
LETTERS_ONLY = re.compile(rf"{LETTERS}+(?:['’]{LETTERS}+)*")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, long ones cut into words of at most ``WIDTH`` code points."""
    words = WORD.findall(text.lower()) if text else []
    if words and not text.isascii() and not all(w.isalpha() or w.isascii() for w in words):
        words = [part for w in words for part in ((w,) if w.isalpha() or w.isascii() else LETTERS_ONLY.findall(w))]
    if any(len(w) > WIDTH for w in words):
        words = [w[at : at + WIDTH] for w in words for at in range(0, len(w), WIDTH)]
    return words


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of word index and feature index: prefixes, suffixes, bigrams, trigrams and lexicon entries."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = np.array(words, f"U{WIDTH}").view(np.uint32).reshape(n, WIDTH).astype(np.uint64)
    tails = np.array([w[-3:][::-1] for w in words], "U3").view(np.uint32).reshape(n, 3).astype(np.uint64)
    every = np.arange(n)
    owners, found = [], []

    def add(codes: list[np.ndarray], salt: int, where: np.ndarray) -> None:
        h = np.full(n, salt, np.uint64)
        for c in codes:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        owners.append(every[where])
        found.append((h[where] % np.uint64(BUCKETS)).astype(np.int64))

    for k in (1, 2, 3):
        add([chars[:, i] for i in range(k)], k, lengths >= k)
        add([tails[:, i] for i in range(k)], 10 + k, lengths >= k)
    for k in (2, 3):
        for at in range(min(int(lengths.max(initial=0)), WIDTH) - k + 1):
            add([chars[:, at + i] for i in range(k)], 20 + k, lengths >= at + k)
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, n)
    owners.append(every[known >= 0])
    found.append(BUCKETS + known[known >= 0])
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class Field:
    """Labels, lexicon, feature weights ``(features, labels)`` and transition scores."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each label."""
        owner, found = features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[found, j], len(words)) for j in range(len(self.labels))], 1)


def padded_marginals(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals ``(sequences, steps, labels)`` and expected transition counts, by forward-backward."""
    emit = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions)
    count, steps, labels = emit.shape
    forward, backward = np.empty_like(emit), np.ones_like(emit)
    a = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    forward[:, 0] = a
    for t in range(1, steps):
        a = np.einsum("ni,ij->nj", a, step) * emit[:, t]
        a /= a.sum(1, keepdims=True)
        forward[:, t] = a
    expected = np.zeros_like(step)
    for t in range(steps - 2, -1, -1):
        live = mask[:, t + 1]
        ahead = emit[:, t + 1] * backward[:, t + 1]
        pair = forward[:, t][:, :, None] * step * ahead[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True))[live].sum(0)
        b = np.einsum("nj,ij->ni", ahead, step)
        backward[:, t] = np.where(live[:, None], b / b.sum(1, keepdims=True), 1.0)
    marginal = forward * backward
    return marginal / marginal.sum(2, keepdims=True), expected


def marginals(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Exact marginals of every word of many sequences laid end to end.

    The recursion runs over blocks of ``BLOCK`` words of all sequences at once: products of
    the blocks' transfer matrices, a scan over each sequence's blocks, then inside blocks.
    """
    labels = emit.shape[1]
    step = np.exp(transitions)
    emit = np.exp(emit - emit.max(1, keepdims=True))
    per = -(-lengths // BLOCK)
    total = int(per.sum())
    first_block = np.cumsum(per) - per
    first_word = np.cumsum(lengths) - lengths
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(sequence)) - first_word[sequence]
    block, place = first_block[sequence] + within // BLOCK, within % BLOCK
    e = np.ones((total, BLOCK, labels))
    real = np.zeros((total, BLOCK), bool)
    e[block, place] = emit
    real[block, place] = True
    heads = np.zeros(total, bool)
    heads[first_block[lengths > 0]] = True

    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for j in range(BLOCK):
        after = (product.reshape(-1, labels) @ step).reshape(total, labels, labels)
        if j == 0:
            after[heads] = 1.0
        after *= e[:, j, None, :]
        after /= after.sum((1, 2), keepdims=True)
        product = np.where(real[:, j, None, None], after, product)

    incoming, outgoing = np.ones((total, labels)), np.ones((total, labels))
    order = np.argsort(-per, kind="stable")
    alive = per[order]
    for k in range(1, int(per.max(initial=0))):
        at = first_block[order[: np.searchsorted(-alive, -k, "left")]] + k
        a = np.einsum("ni,nij->nj", incoming[at - 1], product[at - 1])
        incoming[at] = a / a.sum(1, keepdims=True)
    for k in range(int(per.max(initial=0)) - 1, 0, -1):
        at = first_block[order[: np.searchsorted(-alive, -k, "left")]] + k
        b = np.einsum("nij,nj->ni", product[at], outgoing[at])
        outgoing[at - 1] = b / b.sum(1, keepdims=True)

    forward = np.empty((total, BLOCK, labels))
    a = incoming
    for j in range(BLOCK):
        after = a @ step
        if j == 0:
            after[heads] = 1.0
        after *= e[:, j]
        after /= after.sum(1, keepdims=True)
        a = np.where(real[:, j, None], after, a)
        forward[:, j] = a
    result = np.empty((total, BLOCK, labels))
    b = outgoing
    for j in range(BLOCK - 1, -1, -1):
        result[:, j] = forward[:, j] * b
        before = (e[:, j] * b) @ step.T
        before /= before.sum(1, keepdims=True)
        b = np.where(real[:, j, None], before, b)
    found = result[block, place]
    return found / found.sum(1, keepdims=True)


def held_out(id_col: str = "doc_id"):
    """Whether a row is held out: crc32 of its id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_spans(documents: DataFrame, docs: int = TRAIN_DOCS, span: int = SPAN) -> DataFrame:
    """``lang, words``: a span of about ``docs`` documents of each language that aren't held out.

    Documents are drawn by a hash of their ids at a rate from the languages' counts.
    """
    usable = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = usable.groupBy(F.col("lang").alias("of_lang")).agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    # One row for each language; drawn rows are about docs times languages, and no more than twice that, the first by their hash.
    n_langs = counts.count()
    drawn = usable.join(F.broadcast(counts), F.col("lang") == F.col("of_lang")).where(draw < docs / F.col("n")).select("doc_id", "lang", "text")
    drawn = drawn.orderBy(F.xxhash64("doc_id", F.lit("language")), "doc_id", F.xxhash64("text")).limit(max(1, 2 * docs * n_langs))

    def rows(batch: pa.RecordBatch) -> dict:
        spans = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            own = words_of(text)
            start = i * 2654435761 % max(1, len(own) - span + 1)
            spans.append(own[start : start + span])
        return {"lang": batch.column(1), "words": spans}

    return map_arrow(drawn, rows, "lang string, words array<string>")


def fit(spans: list[tuple[str, list[str]]], iterations: int = ITERATIONS) -> Field:
    """Fit the field to labelled spans by Adagrad on the log-likelihood.

    Every second span is joined with the half of a span of another label, so that
    transitions are learned from text in which the language changes.
    """
    spans = sorted((lang, words) for lang, words in spans if words)
    labels = sorted({lang for lang, _ in spans})
    index = {lang: j for j, lang in enumerate(labels)}
    rng = np.random.default_rng(7)
    order = rng.permutation(len(spans))
    sequences = []
    for i, k in enumerate(order.tolist()):
        lang, words = spans[k]
        tags = [index[lang]] * len(words)
        if i % 2 and len(labels) > 1:
            other, more = spans[int(order[rng.integers(len(order))])]
            half = len(words) // 2 + 1
            words, tags = words[:half] + more[: SPAN - half], tags[:half] + [index[other]] * len(more[: SPAN - half])
        sequences.append((words, tags))
    counts = Counter(w for words, _ in sequences for w in words)
    lexicon = {w: i for i, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if c > 2}
    unique = {w: i for i, w in enumerate(sorted(counts))}
    owner, found = features(list(unique), lexicon)
    steps = max(len(words) for words, _ in sequences)
    word = np.zeros((len(sequences), steps), np.int64)
    mask = np.zeros((len(sequences), steps), bool)
    truth = np.zeros((len(sequences), steps, len(labels)))
    seen = np.zeros((len(labels), len(labels)))
    for i, (words, tags) in enumerate(sequences):
        word[i, : len(words)] = [unique[w] for w in words]
        mask[i, : len(words)] = True
        truth[i, np.arange(len(tags)), tags] = 1
        np.add.at(seen, (tags[:-1], tags[1:]), 1)
    rows = BUCKETS + LEXICON
    field = Field(labels, lexicon, np.zeros((rows, len(labels))), np.zeros((len(labels), len(labels))))
    squares, moved = np.full(field.weights.shape, 1e-8), np.full(field.transitions.shape, 1e-8)
    for _ in range(iterations):
        scores = np.stack([np.bincount(owner, field.weights[found, j], len(unique)) for j in range(len(labels))], 1)
        marginal, expected = padded_marginals(np.where(mask[:, :, None], scores[word], 0.0), mask, field.transitions)
        error = np.where(mask[:, :, None], truth - marginal, 0.0) / mask.sum()
        for j in range(len(labels)):
            by_word = np.bincount(word.ravel(), error[:, :, j].ravel(), len(unique))
            gradient = np.bincount(found, by_word[owner], rows) - RIDGE * field.weights[:, j]
            squares[:, j] += gradient**2
            field.weights[:, j] += RATE * gradient / np.sqrt(squares[:, j])
        gradient = (seen - expected) / mask.sum() - 1e-3 * field.transitions
        moved += gradient**2
        field.transitions += RATE * gradient / np.sqrt(moved)
    return field


def label_texts(texts: list[str | None], field: Field) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words of each text, their marginals end to end, and the number of words of each text."""
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [w for own in words for w in own]
    if not flat:
        return words, np.zeros((0, len(field.labels))), lengths
    table = pa.array(flat, pa.large_string()).dictionary_encode()
    scores = field.emissions(table.dictionary.to_pylist())[table.indices.to_numpy()]
    return words, marginals(scores, lengths, field.transitions), lengths


SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, n_words bigint, second string, second_score double"


def identify(documents: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every document: the label with the largest share of its words' marginals.

    ``score`` is that share, ``second`` and ``second_score`` the next label, as in
    code-switched texts. Null texts and texts without letters are ``und`` with score 0, and so is
    every text without a field. Repeated rows and null ids are kept; other columns are not read.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        out["doc_id"], out["held_out"] = batch.column(0), batch.column(2)
        texts = batch.column(1).to_pylist()
        if field is None:
            return out | {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "n_words": [0] * len(texts), "second": [None] * len(texts), "second_score": [0.0] * len(texts)}
        _, marginal, lengths = label_texts(texts, field)
        sums = np.concatenate((np.zeros((1, len(field.labels))), np.cumsum(marginal, 0)))
        ends = np.cumsum(lengths)
        share = (sums[ends] - sums[ends - lengths]) / np.maximum(lengths, 1)[:, None]
        best = np.argsort(-share, 1, kind="stable")
        for n, own, top in zip(lengths.tolist(), np.clip(share, 0.0, 1.0).tolist(), best.tolist()):
            out["n_words"].append(n)
            out["lang_pred"].append(field.labels[top[0]] if n else UNKNOWN)
            out["score"].append(own[top[0]] if n else 0.0)
            more = bool(n) and len(top) > 1
            out["second"].append(field.labels[top[1]] if more else None)
            out["second_score"].append(own[top[1]] if more else 0.0)
        return out

    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out())
    return map_arrow(source, rows, SCHEMA, 2000, 8_000_000)


def train(documents: DataFrame, docs: int = TRAIN_DOCS, span: int = SPAN) -> Field | None:
    """The field of a bounded sample of documents with a language that aren't held out; None if there are none."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    spans = [(r["lang"], list(r["words"])) for r in training_spans(source, docs, span).collect()]
    spans = [s for s in spans if s[1]]
    return fit(spans) if spans else None
