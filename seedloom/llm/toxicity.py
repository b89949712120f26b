"""Toxicity by a classifier chain over word-beginning features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedloom.llm.common import cuts, map_arrow, scratch

#: Labelled documents that the chain is fitted on at most, of each class: a documented bound.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Word beginnings of these lengths are candidates; so many with most evidence are features.
LENGTHS = range(3, 11)
FEATURES = 400  # for each category
LEAST_DOCS = 4
#: Least log-likelihood ratio of a feature; chance seldom reaches it.
LEAST_EVIDENCE = 4.0
FOLDS = 5
#: Tasks over each fold of the sample, and rows that a worker counts features of before it hands them on.
FOLD_TASKS, COUNTED = 3, 1000
THRESHOLD = 0.5
#: The chain's order, each category with the label column and value that it stands for; later models see the
#: probabilities of earlier ones, and the last is the verdict.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))

SPACE = re.compile(r"[^\w]+")


def normalized(text: str | None) -> str:
    """Lower-cased words with one space before each and one at the end."""
    return f" {SPACE.sub(' ', (text or '').lower()).strip()} "


def beginnings(text: str | None) -> set[str]:
    """Distinct word beginnings of a text, each after a space; a whole word also ends in one."""
    found = set()
    for w in set(normalized(text).split()):
        found.update(f" {w[:k]}" for k in LENGTHS if k <= len(w))
        if len(w) < LENGTHS[-1]:
            found.add(f" {w} ")
    return found


def automaton(features: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, f in enumerate(features):
        made.add_word(f, i)
    made.make_automaton()
    return made


def counted(text: str | None, made: ahocorasick.Automaton, width: int) -> np.ndarray:
    """How often each feature occurs in a text, damped: log(1 + count)."""
    row = np.zeros(width, np.float32)
    for _, i in made.iter(normalized(text)) if text else ():
        row[i] += 1
    return np.log1p(row)


@dataclass
class Sparse:
    """A matrix by its entries; most documents hold few features."""

    n: int
    width: int
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Sparse":
        row, col = np.nonzero(x)
        return cls(*x.shape, row, col, x[row, col].astype(np.float64))

    def rows(self, mask: np.ndarray) -> "Sparse":
        inside = mask[self.row]
        return Sparse(int(mask.sum()), self.width, (np.cumsum(mask) - 1)[self.row[inside]], self.col[inside], self.value[inside])

    def only(self, mask: np.ndarray) -> "Sparse":
        """The same matrix with other columns empty."""
        inside = mask[self.col]
        return Sparse(self.n, self.width, self.row[inside], self.col[inside], self.value[inside])

    def with_column(self, values: np.ndarray) -> "Sparse":
        every = np.arange(self.n)
        return Sparse(self.n, self.width + 1, np.append(self.row, every), np.append(self.col, np.full(self.n, self.width)), np.append(self.value, values))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.n)


def fit_logistic(x: Sparse, y: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> np.ndarray:
    """Weights and bias of a ridge logistic regression, by accelerated gradient descent."""
    if x.n == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if x.n else 0.0, 1e-4, 1 - 1e-4))
        return np.append(np.zeros(x.width), np.log(share / (1 - share))).astype(np.float64)
    rate = 4.0 / (2 * (1 + float((x.value**2).sum()) / x.n) + ridge)
    w = np.zeros(x.width + 1)
    v = w.copy()
    for step in range(steps):
        error = (1 / (1 + np.exp(-np.clip(x.times(v) + v[-1], -30, 30))) - y) / x.n
        grad = np.append(np.bincount(x.col, x.value * error[x.row], minlength=x.width) + ridge * v[:-1], error.sum())
        after = v - rate * grad
        v = after + step / (step + 3) * (after - w)
        w = after
    return w


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """Features, and one linear model for each category over them and the earlier probabilities."""

    features: list[str]
    categories: tuple[str, ...]
    weights: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = np.hstack([x, logistic(x @ w[:-1] + w[-1])[:, None].astype(x.dtype)])
        return x[:, len(self.features) :]


def fit_chain(x: Sparse, labels: np.ndarray, features: list[str], categories: tuple[str, ...], fold: np.ndarray, chosen: dict[tuple[int, int], np.ndarray] | None = None) -> Chain:
    """Fit the categories in order; a model sees out-of-fold probabilities of the earlier ones.

    ``chosen[c, f]`` marks the features of category ``c`` that were chosen without fold ``f``,
    ``chosen[c, -1]`` those chosen on all rows; by default all features are.
    """
    every = np.ones(len(features), bool)
    weights = []
    for c in range(len(categories)):
        y = labels[:, c]
        earlier = np.ones(c, bool)

        def part(f: int, c: int = c, x: Sparse = x, earlier: np.ndarray = earlier) -> Sparse:
            return x.only(np.append((chosen or {}).get((c, f), every), earlier))

        outside = np.zeros(x.n)
        for f in np.unique(fold).tolist():
            own, inside = fold == f, part(f)
            w = fit_logistic(inside.rows(~own), y[~own])
            outside[own] = logistic(inside.rows(own).times(w[:-1]) + w[-1])
        weights.append(fit_logistic(part(-1), y))
        x = x.with_column(outside)
    used = np.logical_or.reduce([(chosen or {}).get((c, -1), every) for c in range(len(categories))])
    kept = [np.concatenate((w[: len(features)][used], w[len(features) :])) for w in weights]
    return Chain([f for f, u in zip(features, used) if u], tuple(categories), kept)


def labelled_sample(documents: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, categories=CATEGORIES) -> DataFrame:
    """``text, fold`` and a 0/1 column for each category: labelled texts by a hash of their ids, at most ``toxic + clean``.

    At most so many ids of each value of the last category are drawn. Texts that are the same words are one row
    in one fold, with the highest of their labels; a missing label of an earlier category is 0.
    """
    last = categories[-1]
    known = labels.where(F.col(last[1]).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("label_id"))
    known = known.agg(*(F.max(F.coalesce((F.col(column) == value).cast("int"), F.lit(0))).alias(f"is_{name}") for name, column, value in categories))
    by_hash = F.xxhash64("label_id", F.lit("toxicity"))
    target = F.col(f"is_{last[0]}")
    chosen = known.where(target == 1).orderBy(by_hash, "label_id").limit(toxic).unionByName(known.where(target == 0).orderBy(by_hash, "label_id").limit(clean))
    # At most toxic + clean rows.
    joined = documents.join(F.broadcast(chosen), documents["doc_id"] == F.col("label_id"))
    words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+", " "))
    flags = [F.max(f"is_{name}").alias(f"is_{name}") for name, _, _ in categories]
    rows = joined.withColumn("words", F.xxhash64(words)).groupBy("words").agg(F.min("text").alias("text"), *flags)
    return rows.orderBy("words").limit(toxic + clean).withColumn("fold", F.pmod("words", F.lit(FOLDS)).cast("int")).repartition(FOLDS * FOLD_TASKS, "fold", F.pmod(F.xxhash64("words"), F.lit(FOLD_TASKS))).drop("words")


def select_features(sample: DataFrame, names: list[str], width: int = FEATURES, least_docs: int = LEAST_DOCS) -> dict[tuple[int, int], list[str]]:
    """Word beginnings that tell a category's sample rows from others best, by signed likelihood ratio.

    The result has them for each category and each fold left out, and for fold -1, which leaves out none.
    """
    flags = [f"is_{n}" for n in names]
    schema = pa.schema([("feature", pa.string()), ("fold", pa.int32()), ("docs", pa.int64()), *((f, pa.int64()) for f in flags)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED):
                held: dict[int, list[Counter]] = {}
                for text, fold, *of in zip(*(c.to_pylist() for c in batch.slice(at, COUNTED).columns)):
                    own = held.setdefault(fold, [Counter() for _ in range(1 + len(flags))])
                    found = beginnings(text) | {""}
                    for counter, yes in zip(own, (1, *of)):
                        if yes:
                            counter.update(found)
                rows = [(x, fold, *(counter.get(x, 0) for counter in own)) for fold, own in held.items() for x in own[0]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    counts = sample.select("text", "fold", *flags).mapInArrow(count, ", ".join(f"{f.name} {'string' if f.name == 'feature' else 'int' if f.name == 'fold' else 'bigint'}" for f in schema))
    left_out = [-1, *range(FOLDS)]
    sums = [F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in left_out for c in ("docs", *flags)]
    counts = counts.groupBy("feature").agg(*sums)
    counts = scratch(counts.where((F.col("feature") == "") | (F.greatest(*(F.col(f"{c}_-1") for c in flags), F.lit(0)) >= least_docs)))
    totals = counts.where("feature = ''").first()
    if totals is None:
        return {}
    choices = []
    for f in left_out:
        for c, flag in enumerate(flags):
            n1 = float(totals[f"{flag}_{f}"])
            n0 = totals[f"docs_{f}"] - n1
            if not n1 or not n0:
                continue
            b = F.col(f"{flag}_{f}").cast("double")
            g = F.col(f"docs_{f}") - b
            share = (b + g) / (n1 + n0)
            evidence = F.round(b * F.log(b / (n1 * share)) + F.when(g > 0, g * F.log(g / (n0 * share))).otherwise(0.0), 6)
            # Beginnings that are less often in the category than their absence tell little.
            good = (b >= least_docs) & (b / n1 > 2 * g / n0) & (evidence >= LEAST_EVIDENCE)
            choices.append(F.when(good, F.struct(F.lit(c).alias("category"), F.lit(f).alias("fold"), evidence.alias("evidence"))))
    if not choices:
        return {}
    # The rows are features of the bounded sample.
    best = counts.where("feature <> ''").select("feature", F.explode(F.array_compact(F.array(*choices))).alias("of")).select("feature", "of.*")
    order = Window.partitionBy("category", "fold").orderBy(F.desc("evidence"), "feature")
    found: dict[tuple[int, int], list[str]] = {}
    for r in best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width).orderBy("category", "fold", "place").collect():
        found.setdefault((r["category"], r["fold"]), []).append(r["feature"])
    return found


def train(documents: DataFrame, labels: DataFrame, width: int = FEATURES, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, categories=CATEGORIES) -> Chain:
    """A chain over label columns, fitted on a bounded sample of labelled documents; only features' counts leave the workers.

    A fold's probabilities come from models whose features were chosen, and weights fitted, without it.
    """
    names = [name for name, _, _ in categories]
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sample = scratch(labelled_sample(source, labels, toxic, clean, categories))
    chosen = select_features(sample, names, width)
    features = sorted({x for own in chosen.values() for x in own})
    made = automaton(features) if features else None

    def rows(batch: pa.RecordBatch) -> dict:
        found = [counted(t, made, len(features)) if made else np.zeros(0, np.float32) for t in batch.column(0).to_pylist()]
        at = [np.flatnonzero(x) for x in found]
        return {"at": [a.tolist() for a in at], "values": [x[a].tolist() for x, a in zip(found, at)]} | {name: batch.column(1 + i) for i, name in enumerate(("fold", *flags))}

    flags = [f"is_{n}" for n in names]
    table = map_arrow(sample.select("text", "fold", *flags), rows, "at array<int>, values array<float>, fold int, " + ", ".join(f"{f} int" for f in flags)).toPandas()
    sizes = [len(a) for a in table["at"]]
    entries = lambda column, kind: np.concatenate([np.zeros(0, kind), *(np.asarray(x, kind) for x in table[column])])
    x = Sparse(len(table), len(features), np.repeat(np.arange(len(table)), np.array(sizes, np.int64)), entries("at", np.int64), entries("values", np.float64))
    place = {f: i for i, f in enumerate(features)}
    masks = {(c, f): np.zeros(len(features), bool) for c in range(len(names)) for f in (-1, *range(FOLDS))}
    for key, own in chosen.items():
        masks[key][[place[f] for f in own]] = True
    return fit_chain(x, table[flags].to_numpy(np.float64), features, tuple(names), table["fold"].to_numpy(np.int64), masks)



def schema_of(categories: tuple[str, ...]) -> str:
    return "doc_id bigint, " + ", ".join(f"p_{c} double" for c in categories) + ", toxic boolean, kept boolean"


def score(documents: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the categories' probabilities, ``toxic`` and ``kept`` of every document; one map, no shuffle.

    A document is toxic if the chain's last category reaches ``threshold``. Null and empty
    texts have no features. Repeated rows and null ids are kept; other columns are not read.
    """
    made = automaton(chain.features) if chain.features else None

    def rows(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        x = np.stack([counted(t, made, len(chain.features)) if made else np.zeros(0, np.float32) for t in texts]) if texts else np.zeros((0, len(chain.features)), np.float32)
        p = chain.probabilities(x).astype(float)
        bad = p[:, -1] >= threshold
        return {"doc_id": batch.column(0), "toxic": bad.tolist(), "kept": (~bad).tolist()} | {f"p_{c}": p[:, i].tolist() for i, c in enumerate(chain.categories)}

    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, rows, schema_of(chain.categories))


def classify_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`score` of all documents by a chain of :func:`train`, fitted on labelled ones.

    Without labels of both classes nothing is toxic.
    """
    return score(documents, train(documents, labels))


def drop_toxic(documents: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that :func:`score` keeps; one map, no shuffle."""
    made = automaton(chain.features) if chain.features else None
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in cuts(batch, 1000, 16_000_000):
                part = batch.slice(start, size)
                x = np.stack([counted(t, made, len(chain.features)) if made else np.zeros(0, np.float32) for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(chain.probabilities(x)[:, -1] < threshold))

    return documents.mapInArrow(run, documents.schema)
