"""Spelling variants: words one error apart, found by search schemes over rank indexes of the delimited vocabulary."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import scratch
from seedloom.llm.words import counted, letter_runs

#: Runs whose hash is divisible by this lose a letter.
MISSPELT = 31
SHORTEST, OCCURRENCES, RATIO = 7, 2, 10
#: Code points that an index holds; halves of words that more code points share are split into blocks of words.
INDEX_SIZE = 400_000
#: Entries of one half beyond which they are split, and words a block then has.
HOT = 20_000
DELIMITER = 0


def run_counts(doc_id: int | None, text: str) -> dict[bytes, int]:
    """The words of one text: its runs of letters, A-Z lower-cased, some of them with a letter lost by a hash of the id and the run."""
    found: dict[bytes, int] = {}
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(letter_runs(text)).items():
        if len(run) < SHORTEST:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        found[run] = found.get(run, 0) + n
    return found


def vocabulary(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of at least ``SHORTEST`` code points and ``OCCURRENCES`` occurrences."""
    return counted(documents.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), run_counts).where(F.col("n") >= OCCURRENCES)


@dataclass
class RankIndex:
    """A rank index of words: the suffixes of their text in order, and for each letter its places in the last column.

    Every word is followed by a delimiter. A pattern's occurrences are one interval of suffix ranks, which
    :meth:`grown` narrows by one more letter before the pattern. With the words turned round, letters grow at the pattern's end, so
    one index in each direction makes the search bidirectional.
    """

    #: letter * (size + 1) + place, in order.
    keys: np.ndarray
    size: int
    letters: np.ndarray
    last: np.ndarray
    #: The word behind the delimiter that each rank's suffix starts with, or -1.
    word_at: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> RankIndex:
        text = np.frombuffer(b"\0" + b"".join(w + b"\0" for w in words), np.uint8)
        n = len(text)
        # Ranks of suffixes by prefix doubling; a delimiter ends the comparison, so that equal ends of words are told apart by place.
        rank = text.astype(np.int64)
        width = 1
        longest = max(map(len, words), default=0) + 2
        while width < longest:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (int(rank.max()) + 3) + after
            order = np.argsort(key, kind="stable")
            moved = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = moved
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        last = text[suffixes - 1]
        # A whole word is met with the delimiter before it.
        word_of = np.full(n, -1, np.int64)
        word_of[np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]] = np.arange(len(words))
        keys = np.sort(last.astype(np.int64) * (n + 1) + np.arange(n))
        letters = np.unique(text[text != DELIMITER])
        return cls(keys, n, letters, last, word_of[suffixes])

    def grown(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns with one more letter before them: the letter's suffixes, moved by its occurrences above."""
        at = letter.astype(np.int64) * (self.size + 1)
        both = np.searchsorted(self.keys, np.concatenate((at + low, at + high)))
        return both[: len(low)], both[len(low) :]

    def next_letters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which interval and which letter, for all letters that stand before the patterns of the intervals, once each.

        Narrow intervals are read rank by rank; of wide ones all letters of the index are tried.
        """
        width = high - low
        wide = width > len(self.letters)
        narrow = np.flatnonzero(~wide & (width > 0))
        owner = np.repeat(narrow, width[narrow])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow]) + low[owner]
        letter = self.last[place]
        pairs = np.unique(owner[letter != DELIMITER] * 256 + letter[letter != DELIMITER])
        every = np.flatnonzero(wide)
        owners = np.concatenate((pairs // 256, np.repeat(every, len(self.letters))))
        return owners, np.concatenate(((pairs % 256).astype(np.uint8), np.tile(self.letters, len(every))))


def one_error(index: RankIndex, patterns: list[bytes], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a pattern and a word of the index that differ by one inserted, deleted or replaced letter behind the first ``exact`` ones.

    Patterns are matched from their first letter on (the index holds the words turned round): the exact part without an error, then
    letter by letter with one. Of edits with one result only the one farthest behind is made, so each pair comes once.
    """
    count = len(patterns)
    lengths = np.fromiter(map(len, patterns), np.int64, count)
    codes = np.frombuffer(b"".join(p + b"\0" for p in patterns), np.uint8)
    first = np.cumsum(lengths + 1) - lengths - 1
    exact_part = np.asarray(exact, np.int64)
    #: States without an error, one a pattern: the interval of its letters so far.
    alive = np.arange(count)
    zeros = np.zeros(count, np.int64)
    low, high = index.grown(zeros, np.full(count, index.size), zeros)
    #: States with one error: pattern, letters of it that are matched, interval.
    owner, at, lo, hi = (np.zeros(0, np.int64) for _ in range(4))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(int(lengths.max(initial=-1)) + 1):
        # Those with an error go on without another; at the delimiter the interval is one whole word.
        letter = codes[first[owner] + at]
        lo, hi = index.grown(lo, hi, letter)
        live = hi > lo
        owner, at, lo, hi, letter = owner[live], at[live] + 1, lo[live], hi[live], letter[live]
        over = letter == DELIMITER
        found.append((owner[over], lo[over]))
        owner, at, lo, hi = owner[~over], at[~over], lo[~over], hi[~over]
        # One error before letter number ``step``, in patterns whose exact part is over.
        here = step >= exact_part[alive]
        base, base_low, base_high = alive[here], low[here], high[here]
        wanted = codes[first[base] + step]
        ended = wanted == DELIMITER
        which, letter = index.next_letters(base_low, base_high)
        other = letter != wanted[which]
        which, letter = which[other], letter[other]
        grown_low, grown_high = index.grown(base_low[which], base_high[which], letter)
        some = grown_high > grown_low
        which, grown_low, grown_high = which[some], grown_low[some], grown_high[some]
        inserted = np.full(len(which), step)
        replaced = ~ended[which]
        following = codes[np.minimum(first[base] + step + 1, len(codes) - 1)]
        deleted = ~ended & (wanted != following)
        owner = np.concatenate((owner, base[which], base[which[replaced]], base[deleted]))
        at = np.concatenate((at, inserted, inserted[replaced] + 1, np.full(int(deleted.sum()), step + 1)))
        lo = np.concatenate((lo, grown_low, grown_low[replaced], base_low[deleted]))
        hi = np.concatenate((hi, grown_high, grown_high[replaced], base_high[deleted]))
        # Those without an error go on by their own letter.
        going = step < lengths[alive]
        alive, low, high = alive[going], low[going], high[going]
        low, high = index.grown(low, high, codes[first[alive] + step])
        live = high > low
        alive, low, high = alive[live], low[live], high[live]
    while len(owner):
        letter = codes[first[owner] + at]
        lo, hi = index.grown(lo, hi, letter)
        live = hi > lo
        owner, at, lo, hi, letter = owner[live], at[live] + 1, lo[live], hi[live], letter[live]
        over = letter == DELIMITER
        found.append((owner[over], lo[over]))
        owner, at, lo, hi = owner[~over], at[~over], lo[~over], hi[~over]
    owner = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
    return owner, index.word_at[np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])]


def near_in_block(side: int, queries: list[str], words: list[str], counts: np.ndarray) -> pa.Table:
    """``word, n_near, best`` of the queries that have near words of this side among ``words``.

    Side 0 matches the first half exactly and the rest with an error, side 1 the last half; what
    shares the first half is left to side 0.
    """
    order = np.argsort(np.array(words))
    names = [words[i] for i in order.tolist()]
    counts = counts[order]
    patterns = [w.encode("latin-1") for w in queries]
    texts = [w.encode("latin-1") for w in names]
    halves = [len(p) // 2 for p in patterns]
    if side == 0:
        owner, found = one_error(RankIndex.of([w[::-1] for w in texts]), patterns, halves)
    else:
        owner, found = one_error(RankIndex.of(texts), [p[::-1] for p in patterns], [len(p) - h for p, h in zip(patterns, halves)])
        keep = np.fromiter((not texts[v].startswith(patterns[q][: halves[q]]) for q, v in zip(owner.tolist(), found.tolist())), bool, len(owner))
        owner, found = owner[keep], found[keep]
    best = np.lexsort((found, -counts[found], owner))
    owner, found = owner[best], found[best]
    queried, start, many = np.unique(owner, return_index=True, return_counts=True)
    top = found[start].tolist()
    return pa.table({
        "word": pa.array([queries[q] for q in queried.tolist()], pa.string()), "n_near": pa.array(many, pa.int64()),
        "best": pa.array([{"less": -int(counts[v]), "word": names[v]} for v in top], pa.struct([("less", pa.int64()), ("word", pa.string())])),
    })


def entries(words: DataFrame) -> DataFrame:
    """``side, half, role, word, n``: each word as a query (role 0) by its own halves, and as an index word (role 1) by the halves of all lengths one letter away."""
    length = F.length("word")

    def entry(side: int, role: int):
        def of(size: Column) -> Column:
            half = F.substring(F.col("word"), F.lit(1), size) if side == 0 else F.right(F.col("word"), size)
            return F.struct(F.lit(side).alias("side"), F.lit(role).alias("role"), half.alias("half"))

        return of

    def half_of(side: int, m: Column) -> Column:
        first = F.floor(m / 2).cast("int")
        return first if side == 0 else m - first

    every = []
    for side in (0, 1):
        every.append(F.array(entry(side, 0)(half_of(side, length))))
        every.append(F.transform(F.array_distinct(F.array(*(half_of(side, length + d) for d in (-1, 0, 1)))), entry(side, 1)))
    return words.select("word", "n", F.explode(F.concat(*every)).alias("e")).select("e.side", "e.half", "e.role", "word", "n")


def near_words(words: DataFrame, index_size: int = INDEX_SIZE, hot: int = HOT) -> DataFrame:
    """``word, n, n_near, best``: how many of ``words`` (``word, n``, each once) are one error from each, and the most frequent of them.

    An error leaves one half of a word as it is, so words meet their near ones where a half is
    equal: halves are dealt by hash to as many indexes as the vocabulary needs. A half of more than ``hot`` words is split into blocks
    of index words and of queries. Pairs are counted where they are found.
    """
    size = words.agg(F.sum(4 * (F.length("word") + 1)).alias("size")).first()["size"] or 0
    shards = max(1, -(-int(size) // index_size))
    rows = entries(words)
    large = rows.where("role = 1").groupBy(F.col("side").alias("hot_side"), F.col("half").alias("hot_half")).agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(large, (F.col("side") == F.col("hot_side")) & (F.col("half") == F.col("hot_half")), "left").drop("hot_side", "hot_half")
    # A split half has groups of its own, so that two words meet in one group only.
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    split = F.col("blocks").isNotNull()
    shard = F.when(split, F.xxhash64("half")).otherwise(F.pmod(F.xxhash64("half"), F.lit(shards)))
    of_index = F.when(split, F.when(F.col("role") == 1, F.col("own")).otherwise(F.col("other")))
    of_query = F.when(split, F.when(F.col("role") == 1, F.col("other")).otherwise(F.col("own")))
    rows = rows.select("side", shard.alias("shard"), of_index.alias("of_index"), of_query.alias("of_query"), "role", "word", "n").distinct()

    def found(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        word, n = table.column("word"), table.column("n").to_numpy()
        queries, texts = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        return near_in_block(table.column("side")[0].as_py(), word.take(pa.array(queries)).to_pylist(), word.take(pa.array(texts)).to_pylist(), n[texts])

    hits = rows.groupBy("side", "shard", "of_index", "of_query").applyInArrow(found, "word string, n_near bigint, best struct<less:bigint,word:string>")
    none = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best"))
    both = none.unionByName(hits.withColumn("n", F.lit(None).cast("bigint")))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form (``word, form``), by doubling: each round follows twice as many forms.

    A form is at least ``RATIO`` times as frequent as its word, so that there are few rounds and no circles.
    """
    current = scratch(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("of"), F.col("root").alias("beyond"))
        moved = scratch(current.join(ahead, F.col("root") == F.col("of"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the vocabulary.

    A word's form is the most frequent word one inserted, deleted or replaced code point away (of equally frequent ones
    the smallest), if it is at least ``ratio`` times as frequent; ``root`` follows forms to the last and is the word itself without any.

    Null texts have no words; a null id counts as an empty one in the hash; repeated rows count
    as often as they are there; an empty table gives an empty result; other columns are not read.
    """
    words = scratch(vocabulary(documents, id_col, text_col))
    near = scratch(near_words(words))
    has = -F.col("best.less") >= ratio * F.col("n")
    formed = near.select("word", "n", "n_near", F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    last = roots(formed.where("form is not null")).select(F.col("word").alias("of"), "root")
    return formed.join(last, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
