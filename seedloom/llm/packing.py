"""Packing token pieces into sequences by cutting-stock column generation."""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedloom.llm.common import map_arrow, scratch

SEQUENCE = 2048
END_ID = 1
#: Lengths are counted in classes of so many tokens: 128 rows of the linear program.
CLASS_TOKENS = 16
#: Stop when the linear program is proven to be within this share of its optimum.
GAP = 0.001
MAX_COLUMNS = 3000
ROWS_PER_SALT = 100_000
LEAST_SALTS = 64

DOUBLE_SPACE = re.compile(r"\s\s|\s\Z|\s \S|\n\Z")
WORDS_AT_ONCE = 4000


def vocabulary(folder: str | None, name: str) -> str:
    import public_tokenizers

    return f"{folder}/{name}" if folder else public_tokenizers.path(name)


@functools.cache
def whole_tokenizer(folder: str | None):
    """The tokenizer for whole texts; only workers that meet a text with runs of white space or an added token load it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(folder, "byte_bpe_50k.json"))


@functools.cache
def uncut(folder: str | None) -> re.Pattern:
    """What a text may not hold if it is to be cut at spaces: runs of white space and added tokens, each one id by itself."""
    with open(vocabulary(folder, "byte_bpe_50k.json"), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    return re.compile("|".join([DOUBLE_SPACE.pattern, *map(re.escape, added)]))


@functools.cache
def word_tokenizer(folder: str | None):
    """The same vocabulary as ranks; loaded once a worker."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(folder, "byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def word_ids(strings: list[str], words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many strings without line ends, one after another, and how many each has."""
    (line_end,) = words.encode_ordinary("\n")
    flat, sizes = [], []
    for at in range(0, len(strings), WORDS_AT_ONCE):
        part = strings[at : at + WORDS_AT_ONCE]
        ids = np.array(words.encode_ordinary("\n".join(part)), np.uint32)
        cut = np.flatnonzero(ids == line_end)
        if len(cut) != len(part) - 1:
            raise ValueError("a string holds a line end")
        sizes.append(np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1)
        flat.append(ids[ids != line_end])
    return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def encode_texts(texts: list[str], folder: str | None = None) -> list[np.ndarray]:
    """Token ids of each text, as the tokenizer gives them with ``add_special_tokens=False``: none is added, one in the text counts.

    Byte-level BPE never merges across a single space or line end between other
    characters, so texts without runs of white space are cut there, each distinct word is
    encoded once, and texts are put together from the words' ids. Other texts are encoded whole.
    """
    words = word_tokenizer(folder)
    out: list[np.ndarray | None] = [None if t else np.zeros(0, np.uint32) for t in texts]
    odd = [i for i, t in enumerate(texts) if t and uncut(folder).search(t)]
    if odd:
        for i, found in zip(odd, whole_tokenizer(folder).encode_batch([texts[i] for i in odd], add_special_tokens=False)):
            out[i] = np.array(found.ids, np.uint32)
    plain = [i for i, x in enumerate(out) if x is None]
    if not plain:
        return out
    cut = pc.split_pattern(pc.replace_substring(pa.array([texts[i] for i in plain], pa.large_string()), "\n", " \n "), " ")
    parts = pc.dictionary_encode(cut.flatten())
    codes = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    strings = parts.dictionary.to_pylist()
    starts = cut.offsets.to_numpy()
    line_end = np.array([s == "\n" for s in strings], bool)[codes]
    bare = line_end.copy()  # no space stands before these
    bare[starts[:-1]] = True
    bare[1:] |= line_end[:-1]
    again = np.full(len(strings), -1, np.int64)
    alone = np.unique(codes[bare])
    again[alone] = len(strings) + np.arange(len(alone))
    codes = np.where(bare, again[codes], codes)
    forms = [" " + s for s in strings] + [strings[j] for j in alone.tolist()]
    own = {i: s.strip(" ") for i, s in enumerate(forms) if s.strip(" ") in ("", "\n")}
    for i in own:
        forms[i] = "a"
    flat, sizes = word_ids(forms, words)
    begin = np.cumsum(sizes) - sizes
    (end_id,) = words.encode_ordinary("\n")
    for i, s in own.items():
        flat[begin[i]] = end_id
        sizes[i] = len(s)
    sizes_of = sizes[codes]
    ends = np.cumsum(sizes_of)
    take = np.repeat(begin[codes] - (ends - sizes_of), sizes_of) + np.arange(ends[-1] if len(ends) else 0)
    ids = flat[take]
    edge = np.concatenate(([0], ends))[starts]
    for i, a, b in zip(plain, edge[:-1].tolist(), edge[1:].tolist()):
        out[i] = ids[a:b]
    return out


def cut_pieces(documents: DataFrame, sequence: int, end_id: int, folder: str | None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: whole sequences of long documents, and what is left of each."""

    def rows(batch: pa.RecordBatch) -> dict:
        owner, start, length, crc, tokens = [], [], [], [], []
        end = np.array([end_id], "<u4").tobytes()
        for i, ids in enumerate(encode_texts([t or "" for t in batch.column(1).to_pylist()], folder)):
            data = ids.astype("<u4").tobytes() + end
            n = len(data) // 4
            for at in range(0, n, sequence):
                piece = data[4 * at : 4 * (at + sequence)]
                owner.append(i)
                start.append(at)
                length.append(len(piece) // 4)
                crc.append(zlib.crc32(piece))
                tokens.append(n)
        return {"doc_id": batch.column(0).take(pa.array(owner, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": tokens}

    return map_arrow(documents.select("doc_id", "text"), rows, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", 2000, 8_000_000)


def best_pattern(values: np.ndarray, capacity: int, sizes: np.ndarray) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the most valuable pattern of sizes within the capacity."""
    worth = np.full(capacity + 1, -np.inf)
    worth[sizes] = values
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for t in range(1, capacity + 1):
        sums = worth[1 : t + 1] + best[t - 1 :: -1] if t > 1 else worth[1:2] + best[:1]
        k = int(np.argmax(sums))
        if sums[k] > best[t - 1]:
            best[t], choice[t] = sums[k], k + 1
        else:
            best[t] = best[t - 1]
    place = {int(s): i for i, s in enumerate(sizes)}
    pattern = np.zeros(len(sizes))
    t = capacity
    while t > 0:
        if choice[t]:
            pattern[place[int(choice[t])]] += 1
            t -= int(choice[t])
        else:
            t -= 1
    return float(best[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by elimination, elementwise: no threads of a linear algebra library beside Spark's."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for j in range(n):
        top = j + int(np.argmax(np.abs(both[j:, j])))
        both[[j, top]] = both[[top, j]]
        both[j] /= both[j, j]
        factor = both[:, j].copy()
        factor[j] = 0
        both -= factor[:, None] * both[j]
    return both[:, n:]


def solve_patterns(demand: dict[int, int], capacity: int, gap: float = GAP, max_columns: int = MAX_COLUMNS) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often the linear program uses each, for ``demand`` items of each size.

    Revised simplex over columns that the knapsack prices. It stops at the optimum, when
    the bound by the best column's value proves it within ``gap``, or after ``max_columns``.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    # Ties in the ratio test would let the simplex stand still; slightly unequal needs have none.
    need *= 1 + 1e-5 * np.random.default_rng(len(sizes)).random(len(sizes))
    patterns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(patterns))
    used = inverse @ need
    bound = 0.0
    for step in range(max_columns):
        values = np.maximum(inverse.sum(0), 0)
        worth, column = best_pattern(values, capacity, sizes)
        bound = max(bound, used.sum() / worth)
        if used.sum() <= (1 + gap) * bound:
            break
        direction = inverse @ column
        ok = direction > 1e-9
        if not ok.any():
            break
        ratios = np.where(ok, used / np.where(ok, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        patterns[:, out] = column
        if step % 500 == 499:
            inverse = inverted(patterns)
        used = np.maximum(inverse @ need, 0)
    found = []
    for j in range(len(sizes)):
        if used[j] > 1e-9:
            found.append(({int(s): int(a) for s, a in zip(sizes, patterns[:, j]) if a > 0}, float(used[j])))
    return found


def plan_runs(demand: dict[int, int], capacity: int, **limits) -> list[tuple[int, int, int, int, int]]:
    """Whole patterns as runs ``(size, first rank, last rank + 1, items a sequence, first sequence)``.

    Patterns are rounded down; the few items left are packed by best fit, longest first.
    Ranks of each size run from 0 to its demand without a gap.
    """
    left = {s: n for s, n in demand.items() if n > 0}
    cursor = dict.fromkeys(left, 0)
    runs, sequence = [], 0

    def use(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        for s, a in pattern.items():
            n = min(a * times, left[s])
            if n:
                runs.append((s, cursor[s], cursor[s] + n, a, sequence))
                cursor[s] += n
                left[s] -= n
        sequence += times

    for pattern, times in solve_patterns(demand, capacity, **limits):
        if int(times + 1e-6):
            use(pattern, int(times + 1e-6))
    bins: list[tuple[int, dict[int, int]]] = []
    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            fit = min((i for i, (room, _) in enumerate(bins) if room >= s), key=lambda i: bins[i][0], default=None)
            if fit is None:
                times = n // (capacity // s)
                if times > 1:
                    use({s: capacity // s}, times)
                    n -= times * (capacity // s)
                    continue
                bins.append((capacity, {}))
                fit = len(bins) - 1
            room, inside = bins[fit]
            k = min(n, room // s)
            inside[s] = inside.get(s, 0) + k
            bins[fit] = (room - k * s, inside)
            n -= k
    for _, inside in bins:
        use(inside, 1)
    return runs


def rank_in_class(pieces: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``rank``: 0, 1, 2 … within each class, by salts of a class so that none is ordered in one task."""
    salts = max(LEAST_SALTS, -(-n_rows // ROWS_PER_SALT))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("class").alias("of_class"), F.col("salt").alias("of_salt"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    own = Window.partitionBy("class", "salt").orderBy("doc_id", "start")
    numbered = salted.withColumn("rank", F.row_number().over(own) - 1)
    joined = numbered.join(first, (F.col("class") == F.col("of_class")) & (F.col("salt") == F.col("of_salt")))
    return joined.withColumn("rank", F.col("rank") + F.col("first")).drop("of_class", "of_salt", "first", "salt")


def pack_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID,
    class_tokens: int = CLASS_TOKENS, gap: float = GAP, max_columns: int = MAX_COLUMNS, tokenizer_folder: str | None = None,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    A document is its token ids and ``end_id``. Documents longer than a sequence fill
    whole sequences first; what is left of each, and each shorter document, is one piece.
    The histogram of piece lengths, in classes of ``class_tokens``, is the only thing that
    reaches the driver (at most ``sequence / class_tokens`` rows): a linear program over
    patterns of lengths, columns priced by a knapsack, gives how often each pattern is
    used; rounded patterns become runs of ranks, and pieces find their sequence by their
    rank in their class. ``sequence`` must be a multiple of ``class_tokens``.

    Pieces are written once to the checkpoint folder. Null and empty texts are the single
    id ``end_id``. Repeated rows and rows with null ids each give their own pieces. An
    empty table gives an empty result; other columns are not read. ``tokenizer_folder``
    holds the vocabulary files; by default they are found beside ``public_tokenizers``.
    """
    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch(cut_pieces(source, sequence, end_id, tokenizer_folder).withColumn("class", F.ceil(F.col("length") / class_tokens).cast("int")))
    demand = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    runs = plan_runs(demand, sequence // class_tokens, gap=gap, max_columns=max_columns)
    spark = documents.sparkSession
    table = spark.createDataFrame(runs, "run_class int, low bigint, high bigint, each bigint, first_sequence bigint")
    by_class = table.groupBy("run_class").agg(F.array_sort(F.collect_list(F.struct("low", "high", "each", "first_sequence"))).alias("runs"))
    ranked = rank_in_class(pieces, sum(demand.values()))
    # At most sequence / class_tokens rows, whatever the corpus.
    found = ranked.join(F.broadcast(by_class), F.col("class") == F.col("run_class"))
    own = F.element_at(F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), 1)
    found = found.withColumn("run", own).withColumn("sequence_id", F.col("run.first_sequence") + F.floor((F.col("rank") - F.col("run.low")) / F.col("run.each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint")
    return found.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
