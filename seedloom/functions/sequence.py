"""Sequence text as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

# Fixed values: (name, first, end) of miRNA segments, counted from 0.
EXACT_SEGMENTS = (("mirna_1_7", 0, 7), ("mirna_1_8", 0, 8), ("mirna_2_9", 1, 9), ("mirna_2_10", 1, 10))
WINDOW_SEGMENTS = (("seed_2_7", 1, 7), ("seed_2_8", 1, 8), ("seed_1_8", 0, 8), ("extended_2_13", 1, 13), ("central_9_16", 8, 16), ("supplementary_13_22", 12, 22))
WINDOW_FEATURES = (
    "segment_valid", "max_wc_frac", "max_wobble_frac", "max_pair_frac", "max_score_frac", "max_contiguous_wc_frac", "max_contiguous_pair_frac",
    "top3_score_frac_mean", "windows_score_ge_0p75_frac", "windows_score_ge_0p85_frac", "best_start_norm", "best_center_distance_frac",
)


def _dna(seq: Column) -> Column:
    return F.replace(F.upper(seq), F.lit("U"), F.lit("T"))


def normalize_strict(seq: Column) -> Column:
    """Trimmed upper-case DNA; null where it is empty or holds a letter outside ACGTN."""
    clean = _dna(F.trim(seq))
    return F.when(clean.rlike("^[ACGTN]+$"), clean)


def normalize_padded(seq: Column, length: int) -> Column:
    """DNA with other letters as N, cut or right-padded with N to ``length``; null as empty."""
    return F.rpad(F.regexp_replace(F.coalesce(_dna(seq), F.lit("")), "[^ACGT]", "N"), length, "N")


def sanitize_dna(seq: Column) -> Column:
    """DNA with other letters as N; null as empty."""
    return F.coalesce(F.regexp_replace(_dna(seq), "[^ACGT]", "N"), F.lit(""))


def sanitize_rna(seq: Column) -> Column:
    """RNA with other letters as N; null and empty as N."""
    clean = F.translate(sanitize_dna(seq), "T", "U")
    return F.when(clean == "", "N").otherwise(clean)


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of the sanitized sequence; N stays N."""
    return F.reverse(F.translate(sanitize_dna(seq), "ACGT", "TGCA"))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C; 0 for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, (n - F.length(F.regexp_replace(seq, "[GC]", ""))) / n).otherwise(0.0)


def count_overlapping(text: Column, pattern: Column) -> Column:
    """Occurrences of ``pattern`` in ``text``, overlapping ones too; 0 for an empty pattern."""
    ahead = F.concat(F.lit(r"(?=\Q"), pattern, F.lit(r"\E)"))
    return F.when(F.length(pattern) > 0, F.regexp_count(text, ahead)).otherwise(0)


def segment_rc_count(gene: Column, mirna: Column, first: int, end: int) -> Column:
    """Occurrences of the reverse complement of a whole miRNA segment in the target; 0 if short or with N."""
    segment = F.substring(mirna, first + 1, end - first)
    usable = (F.length(segment) == end - first) & ~segment.contains("N")
    return F.when(usable, count_overlapping(gene, reverse_complement(segment))).otherwise(0)


def seed_counts(gene: Column, mirna: Column) -> dict[str, Column]:
    """Reverse complement counts of miRNA positions 2-7 and 2-8."""
    return {"seed6": segment_rc_count(gene, mirna, 1, 7), "seed7": segment_rc_count(gene, mirna, 1, 8)}


def exact_rc_counts(gene: Column, mirna: Column) -> dict[str, Column]:
    """Reverse complement counts of the four longer segments."""
    return {name: segment_rc_count(gene, mirna, first, end) for name, first, end in EXACT_SEGMENTS}


def seed_max_match(gene: Column, mirna: Column) -> Column:
    """Length of the longest part, up to 7, of the seed's reverse complement that the target holds."""
    seed = reverse_complement(F.substring(mirna, 2, 7))
    found = F.lit(0)
    for k in range(1, 8):
        found = F.when((F.length(seed) >= k) & F.exists(_starts(seed, k), _held(gene, seed, k)), k).otherwise(found)
    return found


def _starts(seq: Column, k: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(seq) - k + 1, F.lit(1)))


def _held(gene: Column, seq: Column, k: int):
    return lambda i: gene.contains(F.substring(seq, i, F.lit(k)))


def longest_true_run(flags: Column) -> Column:
    """Longest run of true in a boolean array."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        now = F.when(x, a["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["best"], now).alias("best"))

    return F.aggregate(flags, start, step, lambda a: a["best"])


def base_codes(seq: Column, length: int) -> Column:
    """``length`` codes: A 0, C 1, G 2, T and U 3, others and padding 4."""
    padded = F.rpad(F.substring(F.upper(seq), 1, length), length, "N")
    return F.transform(F.split(padded, ""), lambda c: F.when(c == "A", 0).when(c == "C", 1).when(c == "G", 2).when(c.isin("T", "U"), 3).otherwise(4))


def pair_base_codes(seq: Column, length: int) -> Column:
    """``length`` codes in the pair grid's order: A 0, T and U 1, C 2, G 3, others and padding -1."""
    padded = F.rpad(F.substring(F.upper(seq), 1, length), length, "N")
    return F.transform(F.split(padded, ""), lambda c: F.when(c == "A", 0).when(c.isin("T", "U"), 1).when(c == "C", 2).when(c == "G", 3).otherwise(-1))


def _letters(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Codes A 0, C 1, G 2, T 3, others 4 of equal-width rows, and the lengths."""
    text = values.fillna("").tolist()
    lengths = np.fromiter(map(len, text), np.int64, len(text))
    width = max(1, int(lengths.max(initial=1)))
    chars = np.array(text, f"U{width}").view(np.uint32).reshape(len(text), width)
    codes = np.full(chars.shape, 4, np.int8)
    for code, letter in enumerate("ACGT"):
        codes[chars == ord(letter)] = code
    return codes, lengths


def window_table(genes: pd.Series, mirnas: pd.Series) -> np.ndarray:
    """The 12 features of each of the 6 segments, ``(rows, 72)``, over all target windows at once.

    Target offset k pairs with segment base ``length - 1 - k``. Watson-Crick pairs score 1,
    G with T one half; the first best window counts. Constants 49 and 25 scale the best start and
    the distance of its centre whatever the target's length.
    """
    gene, gene_len = _letters(genes)
    mirna, mirna_len = _letters(mirnas)
    out = np.zeros((len(gene_len), len(WINDOW_SEGMENTS) * len(WINDOW_FEATURES)))
    pair = np.zeros((5, 5), np.int8)
    pair[0, 3] = pair[3, 0] = pair[1, 2] = pair[2, 1] = 1
    pair[2, 3] = pair[3, 2] = 2
    for s, (_, first, end) in enumerate(WINDOW_SEGMENTS):
        size = end - first
        if gene.shape[1] < size or mirna.shape[1] < end:
            continue
        rows = np.flatnonzero((mirna_len >= end) & (gene_len >= size))
        if not len(rows):
            continue
        windows = np.lib.stride_tricks.sliding_window_view(gene[rows], size, axis=1)
        kinds = pair[mirna[rows, first:end][:, ::-1][:, None, :], windows]
        live = np.arange(windows.shape[1])[None, :] <= (gene_len[rows] - size)[:, None]
        wc, wobble = ((kinds == k).sum(2) * live for k in (1, 2))
        score = np.where(live, wc + 0.5 * wobble, -1.0)
        best = score.argmax(1)
        runs = []
        for flags in (kinds == 1, kinds > 0):
            now = np.zeros(live.shape, np.int64)
            longest = np.zeros(live.shape, np.int64)
            for k in range(size):
                now = np.where(flags[:, :, k], now + 1, 0)
                longest = np.maximum(longest, now)
            runs.append((longest * live).max(1))
        count = live.sum(1)
        top = -np.sort(-score, 1)[:, :3]
        share = np.where(live, score / size, -1.0)
        table = [
            np.ones(len(rows)), wc.max(1) / size, wobble.max(1) / size, (wc + wobble).max(1) / size, score.max(1) / size, runs[0] / size, runs[1] / size,
            np.where(top >= 0, top / size, 0).sum(1) / np.minimum(count, 3), (share >= 0.75).sum(1) / count, (share >= 0.85).sum(1) / count,
            best / 49.0, np.abs(best + (size - 1) / 2 - (gene_len[rows] - 1) / 2) / 25.0,
        ]
        out[rows, s * len(WINDOW_FEATURES) : (s + 1) * len(WINDOW_FEATURES)] = np.stack(table, 1)
    return out


@pandas_udf(ArrayType(DoubleType()))
def window_alignment(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """72 alignment features of sanitized ``(gene, mirna)`` columns; a segment that doesn't fit has zeros."""
    for gene, mirna in batches:
        yield pd.Series(list(window_table(gene, mirna)))
