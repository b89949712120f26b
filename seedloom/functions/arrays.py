"""Score arrays, masks, pair grids and shifts as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

BASES = ("a", "c", "g", "t")
NEUTRAL_SCORE, NEUTRAL_PHYLOP, NEUTRAL_PHASTCONS = 0.5, 0.0, 0.5
PADDING_CLASS = 17
MIRNA_LENGTH, TARGET_LENGTH = 28, 50
#: Rows of a batch whose grids a worker holds as numbers at once.
GRID_ROWS = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used and inside whichever lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_score_array(text: Column) -> Column:
    """JSON list of numbers, NaN and null as ``array<double>`` with null for missing; null for missing tokens, infinities or other text."""

    def parsed(t: Column) -> Column:
        missing = F.lower(F.trim(t)).isin("", "na", "nan", "none", "null")
        clean = F.transform(F.from_json(t, "array<double>", {"allowNonNumericNumbers": "true"}), lambda x: F.when(~F.isnan(x), x))
        finite = lambda c: F.when(~F.coalesce(F.exists(c, lambda x: F.abs(x) == float("inf")), F.lit(False)), c)
        return F.when(~missing, once(clean, finite))

    return once(text, parsed)


def parse_vector_lenient(text: Column) -> Column:
    """Bracketed comma list of numbers; a part that isn't one becomes null."""
    inner = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", ""))

    def parsed(t: Column) -> Column:
        parts = F.transform(F.split(t, ","), lambda x: F.trim(x).try_cast("double"))
        return F.when(t == "", F.array().cast("array<double>")).otherwise(F.transform(parts, lambda x: F.when(~F.isnan(x), x)))

    return once(inner, parsed)


def parse_track_lenient(text: Column, kind: str, length: int = TARGET_LENGTH) -> Column:
    """A conservation track of ``length``; text that isn't a whole list of numbers gives the kind's defaults throughout.

    phyloP is divided by 10 and clipped to 1; missing and padded positions get the default.
    """
    default = NEUTRAL_PHYLOP if kind == "phylop" else NEUTRAL_PHASTCONS

    def track(parsed: Column) -> Column:
        bad = parsed.isNull() | F.coalesce(F.exists(parsed, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
        scaled = F.transform(parsed, lambda x: F.greatest(F.least(x / 10, F.lit(1.0)), F.lit(-1.0))) if kind == "phylop" else parsed
        filled = F.concat(F.slice(scaled, 1, length), F.array_repeat(F.lit(default), length))
        return F.slice(F.when(bad, F.array_repeat(F.lit(default), length)).otherwise(filled), 1, length)

    return once(F.from_json(text, "array<double>"), track)


def zip_score_quartet(a: Column, c: Column, g: Column, t: Column, length: int) -> Column:
    """Four arrays as ``length`` structs of A, C, G, T; positions beyond an array are null."""
    four = F.struct(*(x.alias(n) for n, x in zip("ACGT", (a, c, g, t))))
    return once(four, lambda f: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(*(F.get(f[n], i).alias(n) for n in "ACGT"))))


def fill_missing(values: Column, default: float) -> Column:
    """An array of doubles with nulls and NaNs filled."""
    return F.transform(values, lambda x: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(default)))


def missing_mask(values: Column) -> Column:
    """1 where an array's value is null or NaN, else 0."""
    return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x), 1).otherwise(0))


def reduce_scores(kind: str, actual: Column, a: Column, c: Column, g: Column, t: Column) -> Column:
    """One position's scores as an array.

    ``nucleotide`` keeps the four scores, 0.5 where missing. ``actual_margin`` is the actual
    base's score less the greatest of the others, 0 where a score or the base is missing;
    ``alt_mean`` is the mean of the others, 0.5 where missing.
    """
    scores = {"A": a, "C": c, "G": g, "T": t}
    missing = a.isNull() | c.isNull() | g.isNull() | t.isNull()
    if kind == "nucleotide":
        return F.when(missing, F.array_repeat(F.lit(NEUTRAL_SCORE), 4)).otherwise(F.array(a, c, g, t))
    if kind not in ("actual_margin", "alt_mean"):
        raise ValueError(f"unknown reduction {kind!r}")
    base = F.replace(F.upper(F.trim(actual)), F.lit("U"), F.lit("T"))
    found = F.lit(None).cast("double")
    for letter, own in scores.items():
        others = [s for x, s in scores.items() if x != letter]
        value = own - F.greatest(*others) if kind == "actual_margin" else (others[0] + others[1] + others[2]) / 3
        found = F.when(base == letter, value).otherwise(found)
    fill = 0.0 if kind == "actual_margin" else NEUTRAL_SCORE
    return F.array(F.when(missing, fill).otherwise(F.coalesce(found, F.lit(fill))))


def concat_missingness(channels: Column, mask: Column) -> Column:
    """Each position's channel array with its mask appended."""
    return F.zip_with(channels, mask, lambda x, m: F.concat(x, F.array(m.cast("double"))))


def shift_target(values: Column, k: int, fill) -> Column:
    """An array moved right by ``k`` (left if negative), with neutral fills in the gap."""
    n = F.size(values)
    gap = F.array_repeat(F.lit(fill), abs(k))
    moved = F.concat(gap, values) if k >= 0 else F.concat(F.slice(values, F.lit(1 - k), F.greatest(n + k, F.lit(0))), gap)
    return F.slice(moved, F.lit(1), n)


def shifted(values: Column, k: Column, fill: Column) -> Column:
    """An array moved right by a column ``k`` (left if negative), with ``fill`` in the gap."""
    n = F.size(values)
    return F.when(n == 0, values).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i - k >= 0) & (i - k < n), F.get(values, i - k)).otherwise(fill)))


def shifted_text(text: Column, k: Column, fill: str = "N") -> Column:
    """A sequence moved right by a column ``k`` (left if negative), its length kept, with the letter ``fill`` in the gap."""
    n = F.length(text)
    gap = F.repeat(F.lit(fill), F.least(F.abs(k), n))
    return F.when(k >= 0, F.concat(gap, F.substring(text, F.lit(1), F.greatest(n - k, F.lit(0))))).otherwise(F.concat(F.substring(text, 1 - k, n), gap))


def random_shift(seed: int, epoch: int, batch: Column, most: int) -> Column:
    """One shift between -most and most for a batch of an epoch, decided by the md5 of seed, epoch and batch."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), batch.cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % (2 * most + 1)).cast("int") - most


def standardize(values: Column, mean: Column, std: Column) -> Column:
    """``(x - mean) / std`` where a value is finite, else 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.transform(values, lambda x: F.when(finite(x), (x - mean) / std).otherwise(0.0))


def outer_interactions(left: Column, right: Column) -> Column:
    """Products of every pair of positions of two tracks, row by row."""
    return F.transform(left, lambda x: F.transform(right, lambda y: x * y))


@pandas_udf(DoubleType())
def outer_interaction_totals(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Sum over the products of every pair of positions of two tracks; the products of some rows at a time are held, and sent nowhere."""
    for left, right in batches:
        out = np.zeros(len(left))
        for at, x, y in _alike(left, right):
            out[at] = (x[:, :, None] * y[:, None, :]).sum((1, 2))
        yield pd.Series(out)


def _slices(n: int, rows: int) -> Iterator[slice]:
    return (slice(at, at + rows) for at in range(0, n, rows))


def _alike(left: pd.Series, right: pd.Series, rows: int = GRID_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of up to ``rows`` rows whose two arrays (nested ones too) have the same shapes, and both as one block each."""
    left, right = [_block(v) for v in left], [_block(v) for v in right]
    shapes: dict[tuple, list[int]] = {}
    for i, (x, y) in enumerate(zip(left, right)):
        shapes.setdefault((x.shape, y.shape), []).append(i)
    for own in shapes.values():
        for part in _slices(len(own), rows):
            yield np.array(own[part]), np.stack([left[i] for i in own[part]]), np.stack([right[i] for i in own[part]])


def _block(value) -> np.ndarray:
    """An array column's value as numbers: one track, or tracks of equal length."""
    return np.stack(value) if len(value) and isinstance(value[0], (np.ndarray, list)) else np.asarray(value, float)


def broadcast_channels(track: Column, rows: int) -> Column:
    """A target track repeated for each of ``rows`` miRNA positions."""
    return F.array_repeat(track, rows)


def vector_summary(values: Column) -> dict[str, Column]:
    """mean, std (population), min, max, median, quartiles by linear interpolation, finite share and an empty flag."""
    ordered = F.sort_array(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))

    def summary(finite: Column) -> Column:
        n = F.size(finite)
        mean = F.when(n > 0, F.aggregate(finite, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
        # The mean is computed before it goes into the squares, not again for each of them.
        spread = once(mean, lambda m: F.struct(m.alias("mean"), F.aggregate(finite, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)).alias("squares")))

        def quantile(q: float) -> Column:
            at = (n - 1) * F.lit(q)
            low = F.get(finite, F.floor(at).cast("int"))
            high = F.get(finite, F.ceil(at).cast("int"))
            return F.when(n > 0, low + (high - low) * (at - F.floor(at))).otherwise(0.0)

        return once(spread, lambda s: F.struct(
            s["mean"].alias("mean"),
            F.when(n > 0, F.sqrt(s["squares"] / n)).otherwise(0.0).alias("std"),
            F.when(n > 0, F.get(finite, F.lit(0))).otherwise(0.0).alias("min"),
            F.when(n > 0, F.get(finite, n - 1)).otherwise(0.0).alias("max"),
            quantile(0.5).alias("median"),
            quantile(0.25).alias("q25"),
            quantile(0.75).alias("q75"),
            F.when(F.size(values) > 0, n / F.size(values)).otherwise(0.0).alias("finite_fraction"),
            (n == 0).cast("double").alias("empty_indicator"),
        ))

    whole = once(ordered, summary)
    return {n: whole[n] for n in ("mean", "std", "min", "max", "median", "q25", "q75", "finite_fraction", "empty_indicator")}


def _pair_codes(values: pd.Series, length: int) -> np.ndarray:
    # Not by ``.str``, which keeps its Series in a cycle: batches would stay until the next garbage collection.
    chars = np.array([x.upper() for x in values.fillna("")], f"U{length}").view(np.uint32).reshape(len(values), length)
    codes = np.full(chars.shape, -1, np.int16)
    for letters, code in (("A", 0), ("TU", 1), ("C", 2), ("G", 3)):
        for letter in letters:
            codes[chars == ord(letter)] = code
    return codes


@pandas_udf(BinaryType())
def encode_pair_grid(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A 28 by 50 grid of ``(mirna, gene)``, one byte a cell: 4 x miRNA base + target base in the order A, T, C, G; 17 where either is none."""
    for mirna, gene in batches:
        m, t = _pair_codes(mirna, MIRNA_LENGTH).astype(np.int8), _pair_codes(gene, TARGET_LENGTH).astype(np.int8)
        out = []
        for part in _slices(len(m), GRID_ROWS):
            x, y = m[part, :, None], t[part, None, :]
            out += [g.tobytes() for g in np.where((x >= 0) & (y >= 0), 4 * x + y, np.int8(PADDING_CLASS)).view(np.uint8)]
        yield pd.Series(out)


@pandas_udf(ArrayType(IntegerType()))
def grid_class_histogram(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Cells of each of the 18 classes in a grid."""
    for grids in batches:
        yield pd.Series([np.bincount(np.frombuffer(g, np.uint8), minlength=18)[:18] for g in grids])


@pandas_udf(StructType([StructField(n, ArrayType(IntegerType())) for n in ("mirna", "target")]))
def decode_pair_grid(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Base codes on both axes of a grid, -1 where an axis position has no valid cell."""
    for grids in batches:
        axes: dict[str, list] = {"mirna": [], "target": []}
        for part in _slices(len(grids), GRID_ROWS):
            cells = np.frombuffer(b"".join(grids.iloc[part]), np.int8).reshape(-1, MIRNA_LENGTH, TARGET_LENGTH)
            valid = cells < 16
            for name, axis, base in (("mirna", 2, cells >> 2), ("target", 1, cells & 3)):
                axes[name] += list(np.where(valid, base, np.int8(-1)).max(axis).astype(np.int32))
        yield pd.DataFrame(axes)


@pandas_udf(ArrayType(IntegerType()))
def rc_pair_features(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Sums of 20 channels over the grid of a miRNA and the reverse complement of the padded target.

    Channels: 16 base pairs in the order A, C, G, T, then Watson-Crick, G-T wobble, valid, seed 2-8.
    """
    order = {0: 0, 2: 1, 3: 2, 1: 3}
    for mirna, gene in batches:
        m, t = _pair_codes(mirna, MIRNA_LENGTH), _pair_codes(gene, TARGET_LENGTH)
        swap = np.array([1, 0, 3, 2, -1], np.int16)  # complement in the grid's codes; -1 picks the last
        t = swap[t][:, ::-1]
        counts = np.zeros((len(m), 20), np.int64)
        for i, a in order.items():
            for j, b in order.items():
                counts[:, 4 * a + b] = (m == i).sum(1) * (t == j).sum(1)
        counts[:, 16] = counts[:, [3, 6, 9, 12]].sum(1)
        counts[:, 17] = counts[:, [11, 14]].sum(1)
        counts[:, 18] = counts[:, :16].sum(1)
        counts[:, 19] = (m[:, 1:8] >= 0).sum(1) * (t >= 0).sum(1)
        yield pd.Series(list(counts.astype(np.int32)))


#: Channels of a pair feature grid after the 16 base pairs, which are named by miRNA and target base in the order A, C, G, T.
PAIR_CHANNELS = (*(a + b for a in "ACGT" for b in "ACGT"), "watson_crick", "wobble", "valid", "seed")
#: Bits of a cell: the low four are its pair, the others a plane each.
CELL_BITS = {"watson_crick": 32, "wobble": 64, "valid": 16, "seed": 128}


def _acgt(values: pd.Series, length: int) -> np.ndarray:
    codes = _pair_codes(values, length)
    return np.where(codes >= 0, np.array([0, 3, 1, 2, -1], np.int16)[codes], -1)


@pandas_udf(BinaryType())
def rc_pair_grid(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The 20 channels of a miRNA and the reverse complement of the padded target over their 28 by 50 cells, a byte a cell.

    Low four bits: the pair, 4 x miRNA base + target base in the order A, C, G, T. Bit planes: valid (both are bases),
    Watson-Crick, G-T wobble, and seed (valid and miRNA position 2 to 8). Cells that aren't valid are 0.
    """
    place = np.arange(MIRNA_LENGTH)
    seed = ((place >= 1) & (place < 8))[None, :, None]
    for mirna, gene in batches:
        m, t = _acgt(mirna, MIRNA_LENGTH)[:, :, None], _acgt(gene, TARGET_LENGTH)[:, ::-1]
        t = np.where(t >= 0, 3 - t, -1)[:, None, :]
        out = []
        for part in _slices(len(m), GRID_ROWS):
            x, y = m[part], t[part]
            valid = (x >= 0) & (y >= 0)
            wobble = (x == 2) & (y == 3) | (x == 3) & (y == 2)
            out += [g.tobytes() for g in np.where(valid, 4 * x + y + 16 + 32 * (x + y == 3) + 64 * wobble + 128 * seed, 0).astype(np.uint8)]
        yield pd.Series(out)


def _plane(cells: np.ndarray, channel: int) -> np.ndarray:
    name = PAIR_CHANNELS[channel]
    return (cells & CELL_BITS[name] > 0) if name in CELL_BITS else (cells & 31) == 16 + channel


@pandas_udf(ArrayType(LongType()))
def plane_checksums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of each of the 20 planes of a pair feature grid, the sum of the places of its cells, counted from 1 by rows."""
    weights = np.arange(1, MIRNA_LENGTH * TARGET_LENGTH + 1, dtype=np.int64)
    for grids in batches:
        out = []
        for part in _slices(len(grids), GRID_ROWS):
            cells = np.frombuffer(b"".join(grids.iloc[part]), np.uint8).reshape(-1, len(weights))
            out += list(np.stack([_plane(cells, c) @ weights for c in range(len(PAIR_CHANNELS))], 1))
        yield pd.Series(out)


def grid_plane(channel: str):
    """A function of a pair feature grid that gives one channel as 1400 bytes of 0 and 1."""
    at = PAIR_CHANNELS.index(channel)

    @pandas_udf(BinaryType())
    def plane(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for grids in batches:
            yield pd.Series([_plane(np.frombuffer(g, np.uint8), at).astype(np.uint8).tobytes() for g in grids])

    return plane


@pandas_udf(BinaryType())
def axis_grid(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Tracks of both axes over the cells of a pair as one block of 4-byte floats, a plane after the other.

    First the miRNA tracks, each value along its row, then the target tracks along their columns, then
    the products of every miRNA track with every target track. The arguments are arrays of tracks.
    """
    for mirna, target in batches:
        out: list = [None] * len(mirna)
        for at, m, t in _alike(mirna, target):
            for i, block in zip(at, _axis_blocks(m, t)):
                out[i] = block.tobytes()
        yield pd.Series(out)


def _axis_blocks(m: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Planes of some rows' tracks, ``(rows, planes, miRNA positions, target positions)`` of 4-byte floats."""
    m, t = m.astype("<f4"), t.astype("<f4")
    shape = (len(m), m.shape[2], t.shape[2])
    planes = [np.broadcast_to(m[:, a, :, None], shape) for a in range(m.shape[1])] + [np.broadcast_to(t[:, b, None, :], shape) for b in range(t.shape[1])]
    return np.stack(planes + [m[:, a, :, None] * t[:, b, None, :] for a in range(m.shape[1]) for b in range(t.shape[1])], 1)


def _plane_sums(grid: bytes, cells: int, rows: int) -> np.ndarray:
    """Of each plane of ``rows`` grids, the sum of values times their places, counted from 1."""
    return np.frombuffer(grid, "<f4").reshape(rows, -1, cells).astype(float) @ np.arange(1, cells + 1, dtype=float)


@pandas_udf(ArrayType(DoubleType()))
def axis_grid_checksums(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Checksums of each plane of the grids of :func:`axis_grid`, read back from their bytes where they are made: grids of 45 kB a row are held for some rows at a time."""
    for mirna, target in batches:
        out: list = [None] * len(mirna)
        for at, m, t in _alike(mirna, target):
            for i, sums in zip(at, _plane_sums(_axis_blocks(m, t).tobytes(), m.shape[2] * t.shape[2], len(at))):
                out[i] = sums
        yield pd.Series(out)


def axis_plane_checksums(cells: int):
    """A function of an axis grid of planes of ``cells`` cells: of each plane, the sum of values times their places, counted from 1."""

    @pandas_udf(ArrayType(DoubleType()))
    def checksums(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for grids in batches:
            yield pd.Series([_plane_sums(g, cells, 1)[0] for g in grids])

    return checksums
