"""Quality rules: word and repetition counts, and zstandard compression bands."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import ASCII_SPACE, map_arrow

#: Bounds where no labelled documents tell better: rows of (documents below so many bytes, least ratio, greatest ratio); the ratio is
#: bytes over compressed bytes. Short frames carry a header, so their bounds are lower. Each lower bound
#: lies between the ratios of prose and of random base64 text of the row's least length.
BANDS = (
    (128, 0.9, 3.0),
    (160, 0.98, 3.0),
    (200, 1.04, 3.0),
    (256, 1.1, 3.0),
    (512, 1.15, 3.0),
    (1024, 1.25, 3.2),
    (2048, 1.4, 3.5),
    (4096, 1.5, 4.0),
    (float("inf"), 1.55, 4.5),
)
CHUNK_BYTES = 4096
#: Chunks of what is left below CHUNK_BYTES. Lengths at which a row of BANDS starts tell noise best.
SHORT_CHUNKS = (1024, 256)
#: The band of a whole chunk of CHUNK_BYTES, and the share of a text's bytes in chunks outside their bands at which it is rejected.
CHUNK_BAND = (1.5, 4.0)
CHUNK_SHARE = 0.25
LEVEL = 3
#: About so many documents labelled as good fit the bands, the documented bound of that sample; a class of lengths needs so many of them.
SAMPLE, LEAST_SAMPLE = 20_000, 20
#: Bands reach from this quantile of good documents to its mirror, and so much farther on both sides.
QUANTILE, MARGIN = 0.002, 0.04
#: Bytes of the chunks that are compressed one by one all through a text: their ratio tells words of a language from words of random characters, which repeat no less in a whole text.
FINE_BYTES = 256
#: Classes of lengths to a doubling.
CLASSES = 2

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_bytes bigint, ratio double, n_chunks bigint, n_bad_chunks bigint, "
    "base_failed boolean, band_failed boolean, kept boolean"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    marked = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = 1
    return sum(marked)


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(ASCII_SPACE))
        seen.add(line)
    return again


def base_failed(n_words: int, repeats: int) -> bool:
    return n_words < 50 or 100 * repeats > 50 * n_words


def length_class(n_bytes: int) -> int:
    """The number of a length's class; classes grow by the same factor."""
    return math.floor(CLASSES * math.log2(n_bytes))


def band_of(n_bytes: int, bands=BANDS) -> tuple[float, float]:
    """The bounds of the ratio for a length."""
    return next((low, high) for below, low, high in bands if n_bytes < below)


@dataclass(frozen=True)
class Bands:
    """Bounds of ratios fitted to good documents: by class of length for whole texts, by size for chunks. Others take ``BANDS`` and ``CHUNK_BAND``."""

    whole: dict[int, tuple[float, float]] = field(default_factory=dict)
    chunks: dict[int, tuple[float, float]] = field(default_factory=dict)
    #: Of all chunks of ``FINE_BYTES`` together, by class of length of the text.
    fine: dict[int, tuple[float, float]] = field(default_factory=dict)

    def of_fine(self, n_bytes: int) -> tuple[float, float]:
        """Wide open where no good documents of such a length have been seen."""
        return self.fine.get(min(length_class(n_bytes), max(self.fine, default=0)), (0.0, math.inf))

    def of_text(self, n_bytes: int, bands=BANDS) -> tuple[float, float]:
        found = self.whole.get(length_class(n_bytes))
        if found is None and self.whole and length_class(n_bytes) > max(self.whole):
            # Longer texts compress no worse than the longest that were seen.
            return self.whole[max(self.whole)][0], band_of(n_bytes, bands)[1]
        return band_of(n_bytes, bands) if found is None else found

    def of_chunk(self, n_bytes: int, chunk_bytes: int, chunk_band, bands=BANDS) -> tuple[float, float]:
        return self.chunks.get(n_bytes) or (chunk_band if n_bytes == chunk_bytes else band_of(n_bytes, bands))


def chunks_of(data: bytes, chunk_bytes: int = CHUNK_BYTES) -> list[tuple[int, bytes]]:
    """Chunks that cover every byte of a text, each with the number of bytes that it speaks for.

    The last bytes are judged with those before them, as a smallest chunk that ends with the text.
    """
    found, at = [], 0
    sizes = [chunk_bytes, *(n for n in SHORT_CHUNKS if n < chunk_bytes)]
    while at < len(data):
        size = next((n for n in sizes if at + n <= len(data)), 0)
        found.append((size or len(data) - at, data[at : at + size] if size else data[-sizes[-1] :]))
        at += size or len(data) - at
    return found


def fine_ratio(data: bytes, compressor: zstandard.ZstdCompressor, size: int = FINE_BYTES) -> float:
    """Bytes over compressed bytes of all whole chunks of ``size`` bytes together; 0 for shorter texts."""
    packed = sum(len(compressor.compress(data[at : at + size])) for at in range(0, len(data) - size + 1, size))
    return len(data) // size * size / packed if packed else 0.0


def band_verdict(data: bytes, compressor: zstandard.ZstdCompressor, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE, fitted: Bands | None = None):
    """``(ratio, chunks, chunks outside the band, passed)`` of one text; with ``fitted`` its small chunks together must lie in a band too."""
    if not data:
        return 0.0, 0, 0, True
    fine = fine_ratio(data, compressor) if fitted and fitted.fine and len(data) >= FINE_BYTES else None
    fitted = fitted or Bands()
    ratio = len(data) / len(compressor.compress(data))
    low, high = fitted.of_text(len(data), bands)
    chunks = bad = bad_bytes = 0
    for covered, chunk in chunks_of(data, chunk_bytes):
        least, most = fitted.of_chunk(len(chunk), chunk_bytes, chunk_band, bands)
        chunks += 1
        if not least <= len(chunk) / len(compressor.compress(chunk)) <= most:
            bad += 1
            bad_bytes += covered
    even = fine is None or fitted.of_fine(len(data))[0] <= fine <= fitted.of_fine(len(data))[1]
    return ratio, chunks, bad, low <= ratio <= high and bad_bytes <= chunk_share * len(data) and even


def between(values: list[float], quantile: float, margin: float) -> tuple[float, float]:
    """Bounds about most of ``values``, with a margin."""
    return float(np.quantile(values, quantile)) * (1 - margin), float(np.quantile(values, 1 - quantile)) * (1 + margin)


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL, quantile: float = QUANTILE, margin: float = MARGIN) -> Bands:
    """Bands of the ratios of documents that ``labels`` (``doc_id, quality``) calls good and that pass the base rules.

    About ``sample`` of them are drawn by a hash of their ids, and no more than twice that; the driver gets a few numbers of each. Classes of
    lengths and sizes of chunks with fewer than ``LEAST_SAMPLE`` of them have no bands of their own.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("good_id")).distinct()
    draw = F.pmod(F.xxhash64("good_id", F.lit("bands")), F.lit(1 << 30)) / float(1 << 30)
    drawn = good.where(draw < sample / max(1, good.count())).orderBy(F.xxhash64("good_id", F.lit("bands")), "good_id").limit(2 * sample)

    def measured(batch: pa.RecordBatch) -> dict:
        compressor = zstandard.ZstdCompressor(level=level)
        rows = []
        for text in batch.column(0).to_pylist():
            data = (text or "").encode()
            words = data.split()
            if not data or base_failed(len(words), repeated_words(words)):
                continue
            ends: dict[int, list[float]] = {}
            for _, chunk in chunks_of(data, chunk_bytes):
                ratio = len(chunk) / len(compressor.compress(chunk))
                own = ends.setdefault(len(chunk), [ratio, ratio])
                own[:] = min(own[0], ratio), max(own[1], ratio)
            rows.append((len(data), len(data) / len(compressor.compress(data)), fine_ratio(data, compressor), list(ends), [e[0] for e in ends.values()], [e[1] for e in ends.values()]))
        return dict(zip(("n_bytes", "ratio", "fine", "sizes", "least", "most"), map(list, zip(*rows)) if rows else ([], [], [], [], [], [])))

    # At most 2 x sample ids.
    texts = documents.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(drawn), F.col("_id") == F.col("good_id")).select("_text")
    found = map_arrow(texts, measured, "n_bytes bigint, ratio double, fine double, sizes array<int>, least array<double>, most array<double>").limit(4 * sample).collect()
    whole: dict[int, list[float]] = {}
    fine: dict[int, list[float]] = {}
    chunks: dict[int, tuple[list[float], list[float]]] = {}
    for r in found:
        whole.setdefault(length_class(r["n_bytes"]), []).append(r["ratio"])
        if r["fine"]:
            fine.setdefault(length_class(r["n_bytes"]), []).append(r["fine"])
        for size, least, most in zip(r["sizes"], r["least"], r["most"]):
            low, high = chunks.setdefault(size, ([], []))
            low.append(least)
            high.append(most)
    fitted = {size: (between(low, quantile, margin)[0], between(high, quantile, margin)[1]) for size, (low, high) in chunks.items() if len(low) >= LEAST_SAMPLE and size in (chunk_bytes, *SHORT_CHUNKS)}
    by_class = lambda held: {k: between(v, quantile, margin) for k, v in held.items() if len(v) >= LEAST_SAMPLE}
    return Bands(by_class(whole), fitted, by_class(fine))


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE, level: int = LEVEL, fitted: Bands | None = None) -> DataFrame:
    """Counts and verdict of every text; one map over the table, no shuffle.

    A text passes the base rules with at least 50 words of which at most half lie in
    repeated 3-word windows. It passes the compression bands if its zstandard ratio lies
    between the bounds for its length and at most ``chunk_share`` of its bytes lie in chunks
    outside their bands: above is repetitive, below is noise. Chunks cover every byte: first
    of ``chunk_bytes``, with ``chunk_band``, then of 1024 and of 256 bytes, and what is left,
    judged by the last 256 bytes of the text; these take the bounds in ``bands`` for their lengths. Where ``fitted``
    (see :func:`train`) has a band for a length or a size of chunks, that one holds, and all chunks of 256 bytes together have a band
    by the text's length.

    Null and empty texts have no words, ratio 0 and fail the base rules. Repeated rows
    each get a row, null ids are kept, and other columns of the input are not read.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        compressor = zstandard.ZstdCompressor(level=level)
        out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            text = text or ""
            data = text.encode()
            words = data.split()
            repeats = repeated_words(words)
            failed = base_failed(len(words), repeats)
            ratio, chunks, bad, passed = band_verdict(data, compressor, bands, chunk_bytes, chunk_band, chunk_share, fitted)
            for name, value in (
                ("n_words", len(words)),
                ("word_chars", len(text) - sum(map(text.count, ASCII_SPACE))),
                ("n_symbols", sum(map(text.count, "#*$%&|<>"))),
                ("n_dup_lines", duplicate_lines(text)),
                ("n_repeat_words", repeats),
                ("n_bytes", len(data)),
                ("ratio", ratio),
                ("n_chunks", chunks),
                ("n_bad_chunks", bad),
                ("base_failed", failed),
                ("band_failed", not passed),
                ("kept", not failed and passed),
            ):
                out[name].append(value)
        return out

    source = documents.select(documents[id_col].cast("bigint").alias("doc_id"), documents[text_col].alias("text"))
    return map_arrow(source, rows, SCHEMA)
