"""Line dedup by two Bloom filters and an exact confirmation of suspected repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seedloom.llm.common import cuts, map_arrow, scratch

MIN_CHARS = 40
MIN_DOCS = 5
#: Filter bits for each line of the corpus, and the bounds of a filter's size: 2^28 bits
#: are the 32 MB that every worker holds. Beyond that filters fill up and let more lines
#: through to the exact step, none less.
BITS_PER_LINE = 8
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
SLICE_BITS = 1 << 18
#: Hashes that a task holds before it hands its part of the filters on.
FLUSH = 4_000_000
#: Repeated keys up to this number reach every worker (24 bytes each); more meet the documents' keys in a join.
BROADCAST_KEYS = 1_000_000
#: A keeper below all ids: that of a key whose documents have none.
NO_ID = np.iinfo(np.int64).min


def line_key(line: bytes) -> bytes:
    """The line with ASCII white space stripped at both ends and A-Z lower-cased."""
    return line.strip().lower()


def long_keys(text: str | None, min_chars: int) -> list[bytes]:
    """Keys of at least ``min_chars`` code points, one per line that has such a key."""
    if not text or len(text) < min_chars:
        return []
    found = []
    for line in text.encode().lower().split(b"\n"):
        key = line.strip()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            found.append(key)
    return found


def bit_pair(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions for each hash; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask], 1).astype(np.int64)


def seen_bits(documents: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """``slice, once, twice``: set positions of each task's filters for once-seen and twice-seen lines."""

    def parts(hashes: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        unique, counts = np.unique(hashes, return_counts=True)
        once = np.unique(bit_pair(unique, bits))
        twice = np.unique(bit_pair(unique[counts > 1], bits))
        for s in np.unique(once // SLICE_BITS).tolist():
            own = [x[np.searchsorted(x, s * SLICE_BITS) : np.searchsorted(x, (s + 1) * SLICE_BITS)] - s * SLICE_BITS for x in (once, twice)]
            yield s, own[0].astype("<u4").tobytes(), own[1].astype("<u4").tobytes()

    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[int]) -> pa.RecordBatch:
            rows = list(parts(np.array(held, np.uint64)))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        held: list[int] = []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.extend(map(xxhash.xxh3_64_intdigest, set(long_keys(text, min_chars))))
                if len(held) > FLUSH:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return documents.select("text").mapInArrow(run, "slice int, once binary, twice binary")


def merge_bits(parts: DataFrame, bits: int) -> DataFrame:
    """``slice, twice``: the packed twice-seen filter of all tasks.

    A position counts as twice seen if one task saw it twice or two tasks saw it once,
    whatever the order in which their parts arrive.
    """
    schema = pa.schema([("slice", pa.int32()), ("twice", pa.binary())])
    width = min(bits, SLICE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = held.setdefault(s, (np.zeros(width, bool), np.zeros(width, bool)))
                positions = np.frombuffer(once, "<u4")
                b[positions[a[positions]]] = True
                b[np.frombuffer(twice, "<u4")] = True
                a[positions] = True
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([np.packbits(held[s][1]).tobytes() for s in keys], pa.binary())], schema=schema)

    return parts.repartition("slice").mapInArrow(run, "slice int, twice binary")


def filter_size(lines: int) -> int:
    """Bits of a filter for so many lines: a power of two within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(lines * BITS_PER_LINE - 1, 1).bit_length()))


def twice_filter(documents: DataFrame, min_chars: int, bits: int | None = None) -> np.ndarray:
    """The twice-seen filter as packed bits, at most 32 MB whatever the corpus."""
    if bits is None:
        lines = documents.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
        bits = filter_size(lines)
    packed = np.zeros(bits // 8, np.uint8)
    for row in merge_bits(seen_bits(documents, bits, min_chars), bits).toLocalIterator():
        packed[row.slice * SLICE_BITS // 8 :][: min(bits, SLICE_BITS) // 8] = np.frombuffer(row.twice, np.uint8)
    return packed


def suspected(source: DataFrame, packed: np.ndarray, min_chars: int) -> DataFrame:
    """``digest, doc_id, row_key``: 128-bit digests of each row's keys that the filter holds."""
    shared = source.sparkSession.sparkContext.broadcast(packed)
    bits = len(packed) * 8

    def rows(batch: pa.RecordBatch) -> dict:
        found = shared.value
        keys, owners = [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            own = set(long_keys(text, min_chars))
            keys.extend(own)
            owners.extend([i] * len(own))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        at = bit_pair(hashes, bits)
        hit = ((found[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
        which = np.flatnonzero(hit)
        take = pa.array(np.array(owners, np.int64)[which])
        return {"digest": [xxhash.xxh3_128_digest(keys[i]) for i in which.tolist()], "doc_id": batch.column(0).take(take), "row_key": batch.column(1).take(take)}

    return map_arrow(source.select("doc_id", row_key(), "text"), rows, "digest binary, doc_id bigint, row_key bigint")


def row_key() -> Column:
    """64 bits that name a row by id and text; rows that share them are repeats and lose the same lines."""
    return F.xxhash64("doc_id", "text").alias("row_key")


def repeated_keys(source: DataFrame, min_chars: int, min_docs: int, filter_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``digest, doc_id, row_key`` of suspects, and ``digest, keeper`` of the keys that at least ``min_docs`` documents hold."""
    packed = twice_filter(source, min_chars, filter_bits)
    # Written once: it is counted and perhaps joined. Repeated rows of a document count once.
    suspects = scratch(suspected(source, packed, min_chars))
    counted = suspects.groupBy("digest", "doc_id").agg(F.lit(1).alias("one")).groupBy("digest")
    repeated = counted.agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs).drop("n_docs")
    return suspects, scratch(repeated)


class Lost:
    """The keys that a document loses, by its id: those of ``digest, keeper`` rows whose keeper is another."""

    def __init__(self, digests: list[bytes], keepers: list[int | None]) -> None:
        halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.halves = halves[order]
        self.keepers = np.array([NO_ID if k is None else k for k in keepers], np.int64)[order]

    def of(self, doc_id: int | None, digests: list[bytes]) -> set[bytes]:
        own = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        first, last = (np.searchsorted(self.halves[:, 0], own[:, 0], side) for side in ("left", "right"))
        other = NO_ID if doc_id is None else doc_id
        return {digests[i] for i in np.flatnonzero(last > first).tolist() for j in range(first[i], last[i]) if self.halves[j, 1] == own[i, 1] and self.keepers[j] != other}


def without_lines(text: str | None, lost: Callable[[list[bytes]], set[bytes]], min_chars: int) -> tuple[int, int, str]:
    """Number of lines, of dropped ones, and the text of those that stay; ``lost`` tells which of the digests of long lines go."""
    lines = (text or "").encode().split(b"\n")
    long = [(i, xxhash.xxh3_128_digest(line_key(x))) for i, x in enumerate(lines) if len(x) >= min_chars]
    gone = lost([d for _, d in long]) if long else set()
    if not gone:
        return len(lines), 0, text or ""
    dropped = {i for i, d in long if d in gone}
    return len(lines), len(dropped), b"\n".join(x for i, x in enumerate(lines) if i not in dropped).decode()


def map_lines(documents: DataFrame, fn: Callable, schema: str | StructType, min_chars: int, min_docs: int, filter_bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``mapInArrow`` of ``fn(batch, found)`` over ``documents``, with ``found`` the ``without_lines`` of each row of a slice.

    ``documents`` has ``doc_id`` and ``text``. The few repeated keys go to all workers, no text is shuffled;
    where they are more than ``broadcast_keys``, rows meet the digests that they lose in a join.
    """
    narrow = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    suspects, repeated = repeated_keys(narrow, min_chars, min_docs, filter_bits)
    names = documents.columns
    at_id, at_text = names.index("doc_id"), names.index("text")
    if repeated.count() <= broadcast_keys:
        table = repeated.toPandas()
        shared = documents.sparkSession.sparkContext.broadcast((list(map(bytes, table["digest"])), [None if k != k or k is None else int(k) for k in table["keeper"].astype(object)]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lost = Lost(*shared.value)
            for batch in batches:
                for at, n in cuts(batch, 1000, 16_000_000):
                    part = batch.slice(at, n)
                    pairs = zip(part.column(at_id).to_pylist(), part.column(at_text).to_pylist())
                    yield fn(part, [without_lines(t, lambda digests, d=d: lost.of(d, digests), min_chars) for d, t in pairs])

        return documents.mapInArrow(run, schema)
    gone = suspects.join(repeated, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("row_key").alias("__row_key")).agg(F.collect_set("digest").alias("__digests"))
    joined = documents.join(gone, F.xxhash64(F.col("doc_id").cast("bigint"), "text") == F.col("__row_key"), "left").select(*(F.col(f"`{c}`") for c in names), "__digests")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in cuts(batch, 1000, 16_000_000):
                part = batch.slice(at, n)
                rows = zip(part.column(at_text).to_pylist(), part.column(len(names)).to_pylist())
                found = [without_lines(t, lambda digests, d=d: set(d or ()).intersection(digests), min_chars) for t, d in rows]
                yield fn(pa.RecordBatch.from_arrays(part.columns[: len(names)], names=names), found)

    return joined.mapInArrow(run_joined, schema)


def dedup_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` of every document.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all
    their lines but those of the largest doc_id that holds them; the rest stays in order.

    Each task fills one Bloom filter with lines it saw once and one with lines it saw
    twice; slices of them are merged in parallel into the filter of lines seen twice
    anywhere. Only documents' keys in that filter are shuffled, as 128-bit digests, to be
    counted exactly, so filter errors cost traffic and no result. Lines that stay keep
    their bytes. The confirmed keys go to the documents; only beyond ``broadcast_keys`` of them are texts joined.

    Null and empty texts are one empty line. All null doc_ids count as one document, the
    smallest. Rows with the same doc_id count as one document, and each gets its row.
    ``filter_bits`` (a power of two of at least 2^18) overrides the size chosen from the number of lines.
    An empty table gives an empty result; other columns are not read.
    """
    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_lines", "n_dropped", "kept_text"]

    def rows(batch: pa.RecordBatch, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds))], names=names)

    return map_lines(source, rows, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string", min_chars, min_docs, filter_bits, broadcast_keys)


def dedup_documents(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``documents`` with repeated lines left out of ``text`` and ``n_chars`` counted again.

    Rules as in :func:`dedup_lines`; documents that lose nothing, null texts among them, stay as they are.
    """
    columns = documents.columns

    def rows(batch: pa.RecordBatch, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        text, size = columns.index("text"), columns.index("n_chars")
        arrays = list(batch.columns)
        texts, sizes = arrays[text].to_pylist(), arrays[size].to_pylist()
        for i, (_, dropped, kept) in enumerate(found):
            if dropped:
                texts[i], sizes[i] = kept, len(kept)
        arrays[text], arrays[size] = pa.array(texts, arrays[text].type), pa.array(sizes, arrays[size].type)
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_lines(documents, rows, documents.schema, min_chars, min_docs, broadcast_keys=broadcast_keys)


#: DuckDB SQL for the query's rows.
DEDUP_SQL = r"""
with lines as (
  select doc_id, row, i, line, lower_ascii as key from (
    select doc_id, row, unnest(range(len(parts))) as i, unnest(parts) as line,
      translate(regexp_replace(unnest(parts), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii
    from (select doc_id, row_number() over () as row, string_split(coalesce(text, ''), chr(10)) as parts from documents))
), repeated as (
  select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), marked as (
  select l.*, r.key is not null and l.doc_id <> r.keeper as dropped from lines l left join repeated r on l.key = r.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id, row
"""
