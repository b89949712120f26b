"""Media columns: ISO media containers written, walked and read back by sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seedloom.llm.common import map_arrow

#: Bytes of one access unit: 192 unsigned 8-bit samples.
UNIT = 192
RATE = 8000
UNITS_PER_CHUNK = 32
KEY_EVERY = 16
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = 8 + len(body)
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + body
    return struct.pack(">I4sQ", 1, kind, size + 8) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def sample_tables(units: int, first: int) -> bytes:
    """The ``stbl`` box for equal units in chunks that lie one after another from ``first``."""
    chunks = -(-units // UNITS_PER_CHUNK)
    last = units - (chunks - 1) * UNITS_PER_CHUNK
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, UNITS_PER_CHUNK, 1)] if last == UNITS_PER_CHUNK else [(1, UNITS_PER_CHUNK, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    offsets = first + np.arange(chunks, dtype=np.int64) * UNITS_PER_CHUNK * UNIT
    keys = np.arange(1, units + 1, KEY_EVERY, dtype=">u4")
    return box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, units, UNIT)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", UNIT, units)),
        full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()),
    )


def write_container(payload: bytes) -> bytes:
    """An ISO media file that stores ``payload`` (a positive multiple of 192 bytes) as 8-bit samples.

    Raises ``ValueError`` for another length.
    """
    units, rest = divmod(len(payload), UNIT)
    if rest or not units:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        return box(
            b"moov",
            full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, len(payload)), struct.pack(">IHH", 1 << 16, 256, 0), bytes(8), matrix, bytes(24), struct.pack(">I", 2)),
            box(
                b"trak",
                full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 256, 0), matrix, bytes(8), flags=7),
                box(
                    b"mdia",
                    full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)),
                    full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
                    box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), sample_tables(units, first)),
                ),
            ),
        )

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(kind) + len(moov(0)) + head
    return kind + moov(first) + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: str = ""):
    """Yield ``(path, start, end)`` of every box body, outer boxes first."""
    end = len(data) if end is None else end
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box at {at} reaches beyond its parent")
        own = f"{path}/{kind.decode('latin-1')}"
        yield own, at + head, at + size
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + size, own)
        at += size


def read_track(data: memoryview, boxes: dict[str, tuple[int, int]]) -> dict:
    """Codec, timescale, duration, and byte ranges and start times of a track's samples, from its boxes by path."""
    stbl = "/moov/trak/mdia/minf/stbl"

    def table(name: str, kind: str, skip: int = 8) -> np.ndarray:
        start, end = boxes[f"{stbl}/{name}"]
        width = np.dtype(kind).itemsize
        return np.frombuffer(data[start + skip : end], kind, (end - start - skip) // width).astype(np.int64)

    def body(path: str) -> memoryview:
        start, end = boxes[path]
        return data[start:end]

    head = body("/moov/trak/mdia/mdhd")
    wide = head[0] == 1
    timescale, duration = struct.unpack_from(">IQ" if wide else ">II", head, 20 if wide else 12)
    codec = bytes(struct.unpack_from("4s", body(f"{stbl}/stsd"), 12)[0]).decode("latin-1")
    even, count = struct.unpack_from(">II", body(f"{stbl}/stsz"), 4)
    sizes = np.full(count, even, np.int64) if even else table("stsz", ">u4", 12)[:count]
    chunks = table("co64", ">u8") if f"{stbl}/co64" in boxes else table("stco", ">u4")
    runs = table("stsc", ">u4").reshape(-1, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    owner = np.repeat(np.arange(len(chunks)), per_chunk)[:count]
    before = np.cumsum(sizes) - sizes
    heads = np.cumsum(per_chunk) - per_chunk
    offsets = chunks[owner] + before - before[np.minimum(heads[owner], count - 1)] if count else np.zeros(0, np.int64)
    steps = table("stts", ">u4").reshape(-1, 2) if f"{stbl}/stts" in boxes else np.zeros((0, 2), np.int64)
    lasting = np.repeat(steps[:, 1], steps[:, 0])[:count]
    keys = table("stss", ">u4") - 1 if f"{stbl}/stss" in boxes else np.arange(count)
    samples = np.stack([offsets, sizes], 1)
    return {
        "codec": codec, "timescale": timescale, "duration": duration or int(lasting.sum()), "samples": samples,
        "keyframes": samples[keys], "keyframe_times": (np.cumsum(lasting) - lasting)[keys] if len(lasting) == count else np.zeros(0, np.int64),
    }


def tracks(media: bytes) -> list[dict]:
    """:func:`read_track` of every track that has sample tables, in file order; broken boxes raise ``ValueError``."""
    data = memoryview(media)
    boxes: list[dict[str, tuple[int, int]]] = []
    for path, start, end in walk(data):
        if path == "/moov/trak":
            boxes.append({})
        elif path.startswith("/moov/trak/"):
            boxes[-1].setdefault(path, (start, end))
    needed = {"/moov/trak/mdia/mdhd"} | {f"/moov/trak/mdia/minf/stbl/{x}" for x in ("stsd", "stsz", "stsc")}
    try:
        return [read_track(data, own) for own in boxes if needed <= set(own)]
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError(f"a sample table is broken: {e}") from e


def probe(media: bytes) -> dict:
    """Codec, duration, sample and keyframe byte ranges of a container's first track; no payload is decoded.

    Ranges are numpy arrays of ``(offset, size)``, ``keyframe_times`` counts in units of the timescale. Files without a
    track with sample tables give ``codec`` None and no ranges; broken boxes and tables raise ``ValueError``.
    """
    none = np.zeros((0, 2), np.int64)
    found = tracks(media)
    return found[0] if found else {"codec": None, "timescale": 0, "duration": 0, "samples": none, "keyframes": none, "keyframe_times": np.zeros(0, np.int64)}


def read_payload(media: bytes, samples: np.ndarray) -> bytes:
    """The stored sample bytes in order; neighbouring ranges are read at once."""
    if not len(samples):
        return b""
    ends = samples[:, 0] + samples[:, 1]
    breaks = np.flatnonzero(samples[1:, 0] != ends[:-1]) + 1
    first = np.append(0, breaks)
    last = np.append(breaks, len(samples)) - 1
    return b"".join(media[a:b] for a, b in zip(samples[first, 0].tolist(), ends[last].tolist()))


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text, and its bytes padded by spaces to a positive multiple of 192."""
    data = (text or "").encode()
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return len(data), data.ljust(size)


def text_to_media(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text (null: empty) in a container of its own.

    Repeated rows and null ids are kept as they are; other columns are not read.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        sizes, files = zip(*((n, write_container(p)) for n, p in map(padded, batch.column(1).to_pylist()))) if batch.num_rows else ((), ())
        return {"doc_id": batch.column(0), "n_bytes": list(sizes), "media": list(files)}

    source = documents.select(documents[id_col].cast("bigint").alias("doc_id"), documents[text_col].alias("text"))
    return map_arrow(source, rows, "doc_id bigint, n_bytes bigint, media binary", 500)


PROBED = (
    "n_tracks bigint, codec string, timescale bigint, duration bigint, n_samples bigint, n_keyframes bigint, "
    "keyframes array<struct<offset:bigint,size:bigint>>, keyframe_times array<bigint>, payload binary"
)


def probe_media(media: DataFrame, keep: str = "doc_id bigint, n_bytes bigint", media_col: str = "media", payload: bool = True) -> DataFrame:
    """Columns of :func:`probe` for a table with a media column, beside its ``keep`` columns, and the number of tracks.

    ``payload`` also reads the stored bytes. Null and broken media give null codec, no tracks and empty ranges.
    """
    names = [c.split()[0] for c in keep.split(", ")]

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.strip().split()[0]: [] for c in ("n_tracks", "codec", "timescale", "duration", "n_samples", "n_keyframes", "keyframes", "keyframe_times", "payload")}
        for data in batch.column(len(names)).to_pylist():
            try:
                every = tracks(data or b"")
            except ValueError:
                every = []
            found = every[0] if every else probe(b"")
            out["n_tracks"].append(len(every))
            out["codec"].append(found["codec"])
            out["timescale"].append(found["timescale"])
            out["duration"].append(found["duration"])
            out["n_samples"].append(len(found["samples"]))
            out["n_keyframes"].append(len(found["keyframes"]))
            out["keyframes"].append([{"offset": a, "size": b} for a, b in found["keyframes"].tolist()])
            out["keyframe_times"].append(found["keyframe_times"].tolist())
            out["payload"].append(read_payload(data or b"", found["samples"]) if payload else None)
        return out | {n: batch.column(i) for i, n in enumerate(names)}

    return map_arrow(media.select(*names, media_col), rows, f"{keep}, {PROBED}", 500)


DIGEST = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string, codec string, duration bigint, keyframes array<struct<offset:bigint,size:bigint>>"
)


def media_digest(media: DataFrame) -> DataFrame:
    """One digest row per container of :func:`text_to_media`, from the bytes read back by the sample tables.

    ``feature`` names codec, rate, duration in samples, the counts, and the CRC of the
    keyframe byte ranges; codec, duration and the ranges have columns too. Null media have no bytes, null hash and codec and no ranges.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in DIGEST.split(", ")}
        out["doc_id"], out["n_bytes"] = batch.column(0), batch.column(1)
        for data in batch.column(2).to_pylist():
            found = probe(data or b"")
            payload = read_payload(data or b"", found["samples"])
            ranges = zlib.crc32(found["keyframes"].astype("<i8").tobytes())
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(data or b""))
            out["media_sha256"].append(None if data is None else hashlib.sha256(data).hexdigest())
            out["feature"].append(f"{(found['codec'] or '').strip()}:{found['timescale']}:{found['duration']}:{len(found['samples'])}:{len(found['keyframes'])}:{ranges:08x}")
            out["codec"].append(found["codec"])
            out["duration"].append(found["duration"])
            out["keyframes"].append([{"offset": a, "size": b} for a, b in found["keyframes"].tolist()])
        return out

    return map_arrow(media.select("doc_id", "n_bytes", "media"), rows, DIGEST, 500)
