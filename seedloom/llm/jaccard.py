"""N-gram Jaccard join by PartEnum signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import cuts, map_arrow, scratch
from seedloom.llm.graph import components

WORDS = 5
PERCENT = 80
#: Sizes of one band lie within this factor.
BAND = 1.5
#: Second-level partitions in a first-level group, of which one may differ.
PARTS = 3
SEEDS = 6
#: Signatures go to buckets of about so many bytes, which one worker holds at a time.
BUCKET_BYTES = 16_000_000
#: Signatures that a worker holds before it packs them.
HELD = 1_000_000
#: A signature of more documents in one pack is common: its rows are dealt out instead of going to its bucket.
COMMON = 64
#: Documents and shingles in a block; a worker holds two.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
#: Keys of texts up to this number are broadcast (at most 40 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``n``-word shingles; A-Z count as a-z.

    A text of fewer words has its whole word sequence as one; null or wordless texts have none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - n + 1
    total = hashes[:count].copy()
    for i in range(1, n):
        total = mix(total) + hashes[i : i + count]
    return np.unique(mix(total))


def bands(largest: int) -> list[tuple[int, int]]:
    """Bands of set sizes from 1 on, each from ``low`` to ``high``, up to the one with ``largest``."""
    found = [(1, 1)]
    while found[-1][1] < largest:
        low = found[-1][1] + 1
        found.append((low, max(low, int(low * BAND))))
    return found


@np.errstate(over="ignore")
def signatures(shingles: np.ndarray, percent: int, table: list[tuple[int, int]]) -> np.ndarray:
    """Signatures that a set shares with every set of at least ``percent`` / 100 Jaccard.

    Sets that similar, the smaller of size at most r, differ in at most k = r (100 - percent) / percent
    elements. They meet in the band of the smaller, so a set signs for its own band and for
    those of sizes down to its size times percent / 100. For a band the domain is split
    into g groups of three partitions, g one half of k and some spare: then more groups
    than the spare hold at most one difference, and in these some two of the three
    partitions agree. Each subset of two partitions of a group is a signature.

    Subsets without elements would be shared by all; they are left out, and a set with more
    such groups than the spare signs again under the next seed, where it meets those like it.
    """
    size = len(shingles)
    if not size:
        return np.zeros(0, np.uint64)
    found = []
    least = -(-size * percent // 100)
    for b, (low, high) in enumerate(table):
        if high < least:
            continue
        if low > size:
            break
        k = high * (100 - percent) // percent
        if k == 0:
            found.append(np.array([shingles.sum(dtype=np.uint64) + np.uint64(size) * ODD[1] + np.uint64(b)], np.uint64))
            continue
        spare = 1 + k // 16
        groups = k // 2 + 1 + spare
        for seed in range(SEEDS):
            scattered = mix(shingles * ODD[seed] + np.uint64(seed))
            part = ((scattered >> np.uint64(33)) % np.uint64(groups * PARTS)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            counts = np.bincount(part, minlength=groups * PARTS)
            np.cumsum(mix(scattered + ODD[2])[order], out=scattered)
            edges = np.concatenate(([0], np.cumsum(counts)))
            total = np.concatenate((np.zeros(1, np.uint64), scattered))[edges]
            sums = np.diff(total).reshape(groups, PARTS)
            counts = counts.reshape(groups, PARTS)
            label = (np.arange(groups, dtype=np.uint64) * np.uint64(4 * SEEDS) + np.uint64(4 * seed)) * ODD[3] + np.uint64(b) * ODD[4]
            void = np.zeros(groups, bool)
            for i in range(PARTS):
                x, y = (i + 1) % PARTS, (i + 2) % PARTS
                some = counts[:, x] + counts[:, y] > 0
                void |= ~some
                whole = mix(sums[:, x] * ODD[1] + np.uint64(1)) + mix(sums[:, y] * ODD[5] + np.uint64(2))
                signed = mix(whole + mix(label + np.uint64(i)))
                found.append(signed if seed == SEEDS - 1 else signed[some])
            if void.sum() <= spare:
                break
    return np.concatenate(found)


def node_of(shingles: np.ndarray) -> int:
    """The name of a set: 64 bits of a hash of its shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def text_key() -> Column:
    """With the doc_id it names a row's text; rows that share both are repeats."""
    return F.xxhash64("text").alias("text_key")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall in each of about half as many bins, a power of two of them; counts stop at 255."""
    bins = max(8, 1 << (max(len(shingles), 1) - 1).bit_length() >> 1)
    return np.minimum(np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8)


def folded(counts: np.ndarray, bins: int) -> np.ndarray:
    """The sketch over fewer bins."""
    return counts.astype(np.int16 if bins > len(counts) // 64 else np.int64).reshape(-1, bins).sum(0) if len(counts) > bins else counts.astype(np.int16)


def near(sizes: np.ndarray, sketches: list[np.ndarray], labels: np.ndarray, left: list[int], right: list[int], percent: int) -> np.ndarray:
    """Which members have one of another label on the other side that their sketches don't tell from an alike set.

    Sketches differ by no more than the sets do, unless counts stopped: sets of at least ``percent`` / 100 Jaccard differ in
    at most (100 - percent) / (100 + percent) of the sum of their sizes.
    """
    found = np.zeros(len(sizes), bool)
    widths = np.array([len(x) for x in sketches])
    for bins in np.unique(widths).tolist():
        # Pairs whose shorter sketch has so many bins; longer ones are folded.
        wide = [j for j in right if widths[j] >= bins]
        table = np.stack([folded(sketches[j], bins) for j in wide]) if wide else np.zeros((0, bins), np.int16)
        wide = np.array(wide, np.int64)
        for i in left:
            if widths[i] < bins:
                continue
            ok = (labels[wide] != labels[i]) & (100 * np.minimum(sizes[wide], sizes[i]) >= percent * np.maximum(sizes[wide], sizes[i]))
            if widths[i] > bins:
                ok &= widths[wide] == bins
            at = np.flatnonzero(ok)
            if len(at):
                apart = np.abs(table[at].astype(np.int32) - folded(sketches[i], bins).astype(np.int32)).sum(1)
                hit = wide[at[apart * (100 + percent) <= (100 - percent) * (sizes[wide[at]] + sizes[i])]]
                found[hit] = True
                found[i] |= len(hit) > 0
    return found


def describe(source: DataFrame, n: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, sketch`` of every row of ``doc_id, text``; node and sketch are null without shingles."""

    def rows(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, n) for t in batch.column(2).to_pylist()]
        return {
            "doc_id": batch.column(0), "text_key": batch.column(1), "n_shingles": [len(s) for s in sets],
            "node": [node_of(s) if len(s) else None for s in sets], "sketch": [sketch(s).tobytes() if len(s) else None for s in sets],
        }

    return map_arrow(source.select("doc_id", text_key(), "text"), rows, "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, sketch binary")


def distinct_pairs(signs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of signatures, the start of each signature's run, and the runs' lengths."""
    order = np.lexsort((nodes, signs))
    signs, nodes = signs[order], nodes[order]
    new = np.ones(len(signs), bool)
    new[1:] = (signs[1:] != signs[:-1]) | (nodes[1:] != nodes[:-1])
    signs, nodes = signs[new], nodes[new]
    starts = np.flatnonzero(np.concatenate(([True], signs[1:] != signs[:-1]))) if len(signs) else np.zeros(0, np.int64)
    return signs, nodes, starts, np.diff(np.append(starts, len(signs)))


@np.errstate(over="ignore")
def groups_of(signs: np.ndarray, nodes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``keys, nodes``: members of the groups of nodes that share a signature.

    A signature in ``common`` has a key of its own, for its other members come from
    elsewhere. Other groups are whole; their key is made of the members, so that equal groups fall together.
    """
    signs, nodes, starts, sizes = distinct_pairs(signs, nodes)
    if not len(signs):
        return np.zeros(0, np.uint64), nodes
    shared = np.isin(signs[starts], common)
    own = mix(np.add.reduceat(mix(nodes.view(np.uint64)), starts) + sizes.astype(np.uint64) * ODD[5])
    _, first = np.unique(own, return_index=True)
    once = np.zeros(len(starts), bool)
    once[first] = True
    keep = shared | (once & (sizes > 1))
    keys = np.where(shared, mix(signs[starts] + ODD[0]), own)
    return np.repeat(keys, sizes)[np.repeat(keep, sizes)], nodes[np.repeat(keep, sizes)]


def candidate_groups(source: DataFrame, n: int, percent: int, largest: int, n_buckets: int) -> DataFrame:
    """``key, node``: groups of at least two nodes that share a signature; equal groups are one.

    Signatures are packed by bucket before they are shuffled, and a bucket is what one
    worker holds. Rows of a signature that is common in a pack don't go to its bucket but
    are dealt out under the signature's key; the bucket is told, so that the signature's
    rows from other packs get that key too.
    """
    table = bands(largest)
    schema = pa.schema([("bucket", pa.int32()), ("signs", pa.binary()), ("nodes", pa.binary()), ("common", pa.binary())])
    out = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def pack(signs: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        every, owner, starts, sizes = distinct_pairs(np.concatenate(signs), np.repeat(np.array(nodes, np.int64), [len(s) for s in signs]))
        often = every[starts[sizes > COMMON]]
        dealt = np.repeat(sizes > COMMON, sizes)
        rows = [(-1, every[dealt].tobytes(), owner[dealt].tobytes(), b"")] if len(often) else []
        every, owner = every[~dealt], owner[~dealt]
        bucket, of_often = ((mix(x) % np.uint64(n_buckets)).astype(np.int64) for x in (every, often))
        order = np.argsort(bucket, kind="stable")
        every, owner, often = every[order], owner[order], often[np.argsort(of_often, kind="stable")]
        cut, cut_often = (np.searchsorted(np.sort(x), np.arange(n_buckets + 1)).tolist() for x in (bucket, of_often))
        for b in range(n_buckets):
            (x, y), (i, j) = cut[b : b + 2], cut_often[b : b + 2]
            if y > x or j > i:
                rows.append((b, every[x:y].tobytes(), owner[x:y].tobytes(), often[i:j].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, nodes, held = [], [], 0
        for batch in batches:
            for at, count in cuts(batch, 1000, 16_000_000):
                for text in batch.column(0).slice(at, count).to_pylist():
                    own = shingle_set(text, n)
                    if len(own):
                        signs.append(signatures(own, percent, table))
                        nodes.append(node_of(own))
                        held += len(signs[-1])
                        if held > HELD:
                            yield pack(signs, nodes)
                            signs, nodes, held = [], [], 0
        if signs:
            yield pack(signs, nodes)

    def members(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes)], schema=out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])

        def done() -> pa.RecordBatch:
            signs, nodes, common = (np.frombuffer(b"".join(x), kind) for x, kind in zip(held, (np.uint64, np.int64, np.uint64)))
            return members(*groups_of(signs, nodes, common))

        for batch in batches:
            for bucket, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    signs = np.frombuffer(parts[0], np.uint64)
                    yield members(*groups_of(signs, np.frombuffer(parts[1], np.int64), signs))
                    continue
                if bucket != now and held[0]:
                    yield done()
                    held = ([], [], [])
                now = bucket
                for x, part in zip(held, parts):
                    x.append(part)
        if held[0]:
            yield done()

    signed = source.select("text").mapInArrow(sign, "bucket int, signs binary, nodes binary, common binary")
    # Common signatures' rows need not meet: they are dealt out by a hash of what they hold.
    dealt = signed.withColumn("deal", F.when(F.col("bucket") >= 0, F.xxhash64("bucket")).otherwise(F.xxhash64("nodes")))
    met = dealt.repartition(n_buckets, "deal").sortWithinPartitions("bucket").select("bucket", "signs", "nodes", "common").mapInArrow(meet, "key bigint, node bigint")
    return met.distinct()


def candidates(described: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, size, sketch, text_key, doc_id`` of each of ``nodes``, the last two those of one row that has the set."""
    rows = described.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("text_key", "doc_id", F.col("n_shingles").cast("int").alias("size"), "sketch")).alias("row"))
    return rows.select("node", "row.size", "row.sketch", "row.text_key", "row.doc_id")


def shingle_table(source: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, shingles``: the packed shingles of the set of each row of ``wanted`` (``text_key, doc_id``)."""
    wanted = scratch(wanted.select(F.col("text_key").alias("of_key"), F.col("doc_id").alias("of_id")))
    few = wanted.count() <= BROADCAST_ROWS
    keyed = source.select("doc_id", text_key(), "text")
    texts = keyed.join(F.broadcast(wanted) if few else wanted, (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("text")

    def rows(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, n) for t in batch.column(0).to_pylist()]
        return {"node": [node_of(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    # A row with a wanted row's key has its text, bar the odd collision, which only adds a node that nobody asks for.
    return map_arrow(texts, rows, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least ``percent`` / 100 Jaccard."""
    if len(a) < len(b):
        a, b = b, a
    if 100 * len(b) < percent * len(a):
        return False
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (``u, v``) whose nodes link."""
    left = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = left.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").select("u", "v", "a", "b")
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, count in cuts(batch, 1000, 16_000_000):
                part = batch.slice(at, count)
                linked = pa.array([alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(i).filter(linked) for i in (0, 1)], schema=out)

    return both.mapInArrow(run, "u bigint, v bigint")


def forest(labels: list[int], sets: list[np.ndarray], left: list[int], right: list[int], percent: int) -> list[tuple[int, int]]:
    """Links of at least ``percent`` / 100 between sets of ``left`` and ``right``, as a spanning forest over their labels."""
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(sets) == 2:
        return [(labels[0], labels[1])] if labels[0] != labels[1] and alike(sets[0], sets[1], percent) else []
    sizes, own = np.array([len(s) for s in sets], np.int64), np.array(labels, np.int64)
    every = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.array(right, np.int64), sizes[right])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    edges = []
    for i in left:
        low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        linked = np.flatnonzero((shared > 0) & (own != own[i]) & (100 * shared >= percent * (sizes[i] + sizes - shared)))
        for j in linked.tolist():
            a, b = root(labels[i]), root(labels[j])
            if a != b:
                parent[a] = b
                edges.append((labels[i], labels[j]))
    return edges


def blocks_of_hubs(members: DataFrame, large: DataFrame, payload: DataFrame, columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(hub, left, right, columns)`` for each pair of blocks of a hub's ``hub, node, label`` members.

    ``payload`` has ``columns`` by node; ``left`` and ``right`` are places in the lists that ``fn`` gets, and its result is
    rows of ``schema``. Hubs in ``large`` (``of_hub, blocks``) are dealt into blocks, so that a worker holds two blocks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    placed = members.join(large, F.col("hub") == F.col("of_hub"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(payload.select("node", *(c for c in columns if c not in ("node", "label"))), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("hub", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *columns)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def results(now: tuple, blocks: list[int], values: list[list]) -> list[tuple]:
        hub, low, high = now
        left = [i for i, b in enumerate(blocks) if b == low]
        right = left if low == high else [i for i, b in enumerate(blocks) if b == high]
        return fn(hub, left, right, *values) if left and right and len(blocks) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], f.type) for i, f in enumerate(out)], schema=out)

        now, held, found = None, [[] for _ in range(1 + len(columns))], []
        for batch in batches:
            for hub, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, low, high) != now:
                    if now:
                        found += results(now, held[0], held[1:])
                    now, held = (hub, low, high), [[] for _ in range(1 + len(columns))]
                for x, value in zip(held, row):
                    x.append(value)
            if found:
                yield made()
                found = []
        if now:
            found = results(now, held[0], held[1:])
            yield made()

    return dealt.repartition("hub", "low", "high").sortWithinPartitions("hub", "low", "high").mapInArrow(run, schema)


def renamed(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` after ``edges`` between components join some of them."""
    edges = scratch(edges)
    if edges.isEmpty():
        return found
    joined = scratch(components(edges).toDF("of", "to"))
    moved = found.join(joined, F.col("component") == F.col("of"), "left").select("node", F.coalesce("to", "component").alias("component"))
    new = joined.join(found.select("node"), F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("to").alias("component"))
    return scratch(moved.unionByName(new))


def linked_components(groups: DataFrame, table: DataFrame, shingles_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``node, component`` of all nodes that link with another, by links between nodes that share a group.

    ``table`` has ``node, size, sketch`` and ``shingles_of`` gives ``node, shingles`` for some of its rows.
    A group's hub is its least node; groups of one hub are taken together. Where they are more than a
    block, each member first meets the hub alone. A hub whose members are then in one component is
    settled, for other links among them change nothing. Of the others' members all pairs in different
    components are compared, by sketches and, where these can't tell, by sets, so no link is missed.
    """
    hubs = scratch(groups.groupBy("key").agg(F.min("node").alias("hub")))
    members = scratch(groups.join(hubs, "key").select("hub", "node").distinct())
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    large = scratch(members.join(table.select("node", "size"), "node").groupBy(F.col("hub").alias("of_hub")).agg(blocks.alias("blocks")).where("blocks > 1"))
    found, named = None, members.withColumn("label", F.col("node"))
    if not large.isEmpty():
        first = scratch(members.join(large, F.col("hub") == F.col("of_hub"), "left_semi"))
        sets = scratch(shingles_of(table.join(first.select("node"), "node", "left_semi")))
        found = scratch(components(verified(first.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")), sets, percent)))
        named = scratch(members.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("hub", "node", F.coalesce("component", "node").alias("label")))
        settled = named.groupBy(F.col("hub").alias("of_hub")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high").select("of_hub")
        named = named.join(scratch(settled), F.col("hub") == F.col("of_hub"), "left_anti")

    def like(hub: int, left: list[int], right: list[int], nodes: list[int], labels: list[int], sizes: list[int], sketches: list[bytes]) -> list[tuple]:
        close = near(np.array(sizes, np.int64), [np.frombuffer(x, np.uint8) for x in sketches], np.array(labels, np.int64), left, right, percent)
        return [(hub, nodes[i], labels[i]) for i in np.flatnonzero(close).tolist()]

    def links(hub: int, left: list[int], right: list[int], labels: list[int], packed: list[bytes]) -> list[tuple]:
        return forest(labels, [np.frombuffer(x, np.uint64) for x in packed], left, right, percent)

    close = scratch(blocks_of_hubs(named, large, table, ["node", "label", "size", "sketch"], like, "hub bigint, node bigint, label bigint").distinct())
    sets = scratch(shingles_of(table.join(close.select("node"), "node", "left_semi")))
    edges = blocks_of_hubs(close, large, sets, ["label", "shingles"], links, "u bigint, v bigint")
    return scratch(components(edges)) if found is None else renamed(found, edges)


def labelled(source: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, label, component_id`` of every row of ``doc_id, text``; the label is null without shingles."""
    described = scratch(describe(source, n))
    total, largest = described.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.coalesce(F.max("n_shingles"), F.lit(1))).first()
    share = 16 * 2.9 * (100 - percent) / percent  # bytes of signatures for a shingle
    n_buckets = max(64, int(total * share / BUCKET_BYTES) + 1)
    groups = scratch(candidate_groups(source, n, percent, max(largest, 1), n_buckets))
    table = scratch(candidates(described, groups.select("node").distinct()))
    found = linked_components(groups, table, lambda rows: shingle_table(source, rows, n), percent)

    firsts = scratch(described.where("node is not null").groupBy(F.col("node").alias("of_node")).agg(F.min("doc_id").alias("first")))
    inside = scratch(found.join(firsts, F.col("node") == F.col("of_node")).select("node", "component", "first"))
    least = inside.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("least"))
    names = inside.join(least, F.col("component") == F.col("of")).select("node", "component", "least")
    named = firsts.join(names, F.col("of_node") == F.col("node"), "left").select("of_node", F.coalesce("component", "of_node").alias("label"), F.coalesce("least", "first").alias("least"))
    joined = described.join(named, F.col("node") == F.col("of_node"), "left")
    return joined.select("doc_id", "text_key", "n_shingles", "label", F.coalesce("least", "doc_id").alias("component_id"))


def similar_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Two documents link when 100 |A ∩ B| >= percent |A ∪ B| for their sets of ``n``-word
    shingles; the component is the smallest doc_id that links reach, itself included. No
    link is lost: every pair of linked sets shares a signature, and pairs that share one are
    compared exactly unless other links have joined them.

    Equal sets are one node from the start, whatever their number and ids; sets and shingles
    are named by 64 bits of hashes. Signatures are packed before they are shuffled, and
    those of many documents are spread over tasks. Sets of candidates are read by a broadcast
    of their rows' keys up to ``BROADCAST_ROWS``, beyond that by a shuffled join.

    Null and wordless texts have no shingles, link with nothing and are their own component.
    Rows with null ids link like others and have the smallest id of their component, null if none has one.
    Rows of one id with different texts are different documents, each with its row; the component's smallest id is
    then that of any of them. Repeated rows link like other equal texts. An empty table gives an empty result; other columns are not read.
    """
    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return labelled(source, n, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(documents: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` without those that another row of their component stands for.

    The row with the smallest doc_id stays, null ids last; of different texts under that id the
    one with the least hash, of repeats of a row one. Texts without shingles stay.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = labelled(source, n, percent).where("label is not null").groupBy("label", "doc_id", "text_key").agg(F.count("*").alias("times"))
    rows = scratch(rows)
    best = rows.groupBy(F.col("label").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    marked = rows.join(best, F.col("label") == F.col("of")).select(F.col("doc_id").alias("__of_id"), F.col("text_key").alias("__of_key"), (~is_best).alias("lost"), "times")
    marked = scratch(marked.where("lost or times > 1"))
    lost, twice = (marked.where(x).select("__of_id", "__of_key") for x in ("lost", "not lost"))
    match = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__of_id")) & (F.xxhash64("text") == F.col("__of_key"))
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost
    kept = documents.join(lost, match, "left_anti")
    if twice.isEmpty():
        return kept
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    again = kept.join(twice, match, "left_semi").groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key")).agg(F.min(F.struct(*columns)).alias("__row"))
    return kept.join(twice, match, "left_anti").unionByName(again.select("__row.*"))
