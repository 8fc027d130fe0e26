"""SimHash near-duplicates by bit-sliced comparison.

Every text gets a 64-bit fingerprint. Distinct fingerprints are then dealt by
key: the 64 bits are cut into blocks, and two fingerprints that differ in at
most ``radius`` bits agree on at least (blocks - radius) whole blocks, so
every pair to be linked meets under some choice of blocks. How many blocks
there are follows the number of fingerprints; any number finds every link.

Fingerprints that meet are stored as bit planes. A plane XORed with a query's
bit gives one bit of difference for 64 fingerprints a word; carry-save
counters add them up, and a tile is abandoned once no lane is within the
radius. Keys with very many fingerprints are cut into parts, and pairs of
parts become tasks of their own. Only a spanning star of each connected set
leaves a tile, never all its pairs; the stars are joined to components by
large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import release, stage, staged_so_far

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
FULL = (1 << BITS) - 1
#: Shingles hashed at a time, so that long texts need no more memory.
CHUNK = 1 << 15
#: Fingerprints of one key compared in one task; keys with more are tiled.
PART = 8192
#: Tiles of fewer fingerprints are compared together, up to so many.
TOGETHER = 512
#: Queries compared with a tile's planes at a time.
QUERIES = 256
#: Fingerprints expected under one key, by which the blocks are chosen.
PER_KEY = 64
#: Edges of a node from which its key is broadcast, at least, and how many
#: such nodes the edges have room for, at most half of them.
HUB_EDGES, HUBS = 1 << 16, 1 << 15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of a text's shingles, unsigned; 0 without words.

    A-Z are lower-cased; words are runs of bytes other than ASCII white
    space; with fewer words than a shingle has, all are one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    flat = b" ".join(found)
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps[words - 1 :].tolist(), len(flat)]
    digest, counts = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for i in range(0, len(ends), CHUNK):
        h = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- bit planes


def planes_of(fps: np.ndarray) -> np.ndarray:
    """[64, words] planes: bit i of plane b is bit b of fingerprint i."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, BITS), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_lanes(queries: np.ndarray, planes: np.ndarray, lanes: int, radius: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Queries that have near lanes, and the [query, words] bits of those lanes.

    Counters hold one bit of every lane's distance each; a lane that passes
    the radius is marked in ``far`` for good, and a query is abandoned once
    all its lanes are far. ``own``: the lane of the first query, if the
    queries are lanes themselves; these lanes don't count.
    """
    width = radius.bit_length()
    shape = (len(queries), planes.shape[1])
    rows = np.arange(len(queries))
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]
    far = np.zeros(shape, np.uint64)
    if lanes % 64:
        far[:, -1] = np.uint64(FULL ^ ((1 << lanes % 64) - 1))
    if own is not None:
        at = own + rows
        far[rows, at // 64] |= np.uint64(1) << (at % 64).astype(np.uint64)
    full, over = np.uint64(FULL), radius + 1
    for b in range(BITS):
        flip = np.where((queries >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None]
        carry = planes[b] ^ flip
        for c in counters:
            c_and = c & carry
            c ^= carry
            carry = c_and
        far |= carry
        if over < 1 << width:  # lanes whose counter stands at radius + 1
            reached = counters[0] if over & 1 else ~counters[0]
            for k in range(1, width):
                reached = reached & (counters[k] if over >> k & 1 else ~counters[k])
            far |= reached
        if b >= 12 and b % 4 == 3:
            live = (far != full).any(axis=1)
            if not live.any():
                return rows[:0], far[:0]
            if 2 * live.sum() <= len(rows):
                rows, queries, far = rows[live], queries[live], far[live]
                counters = [c[live] for c in counters]
    live = (far != full).any(axis=1)
    return rows[live], ~far[live]


def star_edges(fps: np.ndarray, nodes: np.ndarray, split: int | None, radius: int) -> list[tuple[int, int]]:
    """(smallest node, other node) within each set of linked fingerprints.

    With ``split``, only pairs across that position are compared.
    """
    left = slice(0, len(fps) if split is None else split)
    right = slice(0 if split is None else split, len(fps))
    planes, lanes = planes_of(fps[right]), len(fps) - right.start
    label = np.arange(len(fps))

    def top(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for q in range(0, left.stop, QUERIES):
        block = fps[q : min(q + QUERIES, left.stop)]
        for i, near in zip(*near_lanes(block, planes, lanes, radius, q if split is None else None)):
            row = np.unpackbits(near.view(np.uint8), bitorder="little")[:lanes]
            others = np.flatnonzero(row) + right.start
            while not (label[label[others]] == label[others]).all():
                label[others] = label[label[others]]
            heads = np.unique(label[others])
            root = min(top(int(q + i)), int(heads[0]))
            label[heads] = root
            label[top(int(q + i))] = root
    while not (label[label] == label).all():
        label = label[label]
    out = []
    order = np.argsort(label, kind="stable")
    bounds = np.flatnonzero(np.diff(label[order])) + 1
    for members in np.split(order, bounds):
        if len(members) > 1:
            ids = nodes[members]
            first = int(ids.min())
            out += [(first, int(x)) for x in ids if x != first]
    return out


# ---------------------------------------------------------------- candidates


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """Number of blocks so that a key of agreeing blocks holds PER_KEY or so."""
    for blocks in range(radius + 1, radius + 5):
        if count >> (BITS * (blocks - radius) // blocks) <= PER_KEY:
            return blocks
    return radius + 4


def block_keys(fp: Column, blocks: int, radius: int = RADIUS) -> Column:
    """Array of (choice, key): the bits of each choice of agreeing blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for n, choice in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*out)


def links(nodes: DataFrame, radius: int = RADIUS, part: int = PART, blocks: int | None = None) -> DataFrame:
    """Star edges (a < b) that connect ``nodes(fp, node)`` within ``radius`` bits."""
    blocks = blocks or blocks_for(nodes.count(), radius)
    keyed = nodes.select("fp", "node", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("k")).select("fp", "node", "k.choice", "k.key")
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = (
        keyed.join(stage(sizes, "simhash-keys"), ["choice", "key"])
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("choice", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp", "node")
    )
    order = ["choice", "key", "x", "y", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((7, 0), np.int64)
        for cols in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols.columns])
            rows = np.concatenate([held, rows], axis=1)
            new = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            stop = new[-1] if len(new) else 0
            held = rows[:, stop:]
            if stop and (edges := compared(np.split(rows[:, :stop], new[:-1], axis=1))):
                yield batch(edges)
        if edges := compared([held]):
            yield batch(edges)

    def compared(groups: list[np.ndarray]) -> list[tuple[int, int]]:
        """Edges of whole tiles; small ones share planes, which finds no false link."""
        edges, small, n = [], [], 0
        for g in groups:
            if g.shape[1] < TOGETHER and (g[2] == g[3]).all():
                small, n = [*small, g], n + g.shape[1]
                if n >= TOGETHER:
                    edges += tile(np.concatenate(small, axis=1), None)
                    small, n = [], 0
            else:  # two parts: all pairs across; one part: its own pairs
                edges += tile(g, int((g[4] == g[2][0]).sum()) if g[2][0] != g[3][0] else None)
        return edges + (tile(np.concatenate(small, axis=1), None) if small else [])

    def tile(g: np.ndarray, split: int | None) -> list[tuple[int, int]]:
        if g.shape[1] < 2 or split in (0, g.shape[1]):
            return []
        return star_edges(g[5].view(np.uint64), g[6], split, radius)

    def batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["a", "b"])

    found = tiles.repartition("choice", "key", "x", "y").sortWithinPartitions(*order).select(*order, "fp", "node").mapInArrow(run, "a long, b long")
    return found.distinct()


def _with_least(rows: DataFrame, key: str, least: DataFrame, heavy: int | None) -> DataFrame:
    """``rows`` joined with ``least(key, m, n)``, the n rows of each key spread if they are many.

    Keys of more than ``heavy`` rows are broadcast: there are at most
    rows / heavy of them. The others meet their rows in an exchange, as all
    do where ``heavy`` is None.
    """
    if heavy is None:
        return rows.join(least.select(key, "m"), key)
    hubs = F.broadcast(least.filter(F.col("n") > heavy).select(key, F.col("m").alias("_hub")))
    at = rows.join(hubs, key, "left")
    light = least.filter(F.col("n") <= heavy).select(key, "m")
    return (
        at.filter("_hub is not null").withColumnRenamed("_hub", "m")
        .unionByName(at.filter("_hub is null").drop("_hub").join(light, key))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with edges.

    Large-star and small-star rounds on edges (a, b) with a < b, each written
    to the shared folder, until nothing changes. A node with very many edges
    is one key of them; such keys are broadcast, at most 2 * HUBS of them.
    Graphs of HUB_EDGES edges or fewer have none.
    """
    spark, mark = edges.sparkSession, staged_so_far()
    now = stage(edges.select("a", "b").filter("a <> b").distinct(), "components")
    count = now.count()
    if not count:
        return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    heavy, seen = max(HUB_EDGES, count // HUBS) if count > HUB_EDGES else None, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both, "a", least, heavy).filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, "b", low, heavy).select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        now = stage(small.filter("a <> b").distinct(), "components")
        release(spark, mark, keep=(now,))
        # the edge set is stable once its size and checksum are
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        seen = found


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest id reachable over links of at most
    ``radius`` differing bits. Null and blank texts have fingerprint zero and
    link like others. Ids are integers; null ids take part in links but name
    no component unless all ids of a fingerprint are null, which then stays
    alone with a null component. Repeated rows give repeated results.
    """
    mark = staged_so_far()
    docs = stage(fingerprints(df, id_col, text_col, words), "simhash-docs")
    nodes = stage(docs.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")), "simhash-nodes")
    # a repeated id may stand for several fingerprints: one node then
    # stands for both, which links them; ids are meant to be unique
    found = components(stage(links(nodes.filter("node is not null"), radius), "simhash-links"))
    named = stage(
        nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "simhash-classes"
    )
    release(df.sparkSession, mark, keep=(docs, named))
    return docs.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
