"""Near copies by the exact Jaccard similarity of word shingles.

SimHash comes first: texts whose fingerprints of the same shingles are equal or
differ in few bits are candidates. A pair of similarity 0.8 differs in some ten
of 64 bits, so most of these lie beyond any radius that can be searched; MinHash
adds the candidates that the fingerprints leave: BANDS keys of ROWS minima
each, so that a pair of similarity s shares a key with probability
1 - (1 - s**ROWS)**BANDS (0.9999 at 0.8, more above). Every link is then checked
on the shingle sets themselves, so a fingerprint or key alone removes nothing.

Texts of one key are first compared with a leader of the key, in STARS rounds
with other leaders; then the texts of keys that still span several components
meet, all of them, in tiles: keys with very many texts are cut into parts, and
pairs of parts are tiles of their own, so no task holds a whole hot key. A
tile counts common shingles over an inverted index and tells only links that
join two components, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release, stage, staged_so_far
from .simhash import _LOWER, RADIUS, SEED, components, fingerprints, links as near_prints

WORDS, LEAST = 5, 0.8
#: Keys of a text and minima of a key.
BANDS, ROWS = 24, 5
#: Rounds of leaders, and texts of a key that make one part.
STARS, PART = 2, 512
#: Shingles put through the minima at a time, and rows sent on at a time.
CHUNK, SENT = 1 << 11, 256

_rng = np.random.default_rng(SEED)
_ADD, _MIX = _rng.integers(0, 1 << 63, (2, 1, BANDS * ROWS), np.uint64)
_MIX = 2 * _MIX + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles; those of simhash.fingerprint.

    A text of fewer words is one shingle, one without words the empty shingle.
    """
    flat = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps[words - 1 :].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    return np.array(list({digest(flat[a:b], SEED) for a, b in zip(starts, ends)}), np.uint64)


def keys(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), CHUNK):
        h = (found[i : i + CHUNK, None] ^ _ADD) * _MIX
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _mapped(df: DataFrame, id_col: str, text_col: str, name: str, of) -> DataFrame:
    """node and the array ``of(text)`` as ``name``, for rows with an id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SENT):
                own = b.slice(i, SENT)
                made = [of(t.as_py()) for t in own.column(1)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", name])

    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"node long, {name} array<long>")


def simhash_pairs(df: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> DataFrame:
    """Pairs (a < b) that connect all rows within ``radius`` bits of a SimHash of ``words``-word shingles."""
    prints = stage(fingerprints(df.filter(F.col(id_col).isNotNull()), id_col, text_col, words).select("fp", F.col("doc_id").cast("long").alias("b")), "copies-prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("b").alias("node")), "copies-nodes")
    same = prints.join(nodes, "fp").filter("b <> node").select(F.col("node").alias("a"), "b")
    return stage(same.unionByName(near_prints(nodes, radius)).distinct(), "copies-simhash")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike enough."""
    of_a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    of_b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both / (F.size("sa") + F.size("sb") - both) >= least
    return pairs.join(of_a, "a").join(of_b, "b").filter(alike).select("a", "b").distinct()


def tile_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (i < j) of alike sets that join components, given by ``label``.

    Where ``side`` has two values, only pairs across count.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    count = np.diff(np.append(first, len(flat)))
    which = np.empty(len(flat), np.int64)
    which[order] = np.repeat(np.arange(len(first)), count)
    holders, ends = owner[order], np.cumsum(sizes)
    across, label, out = side.min() != side.max(), label.copy(), []
    for i in range(len(sets) - 1):
        own = which[ends[i] - sizes[i] : ends[i]]
        own = own[count[own] > 1]
        if not len(own):
            continue
        n = count[own]
        at = np.arange(n.sum()) + np.repeat(first[own] - np.cumsum(n) + n, n)
        common = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero(common / (sizes[i] + sizes - common) >= least)
        near = near[(near > i) & (label[near] != label[i])]
        for j in near[side[near] != side[i]] if across else near:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def _met(tiles: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of ``tiles(key, x, y, p, node, c, s)``, tile by tile."""
    names = ["key", "x", "y"]

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2 or len({r[5] for r in rows}) < 2:
            return []
        # one text of a set of equal ids is enough
        nodes = np.array([r[4] for r in rows])
        label = np.unique([r[5] for r in rows], return_inverse=True)[1]
        side = np.array([r[3] for r in rows])
        if rows[0][1] != rows[0][2] and side.min() == side.max():
            return []
        pairs = tile_links([r[6] for r in rows], label, side if rows[0][1] != rows[0][2] else np.zeros(len(rows)), least)
        return [(int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))) for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def sent(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        for b in batches:
            small = [b.column(i).to_pylist() for i in range(6)]
            for row in zip(*small, (v.values.to_numpy() for v in b.column(6))):
                if held and held[0][:3] != row[:3]:
                    yield from sent(links(held))
                    held = []
                held.append(row)
        yield from sent(links(held))

    dealt = tiles.repartition(*names).sortWithinPartitions(*names, "node").select(*names, "p", "node", "c", "s")
    return dealt.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """(node, component) of the rows that have a near copy.

    Two rows are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``least``; the component is the smallest id reachable.
    Rows with null ids are left out.
    """
    mark = staged_so_far()
    keyed = _mapped(df, id_col, text_col, "k", lambda t: keys(shingles(t, words)))
    keyed = stage(keyed.select("node", F.explode("k").alias("key")), "copies-keys")
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "copies-shared")
    members = stage(keyed.join(shared, "key").distinct(), "copies-members")
    by_print = simhash_pairs(df, id_col, text_col, words, radius)
    named = members.select("node").unionByName(by_print.select(F.explode(F.array("a", "b")).alias("node")))
    own = df.join(named.select(F.col("node").alias(id_col)).distinct(), id_col, "left_semi")
    sets = stage(_mapped(own, id_col, text_col, "s", lambda t: shingles(t, words).view(np.int64)), "copies-sets")

    tried = edges = None
    found = members.select("node", F.col("node").alias("component")).limit(0)

    def checked(pairs: DataFrame) -> None:
        nonlocal tried, edges, found
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = stage(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), "copies-pairs")
        tried = new if tried is None else tried.unionByName(new)
        links = stage(_linked(new, sets, least), "copies-links")
        edges = links if edges is None else edges.unionByName(links)
        found = components(edges)

    def open_keys() -> DataFrame:
        """Members of keys that still span several components."""
        at = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        at = stage(at, "copies-open")
        spans = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"))
        return at.join(stage(spans.filter("lo < hi").select("key", "n"), "copies-spans"), "key")

    checked(by_print)
    for r in range(STARS):
        now = stage(open_keys(), "copies-now")
        lead = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "c")).alias("l"))
        lead = stage(lead.select("key", F.col("l.node").alias("a"), F.col("l.c").alias("la")), "copies-leaders")
        checked(now.join(lead, "key").filter("c <> la").select("a", F.col("node").alias("b")))

    parts = F.ceil(F.col("n") / PART).cast("int")
    tiles = open_keys().withColumn("p", F.pmod(F.xxhash64("node"), parts).cast("int"))
    tiles = tiles.withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    tiles = tiles.select("key", F.least("p", "o").alias("x"), F.greatest("p", "o").alias("y"), "p", "node", "c")
    met = stage(_met(stage(tiles, "copies-tiles").join(sets, "node"), least), "copies-met")
    found = components(edges.unionByName(met))
    release(df.sparkSession, mark, keep=(found,))
    return found
