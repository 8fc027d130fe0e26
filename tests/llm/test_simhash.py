"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from seriesmith.llm import simhash
from seriesmith.llm.simhash import components, fingerprint, links, near_duplicates, star_edges


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids, radius=4):
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints():
    for text in [None, "", " \t\n\v\f\r", "One", "a b c", "a b c d", "A  b\xa0c\nd e f g", "É é x y z", "w " * 300, "日本 🙂 b c d"]:
        assert fingerprint(text) == plain_fingerprint(text), text
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["a", "B", " ", "\n", "é", "long"]) for _ in range(rng.randrange(200)))
        assert fingerprint(text) == plain_fingerprint(text)


def test_chunks_of_long_texts(monkeypatch):
    text = " ".join(str(i) for i in range(1000))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert fingerprint(text) == whole


def near_fps(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 5))]
    out = {b for b in base}
    while len(out) < n:
        x = rng.choice(sorted(out))
        for _ in range(rng.randrange(1, 7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return list(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("split", [None, 40])
def test_star_edges(split):
    fps = near_fps(3, 150)
    edges = star_edges(np.array(fps, np.uint64), np.arange(150) * 3, split, 4)
    linked = [(i, j) for i in range(150) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4 and (split is None or (j < split <= i))]
    from collections import defaultdict

    def reach(pairs):
        near = defaultdict(set)
        for a, b in pairs:
            near[a].add(b), near[b].add(a)
        seen, out = set(), set()
        for a in list(near):
            if a not in seen:
                todo, own = [a], set()
                while todo:
                    x = todo.pop()
                    if x not in own:
                        own.add(x)
                        todo += near[x]
                seen |= own
                out.add(frozenset(own))
        return out

    assert reach([(a // 3, b // 3) for a, b in edges]) == reach(linked)


@pytest.mark.parametrize("blocks", [5, 6, 8])
@pytest.mark.parametrize("part", [8192, 6])
def test_links_and_components(spark, blocks, part):
    fps = near_fps(7, 120)
    nodes = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, node long")
    found = {r["node"]: r["component"] for r in components(links(nodes, part=part, blocks=blocks)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == classes(fps, list(range(len(fps))))


def test_near_duplicates(spark):
    rng = random.Random(2)
    texts = [None, "", "  ", "one", "One"]
    for i in range(40):
        words = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(200)]
        texts += [" ".join(words), " ".join(words[:-1])]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids))), "doc_id long, text string, fp string")
    rows = {r["doc_id"]: r for r in near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    for i, f, c in zip(ids, fps, classes(fps, ids)):
        assert (rows[i]["fingerprint"], rows[i]["component_id"]) == (f"{f:016x}", c)
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q r s t u")], "doc_id long, text string")
    rows = near_duplicates(df).collect()
    assert sorted(str(r["component_id"]) for r in rows) == ["5", "5", "5", "None"]
