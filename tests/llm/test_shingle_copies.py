"""Near copies of the pipeline against brute-force similarity of shingle sets."""

import random

import numpy as np
import pytest

from seriesmith.llm import shingle_copies


def plain_sets(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(texts):
    sets, top = [plain_sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    return [i for i, t in enumerate(top) if i == t]


def near_texts(seed, n):
    """Texts and copies of them with a few words changed, on both sides of 0.8."""
    rng = random.Random(seed)
    out = ["one", "One", "a b c d e", "a b c d e f"]
    for _ in range(n):
        words = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(60, 200))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(0, 4)):
            other = list(words)
            for _ in range(rng.randrange(1, 7)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(other))
    return out


@pytest.mark.parametrize("sides", [1, 2])
def test_tiles_link_what_all_pairs_do(sides):
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 1 << 62, int(rng.integers(0, 9)))])) for _ in range(70)]
    label, side = np.arange(70) // 2, np.arange(70) % sides
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8
    pairs = [(i, j) for i in range(70) for j in range(i) if alike(sets[i], sets[j]) and (sides == 1 or side[i] != side[j])]

    def closed(links):
        top = {i: i // 2 for i in range(70)}
        for i, j in links:
            a, b = top[i], top[j]
            top = {k: a if v == b else v for k, v in top.items()}
        return {frozenset(k for k in top if top[k] == v) for v in top.values()}

    got = shingle_copies.tile_links(sets, label, side, 0.8)
    assert closed(got) == closed(pairs) and len(got) < 35 and all((j, i) in pairs for i, j in got)


@pytest.mark.parametrize("part", [1024, 2])
def test_pipeline_drops_near_copies(spark, monkeypatch, part):
    import corpus_pipeline

    monkeypatch.setattr(shingle_copies, "PART", part)
    texts = near_texts(11, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == plain_kept(texts)
    assert len(kept) < len(texts)


def test_simhash_links_without_shared_minima(spark, monkeypatch):
    """Fingerprints alone find what they can, and only links that hold."""
    monkeypatch.setattr(shingle_copies, "keys", lambda found: np.zeros(0, np.int64))
    words = [f"w{i}" for i in range(4000)]
    changed = [*words[:2000], "x", *words[2001:]]
    texts = [" ".join(words), " ".join(changed), " ".join(words[::-1]), "one", "ONE", "two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in shingle_copies.near_copies(docs).collect()}
    assert {(1, 0), (4, 3)} <= got and all(n in (0, 1, 3, 4) for n, _ in got)
