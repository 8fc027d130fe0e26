"""Exact dedup, sharding and fingerprints against plain Python."""

import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from seriesmith.llm import sharding
from seriesmith.llm.exact_dedup import exact_dedup
from seriesmith.llm.fingerprints import differing_leaves, fingerprint, fingerprint_edits, print_leaves, root
from seriesmith.llm.sharding import shard_by_bytes

SCHEMA = "doc_id long, text string, lang string, keep_id string, h string, t string"
TEXTS = ["Same", "same", "SAME", None, "", "É", "é", "other", "x" * 50000, "X" * 50000, " same"]


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "clash", "clash", "clash") for i, t in zip(ids, texts)], SCHEMA)


def folded(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, keep, weak):
    extra = {"hash_of": lambda t: F.lit(b"0")} if weak else {}
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark, TEXTS), keep=keep, **extra).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        own = [j for j, other in enumerate(TEXTS) if folded(other) == folded(text)]
        best = min(own) if keep == "min" else max(own)
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best, len(own), best == i)
        assert got[i]["text_sha256"] == hashlib.sha256(folded(text).encode()).hexdigest()


def test_exact_dedup_null_ids_repeats_and_empty(spark):
    rows = exact_dedup(frame(spark, ["a", "a", "a", "b", "b"], [3, None, 3, None, None])).collect()
    assert sorted(str(r["kept"]) for r in rows if r["keep_id"] == 3) == ["False", "True", "True"]
    assert all(r["kept"] for r in rows if r["keep_id"] is None)
    assert exact_dedup(frame(spark, ["a"]).limit(0)).count() == 0


def best_capacity(sizes, shards):
    best = [[0] + [10**18] * len(sizes)]
    for _ in range(shards):
        best.append([0] * (len(sizes) + 1))
        for j in range(1, len(sizes) + 1):
            best[-1][j] = min(max(best[-2][i], sum(sizes[i:j])) for i in range(j))
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(4))
def test_minimax_cuts_are_optimal(spark, seed, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rng = random.Random(seed)
    groups = sorted((hashlib.md5(str(rng.random()).encode()).hexdigest(), rng.choice([1, 5, 40, 400])) for _ in range(rng.choice([3, 40, 60])))
    shards = rng.choice([2, 5, 8])
    capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "h string, size long"), shards)
    assert capacity == best_capacity([s for _, s in groups], shards)
    loads = [0] * shards
    for h, s in groups:
        loads[sum(h >= c for c in cuts)] += s
    assert max(loads) == capacity


def test_shards(spark):
    texts = [random.Random(i % 90).choice(["a", "bé", "日"]) * (1 + i % 90) for i in range(300)] + [None, "", None]
    rows = shard_by_bytes(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    where = {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text or "").encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        assert where.setdefault(text or "", r["shard"]) == r["shard"]
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert shard_by_bytes(frame(spark, ["a"]).limit(0)).count() == 0
    assert [r["shard"] for r in shard_by_bytes(frame(spark, [None, None], [None, 1])).collect()] == [0, 0]


def edited(texts, i):
    ids = sorted(range(len(texts)), reverse=True)
    after = texts[ids[(ids.index(i) + 1) % len(ids)]] or ""
    text = texts[i] or ""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k], after


def test_fingerprint_edits(spark, monkeypatch):
    from seriesmith.llm import fingerprints

    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 700)
    rng = random.Random(5)
    words = ["alpha", "béta", "日本", "delta.", "e!\n", "🙂"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, "", "same text", "same text"]
    rows = {r["doc_id"]: r for r in fingerprint_edits(frame(spark, texts)).collect()}
    assert sorted(rows) == list(range(len(texts)))
    prints = {}
    for i, r in rows.items():
        new, after = edited(texts, i)
        assert r["n_chars"] == len(texts[i] or "")
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert prints.setdefault(texts[i] or "", r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) == ((texts[i] or "") == new)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if (texts[i] or "") == after:
            assert r["near_next"] == 1
    assert len(set(prints.values())) == len(prints)
    assert rows[63]["near_next"] == 1 and fingerprint_edits(frame(spark, ["a"]).limit(0)).count() == 0
    assert fingerprint_edits(frame(spark, ["abc def"])).first()["near_next"] == 1


def test_a_branch_locates_an_edit(spark):
    lines = [f"Sentence number {i} stands here.\n" for i in range(40)]
    other = [*lines[:17], "Something else.\n", *lines[18:]]
    df = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string").select(fingerprint(F.col("a")).alias("a"), fingerprint(F.col("b")).alias("b"))
    r = df.select(differing_leaves(print_leaves(F.col("a")), print_leaves(F.col("b"))).alias("d"), (root(F.col("a")) == root(F.col("b"))).alias("same")).first()
    assert r["d"] == [17] and not r["same"]


def test_texts_of_equal_low_hash_bits_differ(spark):
    a, b = "Order number 37310 is ready.", "Order number 67461 is ready."
    lines = [f"Sentence number {i} stands here.\n" for i in range(20)]
    rows = [(a, b), ("".join([*lines, a]), "".join([*lines, b]))]
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprint(F.col("a")).alias("a"), fingerprint(F.col("b")).alias("b"))
    got = df.select((root(F.col("a")) == root(F.col("b"))).alias("same"), F.size(differing_leaves(print_leaves(F.col("a")), print_leaves(F.col("b")))).alias("n")).collect()
    assert [(r["same"], r["n"]) for r in got] == [(False, 1), (False, 1)]
