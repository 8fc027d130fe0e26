"""Skew, edges and brute force that the other files lack."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.llm import _shared, fingerprints, simhash, toxicity, warc
from seriesmith.llm.fingerprints import fingerprint_edits, with_next
from seriesmith.llm.language import SMOOTH, TRIGRAMS, identify, identify_documents, train_trigrams
from seriesmith.llm.ngrams import hashes
from seriesmith.llm.sharding import shard_by_bytes
from seriesmith.llm.toxicity import score_toxicity


# ------------------------------------------------------------------ storage


class Session:
    """A session of another master, without the shared folder set."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": lambda self, key, default=None: default})()


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "local-cluster[3,2,1024]", "k8s://h"])
def test_clusters_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_dir(Session(master))


def test_staged_tables_go_when_released(spark):
    mark = _shared.staged_so_far()
    kept = _shared.stage(spark.range(5), "kept")
    gone = _shared.stage(spark.range(5), "gone")
    files = [f.removeprefix("file://") for f in gone.inputFiles()]
    _shared.release(spark, mark, keep=(kept,))
    import os

    assert kept.count() == 5 and files and not any(os.path.exists(f) for f in files)


# ------------------------------------------------------------------ skew


def plain_components(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {x: find(x) for x in top}


@pytest.mark.parametrize("centre", [0, 10_000])
def test_hubs_are_components_too(spark, monkeypatch, centre):
    monkeypatch.setattr(simhash, "HUB_EDGES", 100)
    monkeypatch.setattr(simhash, "HUBS", 16)
    edges = [tuple(sorted((centre, x))) for x in range(1, 3000)] + [(x, x + 1) for x in range(20_000, 20_040)] + [(5, 20_000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(df).collect()}
    want = {k: v for k, v in plain_components(edges).items() if k != v}
    assert {k: v for k, v in got.items() if k != v} == want


def rows_by_task(df):
    """Rows of the largest task that computes ``df``."""
    def run(batches):
        n = sum(b.num_rows for b in batches)
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return max(r["n"] for r in df.mapInArrow(run, "n long").collect())


def test_a_far_id_crowds_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 4000)
    rows = [(i, "t%d" % i) for i in range(2000)] + [(1 << 60, "far"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, t string").repartition(4)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        made = with_next(df, "doc_id", F.lit(100).cast("long"), ["t"])
        assert rows_by_task(made) < 400
        order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
        got = {r["t"]: r["next_t"] for r in made.collect()}
        assert got == {t: order[(i + 1) % len(order)] for i, t in enumerate(order)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_readers_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    big = "<p>" + "x" * 3_000_000 + "</p>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>%d</p>" % i * 200) for i in range(120)] + [(500, "http://h/big", big), (501, "http://h/big2", big)], "page_id long, url string, html string")
    index = _shared.stage(warc.write_archives(warc.plan_records(pages), _shared.staged_path(spark, "warc")), "warc-index")
    read = warc.read_records(index)
    assert read.rdd.getNumPartitions() > 20
    got = {r["page_id"]: r for r in read.collect()}
    assert len(got) == 122 and got[500]["record_type"] == "revisit" and got[500]["refers_to"] == 501 and got[501]["payload_bytes"] == len(big)


@pytest.mark.parametrize("shares", [[0.6], [0.5, 0.2], [0.3, 0.3, 0.3], []])
def test_shards_beside_large_classes_stay_near_equal(spark, shares):
    total = 200_000
    rows, i = [], 0
    for k, share in enumerate(shares):
        text = f"class {k} " * 20
        for _ in range(int(total * share / (len(text) + 1))):
            rows.append((i, text))
            i += 1
    left = total * (1 - sum(shares))
    rng = random.Random(5)
    while left > 0:
        text = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(20, 200)))
        rows.append((i, text))
        left -= len(text) + 1
        i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_by_bytes(df).join(df, "doc_id").collect()
    size, of = Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        of[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    groups = Counter()
    for _, t in rows:
        groups[t] += len(t) + 1
    large = [g for g in groups.values() if g > total / 8]
    small = sorted(size[s] for s in range(8))[: 8 - len(large)]
    assert len(size) == 8 and max(size.values()) <= max(max(groups.values()), sum(groups.values()) / 8 * 1.1)
    assert max(small) - min(small) <= 0.1 * sum(small) / len(small)


# ------------------------------------------------------------------ fingerprints


def test_fingerprints_are_those_of_a_plain_tree(spark):
    import re

    import xxhash

    def tree(text):
        leaves = []
        for m in re.findall(fingerprints.PARAGRAPH, text):
            h = xxhash.xxh64_intdigest(m.encode(), 42)
            leaves.append(h - (1 << 64) if h >> 63 else h)
        shown = "".join(("|" if x % 8 == 0 else "") + format(x & (1 << 64) - 1, "016x") for x in leaves)
        sections = []
        for s in shown.split("|"):
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            sections.append(format(h, "X"))
        return hashlib.md5(",".join(sections).encode()).hexdigest() + ":" + shown, leaves

    def like(a, b):
        n = len(set(a)) + len(set(b))
        return 1.0 if n == 0 else 2 * len(set(a) & set(b)) / n

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["one.", "two", "three!\n", "é", "日本。", "x" * 90]) for _ in range(rng.randrange(0, 60))) for _ in range(40)] + ["", None, "a", "y" * 100_000]
    rows = [*enumerate(texts), (None, "no id"), (7, texts[7]), (7, "second of seven")]
    df = spark.createDataFrame([(i, t, "clash", "l", 3) for i, t in rows], "doc_id long, text string, t string, l string, n_chars int")
    got = fingerprint_edits(df).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        (f, a), (g, b), (_, c) = tree(t), tree(edited), tree(after)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, round(like(a, b), 9), round(like(a, c), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    with pytest.raises(ValueError, match="integer"):
        fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ------------------------------------------------------------------ language


def test_fusion_is_bayes_by_hand(spark):
    """Likelihood times trust in the declaration, suffix and smoothed priors, by plain Python."""
    train = [("aaa aba bab", "x"), ("bbb cab aaa", "x"), ("ccc dcd cdc", "y"), ("ddd cad", "y"), ("aaa ccc", "z")]
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(train)], "doc_id long, text string, lang string")
    names, table = train_trigrams(docs, "text", "lang")

    def trigrams(text):
        padded = f" {text} "
        return [padded[i : i + 3] for i in range(len(padded) - 2)]

    bucket = lambda g: int(hashes(np.array([ord(c) for c in g], np.uint32), 3, 16)[0])
    counts = {l: Counter(bucket(g) for t, k in train if k == l for g in trigrams(t)) for l in names}
    for k, l in enumerate(names):
        total = sum(counts[l].values()) + 0.1 * (1 << 16)
        for b in list(counts[l]) + [0]:
            assert math.isclose(table[b, k], math.log((counts[l][b] + 0.1) / total), rel_tol=1e-5)
    rows = [(0, "aaa bab", "h1", "d1", "x", "s1"), (1, "ccc", "h1", "d1", "y", None), (2, "dcd cdc", "h2", "d1", "x", "s2"), (3, "12 3", "h1", "d1", "x", "s1"), (4, "ab", "h3", "d2", None, "s1"), (5, None, "h9", "d9", None, None), (6, "aaa ccc", None, None, "y", "s9")]
    df = spark.createDataFrame(rows, "i long, t string, h string, d string, m string, s string")
    made = identify(df, (names, table), id_col="i", text_col="t", host=F.col("h"), domain=F.col("d"), declared=F.col("m"), suffix=F.col("s"))
    got = {r["i"]: r for r in made.collect()}

    logs, size, best = {}, {}, {}
    for i, t, *_ in rows:
        own = [g for g in trigrams(t or "") if g[1] != " " and g[1].isalpha()]
        size[i] = len(own)
        scale = min(len(own), TRIGRAMS) / max(len(own), 1)
        logs[i] = [scale * sum(float(table[bucket("".join(c if c.isalpha() else " " for c in g)), k]) for g in own) for k in range(len(names))]
        best[i] = max(range(len(names)), key=lambda k: (logs[i][k], -k)) if own else None
    told = [(h or "", d or "", m, s, best[i]) for i, _, h, d, m, s in rows if best[i] is not None]
    share = lambda c, above: [(c[k] + SMOOTH * above[k]) / (sum(c.values()) + SMOOTH) for k in range(len(names))]
    whole = [1 + sum(x[4] == k for x in told) for k in range(len(names))]
    base = [w / sum(whole) for w in whole]
    for i, t, h, d, m, s in rows:
        total = list(logs[i])
        near = Counter(x[4] for x in told if x[:2] == (h or "", d or ""))
        wide = Counter(x[4] for x in told if x[1] == (d or ""))
        prior = share(near, share(wide, base)) if near else base
        total = [a + math.log(b) for a, b in zip(total, prior)]
        for at, value in ((2, m), (3, s)):
            seen = [x for x in told if x[at] is not None]
            values = {x[at] for x in seen}
            if value in values:
                for k in range(len(names)):
                    of = sum(x[4] == k for x in seen) + 0.5 * len(values)
                    total[k] += math.log((sum(x[4] == k and x[at] == value for x in seen) + 0.5) / of)
        known = size[i] > 0 or m is not None or s is not None
        top = max(range(len(names)), key=lambda k: (total[k], -k))
        r = got[i]
        assert r["n_letters"] == size[i] and r["language"] == (names[top] if known else "und"), (i, r, total)
        weight = sum(math.exp(x - total[top]) for x in total)
        assert math.isclose(r["confidence"], 1 / weight if known else 0.0, rel_tol=1e-4, abs_tol=1e-9), (i, r)
        assert r["kept"] == (size[i] > 0 and 1 / weight >= 0.5)


def test_language_of_long_texts_and_clashing_columns(spark):
    rows = [(i, "der und die nicht " * 5 if i % 2 else "the and of to was " * 5, "de" if i % 2 else "en", "s", "x", 1) for i in range(20)]
    rows += [(100, "the and of to was " * 200_000, None, "s", "x", 1), (101, "w" * 2_500_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, best string, n_letters int")
    got = {r["doc_id"]: r for r in identify_documents(docs).collect()}
    assert len(got) == 22 and got[100]["language"] == "en" and got[1]["language"] == "de" and got[0]["language"] == "en" and got[101]["n_letters"] == 2_500_000


# ------------------------------------------------------------------ toxicity


def plain_fit(texts, labels, weights):
    """Scaled logistic regression of n-gram counts with dense arrays, the same step and rounds."""
    def counts(text):
        folded = "".join(c.lower() if c.isalpha() else " " for c in f" {text or ''} ")
        codes = np.array([ord(c) for c in folded], np.uint32)
        out = Counter()
        for j, n in enumerate(toxicity.LENGTHS):
            if len(codes) >= n:
                out.update((hashes(codes, n, toxicity.HASH_BITS) + (j << toxicity.HASH_BITS)).tolist())
        return out, max(len(codes) - toxicity.LENGTHS[0] + 1, 0)

    rows = [counts(t) for t in texts]
    toxic = labels == 1
    df = [Counter(f for (c, _), y in zip(rows, toxic) if y == side for f in c) for side in (True, False)]
    ratio = {}
    for f in set(df[0]) | set(df[1]):
        r = math.log((df[0][f] + 0.5) / (toxic.sum() + 1)) - math.log((df[1][f] + 0.5) / ((~toxic).sum() + 1))
        if df[0][f] + df[1][f] >= toxicity.LEAST_TEXTS and abs(r) >= toxicity.LEAST_RATIO:
            ratio[f] = r
    names = sorted(ratio)
    x = np.array([[c[f] * ratio[f] / math.sqrt(max(n, 1)) for f in names] for c, n in rows])
    scale = math.sqrt((x**2).sum() / len(rows))
    x /= scale
    share = np.where(toxic, toxicity.TOXIC_WEIGHT, 1.0) * weights
    share /= share.sum()
    step = 1 / (0.25 * np.quantile((x**2).sum(axis=1), 0.95) + 0.25 + toxicity.RIDGE)
    w = z = np.zeros(len(names))
    bias, pace = float(np.log((weights[toxic].sum() + 0.5) / (weights[~toxic].sum() + 1.5))), 1.0
    for _ in range(toxicity.ROUNDS):
        slope = (1 / (1 + np.exp(-np.clip(x @ z + bias, -40, 40))) - toxic) * share
        after = z - step * (x.T @ slope + toxicity.RIDGE * z)
        bias -= step * slope.sum()
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        z, w, pace = after + (pace - 1) / faster * (after - w), after, faster
    return names, w * np.array([ratio[f] for f in names]) / scale, bias


@pytest.mark.parametrize("together", [250, 7])
def test_fit_is_that_of_dense_arrays(monkeypatch, together):
    monkeypatch.setattr(toxicity, "TOGETHER", together)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["vile", "brute", "kind", "word", "sun"][: 3 + 2 * (i % 2)] if i % 3 else ["kind", "sun", "word"]) for _ in range(rng.randrange(0, 9))) for i in range(50)] + [None, ""]
    labels = np.array([int(i % 3 > 0) for i in range(50)] + [0, 1])
    weights = np.where(labels == 1, 1.0, 2.0)
    features, w, bias = toxicity.fit(texts, labels, weights)
    names, want, base = plain_fit(texts, labels, weights)
    assert features.tolist() == names and np.allclose(w, want, rtol=1e-3, atol=1e-5) and math.isclose(bias, base, rel_tol=1e-3, abs_tol=1e-4)


def test_tied_and_conflicting_labels(spark):
    """Of several labels of an id the toxic one holds; texts of both labels score in between."""
    texts = ["vile brute " * 4, "kind word " * 4, "both sides " * 4]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(240)], "doc_id long, text string")
    rows = [(i, 1 if i % 3 == 0 else 0 if i % 3 == 1 else i // 3 % 2) for i in range(240)] + [(0, 0), (3, 0), (1, None), (None, 1), (4, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, labels).collect()}
    assert got[0] > 0.8 > got[2] > 0.2 > got[1] and got[2] == got[5]
    assert [r["held_out"] for r in score_toxicity(docs, labels).orderBy("doc_id").collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(240)]
