"""Lattice language model: every path, class and run summed by brute force."""

import math
import os
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seriesmith.llm import lm_scoring
from seriesmith.llm.lm_scoring import Lattice, compiled, discount, run_starts, score_documents, text_scores, vocabulary

VOCABULARY = str(public_tokenizers.path("piece_bpe_32k.model"))


def lattice_of(p, stop=0.0):
    return Lattice(compiled(list(p)), np.log(list(p.values())), stop)


def paths(w, p):
    return [[]] if not w else [[x, *rest] for x in p if w.startswith(x) for rest in paths(w[len(x) :], p)]


def test_lattice_is_the_sum_over_segmentations():
    p = {b"a": 0.2, b"b": 0.2, b"ab": 0.1, b"ba": 0.1, b"abc": 0.1, b"c": 0.2}
    lattice = lattice_of(p, math.log(0.1))
    words = [b"a", b"abcab", b"cc", b"ababab", b"bab"]
    total = {w: sum(math.prod(p[x] for x in s) for s in paths(w, p)) for w in words}
    assert np.allclose(lattice.log10(words)[0], [math.log10(total[w] * 0.1) for w in words])
    uses = Counter()
    for w in words:
        for s in paths(w, p):
            for x in s:
                uses[x] += math.prod(p[y] for y in s) / total[w]
    assert np.allclose(lattice.expected(words), [uses[x] for x in p])
    assert np.isfinite(lattice.log10([b"ab" * 4000]))[0, 0]


def test_classes_score_at_once():
    p, q = {b"a": 0.5, b"b": 0.3, b"ab": 0.2}, {b"a": 0.1, b"b": 0.8, b"ab": 0.1}
    both = Lattice(compiled(list(p)), np.log([list(p.values()), list(q.values())]), np.array([0.0, -1.0]))
    words = [b"", b"ab", b"abba", b"b" * 70]
    for k, (x, stop) in enumerate([(p, 0.0), (q, -1.0)]):
        assert np.allclose(both.log10(words)[k], lattice_of(x, stop).log10(words)[0])


def test_long_pieces_are_arcs():
    found = vocabulary(VOCABULARY)
    assert all(bytes([b]) in found for b in range(256)) and abs(sum(found.values()) - 1) < 1e-9
    assert all(p in found for p in (b"information", b"something", b"different", b"university"))
    lattice = lattice_of({b"a": 0.1, b"b": 0.1, b"abababababab": 0.8})
    words = [b"abababababab", b"ab", b"aabababababab"]
    want = np.array([0.8 + 1e-12, 1e-2, 0.1 * (0.8 + 1e-12)])
    assert np.allclose(lattice.log10(words), np.log10(want), rtol=1e-12)
    assert np.allclose(lattice.expected(words[:1]), [6e-12 / want[0], 6e-12 / want[0], 0.8 / want[0]])


def test_rounds_and_runs():
    assert (lm_scoring.ROUNDS, lm_scoring.RUN) == (3, 32)
    words = [b"a."] * 2 + [b"b"] * 70 + [b"c!"]
    assert run_starts(words) == [0, 1, 2, 34, 66] and run_starts([]) == [0] and run_starts([b"x."]) == [0]


def test_texts_sum_over_all_classes():
    rng = np.random.default_rng(2)
    counts, shares = np.array([3, 1, 5]), np.array([0.5, 0.3, 0.2])
    runs = -rng.random((9, 3)) * 6
    got, at = text_scores(runs, counts, shares), 0
    for n, value in zip(counts, got):
        total = 0.0
        for path in product(range(3), repeat=n):
            chance = shares[path[0]]
            for a, b in zip(path, path[1:]):
                chance *= lm_scoring.STAY * (a == b) + (1 - lm_scoring.STAY) * shares[b]
            total += chance * 10 ** sum(runs[at + i, k] for i, k in enumerate(path))
        assert math.isclose(value, math.log10(total), rel_tol=1e-9)
        at += n


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def tokens(t):
    return [*(t or "").lower().encode().split(), b""]


class Plain:
    """The model of ``score_documents`` by dictionaries and full enumeration."""

    def __init__(self, rows):
        self.pieces = vocabulary(VOCABULARY)
        names = [None, *sorted({k for i, _, k in rows if k is not None and not held(i)})]
        train = [(tokens(t), k) for i, t, k in rows if not held(i)]
        self.all = Counter(w for t, _ in train for w in t)
        each = [Counter(w for t, k in train if k == n for w in t) for n in names]
        self.each = [c for c in each if c]
        self.share = [c.total() / self.all.total() for c in self.each]
        self.runs = Counter(r for t, _ in train for r in self.cut(t[:-1]))
        self.models = [self.fitted([w for w in c if w]) for c in self.each]

    @staticmethod
    def cut(words):
        starts = run_starts(words) if words else []
        return [tuple(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)])]

    def arcs(self, w):
        """All segmentations of a word, by the vocabulary."""
        return [[]] if not w else [[w[:n], *rest] for n in range(1, len(w) + 1) if w[:n] in self.pieces for rest in self.arcs(w[n:])]

    def fitted(self, types):
        p, stop = self.pieces, 1.0
        for _ in range(lm_scoring.ROUNDS):
            uses = Counter({x: v * lm_scoring.PRIOR for x, v in self.pieces.items()})
            for w in types:
                ways = [(s, math.prod(p[x] for x in s)) for s in self.arcs(w)]
                total = sum(v for _, v in ways)
                for s, v in ways:
                    for x in s:
                        uses[x] += v / total
            n = len(types) + 1
            total = uses.total() + n
            p, stop = {x: v / total for x, v in uses.items()}, n / total
        return p, stop

    @staticmethod
    def backed(counter, w, below, used=None):
        d = discount(sum(v == 1 for v in counter.values()), sum(v == 2 for v in counter.values()))
        n, v = counter.total(), len(counter)
        return max((counter[w] if used is None else used) - d, 0) / n + d * v / n * below

    def word(self, w, k):
        p, stop = self.models[k]
        spelled = sum(math.prod(p[x] for x in s) for s in self.arcs(w)) * stop if w else 0.0
        return self.backed(self.each[k], w, self.backed(self.all, w, spelled))

    def score(self, i, text):
        words = tokens(text)[:-1]
        runs, own = self.cut(words), Counter()
        if not held(i):
            own.update(runs)
        chance = []
        for r in runs or [()]:
            spelled = [math.prod(self.word(w, k) for w in r) for k in range(len(self.each))]
            chance.append([self.backed(self.runs, r, x, max(self.runs[r] - own[r], 0)) if r else 1.0 for x in spelled])
        chance[-1] = [x * self.word(b"", k) for k, x in enumerate(chance[-1])]
        total = 0.0
        for path in product(range(len(self.each)), repeat=len(chance)):
            x = self.share[path[0]] * chance[0][path[0]]
            for a, b, c in zip(path, path[1:], chance[1:]):
                x *= (lm_scoring.STAY * (a == b) + (1 - lm_scoring.STAY) * self.share[b]) * c[b]
            total += x
        return math.log10(total)


def some_rows():
    rng = random.Random(4)
    en, fr = ["the", "of", "and.", "Word", "Word!"], ["le", "él", "une.", "des"]
    rows = []
    for i in range(60):
        own, name = rng.choice([(en, "en"), (fr, "fr"), (en + fr, None)])
        rows.append((i, " ".join(rng.choice([*own, "x%d" % rng.randrange(20)]) for _ in range(rng.randrange(0, 18))), name))
    return [*rows, (70, rows[3][1], "en"), (71, rows[3][1], "fr"), (72, None, "en"), (73, "", None), (74, "zzqqx new", "en"), (None, "the of", "en"), (3, rows[3][1], rows[3][2])]


def test_scores_are_those_of_full_enumeration(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, k, 1.0, 2, 5) for i, t, k in rows], "doc_id long, text string, lang string, score double, block int, w int")
    got = score_documents(spark, docs, VOCABULARY, class_col="lang").collect()
    assert len(got) == len(rows)
    plain = Plain(rows)
    n, v = plain.all.total(), len(plain.all)
    want = Counter()
    for i, t, _ in rows:
        own = tokens(t)
        base = sum(math.log10((plain.all[w] + 1) / (n + v + 1)) for w in own)
        want[i, held(i), len(own), sum(plain.all[w] > 0 for w in own), n, round(base, 6), round(plain.score(i, t), 3)] += 1
    found = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 3)) for r in got)
    close = lambda x, y: x[:6] == y[:6] and abs(x[6] - y[6]) < 0.0025
    key = lambda x: (str(x[0]), x[6])
    assert all(close(x, y) for x, y in zip(sorted(want.elements(), key=key), sorted(found.elements(), key=key)))


def test_score_edges(spark):
    docs = spark.createDataFrame([(1, "w" * 3000, "en"), (2, "x " * 50_000, "en"), (5, None, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in score_documents(spark, docs, VOCABULARY).collect()}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got.values()) and got[2]["n_tokens"] == 50_001
    assert score_documents(spark, docs.limit(0), VOCABULARY).count() == 0
    only = next(i for i in range(100) if held(i))
    untrained = score_documents(spark, spark.createDataFrame([(only, "the of", "en")], docs.schema), VOCABULARY).first()
    assert untrained["train_tokens"] == 0 and math.isfinite(untrained["score"])


@pytest.mark.parametrize("most", [100, 1])
def test_blocks_are_bounded_by_bytes(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(lm_scoring, "BLOCK_ROWS", 45)
    monkeypatch.setattr(lm_scoring, "HEAVY_RUNS", most)
    rows = [(i, "x" * (3000 if i % 3 else 10)) for i in range(90)] + [(100, "y" * 10_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    size = lm_scoring.located(docs, F.col("text")).groupBy("_block").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 45_000 or r["n"] == 1 for r in size) and sum(r["n"] for r in size) == 91 and 5 < len(size) < 60


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_texts_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = score_documents(spark, docs, VOCABULARY, class_col="lang").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]
