"""Kernels against brute force, and points, files and streams."""

import itertools
import json
import random
import tracemalloc
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions import naming as nm, statistics as st
from seriesmith.operators import kernels as kn, signal as sg, tolerance as tol
from seriesmith.sources import files
from seriesmith.streaming import streams


def test_linkage_joins_least_mean_distance():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=(12, 2))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        sets = [[i] for i in range(12)]
        while len(sets) > 1:
            m, i, j = min((d[np.ix_(a, b)].mean(), p, q) for (p, a), (q, b) in itertools.combinations(enumerate(sets), 2))
            if m > 1.5:
                break
            sets[i] = sets[i] + sets.pop(j)
        label = kn.average_linkage(d)
        assert {frozenset(s) for s in sets} == {frozenset(np.flatnonzero(label == g)) for g in set(label)}


def test_assignment_is_best():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = rng.integers(1, 6, 2)
        score, ok = rng.random((n, m)).round(3), rng.random((n, m)) < 0.6
        best = (0, 0.0)
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    if all(ok[i, j] for i, j in zip(rows, cols)):
                        best = max(best, (k, round(sum(score[i, j] for i, j in zip(rows, cols)), 6)))
        pairs = kn.assign(score, ok)
        assert (len(pairs), round(sum(score[i, j] for i, j in pairs), 6)) == best


def test_bounded_least_squares_meets_its_bounds():
    rng = np.random.default_rng(3)
    a = rng.random((60, 3))
    w = kn.bounded_least_squares(a, a @ [0.5, 2.0, 0.0])
    assert 0 <= w.min() and w.max() <= 1.5 and w[1] == 1.5
    assert np.allclose(kn.bounded_least_squares(a, a @ [0.5, 1.0, 0.2]), [0.5, 1.0, 0.2])


def test_medoid_groups_and_separation():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    g = kn.medoid_groups(d)
    assert all(len(set(g[i : i + 30])) == 1 for i in (0, 30, 60)) and len(set(g)) == 3
    assert (kn.separation(d, g) > 4).all() and (kn.jaccard_stability(g, g) == 1).all()


def test_grid_with_dropouts_and_jitter():
    rng = np.random.default_rng(5)
    t = 0.3 + np.arange(200) * 60 / 124 + rng.normal(0, 0.01, 200)
    grid = kn.fit_grid(t[rng.random(200) < 0.8])
    assert abs(60 / grid["period"] - 124) < 0.05 and kn.fit_grid(t[:5]) is None and kn.fit_grid(rng.random(50) * 100) is None


def test_coherence_of_many_points_needs_little_memory():
    rng = np.random.default_rng(8)
    t, periods = np.sort(rng.random(5000) * 2500), np.linspace(0.47, 0.53, 4001)
    tracemalloc.start()
    got = kn.comb_coherence(t, periods)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[::400], [abs(np.exp(2j * np.pi * t / p).mean()) for p in periods[::400]], atol=1e-12)
    assert peak < 100e6


def test_split_by_gap():
    assert kn.split_by_gap(np.array([1.0, 2, 9, 10, 30, 31, 1.5])).tolist() == [0, 0, 1, 1, 2, 2, 0]


def test_contiguous_segments():
    assert kn.contiguous_segments(np.array([[0.0], [0.1], [5], [5.1], [9], [9]]), 3).tolist() == [0, 0, 1, 1, 2, 2]


def test_one_to_one_is_a_maximum():
    rng = random.Random(6)
    for _ in range(200):
        a, b = (sorted(rng.randrange(30) for _ in range(rng.randrange(6))) for _ in "ab")
        pairs = tol.one_to_one(np.array(a, float), np.array(b, float), 2)
        assert all(abs(a[i] - b[j]) <= 2 for i, j in pairs) and len({j for _, j in pairs}) == len(pairs)
        best = max((k for k in range(min(len(a), len(b)) + 1) for r in itertools.combinations(a, k) for c in itertools.permutations(b, k) if all(abs(x - y) <= 2 for x, y in zip(r, c))), default=0)
        assert len(pairs) == best


def test_matching_by_pieces_is_a_maximum(spark):
    rng = random.Random(7)
    side = lambda: [("k%d" % (i % 3), float(rng.randrange(400))) for i in range(90)]
    a, b = side(), side()
    got = tol.match_points(spark.createDataFrame(a, "k string, t double"), spark.createDataFrame(b, "k string, t double"), ["k"], "t", 3.0).collect()
    for k in ("k0", "k1", "k2"):
        whole = tol.one_to_one(*(np.array(sorted(t for x, t in s if x == k)) for s in (a, b)), 3.0)
        assert sum(r["k"] == k for r in got) == len(whole)


def test_points_on_the_tolerance_and_before_zero(spark):
    a = spark.createDataFrame([("k", -1.0), ("k", 5.0), ("k", 9.0), (None, 5.0)], "k string, t double")
    b = spark.createDataFrame([("k", -3.0), ("k", 7.0), ("j", 9.0)], "k string, t double")
    assert sorted(r["t"] for r in tol.near(a, b, ["k"], "t", 2.0).collect()) == [-1.0, 5.0, 9.0]
    assert [r["t"] for r in tol.near(a, b, ["k"], "t", 1.9, absent=True).filter("k is not null").orderBy("t").collect()] == [-1.0, 5.0, 9.0]


def test_interpolation_extends_the_outer_pairs(spark):
    marks = spark.createDataFrame([("k", 0.0, 0.0), ("k", 2.0, 8.0), ("k", 4.0, 10.0)], "k string, x double, y double")
    points = spark.createDataFrame([("k", v) for v in (-1.0, 0.0, 1.0, 2.0, 3.0, 6.0)], "k string, x double")
    got = {r["x"]: r["value"] for r in tol.interpolate(points, marks, ["k"], "x", "y").collect()}
    assert got == {-1.0: -4.0, 0.0: 0.0, 1.0: 4.0, 2.0: 8.0, 3.0: 9.0, 6.0: 12.0}


def test_exact_tails(spark):
    df = spark.createDataFrame([([0.5, 0.2, 0.9], 2), ([0.5], 0), ([], 1)], "p array<double>, k int")
    got = [r[0] for r in df.select(st.poisson_binomial_tail(F.col("p"), F.col("k"))).collect()]
    chance = sum(np.prod([p if x else 1 - p for p, x in zip([0.5, 0.2, 0.9], xs)]) for xs in itertools.product([0, 1], repeat=3) if sum(xs) >= 2)
    assert np.allclose(got, [chance, 1.0, 0.0])


def tone(hz, seconds=1.0, rate=8000, decay=0.0):
    t = np.arange(int(seconds * rate)) / rate
    return np.sin(2 * np.pi * hz * t) * np.exp(-decay * t)


def test_signals():
    x = np.concatenate([np.zeros(800), tone(200, 0.5, decay=20), tone(200, 0.5, decay=20)])
    assert np.allclose(sg.onsets(x, 8000), [0.1, 0.6], atol=0.012)
    assert sg.spectral_distance(tone(200), 0.5 * tone(200), 8000) < 1e-6 < 0.5 < sg.spectral_distance(tone(200), tone(900), 8000)
    assert sg.chroma(tone(440), 8000).argmax() == 9 and sg.chroma(np.zeros(9000), 8000).sum() == 0
    a, b = tone(200), tone(1500)
    parts = sg.soft_masks(a + b, [a, b])
    assert np.abs(sum(parts) - a - b).max() < 1e-6 and np.abs(parts[0] - a)[500:-500].max() < 0.05
    quiet = sg.gate(np.ones(8000), 8000, [(0.25, 0.5)])
    assert quiet[2000:4000].max() == 0 and quiet[:1900].min() == 1 and quiet[4100:].min() == 1
    assert abs(sg.hit_profile(tone(180, decay=10), 8000)["pitch_hz"] - 180) < 3 and sg.hit_profile(np.zeros(100), 8000) == {}
    assert sg.align_lag(np.roll(tone(50, decay=5), 7), tone(50, decay=5), 20) == 7
    at, energy = sg.band_energy(tone(100, 2.0), 8000)
    assert energy.sum(axis=0).argmax() == 0 and len(at) == len(energy)
    assert np.allclose(sg.bar_power(np.ones(10), np.array([0, 4, 8, 30, 40]))[:3], 1)


def test_keys(spark):
    df = spark.createDataFrame([(t,) for t in ("A minor", "F#Maj", "C", "Abm", "6A", "11b", "H", "13A", "CM", None)], "t string")
    got = [r["k"] and tuple(r["k"]) for r in df.select(nm.parse_key(F.col("t")).alias("k")).collect()]
    assert got == [(9, "minor"), (6, "major"), (0, "major"), (8, "minor"), (7, "minor"), (9, "major"), None, None, (0, "major"), None]


def test_title_keys(spark):
    names = ["8A - 124 - Ártist - Niñght_Drive 124bpm Am [abcdefghijk]", "???", "Song F#m"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(nm.title_key(F.col("n"))).collect()] == ["ninght drive am", "???", "song"]


def test_crc16(spark):
    def plain(data):
        c = 0
        for b in data[:16384]:
            c ^= b << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1 & 0xFFFF
        return c

    rows = [(bytes(random.Random(i).randbytes(n)),) for i, n in enumerate((0, 1, 9, 200))]
    df = spark.createDataFrame(rows, "d binary")
    assert [r[0] for r in df.select(nm.crc16(F.col("d"))).collect()] == [plain(d) for (d,) in rows]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_blocks(spark, tmp_path, width, monkeypatch):
    x = (tone(100, 0.1) * 0.5 * (1 << (8 * width - 1))).astype(int)
    with wave.open(str(tmp_path / "kick.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(width), w.setframerate(8000)
        w.writeframes(b"".join(int(v + 128).to_bytes(1, "little") if width == 1 else int(v).to_bytes(width, "little", signed=True) for v in x))
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    rows = {r["stem"]: r for r in files.read_audio(spark, str(tmp_path)).collect()}
    assert rows["bad"]["sr"] is None and rows["kick"]["sr"] == 8000 and len(rows["kick"]["pcm"]) == 800
    assert np.abs(np.array(rows["kick"]["pcm"]) - tone(100, 0.1) * 0.5).max() < max(1e-6, 2 / (1 << (8 * width - 2)))


def test_manifest_log_and_documents(spark, tmp_path):
    path = str(tmp_path / "m.tsv")
    row = dict(zip(files.MANIFEST.replace(" string", "").split(", "), "abcdefghij"))
    files.write_manifest(spark.createDataFrame([row], files.MANIFEST), path)
    assert files.read_manifest(spark, path).first().asDict() == row
    with pytest.raises(ValueError):
        files.read_manifest(spark, path, "other string")
    (tmp_path / "log.jsonl").write_text('{"id":"a","status":"done"}\nbroken\n{"id":"b","status":"failed"}\n')
    assert {r["id"] for r in files.read_log(spark, str(tmp_path / "log.jsonl")).filter("id is not null").collect()} == {"a", "b"}
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, value in (("a", {"kind": "p", "version": 6}), ("b", {"kind": "p", "version": 7}), ("c", {"kind": "q"}), ("d", None)):
        (docs / f"{name}.json").write_text(json.dumps(value) if value else "{broken")
    got = {r["path"][-6]: r["state"] for r in files.read_documents(spark, str(docs), "kind string, version int", version=6, kind="p").collect()}
    assert got == {"a": "present", "b": "newer", "c": "unreadable", "d": "unreadable"}
    assert {r["name"] for r in files.listing(spark, str(docs), "*.json").collect()} == set("abcd")


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    events = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.1, 0.6, 0.4, 0.2, 0.4, 0.9])], "k string, i int, v double")
    events.coalesce(1).write.parquet(str(folder))
    for name, made, mode in (
        ("states", lambda s: streams.hysteresis_stream(s, "k", "i", "v"), "append"),
        ("latest", lambda s: streams.latest_status(s.withColumn("s", F.col("v").cast("string")), "k", "i", "s"), "complete"),
    ):
        stream = spark.readStream.schema(events.schema).parquet(str(folder))
        query = made(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert [r["state"] for r in spark.sql("select * from states order by i").collect()] == [False, True, True, False, False, True]
    assert spark.sql("select s, events from latest").first().asDict() == {"s": "0.9", "events": 6}
