"""Sequence operators against plain loops and hand-counted rows."""

import random

import pytest
from pyspark.sql import functions as F

from seriesmith.operators import parts, sequences as seq


def series(spark, values, kind="double", key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], f"k string, i int, v {kind}")


def ordered(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def test_hysteresis_keeps_its_state(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(200)]
    state, want = False, []
    for v in values:
        state = v >= 0.3 if state else v > 0.5
        want.append(state)
    assert ordered(seq.hysteresis(series(spark, values), "v", ["k"], "i"), "state") == want


@pytest.mark.parametrize("seed", range(6))
def test_despeckle_joins_short_runs(spark, seed):
    rng = random.Random(seed)
    values = [rng.random() < 0.6 for _ in range(rng.choice([1, 3, 40]))]
    out, i = list(values), 0
    while i < len(out):
        j = i
        while j < len(out) and values[j] == values[i]:
            j += 1
        if j - i < 4 and (i or j < len(out)):
            out[i:j] = [out[i - 1] if i else values[j]] * (j - i)
        i = j
    assert ordered(seq.despeckle(series(spark, values, "boolean"), "v", ["k"], "i"), "clean") == out


def flags(spark, kick, bass):
    rows = [("t", i, a == "1", b == "1", 1) for i, (a, b) in enumerate(zip(kick, bass))]
    return spark.createDataFrame(rows, "k string, i int, kick boolean, bass boolean, w int")


def test_groove_blocks(spark):
    #          0         1         2         3
    kick = "0000111111110011111100000000111111111111"
    bass = "0011111111111111111100000111111111111111"
    rows = seq.groove_blocks(flags(spark, kick, bass), "kick", "bass", ["k"], "i", "w").orderBy("block").collect()
    assert [(r["bar"], r["bars"], r["lead"], r["gap_before"], r["a_out_before"]) for r in rows] == [(4, 16, 2, None, None), (28, 12, 3, 8, 8)]


def test_a_lead_of_one_bar_reads_none(spark):
    rows = seq.groove_blocks(flags(spark, "0111111111", "1111111111"), "kick", "bass", ["k"], "i", "w").collect()
    assert [(r["lead"], r["lead_raw"]) for r in rows] == [(0, 1)]


def test_gaps_lie_between_long_stretches(spark):
    rows = seq.stretch_gaps(flags(spark, "0100111100011110010", "0" * 19), "kick", ["k"], "i", "w").collect()
    assert [(r["bar"], r["bars"]) for r in rows] == [(8, 3)]
    entry = seq.entries(flags(spark, "0100111100011110010", "0" * 19), "kick", ["k"], "i", "w").first()
    assert (entry["enters"], entry["leaves"], entry["trailing"]) == (4, 14, 4)


def test_spaced_and_snapped_cuts(spark):
    df = spark.createDataFrame([([9, 3, 12, 12, 17, 38], 40)], "c array<bigint>, n int")
    assert df.select(seq.spaced(F.col("c"), F.col("n")).alias("c")).first()["c"] == [9, 17]
    one = spark.createDataFrame([(8, 0), (9, 0), (10, 0), (39, 0)], "c int, o int")
    assert [r[0] for r in one.select(seq.snapped(F.col("c"), F.col("o"), F.lit(40))).collect()] == [8, 8, 10, 39]


def test_labels(spark):
    rows = [("t", i, k, b, h, s) for i, (k, b, h, s) in enumerate([(0, 0, 1, 0), (0, 0, 1, 0), (0, 0, 1, 1), (1, 1, 1, 1), (1, 1, 1, 0), (1, 0, 1, 0), (1, 1, 1, 0), (0, 1, 0, 0)])]
    df = spark.createDataFrame(rows, "k string, i int, kick int, bass int, hats int, synths int").select("k", "i", *(F.col(c).cast("boolean").alias(c) for c in ("kick", "bass", "hats", "synths")))
    assert ordered(seq.stem_labels(df, ["k"], "i", "kick", "bass", "hats", "synths"), "label") == ["Intro", "Breakdown", "Build 1", "Drop 1", "Main", "Build 2", "Drop 2", "Outro"]


def test_merge_short_sections(spark):
    df = spark.createDataFrame([([(0, 4), (4, 4), (8, 20), (28, 3)],), ([(0, 3)],)], "s array<struct<start:bigint,bars:bigint>>")
    got = [[(x["start"], x["bars"]) for x in r["s"]] for r in df.select(seq.merge_short(F.col("s")).alias("s")).collect()]
    assert got == [[(0, 8), (8, 23)], [(0, 3)]]


def test_packs_hold_both_capacities(spark):
    df = spark.createDataFrame([([5, 5, 1, 9, 1, 20],)], "w array<bigint>")
    assert df.select(seq.pack_batches(F.col("w"), 12, 5, 2).alias("b")).first()["b"] == [0, 0, 0, 1, 1, 2]


def test_letters(spark):
    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 27, 52)], "i int")
    assert [r[0] for r in df.select(seq.letter(F.col("i"))).collect()] == ["A", "Z", "AA", "AB", "BA"]


def test_results_hang_on_no_partitioning(spark):
    df = series(spark, [random.Random(3).random() for _ in range(100)])
    a = seq.hysteresis(df.repartition(7, "i"), "v", ["k"], "i")
    assert ordered(a, "state") == ordered(seq.hysteresis(df.coalesce(1), "v", ["k"], "i"), "state")


def test_duplicate_titles_by_suffix(spark):
    rows = [(1, "a night drive", False), (2, "night drive", False), (3, "drive", False), (4, "x night drive", False), (5, "old song", True), (6, "old song", False)]
    df = spark.createDataFrame(rows, "id int, t string, done boolean")
    got = {r["id"]: r["status"] for r in parts.duplicate_titles(df, F.lit(0), "t", "id", "id", "done").collect()}
    assert got == {1: "kept", 2: "duplicate", 3: "kept", 4: "kept", 5: "processed", 6: "processed"}


def test_duplicate_titles_gathers_no_items(spark):
    names = ["a night drive", "night drive", "x night drive", "old song", "an old song"]
    df = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 5 + 1).cast("int")).alias("t"), (F.col("id") == 13).alias("done"))
    made = parts.duplicate_titles(df, F.lit(0), "t", "id", "id", "done")
    got = {r["id"]: (r["group_key"], r["status"]) for r in made.collect()}
    key = ["a night drive", "a night drive", "x night drive", "old song", "old song"]
    status = {"a night drive": "kept", "x night drive": "kept", "old song": "processed"}
    assert got == {i: (k := key[i % 5], status[k] if i in (0, 2) or k == "old song" else "duplicate") for i in range(4000)}
    # titles alone are collected: each is one row of its block before
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    gather = plan[plan.index("collect_list") :]
    assert gather.count("Aggregate [") == 1 and "_m" not in gather


def test_duplicate_titles_of_tied_ranks_and_null_titles(spark):
    rows = [(1, 5, "old song", False), (2, 5, "old song", False), (3, 7, "an old song", None), (4, 1, None, False)]
    df = spark.createDataFrame(rows, "id int, r int, t string, done boolean")
    got = {r["id"]: r["status"] for r in parts.duplicate_titles(df, F.substring_index("t", " ", -2), "t", "r", "id", "done").collect()}
    assert got == {1: "kept", 2: "kept", 3: "duplicate"}


def test_empty_series(spark):
    empty = series(spark, []).limit(0)
    assert seq.hysteresis(empty, "v", ["k"], "i").count() == 0 and seq.run_table(empty, "v", ["k"], "i").count() == 0
