"""Operators that sum up, pair and check whole studies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A block of so many bars is no teaser; a groove this early is no arrival.
SHORT_BLOCK, EARLY_BARS = 16, 8


def block_profile(blocks: DataFrame, keys: list[str], short: int = SHORT_BLOCK, early: int = EARLY_BARS) -> DataFrame:
    """Comparable numbers of each key's groove blocks, and flags of what moves them.

    ``blocks`` as from ``sequences.groove_blocks``; bars count from 0.
    """
    nth = lambda n, c: F.max(F.when(F.col("block") == n, F.col(c)))
    long = F.row_number().over(Window.partitionBy(*keys, "_long").orderBy("block"))
    marked = blocks.withColumn("_long", F.col("bars") >= short).withColumn("_l", F.when(F.col("_long"), long))
    major = lambda n: F.max(F.when(F.col("_l") == n, F.col("bars")))
    made = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_blocks"), nth(1, "bar").alias("bars_before_block1"), nth(1, "bars").alias("block1_bars"), nth(2, "bars").alias("block2_bars"),
        F.round(nth(2, "bars") / nth(1, "bars"), 3).alias("block_ratio"), major(1).alias("major1_bars"), major(2).alias("major2_bars"),
        nth(2, "a_out_before").alias("out_before_block2"), nth(1, "lead").alias("lead1"), nth(2, "lead").alias("lead2"),
    )
    flags = F.concat_ws(
        "; ",
        F.when(F.col("bars_before_block1") < early, f"groove already on in the first {early} bars"),
        F.when(F.least("block1_bars", "block2_bars") < short, f"a block under {short} bars"),
        F.when(F.col("n_blocks") > 2, F.concat(F.lit("later blocks not compared ("), F.col("n_blocks").cast("string"), F.lit(" blocks)"))),
    )
    return made.withColumn("flags", flags)


def warp_map(segments: DataFrame, keys: list[str], order: str, period: str, beats: str) -> DataFrame:
    """(beat, sec) at each segment's start and at the end, by running sums: keys, i, beat, sec."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ends = segments.select(*keys, F.row_number().over(w).alias("i"), F.sum(beats).over(upto).cast("double").alias("beat"), F.sum(F.col(beats) * F.col(period)).over(upto).alias("sec"))
    start = segments.select(*keys).distinct().select(*keys, F.lit(0).alias("i"), F.lit(0.0).alias("beat"), F.lit(0.0).alias("sec"))
    return start.unionByName(ends)


def rising(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows that don't lie above the row before in every column; none in a valid map."""
    w = Window.partitionBy(*keys).orderBy(order)
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c) <= F.lag(c).over(w))
    return df.withColumn("_bad", F.coalesce(bad, F.lit(False))).filter("_bad").drop("_bad")


def same_shape(df: DataFrame, keys: list[str], a: str, b: str, tolerance: float = 0.3) -> DataFrame:
    """Whether two curves differ by a constant only: keys, offset, widest, same."""
    d = F.col(a) - F.col(b)
    offset = df.withColumn("_d", d).withColumn("_m", F.median(d).over(Window.partitionBy(*keys)))
    made = offset.groupBy(*keys).agg(F.max("_m").alias("offset"), F.max(F.abs(F.col("_d") - F.col("_m"))).alias("widest"))
    return made.withColumn("same", F.col("widest") <= tolerance)


def wins(df: DataFrame, keys: list[str], a: str, b: str, active: str) -> DataFrame:
    """Share of active rows where b beats a, and the median difference."""
    own = F.when(F.col(active), F.col(b) - F.col(a))
    return df.groupBy(*keys).agg(F.count(own).alias("n"), F.avg((own > 0).cast("int")).alias("won"), F.median(own).alias("gap"))


def score_table(scores: DataFrame, label: str, file: str, score: str, files: list[str], floor: float) -> DataFrame:
    """Labels by files; scores under the floor read as censored text."""
    text = F.when(F.col(score) < floor, F.concat(F.lit("<"), F.format_number(F.lit(floor), 0))).otherwise(F.format_number(score, 1))
    return scores.withColumn("_t", text).groupBy(label).pivot(file, files).agg(F.max("_t"))


def best_evidence(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The strongest pair of every key."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def paired_sections(plan: DataFrame, profile: DataFrame, keys: list[str], name: str, override: str) -> DataFrame:
    """Plan sections with the profile section of their override or name; whether the range fits.

    ``plan(offset, length)`` must lie inside ``profile(bar, bars)``.
    """
    other = profile.select(*keys, F.col(name).alias("_to"), "bar", "bars")
    both = plan.withColumn("_to", F.coalesce(override, name)).join(other, [*keys, "_to"], "left")
    fits = F.coalesce(F.col("offset") + F.col("length") <= F.col("bars"), F.lit(False))
    return both.withColumn("fits", fits).withColumnRenamed("_to", "paired")


def inherited(tracks: DataFrame, keys: list[str], node: str, parent: str, flag: str, levels: int = 3) -> DataFrame:
    """A flag that holds for a node if it or one of its next ``levels`` parents has it."""
    own = tracks.select(*keys, node, parent, F.col(flag).alias("_f"))
    found = own.withColumn("_at", F.col(parent))
    above = own.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(node).alias("_n"), F.col(parent).alias("_p"), F.col("_f").alias("_pf"))
    for _ in range(levels):
        on = F.col("_at") == F.col("_n")
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{k}"))
        found = found.join(above, on, "left").select(*keys, node, parent, (F.col("_f") | F.coalesce("_pf", F.lit(False))).alias("_f"), F.col("_p").alias("_at"))
    return found.select(*keys, node, F.col("_f").alias(flag))


def uniform_format(files: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Whether a key's files share their format: keys, formats, uniform."""
    made = files.groupBy(*keys).agg(F.countDistinct(F.struct(*columns)).alias("formats"))
    return made.withColumn("uniform", F.col("formats") == 1)


def format_problems(files: DataFrame, keys: list[str], columns: list[str], bars: str, declared: str, within: float = 0.01) -> DataFrame:
    """What keeps a key's files from being one pack: keys, problem; fine keys give no row.

    Formats must be equal, and every file's bars within ``within`` of the
    number that is declared.
    """
    made = files.groupBy(*keys).agg(F.countDistinct(F.struct(*columns)).alias("_f"), F.max(F.abs(F.col(bars) - F.col(declared))).alias("_d"))
    problem = F.concat_ws("; ", F.when(F.col("_f") > 1, F.concat(F.col("_f").cast("string"), F.lit(" formats"))), F.when(F.col("_d") > within, "other bars than declared"))
    return made.select(*keys, problem.alias("problem")).filter("problem <> ''")


def owned(hits: DataFrame, sections: DataFrame, keys: list[str], time: str, early: float = 0.020) -> DataFrame:
    """Hits that belong to the section they were cut for.

    Sections read a halo on both sides; a hit is owned by the section whose
    lines, moved ``early`` earlier, enclose it.
    """
    both = hits.join(sections, [*keys, "section"])
    return both.filter((F.col(time) >= F.col("start") - early) & (F.col(time) < F.col("stop") - early)).select(*hits.columns)


def with_halo(points: DataFrame, keys: list[str], time: str, width: float, halo: float) -> DataFrame:
    """Points by section of equal width, copied to neighbours whose halo they lie in."""
    s = F.floor(F.col(time) / width)
    near = F.array_distinct(F.array(s, F.floor((F.col(time) - halo) / width), F.floor((F.col(time) + halo) / width)))
    return points.select("*", F.explode(near).alias("section"))


def representative(hits: DataFrame, keys: list[str], loud: str, lead: str, room: str, onset: str) -> DataFrame:
    """One complete, clean hit of every key.

    Within 6 dB of the median loudness, with room of 0.9 of the median at
    least, those with the quietest lead and, of equals, the earliest; a key
    none of whose hits qualify gives its earliest.
    """
    by = Window.partitionBy(*keys)
    marked = hits.withColumn("_l", F.median(loud).over(by)).withColumn("_r", F.median(room).over(by))
    fine = (F.abs(F.col(loud) - F.col("_l")) <= 6) & (F.col(room) >= 0.9 * F.col("_r"))
    order = [F.when(fine, 0).otherwise(1), F.when(fine, F.col(lead)).asc_nulls_last(), F.col(onset)]
    return marked.withColumn("clean", fine).withColumn("_n", F.row_number().over(by.orderBy(*order))).filter("_n = 1").drop("_l", "_r", "_n")


def standardised(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation (1 where there is none)."""
    by = Window.partitionBy(*keys)
    made = {}
    for c in columns:
        sd = F.stddev_pop(c).over(by)
        made[c] = (F.col(c) - F.avg(c).over(by)) / F.when(sd < 1e-9, 1.0).otherwise(sd)
    return df.withColumns(made)


def analysis_mix(samples: DataFrame, keys: list[str], index: str, value: str, peak: float = 0.9) -> DataFrame:
    """Sum of all stems, the shorter ones padded by nothing, brought to one peak."""
    total = samples.groupBy(*keys, index).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("mix"))
    top = F.max(F.abs("mix")).over(Window.partitionBy(*keys))
    return total.withColumn("mix", F.when(top > 0, F.col("mix") * peak / top).otherwise(0.0))


def boundary_vote(cuts: DataFrame, keys: list[str], at: str, cycle: int = 4) -> DataFrame:
    """Phase most boundaries fall on and how likely so many are by chance: keys, phase, votes, n, p.

    p is the larger of two binomial tails: against even phases, and against
    the runner-up at one half.
    """
    from ..functions.statistics import binomial_tail

    votes = cuts.groupBy(*keys, F.pmod(F.col(at), F.lit(cycle)).alias("phase")).agg(F.count(F.lit(1)).alias("v"))
    by = Window.partitionBy(*keys)
    order = by.orderBy(F.desc("v"), "phase")
    ranked = votes.withColumn("_r", F.row_number().over(order)).withColumn("n", F.sum("v").over(by)).withColumn("_next", F.coalesce(F.lead("v").over(order), F.lit(0)))
    best = ranked.filter("_r = 1")
    p = F.greatest(binomial_tail(F.col("n"), F.col("v"), 1 / cycle), binomial_tail(F.col("v") + F.col("_next"), F.col("v"), 0.5))
    return best.select(*keys, "phase", F.col("v").alias("votes"), "n", p.alias("p"))


def named_groups(groups: DataFrame, alike: DataFrame, keys: list[str], node: str, name: str, rank: str) -> DataFrame:
    """Name groups as their union and number duplicates: keys, node, union, label.

    Alike groups (pairs a, b of equal name) fall together; a union's number is
    its least node. Unions are numbered by rank where a name has several. A
    key's few groups and pairs make one small graph, joined in a kernel.
    """
    kinds = ", ".join(f"{k} {groups.schema[k].dataType.simpleString()}" for k in keys)
    kind = groups.schema[node].dataType.simpleString()
    edges = alike.select(*keys, "a", "b").unionByName(groups.select(*keys, F.col(node).alias("a"), F.col(node).alias("b")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = {x: x for x in sorted(set(pdf.a) | set(pdf.b))}

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for a, b in zip(pdf.a, pdf.b):
            low, high = sorted((find(a), find(b)))
            top[high] = low
        made = pd.DataFrame({node: list(top), "union": [find(x) for x in top]})
        for k in reversed(keys):
            made.insert(0, k, pdf[k].iloc[0])
        return made

    label = edges.groupBy(*keys).applyInPandas(run, f"{kinds}, {node} {kind}, union {kind}")
    named = groups.join(label, [*keys, node])
    unions = named.groupBy(*keys, "union").agg(F.min(name).alias("_name"), F.min(rank).alias("_rank"))
    by = Window.partitionBy(*keys, "_name")
    many = F.count(F.lit(1)).over(by) > 1
    numbered = unions.withColumn("label", F.when(many, F.concat_ws(" ", "_name", F.row_number().over(by.orderBy("_rank", "union")).cast("string"))).otherwise(F.col("_name")))
    return named.join(numbered.select(*keys, "union", "label"), [*keys, "union"]).select(*keys, node, "union", "label")
