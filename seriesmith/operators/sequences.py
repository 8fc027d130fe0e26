"""Runs, hysteresis, blocks and other operators on ordered series.

Every operator takes the series' key columns and the order column, so that all
series of a table are worked on at once, each inside its own window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: State thresholds, shortest run, phrase length, snap distance.
ON, OFF, MIN_RUN, PHRASE, SNAP = 0.5, 0.3, 4, 8, 1


def _ordered(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def hysteresis(df: DataFrame, value: str, keys: list[str], order: str, on: float = ON, off: float = OFF, out: str = "state") -> DataFrame:
    """Two-threshold state: on above ``on``, off below ``off``, else unchanged.

    A series starts on only if its first value is above ``on``. Null values
    change nothing.
    """
    x = F.col(value)
    turn = F.when(x > on, F.lit(True)).when(x < off, F.lit(False))
    w = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False)))


def with_runs(df: DataFrame, value: str, keys: list[str], order: str, out: str = "run") -> DataFrame:
    """Number the maximal runs of equal values of each series from 1; nulls are equal."""
    w = _ordered(keys, order)
    first = F.row_number().over(w) == 1
    change = first | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn(out, F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def run_table(df: DataFrame, value: str, keys: list[str], order: str, weight: Column | None = None) -> DataFrame:
    """One row per run: keys, run, value, first, last, steps, span.

    ``span`` sums ``weight`` (1 a row by default).
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    return (
        with_runs(df.withColumn("_weight", weight), value, keys, order)
        .groupBy(*keys, "run")
        .agg(
            F.first(value).alias("value"),
            F.min(order).alias("first"),
            F.max(order).alias("last"),
            F.count(F.lit(1)).alias("steps"),
            F.sum("_weight").alias("span"),
        )
    )


def despeckle(df: DataFrame, flag: str, keys: list[str], order: str, least: int = MIN_RUN, out: str = "clean") -> DataFrame:
    """Give runs shorter than ``least`` the value of the run before them.

    A short first run takes the value of the next; a single run stays.
    """
    runs = with_runs(df, flag, keys, order, "_run")
    sized = runs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")))
    w = Window.partitionBy(*keys).orderBy("_run", order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.last(F.when(F.col("_n") >= least, F.col(flag)), ignorenulls=True).over(w)
    single = F.max("_run").over(Window.partitionBy(*keys)) == 1
    begin = F.first(flag).over(whole)
    return sized.withColumn(out, F.when(single, F.col(flag)).otherwise(F.coalesce(held, ~begin))).drop("_run", "_n")


def bridge(df: DataFrame, flag: str, keys: list[str], order: str, weight: str, min_gap: int = MIN_RUN, out: str = "bridged") -> DataFrame:
    """Fill interior off-runs whose weight is under ``min_gap``; the ends stay."""
    runs = with_runs(df, flag, keys, order, "_run")
    by_run, by_key = Window.partitionBy(*keys, "_run"), Window.partitionBy(*keys)
    sized = runs.withColumn("_span", F.sum(weight).over(by_run)).withColumn("_runs", F.max("_run").over(by_key))
    inner = (F.col("_run") > 1) & (F.col("_run") < F.col("_runs")) & (F.col("_span") < min_gap)
    return sized.withColumn(out, F.col(flag) | inner).drop("_run", "_span", "_runs")


def groove_blocks(df: DataFrame, a: str, b: str, keys: list[str], order: str, weight: str, min_gap: int = MIN_RUN, min_block: int = 8) -> DataFrame:
    """Stretches in which both flags hold, short gaps bridged.

    One row per block of ``min_block`` or more: block (from 1), bar, bars,
    lead (weight of the run of ``b`` without ``a`` that ends just before the
    block; 1 or less reads 0), lead_raw, gap_before and a_out_before (what
    lies between this block and the one before, and how much of it lacks a).
    """
    both = df.withColumn("_on", F.col(a) & F.col(b)).withColumn("_lead", F.col(b) & ~F.col(a))
    joined = bridge(both, "_on", keys, order, weight, min_gap, "_block")
    upto = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    marked = with_runs(with_runs(joined, "_lead", keys, order, "_lead_run"), "_block", keys, order, "_run")
    within = Window.partitionBy(*keys, "_lead_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w = _ordered(keys, order)
    led = (
        marked.withColumn("_led", F.when(F.col("_lead"), F.sum(weight).over(within)).otherwise(0))
        .withColumn("_before", F.coalesce(F.lag("_led").over(w), F.lit(0)))
        .withColumn("_at", F.coalesce(F.sum(weight).over(upto), F.lit(0)))
        .withColumn("_out", F.coalesce(F.sum(F.when(~F.col(a), F.col(weight)).otherwise(0)).over(upto), F.lit(0)))
    )
    found = (
        led.groupBy(*keys, "_run")
        .agg(
            F.first("_block").alias("on"),
            F.min(order).alias("bar"),
            F.sum(weight).alias("bars"),
            F.min_by("_before", order).alias("lead_raw"),
            F.min("_at").alias("_from"),
            F.min("_out").alias("_out_from"),
            F.sum(F.when(~F.col(a), F.col(weight)).otherwise(0)).alias("_out_in"),
        )
        .filter(F.col("on") & (F.col("bars") >= min_block))
    )
    by = Window.partitionBy(*keys).orderBy("bar")
    return found.select(
        *keys,
        F.row_number().over(by).alias("block"),
        "bar",
        "bars",
        F.when(F.col("lead_raw") <= 1, 0).otherwise(F.col("lead_raw")).cast("long").alias("lead"),
        F.col("lead_raw").cast("long").alias("lead_raw"),
        (F.col("_from") - F.lag(F.col("_from") + F.col("bars")).over(by)).cast("long").alias("gap_before"),
        (F.col("_out_from") - F.lag(F.col("_out_from") + F.col("_out_in")).over(by)).cast("long").alias("a_out_before"),
    )


def stretch_gaps(df: DataFrame, flag: str, keys: list[str], order: str, weight: str, least: int = MIN_RUN) -> DataFrame:
    """Off-runs strictly between a series' first and last on-run of ``least`` or more."""
    runs = run_table(df, flag, keys, order, F.col(weight))
    long = F.col("value") & (F.col("span") >= least)
    by = Window.partitionBy(*keys)
    bounds = runs.withColumn("_a", F.min(F.when(long, F.col("first"))).over(by)).withColumn("_b", F.max(F.when(long, F.col("first"))).over(by))
    return bounds.filter(~F.col("value") & (F.col("first") > F.col("_a")) & (F.col("last") < F.col("_b"))).select(*keys, F.col("first").alias("bar"), F.col("span").alias("bars"))


def entries(df: DataFrame, flag: str, keys: list[str], order: str, weight: str, least: int = MIN_RUN) -> DataFrame:
    """First and last on-run of ``least`` or more: enters, leaves, trailing weight."""
    runs = run_table(df, flag, keys, order, F.col(weight))
    long = F.col("value") & (F.col("span") >= least)
    marked = runs.withColumn("_last", F.max(F.when(long, F.col("last"))).over(Window.partitionBy(*keys)))
    return (
        marked.groupBy(*keys)
        .agg(
            F.min(F.when(long, F.col("first"))).alias("enters"),
            F.max(F.when(long, F.col("last"))).alias("leaves"),
            F.coalesce(F.sum(F.when(F.col("first") > F.col("_last"), F.col("span"))), F.lit(0)).alias("trailing"),
        )
        .filter("enters is not null")
    )


def novelty(df: DataFrame, values: list[str], keys: list[str], order: str, width: int = 4, out: str = "novelty") -> DataFrame:
    """Distance between the mean of the next ``width`` rows and of those before; the first row 0."""
    w = _ordered(keys, order)
    ahead, behind = w.rowsBetween(0, width - 1), w.rowsBetween(-width, -1)
    squares = sum(((F.avg(v).over(ahead) - F.avg(v).over(behind)) ** 2 for v in values), F.lit(0.0))
    return df.withColumn(out, F.coalesce(F.sqrt(squares), F.lit(0.0)))


def phrase_offset(df: DataFrame, value: str, keys: list[str], order: str, phrase: int = PHRASE) -> DataFrame:
    """Position in the phrase on which changes land: keys, phrase_offset.

    Each row votes for its own position, and half for both neighbours; 0 wins
    with 0.9 of the best score, and of ties the first position.
    """
    votes = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in ((0, 1.0), (1, 0.5), (-1, 0.5))))
    cast = df.select(*keys, F.col(order), F.col(value), F.explode(votes).alias("v"))
    scores = cast.groupBy(*keys, F.pmod(F.col(order) + F.col("v.d"), F.lit(phrase)).cast("int").alias("at")).agg(F.sum(F.col(value) * F.col("v.s")).alias("score"))
    best = scores.groupBy(*keys).agg(
        F.max(F.struct("score", (-F.col("at")).alias("at"))).alias("b"), F.max(F.when(F.col("at") == 0, F.col("score"))).alias("zero")
    )
    return best.select(*keys, F.when(F.coalesce("zero", F.lit(0.0)) >= 0.9 * F.col("b.score"), 0).otherwise(-F.col("b.at")).cast("int").alias("phrase_offset"))


def snapped(cut: Column, offset: Column, total: Column, phrase: int = PHRASE, snap: int = SNAP) -> Column:
    """A cut moved to its phrase line if that is within ``snap`` and inside."""
    line = offset + phrase * F.rint((cut - offset) / phrase)
    near = (F.abs(cut - line) <= snap) & (line > 0) & (line < total)
    return F.when(near, line).otherwise(cut).cast("long")


def spaced(cuts: Column, total: Column, least: int = MIN_RUN) -> Column:
    """Cuts (array) at least ``least`` from both ends and the last cut kept, greedily."""
    fits = lambda kept, c: (c >= least) & (total - c >= least) & (
        (F.size(kept) == 0) | (c - F.coalesce(F.element_at(kept, -1), F.lit(0)) >= least)
    )
    return F.aggregate(
        F.array_sort(F.array_distinct(cuts)), F.array().cast("array<bigint>"), lambda kept, c: F.when(fits(kept, c), F.concat(kept, F.array(c))).otherwise(kept)
    )


def activity_string(df: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """One '0101...' string per series, in order: keys, first, length, bits."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.when(F.col(flag), "1").otherwise("0").alias("b"))))
    return df.groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("length"), F.array_join(F.transform(pairs, lambda p: p["b"]), "").alias("bits"))


def decode_activity(df: DataFrame, bits: str, keys: list[str], first: str) -> DataFrame:
    """The inverse of :func:`activity_string`: keys, order, flag."""
    each = df.select(*keys, F.col(first).alias("_first"), F.posexplode(F.split(F.col(bits), "")).alias("_i", "_b")).filter("_b <> ''")
    return each.select(*keys, (F.col("_first") + F.col("_i")).alias("order"), (F.col("_b") == "1").alias("flag"))


def valid_activity(bits: Column, length: Column) -> Column:
    """Whether a map's strings are all of one length and of 0 and 1 only."""
    return F.forall(F.map_values(bits), lambda s: (F.length(s) == length) & s.rlike("^[01]*$"))


def unmapped(bits: Column, roles: dict[str, str]) -> Column:
    """Names of a map that stand for no role, in order."""
    return F.array_sort(F.filter(F.map_keys(bits), lambda k: ~k.isin(*roles)))


def numbered(df: DataFrame, name: str, keys: list[str], order: str, out: str = "label") -> DataFrame:
    """Number names that occur more than once in a series, in order, from 1."""
    by = Window.partitionBy(*keys, name)
    many = F.count(F.lit(1)).over(by) > 1
    return df.withColumn(out, F.when(many, F.concat_ws(" ", F.col(name), F.row_number().over(by.orderBy(order)).cast("string"))).otherwise(F.col(name)))


def stem_labels(df: DataFrame, keys: list[str], order: str, kick: str, bass: str, hats: str, synths: str) -> DataFrame:
    """Names of sections by the parts that play: adds ``name`` and ``label``."""
    w = _ordered(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(w) - 1
    flags = {"kick": kick, "bass": bass, "hats": hats, "synths": synths}
    now = {k: F.col(c) for k, c in flags.items()}
    prev = {k: F.coalesce(F.lag(c).over(w), F.lit(False)) for k, c in flags.items()}
    nxt = {k: F.coalesce(F.lead(c).over(w), F.lit(False)) for k, c in flags.items()}
    no_new, fewer = F.lit(True), F.lit(False)
    for k in flags:
        no_new = no_new & (~now[k] | prev[k])
        fewer = fewer | (prev[k] & ~now[k])
    marked = df.withColumns({"_i": i, "_n": n, "_less": no_new & fewer} | {f"_p{k}": c for k, c in prev.items()} | {f"_n{k}": c for k, c in nxt.items()})
    last = (F.col("_i") == F.col("_n") - 1) & (~(now["kick"] & now["bass"]) | F.col("_less"))
    name = (
        F.when(F.col("_i") == 0, "Intro")
        .when(last, "Outro")
        .when(~now["kick"], F.when(F.col("_nkick") & now["hats"] & (F.col("_i") > 1), "Build").otherwise("Breakdown"))
        .when(~F.col("_pkick"), F.when(now["bass"], "Drop").otherwise("Build"))
        .when(now["bass"], F.when(F.col("_pbass"), "Main").otherwise("Drop"))
        .otherwise(F.when(F.col("_nbass"), "Build").otherwise("Main"))
    )
    named = marked.withColumn("name", name).drop("_i", "_n", "_less", *(f"_{x}{k}" for k in flags for x in "pn"))
    return numbered(named, "name", keys, order)


def energy_labels(df: DataFrame, energy: str, keys: list[str], order: str, quiet: float = 0.75, full: float = 1.12) -> DataFrame:
    """Names of sections by loudness relative to the mean: adds ``name`` and ``label``."""
    w = _ordered(keys, order)
    level = F.when(F.col(energy) < quiet, "quiet").when(F.col(energy) > full, "full").otherwise("mid")
    marked = df.withColumn("_l", level)
    marked = marked.withColumns(
        {"_p": F.lag("_l").over(w), "_x": F.lead("_l").over(w), "_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
    )
    l = F.col("_l")
    name = (
        F.when(F.col("_i") == 1, "Intro")
        .when(F.col("_i") == F.col("_n"), "Outro")
        .when(l == "full", F.when(F.col("_p") == "full", "Main").otherwise("Drop"))
        .when(l == "quiet", F.when(F.col("_p") == "full", "Break").otherwise("Quiet"))
        .otherwise(F.when(F.col("_x") == "full", "Build").otherwise("Mid"))
    )
    return numbered(marked.withColumn("name", name).drop("_l", "_p", "_x", "_i", "_n"), "name", keys, order)


def letter(i: Column) -> Column:
    """A, B, ... Z, AA, AB, ... for index 0, 1, ... (two letters at most)."""
    low = F.char((F.lit(65) + i % 26).cast("long"))
    return F.when(i < 26, low).otherwise(F.concat(F.char((F.lit(64) + F.floor(i / 26)).cast("long")), low))


def change_comment(df: DataFrame, parts: str, keys: list[str], order: str, ranked: list[str], most: int = 2) -> DataFrame:
    """Text of up to ``most`` parts that came in or went out since the row before."""
    prev = F.lag(parts).over(_ordered(keys, order))
    texts = [
        F.when(F.array_contains(parts, r) & ~F.array_contains("_prev", r), f"{r} in").when(F.array_contains("_prev", r) & ~F.array_contains(parts, r), f"{r} out")
        for r in ranked
    ]
    found = F.slice(F.filter(F.array(*texts), lambda t: t.isNotNull()), 1, most)
    return df.withColumn("_prev", prev).withColumn("comment", F.when(F.col("_prev").isNull(), "").otherwise(F.array_join(found, ", "))).drop("_prev")


def change_kinds(df: DataFrame, items: str, keys: list[str], order: str) -> DataFrame:
    """Change of a set of sounding items against the row before: adds ``change``.

    Null on the first row; enter, vary (something new), thin (something
    gone), same; leave when nothing is left.
    """
    w = _ordered(keys, order)
    now, prev = F.coalesce(F.col(items), F.array()), F.lag(F.coalesce(F.col(items), F.array())).over(w)
    marked = df.withColumn("_p", prev).withColumn("_f", F.row_number().over(w) == 1)
    kind = (
        F.when(F.col("_f"), F.lit(None).cast("string"))
        .when((F.size(now) > 0) & (F.size("_p") == 0), "enter")
        .when((F.size(now) > 0) & (F.size(F.array_except(now, F.col("_p"))) > 0), "vary")
        .when((F.size(now) > 0) & (F.size(F.array_except(F.col("_p"), now)) > 0), "thin")
        .when(F.size(now) > 0, "same")
        .when(F.size("_p") > 0, "leave")
    )
    return marked.withColumn("change", kind).drop("_p", "_f")


def merge_labels(df: DataFrame, label: str, keys: list[str], order: str, weight: str) -> DataFrame:
    """Sections of adjacent equal labels: keys, section, label, bar (running, from 1), bars."""
    upto = _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    running = df.withColumn("_bar", F.coalesce(F.sum(weight).over(upto), F.lit(0)) + 1)
    return (
        with_runs(running, label, keys, order, "section")
        .groupBy(*keys, "section")
        .agg(F.first(label).alias("label"), F.min("_bar").alias("bar"), F.sum(weight).alias("bars"))
    )


def mains_after(df: DataFrame, label: str, keys: list[str], order: str, weight: str, head: str = "Drop", tail: str = "Main") -> DataFrame:
    """Rows labelled ``head...`` with the weight of the ``tail...`` rows directly after each."""
    kind = F.when(F.col(label).startswith(head), "h").when(F.col(label).startswith(tail), "t").otherwise("o")
    w = _ordered(keys, order)
    marked = df.withColumn("_k", kind)
    group = F.sum((F.col("_k") != "t").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    by = Window.partitionBy(*keys, "_g")
    summed = marked.withColumn("_g", group).withColumn("mains_after", F.coalesce(F.sum(F.when(F.col("_k") == "t", F.col(weight))).over(by), F.lit(0)))
    return summed.filter("_k = 'h'").drop("_k", "_g")


def first_stable(df: DataFrame, index: str, keys: list[str], phase: Column, least: int = 16, cycle: int = 4) -> DataFrame:
    """Earliest index of the phase that ``least`` consecutive indices follow: keys, stable.

    Without one, the earliest index of the phase; without that, the earliest.
    """
    seen = df.select(*keys, F.col(index).alias("k"), phase.alias("_phase")).distinct()
    island = seen.withColumn("_g", F.col("k") - F.row_number().over(Window.partitionBy(*keys).orderBy("k")))
    ends = island.withColumn("_end", F.max("k").over(Window.partitionBy(*keys, "_g")))
    own = F.pmod(F.col("k") - F.col("_phase"), F.lit(cycle)) == 0
    return ends.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(own & (F.col("_end") - F.col("k") + 1 >= least), F.col("k"))), F.min(F.when(own, F.col("k"))), F.min("k")).alias("stable")
    )


def plan_spans(df: DataFrame, start: str, keys: list[str], total: str, least: int = 1) -> DataFrame:
    """Spans to the next start (the last to ``total``), short ones skipped, numbered from 0."""
    w = _ordered(keys, start)
    stop = F.coalesce(F.lead(start).over(w), F.col(total))
    sized = df.withColumn("span", F.floor(stop - F.col(start) + 1e-6)).filter(F.col("span") >= least)
    return sized.withColumn("slot", (F.row_number().over(w) - 1).cast("int"))


def merge_short(sections: Column, least: int = 8) -> Column:
    """Merge (start, bars) structs shorter than ``least`` into the next; the last into the one before.

    ``sections`` is an array sorted by start.
    """
    kind = "array<struct<start:bigint,bars:bigint>>"

    def step(acc: Column, s: Column) -> Column:
        tail = F.element_at(acc, -1)
        grown = F.struct(tail["start"].alias("start"), (tail["bars"] + s["bars"]).alias("bars"))
        return F.when((F.size(acc) > 0) & (tail["bars"] < least), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    def finish(acc: Column) -> Column:
        a, b = F.element_at(acc, -2), F.element_at(acc, -1)
        joined = F.struct(a["start"].alias("start"), (a["bars"] + b["bars"]).alias("bars"))
        return F.when((F.size(acc) > 1) & (b["bars"] < least), F.concat(F.slice(acc, 1, F.size(acc) - 2), F.array(joined))).otherwise(acc)

    return F.aggregate(sections, F.array().cast(kind), step, finish)


def pack_batches(weights: Column, most: int, heavy_from: int, most_heavy: int) -> Column:
    """Batch number of each of an array of weights, in order, under two capacities."""
    start = F.struct(F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("w"), F.lit(0).alias("h"), F.array().cast("array<int>").alias("out"))
    def step(s: Column, w: Column) -> Column:
        heavy = (w >= heavy_from).cast("int")
        full = (s["w"] > 0) & ((s["w"] + w > most) | (s["h"] + heavy > most_heavy))
        b = F.when(full, s["b"] + 1).otherwise(s["b"])
        return F.struct(
            b.alias("b"),
            F.when(full, w).otherwise(s["w"] + w).cast("bigint").alias("w"),
            F.when(full, heavy).otherwise(s["h"] + heavy).alias("h"),
            F.concat(s["out"], F.array(b)).alias("out"),
        )

    return F.aggregate(weights, start, step, lambda s: s["out"])
