"""Queries of hit groups, leak evidence, elements, form and catalogue layers over the shared tables.

Hits are events: a user's tracks are stems (event type) and groups (user),
seconds are minutes of the table's time, bars and steps come from the minute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels as lv, naming as nm
from ..operators import clips, elements as el, evidence as ev, hitgroups as hg, layers as ly, sequences as seq
from .series import _MERGED, merged_labels
from .tables import BARS, STEPS, bars, micros, steps, table

#: Seconds of a step of the events' grid, and within which two of them coincide.
STEP, NEAR = 3600.0, 1800.0


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, stem, group, hit, onset, level, bar, step, on_grid, lead_db and readings of events."""
    onset = F.floor(micros() / 1_000_000).cast("double")
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("track"), F.col("event_type").alias("stem"), (F.floor(F.col("user_id") / 50) % 2).alias("group"), F.col("event_id").alias("hit"), onset.alias("onset"), F.col("value").alias("level")
    )
    at = F.floor(F.col("onset") / STEP)
    return e.withColumns({"bar": F.floor(at / 16), "step": F.pmod(at, F.lit(16)), "on_grid": F.pmod(F.col("onset"), F.lit(STEP)) < STEP / 2})


def step_uses_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir)
    return hg.step_use(h.filter("on_grid"), h.filter("not on_grid"), ["stem", "group"], "bar", "step")


def pattern_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hg.pattern_numbers(step_uses_full(spark, sf_dir), ["stem", "group"])
    return made.select("stem", "group", *(F.round(c, 6).alias(c) if made.schema[c].dataType.simpleString() == "double" else c for c in made.columns[2:]))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as hits that were read: kind by their container, group by brand."""
    p = table(spark, sf_dir, "part")
    kind = nm._pick(["hh", "snare", "toms", "kick"], F.col("p_partkey") % 4)
    fall, noise, pitched, hz = F.col("p_size") * 4.0, F.col("p_size") / 2.0 - 14, F.col("p_partkey") % 3 != 0, F.col("p_size") * 2.0
    return p.select("p_brand", kind.alias("kind"), (F.floor(F.col("p_partkey") / 4) % 60).alias("group"), hg.hit_label(kind, fall, noise, pitched, hz).alias("label"), hz.alias("hz"))


def agreed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hg.agreed_labels(_reads(spark, sf_dir), ["p_brand", "kind", "group"], "label", "hz")


def ruled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of groups by ordered rules, with the rule or the reason."""
    numbers = hg.pattern_numbers(step_uses_full(spark, sf_dir), ["stem", "group"])
    votes = agreed_labels(spark, sf_dir).filter("p_brand = 'Brand#11'").select(F.lit("click").alias("stem"), (F.col("group") % 2).alias("group"), "agreed", "agree", "members", "pitch_hz")
    votes = votes.groupBy("stem", "group").agg(F.max("agreed").alias("agreed"), F.max("agree").alias("agree"), F.max("members").alias("members"), F.max("pitch_hz").alias("pitch_hz"))
    kind = F.when(F.col("stem").isin("view", "click"), "hh").otherwise("snare")
    hits, stability = F.col("off_total") + F.length("stem") % 5, F.when(F.col("stem") != "error", F.length("stem") / 8)
    both = numbers.join(votes, ["stem", "group"], "left").withColumn("kind", kind)
    both = both.withColumn("why", hg.why_not(hits, stability, F.lit("measured"), F.when(F.col("stem") == "purchase", F.lit(1.25))))
    return hg.by_rules(both, "kind").select("stem", "group", "why", "name", F.col("rule").isNotNull().alias("ruled"), F.col("reason").isNotNull().alias("neutral"))


def ranked_toms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("name", F.when(F.col("p_partkey") % 4 != 0, "tom").otherwise("kick"))
    return p.select("p_partkey", hg.ranked_toms(p, ["p_brand", "p_type"], "name", "p_retailprice").alias("name"))


def alike_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of event groups of one stem that play the same steps and are near."""
    use = step_uses_full(spark, sf_dir).groupBy("stem", "group").agg(F.array_sort(F.collect_list(F.struct("step", "hits"))).alias("s")).select("stem", "group", F.transform("s", lambda x: x["hits"]).alias("v"))
    a, b = (use.select("stem", F.col("group").alias(x), F.col("v").alias(f"{x}_steps")) for x in "ab")
    pairs = a.join(b, "stem").filter("a < b").withColumns({"a_nearest": F.col("b"), "b_nearest": F.lit(-1).cast("long"), "a_separation": F.length("stem") / 4.0, "b_separation": F.lit(9.0)})
    return hg.one_sound(pairs).select("stem", "a", "b")


def covered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as covered hits, suppliers modulo 4 as groups that exist."""
    li = table(spark, sf_dir, "lineitem")
    d = li.groupBy("l_orderkey", (F.col("l_suppkey") % 4).alias("g")).agg((F.min("l_quantity") / 25).alias("d"), F.count(F.lit(1)).alias("members"), (-F.min("l_linenumber") * 12.0).alias("lead_db"))
    lead = d.groupBy("l_orderkey").agg(F.min("lead_db").alias("lead_db"))
    made = d.drop("lead_db").join(lead, "l_orderkey").withColumn("medoid_lead_db", F.when(F.col("g") != 0, -50.0)).withColumn("h", F.lit(0))
    return hg.assign_covered(made, ["l_orderkey"], "h", "g", "d").select("l_orderkey", F.col("g").cast("long").alias("g"), "status")


def leak_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coincidence of every group with the groups of other stems, beside chance."""
    h = _hits(spark, sf_dir)
    others = h.select("track", F.col("stem").alias("source_stem"), F.col("group").alias("source"), "onset", "level", F.col("group").alias("owner"), "bar", "step", "on_grid")
    found = ev.coincidences(h, others, ["track"], NEAR)
    return found.select("track", "stem", "group", "source_stem", "source", "hits", "coincide", *(F.round(c, 9).alias(c) for c in ("rate", "expected", "own_expected", "louder_db")), "own_bars")


def leak_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which condition a leak fails, of rates and levels given by parts."""
    p = table(spark, sf_dir, "part")
    part = lambda k, n: F.pmod(F.col("p_partkey") * k, F.lit(n)) / n
    found = p.select(
        "p_partkey", "p_size", part(7, 20).alias("expected"), part(3, 10).alias("own_expected"), part(13, 16).alias("rate"), (part(11, 8) / 20).alias("p"),
        (F.col("p_size") / 3.0).alias("louder_db"), (1 - part(5, 6) / 2).alias("_share"), (1 - part(17, 7) / 4).alias("_strict_share"),
    )
    return ev.judged(found, F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") / 20.0)).select("p_partkey", "co_located", "strict", F.round("louder_share", 6).alias("louder_share"), "failed")


def leaking_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that leak, singly or from a union, with distances by the groups' numbers."""
    h = _hits(spark, sf_dir).withColumn("level", F.col("level") - F.length("stem") * 8)
    g = h.select("track", "stem", "group").distinct()
    o = g.select("track", F.col("stem").alias("source_stem"), F.col("group").alias("source"))
    far = g.join(o, "track").filter("stem <> source_stem").withColumn("distance", (F.col("group") + F.col("source")) * 0.75)
    return ev.leaks(h, far, ["track"], NEAR * 4)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = bars(spark, sf_dir).withColumn("db", F.when(F.col("power") > 0, lv.power_db(F.col("power") / 1e6))).withColumn("core", F.col("db") - F.col("bar") % 3 * 15)
    drop = F.pmod(F.col("track") + F.length("stem"), F.lit(5))
    ref = b.filter((F.col("bar") % 2 == 0) & (drop != 1))
    ours = b.filter((F.col("bar") % 2 == 1) & (drop != 2)).withColumn("db", F.when((F.col("stem") == "click") & (F.col("track") % 3 == 0), F.col("db") - 45).otherwise(F.col("db")))
    ours = ours.withColumn("core", F.when((F.col("stem") == "view") & (F.col("track") == 2), F.col("core") - 45).otherwise(F.col("core")))
    return el.side_levels(ref, ["track"], "stem", "bar", "db", "core"), el.side_levels(ours, ["track"], "stem", "bar", "db", "core")


def side_presences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir)[1].withColumn("level_db", F.round("level_db", 6))


def compared_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, ours = _sides(spark, sf_dir)
    return el.compare_elements(ref.withColumn("level_db", F.round("level_db", 6)), ours.withColumn("level_db", F.round("level_db", 6)), ["track"], "click")


def stem_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of discounted against full prices, months as bars, suppliers as stems."""
    li = table(spark, sf_dir, "lineitem")
    month = F.expr("CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT)")
    r, e = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = li.groupBy("l_suppkey", month.alias("month")).agg(
        F.sum(r * r).alias("ss"), F.sum(e * r).alias("se"), F.sum(e * e).alias("ee"), (F.sum(r) / 1e8).alias("ms_ref"), (F.sum(e) / 1e8).alias("ms_est"), F.count(F.lit(1)).alias("frames")
    )
    made = el.score_stems(sums, ["l_suppkey"], -80.0, 3.0)
    return made.select("l_suppkey", *(F.round(c, 4).alias(c) if made.schema[c].dataType.simpleString() == "double" else c for c in made.columns[1:]))


def predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks hold each test, over all and over unflagged ones."""
    by = steps(spark, sf_dir).groupBy("track").agg(F.sum("kick_power").alias("kick"), F.sum("bass_power").alias("bass"), F.count_if("hats").alias("hats_on"))
    tests = {"bass over kick": F.col("bass") > F.col("kick"), "hats": F.col("hats_on") > 10}
    return el.comparison_counts(by.withColumn("flag", F.col("track") % 3 == 0), ["kick", "bass", "hats_on"], "flag", tests, F.col("track") != 4)


def structure_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir).withColumn("lead", F.col("synths"))
    named = seq.numbered(merged_labels(spark, sf_dir), "label", ["track"], "section", "name").drop("label").withColumnRenamed("name", "label")
    return clips.structure_numbers(s, named, ["track"], "bar", "bars", {"lead": "lead", "bass": "bass", "kick": "kick", "hats": "hats"})


def step_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .series import change_kinds

    return clips.step_flags(change_kinds(spark, sf_dir).withColumn("k", F.lit(0)), ["k"], "win", "change").select("win", "flag")


def study_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as studies, their orders and lines as layers, the best order as profile."""
    o = table(spark, sf_dir, "orders")
    best = ly.best_profile(o.withColumn("state", F.when(F.col("o_orderstatus") == "F", "fresh").otherwise("stale")), ["o_custkey"], "state", "o_orderdate", "o_orderkey")
    profile = best.select(F.col("o_custkey").alias("c_custkey"), "state", F.struct("o_orderkey").alias("body"))
    late = o.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("k"))
    drums = late.select("c_custkey", F.lit("present").alias("state"), F.struct("k").alias("body"))
    made = ly.assembled(table(spark, sf_dir, "customer").select("c_custkey"), {"profile": profile, "drums": drums}, ["c_custkey"], {"profile": "make profile", "drums": "make drums"})
    return made.select("c_custkey", "profile_state", F.col("profile.o_orderkey").alias("best"), "drums_state", "todo")


def lookup_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as studies and lookup rows, by the number in their names."""
    a = table(spark, sf_dir, "supplier").select(F.concat(F.lit("No "), F.substring_index("s_name", "#", -1)).alias("name"), "s_suppkey")
    b = table(spark, sf_dir, "customer").select(F.concat(F.lit("NO "), F.substring_index("c_name", "#", -1)).alias("name"), "c_custkey")
    return ly.joined_lookup(a, b, "name").select("s_suppkey", "c_custkey", "match")


def rename_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("p_partkey") % 7 != 0, F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" [124]"))))
    return ly.rename_moves(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("old"), new.alias("new")), "old", "new")


def recorded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    inputs = p.select(F.concat(F.lit("/m/"), F.col("p_brand"), F.lit("/"), F.upper("p_type"), F.lit("/"), F.col("p_name")).alias("path"))
    folders = p.select(F.concat(F.lit("/m/"), F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("folder")).distinct().unionByName(spark.range(1).select(F.lit("/m/none").alias("folder")))
    return ly.recorded_paths(inputs, folders, "path", "folder")


def placed_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    have = o.select("o_custkey", F.col("o_orderkey").alias("clip"), (F.col("o_orderkey") % 64 + F.when(F.col("o_orderkey") % 3 == 0, 0.00005).otherwise(0.01)).alias("start"))
    wanted = o.select("o_custkey", (F.col("o_orderkey") % 64).cast("double").alias("position")).distinct()
    return ly.placed_clip(have, wanted, ["o_custkey"], "start", "position")


def audio_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("audio"), F.lit(4).alias("wanted"))
    return ly.audio_targets(t, ["o_custkey"], "o_orderkey", "audio", "wanted").select("o_custkey", "o_orderkey", "place")


def truth_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.select("p_partkey", F.col("p_partkey").cast("string").alias("name"))
    of = lambda n, d: p.filter(F.col("p_size") % n < 2).select(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit(d), F.col("p_name")).alias("path"))
    return ly.resolved_truth(names, of(5, "role/"), of(7, "source/"), "name", "path").select("p_partkey", "path", "state")


def usable_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    layers = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("layer"))
    return ly.usable_references(table(spark, sf_dir, "customer"), layers, ["c_custkey"], ["1-URGENT", "2-HIGH", "5-LOW"])


def key_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return ly.key_roles(o, ["o_custkey"], "o_orderpriority", ["1-URGENT", "5-LOW"])


def downbeat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of every track from the shares of kick, hats and synths."""
    from ..functions.statistics import phase_means

    s = steps(spark, sf_dir)
    shares = None
    for name, part in (("low", "kick_power"), ("high", "hats_power"), ("harmony", "synths_power")):
        own = phase_means(s, part, "bar", ["track"]).withColumnRenamed("share", name)
        shares = own if shares is None else shares.join(own, ["track", "phase"])
    made = ly.downbeat_scores(shares.withColumn("harmony", F.when(F.col("track") != 3, F.col("harmony"))), ["track"])
    return made.select("track", "phase", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "best")


def pooled_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase on which the cuts of all stems of a track fall."""
    cuts = seq.run_table(bars(spark, sf_dir), "on", ["track", "stem"], "bar")
    return ly.pooled_vote(cuts, ["track"], "first").select("track", "phase", F.round("share", 6).alias("share"), "votes", F.round("p", 7).alias("p"), "decides")


def half_tempos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tempi of two halves of every order date's parts, told where they agree."""
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 2).alias("half"), (F.floor(F.col("p_size") / 10) + 100.0).alias("bpm"), (F.col("p_retailprice") % 97).alias("score"), F.lit(104.0).alias("detected"))
    made = ly.agreed_tempo(p, ["p_brand"], "half", "bpm", "score", "detected")
    return made.select("p_brand", "bpm", F.round("ratio", 6).alias("ratio"), "agree")


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    hits = li.select("l_returnflag", (F.col("l_quantity") > 20).alias("true"))
    groups = li.groupBy("l_returnflag", "l_suppkey").agg((F.avg("l_quantity") > 25).alias("coincident"), (F.max("l_tax") > 0.075).alias("leak"))
    return ly.gate_counts(hits, groups, ["l_returnflag"])


def next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next twenty customers to take up: those without urgent orders, before the first broken one."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") < -900).alias("broken"))
    done = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return ly.run_until(c, done, "c_custkey", "c_custkey", 20, "broken").select("c_custkey", "place")


QUERIES = {f.__name__: f for f in (
    step_uses_full, pattern_numbers, agreed_labels, ruled_groups, ranked_toms, alike_groups, covered_hits, leak_evidence, leak_stages, leaking_groups, side_presences,
    compared_elements, stem_statistics, predicate_counts, structure_numbers, step_flags, study_layers, lookup_matches, rename_moves, recorded_paths, placed_clips, audio_targets,
    truth_names, usable_references, key_roles, downbeat_scores, pooled_votes, half_tempos, gate_counts, next_run,
)}

_HITS = f"""h AS (SELECT user_id % 50 AS track, event_type AS stem, CAST(floor(user_id / 50) AS BIGINT) % 2 AS "group", event_id AS hit, floor((epoch_us(ts) - 1704067200000000) / 1000000.0) AS onset, value AS level,
    CAST(floor(floor(floor((epoch_us(ts) - 1704067200000000) / 1000000.0) / {STEP}) / 16) AS BIGINT) AS bar, CAST(floor(floor((epoch_us(ts) - 1704067200000000) / 1000000.0) / {STEP}) AS BIGINT) % 16 AS step,
    floor((epoch_us(ts) - 1704067200000000) / 1000000.0) % {STEP} < {STEP / 2} AS on_grid FROM events)"""
_USE = _HITS + """, own AS (SELECT stem, "group", count(DISTINCT bar) AS own FROM h WHERE on_grid GROUP BY ALL), per AS (SELECT stem, "group", step, count(*) AS hits, count(DISTINCT bar) AS played FROM h WHERE on_grid GROUP BY ALL),
    blind AS (SELECT stem, "group", step, count(DISTINCT bar) AS lost FROM h b WHERE NOT on_grid AND EXISTS (SELECT 1 FROM h x WHERE x.on_grid AND x.stem = b.stem AND x."group" = b."group" AND x.bar = b.bar)
        AND NOT EXISTS (SELECT 1 FROM h x WHERE x.on_grid AND x.stem = b.stem AND x."group" = b."group" AND x.bar = b.bar AND x.step = b.step) GROUP BY ALL),
    us AS (SELECT o.stem, o."group", s.step, coalesce(hits, 0) AS hits, coalesce(played, 0) AS played, own, own - coalesce(lost, 0) AS observable FROM own o CROSS JOIN range(0, 16) s(step)
        LEFT JOIN per p ON p.stem = o.stem AND p."group" = o."group" AND p.step = s.step LEFT JOIN blind b ON b.stem = o.stem AND b."group" = o."group" AND b.step = s.step),
    use AS (SELECT *, CASE WHEN observable < 4 THEN 'unknown' WHEN played / observable >= 0.25 THEN 'in use' ELSE 'not in use' END AS state FROM us)"""
_KIND = lambda n, w: f"""count(*) FILTER (WHERE {w} AND state = 'in use') AS {n}_used, count(*) FILTER (WHERE {w} AND state = 'unknown') AS {n}_unknown, count(*) FILTER (WHERE {w} AND state <> 'unknown') AS {n}_known,
    count(*) FILTER (WHERE {w}) AS {n}_total, sum(CASE WHEN {w} THEN hits ELSE 0 END) / max(own) AS {n}_per_bar, sum(CASE WHEN {w} AND state <> 'unknown' AND observable > 0 THEN played / observable ELSE 0.0 END) AS {n}_density"""  # noqa: E731
_NUMBERS = _USE + f""", nums AS (SELECT stem, "group", sum(CASE WHEN step % 4 = 2 THEN hits ELSE 0 END) / sum(hits) AS share_off, {_KIND("off", "step % 4 = 2")}, {_KIND("odd", "step % 2 = 1")} FROM use GROUP BY ALL)"""
_READS = """rd AS (SELECT p_brand, ['hh', 'snare', 'toms', 'kick'][CAST(p_partkey % 4 AS INT) + 1] AS kind, CAST(floor(p_partkey / 4) AS BIGINT) % 60 AS "group", p_size * 4.0 AS fall, p_size / 2.0 - 14 AS noise, p_partkey % 3 <> 0 AS pitched, p_size * 2.0 AS hz FROM part),
    rl AS (SELECT *, CASE WHEN kind = 'hh' AND fall >= 140 THEN 'hh open' WHEN kind = 'snare' AND fall < 30 THEN 'rim' WHEN kind = 'snare' AND noise > -12 AND noise <= -1 THEN 'snare' WHEN kind = 'toms' AND pitched THEN 'tom' WHEN kind = 'kick' AND pitched AND hz <= 70 THEN 'kick' END AS label FROM rd),
    vo AS (SELECT p_brand, kind, "group", label, count(*) AS agree, median(hz) AS hz, sum(count(*)) OVER (PARTITION BY p_brand, kind, "group") AS members FROM rl GROUP BY p_brand, kind, "group", label),
    rk AS (SELECT *, label IS NOT NULL AND members >= 3 AND agree >= 2 / 3 * members - 1e-9 AS fit FROM vo),
    ag AS (SELECT p_brand, kind, "group", max(label) FILTER (WHERE fit) AS agreed, max(agree) FILTER (WHERE fit) AS agree, CAST(max(members) AS BIGINT) AS members, max(hz) FILTER (WHERE fit) AS pitch_hz FROM rk GROUP BY ALL)"""
_SIDES = BARS + """, sb AS (SELECT track, stem, bar, CASE WHEN power > 0 THEN 10 * log10(power / 1e6 + 1e-12) END AS db, (track + length(stem)) % 5 AS dr FROM bars), sc AS (SELECT *, db - bar % 3 * 15 AS core FROM sb),
    sd AS (SELECT bar % 2 AS side, track, stem AS role, bar, CASE WHEN bar % 2 = 1 AND stem = 'click' AND track % 3 = 0 THEN db - 45 ELSE db END AS db, CASE WHEN bar % 2 = 1 AND stem = 'view' AND track = 2 THEN core - 45 ELSE core END AS core FROM sc WHERE (bar % 2 = 0 AND dr <> 1) OR (bar % 2 = 1 AND dr <> 2)),
    sp AS (SELECT side, track, bar, sum(coalesce(pow(10, core / 10), 0)) AS p FROM sd GROUP BY ALL), sm AS (SELECT side, track, CASE WHEN avg(p) > 0 THEN 10 * log10(avg(p)) END AS s FROM sp GROUP BY ALL),
    sl AS (SELECT side, track, role, avg(coalesce(pow(10, db / 10), 0)) AS m, CASE WHEN count(*) FILTER (WHERE core >= s - 40) >= greatest(1, count(*) / 4) THEN 'present' WHEN count(*) FILTER (WHERE core >= s - 60) >= greatest(1, count(*) / 4) THEN 'trace' ELSE 'absent' END AS presence FROM sd JOIN sm USING (side, track) GROUP BY ALL),
    lvl AS (SELECT side, track, role, CASE WHEN presence <> 'absent' AND m > 0 THEN round(10 * log10(m), 6) END AS level_db, presence FROM sl)"""
_TAIL = "CASE WHEN {k} <= 0 THEN 1.0 ELSE (SELECT sum(exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) + i * ln({p}) + ({n} - i) * ln(1 - {p}))) FROM range(0, 2000) r(i) WHERE i >= {k} AND i <= {n}) END"
_RUNS_OF = lambda c: f"""(SELECT track, bar, {c} AS v, sum(c) OVER (PARTITION BY track ORDER BY bar) AS run FROM (SELECT track, bar, {c}, CASE WHEN {c} IS DISTINCT FROM lag({c}) OVER (PARTITION BY track ORDER BY bar) THEN 1 ELSE 0 END AS c FROM steps))"""
_STRETCH = lambda c: f"""{c}_r AS (SELECT track, run, any_value(v) AS v, min(bar) AS a, max(bar) AS b, count(*) AS n FROM {_RUNS_OF(c)} GROUP BY track, run),
    {c}_l AS (SELECT *, min(CASE WHEN v AND n >= 4 THEN a END) OVER (PARTITION BY track) AS fa, max(CASE WHEN v AND n >= 4 THEN a END) OVER (PARTITION BY track) AS la, max(CASE WHEN v AND n >= 4 THEN b END) OVER (PARTITION BY track) AS lb FROM {c}_r),
    {c}_s AS (SELECT track, max(fa) AS enters, coalesce(sum(CASE WHEN a > lb THEN n END), 0) AS trailing, count(*) FILTER (WHERE NOT v AND a > fa AND b < la) AS gaps, coalesce(max(n) FILTER (WHERE NOT v AND a > fa AND b < la), 0) AS longest, coalesce(max(n) FILTER (WHERE v), 0) AS hook FROM {c}_l GROUP BY track)"""  # noqa: E731
ORACLES = {
    "step_uses_full": f'WITH {_USE} SELECT stem, "group", step, hits, played, own, observable, state FROM use',
    "pattern_numbers": f"""WITH {_NUMBERS} SELECT stem, "group", round(share_off, 6) AS share_off, off_used, off_unknown, off_known, off_total, round(off_per_bar, 6) AS off_per_bar, round(off_density, 6) AS off_density, odd_used, odd_unknown, odd_known, odd_total, round(odd_per_bar, 6) AS odd_per_bar, round(odd_density, 6) AS odd_density FROM nums""",
    "agreed_labels": f'WITH {_READS} SELECT p_brand, kind, "group", agreed, agree, members, pitch_hz FROM ag',
    "ruled_groups": f"""WITH {_NUMBERS}, {_READS}, vv AS (SELECT 'click' AS stem, "group" % 2 AS "group", max(agreed) AS agreed, max(members) AS members FROM ag WHERE p_brand = 'Brand#11' GROUP BY 2),
        b AS (SELECT n.*, agreed, CASE WHEN n.stem IN ('view', 'click') THEN 'hh' ELSE 'snare' END AS kind, off_total + length(n.stem) % 5 AS hits, CASE WHEN n.stem <> 'error' THEN length(n.stem) / 8 END AS st, CASE WHEN n.stem = 'purchase' THEN 1.25 END AS sp FROM nums n LEFT JOIN vv ON vv.stem = n.stem AND vv."group" = n."group"),
        w AS (SELECT *, concat_ws('; ', CASE WHEN hits < 4 THEN 'only ' || hits || ' hits' END, CASE WHEN st IS NULL AND hits >= 4 THEN 'stability not measured' WHEN st < 0.75 THEN printf('stability %.2f', st) END, CASE WHEN sp <= 1.5 THEN printf('separation %.2f', sp) END) AS why FROM b),
        x AS (SELECT *, CASE WHEN why = '' THEN CASE WHEN kind = 'hh' AND share_off >= 0.9 AND off_known >= 3 AND off_known - off_used <= 1 AND off_density >= 2 THEN 'hh offbeat' WHEN kind = 'hh' AND odd_known >= 6 AND odd_known - odd_used <= 2 AND odd_density >= 4 THEN 'hh 16th' ELSE agreed END END AS name FROM w)
        SELECT stem, "group", why, name, name IS NOT NULL AS ruled, name IS NULL AS neutral FROM x""",
    "ranked_toms": """WITH t AS (SELECT p_partkey, p_brand, p_type, p_partkey % 4 <> 0 AS tom, CASE WHEN p_partkey % 4 <> 0 THEN round_even(p_retailprice, 0) END AS hz FROM part),
        r AS (SELECT *, min(hz) OVER w AS lo, max(hz) OVER w AS hi FROM t WINDOW w AS (PARTITION BY p_brand, p_type)) SELECT p_partkey, CASE WHEN NOT tom THEN 'kick' WHEN lo = hi THEN 'tom' WHEN hz = lo THEN 'tom low' WHEN hz = hi THEN 'tom high' ELSE 'tom mid' END AS name FROM r""",
    "alike_groups": f"""WITH {_USE}, p AS (SELECT a.stem, a."group" AS a, b."group" AS b, sum(CASE WHEN a.hits > 0 AND b.hits > 0 THEN 1 ELSE 0 END) / sqrt(sum(CASE WHEN a.hits > 0 THEN 1 ELSE 0 END) * sum(CASE WHEN b.hits > 0 THEN 1 ELSE 0 END)) AS c FROM use a JOIN use b ON a.stem = b.stem AND a.step = b.step AND a."group" < b."group" GROUP BY ALL)
        SELECT stem, a, b FROM p WHERE c >= 0.8 AND length(stem) / 4.0 <= 1.15 * 1.5""",
    "covered_hits": """WITH d AS (SELECT l_orderkey, l_suppkey % 4 AS g, min(l_quantity) / 25 AS d, count(*) AS m FROM lineitem GROUP BY ALL), l AS (SELECT l_orderkey, min(-l_linenumber * 12.0) AS lead FROM (SELECT l_orderkey, l_suppkey % 4 AS g, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL) GROUP BY 1),
        u AS (SELECT d.*, row_number() OVER w AS r, lead(d) OVER w AS nx FROM d JOIN l USING (l_orderkey) WHERE lead <= -14 AND (m >= 4 OR g <> 0) WINDOW w AS (PARTITION BY l_orderkey ORDER BY d, g)),
        s AS (SELECT l.l_orderkey, g, CASE WHEN lead > -14 THEN 'tail too loud' WHEN g IS NULL THEN 'no group' WHEN d > 1.5 THEN 'too far' WHEN nx < 1.15 * d THEN 'undecided' ELSE 'assigned' END AS status FROM l LEFT JOIN u ON u.l_orderkey = l.l_orderkey AND r = 1)
        SELECT l_orderkey, CAST(CASE WHEN status = 'assigned' THEN g END AS BIGINT) AS g, status FROM s""",
    "leak_evidence": f"""WITH {_HITS}, sn AS (SELECT track, max(bar) - min(bar) + 1 AS span FROM h GROUP BY 1), src AS (SELECT DISTINCT track, stem AS ss, "group" AS sg FROM h), ce AS (SELECT DISTINCT track, stem AS ss, "group" AS sg, step, bar FROM h WHERE on_grid),
        pl AS (SELECT track, ss, sg, step, count(*) AS n FROM ce GROUP BY ALL), ob AS (SELECT DISTINCT track, stem, "group", bar FROM h), oc AS (SELECT track, stem, "group", count(*) AS own_bars FROM ob GROUP BY ALL),
        om AS (SELECT o.track, o.stem, o."group", c.ss, c.sg, c.step, count(*) AS m FROM ob o JOIN ce c ON c.track = o.track AND c.bar = o.bar AND c.ss <> o.stem GROUP BY ALL),
        ex AS (SELECT h.track, h.stem, h."group", src.ss, src.sg, count(*) AS hits, avg(greatest(0.02, coalesce(n, 0) / span)) AS expected, avg(greatest(0.02, coalesce(m, 0) / own_bars)) AS own_expected, any_value(own_bars) AS own_bars
            FROM h JOIN src ON src.track = h.track AND src.ss <> h.stem JOIN sn ON sn.track = h.track JOIN oc ON oc.track = h.track AND oc.stem = h.stem AND oc."group" = h."group"
            LEFT JOIN pl ON pl.track = h.track AND pl.ss = src.ss AND pl.sg = src.sg AND pl.step = h.step LEFT JOIN om ON om.track = h.track AND om.stem = h.stem AND om."group" = h."group" AND om.ss = src.ss AND om.sg = src.sg AND om.step = h.step GROUP BY ALL),
        nr AS (SELECT a.track, a.stem, a."group", b.stem AS ss, b."group" AS sg, a.hit, arg_min(b.level - a.level, (abs(a.onset - b.onset), b.onset, b.level - a.level)) AS louder FROM h a JOIN h b ON a.track = b.track AND a.stem <> b.stem AND abs(a.onset - b.onset) <= {NEAR} GROUP BY ALL),
        co AS (SELECT track, stem, "group", ss, sg, count(*) AS coincide, median(louder) AS louder_db FROM nr GROUP BY ALL)
        SELECT ex.track, ex.stem, ex."group", ex.ss AS source_stem, ex.sg AS source, hits, coalesce(coincide, 0) AS coincide, round(coalesce(coincide, 0) / hits, 9) AS rate, round(expected, 9) AS expected, round(own_expected, 9) AS own_expected, round(louder_db, 9) AS louder_db, own_bars
        FROM ex LEFT JOIN co ON co.track = ex.track AND co.stem = ex.stem AND co."group" = ex."group" AND co.ss = ex.ss AND co.sg = ex.sg""",
    "leak_stages": """WITH f AS (SELECT p_partkey, (p_partkey * 7 % 20) / 20 AS e, (p_partkey * 3 % 10) / 10 AS o, (p_partkey * 13 % 16) / 16 AS r, (p_partkey * 11 % 8) / 8 / 20 AS p, p_size / 3.0 AS l, 1 - (p_partkey * 5 % 6) / 6 / 2 AS s, 1 - (p_partkey * 17 % 7) / 7 / 4 AS t, CASE WHEN p_partkey % 9 <> 0 THEN p_size / 20.0 END AS d FROM part),
        g AS (SELECT *, e >= 0.9 AS co, e >= 0.9 OR o >= 0.9 AS st FROM f)
        SELECT p_partkey, co AS co_located, st AS strict, round(CASE WHEN st THEN t ELSE s END, 6) AS louder_share, CASE WHEN NOT CASE WHEN co THEN r >= 0.9 ELSE r >= 0.7 AND r - e >= 0.25 AND p <= 0.01 END THEN 'coincidence'
            WHEN NOT CASE WHEN st THEN l >= 12 AND t >= 0.9 ELSE l >= 6 AND s >= 0.75 END THEN 'level' WHEN NOT coalesce(d <= CASE WHEN st THEN 1.5 ELSE 2.0 END, false) THEN 'likeness' END AS failed FROM g""",
    "side_presences": f"WITH {_SIDES} SELECT track, role, level_db, presence FROM lvl WHERE side = 1",
    "compared_elements": f"""WITH {_SIDES}, j AS (SELECT coalesce(a.track, b.track) AS track, coalesce(a.role, b.role) AS role, a.level_db AS r, a.presence AS rk, b.level_db AS o, b.presence AS ok FROM (SELECT * FROM lvl WHERE side = 0) a FULL JOIN (SELECT * FROM lvl WHERE side = 1) b ON a.track = b.track AND a.role = b.role),
        k AS (SELECT track, max(CASE WHEN role = 'click' AND rk IS NOT NULL THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN role = 'click' AND ok IS NOT NULL THEN 1 ELSE 0 END) = 1 AS us, max(r) FILTER (WHERE role = 'click') IS NULL OR coalesce(max(r) FILTER (WHERE role <> 'click') - max(r) FILTER (WHERE role = 'click') > 30, false) AS ro,
            max(o) FILTER (WHERE role = 'click') IS NULL OR coalesce(max(o) FILTER (WHERE role <> 'click') - max(o) FILTER (WHERE role = 'click') > 30, false) AS oo, arg_max(role, (r, role)) FILTER (WHERE rk = 'present' AND ok = 'present' AND role <> 'click') AS lo FROM j GROUP BY track),
        y AS (SELECT j.*, us AND (ro OR oo) AS kick_out, ro, oo, CASE WHEN us THEN CASE WHEN ro OR oo THEN lo ELSE 'click' END END AS yardstick FROM j JOIN k USING (track)),
        z AS (SELECT *, round(r - max(r) FILTER (WHERE role = yardstick) OVER w, 2) AS reference_db, round(o - max(o) FILTER (WHERE role = yardstick) OVER w, 2) AS ours_db, coalesce(rk IN ('present', 'trace'), false) AS hr, coalesce(ok IN ('present', 'trace'), false) AS ho FROM y WINDOW w AS (PARTITION BY track)),
        q AS (SELECT *, CASE WHEN role = 'click' AND kick_out THEN CASE WHEN ro AND oo THEN NULL WHEN ro THEN 'ours_only' ELSE 'reference_only' END WHEN (coalesce(rk, '') = 'present' OR coalesce(ok, '') = 'present') AND hr AND ho THEN CASE WHEN yardstick IS NOT NULL THEN 'compared' END
            WHEN rk = 'present' THEN 'reference_only' WHEN ok = 'present' THEN 'ours_only' WHEN rk = 'trace' OR ok = 'trace' THEN 'trace' ELSE 'silent' END AS kind FROM z)
        SELECT track, role, yardstick, kick_out, kind, reference_db, ours_db, CASE WHEN kind = 'compared' THEN round(ours_db - reference_db, 2) END AS difference, CASE WHEN kind = 'compared' AND rk <> ok THEN CASE WHEN rk = 'trace' THEN 'reference' ELSE 'ours' END END AS trace_side,
            kind = 'compared' AND coalesce(abs(round(ours_db - reference_db, 2)) > 1, false) AS gap FROM q WHERE kind IS NOT NULL AND NOT coalesce(role = yardstick, false)""",
    "stem_statistics": """WITH m AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS month, sum(l_extendedprice * l_extendedprice) AS ss, sum(l_extendedprice * (1 - l_discount) * l_extendedprice) AS se, sum(pow(l_extendedprice * (1 - l_discount), 2)) AS ee,
            sum(l_extendedprice) / 1e8 AS mr, sum(l_extendedprice * (1 - l_discount)) / 1e8 AS me, count(*) AS frames FROM lineitem GROUP BY ALL),
        d AS (SELECT *, 10 * log10(mr + 1e-12) AS r, 10 * log10(me + 1e-12) AS e, 10 * log10((se * se / ss + 1e-12) / (greatest(ee - se * se / ss, 0) + greatest(se * se / ss, 1) * 1e-12)) AS s FROM m),
        t AS (SELECT l_suppkey, quantile_cont(r, 0.95) FILTER (WHERE r > -80) AS tr, quantile_cont(e, 0.95) FILTER (WHERE e > -80) AS te FROM d GROUP BY 1), a AS (SELECT d.*, r > -80 AND r > tr - 3 AS a, e > -80 AND e > te - 3 AS b FROM d JOIN t USING (l_suppkey)),
        g AS (SELECT *, median(CASE WHEN a THEN e - r END) OVER (PARTITION BY l_suppkey) AS g FROM a),
        x AS (SELECT l_suppkey, 10 * log10((sum(se) * sum(se) / sum(ss) + 1e-12) / (greatest(sum(ee) - sum(se) * sum(se) / sum(ss), 0) + greatest(sum(se) * sum(se) / sum(ss), 1) * 1e-12)) AS si, sum(se) / sqrt(sum(ss) * sum(ee)) AS rho, median(s) FILTER (WHERE a) AS sm, 10 * log10((sum(ee) + 1e-30) / (sum(ss) + 1e-30)) AS lg, max(g) AS gm,
            count(*) FILTER (WHERE a) AS n, stddev_pop(r) FILTER (WHERE a) AS sd, sqrt(avg(pow(e - r - g, 2)) FILTER (WHERE a)) AS te, corr(e, r) AS c, corr(me, mr) AS cl, corr(e, r) FILTER (WHERE a) AS ca, count(*) FILTER (WHERE a = b) AS ag, count(*) AS bars, sum(frames) AS frames FROM g GROUP BY 1)
        SELECT l_suppkey, round(si, 4) AS si_sdr_db, round(rho, 4) AS rho, round(sm, 4) AS si_sdr_active_median_db, round(lg, 4) AS level_gap_db, round(gm, 4) AS level_gap_active_median_db, round(CASE WHEN n > 1 THEN sd END, 4) AS truth_sd_active_db, round(te, 4) AS track_err_active_db,
            round(CASE WHEN NOT isnan(c) THEN c END, 4) AS corr_db, round(CASE WHEN NOT isnan(cl) THEN cl END, 4) AS corr_linear, round(CASE WHEN n > 1 AND NOT isnan(ca) THEN ca END, 4) AS corr_db_active_raw, n AS bars_active_true, ag AS bars_active_agree, bars, CAST(frames AS BIGINT) AS frames,
            round(CASE WHEN n > 1 AND sd >= 2 AND NOT isnan(ca) THEN ca END, 4) AS corr_db_active FROM x""",
    "predicate_counts": f"""WITH {STEPS}, b AS (SELECT track, sum(kick_power) AS kick, sum(bass_power) AS bass, count(*) FILTER (WHERE hats) AS hats_on FROM steps GROUP BY track), l AS (SELECT track, 'bass over kick' AS test, bass > kick AS h FROM b WHERE track <> 4 UNION ALL SELECT track, 'hats', hats_on > 10 FROM b WHERE track <> 4),
        p AS (SELECT 'all' AS population, * FROM l UNION ALL SELECT 'clean', * FROM l WHERE track % 3 <> 0) SELECT population, test, count(*) FILTER (WHERE h) AS hold, count(h) AS "of" FROM p GROUP BY ALL UNION ALL SELECT 'left out', 'unusable', count(*) FILTER (WHERE track = 4), count(*) FROM b""",
    "structure_numbers": f"""WITH {_MERGED}, nm AS (SELECT track, CASE WHEN count(*) OVER (PARTITION BY track, label) > 1 THEN label || ' ' || row_number() OVER (PARTITION BY track, label ORDER BY section) ELSE label END AS label, bar, bars FROM merged), {_STRETCH("synths")}, {_STRETCH("bass")}, {_STRETCH("kick")}, {_STRETCH("hats")},
        st AS (SELECT track, CAST(sum(bars) AS BIGINT) AS bars, count(*) AS steps, count(*) FILTER (WHERE synths) AS hook_steps, CAST(sum(CASE WHEN synths THEN bars ELSE 0 END) AS BIGINT) AS hook_bars, min(bar) FILTER (WHERE synths) AS hook_first, count(*) FILTER (WHERE hats) AS hats_steps FROM steps GROUP BY track),
        dr AS (SELECT track, min(bar) FILTER (WHERE label LIKE 'Drop%') AS first_drop, sum(bars) FILTER (WHERE label = 'Drop 1') AS d1, sum(bars) FILTER (WHERE label = 'Drop 2') AS d2 FROM nm GROUP BY track)
        SELECT st.track, st.bars, st.steps, hook_steps, hook_bars, hook_first, CAST(sy.hook AS BIGINT) AS hook_longest, b.enters AS bass_enters, first_drop, b.enters < first_drop AS bass_before_drop, k.enters AS kick_enters, k.gaps AS kick_gaps, CAST(k.longest AS BIGINT) AS kick_longest_out,
            CASE WHEN k.enters IS NOT NULL THEN CAST(k.trailing AS BIGINT) END AS kick_trailing, hats_steps, h.enters IS NOT NULL AND h.gaps = 0 AS hats_constant, CASE WHEN h.enters IS NOT NULL THEN CAST(h.trailing AS BIGINT) END AS hats_trailing, CASE WHEN d1 > 0 THEN round(d2 / d1, 3) END AS drop_ratio
        FROM st JOIN synths_s sy USING (track) JOIN bass_s b USING (track) JOIN kick_s k USING (track) JOIN hats_s h USING (track) LEFT JOIN dr USING (track)""",
    "step_flags": f"""WITH {BARS}, s AS (SELECT stem, CAST(floor(bar / 4) AS BIGINT) AS win, coalesce(list(DISTINCT track) FILTER (WHERE power > 30000), []) AS s FROM bars GROUP BY ALL), p AS (SELECT *, lag(s) OVER w AS p, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY stem ORDER BY win)),
        c AS (SELECT win, i, CASE WHEN i = 1 THEN NULL WHEN len(s) > 0 AND len(p) = 0 THEN 'enter' WHEN len(s) > 0 AND len(list_filter(s, lambda x: NOT list_contains(p, x))) > 0 THEN 'vary' WHEN len(s) > 0 AND len(list_filter(p, lambda x: NOT list_contains(s, x))) > 0 THEN 'thin' WHEN len(s) > 0 THEN 'same' WHEN len(p) > 0 THEN 'leave' END AS c FROM p)
        SELECT win, CASE WHEN coalesce(bool_or(c IN ('enter', 'vary')), false) THEN NULL WHEN coalesce(bool_or(c IN ('leave', 'thin')), false) THEN 'only a removal' ELSE 'nothing new' END AS flag FROM c WHERE win > (SELECT min(win) FROM c) GROUP BY win""",
    "study_layers": """WITH b AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderstatus <> 'F', -epoch(CAST(o_orderdate AS TIMESTAMP)), o_orderkey)) AS best, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY 1), d AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT c_custkey, CASE WHEN b.o_custkey IS NULL THEN 'missing' WHEN f THEN 'fresh' ELSE 'stale' END AS profile_state, best, CASE WHEN d.o_custkey IS NULL THEN 'missing' ELSE 'present' END AS drums_state, concat_ws('; ', CASE WHEN b.o_custkey IS NULL THEN 'make profile' END, CASE WHEN d.o_custkey IS NULL THEN 'make drums' END) AS todo
        FROM customer LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN d ON d.o_custkey = c_custkey""",
    "lookup_matches": """SELECT s_suppkey, c_custkey, CASE WHEN s_suppkey IS NULL THEN 'lookup only' WHEN c_custkey IS NULL THEN 'study only' ELSE 'both' END AS match FROM supplier FULL JOIN customer ON split_part(s_name, '#', 2) = split_part(c_name, '#', 2)""",
    "rename_moves": """WITH n AS (SELECT p_partkey, p_name AS old, CASE WHEN p_partkey % 7 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' [124]' END END AS "new" FROM part) SELECT p_partkey, old, "new", "new" IS NULL AS refused FROM n WHERE "new" IS DISTINCT FROM old""",
    "recorded_paths": "SELECT '/m/' || p_brand || '/' || p_type AS folder, count(*) AS paths FROM part GROUP BY 1 UNION ALL SELECT '/m/none', 0",
    "placed_clips": """WITH w AS (SELECT DISTINCT o_custkey, CAST(o_orderkey % 64 AS DOUBLE) AS position FROM orders), c AS (SELECT o_custkey, o_orderkey AS clip, CAST(o_orderkey % 64 AS DOUBLE) AS position FROM orders WHERE o_orderkey % 3 = 0) SELECT o_custkey, position, min(clip) AS clip FROM w LEFT JOIN c USING (o_custkey, position) GROUP BY ALL""",
    "audio_targets": "WITH r AS (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS place FROM orders WHERE o_orderstatus = 'F') SELECT * FROM r WHERE place < 4",
    "truth_names": """SELECT p_partkey, CASE WHEN p_size % 5 < 2 AND p_size % 7 < 2 THEN NULL WHEN p_size % 5 < 2 THEN 'role/' || p_name WHEN p_size % 7 < 2 THEN 'source/' || p_name END AS path, CASE WHEN p_size % 5 < 2 AND p_size % 7 < 2 THEN 'ambiguous' WHEN p_size % 5 < 2 THEN 'role' WHEN p_size % 7 < 2 THEN 'source' ELSE 'missing' END AS state FROM part""",
    "usable_references": """WITH h AS (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS a, bool_or(o_orderpriority = '2-HIGH') AS b, bool_or(o_orderpriority = '5-LOW') AS c FROM orders GROUP BY 1), x AS (SELECT c_custkey, coalesce(a, false) AS a, coalesce(b, false) AS b, coalesce(c, false) AS c FROM customer LEFT JOIN h ON o_custkey = c_custkey)
        SELECT c_custkey, a AND b AND c AS usable, CASE WHEN NOT (a AND b AND c) THEN 'no ' || concat_ws(', ', CASE WHEN NOT a THEN '1-URGENT' END, CASE WHEN NOT b THEN '2-HIGH' END, CASE WHEN NOT c THEN '5-LOW' END) END AS reason FROM x""",
    "key_roles": """WITH k AS (SELECT o_custkey, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))), []) AS roles FROM orders GROUP BY 1) SELECT o_custkey, roles, len(roles) = 2 AS complete, len(roles) < 2 AS refused FROM k""",
    "downbeat_scores": f"""WITH {STEPS}, m AS (SELECT track, CAST(bar % 4 AS INT) AS phase, avg(kick_power) AS l, avg(hats_power) AS h, avg(synths_power) AS y FROM steps GROUP BY ALL), s AS (SELECT track, phase, l / sum(l) OVER w AS l, h / sum(h) OVER w AS h, y / sum(y) OVER w AS y FROM m WINDOW w AS (PARTITION BY track)),
        x AS (SELECT a.track, a.phase, 1.5 * a.l + b.l + 0.8 * (c.h + d.h) + CASE WHEN a.track <> 3 THEN 2 * a.y ELSE 0 END AS score FROM s a JOIN s b ON b.track = a.track AND b.phase = (a.phase + 2) % 4 JOIN s c ON c.track = a.track AND c.phase = (a.phase + 1) % 4 JOIN s d ON d.track = a.track AND d.phase = (a.phase + 3) % 4)
        SELECT track, phase, round(score, 6) AS score, round(score / sum(score) OVER (PARTITION BY track), 6) AS confidence, row_number() OVER (PARTITION BY track ORDER BY score DESC, phase) = 1 AS best FROM x""",
    "pooled_votes": f"""WITH {BARS}, mk AS (SELECT *, CASE WHEN playing IS DISTINCT FROM lag(playing) OVER w THEN 1 ELSE 0 END AS c FROM bars WINDOW w AS (PARTITION BY track, stem ORDER BY bar)), v AS (SELECT track, CAST(bar % 4 AS INT) AS phase, count(*) AS v FROM mk WHERE c = 1 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER w AS r, sum(v) OVER (PARTITION BY track) AS n, coalesce(lead(v) OVER w, 0) + v AS m FROM v WINDOW w AS (PARTITION BY track ORDER BY v DESC, phase DESC)),
        b AS (SELECT track, phase, v / n AS share, CAST(n AS BIGINT) AS votes, greatest({_TAIL.format(k="v", n="n", p="0.25")}, {_TAIL.format(k="v", n="m", p="0.5")}) AS p FROM r WHERE r = 1) SELECT track, phase, round(share, 6) AS share, votes, round(p, 7) AS p, votes >= 8 AND p <= 0.01 AS decides FROM b""",
    "half_tempos": """WITH t AS (SELECT p_brand, p_partkey % 2 AS half, floor(p_size / 10) + 100.0 AS bpm, p_retailprice % 97 AS s FROM part), b AS (SELECT p_brand, half, arg_min(bpm, (-s, bpm)) AS bpm FROM t GROUP BY ALL), a AS (SELECT p_brand, count(*) = 2 AND max(bpm) - min(bpm) <= 0.02 * min(bpm) AS agree, avg(bpm) AS bpm FROM b GROUP BY 1)
        SELECT p_brand, CASE WHEN agree THEN bpm END AS bpm, round(CASE WHEN agree THEN bpm / 104 END, 6) AS ratio, agree FROM a""",
    "gate_counts": """WITH g AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) > 25 AS c, max(l_tax) > 0.075 AS k FROM lineitem GROUP BY ALL), u AS (SELECT l_returnflag, count(*) FILTER (WHERE c AND NOT k) AS unmarked FROM g GROUP BY 1)
        SELECT l_returnflag, count(*) AS hits, count(*) FILTER (WHERE l_quantity <= 20) AS gated, any_value(unmarked) AS unmarked FROM lineitem JOIN u USING (l_returnflag) GROUP BY 1""",
    "next_run": """WITH s AS (SELECT c_custkey, c_acctbal < -900 AS b FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY c_custkey LIMIT 20), r AS (SELECT *, CAST(row_number() OVER (ORDER BY c_custkey) AS INT) AS place, coalesce(max(CAST(b AS INT)) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM s)
        SELECT c_custkey, place FROM r WHERE x = 0""",
}
