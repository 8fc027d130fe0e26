"""Naming groups of hits: pattern numbers, eligibility, ordered rules, placing of covered hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.placement import enough

#: Hits and stability a name asks for, and the distance at which groups are one.
NAME_HITS, NAME_STABILITY, APART = 4, 0.75, 1.5
#: Offbeats (share of hits, in use of 4, known, hits a bar) and odd steps (of 8).
OFF_SHARE, OFF_STEPS, OFF_KNOWN, OFF_DENSITY = 0.9, 3, 3, 2.0
ODD_STEPS, ODD_KNOWN, ODD_DENSITY = 6, 6, 4.0
#: Readings of a hit (ms, dB, Hz) and the agreement of the members that were read.
OPEN_MS, RIM_MS, NOISE_LOW, NOISE_HIGH, KICK_HZ = 140.0, 30.0, -12.0, -1.0, 70.0
AGREE_LEAST, AGREE_SHARE = 3, 2 / 3
#: Nearness and likeness of patterns of groups that may be one sound.
NEAR, SAME_PATTERN = 1.15, 0.8
#: How far a covered hit's tail lies under it to be compared whole or at all, how
#: much nearer the nearest group must be, and when a small group takes hits.
WHOLE_DB, SHORT_DB, MARGIN, SMALL, QUIET_DB = -24.0, -14.0, 1.15, 4, -40.0


def step_use(hits: DataFrame, blind: DataFrame, keys: list[str], bar: str, step: str, known: int = 4, used: float = 0.25, steps: int = 16) -> DataFrame:
    """How a key plays on every step: keys, step, hits, played, own, observable, state.

    ``own`` counts the bars a key plays in, ``played`` those in which it plays
    the step, ``observable`` those in which the step could be seen: all but
    the blind (bar, step) cells at which it isn't heard.
    """
    at = F.col(step).cast("long").alias("step")
    per = hits.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct(bar).alias("played"))
    bars = hits.select(*keys, bar).distinct()
    own = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("own"))
    heard = hits.select(*keys, bar, at).distinct()
    hidden = blind.select(*keys, bar, at).distinct().join(bars, [*keys, bar], "left_semi").join(heard, [*keys, bar, "step"], "left_anti")
    lost = hidden.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("_h"))
    grid = own.select(*keys, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("step"))
    each = grid.join(per, [*keys, "step"], "left").join(lost, [*keys, "step"], "left").na.fill(0, ["hits", "played", "_h"])
    observable = F.col("own") - F.col("_h")
    share = F.when(observable > 0, F.col("played") / observable).otherwise(0.0)
    state = F.when(observable < known, "unknown").when(share >= used, "in use").otherwise("not in use")
    return each.select(*keys, "step", "hits", "played", "own", observable.alias("observable"), state.alias("state"))


def pattern_numbers(use: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of the offbeats (step 2 of 4) and the odd steps of every key's ``step_use`` rows.

    keys, share_off, then for off and odd: used, unknown, known, total,
    per_bar (hits over own bars) and density (the known steps' shares of
    their observable bars, summed).
    """
    kinds = {"off": F.col("step") % 4 == 2, "odd": F.col("step") % 2 == 1}
    known = F.col("state") != "unknown"
    made = []
    for name, own in kinds.items():
        made += [
            F.count_if(own & (F.col("state") == "in use")).alias(f"{name}_used"),
            F.count_if(own & ~known).alias(f"{name}_unknown"),
            F.count_if(own & known).alias(f"{name}_known"),
            F.count_if(own).alias(f"{name}_total"),
            (F.sum(F.when(own, F.col("hits")).otherwise(0)) / F.max("own")).alias(f"{name}_per_bar"),
            F.sum(F.when(own & known & (F.col("observable") > 0), F.col("played") / F.col("observable")).otherwise(0.0)).alias(f"{name}_density"),
        ]
    total = F.sum("hits")
    share = F.when(total > 0, F.sum(F.when(kinds["off"], F.col("hits")).otherwise(0)) / total).otherwise(0.0)
    return use.groupBy(*keys).agg(share.alias("share_off"), *made)


def hit_label(kind: Column, fall_20_ms: Column, noise_db: Column, pitched: Column, pitch_hz: Column) -> Column:
    """What one hit's readings say it is, by the kind of its stem; null for nothing."""
    return (
        F.when((kind == "hh") & (fall_20_ms >= OPEN_MS), "hh open")
        .when((kind == "snare") & (fall_20_ms < RIM_MS), "rim")
        .when((kind == "snare") & (noise_db > NOISE_LOW) & (noise_db <= NOISE_HIGH), "snare")
        .when((kind == "toms") & pitched, "tom")
        .when((kind == "kick") & pitched & (pitch_hz <= KICK_HZ), "kick")
    )


def agreed_labels(reads: DataFrame, keys: list[str], label: str, pitch: str) -> DataFrame:
    """The label that enough of a key's read members have: keys, agreed, agree, members, pitch_hz.

    Without agreement, or with fewer members than AGREE_LEAST, ``agreed`` is
    null. ``pitch_hz`` is the median of the members that agree.
    """
    votes = reads.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("agree"), F.median(pitch).alias("pitch_hz"))
    total = votes.withColumn("members", F.sum("agree").over(Window.partitionBy(*keys)))
    best = F.max(F.when(F.col(label).isNotNull() & (F.col("members") >= AGREE_LEAST) & (F.col("agree") >= AGREE_SHARE * F.col("members") - 1e-9), F.struct("agree", F.col(label).alias("l"), "pitch_hz")))
    found = total.groupBy(*keys).agg(best.alias("b"), F.max("members").alias("members"))
    return found.select(*keys, F.col("b.l").alias("agreed"), F.col("b.agree").alias("agree"), "members", F.col("b.pitch_hz").alias("pitch_hz"))


def why_not(hits: Column, stability: Column, status: Column, separation: Column, threshold: float = APART) -> Column:
    """Reasons why a group may not be named, joined by "; "; empty when it may.

    Too few hits; stability not measured (unless no regrouping could differ)
    or too low; no further than the threshold from its nearest rival. A group
    without a rival has no separation and passes that.
    """
    few = F.when(hits < NAME_HITS, F.concat(F.lit("only "), hits.cast("string"), F.lit(" hits")))
    unmeasured = stability.isNull() & (hits >= NAME_HITS) & ~F.coalesce(status == "stable by construction", F.lit(False))
    shaky = F.when(unmeasured, "stability not measured").when(stability < NAME_STABILITY, F.format_string("stability %.2f", F.bround(stability, 2)))
    close = F.when(separation <= threshold, F.format_string("separation %.2f", F.bround(separation, 2)))
    return F.concat_ws("; ", few, shaky, close)


def by_rules(groups: DataFrame, kind: str) -> DataFrame:
    """Adds ``name`` and ``rule`` of the first rule that fits, or ``reason``.

    ``groups`` has the columns of ``pattern_numbers`` and ``agreed_labels``
    and ``why`` of ``why_not``. The patterns of hats come first, then what the
    members that were read agree on. A group with a reason has no name.
    """
    c, hats = F.col, F.col(kind) == "hh"
    offbeat = hats & (c("share_off") >= OFF_SHARE) & enough(c("off_used"), c("off_known"), 4, OFF_STEPS, OFF_KNOWN) & (c("off_density") >= OFF_DENSITY)
    odd = hats & enough(c("odd_used"), c("odd_known"), 8, ODD_STEPS, ODD_KNOWN) & (c("odd_density") >= ODD_DENSITY)
    may = F.coalesce(c("why"), F.lit("")) == ""
    name = F.when(offbeat, "hh offbeat").when(odd, "hh 16th").otherwise(c("agreed"))
    rule = F.when(
        offbeat, F.format_string("%.0f %% on offbeats, %d of %d known in use, %.1f a bar", c("share_off") * 100, c("off_used"), c("off_known"), c("off_density"))
    ).when(odd, F.format_string("%d of %d known odd steps in use, %.1f a bar", c("odd_used"), c("odd_known"), c("odd_density"))).when(
        c("agreed").isNotNull(), F.format_string("%d of %d members", c("agree"), c("members"))
    )
    unruled = F.concat_ws(
        "; ",
        F.when(hats & (c("odd_known") < ODD_KNOWN), F.format_string("only %d of 8 odd steps known", c("odd_known"))),
        F.when(hats & (c("off_known") < OFF_KNOWN), F.format_string("only %d of 4 offbeats known", c("off_known"))),
        F.when(F.coalesce(c("members"), F.lit(0)) < AGREE_LEAST, F.format_string("only %d members read", F.coalesce(c("members"), F.lit(0)))).otherwise("members disagree"),
    )
    made = groups.withColumn("name", F.when(may, name)).withColumn("rule", F.when(may, rule))
    return made.withColumn("reason", F.when(~may, F.concat(F.lit("not named: "), c("why"))).when(c("name").isNull(), F.concat(F.lit("no rule fits: "), unruled)))


def ranked_toms(groups: DataFrame, keys: list[str], name: str, pitch: str) -> Column:
    """Name with toms ranked low, mid and high by whole Hz among a key's, if there are several pitches."""
    by, tom = Window.partitionBy(*keys), F.col(name) == "tom"
    hz = F.when(tom, F.rint(F.col(pitch)))
    low, high = F.min(hz).over(by), F.max(hz).over(by)
    rank = F.when(hz == low, "tom low").when(hz == high, "tom high").otherwise("tom mid")
    return F.when(tom & (low < high), rank).otherwise(F.col(name))


def alike(a: Column, b: Column) -> Column:
    """Cosine of two arrays of step counts, by presence; 0 for an empty one."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("int")), F.lit(0), lambda n, x: n + x)
    size = lambda v: F.size(F.filter(v, lambda x: x > 0))
    return F.when((size(a) > 0) & (size(b) > 0), both / F.sqrt(size(a) * size(b))).otherwise(0.0)


def one_sound(pairs: DataFrame, threshold: float = APART) -> DataFrame:
    """Pairs of groups that may be one sound: near, one being the other's nearest, and alike in pattern.

    ``pairs`` has a, b, their nearest (a_nearest, b_nearest), separations and
    arrays of step counts (a_steps, b_steps).
    """
    near = lambda x, y: (F.col(f"{x}_nearest") == F.col(y)) & (F.col(f"{x}_separation") <= NEAR * threshold)
    close = F.coalesce(near("a", "b"), F.lit(False)) | F.coalesce(near("b", "a"), F.lit(False))
    return pairs.filter(close & (alike(F.col("a_steps"), F.col("b_steps")) >= SAME_PATTERN))


def assign_covered(distances: DataFrame, keys: list[str], hit: str, group: str, distance: str, threshold: float = APART) -> DataFrame:
    """Place hits that start inside a tail in groups that exist: keys, hit, group, status.

    ``distances`` has a row for each (hit, group) with the tail's level under
    the hit (lead_db), the group's size (members) and the level that its
    middle hit rose from (medoid_lead_db). A hit goes to the nearest group
    within the threshold that is MARGIN times nearer than the second; small
    groups count only if they rose out of silence, loud tails not at all.
    """
    usable = (F.col("lead_db") <= SHORT_DB) & ((F.col("members") >= SMALL) | F.coalesce(F.col("medoid_lead_db") <= QUIET_DB, F.lit(False)))
    order = Window.partitionBy(*keys, hit).orderBy(F.col(distance), F.col(group))
    every = distances.select(*keys, hit, "lead_db").distinct()
    ranked = distances.filter(usable).withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead(distance).over(order)).filter("_r = 1")
    both = every.join(ranked.select(*keys, hit, F.col(group).alias("_g"), F.col(distance).alias("_d"), "_next"), [*keys, hit], "left")
    status = (
        F.when(F.col("lead_db").isNull() | (F.col("lead_db") > SHORT_DB), "tail too loud")
        .when(F.col("_g").isNull(), "no group")
        .when(F.col("_d") > threshold, "too far")
        .when(F.col("_next") < MARGIN * F.col("_d"), "undecided")
        .otherwise("assigned")
    )
    made = both.withColumn("status", status)
    return made.select(*keys, hit, F.when(F.col("status") == "assigned", F.col("_g")).alias(group), "status")


def compared_over(lead_db: Column, whole: Column, short: float = 0.040) -> Column:
    """Seconds over which a covered hit is compared: all, the first ``short``, or null (not at all)."""
    return F.when(lead_db <= WHOLE_DB, whole).when(lead_db <= SHORT_DB, F.least(whole, F.lit(short)))
