"""Queries of the sequence operators, over bars made of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sequences as seq
from .tables import BARS, PARTS, STEPS, bars, steps

KEYS = ["track", "stem"]


def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.hysteresis(bars(spark, sf_dir), "x", KEYS, "bar").select(*KEYS, "bar", "state")


def despeckle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.despeckle(bars(spark, sf_dir), "on", KEYS, "bar").select(*KEYS, "bar", "clean")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.run_table(bars(spark, sf_dir), "on", KEYS, "bar").filter("value").select(*KEYS, F.col("first").alias("start_bar"), "steps")


def groove_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.groove_blocks(steps(spark, sf_dir), "kick", "bass", ["track"], "bar", "bars", 4, 4)


def stretch_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.stretch_gaps(steps(spark, sf_dir), "kick", ["track"], "bar", "bars", 2)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.entries(bars(spark, sf_dir).withColumn("w", F.lit(1).cast("long")), "on", KEYS, "bar", "w", 3)


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("track", "bar", *((F.col(f"{p}_power") / 100000.0).alias(p) for p in ("kick", "bass", "hats", "synths")))


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.novelty(_shares(spark, sf_dir), ["kick", "bass", "hats", "synths"], ["track"], "bar")
    return found.select("track", "bar", F.round("novelty", 5).alias("novelty"))


def phrase_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.novelty(_shares(spark, sf_dir), ["kick", "bass", "hats", "synths"], ["track"], "bar")
    return seq.phrase_offset(found.withColumn("novelty", F.round("novelty", 5)), "novelty", ["track"], "bar")


def activity_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.activity_string(bars(spark, sf_dir), "on", KEYS, "bar")


def activity_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = seq.activity_string(bars(spark, sf_dir), "on", KEYS, "bar")
    return seq.decode_activity(made, "bits", KEYS, "first").select(*KEYS, F.col("order").alias("bar"), "flag")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight bars a section, a part plays if it does in most of them."""
    by = steps(spark, sf_dir).withColumn("section", F.floor(F.col("bar") / 8))
    parts = [(F.avg(F.col(p).cast("int")) > 0.5).alias(p) for p in PARTS]
    power = sum((F.col(f"{p}_power") for p in PARTS), F.lit(0))
    return by.groupBy("track", "section").agg(*parts, F.sum(power).alias("power"))


_SECTIONS = STEPS + """,
    sections AS (SELECT track, CAST(floor(bar / 8) AS BIGINT) AS section, """ + ", ".join(f"avg(CAST({p} AS INT)) > 0.5 AS {p}" for p in PARTS) + """,
        CAST(sum(""" + " + ".join(f"{p}_power" for p in PARTS) + """) AS BIGINT) AS power FROM steps GROUP BY ALL)"""


def stem_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.stem_labels(_sections(spark, sf_dir), ["track"], "section", "kick", "bass", "hats", "synths").select("track", "section", "label")


def energy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _sections(spark, sf_dir).withColumn("rel", F.col("power") / F.avg("power").over(Window.partitionBy("track")))
    return seq.energy_labels(rel, "rel", ["track"], "section", 0.95, 1.05).select("track", "section", "label")


def change_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(PARTS)
    listed = _sections(spark, sf_dir).withColumn("parts", F.filter(F.array(*(F.when(F.col(p), F.lit(p)) for p in names)), lambda x: x.isNotNull()))
    return seq.change_comment(listed, "parts", ["track"], "section", names).select("track", "section", "comment")


def change_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By part and window of four bars: the users' parity classes that sound."""
    by = bars(spark, sf_dir).withColumn("win", F.floor(F.col("bar") / 4))
    sets = by.groupBy("stem", "win").agg(F.array_sort(F.collect_set(F.when(F.col("power") > 30000, F.col("track")))).alias("sounding"))
    return seq.change_kinds(sets, "sounding", ["stem"], "win").select("stem", "win", "change")


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("kick") & F.col("bass"), "Drop").when(F.col("kick"), "Main").otherwise("Break")
    return seq.merge_labels(steps(spark, sf_dir).withColumn("label", level), "label", ["track"], "bar", "bars").select("track", F.col("section").cast("long").alias("section"), "label", "bar", "bars")


def drops_with_mains(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merged_labels(spark, sf_dir)
    return seq.mains_after(merged, "label", ["track"], "section", "bars").select("track", "label", "bar", "bars", "mains_after")


def first_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = bars(spark, sf_dir).filter("on")
    return seq.first_stable(on, "bar", KEYS, F.pmod(F.col("track"), F.lit(4)), 6)


def session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.run_table(bars(spark, sf_dir), "on", KEYS, "bar").filter("value").withColumn("total", F.lit(90.5))
    return seq.plan_spans(found, "first", KEYS, "total", 3).select(*KEYS, "slot", F.col("first").alias("start_bar"), F.col("span").cast("long").alias("span"))


def merged_short_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seq.run_table(steps(spark, sf_dir), "kick", ["track"], "bar")
    one = F.array_sort(F.collect_list(F.struct(F.col("first").alias("start"), F.col("steps").alias("bars"))))
    made = found.groupBy("track").agg(seq.merge_short(one, 8).alias("s"))
    return made.select("track", F.explode("s").alias("s")).select("track", "s.start", "s.bars")


def spaced_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = seq.run_table(bars(spark, sf_dir), "on", KEYS, "bar").select("track", F.col("first").alias("cut"))
    one = starts.groupBy("track").agg(seq.spaced(F.collect_list(F.col("cut").cast("long")), F.lit(90)).alias("c"))
    return one.select("track", F.explode("c").alias("cut"))


def snapped_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = seq.run_table(bars(spark, sf_dir), "on", KEYS, "bar")
    return starts.select(*KEYS, F.col("first").alias("cut"), seq.snapped(F.col("first"), F.lit(3), F.lit(90)).alias("snapped"))


def request_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = bars(spark, sf_dir).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("bar", "power"))), lambda p: F.floor(p["power"] / 1000)).alias("w"))
    made = ordered.select(*KEYS, F.arrays_zip(F.sequence(F.lit(0), F.size("w") - 1).alias("i"), seq.pack_batches(F.col("w"), 256, 30, 6).alias("b")).alias("z"))
    return made.select(*KEYS, F.explode("z").alias("z")).select(*KEYS, F.col("z.i").alias("i"), F.col("z.b").alias("batch"))


def sections_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From bars to named sections: ramp, states, cuts, statistics, labels."""
    from .structure import sections

    return sections(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    hysteresis, despeckle, runs, groove_blocks, stretch_gaps, entries, novelty, phrase_offset, activity_strings, activity_decoded, stem_labels,
    energy_labels, change_comments, change_kinds, merged_labels, drops_with_mains, first_stable, session_spans, merged_short_sections, spaced_cuts,
    snapped_cuts, request_packs, sections_flagship,
)}

RUNS = """,
    marked AS (SELECT *, CASE WHEN playing IS DISTINCT FROM lag(playing) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM bars WINDOW w AS (PARTITION BY track, stem ORDER BY bar)),
    numbered AS (SELECT *, sum(c) OVER (PARTITION BY track, stem ORDER BY bar) AS run FROM marked),
    runs AS (SELECT track, stem, run, first(playing) AS value, min(bar) AS start_bar, max(bar) AS end_bar, count(*) AS steps FROM numbered GROUP BY track, stem, run)"""

BLOCKS = STEPS + """,
    g1 AS (SELECT *, kick AND bass AS g, bass AND NOT kick AS led FROM steps),
    g2 AS (SELECT *, CASE WHEN g IS DISTINCT FROM lag(g) OVER w THEN 1 ELSE 0 END AS c FROM g1 WINDOW w AS (PARTITION BY track ORDER BY bar)),
    g3 AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY bar) AS run FROM g2),
    g4 AS (SELECT *, g OR (run > 1 AND run < max(run) OVER (PARTITION BY track) AND count(*) OVER (PARTITION BY track, run) < 4) AS h, sum(CASE WHEN kick THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY bar) AS outs,
        bar - 1 - coalesce(max(CASE WHEN NOT led THEN bar END) OVER (PARTITION BY track ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS lead_raw FROM g3),
    g5 AS (SELECT *, CASE WHEN h IS DISTINCT FROM lag(h) OVER w THEN 1 ELSE 0 END AS d FROM g4 WINDOW w AS (PARTITION BY track ORDER BY bar)),
    g6 AS (SELECT *, sum(d) OVER (PARTITION BY track ORDER BY bar) AS blk FROM g5),
    g7 AS (SELECT track, min(bar) AS bar, count(*) AS bars, arg_min(lead_raw, bar) AS lead_raw, arg_min(outs, bar) AS o1, arg_max(outs, bar) AS o2 FROM g6 WHERE h GROUP BY track, blk HAVING count(*) >= 4),
    blocks AS (SELECT track, CAST(row_number() OVER w AS INT) AS block, bar, bars, CASE WHEN lead_raw <= 1 THEN 0 ELSE lead_raw END AS lead, lead_raw, bar - lag(bar + bars) OVER w AS gap_before, CAST(o1 - lag(o2) OVER w AS BIGINT) AS a_out_before FROM g7 WINDOW w AS (PARTITION BY track ORDER BY bar))"""

_NOVELTY = STEPS + """,
    nov AS (SELECT track, bar, round(coalesce(sqrt(""" + " + ".join(
    f"(avg({p}_power / 100000.0) OVER a - avg({p}_power / 100000.0) OVER b) ** 2" for p in ("kick", "bass", "hats", "synths")
) + """), 0), 5) AS novelty FROM steps WINDOW a AS (PARTITION BY track ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING),
        b AS (PARTITION BY track ORDER BY bar ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""

_NUMBERED = """SELECT track, section, CASE WHEN count(*) OVER (PARTITION BY track, name) > 1
        THEN name || ' ' || row_number() OVER (PARTITION BY track, name ORDER BY section) ELSE name END AS label FROM named"""

_MERGED = STEPS + """,
    lab AS (SELECT *, CASE WHEN kick AND bass THEN 'Drop' WHEN kick THEN 'Main' ELSE 'Break' END AS label FROM steps),
    chg AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c, coalesce(sum(bars) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS pos
        FROM lab WINDOW w AS (PARTITION BY track ORDER BY bar)),
    num AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY bar) AS section FROM chg),
    merged AS (SELECT track, CAST(section AS BIGINT) AS section, first(label) AS label, CAST(min(pos) AS BIGINT) AS bar, CAST(sum(bars) AS BIGINT) AS bars FROM num GROUP BY track, section)"""

#: Name of a section by its own, the previous and the next section's parts.
_NAMES = """CASE WHEN i = 0 THEN 'Intro'
            WHEN i = n - 1 AND (NOT (kick AND bass) OR ((NOT kick OR pkick) AND (NOT bass OR pbass) AND (NOT hats OR phats) AND (NOT synths OR psynths)
                AND ((pkick AND NOT kick) OR (pbass AND NOT bass) OR (phats AND NOT hats) OR (psynths AND NOT synths)))) THEN 'Outro'
            WHEN NOT kick THEN CASE WHEN nkick AND hats AND i > 1 THEN 'Build' ELSE 'Breakdown' END
            WHEN NOT pkick THEN CASE WHEN bass THEN 'Drop' ELSE 'Build' END
            WHEN bass THEN CASE WHEN pbass THEN 'Main' ELSE 'Drop' END
            ELSE CASE WHEN nbass THEN 'Build' ELSE 'Main' END END"""
_AROUND = ", ".join(f"coalesce(lag({p}) OVER w, false) AS p{p}, coalesce(lead({p}) OVER w, false) AS n{p}" for p in ("kick", "bass", "hats", "synths"))
_SPACED = "list_reduce(list_transform({cuts}, lambda c: [c]), lambda k, c: CASE WHEN c[1] - k[-1] >= 4 THEN list_concat(k, c) ELSE k END)"

ORACLES = {
    "groove_blocks": f"WITH {BLOCKS} SELECT * FROM blocks",
    "merged_short_sections": f"""WITH {STEPS}, m AS (SELECT track, bar, kick, CASE WHEN kick IS DISTINCT FROM lag(kick) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM steps WINDOW w AS (PARTITION BY track ORDER BY bar)),
        r AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY bar) AS run FROM m), g AS (SELECT track, min(bar) AS start, count(*) AS bars FROM r GROUP BY track, run),
        l AS (SELECT track, list({{'start': start, 'bars': bars}} ORDER BY start) AS l FROM g GROUP BY track),
        f AS (SELECT track, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN a[-1].bars < 8 THEN list_concat(list_slice(a, 1, len(a) - 1), [{{'start': a[-1].start, 'bars': a[-1].bars + x[1].bars}}]) ELSE list_concat(a, x) END) AS f FROM l),
        e AS (SELECT track, unnest(CASE WHEN len(f) > 1 AND f[-1].bars < 8 THEN list_concat(list_slice(f, 1, len(f) - 2), [{{'start': f[-2].start, 'bars': f[-2].bars + f[-1].bars}}]) ELSE f END) AS s FROM f)
        SELECT track, s.start AS "start", s.bars AS bars FROM e""",
    "spaced_cuts": f"""WITH {BARS}{RUNS}, l AS (SELECT track, list_sort(list(DISTINCT start_bar)) AS cuts FROM runs WHERE start_bar >= 4 AND 90 - start_bar >= 4 GROUP BY track) SELECT track, unnest({_SPACED.format(cuts="cuts")}) AS cut FROM l""",
    "request_packs": f"""WITH {BARS}, l AS (SELECT track, stem, list(CAST(floor(power / 1000) AS BIGINT) ORDER BY bar) AS w FROM bars GROUP BY ALL),
        f AS (SELECT track, stem, list_reduce(list_transform(w, lambda x: {{'b': [0], 'w': x, 'h': CASE WHEN x >= 30 THEN 1 ELSE 0 END}}), lambda a, x: CASE WHEN a.w > 0 AND (a.w + x.w > 256 OR a.h + x.h > 6)
            THEN {{'b': list_append(a.b, a.b[-1] + 1), 'w': x.w, 'h': x.h}} ELSE {{'b': list_append(a.b, a.b[-1]), 'w': a.w + x.w, 'h': a.h + x.h}} END).b AS b FROM l)
        SELECT track, stem, CAST(unnest(range(0, len(b))) AS INT) AS i, CAST(unnest(b) AS INT) AS batch FROM f""",
    "sections_flagship": f"""WITH {BARS}, lv AS (SELECT *, 10 * log10(power / 1e6 + 1e-12) AS db FROM bars),
        tp AS (SELECT track, stem, quantile_cont(db, 0.95) FILTER (WHERE db > -50) AS top, count(*) FILTER (WHERE db > -50) AS n FROM lv GROUP BY ALL),
        rp AS (SELECT track, CASE stem WHEN 'click' THEN 'kick' WHEN 'purchase' THEN 'bass' WHEN 'view' THEN 'hats' WHEN 'signup' THEN 'synths' WHEN 'error' THEN 'vocals' END AS part, bar, power,
            CASE WHEN db > -50 THEN least(greatest((db - top + 30) / 30, 0), 1) ELSE 0 END AS ramp FROM lv JOIN tp USING (track, stem) WHERE n >= 4),
        hy AS (SELECT *, coalesce(last_value(CASE WHEN ramp > 0.5 THEN true WHEN ramp < 0.3 THEN false END IGNORE NULLS) OVER (PARTITION BY track, part ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS st FROM rp),
        c1 AS (SELECT *, CASE WHEN st IS DISTINCT FROM lag(st) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM hy WINDOW w AS (PARTITION BY track, part ORDER BY bar)),
        c2 AS (SELECT *, sum(c) OVER (PARTITION BY track, part ORDER BY bar) AS run FROM c1), c3 AS (SELECT track, part, run, first(st) AS v, count(*) AS k FROM c2 GROUP BY ALL),
        c4 AS (SELECT *, last_value(CASE WHEN k >= 4 THEN v END IGNORE NULLS) OVER (PARTITION BY track, part ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held, first_value(v) OVER (PARTITION BY track, part ORDER BY run) AS v0, count(*) OVER (PARTITION BY track, part) AS n FROM c3),
        cl AS (SELECT c2.track, c2.part, bar, power, ramp, CASE WHEN n = 1 THEN v ELSE coalesce(held, NOT v0) END AS cl FROM c2 JOIN c4 USING (track, part, run)),
        wd AS (SELECT track, bar, {", ".join(f"coalesce(bool_or(part = '{p}' AND cl), false) AS {p}" for p in PARTS)}, {", ".join(f"coalesce(max(ramp) FILTER (WHERE part = '{p}'), 0.0) AS {p}_x" for p in ("kick", "bass", "hats", "synths"))}, sum(power) AS power FROM cl GROUP BY ALL),
        nv AS (SELECT *, coalesce({" OR ".join(f"{p} <> lag({p}) OVER w" for p in ("kick", "bass", "hats", "synths"))}, false) AS cut, coalesce(sqrt({" + ".join(f"(avg({p}_x) OVER a - avg({p}_x) OVER b) ** 2" for p in ("kick", "bass", "hats", "synths"))}), 0) AS novelty
            FROM wd WINDOW w AS (PARTITION BY track ORDER BY bar), a AS (PARTITION BY track ORDER BY bar ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), b AS (PARTITION BY track ORDER BY bar ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
        vt AS (SELECT track, CAST(((bar + d) % 8 + 8) % 8 AS INT) AS pos, sum(novelty * s) AS score FROM nv, (VALUES (0, 1.0), (1, 0.5), (-1, 0.5)) t(d, s) GROUP BY ALL),
        bs AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, pos) AS r, max(CASE WHEN pos = 0 THEN score END) OVER (PARTITION BY track) AS zero FROM vt),
        os AS (SELECT track, CASE WHEN coalesce(zero, 0) >= 0.9 * score THEN 0 ELSE pos END AS o FROM bs WHERE r = 1), tt AS (SELECT track, max(bar) + 1 AS total FROM wd GROUP BY track),
        ln AS (SELECT nv.track, bar, total, o + 8 * CAST(round_even((bar - o) / 8.0, 0) AS BIGINT) AS line FROM nv JOIN os USING (track) JOIN tt USING (track) WHERE cut),
        sn AS (SELECT track, total, CASE WHEN abs(bar - line) <= 1 AND line > 0 AND line < total THEN line ELSE bar END AS cut FROM ln),
        kp AS (SELECT track, list_sort(list(DISTINCT cut)) AS cuts FROM sn WHERE cut >= 4 AND total - cut >= 4 GROUP BY track),
        sp AS (SELECT tt.track, list_concat([0::BIGINT], coalesce({_SPACED.format(cuts="cuts")}, [])) AS starts FROM tt LEFT JOIN kp USING (track)),
        se AS (SELECT track, CAST(len(list_filter(starts, lambda s: s <= bar)) - 1 AS INT) AS section, min(bar) AS bar, count(*) AS bars, avg(power) AS energy, {", ".join(f"avg(CAST({p} AS INT)) > 0.5 AS {p}" for p in PARTS)} FROM wd JOIN sp USING (track) GROUP BY ALL),
        n AS (SELECT *, round(energy / avg(energy) OVER (PARTITION BY track), 4) AS rel_energy, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY track) AS n, {_AROUND} FROM se WINDOW w AS (PARTITION BY track ORDER BY section)),
        named AS (SELECT *, {_NAMES} AS name FROM n)
        SELECT track, section, bar, bars, {", ".join(PARTS)}, rel_energy, name, CASE WHEN count(*) OVER (PARTITION BY track, name) > 1 THEN name || ' ' || row_number() OVER (PARTITION BY track, name ORDER BY section) ELSE name END AS label FROM named""",
    "hysteresis": f"""WITH {BARS} SELECT track, stem, bar, coalesce(last_value(CASE WHEN x > 0.5 THEN true WHEN x < 0.3 THEN false END IGNORE NULLS)
        OVER (PARTITION BY track, stem ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS state FROM bars""",
    "despeckle": f"""WITH {BARS}{RUNS},
        held AS (SELECT *, last_value(CASE WHEN steps >= 4 THEN value END IGNORE NULLS) OVER (PARTITION BY track, stem ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h,
            first_value(value) OVER (PARTITION BY track, stem ORDER BY run) AS v0, count(*) OVER (PARTITION BY track, stem) AS n FROM runs)
        SELECT b.track, b.stem, b.bar, CASE WHEN n = 1 THEN value ELSE coalesce(h, NOT v0) END AS clean FROM numbered b JOIN held USING (track, stem, run)""",
    "runs": f"WITH {BARS}{RUNS} SELECT track, stem, start_bar, steps FROM runs WHERE value",
    "entries": f"""WITH {BARS}{RUNS}, e AS (SELECT *, max(CASE WHEN value AND steps >= 3 THEN end_bar END) OVER (PARTITION BY track, stem) AS l FROM runs)
        SELECT track, stem, min(CASE WHEN value AND steps >= 3 THEN start_bar END) AS enters, max(CASE WHEN value AND steps >= 3 THEN end_bar END) AS leaves,
            CAST(coalesce(sum(CASE WHEN start_bar > l THEN steps END), 0) AS BIGINT) AS trailing FROM e GROUP BY track, stem HAVING enters IS NOT NULL""",
    "stretch_gaps": f"""WITH {STEPS}, bars2 AS (SELECT track, bar, kick AS playing FROM steps),
        m AS (SELECT *, CASE WHEN playing IS DISTINCT FROM lag(playing) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM bars2 WINDOW w AS (PARTITION BY track ORDER BY bar)),
        r AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY bar) AS run FROM m),
        g AS (SELECT track, run, first(playing) AS v, min(bar) AS a, max(bar) AS b, count(*) AS n FROM r GROUP BY track, run),
        l AS (SELECT *, min(CASE WHEN v AND n >= 2 THEN a END) OVER (PARTITION BY track) AS fa, max(CASE WHEN v AND n >= 2 THEN a END) OVER (PARTITION BY track) AS la FROM g)
        SELECT track, a AS bar, n AS bars FROM l WHERE NOT v AND a > fa AND b < la""",
    "novelty": f"WITH {_NOVELTY} SELECT track, bar, novelty FROM nov",
    "phrase_offset": f"""WITH {_NOVELTY},
        votes AS (SELECT track, CAST(((bar + d) % 8 + 8) % 8 AS INT) AS pos, sum(novelty * s) AS score FROM nov, (VALUES (0, 1.0), (1, 0.5), (-1, 0.5)) t(d, s) GROUP BY ALL),
        best AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, pos) AS r, max(CASE WHEN pos = 0 THEN score END) OVER (PARTITION BY track) AS zero FROM votes)
        SELECT track, CASE WHEN coalesce(zero, 0) >= 0.9 * score THEN 0 ELSE pos END AS phrase_offset FROM best WHERE r = 1""",
    "activity_strings": f"""WITH {BARS} SELECT track, stem, min(bar) AS "first", count(*) AS length, string_agg(CASE WHEN playing THEN '1' ELSE '0' END, '' ORDER BY bar) AS bits FROM bars GROUP BY track, stem""",
    "activity_decoded": f"WITH {BARS} SELECT track, stem, bar, playing AS flag FROM bars",
    "stem_labels": f"""WITH {_SECTIONS},
        n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY track) AS n,
            {_AROUND}
            FROM sections WINDOW w AS (PARTITION BY track ORDER BY section)),
        named AS (SELECT track, section, {_NAMES} AS name FROM n)
        {_NUMBERED}""",
    "energy_labels": f"""WITH {_SECTIONS}, r AS (SELECT *, power / avg(power) OVER (PARTITION BY track) AS rel FROM sections),
        l AS (SELECT *, CASE WHEN rel < 0.95 THEN 'quiet' WHEN rel > 1.05 THEN 'full' ELSE 'mid' END AS lv FROM r),
        p AS (SELECT *, lag(lv) OVER w AS pv, lead(lv) OVER w AS nv, row_number() OVER w AS i, count(*) OVER (PARTITION BY track) AS n FROM l WINDOW w AS (PARTITION BY track ORDER BY section)),
        named AS (SELECT track, section, CASE WHEN i = 1 THEN 'Intro' WHEN i = n THEN 'Outro' WHEN lv = 'full' THEN CASE WHEN pv = 'full' THEN 'Main' ELSE 'Drop' END
            WHEN lv = 'quiet' THEN CASE WHEN pv = 'full' THEN 'Break' ELSE 'Quiet' END ELSE CASE WHEN nv = 'full' THEN 'Build' ELSE 'Mid' END END AS name FROM p)
        {_NUMBERED}""",
    "change_comments": f"""WITH {_SECTIONS},
        p AS (SELECT *, row_number() OVER w AS i, {", ".join(f"lag({p}) OVER w AS p{p}" for p in PARTS)} FROM sections WINDOW w AS (PARTITION BY track ORDER BY section)),
        c AS (SELECT track, section, i, list_filter([{", ".join(f"CASE WHEN {p} AND NOT p{p} THEN '{p} in' WHEN p{p} AND NOT {p} THEN '{p} out' END" for p in PARTS)}], lambda x: x IS NOT NULL) AS t FROM p)
        SELECT track, section, CASE WHEN i = 1 THEN '' ELSE coalesce(array_to_string(t[1:2], ', '), '') END AS comment FROM c""",
    "change_kinds": f"""WITH {BARS},
        s AS (SELECT stem, CAST(floor(bar / 4) AS BIGINT) AS win, coalesce(list(DISTINCT track) FILTER (WHERE power > 30000), []) AS s FROM bars GROUP BY ALL),
        p AS (SELECT *, lag(s) OVER w AS p, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY stem ORDER BY win))
        SELECT stem, win, CASE WHEN i = 1 THEN NULL WHEN len(s) > 0 AND len(p) = 0 THEN 'enter' WHEN len(s) > 0 AND len(list_filter(s, lambda x: NOT list_contains(p, x))) > 0 THEN 'vary'
            WHEN len(s) > 0 AND len(list_filter(p, lambda x: NOT list_contains(s, x))) > 0 THEN 'thin' WHEN len(s) > 0 THEN 'same' WHEN len(p) > 0 THEN 'leave' END AS change FROM p""",
    "merged_labels": f"WITH {_MERGED} SELECT track, section, label, bar, bars FROM merged",
    "drops_with_mains": f"""WITH {_MERGED}, n AS (SELECT *, CASE WHEN label LIKE 'Main%' THEN bars END AS m, sum(CASE WHEN label LIKE 'Main%' THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY section) AS g FROM merged),
        s AS (SELECT *, CAST(coalesce(sum(m) OVER (PARTITION BY track, g), 0) AS BIGINT) AS mains_after FROM n)
        SELECT track, label, bar, bars, mains_after FROM s WHERE label LIKE 'Drop%'""",
    "first_stable": f"""WITH {BARS}, k AS (SELECT track, stem, bar AS k, track % 4 AS p FROM bars WHERE playing),
        g AS (SELECT *, k - row_number() OVER (PARTITION BY track, stem ORDER BY k) AS g FROM k),
        e AS (SELECT *, max(k) OVER (PARTITION BY track, stem, g) AS e FROM g)
        SELECT track, stem, coalesce(min(k) FILTER (WHERE (k - p) % 4 = 0 AND e - k + 1 >= 6), min(k) FILTER (WHERE (k - p) % 4 = 0), min(k)) AS stable FROM e GROUP BY track, stem""",
    "session_spans": f"""WITH {BARS}{RUNS}, s AS (SELECT track, stem, start_bar, CAST(floor(coalesce(lead(start_bar) OVER (PARTITION BY track, stem ORDER BY start_bar), 90.5) - start_bar + 1e-6) AS BIGINT) AS span FROM runs WHERE value)
        SELECT track, stem, CAST(row_number() OVER (PARTITION BY track, stem ORDER BY start_bar) - 1 AS INT) AS slot, start_bar, span FROM s WHERE span >= 3""",
    "snapped_cuts": f"""WITH {BARS}{RUNS}, l AS (SELECT track, stem, start_bar AS cut, 3 + 8 * CAST(round_even((start_bar - 3) / 8.0, 0) AS BIGINT) AS line FROM runs)
        SELECT track, stem, cut, CAST(CASE WHEN abs(cut - line) <= 1 AND line > 0 AND line < 90 THEN line ELSE cut END AS BIGINT) AS snapped FROM l""",
}
