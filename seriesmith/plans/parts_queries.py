"""Queries of the operators on notes, hits, sections and tonal content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import MAJOR_PROFILE, MINOR_PROFILE, keyword_role
from ..operators import parts, records, sequences as seq
from .tables import BARS, bars, table


def clip_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("len"))
    return parts.passes(clips, ["p_partkey"], "len", 64.0)


def sounding_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("at"), (F.col("l_tax") * 100).alias("dur"))
    made = parts.sounding(clip_passes(spark, sf_dir), notes, ["p_partkey"], "at", "dur")
    return made.select("p_partkey", "l_orderkey", "l_linenumber", "pass", F.round("note_start", 4).alias("note_start"), F.round("note_stop", 4).alias("note_stop"))


def faint_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = bars(spark, sf_dir).filter("power > 0").withColumn("db", 10 * F.log10("power"))
    return parts.faint(low, "db", ["track", "stem"], "bar", 5.0).select("track", "stem", "bar", "faint")


def step_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bars(spark, sf_dir).filter("on").withColumn("win", F.floor(F.col("bar") / 16)).withColumn("step", F.pmod("bar", F.lit(16)))
    return parts.step_shares(hits, ["track", "stem"], "win", "step").withColumn("share", F.round("share", 6))


def step_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).withColumn("win", F.floor(F.col("bar") / 16)).withColumn("step", F.pmod("bar", F.lit(16)))
    return parts.use_states(b.filter("on"), b.filter("power = 0"), ["track", "stem"], "win", "step", 3, 0.5)


def section_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = bars(spark, sf_dir).withColumn("section", F.floor(F.col("bar") / 8)).withColumn("v", F.col("power") / 1000.0)
    return parts.section_levels(by, ["track", "stem"], "section", "v").withColumn("level", F.round("level", 5))


def energy_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.energy_notes(section_levels(spark, sf_dir), "stem", "section", ["track"], "level", 60, 0.4)


def section_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = bars(spark, sf_dir).withColumn("section", F.floor(F.col("bar") / 8))
    return parts.transitions(by, ["track", "stem"], "section", "bar", "power")


def key_of_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 12).alias("pc")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("w"))
    made = parts.ranked_keys(w, ["event_type"], "pc", "w")
    return made.select("event_type", "pc", "mode", F.round("score", 5).alias("score"), F.round("margin", 5).alias("margin"))


def onset_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.flux(bars(spark, sf_dir), "power", ["track", "stem"], "bar").select("track", "stem", "bar", "flux")


def tonal_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = bars(spark, sf_dir).groupBy("track", "bar").pivot("stem", ["click", "error", "purchase", "signup", "view"]).agg(F.sum("power"))
    return parts.vector_change(wide, ["click", "error", "purchase", "signup", "view"], ["track"], "bar").select("track", "bar", F.round("change", 5).alias("change"))


def envelope_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = parts.comb_tempo(bars(spark, sf_dir), ["track", "stem"], "bar", "power", 1.0, [6.0, 7.5, 10.0, 12.0, 15.0])
    return made.select("track", "stem", "bpm", F.round("score", 3).alias("score"))


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", F.lower("p_type"), "p_name")).otherwise(F.col("p_name"))
    items = part.select("p_partkey", key.alias("k"), (F.col("p_partkey") % 90 == 0).alias("done"))
    block = F.substring_index(F.col("k"), " ", -2)
    return parts.duplicate_titles(items, block, "k", "p_partkey", "p_partkey", "done")


def assigned_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 8).alias("pitch"))
    pads = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 8).cast("long").alias("pitch"), F.when(F.col("p_size") % 3 == 0, F.lit("Snare")).otherwise(F.col("p_name")).alias("pad"))
    made = parts.voices(clips, pads, ["k"], "pitch", keyword_role(F.col("pad")), ["snare"])
    return made.select("l_orderkey", "l_linenumber", "role")


def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by last status, and those never attempted."""
    last = records.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return jobs.join(last, "user_id", "left").groupBy(F.coalesce("event_type", F.lit("not attempted")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def layer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of events a user has, and a tempo by precedence."""
    e = table(spark, sf_dir, "events")
    has = lambda k: F.bool_or(F.col("event_type") == k)
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("event_id")))
    return e.groupBy("user_id").agg(has("view").alias("aligned"), has("click").alias("marked"), has("error").alias("sectioned"), F.coalesce(first("view"), first("click"), first("error")).alias("source"))


def valid_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = seq.activity_string(bars(spark, sf_dir), "on", ["track", "stem"], "bar")
    broken = F.when(F.col("track") % 4 == 1, F.concat("bits", F.lit("x"))).when(F.col("track") % 4 == 2, F.substring("bits", 1, 50)).otherwise(F.col("bits"))
    by = made.withColumn("bits", broken).groupBy("track").agg(F.map_from_entries(F.collect_list(F.struct("stem", "bits"))).alias("m"), F.max("length").alias("n"))
    return by.select("track", seq.valid_activity(F.col("m"), F.col("n")).alias("valid"), seq.unmapped(F.col("m"), {"click": "kick", "view": "hats"}).alias("unmapped"))


QUERIES = {f.__name__: f for f in (
    clip_passes, sounding_notes, faint_bars, step_patterns, step_uses, section_levels, energy_notes, section_transitions, key_of_weights, onset_flux, tonal_change,
    envelope_tempo, duplicate_titles, assigned_voices, job_report, layer_flags, valid_activity,
)}

_LEVELS = BARS + """, sl AS (SELECT track, stem, CAST(floor(bar / 8) AS BIGINT) AS section, sqrt(avg(pow(power / 1000.0, 2))) AS r FROM bars GROUP BY ALL),
    lev AS (SELECT track, stem, section, round(CASE WHEN max(r) OVER w > 0 THEN r / max(r) OVER w ELSE 0 END, 5) AS level FROM sl WINDOW w AS (PARTITION BY track, stem))"""
_WIN = BARS + ", h AS (SELECT track, stem, CAST(floor(bar / 16) AS BIGINT) AS win, bar % 16 AS step, power, playing FROM bars)"
_STEMS = ("click", "error", "purchase", "signup", "view")
_PASSES = "ps AS (SELECT p_partkey, CAST(i AS INT) AS pass, i * CAST(p_size AS DOUBLE) AS start, least((i + 1) * CAST(p_size AS DOUBLE), 64) AS stop FROM part, range(0, 64) r(i) WHERE p_size > 0 AND i * p_size < 64)"
ORACLES = {
    "clip_passes": f'WITH {_PASSES} SELECT p_partkey, pass, start AS "start", stop AS "stop" FROM ps',
    "sounding_notes": f"""WITH {_PASSES} SELECT p_partkey, l_orderkey, l_linenumber, pass, round(start + l_quantity, 4) AS note_start, round(least(start + l_quantity + l_tax * 100, stop), 4) AS note_stop
        FROM ps JOIN lineitem ON l_partkey = p_partkey WHERE start + l_quantity < stop""",
    "faint_bars": f"""WITH {BARS}, l AS (SELECT track, stem, bar, 10 * log10(power) AS db, row_number() OVER (PARTITION BY track, stem ORDER BY bar) AS i FROM bars WHERE power > 0),
        m AS (SELECT a.track, a.stem, a.bar, a.db, median(b.db) AS m, count(b.db) AS n FROM l a LEFT JOIN l b ON a.track = b.track AND a.stem = b.stem AND a.i <> b.i AND abs(a.i - b.i) <= 6 GROUP BY ALL)
        SELECT track, stem, bar, n >= 3 AND db < m - 5 AS faint FROM m""",
    "step_patterns": f"""WITH {_WIN}, t AS (SELECT track, stem, count(DISTINCT win) AS b FROM h WHERE playing GROUP BY ALL), p AS (SELECT track, stem, step, count(DISTINCT win) AS n FROM h WHERE playing GROUP BY ALL)
        SELECT t.track, t.stem, s.step, round(coalesce(n, 0) / b, 6) AS share FROM t CROSS JOIN range(0, 16) s(step) LEFT JOIN p ON p.track = t.track AND p.stem = t.stem AND p.step = s.step""",
    "step_uses": f"""WITH {_WIN}, own AS (SELECT DISTINCT track, stem, win FROM h WHERE playing), t AS (SELECT track, stem, count(*) AS b FROM own GROUP BY ALL), p AS (SELECT track, stem, step, count(DISTINCT win) AS n FROM h WHERE playing GROUP BY ALL),
        x AS (SELECT h.track, h.stem, step, count(*) AS x FROM h JOIN own USING (track, stem, win) WHERE power = 0 GROUP BY ALL),
        o AS (SELECT t.track, t.stem, s.step, coalesce(n, 0) AS n, b - coalesce(x, 0) AS observable FROM t CROSS JOIN range(0, 16) s(step) LEFT JOIN p ON p.track = t.track AND p.stem = t.stem AND p.step = s.step LEFT JOIN x ON x.track = t.track AND x.stem = t.stem AND x.step = s.step)
        SELECT track, stem, step, observable, CASE WHEN observable < 3 THEN 'unknown' WHEN n / observable >= 0.5 THEN 'in use' ELSE 'not in use' END AS state FROM o""",
    "section_levels": f"WITH {_LEVELS} SELECT track, stem, section, level FROM lev",
    "energy_notes": f"""WITH {_LEVELS}, n AS (SELECT *, lead(section) OVER (PARTITION BY track, stem ORDER BY section) - section AS length, 60 - dense_rank() OVER (PARTITION BY track ORDER BY stem) + 1 AS pitch FROM lev)
        SELECT track, stem, section, length, CAST(pitch AS INT) AS pitch, CAST(greatest(1, least(127, round_even(127 * level, 0))) AS INT) AS velocity FROM n WHERE level >= 0.4""",
    "section_transitions": f"""WITH {BARS}, s AS (SELECT *, CAST(floor(bar / 8) AS BIGINT) AS section FROM bars), m AS (SELECT track, stem, section, median(power) AS m, max(bar) AS bar, arg_max(power, bar) AS p FROM s GROUP BY ALL),
        k AS (SELECT track, stem, section, bar, CASE WHEN m > 0 AND p >= 1.5 * m THEN 'fill' WHEN m > 0 AND p * 2.0 <= m THEN 'dropout' END AS kind FROM m) SELECT * FROM k WHERE kind IS NOT NULL""",
    "key_of_weights": f"""WITH w AS (SELECT event_type, user_id % 12 AS pc, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS w FROM events GROUP BY ALL), m AS (SELECT * FROM (VALUES ('major', {MAJOR_PROFILE}), ('minor', {MINOR_PROFILE})) t(mode, p)),
        s AS (SELECT event_type, mode, t.tonic, round(corr(w, p[CAST((pc - t.tonic + 12) % 12 AS INT) + 1]), 9) AS score FROM w, m, range(0, 12) t(tonic) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER o AS r, score - lead(score) OVER o AS margin FROM s WINDOW o AS (PARTITION BY event_type ORDER BY score DESC, tonic DESC, mode DESC))
        SELECT event_type, CAST(tonic AS INT) AS pc, mode, round(score, 5) AS score, round(margin, 5) AS margin FROM r WHERE r = 1""",
    "onset_flux": f"WITH {BARS} SELECT track, stem, bar, greatest(power - lag(power, 1, 0) OVER (PARTITION BY track, stem ORDER BY bar), 0) AS flux FROM bars",
    "tonal_change": f"""WITH {BARS}, v AS (SELECT track, bar, {", ".join(f"sum(power) FILTER (WHERE stem = '{s}') AS {s}" for s in _STEMS)} FROM bars GROUP BY ALL),
        m AS (SELECT track, bar, {", ".join(f"avg({s}) OVER p AS a{s}, avg({s}) OVER q AS b{s}" for s in _STEMS)}, count(*) OVER p AS n, count(*) OVER q AS k FROM v
            WINDOW p AS (PARTITION BY track ORDER BY bar RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY track ORDER BY bar RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING))
        SELECT track, bar, CASE WHEN n >= 3 AND k >= 3 THEN round(1 - ({" + ".join(f"a{s} * b{s}" for s in _STEMS)}) / nullif(sqrt(({" + ".join(f"a{s} * a{s}" for s in _STEMS)}) * ({" + ".join(f"b{s} * b{s}" for s in _STEMS)})), 0), 5) END AS change FROM m""",
    "envelope_tempo": f"""WITH {BARS}, s AS (SELECT track, stem, bpm, CAST(floor(bar % CAST(60.0 / bpm AS DOUBLE)) AS BIGINT) AS ph, round(avg(power), 9) AS score FROM bars, (VALUES (6.0), (7.5), (10.0), (12.0), (15.0)) t(bpm) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY track, stem ORDER BY score DESC, bpm) AS r FROM s) SELECT track, stem, CAST(bpm AS DOUBLE) AS bpm, round(score, 3) AS score FROM r WHERE r = 1""",
    "assigned_voices": """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_suppkey % 8 AS pitch FROM lineitem),
        p AS (SELECT p_partkey AS k, p_size % 8 AS pitch, CASE WHEN p_size % 3 = 0 THEN 'snare' END AS role FROM part), j AS (SELECT l_orderkey, l_linenumber, coalesce(role, 'unmapped') AS role FROM c LEFT JOIN p USING (k, pitch)) SELECT * FROM j WHERE role <> 'snare'""",
    "job_report": """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY 1) SELECT coalesce(t, 'not attempted') AS status, count(*) AS n FROM customer LEFT JOIN l ON user_id = c_custkey GROUP BY 1""",
    "layer_flags": """SELECT user_id, bool_or(event_type = 'view') AS aligned, bool_or(event_type = 'click') AS marked, bool_or(event_type = 'error') AS sectioned,
        coalesce(min(event_id) FILTER (WHERE event_type = 'view'), min(event_id) FILTER (WHERE event_type = 'click'), min(event_id) FILTER (WHERE event_type = 'error')) AS source FROM events GROUP BY 1""",
    "duplicate_titles": """WITH i AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) || ' ' || p_name ELSE p_name END AS k, p_partkey % 90 = 0 AS done FROM part),
        b AS (SELECT array_to_string(string_split(k, ' ')[-2:], ' ') AS b, list(k ORDER BY p_partkey) AS ks FROM i GROUP BY 1),
        h AS (SELECT b, list_reduce(list_transform(ks, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda g: g = x[1] OR (len(g) < len(x[1]) AND contains(g, ' ') AND ends_with(x[1], ' ' || g)) OR (len(x[1]) < len(g) AND contains(x[1], ' ') AND ends_with(g, ' ' || x[1])))) > 0
            THEN acc ELSE list_concat(acc, x) END) AS heads FROM b),
        o AS (SELECT p_partkey, done, b, list_filter(heads, lambda g: g = k OR (len(g) < len(k) AND contains(g, ' ') AND ends_with(k, ' ' || g)) OR (len(k) < len(g) AND contains(k, ' ') AND ends_with(g, ' ' || k)))[1] AS group_key
            FROM i JOIN h ON b = array_to_string(string_split(k, ' ')[-2:], ' '))
        SELECT p_partkey, group_key, CASE WHEN bool_or(done) OVER w THEN 'processed' WHEN p_partkey = min(p_partkey) OVER w THEN 'kept' ELSE 'duplicate' END AS status FROM o WINDOW w AS (PARTITION BY b, group_key)""",
    "valid_activity": f"WITH {BARS} SELECT track, track % 4 NOT IN (1, 2) AS valid, list_sort(list(DISTINCT stem) FILTER (WHERE stem NOT IN ('click', 'view'))) AS unmapped FROM bars GROUP BY track",
}
