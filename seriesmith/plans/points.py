"""Queries of the tolerance joins and statistics, over points made of ``events`` and others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import levels, statistics as st
from ..operators import tolerance as tol
from .tables import BARS, STEPS, bars, micros, steps, table

HOURS = 3600.0


def _points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return found.select("user_id", "event_id", F.floor(micros() / 1_000_000).cast("double").alias("t"))


_POINTS = "p AS (SELECT user_id, event_id, event_type, floor((epoch_us(ts) - 1704067200000000) / 1000000.0) AS t FROM events), "
_CV = _POINTS + "c AS (SELECT * FROM p WHERE event_type = 'click'), v AS (SELECT * FROM p WHERE event_type = 'view')"


def near_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tol.near(_points(spark, sf_dir, "click"), _points(spark, sf_dir, "view"), ["user_id"], "t", 6 * HOURS).select("user_id", "event_id")


def lone_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tol.near(_points(spark, sf_dir, "click"), _points(spark, sf_dir, "view"), ["user_id"], "t", 6 * HOURS, absent=True).select("user_id", "event_id")


def exclusive_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tol.exclusive(_points(spark, sf_dir, "click"), _points(spark, sf_dir, "view"), ["user_id"], "t", 6 * HOURS).select("user_id", "event_id")


def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tol.nearest(_points(spark, sf_dir, "click"), _points(spark, sf_dir, "view"), ["user_id"], "t", 24 * HOURS, [], "event_id")
    return found.select("event_id", "near_t")


def matched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tol.match_points(_points(spark, sf_dir, "click"), _points(spark, sf_dir, "view"), ["user_id"], "t", 12 * HOURS)


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and F1 of clicks against views, by user."""
    a, b = _points(spark, sf_dir, "click"), _points(spark, sf_dir, "view")
    hits = tol.match_points(a, b, ["user_id"], "t", 12 * HOURS).groupBy("user_id").agg(F.count(F.lit(1)).alias("hit"))
    true, found = (d.groupBy("user_id").agg(F.count(F.lit(1)).alias(n)) for d, n in ((b, "true"), (a, "found")))
    all_ = true.join(found, "user_id", "full").join(hits, "user_id", "left").na.fill(0)
    share = lambda n: F.when(F.col(n) > 0, F.col("hit") / F.col(n)).otherwise(0.0)
    return all_.select("user_id", F.round(share("true"), 6).alias("recall"), F.round(share("found"), 6).alias("precision"), F.round(st.f1(share("true"), share("found")), 6).alias("f1"))


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _points(spark, sf_dir, "view").groupBy("user_id", "t").agg(F.min("event_id").cast("double").alias("y"))
    found = tol.interpolate(_points(spark, sf_dir, "click"), marks, ["user_id"], "t", "y", "at")
    return found.select("event_id", F.round("at", 4).alias("at"))


def points_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = bars(spark, sf_dir).filter("on and stem = 'view'").select(
        F.col("track").alias("k"), (F.col("bar") * 28800).cast("double").alias("a"), ((F.col("bar") + 1) * 28800 - 7200).cast("double").alias("b"), F.col("bar")
    )
    points = _points(spark, sf_dir, "click").withColumn("k", F.col("user_id") % 6)
    return tol.within_spans(points, spans, ["k"], "t", "a", "b", ["bar"]).select("event_id", "bar")


def coincidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tol.coincidence(_points(spark, sf_dir, "click"), _points(spark, sf_dir, "view"), ["user_id"], "t", 6 * HOURS, 720 * HOURS)
    return found.select("user_id", "n", "coincident", *(F.round(c, 5).alias(c) for c in ("rate", "expected")))


def chance_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P of so many active bars or more at a chance of 0.5, by series."""
    by = bars(spark, sf_dir).groupBy("track", "stem").agg(F.count(F.lit(1)).alias("n"), F.count_if("on").alias("k"))
    return by.select("track", "stem", F.round(st.binomial_tail(F.col("n"), F.col("k"), 0.5), 9).alias("p"))


def comb_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.best_period(_points(spark, sf_dir, "click"), "t", ["user_id"], [HOURS * h for h in (5, 6, 7, 8, 12, 24)])
    return found.select("user_id", "period", F.round("coherence", 6).alias("coherence"))


def phase_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.phase_means(bars(spark, sf_dir), "power", "bar", ["track", "stem"]).withColumn("share", F.round("share", 6))


def phase_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = st.phase_votes(_points(spark, sf_dir, "click"), "t", ["user_id"], 4 * HOURS, 0.0, HOURS)
    return found.withColumn("confidence", F.round("confidence", 6))


def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    ranked = _points(spark, sf_dir, "click").withColumn("k", F.row_number().over(w).cast("double"))
    return st.line_fit(ranked, "k", "t", ["user_id"]).select("user_id", "n", F.floor(F.col("slope") + 0.137).alias("slope"), F.floor(F.col("intercept") + 0.137).alias("intercept"))


def tempo_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = _points(spark, sf_dir, "click").withColumn("segment", F.floor(F.col("t") / (168 * HOURS)))
    ranked = week.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "segment").orderBy("t", "event_id")).cast("double"))
    fits = st.line_fit(ranked, "k", "t", ["user_id", "segment"]).filter("n >= 3")
    return st.drift(fits, "slope", ["user_id"]).select("user_id", F.round("drift", 5).alias("drift"), "drifts")


def vote_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.vote_text(table(spark, sf_dir, "events"), "event_type", ["user_id"]).select("user_id", F.col("total").cast("long").alias("total"), "votes")


def signal_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SI-SDR of discounted against full prices, by supplier."""
    li = table(spark, sf_dir, "lineitem")
    r, e = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = li.groupBy("l_suppkey").agg(F.sum(r * r).alias("ss"), F.sum(e * r).alias("se"), F.sum(e * e).alias("ee"))
    return sums.select("l_suppkey", F.round(levels.si_sdr(F.col("ss"), F.col("se"), F.col("ee")), 4).alias("si_sdr"))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    month = F.expr("CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT)")
    flow = li.groupBy("l_suppkey", month.alias("month")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("ref"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")).alias("est")
    )
    return flow.withColumn("db", levels.power_db(F.col("ref") / 1e8)).withColumn("est_db", levels.power_db(F.col("est") / 1e8))


_MONTHLY = """flow AS (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS month,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS ref, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS est FROM lineitem GROUP BY ALL),
    lv AS (SELECT *, 10 * log10(ref / 1e8 + 1e-12) AS db, 10 * log10(est / 1e8 + 1e-12) AS est_db FROM flow),
    tp AS (SELECT l_suppkey, quantile_cont(db, 0.95) FILTER (WHERE db > -80) AS top FROM lv GROUP BY l_suppkey),
    act AS (SELECT lv.*, db > -80 AND db > top - 3 AS active FROM lv JOIN tp USING (l_suppkey))"""


def active_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.active_rows(_monthly(spark, sf_dir), "db", ["l_suppkey"], -80.0, 3.0).select("l_suppkey", "month", "active")


def stem_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level gap, spread and correlation of estimate and reference over active rows."""
    own = levels.active_rows(_monthly(spark, sf_dir), "db", ["l_suppkey"], -80.0, 3.0)
    gap = F.when(F.col("active"), F.col("est_db") - F.col("db"))
    return own.groupBy("l_suppkey").agg(
        F.count_if("active").alias("n_active"),
        F.round(F.median(gap), 6).alias("gap"),
        F.round(F.stddev_pop(gap), 6).alias("spread"),
        F.round(levels.pearson(F.col("db"), F.col("est_db")), 6).alias("rho"),
    )


def activity_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = bars(spark, sf_dir).withColumn("db", levels.power_db(F.col("power") / 1e9))
    return levels.activity_ramp(low, "db", ["track", "stem"]).select("track", "stem", "bar", F.round("ramp", 5).alias("ramp"))


def mean_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power mean of levels by block of 4 bars; silent bars count as no power."""
    low = bars(spark, sf_dir).withColumn("db", F.when(F.col("power") > 0, levels.power_db(F.col("power") / 1e6)))
    return low.groupBy("track", "stem", F.floor(F.col("bar") / 4).alias("block")).agg(F.round(levels.mean_db(F.col("db")), 5).alias("level_db"))


def population_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = steps(spark, sf_dir).groupBy("track").agg(F.sum("kick_power").alias("kick"), F.sum("bass_power").alias("bass"), F.count_if("hats").alias("hats_on"))
    return st.population_stats(by.withColumn("flag", F.col("track") % 3 == 0), ["kick", "bass", "hats_on"], [], "flag")


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = st.model_summary(bars(spark, sf_dir).filter("power > 0"), "stem", "track", "power")
    return made.withColumn("mean", F.round("mean", 4))


QUERIES = {f.__name__: f for f in (
    near_points, lone_points, exclusive_points, nearest_points, matched_points, match_scores, interpolated, points_in_spans, coincidence, chance_tails,
    comb_period, phase_shares, phase_votes, line_fits, tempo_drift, vote_texts, signal_distortion, active_months, stem_scores, activity_ramps, mean_levels,
    population_ranges, model_summary,
)}

#: Two pointers a user: earliest click and view left; l and r where they match.
_MATCHED = _CV + """, a AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM c), b AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS j FROM v),
    s(user_id, i, j, l, r) AS (SELECT DISTINCT user_id, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM a UNION ALL
        SELECT s.user_id, CASE WHEN b.t < a.t - 43200 THEN s.i ELSE s.i + 1 END, CASE WHEN b.t <= a.t + 43200 THEN s.j + 1 ELSE s.j END,
            CASE WHEN abs(b.t - a.t) <= 43200 THEN a.t END, CASE WHEN abs(b.t - a.t) <= 43200 THEN b.t END FROM s JOIN a ON a.user_id = s.user_id AND a.i = s.i JOIN b ON b.user_id = s.user_id AND b.j = s.j)"""
_EXISTS = "EXISTS (SELECT 1 FROM v WHERE v.user_id = c.user_id AND abs(v.t - c.t) <= 21600)"
ORACLES = {
    "near_points": f"WITH {_CV} SELECT user_id, event_id FROM c WHERE {_EXISTS}",
    "lone_points": f"WITH {_CV} SELECT user_id, event_id FROM c WHERE NOT {_EXISTS}",
    "exclusive_points": f"WITH {_CV}, a AS (SELECT *, NOT {_EXISTS} AS alone FROM c), n AS (SELECT *, count(*) FILTER (WHERE alone) OVER (PARTITION BY user_id) AS n FROM a) SELECT user_id, event_id FROM n WHERE alone OR n < 10",
    "nearest_points": f"WITH {_CV} SELECT c.event_id, arg_min(v.t, (abs(v.t - c.t), v.t)) AS near_t FROM c LEFT JOIN v ON v.user_id = c.user_id AND abs(v.t - c.t) <= 86400 GROUP BY c.event_id",
    "matched_points": f"""WITH RECURSIVE {_MATCHED} SELECT user_id, l AS left_time, r AS right_time FROM s WHERE l IS NOT NULL""",
    "match_scores": f"""WITH RECURSIVE {_MATCHED}, h AS (SELECT user_id, count(l) AS hit FROM s GROUP BY 1), x AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS t, count(*) FILTER (WHERE event_type = 'click') AS f FROM p WHERE event_type IN ('click', 'view') GROUP BY 1),
        y AS (SELECT user_id, CASE WHEN t > 0 THEN coalesce(hit, 0) / t ELSE 0.0 END AS r, CASE WHEN f > 0 THEN coalesce(hit, 0) / f ELSE 0.0 END AS q FROM x LEFT JOIN h USING (user_id))
        SELECT user_id, round(r, 6) AS recall, round(q, 6) AS precision, round(CASE WHEN r + q > 0 THEN 2 * r * q / (r + q) ELSE 0.0 END, 6) AS f1 FROM y""",
    "interpolated": f"""WITH {_CV}, m AS (SELECT user_id, t, CAST(min(event_id) AS DOUBLE) AS y FROM v GROUP BY ALL),
        s AS (SELECT *, lead(t) OVER w AS t2, lead(y) OVER w AS y2, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t)),
        q AS (SELECT c.event_id, c.user_id, c.t, greatest(1, least((SELECT count(*) FROM m WHERE m.user_id = c.user_id AND m.t <= c.t), (SELECT count(*) FROM m WHERE m.user_id = c.user_id) - 1)) AS k FROM c)
        SELECT q.event_id, round(s.y + (q.t - s.t) * (s.y2 - s.y) / (s.t2 - s.t), 4) AS "at" FROM q LEFT JOIN s ON s.user_id = q.user_id AND s.k = q.k""",
    "points_in_spans": f"WITH {BARS}, {_POINTS} s AS (SELECT track, bar FROM bars WHERE playing AND stem = 'view') SELECT event_id, s.bar FROM p LEFT JOIN s ON s.track = p.user_id % 6 AND p.t >= s.bar * 28800 AND p.t < (s.bar + 1) * 28800 - 7200 WHERE event_type = 'click'",
    "coincidence": f"""WITH {_CV}, m AS (SELECT user_id, count(*) AS m FROM v GROUP BY 1), h AS (SELECT c.*, {_EXISTS} AS hit FROM c)
        SELECT user_id, count(*) AS n, count(*) FILTER (WHERE hit) AS coincident, round(count(*) FILTER (WHERE hit) / count(*), 5) AS rate, round(avg(least(1.0, coalesce(m, 0) * 43200.0 / 2592000.0)), 5) AS expected
        FROM h LEFT JOIN m USING (user_id) GROUP BY user_id""",
    "chance_tails": f"""WITH {BARS}, k AS (SELECT track, stem, count(*) AS n, count(*) FILTER (WHERE playing) AS k FROM bars GROUP BY ALL)
        SELECT track, stem, round(CASE WHEN k <= 0 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.5) + (n - i) * ln(1 - 0.5))) FROM range(0, 1000) r(i) WHERE i >= k AND i <= n) END, 9) AS p FROM k""",
    "comb_period": f"""WITH {_CV}, r AS (SELECT user_id, h * 3600.0 AS period, round(sqrt(pow(avg(cos(2 * pi() * t / (h * 3600.0))), 2) + pow(avg(sin(2 * pi() * t / (h * 3600.0))), 2)), 9) AS coherence
        FROM c, (VALUES (5), (6), (7), (8), (12), (24)) x(h) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coherence DESC, period) AS i FROM r)
        SELECT user_id, CAST(period AS DOUBLE) AS period, round(coherence, 6) AS coherence FROM n WHERE i = 1""",
    "phase_shares": f"""WITH {BARS}, m AS (SELECT track, stem, CAST(bar % 4 AS INT) AS phase, avg(power) AS m FROM bars GROUP BY ALL)
        SELECT track, stem, phase, round(m / sum(m) OVER (PARTITION BY track, stem), 6) AS share FROM m""",
    "phase_votes": f"""WITH {_CV}, k AS (SELECT user_id, CAST(round_even(t / 14400.0, 0) AS BIGINT) AS k, t FROM c), g AS (SELECT user_id, CAST(k % 4 AS INT) AS phase, count(*) AS votes FROM k WHERE abs(t - k * 14400) <= 3600 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, phase) AS i, sum(votes) OVER (PARTITION BY user_id) AS n FROM g)
        SELECT user_id, phase, votes, round(votes / n, 6) AS confidence FROM r WHERE i = 1""",
    "line_fits": f"""WITH {_CV}, k AS (SELECT user_id, t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS DOUBLE) AS k FROM c)
        SELECT user_id, count(*) AS n, CAST(floor(regr_slope(t, k) + 0.137) AS BIGINT) AS slope, CAST(floor(regr_intercept(t, k) + 0.137) AS BIGINT) AS intercept FROM k GROUP BY user_id""",
    "tempo_drift": f"""WITH {_CV}, s AS (SELECT *, floor(t / 604800.0) AS seg FROM c), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, seg ORDER BY t, event_id) AS DOUBLE) AS k FROM s),
        f AS (SELECT user_id, seg, regr_slope(t, k) AS slope FROM k GROUP BY ALL HAVING count(*) >= 3), d AS (SELECT user_id, (max(slope) - min(slope)) / median(slope) AS d FROM f GROUP BY user_id)
        SELECT user_id, round(d, 5) AS drift, d > 0.005 AS drifts FROM d""",
    "vote_texts": """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM n)
        SELECT user_id, CAST(max(total) AS BIGINT) AS total, string_agg(event_type || ' ' || n || '/' || total, ', ' ORDER BY n DESC, event_type) AS votes FROM t GROUP BY user_id""",
    "signal_distortion": """WITH s AS (SELECT l_suppkey, sum(l_extendedprice * l_extendedprice) AS ss, sum(l_extendedprice * (1 - l_discount) * l_extendedprice) AS se, sum(pow(l_extendedprice * (1 - l_discount), 2)) AS ee FROM lineitem GROUP BY 1)
        SELECT l_suppkey, round(10 * log10((se * se / ss + 1e-12) / (greatest(ee - se * se / ss, 0) + greatest(se * se / ss, 1) * 1e-12)), 4) AS si_sdr FROM s""",
    "active_months": f"WITH {_MONTHLY} SELECT l_suppkey, month, active FROM act",
    "stem_scores": f"""WITH {_MONTHLY} SELECT l_suppkey, count(*) FILTER (WHERE active) AS n_active, round(median(est_db - db) FILTER (WHERE active), 6) AS gap,
        round(stddev_pop(est_db - db) FILTER (WHERE active), 6) AS spread, round(corr(db, est_db), 6) AS rho FROM act GROUP BY l_suppkey""",
    "activity_ramps": f"""WITH {BARS}, l AS (SELECT *, 10 * log10(power / 1e9 + 1e-12) AS db FROM bars), t AS (SELECT track, stem, quantile_cont(db, 0.95) FILTER (WHERE db > -50) AS top, count(*) FILTER (WHERE db > -50) AS n FROM l GROUP BY ALL)
        SELECT track, stem, bar, CASE WHEN n >= 4 THEN round(CASE WHEN db > -50 THEN least(greatest((db - top + 30) / 30, 0), 1) ELSE 0 END, 5) END AS ramp FROM l JOIN t USING (track, stem)""",
    "mean_levels": f"""WITH {BARS} SELECT track, stem, CAST(floor(bar / 4) AS BIGINT) AS block, CASE WHEN sum(power) > 0 THEN round(10 * log10(avg(CASE WHEN power > 0 THEN power / 1e6 + 1e-12 ELSE 0 END)), 5) END AS level_db FROM bars GROUP BY ALL""",
    "population_ranges": f"""WITH {STEPS}, b AS (SELECT track, CAST(sum(kick_power) AS DOUBLE) AS kick, CAST(sum(bass_power) AS DOUBLE) AS bass, CAST(count(*) FILTER (WHERE hats) AS DOUBLE) AS hats_on FROM steps GROUP BY track),
        l AS (UNPIVOT b ON kick, bass, hats_on INTO NAME metric VALUE v), p AS (SELECT 'all' AS population, * FROM l UNION ALL SELECT 'clean', * FROM l WHERE track % 3 <> 0)
        SELECT population, metric, min(v) AS low, max(v) AS high, median(v) AS mid, count(*) AS n FROM p GROUP BY ALL""",
    "model_summary": f"""WITH {BARS}, v AS (SELECT * FROM bars WHERE power > 0), t AS (SELECT stem, track, max(power) - min(power) AS rg, list_sort(list(power))[CAST(floor(count(*) / 2) AS INT) + 1] AS mid FROM v GROUP BY ALL),
        w AS (SELECT stem, arg_max(track, (rg, track)) AS widest_track, max(rg) AS widest_range FROM t GROUP BY stem), b AS (SELECT track, arg_min(stem, (mid, stem)) AS stem FROM t GROUP BY track), n AS (SELECT stem, count(*) AS won FROM b GROUP BY stem)
        SELECT v.stem, list_sort(list(power))[CAST(floor(count(*) / 2) AS INT) + 1] AS mid, round(avg(power), 4) AS mean, min(power) AS low, max(power) AS high, any_value(widest_range) AS widest_range, any_value(widest_track) AS widest_track, coalesce(any_value(won), 0) AS won
        FROM v JOIN w ON w.stem = v.stem LEFT JOIN n ON n.stem = v.stem GROUP BY v.stem""",
}
