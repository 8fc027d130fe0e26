"""Queries of the operators on whole studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sequences as seq, studies as sd
from .series import BLOCKS, RUNS
from .tables import BARS, STEPS, bars, steps, table


def block_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = seq.groove_blocks(steps(spark, sf_dir), "kick", "bass", ["track"], "bar", "bars", 4, 4)
    return sd.block_profile(blocks, ["track"], 8, 8)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line number of an order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"))


_LINES = "li AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL)"


def warp_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lines(spark, sf_dir).withColumn("period", F.lit(0.5) + F.col("l_linenumber") / 1000)
    return sd.warp_map(li, ["l_orderkey"], "l_linenumber", "period", "l_quantity").withColumn("sec", F.round("sec", 5))


def broken_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.rising(_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber", ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber")


def equal_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("a", F.log10("l_extendedprice") * 10).withColumn("b", F.log10(F.col("l_extendedprice") * (1 - F.col("l_discount") / 10)) * 10)
    made = sd.same_shape(li, ["l_suppkey"], "a", "b", 0.0225)
    return made.select("l_suppkey", F.round("offset", 6).alias("offset"), F.round("widest", 6).alias("widest"))


def bar_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sd.wins(steps(spark, sf_dir), ["track"], "kick_power", "bass_power", "hats")
    return made.select("track", "n", F.round("won", 6).alias("won"), "gap")


def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bars(spark, sf_dir).groupBy("stem", (F.col("track") % 3).alias("f")).agg((F.avg("power") / 1000 - 18).alias("s"))
    return sd.score_table(s.withColumn("f", F.concat(F.lit("f"), F.col("f").cast("string"))), "stem", "f", "s", ["f0", "f1", "f2"], 1.0)


def strongest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).filter("on").select("track", "stem", "bar")
    pairs = b.join(b.select("track", "bar", F.col("stem").alias("other")), ["track", "bar"]).filter("stem <> other").groupBy("track", "stem", "other").agg(F.count(F.lit(1)).alias("n"))
    return sd.best_evidence(pairs, ["track", "stem"], [F.desc("n"), F.col("other")])


def paired_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    profile = part.groupBy((F.col("p_partkey") % 10).alias("g"), F.col("p_type").alias("name")).agg(F.min("p_size").alias("bar"), F.max("p_size").alias("bars"))
    plan = part.select((F.col("p_partkey") % 10).alias("g"), "p_partkey", F.col("p_type").alias("name"), F.when(F.col("p_size") % 5 == 0, F.lit("SMALL")).alias("to"), (F.col("p_size") % 7).alias("offset"), F.col("p_size").alias("length"))
    return sd.paired_sections(plan, profile, ["g"], "name", "to").select("p_partkey", "paired", "fits")


def inherited_mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 4 != 0, F.floor(F.col("p_partkey") / 4) * 4).otherwise(F.floor(F.col("p_partkey") / 8) - 1).alias("up"), (F.col("p_size") > 40).alias("muted"))
    return sd.inherited(t, ["g"], "node", "up", "muted").select("node", "muted")


def uniform_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.uniform_format(table(spark, sf_dir, "part"), ["p_brand"], ["p_type"])


def format_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return sd.format_problems(li, ["l_orderkey"], ["l_returnflag", "l_linestatus"], "l_tax", "l_discount", 0.095)


def haloed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("g"), (F.col("p_retailprice")).alias("t"))
    made = sd.with_halo(p, ["g"], "t", 50.0, 4.0)
    sections = made.select("g", "section").distinct().withColumn("start", F.col("section") * 50.0).withColumn("stop", F.col("start") + 50.0)
    return sd.owned(made, sections, ["g"], "t", 2.0).select("p_partkey", "section")


def clean_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("loud", F.col("p_size") - 25).withColumn("lead", -(F.col("p_retailprice"))).withColumn("room", F.col("p_partkey") % 13)
    return sd.representative(p, ["p_brand"], "loud", "lead", "room", "p_partkey").select("p_brand", "p_partkey", "clean")


def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sd.standardised(steps(spark, sf_dir), ["track"], ["kick_power", "bass_power"])
    return made.select("track", "bar", F.round("kick_power", 5).alias("kick"), F.round("bass_power", 5).alias("bass"))


def normalised_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sd.analysis_mix(bars(spark, sf_dir).withColumn("v", F.col("power").cast("double")), ["track"], "bar", "v")
    return made.select("track", "bar", F.round("mix", 6).alias("mix"))


def boundary_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = seq.run_table(bars(spark, sf_dir), "on", ["track", "stem"], "bar")
    return sd.boundary_vote(cuts, ["track", "stem"], "first").withColumn("p", F.round("p", 8))


def united_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name whose sizes follow each other by 2 at most are one group."""
    g = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("k"), F.col("p_type").alias("kind"), "p_partkey", F.col("p_type").alias("name"), "p_size")
    # neighbours by size link what all pairs would
    w = Window.partitionBy("k", "kind").orderBy("p_size", "p_partkey")
    before = g.withColumns({"a": F.lag("p_partkey").over(w), "s": F.lag("p_size").over(w)})
    alike = before.filter("p_size - s <= 2").select("k", "kind", "a", F.col("p_partkey").alias("b"))
    return sd.named_groups(g, alike, ["k", "kind"], "p_partkey", "name", "p_size").drop("kind")


QUERIES = {f.__name__: f for f in (
    block_profiles, warp_maps, broken_maps, equal_shapes, bar_wins, score_matrix, strongest_pairs, paired_sections, inherited_mutes, uniform_formats, format_problems, haloed_points,
    clean_hits, standard_scores, normalised_mix, boundary_votes, united_groups,
)}

ORACLES = {
    "score_matrix": f"""WITH {BARS}, s AS (SELECT stem, 'f' || (track % 3) AS f, avg(power) / 1000 - 18 AS s FROM bars GROUP BY ALL), t AS (SELECT stem, f, CASE WHEN s < 1 THEN '<1' ELSE format('{{:,.1f}}', s) END AS t FROM s)
        SELECT stem, max(t) FILTER (WHERE f = 'f0') AS f0, max(t) FILTER (WHERE f = 'f1') AS f1, max(t) FILTER (WHERE f = 'f2') AS f2 FROM t GROUP BY stem""",
    "boundary_votes": f"""WITH {BARS}{RUNS}, v AS (SELECT track, stem, start_bar % 4 AS phase, count(*) AS v FROM runs GROUP BY ALL),
        r AS (SELECT *, row_number() OVER w AS r, sum(v) OVER (PARTITION BY track, stem) AS n, coalesce(lead(v) OVER w, 0) AS x FROM v WINDOW w AS (PARTITION BY track, stem ORDER BY v DESC, phase)),
        b AS (SELECT track, stem, phase, v AS votes, CAST(n AS BIGINT) AS n, CAST(x + v AS BIGINT) AS m FROM r WHERE r = 1)
        SELECT track, stem, phase, votes, n, round(greatest(1e-300, CASE WHEN votes <= 0 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.25) + (n - i) * ln(1 - 0.25))) FROM range(0, 1000) r(i) WHERE i >= votes AND i <= n) END, CASE WHEN votes <= 0 THEN 1.0 ELSE (SELECT sum(exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) + i * ln(0.5) + (m - i) * ln(1 - 0.5))) FROM range(0, 1000) r(i) WHERE i >= votes AND i <= m) END), 8) AS p FROM b""",
    "block_profiles": f"""WITH {BLOCKS}, m AS (SELECT *, bars >= 8 AS long, row_number() OVER (PARTITION BY track, bars >= 8 ORDER BY block) AS l FROM blocks),
        p AS (SELECT track, count(*) AS n_blocks, max(bar) FILTER (WHERE block = 1) AS bars_before_block1, max(bars) FILTER (WHERE block = 1) AS block1_bars, max(bars) FILTER (WHERE block = 2) AS block2_bars,
            max(bars) FILTER (WHERE long AND l = 1) AS major1_bars, max(bars) FILTER (WHERE long AND l = 2) AS major2_bars, max(a_out_before) FILTER (WHERE block = 2) AS out_before_block2,
            max(lead) FILTER (WHERE block = 1) AS lead1, max(lead) FILTER (WHERE block = 2) AS lead2 FROM m GROUP BY track)
        SELECT *, round(block2_bars / block1_bars, 3) AS block_ratio, concat_ws('; ', CASE WHEN bars_before_block1 < 8 THEN 'groove already on in the first 8 bars' END, CASE WHEN least(block1_bars, block2_bars) < 8 THEN 'a block under 8 bars' END,
            CASE WHEN n_blocks > 2 THEN 'later blocks not compared (' || n_blocks || ' blocks)' END) AS flags FROM p""",
    "warp_maps": f"""WITH {_LINES}, l AS (SELECT l_orderkey, row_number() OVER w AS i, sum(l_quantity) OVER w AS beat, sum(l_quantity * (0.5 + l_linenumber / 1000)) OVER w AS sec FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
        SELECT l_orderkey, CAST(i AS INT) AS i, CAST(beat AS DOUBLE) AS beat, round(sec, 5) AS sec FROM l UNION ALL SELECT DISTINCT l_orderkey, 0, 0.0, 0.0 FROM lineitem""",
    "broken_maps": f"""WITH {_LINES}, l AS (SELECT l_orderkey, l_linenumber, l_quantity <= lag(l_quantity) OVER w OR l_extendedprice <= lag(l_extendedprice) OVER w AS bad FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT l_orderkey, l_linenumber FROM l WHERE bad""",
    "equal_shapes": """WITH d AS (SELECT l_suppkey, log10(l_extendedprice) * 10 - log10(l_extendedprice * (1 - l_discount / 10)) * 10 AS d FROM lineitem), m AS (SELECT l_suppkey, median(d) AS m FROM d GROUP BY 1)
        SELECT l_suppkey, round(any_value(m), 6) AS "offset", round(max(abs(d - m)), 6) AS widest FROM d JOIN m USING (l_suppkey) GROUP BY 1""",
    "bar_wins": f"""WITH {STEPS} SELECT track, count(*) FILTER (WHERE hats) AS n, round(avg(CAST(bass_power > kick_power AS INT)) FILTER (WHERE hats), 6) AS won, median(bass_power - kick_power) FILTER (WHERE hats) AS gap FROM steps GROUP BY track""",
    "strongest_pairs": f"""WITH {BARS}, p AS (SELECT a.track, a.stem, b.stem AS other, count(*) AS n FROM bars a JOIN bars b ON a.track = b.track AND a.bar = b.bar AND a.stem <> b.stem WHERE a.playing AND b.playing GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY track, stem ORDER BY n DESC, other) AS r FROM p) SELECT track, stem, other, n FROM r WHERE r = 1""",
    "paired_sections": """WITH f AS (SELECT p_partkey % 10 AS g, p_type AS name, max(p_size) AS bars FROM part GROUP BY ALL), p AS (SELECT p_partkey % 10 AS g, p_partkey, CASE WHEN p_size % 5 = 0 THEN 'SMALL' ELSE p_type END AS paired, p_size % 7 + p_size AS e FROM part)
        SELECT p_partkey, paired, coalesce(e <= bars, false) AS fits FROM p LEFT JOIN f ON f.g = p.g AND f.name = p.paired""",
    "inherited_mutes": """WITH t AS (SELECT p_partkey AS node, CAST(CASE WHEN p_partkey % 4 <> 0 THEN floor(p_partkey / 4) * 4 ELSE floor(p_partkey / 8) - 1 END AS BIGINT) AS up, p_size > 40 AS m FROM part)
        SELECT a.node, a.m OR coalesce(b.m, false) OR coalesce(c.m, false) OR coalesce(d.m, false) AS muted FROM t a LEFT JOIN t b ON a.up = b.node LEFT JOIN t c ON b.up = c.node LEFT JOIN t d ON c.up = d.node""",
    "uniform_formats": "SELECT p_brand, count(DISTINCT p_type) AS formats, count(DISTINCT p_type) = 1 AS uniform FROM part GROUP BY 1",
    "format_problems": """WITH f AS (SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS f, max(abs(l_tax - l_discount)) AS d FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, concat_ws('; ', CASE WHEN f > 1 THEN f || ' formats' END, CASE WHEN d > 0.095 THEN 'other bars than declared' END) AS problem FROM f) SELECT * FROM p WHERE problem <> ''""",
    "haloed_points": "SELECT p_partkey, CAST(floor((p_retailprice + 2) / 50) AS BIGINT) AS section FROM part",
    "clean_hits": """WITH m AS (SELECT p_brand, median(p_size - 25) AS l, median(p_partkey % 13) AS r FROM part GROUP BY 1), f AS (SELECT p.*, abs(p_size - 25 - l) <= 6 AND p_partkey % 13 >= 0.9 * r AS fine FROM part p JOIN m USING (p_brand)),
        n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN fine THEN 0 ELSE 1 END, CASE WHEN fine THEN -p_retailprice END NULLS LAST, p_partkey) AS n FROM f) SELECT p_brand, p_partkey, fine AS clean FROM n WHERE n = 1""",
    "standard_scores": f"""WITH {STEPS}, z AS (SELECT track, bar, (kick_power - avg(kick_power) OVER w) / CASE WHEN stddev_pop(kick_power) OVER w < 1e-9 THEN 1 ELSE stddev_pop(kick_power) OVER w END AS k,
        (bass_power - avg(bass_power) OVER w) / CASE WHEN stddev_pop(bass_power) OVER w < 1e-9 THEN 1 ELSE stddev_pop(bass_power) OVER w END AS b FROM steps WINDOW w AS (PARTITION BY track)) SELECT track, bar, round(k, 5) AS kick, round(b, 5) AS bass FROM z""",
    "normalised_mix": f"WITH {BARS}, m AS (SELECT track, bar, CAST(sum(power) AS DOUBLE) AS m FROM bars GROUP BY ALL) SELECT track, bar, round(CASE WHEN max(m) OVER w > 0 THEN m * 0.9 / max(m) OVER w ELSE 0 END, 6) AS mix FROM m WINDOW w AS (PARTITION BY track)",
    "united_groups": """WITH RECURSIVE g AS (SELECT p_partkey % 5 AS k, p_partkey, p_type AS name, p_size FROM part), e AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM g a JOIN g b ON a.k = b.k AND a.p_partkey <> b.p_partkey AND a.name = b.name AND abs(a.p_size - b.p_size) <= 2),
        r AS (SELECT p_partkey AS n, p_partkey AS u FROM g UNION SELECT e.b, r.u FROM r JOIN e ON e.a = r.n), u AS (SELECT n, min(u) AS u FROM r GROUP BY n),
        x AS (SELECT k, u, min(name) AS name, min(p_size) AS s FROM g JOIN u ON u.n = g.p_partkey GROUP BY ALL),
        l AS (SELECT k, u, CASE WHEN count(*) OVER w > 1 THEN name || ' ' || row_number() OVER (PARTITION BY k, name ORDER BY s, u) ELSE name END AS label FROM x WINDOW w AS (PARTITION BY k, name))
        SELECT g.k, p_partkey, u.u AS "union", label FROM g JOIN u ON u.n = g.p_partkey JOIN l ON l.k = g.k AND l.u = u.u""",
}
