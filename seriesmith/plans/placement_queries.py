"""Queries of the placement and text functions, over numbers and names of the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as nm, placement as pl
from ..operators import clips, layers as ly
from .tables import BARS, bars, table

BANDS = [(30, 80), (80, 200), (200, 500), (500, 1200), (1200, 3000), (3000, 7000), (7000, 16000)]


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("double"))


def fader_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", F.round(pl.fader(F.col("size") % 30 - 20), 6).alias("fader"))


def scene_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_size").cast("string"), (F.col("p_partkey") % 60).cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(a, F.lit(" - "), b)).when(F.col("p_partkey") % 4 == 1, a).when(F.col("p_partkey") % 4 == 2, F.concat(a, F.lit("-"))).otherwise(F.concat(F.lit(" "), b))
    r = pl.scene_range(text)
    return _part(spark, sf_dir).select("p_partkey", r["first"].alias("first"), r["last"].alias("last"))


def steady_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = pl.steady_from(F.pmod("p_partkey", F.lit(20)).cast("double"), F.lit(4.0), F.least("size", F.lit(16.0)))
    return _part(spark, sf_dir).select("p_partkey", start.alias("steady"))


def clip_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips on bar lines: where they start, what is cut, where a time of the sample falls."""
    period, t0, down = F.col("size") / 100 + 0.25, F.col("p_partkey") % 7 / 16 - 0.125, F.col("p_partkey") % 90 / 8
    p = _part(spark, sf_dir).withColumns({"period": period, "t0": t0, "down": down}).withColumn("at", pl.placement(F.col("period"), F.col("t0"), F.col("down"), F.col("p_partkey") % 40 + 1))
    position, trim = F.col("at.position"), F.col("at.trim")
    return p.select(
        "p_partkey", position.alias("position"), F.round(trim, 6).alias("trim"), F.col("at.downbeat").alias("downbeat"),
        F.round(pl.clip_beat(F.lit(16.0), F.col("t0"), F.col("period")), 6).alias("clip_beat"),
        pl.timeline_bar(F.col("size") + 0.371, F.col("period"), position, trim).alias("bar"),
        pl.note_shift(F.col("t0"), F.lit(0.0), F.col("period"), F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.round(trim, 6))).alias("shift"),
    )


def section_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    comment = F.when(F.col("p_partkey") % 3 == 0, F.lit("bass in"))
    mark = pl.locator(F.col("size"), F.lit(0.5), F.lit(32.0), F.col("p_type"), comment, F.when(F.col("p_partkey") % 4 != 0, F.col("size") * 2))
    return _part(spark, sf_dir).select("p_partkey", mark["time"].alias("time"), mark["name"].alias("name"))


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("p_partkey") % 3 == 0, F.col("size") / 8).when(F.col("p_partkey") % 3 == 1, F.col("size") * 100).otherwise(-F.col("size") / 16)
    quoted = F.concat(F.col("p_name"), F.lit(' <"&>'))
    return _part(spark, sf_dir).select("p_partkey", pl.number_text(x).alias("text"), pl.markup_text(quoted).alias("attribute"))


def marker_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warp markers of clips, of a measured map or of the tempo alone."""
    mark = lambda b, s: F.struct(F.lit(b).cast("double").alias("beat"), s.alias("sec"))
    lead = F.when(F.col("p_partkey") % 3 == 0, 0.0).otherwise(F.col("size") / 16)
    map_ = F.when(F.col("p_partkey") % 4 != 0, F.array(mark(0, lead), mark(4, lead + 2), mark(8, lead + 4.25)))
    made = _part(spark, sf_dir).select("p_partkey", F.posexplode(pl.warp_markers(F.lit(0.5), map_)).alias("i", "m"))
    return made.select("p_partkey", "i", F.col("m.sec").alias("sec"), F.col("m.beat").alias("beat"))


def op_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of requests: each order is a transaction of its lines."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", F.lit(pl.HEAVY_OP)).when(F.col("l_returnflag") == "R", "call").otherwise("set")
    op = F.struct(kind.alias("op"), F.when(F.col("l_linestatus") == "F", F.lit(pl.HEAVY_CALL)).otherwise("get").alias("function"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(pl.HEAVY_SET)).otherwise("name").alias("property"))
    orders = li.groupBy("l_orderkey").agg(F.collect_list(op).alias("ops"))
    whole = F.struct(F.lit("transaction").alias("op"), F.lit(None).cast("string").alias("function"), F.lit(None).cast("string").alias("property"), F.col("ops").alias("ops"))
    w = orders.select("l_orderkey", pl.op_weight(whole).alias("w"))
    return w.select("l_orderkey", F.col("w.ops").alias("ops"), F.col("w.heavy").alias("heavy"))


def error_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ValueError: "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("unknown op "), F.col("p_name"))).otherwise(F.concat(F.lit("no name here: "), F.col("p_name")))
    e = pl.split_error(text)
    return _part(spark, sf_dir).select("p_partkey", e["type"].alias("type"), e["message"].alias("message"))


def censored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = F.when(F.col("p_partkey") % 5 != 0, F.col("size") * 1.25 - 45)
    return _part(spark, sf_dir).select("p_partkey", pl.censored(db).alias("score"))


def band_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*(-(F.pmod(F.col("p_size") * (i + 3), F.lit(41)) + F.lit(0.0)) for i in range(len(BANDS))))
    return _part(spark, sf_dir).select("p_partkey", F.round(pl.log_centroid(levels, BANDS), 4).alias("hz"))


def arranged_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand from low to high: kicks, basses, the kit, others."""
    name = F.concat(nm._pick(["Kick ", "sub bass ", "drums_", "", "drums kick ", "pad "], F.col("p_partkey") % 6), F.col("p_name"))
    made = pl.arranged(_part(spark, sf_dir).withColumn("stem", name), ["p_brand", "p_type"], "stem", "p_retailprice", "p_partkey")
    return made.select("p_brand", "p_type", "p_partkey", "place")


def role_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [r for r, _ in nm.ROLE_KEYWORDS]
    role = nm._pick(["kick", "unmapped", "strings", "synth", "hats"], F.col("p_partkey") % 5)
    return _part(spark, sf_dir).select("p_partkey", pl.role_place(role, known).alias("place"))


def scene_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir).withColumn("loops", F.col("p_partkey") % 3 == 0)
    return clips.scene_beats(p, ["p_brand", "p_type"], "loops", "size")


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by which people tell things apart: composed, without case."""
    accent = F.when(F.col("p_partkey") % 2 == 0, F.lit("\u00c9")).otherwise(F.lit("E\u0301"))
    return _part(spark, sf_dir).select("p_partkey", nm.folded(F.concat(F.initcap("p_name"), F.lit(" "), accent)).alias("name"))


def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir).select("p_partkey", nm.digest6(F.struct(F.col("p_type").alias("a"), F.col("p_size").cast("long").alias("b"))).alias("digest"))


def long_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("p_size") % 2 == 0, "major").otherwise("minor")
    return _part(spark, sf_dir).select("p_partkey", nm.long_key(F.col("p_partkey") % 12, mode).alias("key"))


def known_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.least(F.col("p_size") % 9, F.lit(8))
    return _part(spark, sf_dir).select("p_partkey", pl.enough(F.least(F.col("p_partkey") % 9, known), known, 8, 6, 6).alias("enough"))


def _kind(n: Column) -> Column:
    return nm._pick(["missing", "broken", "old", "now", "ahead"], n)


def layer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a versioned layer of every part, by what is there."""
    n = F.col("p_partkey") % 5
    version = F.when(n >= 2, F.when(n == 2, 1).when(n == 3, 2).otherwise(3))
    return _part(spark, sf_dir).select("p_partkey", ly.layer_state(n > 0, n != 1, version, 2).alias("state"))


def marker_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(nm._pick(nm.MINOR_NAMES, F.col("p_partkey") % 12), nm._pick(["m", "", " x"], F.col("p_size") % 3))
    code = F.when(F.col("p_partkey") % 2 == 0, F.lit(" "))
    source = nm._pick(["detected", "by ear", "guess"], F.col("p_partkey") % 3)
    made = ly.marker_fields(key, code, source, F.col("size") - 5)
    return _part(spark, sf_dir).select("p_partkey", *(c.alias(k) for k, c in made.items()), ly.replaces(source, F.lit("tagged")).alias("replaces"))


def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a text table: names, sizes with one decimal, prices or a dash."""
    price = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice"))
    return _part(spark, sf_dir).select("p_partkey", pl.text_row(F.concat(F.lit("a|"), F.col("p_name")), pl.cell_number(F.col("size") / 2, 1), pl.cell_number(price, 2)).alias("row"))


def study_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned JSON records of parts, of the layers that are asked for."""
    layers = {"name": F.col("p_name"), "size": F.col("p_size").cast("long"), "brand": F.col("p_brand")}
    return _part(spark, sf_dir).select("p_partkey", pl.json_record(2, layers, ["name", "size"]).alias("record"))


QUERIES = {f.__name__: f for f in (
    fader_positions, scene_ranges, steady_starts, clip_placements, section_locators, number_texts, marker_lists, op_weights, error_parts, censored_scores, band_centroids,
    arranged_stems, role_places, scene_lengths, folded_names, record_digests, long_keys, known_enough, layer_states, marker_records, rendered_rows, study_records,
)}

_L = lambda xs: "[" + ", ".join(repr(x) for x in xs) + "]"
_LEVEL = lambda i: f"pow(10, -((p_size * {i + 3}) % 41) / 10.0)"
_E = [_LEVEL(i) for i in range(len(BANDS))]
ORACLES = {
    "rendered_rows": "SELECT p_partkey, '| a\\|' || p_name || ' | ' || printf('%.1f', p_size / 2) || ' | ' || CASE WHEN p_partkey % 4 <> 0 THEN printf('%.2f', CAST(p_retailprice AS DOUBLE)) ELSE '-' END || ' |' AS \"row\" FROM part",
    "study_records": "SELECT p_partkey, CAST(to_json({'version': 2, 'name': p_name, 'size': CAST(p_size AS BIGINT)}) AS VARCHAR) AS record FROM part",
    "fader_positions": "SELECT p_partkey, round(CASE WHEN p_size % 30 - 20 BETWEEN -18 AND 6 THEN 0.85 + (p_size % 30 - 20) / 40.0 END, 6) AS fader FROM part",
    "scene_ranges": """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 3 THEN p_partkey % 60 END AS a, CASE p_partkey % 4 WHEN 0 THEN p_partkey % 60 END AS b FROM part)
        SELECT p_partkey, CAST(CASE WHEN a >= 1 AND coalesce(b, a) >= a THEN a END AS INT) AS "first", CAST(CASE WHEN a >= 1 AND coalesce(b, a) >= a THEN coalesce(b, a) END AS INT) AS "last" FROM t""",
    "steady_starts": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 20 = 4 OR p_partkey % 20 >= least(p_size, 16) THEN 0 ELSE least(p_size, 16) - p_partkey % 20 END AS DOUBLE) AS steady FROM part",
    "clip_placements": """WITH g AS (SELECT p_partkey, p_size, p_size / 100 + 0.25 AS p, p_partkey % 7 / 16 - 0.125 AS t, p_partkey % 90 / 8 AS d, (p_partkey % 40) * 4.0 AS pos FROM part),
        n AS (SELECT *, t - p * floor(t / p) AS t0 FROM g), k AS (SELECT *, CAST(round_even((d - t0) / p, 0) AS BIGINT) AS k FROM n), x AS (SELECT *, ((k % 4) + 4) % 4 AS x FROM k), m AS (SELECT *, t0 + x * p AS trim FROM x)
        SELECT p_partkey, CAST(pos AS DOUBLE) AS position, round(trim, 6) AS trim, CAST(pos + k - x AS DOUBLE) AS downbeat, round(16 + t / p, 6) AS clip_beat, round(1 + (pos - trim / p + (p_size + 0.371) / p) / 4, 2) AS bar,
            CAST(CASE WHEN p_partkey % 3 = 0 OR round(trim, 6) = 0 THEN 0 ELSE round_even((t - round(trim, 6)) / p, 0) END AS INT) AS shift FROM m""",
    "section_locators": """SELECT p_partkey, round(32 + p_size / 0.5, 4) AS "time", p_type || CASE WHEN p_partkey % 3 = 0 THEN ' (bass in)' ELSE '' END || CASE WHEN p_partkey % 4 <> 0 THEN ' · ' || CAST(greatest(1, round_even(p_size * 2 / 4.0, 0)) AS INT) ELSE '' END AS name FROM part""",
    "number_texts": """WITH x AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN p_size / 8 WHEN 1 THEN p_size * 100 ELSE -p_size / 16 END AS x FROM part)
        SELECT p_partkey, regexp_replace(printf('%.12f', CAST(x AS DOUBLE)), '\\.?0+$', '') AS "text", p_name || ' &lt;&quot;&amp;&gt;' AS attribute FROM x""",
    "marker_lists": """WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_size / 16 END AS l, p_partkey % 4 <> 0 AS m FROM part),
        m AS (SELECT p_partkey, CASE WHEN NOT m THEN [{'s': 0.0::DOUBLE, 'b': 0.0::DOUBLE}, {'s': 0.5 / 32, 'b': 1 / 32}] ELSE list_concat(CASE WHEN l > 0 THEN [{'s': 0.0::DOUBLE, 'b': 0.0::DOUBLE}] ELSE [] END, [{'s': l, 'b': 0.0::DOUBLE}, {'s': l + 2, 'b': 4.0}, {'s': l + 4.25, 'b': 8.0}]) END AS m FROM l),
        e AS (SELECT p_partkey, unnest(range(0, len(m))) AS i, unnest(m) AS x FROM m) SELECT p_partkey, CAST(i AS INT) AS i, CAST(x.s AS DOUBLE) AS sec, CAST(x.b AS DOUBLE) AS beat FROM e""",
    "op_weights": """SELECT l_orderkey, CAST(count(*) AS INT) AS ops, CAST(count(*) FILTER (WHERE l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linenumber % 2 = 0)) AS INT) AS heavy FROM lineitem GROUP BY 1""",
    "error_parts": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ValueError' ELSE '' END AS "type", CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'unknown op ' || p_name ELSE 'no name here: ' || p_name END AS message FROM part""",
    "censored_scores": "WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 1.25 - 45 END AS d FROM part) SELECT p_partkey, CASE WHEN d IS NULL THEN '-' WHEN d < -30 THEN '<-30' ELSE printf('%.1f', CAST(d AS DOUBLE)) END AS score FROM d",
    "band_centroids": f"""SELECT p_partkey, round(exp(({" + ".join(f"ln(sqrt({lo * hi}.0)) * {e}" for (lo, hi), e in zip(BANDS, _E))}) / ({" + ".join(_E)})), 4) AS hz FROM part""",
    "arranged_stems": """WITH f AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS f FROM part)
        SELECT p_brand, p_type, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY f, CASE WHEN f >= 2 THEN p_retailprice END, p_partkey) - 1 AS INT) AS place FROM f""",
    "role_places": f"SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 1 THEN {len(nm.ROLE_KEYWORDS) + 2} WHEN 2 THEN {len(nm.ROLE_KEYWORDS) + 1} WHEN 0 THEN 1 WHEN 3 THEN {len(nm.ROLE_KEYWORDS)} ELSE 7 END AS INT) AS place FROM part",
    "scene_lengths": "SELECT p_brand, p_type, CAST(coalesce(max(p_size) FILTER (WHERE p_partkey % 3 = 0), max(p_size)) AS DOUBLE) AS beats FROM part GROUP BY ALL",
    "folded_names": "SELECT p_partkey, lower(p_name) || ' é' AS name FROM part",
    "record_digests": "SELECT p_partkey, left(md5(CAST(to_json({'a': p_type, 'b': CAST(p_size AS BIGINT)}) AS VARCHAR)), 6) AS digest FROM part",
    "long_keys": f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN {_L(nm.MAJOR_NAMES)}[CAST(p_partkey % 12 AS INT) + 1] || ' major' ELSE {_L(nm.MINOR_NAMES)}[CAST(p_partkey % 12 AS INT) + 1] || ' minor' END AS key FROM part",
    "known_enough": "WITH k AS (SELECT p_partkey, least(p_size % 9, 8) AS k FROM part) SELECT p_partkey, k >= 6 AND k - least(p_partkey % 9, k) <= 2 AS enough FROM k",
    "layer_states": "SELECT p_partkey, ['missing', 'unreadable', 'older', 'present', 'newer'][CAST(p_partkey % 5 AS INT) + 1] AS state FROM part",
    "marker_records": f"""WITH k AS (SELECT p_partkey, p_size, {_L(nm.MINOR_NAMES)}[CAST(p_partkey % 12 AS INT) + 1] AS n, CAST(p_partkey % 12 AS INT) AS pc, p_size % 3 AS s FROM part)
        SELECT p_partkey, CASE s WHEN 0 THEN n || 'm' WHEN 1 THEN n END AS key, CASE s WHEN 0 THEN list_position({_L(nm.MINOR_WHEEL)}, pc) || 'A' WHEN 1 THEN list_position({_L(nm.MAJOR_WHEEL)}, pc) || 'B' END AS code,
            CASE WHEN s <> 2 AND p_partkey % 3 <> 2 THEN ['detected', 'by ear'][CAST(p_partkey % 3 AS INT) + 1] END AS source, CASE WHEN p_size > 5 THEN CAST(p_size - 5 AS DOUBLE) END AS bpm, p_partkey % 3 = 1 AS replaces FROM k""",
}
