"""Queries of naming functions and catalogue operators over the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as nm
from ..operators import records as rec
from .tables import BARS, STEPS, bars, cents, steps, table

def _keys() -> Column:
    """Key names, some of them no key, made of part numbers."""
    return F.concat(nm._pick(nm.MINOR_NAMES, F.col("p_partkey") % 12), nm._pick(["m", "", " minor", "Maj", " x"], F.col("p_size") % 5))


def role_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["Bass Drum", "Hi Tom", "HH open", "Sub", "lead 2", "Riser", "vox chop", "thing"]
    name = F.concat(nm._pick(words, F.col("p_partkey") % 8), F.lit(" "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", nm.keyword_role(name).alias("role"))


def section_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["Drop", "break", "INTRO", "Main", "Thing", "Breakdown"]
    name = F.concat(nm._pick(words, F.col("p_partkey") % 6), F.lit(" "), F.col("p_size").cast("string"), nm._pick(["A", "b", ""], F.col("p_partkey") % 3))
    return table(spark, sf_dir, "part").select("p_partkey", nm.section_label(name).alias("label"), nm.section_part(name).alias("part"))


def parsed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return table(spark, sf_dir, "part").withColumn("k", nm.parse_key(_keys())).select(
        "p_partkey", k["pc"].alias("pc"), k["mode"].alias("mode"), nm.wheel_code(k["pc"], k["mode"]).alias("wheel"), nm.short_key(k["pc"], k["mode"]).alias("short")
    )


def key_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wheel = lambda c: F.concat((c % 12 + 1).cast("string"), F.when(F.floor(c / 12) % 2 == 0, "A").otherwise("B"))
    a, b = nm.parse_key(wheel(F.col("p_partkey"))), nm.parse_key(wheel(F.col("p_size")))
    return part.withColumns({"a": a, "b": b}).select("p_partkey", nm.key_relation(F.col("a"), F.col("b")).alias("relation"))


def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    bpm = nm.listed_tempo(F.col("p_retailprice") / 10, F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") / 10 + 0.5).when(F.col("p_partkey") % 3 == 1, F.lit(99.0)))
    name = nm.folder_name(F.col("p_name"), bpm, F.col("k"), F.col("p_partkey") % 2 == 0)
    return part.withColumn("k", nm.parse_key(_keys())).select("p_partkey", name.alias("folder"), nm.bare_title(F.concat(F.col("p_name"), F.lit(" [124 Am 8A?]"))).alias("title"))


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("8A - "), F.col("p_brand"), F.lit(" - "), F.initcap("p_name"), F.lit(" É_è 124bpm [abcdefghijk]"))
    return table(spark, sf_dir, "part").select("p_partkey", nm.title_key(raw).alias("key"))


def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", nm.slug_id(F.col("p_brand"), F.lit(""), F.col("p_name")).alias("slug"))


def folded_tempi(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpm = F.col("p_size").cast("double") * 7 - 14
    return table(spark, sf_dir, "part").select("p_partkey", F.round(nm.folded_tempo(bpm), 6).alias("bpm"))


def checksums16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", nm.crc16(F.col("p_name").cast("binary")).alias("crc"))


def scalar_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid arithmetic: phase, segments, letters and energy levels."""
    from ..operators.sequences import letter

    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        nm.downbeat_phase(F.lit(0.48), F.lit(0.1), F.col("p_retailprice") / 100).alias("phase"),
        nm.segment_count(F.col("p_size") * 40).alias("segments"),
        letter(F.col("p_size") - 1).alias("letter"),
        nm.energy_level(F.col("p_retailprice") / 5000, F.lit(0.0)).alias("energy"),
        nm.phase_verdict(F.col("p_size") / 50, 0.7).alias("verdict"),
        nm.extent(F.col("p_size") % 2 == 0, F.lit(1.0), F.col("p_size").cast("double"), F.lit(8.0), F.col("p_size").cast("double")).alias("beats"),
    )


def bar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier")
    edges = nm.bar_edges(F.col("s_nationkey") + 1, F.lit(1.935), F.lit(22050), F.lit(0.25))
    return p.select("s_suppkey", F.explode(edges).alias("sample"))


def even_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = nm.sample_offsets(F.col("p_retailprice") / 10, 5, 12.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(starts).alias("i", "at")).withColumn("at", F.round("at", 5))


def pattern_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg(F.col("on").cast("int"))
    by = bars(spark, sf_dir).groupBy("track", "stem", F.pmod("bar", F.lit(16)).alias("step")).agg(share.alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("step", "s"))), lambda p: p["s"])
    return by.groupBy("track", "stem").agg(nm.pattern_line(ordered).alias("line"))


def presences(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = 10 * F.log10(F.col("power") / 1e6 + 1e-12)
    by = bars(spark, sf_dir).groupBy("track", "stem", F.floor(F.col("bar") / 16).alias("section")).agg(F.collect_list(db).alias("levels"))
    return by.select("track", "stem", "section", nm.presence(F.col("levels"), F.lit(35.0)).alias("presence"))


def last_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "event_id"])


def compared_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = bars(spark, sf_dir).filter("power > 0").groupBy("track", "stem", (F.col("bar") % 2).alias("side")).agg((10 * F.log10(F.avg("power"))).alias("db"))
    dropped = (F.col("track") + F.length("stem")) % 5
    ref = by.filter((F.col("side") == 0) & (dropped != 1))
    made = rec.compare_sides(ref, by.filter((F.col("side") == 1) & (dropped != 2)), ["track"], "stem", "db", "click", 1.0, 0.2)
    return made.select("track", "item", "yardstick", "kind", *(F.round(c, 4).alias(c) for c in ("reference_db", "ours_db", "difference")), "gap")


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    t = b.select("track").distinct()
    pairs = t.select(F.col("track").alias("a")).join(t.select(F.col("track").alias("b")), F.col("a") < F.col("b"))
    return rec.agreement(b, "track", "bar", "stem", "on", pairs).withColumn("agreement", F.round("agreement", 6))


def distinct_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = agreements(spark, sf_dir).filter("agreement >= 0.6").withColumn("g", F.lit(0)).select("g", "a", "b")
    members = bars(spark, sf_dir).select("track").distinct().withColumn("g", F.lit(0)).withColumn("r", F.col("track"))
    return rec.greedy_distinct(members, near, ["g"], "r", "track").select("track", "kept")


def file_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    path = F.concat_ws("/", "p_brand", "p_name", F.col("p_partkey").cast("string"))
    recorded = part.select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), F.lit(100).cast("long").alias("mtime"))
    drift = F.when(F.col("p_partkey") % 7 == 0, 50).otherwise(1)
    moved = F.when(F.col("p_partkey") % 5 == 0, F.concat(path, F.lit("~"))).otherwise(path)
    listing = part.filter(F.col("p_partkey") % 11 != 0).select(moved.alias("path"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), (F.lit(100) + drift).cast("long").alias("mtime"))
    return rec.freshness(recorded, listing, "path", "name", "size", "mtime").select("id", "state")


def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").select("o_custkey")
    present = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return rec.check_listed(listed, present, "o_custkey")


def listing_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    side = lambda f: li.filter(F.col("l_returnflag") == f).select(F.col("l_partkey") % 50, F.col("l_suppkey") % 10).toDF("p", "s")
    return rec.multiset_difference(side("A"), side("R"))


def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.collisions(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name")), "name")


def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.range(0, 40).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("Customer#00000"), F.lpad(F.col("id").cast("string"), 4, "0"))).otherwise(F.concat(F.lit("#00000"), F.lpad(F.col("id").cast("string"), 3, "0"))).alias("q"))
    return rec.resolve(asked, table(spark, sf_dir, "customer"), "q", "c_name")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    value, source = rec.decide(F.when(F.col("o_orderkey") % 4 == 0, F.lit("8A")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
    return o.select("o_orderkey", value.alias("value"), source.alias("source"))


def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    folder = F.concat(F.col("p_brand"), nm._pick(["/stems", "/mix", "/../x"], F.col("p_size") % 3))
    ext = nm._pick(["wav", "aif", "txt", "mp3"], F.col("p_partkey") % 4)
    name = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 17 == 0, " (conflict)").otherwise(""))
    listing = part.select("p_partkey", folder.alias("folder"), name.alias("name"), ext.alias("ext"))
    return rec.classify_files(listing, "folder", "name", "ext", ["mp3", "wav", "flac", "aif", "aiff", "m4a", "ogg"]).select("p_partkey", "kind")


def command_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rec.usage(e, "event_type", F.col("event_id") % 7, F.col("user_id"), "event_id")


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.sum_sources(bars(spark, sf_dir), ["track"], "bar", "power").select("track", "bar", "mix", "peak")


def refused_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = rec.sum_sources(bars(spark, sf_dir), ["track"], "bar", "power")
    return rec.full_scale(mixed, "peak", 300000).select("track", "bar", "refused")


def unknown_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.unknown_values(table(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase"])


def roots_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as roots, customers as the studies found; some nations can't be read."""
    roots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("root"), F.when(F.col("n_regionkey") == 2, F.concat(F.lit("no folder "), F.col("n_name"))).alias("why"))
    found = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("root"))
    return rec.roots_read(found, roots, "root", "why")


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    mix = b.groupBy("track", "bar").agg(F.sum("power").alias("power"))
    made = rec.residual(mix, b.filter("stem <> 'error'"), ["track"], "bar", "power")
    return made.select("track", "n", "peak", F.round("relative_db", 5).alias("relative_db"))


def preferred_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    best = rec.preferred(part, ["p_name"], [F.col("p_type"), F.col("p_partkey")])
    return best.select("p_name", "p_partkey", "p_type")


def cached_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    hit, miss = rec.reuse(o, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")
    return hit.select("o_orderkey", F.lit("cached").alias("state")).unionByName(miss.select("o_orderkey", F.lit("make").alias("state")))


QUERIES = {f.__name__: f for f in (
    role_keywords, section_names, parsed_keys, key_relations, folder_names, title_keys, slug_ids, folded_tempi, checksums16, scalar_grid, bar_lines, even_windows,
    pattern_lines, presences, last_status, compared_sides, agreements, distinct_studies, file_freshness, manifest_problems, listing_difference, name_collisions,
    resolved_names, decisions, file_classes, command_usage, mixed_sources, refused_mixes, unknown_roles, roots_read, residuals, preferred_files, cached_and_missing,
)}

_L = lambda xs: "[" + ", ".join(repr(x) for x in xs) + "]"
_NOTES = _L(nm.MINOR_NAMES)
_PARSED = f"""k AS (SELECT p_partkey, p_retailprice, p_name, {_NOTES}[CAST(p_partkey % 12 AS INT) + 1] AS note, p_size % 5 AS sfx FROM part),
    pk AS (SELECT *, CASE WHEN sfx <> 4 THEN CAST((CASE substr(note, 1, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END
        + CASE substr(note, 2, 1) WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END + 12) % 12 AS INT) END AS pc, CASE sfx WHEN 0 THEN 'minor' WHEN 2 THEN 'minor' WHEN 4 THEN NULL ELSE 'major' END AS mode FROM k),
    wk AS (SELECT *, CASE mode WHEN 'major' THEN list_position({_L(nm.MAJOR_WHEEL)}, pc) || 'B' WHEN 'minor' THEN list_position({_L(nm.MINOR_WHEEL)}, pc) || 'A' END AS wheel,
        CASE mode WHEN 'major' THEN {_L(nm.MAJOR_NAMES)}[pc + 1] WHEN 'minor' THEN {_NOTES}[pc + 1] || 'm' END AS short FROM pk)"""
ORACLES = {
    "parsed_keys": f"WITH {_PARSED} SELECT p_partkey, pc, mode, wheel, short FROM wk",
    "folder_names": f"""WITH {_PARSED}, t AS (SELECT *, p_retailprice / 10 AS m, CASE p_partkey % 3 WHEN 0 THEN p_retailprice / 10 + 0.5 WHEN 1 THEN 99.0 END AS l FROM wk),
        b AS (SELECT *, CAST(CAST(floor(CASE WHEN l IS NOT NULL AND (m IS NULL OR abs(l - m) <= 1) THEN l ELSE m END + 0.5) AS BIGINT) AS VARCHAR) AS bpm, CASE WHEN p_partkey % 2 = 0 THEN '?' ELSE '' END AS q FROM t)
        SELECT p_partkey, CASE WHEN pc IS NULL THEN p_name || ' [' || bpm || ']' ELSE p_name || ' [' || bpm || ' ' || short || q || ' ' || wheel || q || ']' END AS folder, p_name AS title FROM b""",
    "key_relations": f"""WITH w AS (SELECT p_partkey, p_partkey % 12 + 1 AS na, floor(p_partkey / 12) % 2 AS ra, p_size % 12 + 1 AS nb, floor(p_size / 12) % 2 AS rb FROM part),
        p AS (SELECT *, CASE ra WHEN 0 THEN {_L(nm.MINOR_WHEEL)}[CAST(na AS INT)] ELSE {_L(nm.MAJOR_WHEEL)}[CAST(na AS INT)] END AS pa, CASE rb WHEN 0 THEN {_L(nm.MINOR_WHEEL)}[CAST(nb AS INT)] ELSE {_L(nm.MAJOR_WHEEL)}[CAST(nb AS INT)] END AS pb FROM w)
        SELECT p_partkey, CASE WHEN na = nb AND ra = rb THEN 'exact' WHEN na = nb THEN 'relative' WHEN ra = rb AND (na - nb + 12) % 12 IN (1, 11) THEN 'fifth' WHEN pa = pb THEN 'parallel' ELSE 'different' END AS relation FROM p""",
    "role_keywords": """WITH n AS (SELECT p_partkey, lower(['Bass Drum', 'Hi Tom', 'HH open', 'Sub', 'lead 2', 'Riser', 'vox chop', 'thing'][CAST(p_partkey % 8 AS INT) + 1] || ' ' || p_name) AS n FROM part)
        SELECT p_partkey, CASE WHEN regexp_matches(n, 'kick|(^|[^a-z])bd([^a-z]|$)|bass drum') THEN 'kick' WHEN regexp_matches(n, 'snare|(^|[^a-z])sn([^a-z]|$)') THEN 'snare' WHEN n LIKE '%clap%' THEN 'clap' WHEN n LIKE '%ride%' THEN 'ride'
            WHEN regexp_matches(n, 'shk|shaker') THEN 'shaker' WHEN regexp_matches(n, '(^|[^a-z])[lmh]?toms?([^a-z]|$)') THEN 'tom' WHEN regexp_matches(n, 'hat|(^|[^a-z])hh') THEN 'hats'
            WHEN regexp_matches(n, 'perc|conga|(^|[^a-z])rim([^a-z]|$)|bongo|tambourine|cowbell') THEN 'perc' WHEN regexp_matches(n, 'bass|(^|[^a-z])sub([^a-z]|$)') THEN 'bass'
            WHEN regexp_matches(n, '(^|[^a-z])(lead|ld)([^a-z]|$)') THEN 'lead' WHEN regexp_matches(n, '(^|[^a-z])arp') THEN 'arp' WHEN regexp_matches(n, '(^|[^a-z])pad([^a-z]|$)') THEN 'pad'
            WHEN n LIKE '%drone%' THEN 'drone' WHEN n LIKE '%pluck%' THEN 'pluck' WHEN regexp_matches(n, 'vox|vocal|voice') THEN 'vox'
            WHEN regexp_matches(n, '(^|[^a-z])(fx|rev)([^a-z]|$)|riser|impact|(^|[^a-z])down|sweep|noise') THEN 'fx' WHEN n LIKE '%synth%' THEN 'synth' END AS role FROM n""",
    "section_names": """WITH w AS (SELECT p_partkey, CAST(p_partkey % 6 AS INT) + 1 AS i, p_size, ['A', 'b', ''][CAST(p_partkey % 3 AS INT) + 1] AS p FROM part)
        SELECT p_partkey, CASE WHEN i <> 5 THEN ['Drop', 'Breakdown', 'Intro', 'Main', '', 'Breakdown'][i] || ' ' || p_size END AS label, CASE WHEN i <> 5 THEN CASE WHEN p = 'A' THEN 'A' ELSE '' END END AS part FROM w""",
    "title_keys": "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g') || ' e e' AS key FROM part",
    "slug_ids": "WITH f AS (SELECT p_partkey, p_brand || '/' || p_name AS f FROM part) SELECT p_partkey, left(trim(regexp_replace(f, '[^A-Za-z0-9]+', '-', 'g'), '-'), 60) || '-' || left(sha1(f), 6) AS slug FROM f",
    "folded_tempi": """WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 7 - 14 AS b FROM part) SELECT p_partkey, round(CASE WHEN b <= 0 THEN 120.0 WHEN b < 85 THEN b * pow(2, ceil(log2(85.0 / b)))
        WHEN b > 170 THEN b / pow(2, ceil(log2(b / 170.0))) ELSE b END, 6) AS bpm FROM b""",
    "scalar_grid": """SELECT p_partkey, CAST(((CAST(round_even((p_retailprice / 100 - 0.1) / 0.48, 0) AS BIGINT) % 4) + 4) % 4 AS INT) AS phase, CAST(greatest(4, least(32, round_even(p_size * 40 / 32.0 / 1.6, 0))) AS INT) AS segments,
        CASE WHEN p_size <= 26 THEN chr(64 + p_size) ELSE chr(CAST(64 + floor((p_size - 1) / 26) AS INT)) || chr(65 + (p_size - 1) % 26) END AS letter,
        round(127 * least(1, greatest(0, (10 * log10(p_retailprice / 5000 + 1e-12) + 40) / 40)), 2) AS energy,
        CASE WHEN (p_size / 50 - 0.25) / (0.7 - 0.25) < 0.1 THEN 'chance-level' WHEN (p_size / 50 - 0.25) / (0.7 - 0.25) < 0.35 THEN 'weak' ELSE 'ok' END AS verdict,
        CAST(greatest(CASE WHEN p_size % 2 = 0 THEN p_size - 1.0 ELSE p_size - 8.0 END, 0) AS DOUBLE) AS beats FROM part""",
    "bar_lines": "SELECT s_suppkey, CAST(round_even((0.25 + i * 1.935) * 22050, 0) AS BIGINT) AS sample FROM (SELECT s_suppkey, unnest(range(0, s_nationkey + 2)) AS i FROM supplier)",
    "even_windows": "SELECT p_partkey, CAST(i AS INT) AS i, round(0.1 * p_retailprice / 10 + greatest(0.8 * p_retailprice / 10 - 12, 0) * i / 4, 5) AS at FROM part, range(0, 5) r(i)".replace("AS at", 'AS "at"'),
    "pattern_lines": f"""WITH {BARS}, s AS (SELECT track, stem, bar % 16 AS step, avg(CAST(playing AS INT)) AS s FROM bars GROUP BY ALL)
        SELECT track, stem, string_agg(CASE WHEN s >= 0.75 THEN 'x' WHEN s >= 0.25 THEN 'o' ELSE '.' END, '' ORDER BY step) AS line FROM s GROUP BY ALL""",
    "presences": f"""WITH {BARS}, l AS (SELECT track, stem, CAST(floor(bar / 16) AS BIGINT) AS section, 10 * log10(power / 1e6 + 1e-12) AS db FROM bars)
        SELECT track, stem, section, CASE WHEN count(*) FILTER (WHERE db >= -5) >= greatest(1, count(*) / 4) THEN 'present' WHEN count(*) FILTER (WHERE db >= -25) >= greatest(1, count(*) / 4) THEN 'trace' ELSE 'absent' END AS presence FROM l GROUP BY ALL""",
    "last_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
    "compared_sides": f"""WITH {BARS}, s AS (SELECT track, stem, bar % 2 AS side, 10 * log10(avg(power)) AS db FROM bars WHERE power > 0 GROUP BY ALL),
        j AS (SELECT coalesce(a.track, b.track) AS track, coalesce(a.stem, b.stem) AS item, a.db AS r, b.db AS o FROM (SELECT * FROM s WHERE side = 0 AND (track + length(stem)) % 5 <> 1) a
            FULL JOIN (SELECT * FROM s WHERE side = 1 AND (track + length(stem)) % 5 <> 2) b ON a.track = b.track AND a.stem = b.stem),
        y AS (SELECT track, CASE WHEN coalesce(max(r) FILTER (WHERE item = 'click') >= max(r) FILTER (WHERE item <> 'click') - 1 AND max(o) FILTER (WHERE item = 'click') >= max(o) FILTER (WHERE item <> 'click') - 1, false) THEN 'click'
            ELSE arg_max(item, (r, item)) FILTER (WHERE r IS NOT NULL AND o IS NOT NULL) END AS yardstick FROM j GROUP BY track),
        d AS (SELECT j.*, yardstick, o - max(o) FILTER (WHERE item = yardstick) OVER w - (r - max(r) FILTER (WHERE item = yardstick) OVER w) AS d FROM j JOIN y USING (track) WINDOW w AS (PARTITION BY track))
        SELECT track, item, yardstick, CASE WHEN r IS NOT NULL AND o IS NOT NULL THEN 'both' WHEN r IS NOT NULL THEN 'reference_only' ELSE 'ours_only' END AS kind, round(r, 4) AS reference_db, round(o, 4) AS ours_db,
            round(d, 4) AS difference, coalesce(abs(d) > 0.2, false) AS gap FROM d""",
    "agreements": f"WITH {BARS} SELECT a.track AS a, b.track AS b, round(avg(CAST(a.playing = b.playing AS INT)), 6) AS agreement FROM bars a JOIN bars b ON a.track < b.track AND a.bar = b.bar AND a.stem = b.stem GROUP BY ALL",
    "manifest_problems": """WITH a AS (SELECT o_custkey, count(*) AS a FROM orders GROUP BY 1), b AS (SELECT c_custkey AS o_custkey, count(*) AS b FROM customer GROUP BY 1),
        j AS (SELECT o_custkey, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unlisted' WHEN a > 1 THEN 'duplicate' END AS problem FROM a FULL JOIN b USING (o_custkey)) SELECT * FROM j WHERE problem IS NOT NULL""",
    "listing_difference": """WITH d AS (SELECT l_partkey % 50 AS p, l_suppkey % 10 AS s, CAST(sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS BIGINT) AS d FROM lineitem GROUP BY ALL)
        SELECT p, s, CASE WHEN d > 0 THEN 'before' ELSE 'after' END AS side, abs(d) AS copies FROM d WHERE d <> 0""",
    "name_collisions": "SELECT p_partkey, name FROM (SELECT p_partkey, p_name || ' ' || p_brand AS name, count(*) OVER (PARTITION BY lower(p_name || ' ' || p_brand)) AS n FROM part) WHERE n > 1",
    "resolved_names": """WITH q AS (SELECT DISTINCT CASE WHEN i % 2 = 0 THEN 'Customer#00000' || lpad(CAST(i AS VARCHAR), 4, '0') ELSE '#00000' || lpad(CAST(i AS VARCHAR), 3, '0') END AS name FROM range(0, 40) r(i)), c AS (SELECT c_name FROM customer),
        e AS (SELECT name, c_name AS title FROM q JOIN c ON lower(name) = lower(c_name)), l AS (SELECT name, c_name AS title FROM q JOIN c ON contains(lower(c_name), lower(name)) WHERE name NOT IN (SELECT name FROM e)), a AS (SELECT * FROM e UNION ALL SELECT * FROM l)
        SELECT name, title, count(*) OVER (PARTITION BY name) AS matches FROM a""",
    "checksums16": """WITH b AS (SELECT p_partkey, list_transform(range(1, len(p_name) + 1), lambda i: CAST(ascii(substr(p_name, CAST(i AS INT), 1)) AS BIGINT)) AS b FROM part)
        SELECT p_partkey, CAST(list_reduce(list_concat([0::BIGINT], b), lambda c, x: list_reduce([xor(c, x << 8), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: (CASE WHEN (s & 32768) <> 0 THEN xor(s << 1, 32773) ELSE s << 1 END) & 65535)) AS INT) AS crc FROM b""",
    "decisions": """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '8A' END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS b, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS c FROM orders)
        SELECT o_orderkey, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'decision' WHEN b IS NOT NULL THEN 'published' WHEN c IS NOT NULL THEN 'detected' END AS source FROM d""",
    "file_classes": """WITH f AS (SELECT p_partkey, p_brand || ['/stems', '/mix', '/../x'][p_size % 3 + 1] AS folder, p_partkey % 17 = 0 AS conflict, ['wav', 'aif', 'txt', 'mp3'][CAST(p_partkey % 4 AS INT) + 1] AS ext FROM part),
        n AS (SELECT *, count(*) FILTER (WHERE ext <> 'txt') OVER w AS n, count(*) FILTER (WHERE ext = 'aif') OVER w AS aif FROM f WINDOW w AS (PARTITION BY folder))
        SELECT p_partkey, CASE WHEN contains(folder, '..') THEN 'unsafe' WHEN conflict THEN 'conflict' WHEN ext = 'txt' THEN 'other' WHEN (contains(folder, 'stems') AND n >= 2) OR (n >= 5 AND 2 * aif >= n) THEN 'pack' ELSE 'candidate' END AS kind FROM n""",
    "command_usage": """SELECT event_type, count(*) AS runs, count(*) FILTER (WHERE event_id % 7 <> 0) AS failures, count(DISTINCT CASE WHEN event_id % 7 = 0 THEN user_id END) AS targets, min(event_id) AS "first", max(event_id) AS "last" FROM events GROUP BY event_type""",
    "mixed_sources": f"WITH {BARS}, m AS (SELECT track, bar, CAST(sum(power) AS BIGINT) AS mix FROM bars GROUP BY ALL) SELECT track, bar, mix, max(abs(mix)) OVER (PARTITION BY track) AS peak FROM m",
    "refused_mixes": f"WITH {BARS}, m AS (SELECT track, bar, sum(power) AS mix FROM bars GROUP BY ALL) SELECT track, bar, max(abs(mix)) OVER (PARTITION BY track) >= 300000 AS refused FROM m",
    "unknown_roles": "SELECT event_type, count(*) AS \"rows\" FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1",
    "roots_read": "SELECT n_nationkey AS root, CASE WHEN n_regionkey <> 2 THEN count(c_custkey) END AS studies, CASE WHEN n_regionkey = 2 THEN 'no folder ' || n_name END AS error FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey, n_name",
    "residuals": f"""WITH {BARS}, m AS (SELECT track, bar, sum(power) AS mix, sum(power) FILTER (WHERE stem <> 'error') AS s FROM bars GROUP BY ALL)
        SELECT track, count(*) AS n, CAST(max(abs(mix - s)) AS BIGINT) AS peak, round(10 * log10(sum(pow(mix - s, 2)) / sum(pow(mix, 2)) + 1e-12), 5) AS relative_db FROM m GROUP BY track""",
    "preferred_files": "SELECT p_name, arg_min(p_partkey, (p_type, p_partkey)) AS p_partkey, arg_min(p_type, (p_type, p_partkey)) AS p_type FROM part GROUP BY p_name",
    "cached_and_missing": "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'cached' ELSE 'make' END AS state FROM orders",
    "distinct_studies": f"""WITH RECURSIVE {BARS}, ag AS (SELECT a.track AS a, b.track AS b FROM bars a JOIN bars b ON a.track <> b.track AND a.bar = b.bar AND a.stem = b.stem GROUP BY ALL HAVING avg(CAST(a.playing = b.playing AS INT)) >= 0.6),
        near AS (SELECT a, list(b) AS n FROM ag GROUP BY a), fold AS (SELECT CAST(-1 AS BIGINT) AS t, CAST([] AS BIGINT[]) AS kept UNION ALL
            SELECT t + 1, CASE WHEN list_has_any(kept, coalesce((SELECT n FROM near WHERE a = t + 1), [])) THEN kept ELSE list_append(kept, t + 1) END FROM fold WHERE t < 5)
        SELECT track, list_contains((SELECT kept FROM fold WHERE t = 5), track) AS kept FROM (SELECT DISTINCT track FROM bars)""",
    "file_freshness": """WITH r AS (SELECT p_partkey AS id, p_brand || '/' || p_name || '/' || p_partkey AS path, p_name AS name, p_size AS size FROM part),
        l AS (SELECT CASE WHEN id % 5 = 0 THEN path || '~' ELSE path END AS path, name, size, CASE WHEN id % 7 = 0 THEN 150 ELSE 101 END AS mtime FROM r WHERE id % 11 <> 0),
        n AS (SELECT name, count(*) AS n, list(size) AS sizes FROM l GROUP BY name)
        SELECT id, CASE WHEN l.path IS NOT NULL THEN CASE WHEN l.size = r.size AND abs(l.mtime - 100) <= 2 THEN 'fresh' ELSE 'changed' END WHEN n IS NULL THEN 'missing'
            WHEN len(list_filter(sizes, lambda x: x = r.size)) = 1 THEN 'fresh' WHEN n = 1 THEN 'changed' ELSE 'ambiguous' END AS state FROM r LEFT JOIN l USING (path) LEFT JOIN n ON n.name = r.name""",
}
