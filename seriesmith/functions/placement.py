"""Where clips, sections and marks go on a timeline, and the small texts about them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The fader's position at unity, dB for the whole of it, and where that is linear.
UNITY, DB_PER_UNIT, LEAST_DB, MOST_DB = 0.85, 40.0, -18.0, 6.0
#: What ops count as heavy, by name, function or property.
HEAVY_OP, HEAVY_CALL, HEAVY_SET = "warp_markers_set", "create_audio_clip", "warping"
#: Fixed value: under this an SI-SDR only says that nothing correlates.
UNCORRELATED_DB = -30.0
BEATS = 4
_SCENES = r"^\s*(\d+)\s*(?:-\s*(\d+))?\s*$"


def fader(db: Column) -> Column:
    """Fader position of a gain; null outside the linear range."""
    return F.when(db.between(LEAST_DB, MOST_DB), UNITY + db / DB_PER_UNIT)


def scene_range(text: Column) -> Column:
    """struct(first, last) of "A-B" or "A" with 1 <= A <= B; null otherwise."""
    part = lambda i: F.nullif(F.regexp_extract(text, _SCENES, i), F.lit("")).cast("int")
    first, last = part(1), F.coalesce(part(2), part(1))
    return F.when((first >= 1) & (last >= first), F.struct(first.alias("first"), last.alias("last")))


def steady_from(marker: Column, loop_start: Column, loop_end: Column, eps: float = 1e-6) -> Column:
    """Beat from which a loop repeats whole: its first, partial pass ends there."""
    return F.when((F.abs(marker - loop_start) < eps) | (marker >= loop_end - eps), 0.0).otherwise(loop_end - marker)


def grid_offset(start: Column, period: Column) -> Column:
    """Beats between a sample's start and its first grid beat; null without a period."""
    return F.when(period > 0, start / period)


def clip_beat(beat: Column, start: Column, period: Column) -> Column:
    """A section's start in the clip's own beats."""
    return beat + grid_offset(start, period)


def placement(period: Column, start: Column, downbeat: Column, bar: Column) -> Column:
    """struct(position, trim, downbeat): clip start in beats, lead-in to cut in seconds, beat of the downbeat.

    The lead-in up to a bar line is cut, so that a clip starts on ``bar``
    (from 1) and the downbeat falls on a bar line too.
    """
    t0 = F.pmod(start, period)
    k = F.rint((downbeat - t0) / period).cast("long")
    extra = F.pmod(k, F.lit(BEATS))
    position = (bar - 1) * float(BEATS)
    return F.struct(position.alias("position"), (t0 + extra * period).alias("trim"), (position + k - extra).alias("downbeat"))


def note_shift(first_time: Column, first_beat: Column, period: Column, trim: Column) -> Column:
    """Beats by which notes on the sample's grid move when ``trim`` seconds are cut; 0 uncut."""
    return F.when(trim == 0, 0).otherwise(F.rint((first_time - first_beat * period - trim) / period)).cast("int")


def timeline_bar(time: Column, period: Column, position: Column, trim: Column) -> Column:
    """Bar (from 1) of the timeline on which a time of the sample falls."""
    return F.round(1.0 + (position - trim / period + time / period) / BEATS, 2)


def locator(time: Column, period: Column, offset: Column, label: Column, comment: Column, beats: Column) -> Column:
    """struct(time, name): song beat and "Drop 1 (bass in) · 64"; comment and length only if there."""
    bars = F.greatest(F.lit(1), F.rint(beats / BEATS).cast("int")).cast("string")
    name = F.concat(
        label,
        F.when(F.coalesce(comment, F.lit("")) != "", F.concat(F.lit(" ("), comment, F.lit(")"))).otherwise(""),
        F.when(beats.isNotNull(), F.concat(F.lit(" · "), bars)).otherwise(""),
    )
    return F.struct(F.round(offset + time / period, 4).alias("time"), name.alias("name"))


def number_text(x: Column) -> Column:
    """A number without exponent or closing zeros, to 12 places."""
    plain = F.regexp_replace(F.format_string("%.12f", x.cast("double")), r"\.?0+$", "")
    return F.when(plain.isin("", "-0", "-"), "0").otherwise(plain)


def markup_text(text: Column) -> Column:
    """Text as an attribute's value."""
    for mark, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def warp_markers(period: Column, beats: Column) -> Column:
    """array of struct(sec, beat) for a clip from its measured map.

    Without a map of two markers or more the two that pin the tempo; a map
    that doesn't begin at the sample's start gets a marker there.
    """
    pair = lambda s, b: F.struct(s.cast("double").alias("sec"), b.cast("double").alias("beat"))
    zero = pair(F.lit(0.0), F.lit(0.0))
    given = F.transform(beats, lambda m: pair(m["sec"], m["beat"]))
    led = F.when(F.element_at(given, 1)["sec"] > 0, F.concat(F.array(zero), given)).otherwise(given)
    return F.when(F.coalesce(F.size(beats), F.lit(0)) < 2, F.array(zero, pair(period / 32.0, F.lit(1 / 32)))).otherwise(led)


def op_weight(op: Column) -> Column:
    """struct(ops, heavy) that an op (op, function, property, ops) puts into a request.

    A transaction counts what it holds, of which none is a transaction.
    """
    heavy = lambda o: (
        (o["op"] == HEAVY_OP) | ((o["op"] == "call") & (o["function"] == HEAVY_CALL)) | ((o["op"] == "set") & (o["property"] == HEAVY_SET))
    )
    flag = lambda o: F.coalesce(heavy(o), F.lit(False)).cast("int")
    inner = F.aggregate(op["ops"], F.lit(0), lambda n, o: n + flag(o))
    nested = op["op"] == "transaction"
    return F.struct(F.when(nested, F.size(op["ops"])).otherwise(1).alias("ops"), F.when(nested, inner).otherwise(flag(op)).alias("heavy"))


def split_error(text: Column) -> Column:
    """struct(type, message) of "Type: message"; no type if it doesn't begin with a name."""
    head = F.regexp_extract(text, r"(?s)^([\p{L}_][\p{L}\p{N}_]*): (.*)$", 1)
    rest = F.regexp_extract(text, r"(?s)^([\p{L}_][\p{L}\p{N}_]*): (.*)$", 2)
    return F.struct(head.alias("type"), F.when(head != "", rest).otherwise(F.coalesce(text, F.lit(""))).alias("message"))


def censored(db: Column, floor: float = UNCORRELATED_DB) -> Column:
    """A level with one decimal; "<-30" under the floor, "-" for none."""
    known = F.format_string("%.1f", F.bround(db, 1))
    return F.when(db.isNull() | F.isnan(db), "-").when(db < floor, "<%d" % floor).otherwise(known)


def cell_number(x: Column, places: int) -> Column:
    """A number as a table shows it; "-" for none."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), "-").otherwise(F.format_string(f"%.{places}f", F.bround(x.cast("double"), places)))


def text_row(*cells: Column) -> Column:
    """One line of a text table; bars inside cells are marked, null cells are empty."""
    shown = [F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def json_record(version: int, layers: dict[str, Column], wanted: list[str] | None = None) -> Column:
    """A versioned JSON record of all layers, or of those wanted; an unknown name is an error."""
    unknown = [w for w in wanted or [] if w not in layers]
    if unknown:
        raise ValueError(f"no layer {', '.join(unknown)}; there are {', '.join(layers)}")
    return F.to_json(F.struct(F.lit(version).alias("version"), *(c.alias(n) for n, c in layers.items() if wanted is None or n in wanted)))


def log_centroid(levels: Column, bands: list[tuple[float, float]]) -> Column:
    """Frequency at the energy-weighted mean of the log band centres, from levels in dB."""
    centres = F.array(*(F.lit(math.log(math.sqrt(lo * hi))) for lo, hi in bands))
    energy = F.transform(levels, lambda db: F.pow(F.lit(10.0), db / 10))
    add = lambda a, x: a + x
    total = F.aggregate(energy, F.lit(0.0), add)
    return F.when(total > 0, F.exp(F.aggregate(F.zip_with(centres, energy, lambda f, e: f * e), F.lit(0.0), add) / total))


def enough(in_use: Column, known: Column, total: int, needed: int, least_known: int) -> Column:
    """Whether ``needed`` of ``total`` are in use, judged by the known: few of these may be empty.

    What is unknown counts neither way, so hiding one never takes a name away.
    """
    return (known >= least_known) & (known - in_use <= total - needed)


def arranged(stems: DataFrame, keys: list[str], name: str, centroid: str, given: str) -> DataFrame:
    """Stems from low to high: kick, bass, the rest of the kit, others; adds ``place`` from 0.

    Kicks and basses keep their ``given`` order, the others rise by centroid.
    """
    low = F.lower(F.col(name))
    family = F.when(low.contains("kick"), 0).when(low.contains("bass"), 1).when(low.startswith("drum"), 2).otherwise(3)
    inside = F.when(family >= 2, F.col(centroid))
    order = Window.partitionBy(*keys).orderBy(family, inside, given)
    return stems.withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def role_place(role: Column, known: list[str], unmapped: str = "unmapped") -> Column:
    """Order of a role: the known in their order, then others, the unmapped last."""
    at = F.array_position(F.array(*(F.lit(r) for r in known)), role).cast("int")
    return F.when(at > 0, at).when(role == unmapped, len(known) + 2).otherwise(len(known) + 1)
