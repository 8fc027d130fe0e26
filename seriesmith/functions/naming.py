"""Names, keys and labels: parsing, normalising and formatting."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Role keywords in order of precedence, on lower-case names.
ROLE_KEYWORDS = [
    ("kick", r"kick|(?<![a-z])bd(?![a-z])|bass drum"),
    ("snare", r"snare|(?<![a-z])sn(?![a-z])"),
    ("clap", r"clap"),
    ("ride", r"ride"),
    ("shaker", r"shk|shaker"),
    ("tom", r"(?<![a-z])[lmh]?toms?(?![a-z])"),
    ("hats", r"hat|(?<![a-z])hh"),
    ("perc", r"perc|conga|(?<![a-z])rim(?![a-z])|bongo|tambourine|cowbell"),
    ("bass", r"bass|(?<![a-z])sub(?![a-z])"),
    ("lead", r"(?<![a-z])lead(?![a-z])|(?<![a-z])ld(?![a-z])"),
    ("arp", r"(?<![a-z])arp"),
    ("pad", r"(?<![a-z])pad(?![a-z])"),
    ("drone", r"drone"),
    ("pluck", r"pluck"),
    ("vox", r"vox|vocal|voice"),
    ("fx", r"(?<![a-z])fx(?![a-z])|riser|impact|(?<![a-z])down|(?<![a-z])rev(?![a-z])|sweep|noise"),
    ("synth", r"synth"),
]
# Names of the pitch classes by mode, and the wheel's tonics from 1 to 12.
MAJOR_NAMES = ["C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
MINOR_NAMES = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "G#", "A", "Bb", "B"]
MAJOR_WHEEL = [11, 6, 1, 8, 3, 10, 5, 0, 7, 2, 9, 4]
MINOR_WHEEL = [8, 3, 10, 5, 0, 7, 2, 9, 4, 11, 6, 1]
# Key profiles, tonic first (Krumhansl and Kessler).
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
# Parts of titles that don't count when titles are compared.
WHEEL_PREFIX = r"^\s*\d{1,2}[AaBb](?:\s+or\s+\d{1,2}[AaBb])*\s*-\s*(?:\d{1,3}\s*-\s*)*"
VIDEO_ID = r"\[[A-Za-z0-9_-]{11}\]"
TEMPO_MARK = r"(?i)(?<![A-Za-z0-9])\d{2,3}\s?bpm(?![A-Za-z])"
KEY_MARK = r"(?<![A-Za-z0-9])(?!Am(?![A-Za-z0-9]))[A-G][#b]?(?:Maj|Min|maj|min|m)(?![A-Za-z0-9])"
FOLDER_SUFFIX = r"\s*\[\s*\d{2,3}(?:\.\d+)?(?:\s+[A-G][#b]?m?\??\s+\d{1,2}[AB]\??)?\s*\]\s*$"
# Spellings of a key, by wheel code and by note.
WHEEL_KEY = r"^(\d{1,2})\s*([ABab])$"
NOTE_KEY = r"^([A-Ga-g])\s*([#b♯♭]?)\s*([A-Za-z]*)$"
# Section names.
SECTION_NAME = r"(?i)^\s*(Intro|Main|Build|Drop|Breakdown|Break|Outro)\b\s*(\d+)?\s*((?-i:[A-Z])\b)?"


def keyword_role(name: Column) -> Column:
    """First role whose pattern a lower-case name has; null without any."""
    low, out = F.lower(name), None
    for role, pattern in ROLE_KEYWORDS:
        out = F.when(low.rlike(pattern), role) if out is None else out.when(low.rlike(pattern), role)
    return out


def section_label(name: Column) -> Column:
    """Kind and number of a section's free-text name; null if it has none."""
    kind = F.initcap(F.regexp_extract(name, SECTION_NAME, 1))
    kind = F.when(kind == "Break", "Breakdown").otherwise(kind)
    number = F.regexp_extract(name, SECTION_NAME, 2)
    return F.when(kind != "", F.when(number != "", F.concat_ws(" ", kind, number)).otherwise(kind))


def section_part(name: Column) -> Column:
    """Part letter (upper case) of a section's name; empty without one."""
    return F.when(section_label(name).isNotNull(), F.regexp_extract(name, SECTION_NAME, 3))


def _pick(values: list, index: Column) -> Column:
    return F.when(index.isNotNull(), F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int")))


def parse_key(text: Column) -> Column:
    """struct(pc, mode) of "A minor", "F#Maj", "C", "Abm" or a wheel code "6A"; null otherwise."""
    s, wheel, note = F.trim(text), WHEEL_KEY, NOTE_KEY
    n = F.regexp_extract(s, wheel, 1)
    number = F.when(n != "", n.cast("int"))
    ring = F.upper(F.regexp_extract(s, wheel, 2))
    on_wheel = number.between(1, 12)
    wheel_pc = F.when(on_wheel, F.when(ring == "A", _pick(MINOR_WHEEL, number - 1)).otherwise(_pick(MAJOR_WHEEL, number - 1)))
    letter = F.upper(F.regexp_extract(s, note, 1))
    sign = F.regexp_extract(s, note, 2)
    suffix = F.regexp_extract(s, note, 3)
    base = F.create_map(*(F.lit(x) for p in zip("CDEFGAB", (0, 2, 4, 5, 7, 9, 11)) for x in p))[letter]
    shift = F.when(sign.isin("#", "♯"), 1).when(sign.isin("b", "♭"), -1).otherwise(0)
    mode = F.when((suffix == "m") | F.lower(suffix).isin("min", "minor"), "minor").when(
        suffix.isin("", "M") | F.lower(suffix).isin("maj", "major"), "major"
    )
    is_wheel = number.isNotNull()
    pc = F.when(is_wheel, wheel_pc).when((letter != "") & mode.isNotNull(), F.pmod(base + shift, F.lit(12)))
    kind = F.when(is_wheel, F.when(ring == "A", "minor").otherwise("major")).otherwise(mode)
    return F.when(pc.isNotNull(), F.struct(pc.cast("int").alias("pc"), kind.alias("mode")))


def short_key(pc: Column, mode: Column) -> Column:
    return F.when(mode == "major", _pick(MAJOR_NAMES, F.pmod(pc, F.lit(12)))).otherwise(F.concat(_pick(MINOR_NAMES, F.pmod(pc, F.lit(12))), F.lit("m")))


def long_key(pc: Column, mode: Column) -> Column:
    names = F.when(mode == "major", _pick(MAJOR_NAMES, F.pmod(pc, F.lit(12)))).otherwise(_pick(MINOR_NAMES, F.pmod(pc, F.lit(12))))
    return F.concat_ws(" ", names, mode)


def wheel_code(pc: Column, mode: Column) -> Column:
    major, minor = (F.array(*(F.lit(x) for x in w)) for w in (MAJOR_WHEEL, MINOR_WHEEL))
    at = F.pmod(pc, F.lit(12)).cast("int")
    return F.when(mode == "major", F.concat(F.array_position(major, at).cast("string"), F.lit("B"))).otherwise(F.concat(F.array_position(minor, at).cast("string"), F.lit("A")))


def key_relation(a: Column, b: Column) -> Column:
    """exact, relative, fifth, parallel or different, of two parsed keys."""
    ca, cb = wheel_code(a["pc"], a["mode"]), wheel_code(b["pc"], b["mode"])
    na, nb = (F.regexp_extract(c, r"^\d+", 0).cast("int") for c in (ca, cb))
    return (
        F.when(ca == cb, "exact")
        .when(na == nb, "relative")
        .when((a["mode"] == b["mode"]) & F.pmod(na - nb, F.lit(12)).isin(1, 11), "fifth")
        .when(a["pc"] == b["pc"], "parallel")
        .otherwise("different")
    )


def listed_tempo(measured: Column, listed: Column) -> Column:
    """The listed tempo if nothing was measured or it is within 1, else the measured."""
    return F.when(listed.isNotNull() & (measured.isNull() | (F.abs(listed - measured) <= 1)), listed).otherwise(measured)


def folder_name(title: Column, bpm: Column, key: Column, detected: Column) -> Column:
    """Title [124 Am 8A], with ? after a detected key; Title [124] without key; null without tempo."""
    tempo = F.floor(bpm + 0.5).cast("string")
    mark = F.when(detected, "?").otherwise("")
    pc, mode = key["pc"], key["mode"]
    full = F.concat(title, F.lit(" ["), tempo, F.lit(" "), short_key(pc, mode), mark, F.lit(" "), wheel_code(pc, mode), mark, F.lit("]"))
    return F.when(key.isNull(), F.concat(title, F.lit(" ["), tempo, F.lit("]"))).otherwise(full)


def bare_title(name: Column) -> Column:
    """A folder's name without its tempo and key suffix."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, FOLDER_SUFFIX, "")), F.lit("")), name)


@F.pandas_udf(StringType())
def unaccented(names: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, which Spark has no function for."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def title_key(name: Column) -> Column:
    """Title by which duplicates are found: without marks, artist, accents and signs.

    The words of what stands after the artist, lower-case, letters and digits
    only; a title that has none of these is itself, lower-case.
    """
    marks = "|".join((VIDEO_ID, f"(?:{TEMPO_MARK})", KEY_MARK))
    parts = F.split(F.regexp_replace(F.regexp_replace(name, WHEEL_PREFIX, ""), marks, " "), " - ")
    song = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts) - 1), " - ")).otherwise(parts[0])
    plain = F.regexp_replace(F.lower(unaccented(song)), r"[^\p{L}\p{N} _-]", "")
    words = lambda text, gap: F.array_join(F.filter(F.split(text, gap), lambda w: w != ""), " ")
    return F.coalesce(F.nullif(words(plain, "[ _-]"), F.lit("")), words(F.lower(name), r"\s"))


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """Composed (NFC) and case-folded: names that are equal for people. Accents stay. Spark has no function for it."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFC", s).casefold())


def digest6(record: Column) -> Column:
    """Six digits by which equal records are told from others."""
    return F.substring(F.md5(F.to_json(record).cast("binary")), 1, 6)


def joined_path(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "/")


def slug_id(*parts: Column) -> Column:
    """Slug of at most 60 characters and 6 digits of the path's SHA-1."""
    full = joined_path(*parts)
    slug = F.substring(F.regexp_replace(F.regexp_replace(full, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.concat_ws("-", slug, F.substring(F.sha1(full.cast("binary")), 1, 6))


def folded_tempo(bpm: Column, low: float = 85.0, high: float = 170.0) -> Column:
    """A tempo doubled or halved into [low, high]; 120 for none."""
    return (
        F.when(bpm <= 0, 120.0)
        .when(bpm < low, bpm * F.pow(F.lit(2.0), F.ceil(F.log2(low / bpm))))
        .when(bpm > high, bpm / F.pow(F.lit(2.0), F.ceil(F.log2(bpm / high))))
        .otherwise(bpm)
    )


def downbeat_phase(period: Column, start: Column, downbeat: Column, cycle: int = 4) -> Column:
    """Grid beat nearest the downbeat, modulo the bar; 0 without a downbeat."""
    return F.coalesce(F.pmod(F.rint((downbeat - start) / period), F.lit(cycle)).cast("int"), F.lit(0))


def segment_count(beats: Column, phrase: int = 32) -> Column:
    """Beats by phrases of ``phrase`` at 1.6 a segment, from 4 to 32."""
    return F.greatest(F.lit(4), F.least(F.lit(32), F.rint(beats / phrase / 1.6).cast("int")))


def sample_offsets(duration: Column, n: int, length: float) -> Column:
    """Starts of ``n`` even windows inside the middle 80 % (one window: its middle)."""
    low, span = 0.1 * duration, F.greatest(0.8 * duration - length, F.lit(0.0))
    if n == 1:
        return F.array(low + span / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + span * i / (n - 1))


def bar_edges(bars: Column, seconds: Column, rate: Column, first: Column) -> Column:
    """Sample index of every bar line."""
    return F.transform(F.sequence(F.lit(0), bars.cast("int")), lambda i: F.rint((first + i * seconds) * rate).cast("long"))


def phase_verdict(confidence: Column, ceiling: float, chance: float = 0.25) -> Column:
    """Confidence rescaled from chance to its detector's ceiling: chance-level, weak or ok."""
    scaled = (confidence - chance) / (ceiling - chance)
    return F.when(scaled < 0.1, "chance-level").when(scaled < 0.35, "weak").otherwise("ok")


def pattern_line(shares: Column) -> Column:
    """x, o or . for every share of an array."""
    return F.array_join(F.transform(shares, lambda s: F.when(s >= 0.75, "x").when(s >= 0.25, "o").otherwise(".")), "")


def presence(levels: Column, reference: Column) -> Column:
    """present, trace or absent: enough bars within 40 or 60 dB of a level."""
    need = F.greatest(F.lit(1.0), F.size(levels) / 4)
    within = lambda d: F.size(F.filter(levels, lambda v: v >= reference - d)) >= need
    return F.when(within(40.0), "present").when(within(60.0), "trace").otherwise("absent")


def energy_level(power: Column, reference_db: Column, span: float = 40.0) -> Column:
    """0 to 127 over ``span`` dB under the reference."""
    db = 10.0 * F.log10(power + 1e-12)
    return F.round(127 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (db - reference_db + span) / span)), 2)


def extent(looping: Column, loop_start: Column, loop_end: Column, start: Column, end: Column) -> Column:
    """Loop length or span of the markers, at least 0."""
    return F.greatest(F.when(looping, loop_end - loop_start).otherwise(end - start), F.lit(0.0))


def crc16(data: Column) -> Column:
    """CRC-16 (polynomial 0x8005, initial 0, not reflected) of up to 16 KiB of a binary column."""
    head = F.substring(data, 1, 16384)
    byte = lambda i: F.conv(F.hex(F.substr(head, i, F.lit(1))), 16, 10).cast("int")
    shift = lambda c: F.when(
        c.bitwiseAND(0x8000) != 0, F.shiftleft(c, 1).bitwiseXOR(F.lit(0x8005))
    ).otherwise(F.shiftleft(c, 1)).bitwiseAND(0xFFFF)
    fold = lambda c, i: F.aggregate(F.sequence(F.lit(1), F.lit(8)), c.bitwiseXOR(F.shiftleft(byte(i), 8)), lambda x, _: shift(x))
    length = F.octet_length(head)
    return F.when(length == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), length), F.lit(0), fold))
