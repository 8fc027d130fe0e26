"""What a clip plays in a window, when two windows play the same, and the structure of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.naming import digest6
from ..functions.placement import steady_from
from . import sequences as seq

EPS = 1e-6
#: Shortest loop that is unrolled and longest that is told by its cycle, in beats.
SHORTEST, LONGEST = 1 / 64, 32.0
#: The role whose line is the hook, and the pitched ones.
HOOK, PITCHED = "lead", ("bass", "lead", "arp", "pad", "drone", "pluck", "synth")

NOTE = "struct<pitch:int,at:double,len:double,vel:int>"
RECORD = f"struct<kind:string,length:double,digest:string,cycle:array<{NOTE}>,phase:double,window:double,events:array<{NOTE}>,held:array<int>,after:array<int>>"


def scene_beats(clips: DataFrame, keys: list[str], looping: str, beats: str) -> DataFrame:
    """Length of a scene: its longest looping clip, else its longest: keys, beats."""
    made = F.coalesce(F.max(F.when(F.col(looping), F.col(beats))), F.max(beats), F.lit(0.0))
    return clips.groupBy(*keys).agg(made.alias("beats"))


def _note(pitch: Column, at: Column, length: Column, velocity: Column) -> Column:
    """A note as it is compared: times to a thousandth, velocity by eighths."""
    return F.struct(pitch.cast("int").alias("pitch"), F.round(at, 3).alias("at"), F.round(length, 3).alias("len"), F.floor(velocity / 8).cast("int").alias("vel"))


def note_record(looping: Column, marker: Column, start: Column, stop: Column, notes: Column, sounding: Column, w0: Column, w1: Column) -> Column:
    """What a voice plays in beats [w0, w1): a RECORD, null if it is silent.

    ``notes`` are structs (start, duration, pitch, velocity) of the clip,
    ``sounding`` structs (start, stop, pitch, velocity) as they are heard. A
    clip in its steady loop is its cycle and the phase of the window; anything
    else is the events that begin in the window, what is held in from before
    and what sounds on after it.
    """
    heard = F.filter(sounding, lambda i: (i["start"] < w1 - EPS) & (i["stop"] > w0 + EPS))
    length, steady = stop - start, steady_from(marker, start, stop)
    own = F.filter(notes, lambda n: (n["start"] >= start - EPS) & (n["start"] < stop - EPS))
    cycle = F.array_sort(F.transform(own, lambda n: _note(n["pitch"], n["start"] - start, F.least(n["start"] + n["duration"], stop) - n["start"], n["velocity"])))
    window = F.round(w1 - w0, 3)
    none = F.array().cast(f"array<{NOTE}>")
    loop = F.struct(
        F.lit("loop").alias("kind"), F.round(length, 3).alias("length"), digest6(F.struct(cycle.alias("c"))).alias("digest"), cycle.alias("cycle"),
        F.round(F.pmod(w0 - steady, length), 3).alias("phase"), window.alias("window"), none.alias("events"), F.array().cast("array<int>").alias("held"), F.array().cast("array<int>").alias("after"),
    )
    begun = F.array_sort(F.transform(F.filter(heard, lambda i: i["start"] >= w0 - EPS), lambda i: _note(i["pitch"], i["start"] - w0, i["stop"] - i["start"], i["velocity"])))
    pitches = lambda xs: F.array_sort(F.array_distinct(F.transform(xs, lambda i: i["pitch"].cast("int"))))
    events = F.struct(
        F.lit("ev").alias("kind"), F.lit(None).cast("double").alias("length"), F.lit(None).cast("string").alias("digest"), none.alias("cycle"), F.lit(None).cast("double").alias("phase"), window.alias("window"),
        begun.alias("events"), pitches(F.filter(heard, lambda i: i["start"] < w0 - EPS)).alias("held"), pitches(F.filter(heard, lambda i: i["stop"] >= w1 - EPS)).alias("after"),
    )
    steadily = looping & (length >= SHORTEST) & (length <= LONGEST + EPS) & (w0 >= steady - EPS)
    return F.when(F.size(heard) > 0, F.when(steadily, loop.cast(RECORD)).otherwise(events.cast(RECORD)))


def canonical(record: Column) -> Column:
    """The record as text without what hangs on where in its loop a window begins."""
    loop = F.to_json(F.struct(record["kind"].alias("kind"), record["length"].alias("length"), record["digest"].alias("digest")))
    return F.when(record["kind"] == "loop", loop).otherwise(F.to_json(record))


def unrolled(record: Column, beats: Column) -> Column:
    """Events that begin in the first ``beats`` of a record, a loop unrolled from its phase."""
    def rounds(n: Column) -> Column:
        first = n["at"] - record["phase"]
        first = first + record["length"] * F.greatest(F.ceil((-first - EPS) / record["length"]), F.lit(0))
        count = F.greatest(F.ceil((beats - EPS - first) / record["length"]), F.lit(0)).cast("int")
        times = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(times, lambda k: F.struct(n["pitch"].alias("pitch"), F.round(first + k * record["length"], 3).alias("at"), n["len"].alias("len"), n["vel"].alias("vel")))

    begun = F.filter(record["events"], lambda e: e["at"] < beats - EPS)
    return F.array_sort(F.when(record["kind"] == "loop", F.flatten(F.transform(record["cycle"], rounds))).otherwise(begun))


def same_content(a: Column, b: Column) -> Column:
    """Whether window ``b`` plays what ``a``, the window before, did.

    Two loops by their cycles. Events over the shorter window; one in which
    nothing new begins, only notes held in that sounded on, is the same. A
    loop and events by what begins, the loop unrolled.
    """
    beats = F.least(a["window"], b["window"])
    x, y = unrolled(a, beats), unrolled(b, beats)
    held = (F.size(y) == 0) & (F.size(b["held"]) > 0) & (F.size(F.array_except(b["held"], a["after"])) == 0)
    loops = (a["kind"] == "loop") & (b["kind"] == "loop")
    events = (a["kind"] == "ev") & (b["kind"] == "ev")
    return F.when(loops, (a["length"] == b["length"]) & (a["digest"] == b["digest"])).otherwise((x == y) | (events & held))


def structure_numbers(steps: DataFrame, sections: DataFrame, keys: list[str], order: str, weight: str, flags: dict[str, str]) -> DataFrame:
    """Numbers of a track's form: hook, bass entry, kick and hats gaps, second drop against the first.

    ``flags`` maps lead, bass, kick and hats to the columns that say whether
    they play; ``sections`` has keys, label, bar, bars. Entries and gaps are
    by stretches of 4 bars or more. One row a key that has steps.
    """
    base = steps.groupBy(*keys).agg(F.sum(weight).alias("bars"), F.count(F.lit(1)).alias("steps"))
    lead, by = flags["lead"], Window.partitionBy(*keys)
    played = steps.groupBy(*keys).agg(
        F.count_if(lead).alias("hook_steps"), F.sum(F.when(F.col(lead), F.col(weight)).otherwise(0)).alias("hook_bars"), F.min(F.when(F.col(lead), F.col(order))).alias("hook_first"),
        F.count_if(flags["hats"]).alias("hats_steps"),
    )
    longest = seq.run_table(steps, lead, keys, order, F.col(weight)).filter("value").groupBy(*keys).agg(F.max("span").alias("hook_longest"))
    drops = sections.groupBy(*keys).agg(
        F.min(F.when(F.col("label").startswith("Drop"), F.col("bar"))).alias("first_drop"),
        F.sum(F.when(F.col("label") == "Drop 1", F.col("bars"))).alias("_d1"), F.sum(F.when(F.col("label") == "Drop 2", F.col("bars"))).alias("_d2"),
    )
    found = base.join(played, keys).join(longest, keys, "left").join(drops, keys, "left")
    for part in ("bass", "kick", "hats"):
        entered = seq.entries(steps, flags[part], keys, order, weight).select(*keys, F.col("enters").alias(f"{part}_enters"), F.col("trailing").alias(f"{part}_trailing"))
        gaps = seq.stretch_gaps(steps, flags[part], keys, order, weight).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{part}_gaps"), F.max("bars").alias(f"{part}_longest_out"))
        found = found.join(entered, keys, "left").join(gaps, keys, "left").na.fill(0, [f"{part}_gaps", f"{part}_longest_out"])
    return found.select(
        *keys, "bars", "steps", "hook_steps", "hook_bars", "hook_first", F.coalesce("hook_longest", F.lit(0)).alias("hook_longest"), "bass_enters", "first_drop",
        (F.col("bass_enters") < F.col("first_drop")).alias("bass_before_drop"), "kick_enters", "kick_gaps", "kick_longest_out", "kick_trailing", "hats_steps",
        (F.col("hats_enters").isNotNull() & (F.col("hats_gaps") == 0)).alias("hats_constant"), "hats_trailing", F.when(F.col("_d1") > 0, F.round(F.col("_d2") / F.col("_d1"), 3)).alias("drop_ratio"),
    )


def step_flags(changes: DataFrame, keys: list[str], order: str, change: str) -> DataFrame:
    """What every step after the first adds: keys, order, flag (only a removal, nothing new, or null)."""
    new, gone = F.col(change).isin("enter", "vary"), F.col(change).isin("leave", "thin")
    made = changes.groupBy(*keys, order).agg(F.coalesce(F.bool_or(new), F.lit(False)).alias("_n"), F.coalesce(F.bool_or(gone), F.lit(False)).alias("_g"))
    first = F.min(order).over(Window.partitionBy(*keys))
    flag = F.when(F.col("_n"), F.lit(None).cast("string")).when(F.col("_g"), "only a removal").otherwise("nothing new")
    return made.withColumn("_f", first).filter(F.col(order) > F.col("_f")).select(*keys, order, flag.alias("flag"))


def pitched_parts(steps: DataFrame, sections: DataFrame, keys: list[str], role: str, bar: str, playing: str) -> DataFrame:
    """Most pitched roles that play at once in every section: sections, pitched."""
    counts = steps.filter(F.col(role).isin(*PITCHED)).groupBy(*keys, F.col(bar).alias("_bar")).agg(F.count_if(playing).alias("_n"))
    spans = sections.join(counts, keys, "left").filter(F.col("_bar").isNull() | ((F.col("_bar") >= F.col("bar")) & (F.col("_bar") < F.col("bar") + F.col("bars"))))
    most = spans.groupBy(*keys, "bar").agg(F.max("_n").alias("pitched"))
    return sections.join(most, [*keys, "bar"], "left").withColumn("pitched", F.coalesce("pitched", F.lit(0)))
