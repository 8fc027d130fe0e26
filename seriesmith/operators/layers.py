"""Assembling a catalogue's records from layers, and planning what to do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.naming import folded, parse_key, wheel_code
from ..functions.statistics import binomial_tail

#: Weights of the cues of a downbeat: low band on it and two on, high band beside it, harmony.
LOW_1, LOW_3, HIGH, HARMONY = 1.5, 1.0, 0.8, 2.0
#: How sure a key is by its source, the surest last.
SURENESS = ("detected", "online", "tagged", "by ear")


def layer_state(present: Column, readable: Column, version: Column, current: int) -> Column:
    """missing, unreadable, newer (listed, not read), older (read with a caveat) or present."""
    return (
        F.when(~F.coalesce(present, F.lit(False)), "missing").when(~F.coalesce(readable, F.lit(False)) | version.isNull(), "unreadable")
        .when(version > current, "newer").when(version < current, "older").otherwise("present")
    )


def best_profile(profiles: DataFrame, keys: list[str], state: str, mtime: str, path: str) -> DataFrame:
    """One profile a key: a fresh one first, then the newest, then by path."""
    order = Window.partitionBy(*keys).orderBy(F.when(F.col(state) == "fresh", 0).otherwise(1), F.desc(mtime), path)
    return profiles.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def assembled(studies: DataFrame, layers: dict[str, DataFrame], keys: list[str], commands: dict[str, str]) -> DataFrame:
    """Studies with every layer's state, and what to run for those that are missing.

    A layer has keys, state and a struct ``body``; studies without its row
    lack it. Adds <layer>_state and <layer> for each, and ``todo``.
    """
    made = studies
    for name, layer in layers.items():
        own = layer.select(*keys, F.col("state").alias(f"{name}_state"), F.col("body").alias(name))
        made = made.join(own, keys, "left").withColumn(f"{name}_state", F.coalesce(f"{name}_state", F.lit("missing")))
    todo = F.concat_ws("; ", *(F.when(F.col(f"{n}_state") == "missing", F.lit(commands[n])) for n in layers if n in commands))
    return made.withColumn("todo", todo)


def marker_fields(key: Column, code: Column, source: Column, bpm: Column) -> dict[str, Column]:
    """Validated fields of a marker: key, wheel code (made where it is missing), source, bpm."""
    parsed = parse_key(key)
    valid = parsed.isNotNull()
    return {
        "key": F.when(valid, key), "code": F.when(valid, F.coalesce(F.nullif(F.trim(code), F.lit("")), wheel_code(parsed["pc"], parsed["mode"]))),
        "source": F.when(valid & source.isin(*SURENESS), source), "bpm": F.when((bpm > 0) & ~F.isnan(bpm.cast("double")), bpm),
    }


def sureness(source: Column) -> Column:
    """0 to 3 by the source of a key; -1 for none."""
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SURENESS)), source).cast("int") - 1, F.lit(-1))


def replaces(new: Column, old: Column) -> Column:
    """Whether a key of source ``new`` may take the place of one of source ``old``: never a weaker one."""
    return sureness(new) >= sureness(old)


def joined_lookup(studies: DataFrame, lookup: DataFrame, name: str) -> DataFrame:
    """Studies and lookup rows by folded name, with the unmatched of both: columns, match.

    match is both, study only or lookup only.
    """
    a = studies.withColumns({"_k": folded(F.col(name)), "_a": F.lit(True)})
    b = lookup.withColumns({"_k": folded(F.col(name)), "_b": F.lit(True)}).withColumnRenamed(name, "lookup_name")
    match = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "study only").otherwise("lookup only")
    return a.join(b, "_k", "full").withColumn("match", match).drop("_k", "_a", "_b")


def rename_moves(plan: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose name changes, with a refusal for those without a new name: old, new, refused."""
    return plan.filter(~F.col(new).eqNullSafe(F.col(old))).withColumn("refused", F.col(new).isNull())


def recorded_paths(inputs: DataFrame, folders: DataFrame, path: str, folder: str) -> DataFrame:
    """How many recorded paths lie below every folder: folder, paths.

    Every folder a path lies in is one of its beginnings at a slash, so that
    an equi-join finds them.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = inputs.filter(F.size(parts) > 1).select(F.explode(F.array_distinct(above)).alias("_f"))
    counts = each.withColumn("_f", folded(F.col("_f"))).groupBy("_f").agg(F.count(F.lit(1)).alias("paths"))
    return folders.withColumn("_f", folded(F.col(folder))).join(counts, "_f", "left").select(folder, F.coalesce("paths", F.lit(0)).alias("paths"))


def placed_clip(clips: DataFrame, wanted: DataFrame, keys: list[str], start: str, position: str, tol: float = 1e-4) -> DataFrame:
    """The first clip that starts at each wanted position: keys, position, clip (null for none).

    Positions are looked up by steps of the tolerance, and the steps beside.
    """
    left = wanted.withColumn("_b", F.explode(F.array(*(F.floor(F.col(position) / tol) + d for d in (-1, 0, 1)))))
    right = clips.select(*keys, F.col("clip").alias("_c"), F.col(start).alias("_s"), F.floor(F.col(start) / tol).alias("_b"))
    near = left.join(right, [*keys, "_b"]).filter(F.abs(F.col("_s") - F.col(position)) <= tol)
    first = near.groupBy(*keys, position).agg(F.min("_c").alias("clip"))
    return wanted.join(first, [*keys, position], "left")


def audio_targets(tracks: DataFrame, keys: list[str], index: str, audio: str, wanted: str) -> DataFrame:
    """Tracks to use: the first ``wanted`` that can hold audio; an unknown kind can't. Adds ``place`` from 0."""
    usable = tracks.filter(F.coalesce(F.col(audio), F.lit(False)))
    ranked = usable.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1).cast("int"))
    return ranked.filter(F.col("place") < F.col(wanted))


def resolved_truth(names: DataFrame, roles: DataFrame, sources: DataFrame, name: str, path: str) -> DataFrame:
    """Paths of the names that a reading is scored against: name, path, state.

    A role's file, else a source's; a name of both is ambiguous and has none.
    """
    a = roles.select(F.col(name), F.col(path).alias("_r"))
    b = sources.select(F.col(name), F.col(path).alias("_s"))
    both = names.join(a, name, "left").join(b, name, "left")
    clash = F.col("_r").isNotNull() & F.col("_s").isNotNull()
    state = F.when(clash, "ambiguous").when(F.col("_r").isNotNull(), "role").when(F.col("_s").isNotNull(), "source").otherwise("missing")
    return both.select(*names.columns, F.when(~clash, F.coalesce("_r", "_s")).alias(path), state.alias("state"))


def usable_references(refs: DataFrame, layers: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """References once each, usable or with the layers they lack: keys, usable, reason."""
    has = layers.groupBy(*keys).agg(F.collect_set("layer").alias("_has"))
    listed = F.array(*(F.lit(w) for w in wanted))
    lacking = F.array_except(listed, F.coalesce("_has", F.array().cast("array<string>")))
    made = refs.dropDuplicates(keys).join(has, keys, "left")
    return made.select(*keys, (F.size(lacking) == 0).alias("usable"), F.when(F.size(lacking) > 0, F.concat(F.lit("no "), F.array_join(lacking, ", "))).alias("reason"))


def key_roles(files: DataFrame, keys: list[str], role: str, wanted: list[str], partial: bool = False) -> DataFrame:
    """Which roles a key estimate rests on: keys, roles, complete, refused.

    Incomplete ones are refused unless ``partial`` is allowed; none at all always.
    """
    own = files.filter(F.col(role).isin(*wanted)).groupBy(*keys).agg(F.array_sort(F.collect_set(role)).alias("roles"))
    made = files.select(*keys).distinct().join(own, keys, "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    n = F.size("roles")
    return made.withColumn("complete", n == len(wanted)).withColumn("refused", (n == 0) | ((n < len(wanted)) & F.lit(not partial)))


def downbeat_scores(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the four phases from the cues' shares: keys, phase, score, confidence, best.

    ``shares`` has keys, phase and the columns low, high and harmony, each
    summing to 1 over the phases. A null harmony has no weight. Of equal
    scores the first phase is best.
    """
    other = lambda d, c: shares.select(*keys, F.pmod(F.col("phase") - d, F.lit(4)).alias("phase"), F.col(c).alias(f"{c}{d}"))
    both = shares.join(other(2, "low"), [*keys, "phase"]).join(other(1, "high"), [*keys, "phase"]).join(other(3, "high"), [*keys, "phase"])
    score = LOW_1 * F.col("low") + LOW_3 * F.col("low2") + HIGH * (F.col("high1") + F.col("high3")) + F.coalesce(HARMONY * F.col("harmony"), F.lit(0.0))
    made = both.select(*keys, "phase", score.alias("score"))
    by = Window.partitionBy(*keys)
    total = F.sum("score").over(by)
    ranked = made.withColumn("confidence", F.when(total > 0, F.col("score") / total).otherwise(0.25))
    return ranked.withColumn("best", F.row_number().over(by.orderBy(F.desc("score"), "phase")) == 1)


def pooled_vote(boundaries: DataFrame, keys: list[str], at: str, alpha: float = 0.01, least: int = 8, cycle: int = 4) -> DataFrame:
    """Phase of boundaries pooled over several segmentations: keys, phase, share, p, decides.

    p is the larger of the tails against even phases and against the
    runner-up at one half, so that a tie decides nothing; nor do fewer votes
    than ``least``.
    """
    votes = boundaries.groupBy(*keys, F.pmod(F.col(at), F.lit(cycle)).cast("int").alias("phase")).agg(F.count(F.lit(1)).alias("v"))
    by = Window.partitionBy(*keys)
    order = by.orderBy(F.desc("v"), F.desc("phase"))
    ranked = votes.withColumns({"_r": F.row_number().over(order), "_n": F.sum("v").over(by), "_next": F.coalesce(F.lead("v").over(order), F.lit(0))}).filter("_r = 1")
    p = F.greatest(binomial_tail(F.col("_n"), F.col("v"), 1 / cycle), binomial_tail(F.col("v") + F.col("_next"), F.col("v"), 0.5))
    made = ranked.select(*keys, "phase", (F.col("v") / F.col("_n")).alias("share"), F.col("_n").alias("votes"), p.alias("p"))
    return made.withColumn("decides", (F.col("votes") >= least) & (F.col("p") <= alpha))


def agreed_tempo(halves: DataFrame, keys: list[str], half: str, bpm: str, score: str, detected: str, within: float = 0.02) -> DataFrame:
    """Best tempo of both halves of a track, told only if they agree: keys, bpm, ratio, agree.

    The ratio is to the detected tempo, which every row carries.
    """
    best = Window.partitionBy(*keys, half).orderBy(F.desc(score), bpm)
    top = halves.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    low, high = F.min(bpm), F.max(bpm)
    agree = (F.count(F.lit(1)) == 2) & (high - low <= within * low)
    return top.groupBy(*keys).agg(F.when(agree, F.avg(bpm)).alias("bpm"), F.max(detected).alias("_d"), agree.alias("agree")).select(
        *keys, "bpm", (F.col("bpm") / F.col("_d")).alias("ratio"), "agree"
    )


def gate_counts(hits: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """By stem: hits, those a gate would silence, and groups that coincide but aren't marked.

    ``hits`` has keys and true (a true onset is near), ``groups`` keys,
    coincident and leak.
    """
    a = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.count_if(~F.col("true")).alias("gated"))
    b = groups.groupBy(*keys).agg(F.count_if(F.col("coincident") & ~F.col("leak")).alias("unmarked"))
    return a.join(b, keys, "left").withColumn("unmarked", F.coalesce("unmarked", F.lit(0)))


def run_until(plan: DataFrame, done: DataFrame, key: str, order: str, limit: int, failed_from: str | None = None) -> DataFrame:
    """What a run would take up: rows not done, in order, up to a limit and before the first failure."""
    left = plan.join(done.select(key).distinct(), key, "left_anti")
    w = Window.orderBy(order)  # of the rows that the limit lets through
    some = left.orderBy(order).limit(limit).withColumn("place", F.row_number().over(w))
    if failed_from is None:
        return some
    bad = F.max(F.coalesce(F.col(failed_from), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return some.withColumn("_bad", F.coalesce(bad, F.lit(0))).filter("_bad = 0").drop("_bad")
