"""Catalogue operators: comparing, matching, deduplicating and checking records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.naming import folded

#: Letters of the pieces by which a part of a title is looked up.
PIECE = 3


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row by ``order``; one partial aggregate, no sort."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def compare_sides(ref: DataFrame, ours: DataFrame, keys: list[str], item: str, level: str, yardstick: str, far: float = 30.0, gap: float = 1.0) -> DataFrame:
    """Full outer comparison of two sides' item levels under one shared yardstick.

    The yardstick is the named item unless it is missing on a side or more
    than ``far`` under the loudest other item there; then it is the loudest
    item of the reference that both sides have. Differences are of levels
    relative to the yardstick. kind is both, reference_only or ours_only; gap
    marks differences over ``gap``.
    """
    a = ref.select(*keys, F.col(item).alias("item"), F.col(level).alias("reference_db"))
    b = ours.select(*keys, F.col(item).alias("item"), F.col(level).alias("ours_db"))
    both = a.join(b, [*keys, "item"], "full")
    by = Window.partitionBy(*keys)
    own = F.col("item") == yardstick
    fine = lambda c: F.max(F.when(own, F.col(c))).over(by) >= F.max(F.when(~own, F.col(c))).over(by) - far
    usable = F.coalesce(fine("reference_db") & fine("ours_db"), F.lit(False))
    shared = F.col("reference_db").isNotNull() & F.col("ours_db").isNotNull()
    loudest = F.max(F.when(shared, F.struct("reference_db", "item"))).over(by)["item"]
    marked = both.withColumn("yardstick", F.when(usable, F.lit(yardstick)).otherwise(loudest))
    at = F.col("item") == F.col("yardstick")
    rel = marked.withColumn("_r", F.col("reference_db") - F.max(F.when(at, F.col("reference_db"))).over(by)).withColumn(
        "_o", F.col("ours_db") - F.max(F.when(at, F.col("ours_db"))).over(by)
    )
    kind = F.when(shared, "both").when(F.col("reference_db").isNotNull(), "reference_only").otherwise("ours_only")
    return rel.select(
        *keys, "item", "yardstick", kind.alias("kind"), "reference_db", "ours_db", (F.col("_o") - F.col("_r")).alias("difference"),
        F.coalesce(F.abs(F.col("_o") - F.col("_r")) > gap, F.lit(False)).alias("gap"),
    )


def agreement(flags: DataFrame, member: str, position: str, part: str, flag: str, pairs: DataFrame) -> DataFrame:
    """Share of equal flags of each pair (a, b) of members over common parts and positions.

    Only pairs with two common parts or more.
    """
    a = flags.select(F.col(member).alias("a"), F.col(position).alias("_p"), F.col(part).alias("_r"), F.col(flag).alias("_x"))
    b = flags.select(F.col(member).alias("b"), F.col(position).alias("_p"), F.col(part).alias("_r"), F.col(flag).alias("_y"))
    both = pairs.join(a, "a").join(b, ["b", "_p", "_r"])
    made = both.groupBy("a", "b").agg(F.avg((F.col("_x") == F.col("_y")).cast("int")).alias("agreement"), F.countDistinct("_r").alias("_n"))
    return made.filter("_n >= 2").drop("_n")


def greedy_distinct(members: DataFrame, links: DataFrame, keys: list[str], rank: str, member: str) -> DataFrame:
    """Keep each member, by rank, unless it is linked to one that was kept.

    ``links(keys, a, b)`` holds the pairs that count as duplicates, either
    way round. The choice depends on order, so a key's members are folded in
    rank order; keys are catalogues of bounded size. Gives keys, member, kept.
    """
    both = links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy(*keys, F.col("a").alias(member)).agg(F.collect_set("b").alias("_near"))
    kind = members.schema[member].dataType.simpleString()
    listed = members.join(near, [*keys, member], "left").withColumn("_near", F.coalesce("_near", F.array().cast(f"array<{kind}>")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(member).alias("m"), F.col("_near").alias("n"))))
    kept = F.aggregate(ordered, F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(F.arrays_overlap(acc, x["n"]), acc).otherwise(F.concat(acc, F.array(x["m"]))))
    chosen = listed.groupBy(*keys).agg(kept.alias("_kept"), F.collect_list(member).alias("_all"))
    return chosen.select(*keys, "_kept", F.explode("_all").alias(member)).select(*keys, member, F.array_contains("_kept", F.col(member)).alias("kept"))


def freshness(recorded: DataFrame, listing: DataFrame, path: str, name: str, size: str, mtime: str, slack: int = 2) -> DataFrame:
    """State of every recorded file: fresh, changed, missing or ambiguous.

    By path: the size must equal and the time differ by ``slack`` at most.
    Else by name: a single file of that name must have the size; of several,
    a single one of equal size will do.
    """
    exact = listing.select(F.col(path), F.col(size).alias("_s"), F.col(mtime).alias("_m"))
    by_name = listing.groupBy(F.col(name)).agg(F.count(F.lit(1)).alias("_n"), F.collect_list(size).alias("_sizes"))
    found = recorded.join(exact, path, "left").join(by_name, name, "left")
    same = F.size(F.filter(F.coalesce("_sizes", F.array().cast("array<bigint>")), lambda s: s == F.col(size)))
    state = (
        F.when(F.col("_s").isNotNull(), F.when((F.col("_s") == F.col(size)) & (F.abs(F.col("_m") - F.col(mtime)) <= slack), "fresh").otherwise("changed"))
        .when(F.col("_n").isNull(), "missing")
        .when(same == 1, "fresh")
        .when(F.col("_n") == 1, "changed")
        .otherwise("ambiguous")
    )
    return found.withColumn("state", state).drop("_s", "_m", "_n", "_sizes")


def check_listed(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Differences of two lists of keys: key, problem (missing, unlisted, duplicate)."""
    a = listed.groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    b = present.groupBy(key).agg(F.count(F.lit(1)).alias("_b"))
    both = a.join(b, key, "full")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unlisted").when(F.col("_a") > 1, "duplicate")
    return both.select(key, problem.alias("problem")).filter("problem is not null")


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counted: columns, side, copies."""
    cols = before.columns
    counts = before.select(*cols, F.lit(1).alias("_d")).unionByName(after.select(*cols, F.lit(-1).alias("_d"))).groupBy(*cols).agg(F.sum("_d").alias("_d"))
    return counts.filter("_d <> 0").select(*cols, F.when(F.col("_d") > 0, "before").otherwise("after").alias("side"), F.abs("_d").alias("copies"))


def collisions(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name occurs more than once, whatever its case and Unicode form."""
    return df.withColumn("_f", folded(F.col(name))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_f"))).filter("_n > 1").drop("_f", "_n")


def preferred(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by an order of preference."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def resolve(names: DataFrame, catalogue: DataFrame, name: str, title: str) -> DataFrame:
    """Catalogue rows a name stands for: name, title, matches.

    A title equal to the name, whatever its case and Unicode form, is a match;
    only names without one are looked for inside titles. A name meets the
    titles that have the rarest of its three-letter pieces; a name of fewer
    letters, which has none, meets the pieces that it is part of. More than
    one match is an ambiguity for the caller.
    """
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("_k", folded(F.col("name")))
    # what comes from the catalogue has more rows than the planner thinks: it is merged, never broadcast
    known = catalogue.select(F.col(title).alias("title"), folded(F.col(title)).alias("_t"))
    exact = asked.join(known.hint("merge"), F.col("_k") == F.col("_t"))
    pieces = lambda s, n: F.array_distinct(F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array(s)))
    open_ = asked.join(exact.select("_k").distinct().hint("merge"), "_k", "left_anti")
    inside = known.select("title", "_t", F.explode(pieces(F.col("_t"), PIECE)).alias("_p"))
    common = inside.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    wanted = open_.filter(F.length("_k") >= PIECE).select("name", "_k", F.explode(pieces(F.col("_k"), PIECE)).alias("_p")).join(common.hint("merge"), "_p")
    rarest = wanted.groupBy("name", "_k").agg(F.min(F.struct("_n", "_p"))["_p"].alias("_p"))
    within = F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *(pieces(F.col("_p"), n) for n in range(1, PIECE))))).alias("_k")
    short = open_.filter(F.length("_k") < PIECE).join(common.select("_p", within).hint("merge"), "_k").select("name", "_k", "_p")
    loose = rarest.unionByName(short).join(inside.hint("merge"), "_p").filter(F.col("_t").contains(F.col("_k"))).select("name", "title").distinct()
    found = exact.select("name", "title").unionByName(loose)
    return found.withColumn("matches", F.count(F.lit(1)).over(Window.partitionBy("name")))


def decide(decision: Column, published: Column, detected: Column) -> tuple[Column, Column]:
    """(value, source) by precedence of decision over published over detected."""
    value = F.coalesce(decision, published, detected)
    return value, F.when(decision.isNotNull(), "decision").when(published.isNotNull(), "published").when(detected.isNotNull(), "detected")


def classify_files(listing: DataFrame, folder: str, name: str, extension: str, audio: list[str]) -> DataFrame:
    """Class of every file: unsafe, conflict, pack, candidate or other.

    A pack is a folder named stems with 2 audio files or more, or any folder
    with 5 or more of which at least half are aif.
    """
    ext = F.lower(F.col(extension))
    is_audio, is_aif = ext.isin(*audio), ext.isin("aif", "aiff")
    by = Window.partitionBy(folder)
    n, aif = F.sum(is_audio.cast("int")).over(by), F.sum(is_aif.cast("int")).over(by)
    pack = (F.lower(F.col(folder)).contains("stems") & (n >= 2)) | ((n >= 5) & (2 * aif >= n))
    kind = (
        F.when(F.col(name).rlike(r"[\x00-\x1f]") | F.col(folder).contains(".."), "unsafe")
        .when(F.lower(F.col(name)).contains("conflict"), "conflict")
        .when(~is_audio, "other").when(pack, "pack").otherwise("candidate")
    )
    return listing.withColumn("kind", kind)


def usage(log: DataFrame, command: str, code: Column, target: Column, ts: str) -> DataFrame:
    """Runs, failures, distinct targets that succeeded, first and last time of each command."""
    return log.groupBy(command).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(code != 0).alias("failures"), F.countDistinct(F.when(code == 0, target)).alias("targets"),
        F.min(ts).alias("first"), F.max(ts).alias("last"),
    )


def fingerprint(*columns: Column) -> Column:
    """Identity of inputs and parameters, for caches."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def reuse(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cached rows that are wanted, wanted rows to make)."""
    return cache.join(wanted.select(key), key, "left_semi"), wanted.join(cache.select(key), key, "left_anti")


def sum_sources(samples: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Sample-wise sum of a key's sources, and the peak of each key."""
    mixed = samples.groupBy(*keys, index).agg(F.sum(value).alias("mix"))
    return mixed.withColumn("peak", F.max(F.abs("mix")).over(Window.partitionBy(*keys)))


def full_scale(mixed: DataFrame, peak: str, full: float = 1.0) -> DataFrame:
    """Adds ``refused``: a sum that reaches full scale isn't written."""
    return mixed.withColumn("refused", F.col(peak) >= full)


def unknown_values(listed: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Values of a column that are none of the known, with the rows that have them: column, rows."""
    return listed.filter(F.col(column).isNotNull() & ~F.col(column).isin(*known)).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def roots_read(found: DataFrame, roots: DataFrame, root: str, error: str) -> DataFrame:
    """Every root with the studies found in it, or the error that it gave: root, studies, error."""
    n = found.groupBy(root).agg(F.count(F.lit(1)).alias("studies"))
    return roots.select(root, error).join(n, root, "left").select(root, F.when(F.col(error).isNull(), F.coalesce("studies", F.lit(0))).alias("studies"), F.col(error).alias("error"))


def residual(mix: DataFrame, stems: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """What the sum of the stems leaves of the mix: keys, n, peak, relative level in dB."""
    total = stems.groupBy(*keys, index).agg(F.sum(value).alias("_s"))
    left = mix.join(total, [*keys, index]).withColumn("_r", F.col(value) - F.col("_s"))
    ratio = F.sum(F.col("_r") ** 2) / F.sum(F.col(value) ** 2)
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("_r")).alias("peak"), (10 * F.log10(ratio + 1e-12)).alias("relative_db"))
