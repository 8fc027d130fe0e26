"""Comparing the elements of two mixes, and every statistic of a stem against its truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.levels import active_rows, mean_db, pearson, power_db, si_sdr

#: dB under the elements' sum at which an element is a trace or absent, how far
#: under the loudest other the yardstick is out, and the gaps worth listing.
TRACE_DB, ABSENT_DB, OUT_DB, GAP_DB, WIDTH_GAP = 40.0, 60.0, 30.0, 1.0, 0.1
#: Fixed value: a truth whose active levels vary less has no correlation worth reading.
FLAT_SD_DB = 2.0


def side_levels(bars: DataFrame, keys: list[str], role: str, bar: str, level: str, core: str) -> DataFrame:
    """Level and presence of every role of one side: keys, role, level_db, presence.

    ``level`` and ``core`` are a bar's levels in dB (null: silent), the core
    without the bar's edges. The yardstick of presence is the power sum of the
    side's own cores: a role is present, or a trace, with a quarter of its
    bars (one at least) within TRACE_DB, or ABSENT_DB, of its mean.
    """
    power = lambda c: F.coalesce(F.pow(F.lit(10.0), F.col(c) / 10), F.lit(0.0))
    total = bars.groupBy(*keys, bar).agg(F.sum(power(core)).alias("_p")).groupBy(*keys).agg(F.avg("_p").alias("_m"))
    sum_db = total.select(*keys, F.when(F.col("_m") > 0, 10 * F.log10("_m")).alias("_sum"))
    near = lambda d: F.count_if(F.col(core) >= F.col("_sum") - d)
    need = F.greatest(F.lit(1.0), F.count(F.lit(1)) / 4)
    found = bars.join(sum_db, keys).groupBy(*keys, F.col(role).alias("role")).agg(
        mean_db(F.col(level)).alias("_l"), F.when(near(TRACE_DB) >= need, "present").when(near(ABSENT_DB) >= need, "trace").otherwise("absent").alias("presence")
    )
    return found.select(*keys, "role", F.when(F.col("presence") != "absent", F.col("_l")).alias("level_db"), "presence")


def compare_elements(ref: DataFrame, ours: DataFrame, keys: list[str], yardstick: str = "kick") -> DataFrame:
    """Full outer comparison of two sides' roles, as ratios to one yardstick for both.

    Sides have keys, role, level_db (null: absent) and presence. The yardstick
    is the named role unless a side lacks it; where it is absent, or more than
    OUT_DB under the loudest other role, on either side, it is the role
    present on both that is loudest in the reference, and null without one.

    keys, role, yardstick, kick_out, kind, reference_db, ours_db, difference,
    trace_side, gap. kind: compared, reference_only, ours_only, trace, silent
    in both; a yardstick that is out on one side only is of the other side
    only. Nothing is compared without a yardstick; the yardstick is no row.
    """
    side = lambda d, s: d.select(*keys, "role", F.col("level_db").alias(f"_{s}"), F.col("presence").alias(f"_{s}k"))
    both = side(ref, "r").join(side(ours, "o"), [*keys, "role"], "full")
    by, own = Window.partitionBy(*keys), F.col("role") == yardstick

    def out(s: str) -> Column:
        level, others = F.max(F.when(own, F.col(f"_{s}"))).over(by), F.max(F.when(~own, F.col(f"_{s}"))).over(by)
        return level.isNull() | F.coalesce(others - level > OUT_DB, F.lit(False))

    known = lambda s: F.max((own & F.col(f"_{s}k").isNotNull()).cast("int")).over(by) == 1
    usable = known("r") & known("o")
    shared = (F.col("_rk") == "present") & (F.col("_ok") == "present") & ~own
    loudest = F.max(F.when(shared, F.struct("_r", "role"))).over(by)["role"]
    marked = both.withColumns({"_ro": out("r"), "_oo": out("o"), "_use": usable})
    is_out = F.col("_use") & (F.col("_ro") | F.col("_oo"))
    marked = marked.withColumn("kick_out", is_out).withColumn("yardstick", F.when(F.col("_use"), F.when(is_out, loudest).otherwise(F.lit(yardstick))))
    at = F.col("role") == F.col("yardstick")
    ratio = lambda s: F.round(F.col(f"_{s}") - F.max(F.when(at, F.col(f"_{s}"))).over(by), 2)
    rated = marked.withColumns({"reference_db": ratio("r"), "ours_db": ratio("o")})
    heard = lambda c: F.coalesce(F.col(c).isin("present", "trace"), F.lit(False))
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    alone = own & F.col("kick_out")
    kind = (
        F.when(alone & F.col("_ro") & F.col("_oo"), F.lit(None).cast("string"))
        .when(alone, F.when(F.col("_ro"), "ours_only").otherwise("reference_only"))
        .when((is_("_rk", "present") | is_("_ok", "present")) & heard("_rk") & heard("_ok"), F.when(F.col("yardstick").isNotNull(), "compared"))
        .when(is_("_rk", "present"), "reference_only")
        .when(is_("_ok", "present"), "ours_only")
        .when(is_("_rk", "trace") | is_("_ok", "trace"), "trace")
        .otherwise("silent")
    )
    made = rated.withColumn("kind", kind).filter(F.col("kind").isNotNull() & ~F.coalesce(at, F.lit(False)))
    difference = F.when(F.col("kind") == "compared", F.round(F.col("ours_db") - F.col("reference_db"), 2))
    trace = F.when((F.col("kind") == "compared") & (F.col("_rk") != F.col("_ok")), F.when(F.col("_rk") == "trace", "reference").otherwise("ours"))
    return made.select(
        *keys, "role", "yardstick", "kick_out", "kind", "reference_db", "ours_db", difference.alias("difference"), trace.alias("trace_side"),
        F.coalesce(F.abs(difference) > GAP_DB, F.lit(False)).alias("gap"),
    )


def score_stems(bars: DataFrame, keys: list[str], floor: float = -80.0, span: float = 30.0) -> DataFrame:
    """Every statistic of an estimated stem against its truth, from sums a bar.

    ``bars`` has keys, ss, se, ee (sums of r*r, e*r, e*e), ms_ref, ms_est
    (mean powers) and frames. Levels are of the mean powers; active bars are
    those of the truth. Statistics of active bars are null without any,
    spreads and correlations with fewer than two.
    """
    levels = bars.withColumns({"_r": power_db(F.col("ms_ref")), "_e": power_db(F.col("ms_est")), "_s": si_sdr(F.col("ss"), F.col("se"), F.col("ee"))})
    marked = active_rows(active_rows(levels, "_r", keys, floor, span, "_a"), "_e", keys, floor, span, "_b")
    a, gap = F.col("_a"), F.col("_e") - F.col("_r")
    middle = marked.withColumn("_gap", F.median(F.when(a, gap)).over(Window.partitionBy(*keys)))
    on = lambda c: F.when(a, c)
    ss, se, ee, n = F.sum("ss"), F.sum("se"), F.sum("ee"), F.count_if(a)
    several = lambda c: F.when(n > 1, c)
    made = middle.groupBy(*keys).agg(
        si_sdr(ss, se, ee).alias("si_sdr_db"),
        F.when((ss > 0) & (ee > 0), se / F.sqrt(ss * ee)).alias("rho"),
        F.median(on(F.col("_s"))).alias("si_sdr_active_median_db"),
        F.when(ss > 0, 10 * F.log10((ee + 1e-30) / (ss + 1e-30))).alias("level_gap_db"),
        F.max("_gap").alias("level_gap_active_median_db"),
        several(F.stddev_pop(on(F.col("_r")))).alias("truth_sd_active_db"),
        F.sqrt(F.avg(on((gap - F.col("_gap")) ** 2))).alias("track_err_active_db"),
        pearson(F.col("_e"), F.col("_r")).alias("corr_db"),
        pearson(F.col("ms_est"), F.col("ms_ref")).alias("corr_linear"),
        several(pearson(on(F.col("_e")), on(F.col("_r")))).alias("corr_db_active_raw"),
        n.alias("bars_active_true"),
        F.count_if(F.col("_a") == F.col("_b")).alias("bars_active_agree"),
        F.count(F.lit(1)).alias("bars"),
        F.sum("frames").alias("frames"),
    )
    return made.withColumn("corr_db_active", F.when(F.col("truth_sd_active_db") >= FLAT_SD_DB, F.col("corr_db_active_raw")))


def comparison_counts(profiles: DataFrame, metrics: list[str], flagged: str, tests: dict[str, Column], usable: Column) -> DataFrame:
    """How many references hold each test, over all and over unflagged ones: population, test, hold, of.

    Unusable references are left out of both and told as ``left out``.
    """
    clean = F.when(F.col(flagged), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("clean")))
    each = profiles.withColumn("_u", F.coalesce(usable, F.lit(False)))
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("test"), c.alias("h")) for k, c in tests.items())))
    held = each.filter("_u").select(F.explode(clean).alias("population"), *metrics).select("population", long.alias("t"))
    counts = held.groupBy("population", "t.test").agg(F.count_if("t.h").alias("hold"), F.count("t.h").alias("of"))
    left = each.agg(F.count_if(~F.col("_u")).alias("hold"), F.count(F.lit(1)).alias("of"))
    return counts.unionByName(left.select(F.lit("left out").alias("population"), F.lit("unusable").alias("test"), "hold", "of"))


def width_gaps(table: DataFrame, ref: str, ours: str, partial: str) -> DataFrame:
    """Rows whose stereo widths differ by more than WIDTH_GAP; none where the ranges are partial."""
    d = F.round(F.col(ours) - F.col(ref), 3)
    return table.withColumn("width_difference", d).filter(~F.col(partial) & (F.abs(F.col(ours) - F.col(ref)) > WIDTH_GAP))
