"""Named sections of every track from the activity of its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.levels import activity_ramp, power_db
from ..operators import sequences as seq
from .tables import PARTS, bars

CUTTING = ("kick", "bass", "hats", "synths")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, section, bar, bars, rel_energy, the parts that play, name and label.

    The state of every part comes from its activity ramp; a bar in which the
    state of a cutting part changes is a cut, moved to the phrase grid where
    it is near and kept apart from other cuts.
    """
    ramp = activity_ramp(bars(spark, sf_dir).withColumn("db", power_db(F.col("power") / 1e6)), "db", ["track", "stem"])
    parts = F.create_map(*(F.lit(x) for k, v in PARTS.items() for x in (v, k)))
    each = seq.hysteresis(ramp.filter("ramp is not null").withColumn("part", parts[F.col("stem")]), "ramp", ["track", "part"], "bar")
    clean = seq.despeckle(each, "state", ["track", "part"], "bar")
    wide = clean.groupBy("track", "bar").agg(
        *(F.coalesce(F.bool_or((F.col("part") == p) & F.col("clean")), F.lit(False)).alias(p) for p in PARTS),
        *(F.coalesce(F.max(F.when(F.col("part") == p, F.col("ramp"))), F.lit(0.0)).alias(f"{p}_x") for p in CUTTING),
        F.sum("power").alias("power"),
    )
    w = Window.partitionBy("track").orderBy("bar")
    changed = F.lit(False)
    for p in CUTTING:
        changed = changed | (F.col(p) != F.lag(p).over(w))
    moved = wide.withColumn("cut", F.coalesce(changed, F.lit(False)))
    offset = seq.phrase_offset(seq.novelty(wide, [f"{p}_x" for p in CUTTING], ["track"], "bar"), "novelty", ["track"], "bar")
    total = moved.groupBy("track").agg((F.max("bar") + 1).alias("total"), F.collect_list(F.when(F.col("cut"), F.col("bar"))).alias("cuts"))
    placed = total.join(offset, "track").withColumn("cuts", F.transform("cuts", lambda c: seq.snapped(c, F.col("phrase_offset"), F.col("total"))))
    kept = placed.select("track", F.concat(F.array(F.lit(0).cast("long")), seq.spaced(F.col("cuts"), F.col("total"))).alias("starts"))
    at = F.size(F.filter("starts", lambda s: s <= F.col("bar"))) - 1
    by = wide.join(kept, "track").withColumn("section", at).groupBy("track", "section")
    found = by.agg(
        F.min("bar").alias("bar"), F.count(F.lit(1)).alias("bars"), F.avg("power").alias("energy"), *((F.avg(F.col(p).cast("int")) > 0.5).alias(p) for p in PARTS)
    )
    rel = found.withColumn("rel_energy", F.round(F.col("energy") / F.avg("energy").over(Window.partitionBy("track")), 4)).drop("energy")
    return seq.stem_labels(rel, ["track"], "section", "kick", "bass", "hats", "synths")
