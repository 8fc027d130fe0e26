"""Series that the queries make of the shared test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tracks, seconds of a bar, and the power (cents) above which a part plays.
TRACKS, BAR_SECONDS, PLAYS = 6, 28800, 12000
#: Event type that stands for each part.
PARTS = {"kick": "click", "bass": "purchase", "hats": "view", "synths": "signup", "vocals": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 2024 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast({ts} AS TIMESTAMP_NTZ))")


def cents(c: str = "value") -> Column:
    return F.round(F.col(c) * 100).cast("long")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, stem, bar, power, x (power by the series' largest), on; every bar of every series."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % TRACKS).alias("track"), F.col("event_type").alias("stem"), F.floor(micros() / (BAR_SECONDS * 1_000_000)).alias("bar"), cents().alias("v")
    )
    sums = events.groupBy("track", "stem", "bar").agg(F.sum("v").alias("power"))
    top = sums.agg(F.max("bar").alias("top"))
    grid = sums.select("track", "stem").distinct().crossJoin(F.broadcast(top)).select("track", "stem", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("bar"))
    dense = grid.join(sums, ["track", "stem", "bar"], "left").withColumn("power", F.coalesce("power", F.lit(0)).cast("long"))
    return dense.withColumn("x", F.col("power") / F.max("power").over(Window.partitionBy("track", "stem"))).withColumn("on", F.col("power") > PLAYS)


BARS = f"""
    ev AS (SELECT user_id % {TRACKS} AS track, event_type AS stem,
        CAST(floor((epoch_us(ts) - 1704067200000000) / ({BAR_SECONDS} * 1000000.0)) AS BIGINT) AS bar,
        CAST(round(value * 100) AS BIGINT) AS v FROM events),
    sums AS (SELECT track, stem, bar, CAST(sum(v) AS BIGINT) AS power FROM ev GROUP BY ALL),
    grid AS (SELECT track, stem, unnest(range(0, (SELECT max(bar) + 1 FROM sums))) AS bar FROM (SELECT DISTINCT track, stem FROM sums)),
    bars AS (SELECT track, stem, bar, coalesce(power, 0) AS power,
        coalesce(power, 0) / max(coalesce(power, 0)) OVER (PARTITION BY track, stem) AS x, coalesce(power, 0) > {PLAYS} AS playing
        FROM grid LEFT JOIN sums USING (track, stem, bar))"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, bar, bars (1), a flag for every part that plays, and its power."""
    cols = []
    for part, kind in PARTS.items():
        own = F.col("stem") == kind
        cols += [F.coalesce(F.bool_or(own & F.col("on")), F.lit(False)).alias(part), F.sum(F.when(own, F.col("power")).otherwise(0)).alias(f"{part}_power")]
    return bars(spark, sf_dir).groupBy("track", "bar").agg(*cols).withColumn("bars", F.lit(1).cast("long"))


STEPS = BARS + """,
    steps AS (SELECT track, bar, CAST(1 AS BIGINT) AS bars, """ + ", ".join(
    f"bool_or(stem = '{k}' AND playing) AS {p}, CAST(sum(CASE WHEN stem = '{k}' THEN power ELSE 0 END) AS BIGINT) AS {p}_power" for p, k in PARTS.items()
) + """ FROM bars GROUP BY track, bar)"""
