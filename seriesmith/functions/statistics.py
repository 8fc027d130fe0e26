"""Aggregates and array folds: votes, circular means, fits, exact tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def poisson_binomial_tail(probs: Column, k: Column) -> Column:
    """P(at least k successes) of independent trials with the given chances.

    A fold over the chances keeps the distribution of the number so far.
    """
    grow = lambda pmf, p: F.zip_with(
        F.concat(pmf, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), pmf), lambda stay, step: stay * (1.0 - p) + step * p
    )
    pmf = F.aggregate(probs, F.array(F.lit(1.0)), grow)
    upper = F.slice(pmf, (k + 1).cast("int"), F.greatest(F.size(probs) + 1 - k, F.lit(0)).cast("int"))
    return F.when(k <= 0, 1.0).otherwise(F.aggregate(upper, F.lit(0.0), lambda a, x: a + x))


def _binomial(n: int, p: float) -> tuple[int, np.ndarray]:
    """First count and chances of the counts around the mean, beyond which next to none is left."""
    if p >= 1 or p <= 0:
        return (n if p >= 1 else 0), np.ones(1)
    mode, wide = min(n, int((n + 1) * p)), int(14 * (n * p * (1 - p)) ** 0.5) + 60
    low, high = max(0, mode - wide), min(n, mode + wide)
    up, down = np.arange(mode, high), np.arange(mode, low, -1)
    above = np.cumprod((n - up) / (up + 1) * (p / (1 - p)))
    below = np.cumprod(down / (n - down + 1) * ((1 - p) / p))
    pmf = np.concatenate([below[::-1], [1.0], above])
    return low, pmf / pmf.sum()


def repeated_binomial_tail(probs: Column, times: Column, k: Column) -> Column:
    """P(at least k successes) of independent trials, each of the chances ``probs`` met ``times`` times.

    One binomial for each chance, convolved; cost grows with the spread of
    the counts and not with the square of the trials.
    """
    def tail(chances: list[float], counts: list[int], least: int) -> float:
        low, pmf = 0, np.ones(1)
        for p, n in zip(chances, counts):
            at, own = _binomial(int(n), float(p))
            low, pmf = low + at, np.convolve(pmf, own)
        return 1.0 if least <= low else float(min(1.0, pmf[least - low :].sum()))

    @F.pandas_udf("double")
    def run(p: pd.Series, n: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([tail(*x) for x in zip(p, n, least)], dtype=float)

    return F.when(k <= 0, 1.0).otherwise(run(probs, times, k))


def binomial_tail(n: Column, k: Column, p: float | Column) -> Column:
    """P(at least k of n) at chance ``p``.

    Term by term away from the mean, each from the one before, the first in
    logarithms: above the mean the upper terms are summed, else the lower ones
    are taken from one. Nothing grows with n but the number of terms.
    """
    p = p if isinstance(p, Column) else F.lit(float(p))
    q, n, k = 1 - p, n.cast("long"), k.cast("long")
    upper = k > n * p
    at = F.greatest(F.when(upper, k).otherwise(k - 1), F.lit(0).cast("long"))
    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(at, F.lit(1))), F.lit(0.0), lambda a, j: a + F.log((n - at + j) / j))
    first = F.exp(F.when(at > 0, ways).otherwise(0.0) + at * F.log(p) + (n - at) * F.log(q))
    up = lambda a, i: a["term"] * (n - i) / (i + 1) * p / q
    down = lambda a, i: a["term"] * i / (n - i + 1) * q / p

    def add(step):
        def one(a: Column, i: Column) -> Column:
            term = step(a, i)
            return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

        return one

    none, start = F.array().cast("array<bigint>"), F.struct(first.alias("term"), first.alias("sum"))
    above = F.aggregate(F.when(at < n, F.sequence(at, n - 1)).otherwise(none), start, add(up), lambda a: a["sum"])
    below = F.aggregate(F.when(at > 0, F.sequence(at, F.lit(1).cast("long"))).otherwise(none), start, add(down), lambda a: a["sum"])
    tail = F.greatest(F.least(F.when(upper, above).otherwise(1.0 - below), F.lit(1.0)), F.lit(0.0))
    return F.when(k <= 0, 1.0).when((k > n) | (p <= 0), 0.0).when(p >= 1, 1.0).otherwise(tail)


def upper_median(x: str) -> Column:
    """Aggregate: the middle value of a column, of two the larger."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}` DESC)")


def comb_phase(t: Column, period: Column) -> tuple[Column, Column]:
    """Aggregates: coherence (0 to 1) and phase of points modulo a period."""
    angle = 2 * math.pi * t / period
    c, s = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    return F.hypot(c, s), F.pmod(F.atan2(s, c) / (2 * math.pi), F.lit(1.0))


def best_period(df: DataFrame, time: str, keys: list[str], periods: list[float]) -> DataFrame:
    """Most coherent of the candidate periods (the first of equals): keys, period, coherence."""
    tried = df.select(*keys, F.col(time).alias("_t"), F.explode(F.array(*(F.lit(float(p)) for p in periods))).alias("period"))
    r, _ = comb_phase(F.col("_t"), F.col("period"))
    scored = tried.groupBy(*keys, "period").agg(F.round(r, 9).alias("coherence"))
    top = scored.groupBy(*keys).agg(F.max(F.struct("coherence", (-F.col("period")).alias("p"))).alias("b"))
    return top.select(*keys, (-F.col("b.p")).alias("period"), F.col("b.coherence").alias("coherence"))


def phase_means(df: DataFrame, value: str, index: str, keys: list[str], cycle: int = 4) -> DataFrame:
    """Mean of a value by index modulo ``cycle``, as shares; even shares if all are 0."""
    each = df.groupBy(*keys, F.pmod(F.col(index), F.lit(cycle)).cast("int").alias("phase")).agg(F.avg(value).alias("m"))
    total = F.sum("m").over(Window.partitionBy(*keys))
    return each.select(*keys, "phase", F.when(total > 0, F.col("m") / total).otherwise(1.0 / cycle).alias("share"))


def phase_votes(df: DataFrame, time: str, keys: list[str], period: float, start: float, tol: float, cycle: int = 4) -> DataFrame:
    """Votes of points near grid lines for the phase: keys, phase, votes, confidence."""
    k = F.rint((F.col(time) - start) / period)
    snapped = df.withColumn("_k", k).filter(F.abs(F.col(time) - (start + k * period)) <= tol)
    votes = snapped.groupBy(*keys, F.pmod("_k", F.lit(cycle)).cast("int").alias("phase")).agg(F.count(F.lit(1)).alias("votes"))
    by = Window.partitionBy(*keys)
    ranked = votes.withColumn("_r", F.row_number().over(by.orderBy(F.desc("votes"), "phase"))).withColumn("_n", F.sum("votes").over(by))
    return ranked.filter("_r = 1").select(*keys, "phase", "votes", (F.col("votes") / F.col("_n")).alias("confidence"))


def line_fit(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Least-squares slope and intercept of y over x: keys, n, slope, intercept."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def drift(df: DataFrame, period: str, keys: list[str], threshold: float = 0.005) -> DataFrame:
    """(max - min) / median of segment periods against a threshold: keys, drift, drifts."""
    made = df.groupBy(*keys).agg(((F.max(period) - F.min(period)) / F.median(period)).alias("drift"))
    return made.withColumn("drifts", F.col("drift") > threshold)


def vote_text(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """'label n/all' texts of a vote, most votes first, equal ones by name."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))).alias("v"))
    return ranked.select(*keys, "total", F.array_join(F.transform("v", lambda x: F.concat(x["l"], F.lit(" "), (-x["m"]).cast("string"), F.lit("/"), F.col("total").cast("string"))), ", ").alias("votes"))


def f1(recall: Column, precision: Column) -> Column:
    """Harmonic mean; 0 where both are 0."""
    return F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)


def population_stats(df: DataFrame, metrics: list[str], keys: list[str], flagged: str) -> DataFrame:
    """Range, median and n of every metric over all rows and over unflagged ones.

    One pass: the metrics are unpivoted and each row counts once for ``all``
    and once more for ``clean`` where it isn't flagged. Nulls don't count.
    """
    clean = F.when(F.col(flagged), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("clean")))
    each = df.select(*keys, F.explode(clean).alias("population"), *metrics)
    long = each.select(*keys, "population", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("m"))
    return (
        long.select(*keys, "population", "m.metric", "m.v").filter("v is not null").groupBy(*keys, "population", "metric")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.median("v").alias("mid"), F.count(F.lit(1)).alias("n"))
    )


def model_summary(df: DataFrame, model: str, track: str, value: str) -> DataFrame:
    """Per model: upper median, mean, min, max, the track of widest range, tracks won.

    A track is won by the model with the smallest upper median there (of
    equals the first by name).
    """
    by_track = df.groupBy(model, track).agg((F.max(value) - F.min(value)).alias("range"), upper_median(value).alias("mid"))
    widest = by_track.groupBy(model).agg(F.max(F.struct("range", track)).alias("w"))
    won = by_track.groupBy(track).agg(F.min(F.struct("mid", model)).alias("b")).groupBy(F.col(f"b.{model}").alias(model)).agg(F.count(F.lit(1)).alias("won"))
    total = df.groupBy(model).agg(upper_median(value).cast(df.schema[value].dataType).alias("mid"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return total.join(widest, model).join(won, model, "left").select(
        model, "mid", "mean", "low", "high", F.col("w.range").alias("widest_range"), F.col(f"w.{track}").alias("widest_track"), F.coalesce("won", F.lit(0)).alias("won")
    )
