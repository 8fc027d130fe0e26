"""Levels in decibels and statistics on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Floors and ranges of levels, in dB.
POWER_FLOOR, AMPLITUDE_FLOOR = 1e-12, 1e-12
RAMP_DB, SILENT_DB, LEAST_AUDIBLE = 30.0, -50.0, 4


def power_db(power: Column, floor: float = POWER_FLOOR) -> Column:
    """10 log10 of a power over a floor; -120 for none."""
    return 10.0 * F.log10(power + F.lit(floor))


def amplitude_db(x: Column, floor: float = AMPLITUDE_FLOOR) -> Column:
    """20 log10 of an amplitude, at least the floor's."""
    return 20.0 * F.log10(F.greatest(x, F.lit(floor)))


def db_power(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def mean_db(db: Column) -> Column:
    """Aggregate: power mean of levels; null levels count as no power; null without power."""
    mean = F.avg(F.coalesce(db_power(db), F.lit(0.0)))
    return F.when(mean > 0, 10.0 * F.log10(mean))


def si_sdr(ss: Column, se: Column, ee: Column) -> Column:
    """Scale-invariant SDR in dB from the sums r*r, e*r and e*e; null for a silent reference."""
    target = se * se / ss
    noise = F.greatest(ee - target, F.lit(0.0))
    return F.when(ss > 0, 10.0 * F.log10((target + POWER_FLOOR) / (noise + F.greatest(target, F.lit(1.0)) * 1e-12)))


def pearson(a: Column, b: Column, undefined: float | None = None) -> Column:
    """Aggregate: correlation; ``undefined`` (null) without variance or two points."""
    c = F.corr(a, b)
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(undefined).cast("double"))


def activity_ramp(df: DataFrame, db: str, keys: list[str], out: str = "ramp") -> DataFrame:
    """0 to 1 over the 30 dB under a series' 95th percentile of audible levels.

    Inaudible rows are 0; a series with fewer than 4 audible rows is null.
    """
    audible = F.col(db) > SILENT_DB
    by = Window.partitionBy(*keys)
    top = F.percentile(F.when(audible, F.col(db)), F.lit(0.95)).over(by)
    enough = F.count(F.when(audible, 1)).over(by) >= LEAST_AUDIBLE
    ramp = F.least(F.greatest((F.col(db) - top + RAMP_DB) / RAMP_DB, F.lit(0.0)), F.lit(1.0))
    return df.withColumn(out, F.when(enough, F.when(audible, ramp).otherwise(0.0)))


def active_rows(df: DataFrame, db: str, keys: list[str], floor: float = -80.0, span: float = 30.0, out: str = "active") -> DataFrame:
    """Whether a level is above the floor and less than ``span`` under the loud level."""
    audible = F.col(db) > floor
    top = F.percentile(F.when(audible, F.col(db)), F.lit(0.95)).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.coalesce(audible & (F.col(db) > top - span), F.lit(False)))
