"""Clock anchors and hourly windows of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions.classify import MAX_DATE_DAYS, MAX_SPREAD_S, window_flags
from accordance.operators.ranking import nearest_rank

#: 2000-01-01 and 9999-12-31 in microseconds: before, a receiver had no date; after, no timestamp can hold it.
_YEAR_2000_US, _LAST_US = 946_684_800_000_000, 253_402_214_400_000_000
#: A hundredth of a millimetre.
PLACE_DIGITS = 10


def clock_anchors(gps: DataFrame, run: str = "run_id", boot_us: str = "boot_us", utc_us: str = "utc_us") -> DataFrame:
    """(run, offset_us, spread_s, samples, first_boot_us): the upper median of utc - boot over samples with a date."""
    dated = gps.filter((F.col(utc_us) != 0) & F.col(utc_us).isNotNull() & F.col(boot_us).isNotNull())
    dated = dated.withColumn("_off", F.try_subtract(F.col(utc_us), F.col(boot_us))).filter("_off is not null")
    spread = dated.groupBy(run).agg(((F.max("_off") - F.min("_off")) / 1e6).alias("spread_s"), F.count(F.lit(1)).alias("samples"), F.min(boot_us).alias("first_boot_us"))
    middle = nearest_rank(dated, [run], "_off", {"offset_us": 0.5})
    return spread.join(middle, run)


def to_utc(boot_us: Column, offset_us: Column) -> Column:
    """The time of a boot-clock reading; null where no timestamp can hold it."""
    us = F.try_add(boot_us, offset_us)
    return F.when(us.between(-62_135_596_800_000_000, _LAST_US), F.timestamp_micros(us))


def anchor_reason(offset_us: Column, first_boot_us: Column, expected: Column, days: int = MAX_DATE_DAYS) -> Column:
    """Why a run has no absolute time: null if it has one. A run may precede its expected date by any time, and follow it by ``days``."""
    us = F.try_add(first_boot_us, offset_us)
    return (
        F.when(offset_us.isNull(), "no dated sample")
        .when(us.isNull() | ~us.between(-62_135_596_800_000_000, _LAST_US), "unrepresentable")
        .when(us < _YEAR_2000_US, "before 2000")
        .when(F.datediff(F.to_date(F.timestamp_micros(us)), F.to_date(expected)) > days, "after its upload")
    )


def trustworthy(spread_s: Column) -> Column:
    return spread_s <= MAX_SPREAD_S


def windows(samples: DataFrame, unit: str = "hour") -> DataFrame:
    """Windows of (run_id, ts, topic, east, north, var_u, var_v, lat, lon): one aggregation for both topics.

    Rows of topic ``wind`` count if both components are there, their variances if both are;
    rows of topic ``position`` if both coordinates are. A window with only one of the topics
    is kept, as a full outer join of the two would. Mean coordinates are rounded to ``PLACE_DIGITS``,
    so that the order of a sum doesn't decide a tie between two grid points.
    """
    start = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    wind = (F.col("topic") == "wind") & F.col("north").isNotNull() & F.col("east").isNotNull()
    varied = wind & F.col("var_u").isNotNull() & F.col("var_v").isNotNull()
    place = (F.col("topic") == "position") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    mean = lambda when, name: F.avg(F.when(when, F.col(name)))
    out = samples.filter(wind | place).groupBy("run_id", start.alias("window_start")).agg(
        mean(wind, "east").alias("onboard_u"), mean(wind, "north").alias("onboard_v"), mean(varied, "var_u").alias("var_u"), mean(varied, "var_v").alias("var_v"),
        F.count_if(wind).alias("wind_samples"), F.count_if(place).alias("position_samples"), F.round(mean(place, "lat"), PLACE_DIGITS).alias("lat"), F.round(mean(place, "lon"), PLACE_DIGITS).alias("lon"),
    )
    return out.withColumn("complete", (F.col("wind_samples") > 0) & (F.col("position_samples") > 0))


def flagged(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """Windows with their clock's spread and their quality flags; runs without an anchor have a null spread."""
    out = found.join(anchors.select("run_id", "spread_s"), "run_id", "left")
    return out.withColumn("quality_flags", window_flags(F.col("wind_samples"), F.col("position_samples"), F.col("complete"), F.col("spread_s")))
