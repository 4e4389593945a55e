"""Characterisation of a metadata frame: counts by key, tiers, retention, eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the studied method.
MIN_DURATION_S, MAX_DURATION_S, TIERS, RETENTION_DAYS, TOP = 300, 24 * 3600, (120, 180, 300, 600), 365, 15


def plausible(duration: str = "duration_s") -> Column:
    """A number of seconds within a day."""
    return F.coalesce(F.col(duration).between(0, MAX_DURATION_S), F.lit(False))


def audit(frame: DataFrame) -> DataFrame:
    """One row of counts: simulated and real records, implausible durations, the frame, and hours."""
    real, inside = ~F.col("simulated"), plausible()
    in_frame = real & inside & (F.col("duration_s") >= MIN_DURATION_S)
    return frame.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("simulated").alias("simulated"),
        F.count_if(real).alias("real"),
        F.count_if(real & ~inside).alias("implausible"),
        F.count_if(in_frame).alias("frame"),
        F.rint(F.sum(F.when(real & inside, F.col("duration_s"))) / 3600).cast("long").alias("hours"),
    )


def key_counts(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, value, n) for several keys in one pass."""
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string"), F.lit("unset")).alias("value")) for k in keys]))
    return frame.select(entries.alias("e")).groupBy("e.key", "e.value").agg(F.count(F.lit(1)).alias("n"))


def top_per_key(counts: DataFrame, most: int = TOP) -> DataFrame:
    """The most frequent values of each key, ties by value."""
    order = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def duration_tiers(frame: DataFrame, tiers: Sequence[int] = TIERS) -> DataFrame:
    """(tier_s, n): how many real, plausible records last at least so long; tiers are nested."""
    base = frame.filter(~F.col("simulated") & plausible())
    row = base.agg(*[F.count_if(F.col("duration_s") >= t).alias(str(t)) for t in tiers])
    return row.unpivot([], [str(t) for t in tiers], "tier_s", "n").select(F.col("tier_s").cast("long").alias("tier_s"), "n")


def retention(frame: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """The newest date, the cutoff ``days`` before it, and the counts on either side; nothing for an empty frame."""
    newest = frame.agg(F.max("log_date").alias("newest"))
    dated = frame.crossJoin(F.broadcast(newest.select("newest", F.date_format(F.date_sub(F.to_date("newest"), days), "yyyy-MM-dd").alias("cutoff"))))  # one row
    within = F.col("log_date") >= F.col("cutoff")
    return dated.groupBy("newest", "cutoff").agg(F.count_if(within).alias("within"), F.count_if(~within).alias("older"))


def with_side(frame: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """``frame`` with side: within or older than ``days`` before the newest date; no date is older."""
    cutoff = frame.agg(F.date_format(F.date_sub(F.to_date(F.max("log_date")), days), "yyyy-MM-dd").alias("cutoff"))
    out = frame.crossJoin(F.broadcast(cutoff))  # one row
    return out.withColumn("side", F.when(F.col("log_date") >= F.col("cutoff"), "within").otherwise("older"))


def without_objections(df: DataFrame, objections: DataFrame, log: str = "log_id", vehicle: str = "vehicle") -> DataFrame:
    """``df`` without logs and vehicles objected to; objections(kind, value). Two anti joins, as a disjunction would need a nested loop."""
    values = objections.select("kind", F.col("value").cast("string").alias("value"))
    for kind, column in (("log_id", log), ("vehicle_uuid", vehicle)):
        own = values.filter(F.col("kind") == kind).select(F.col("value").alias("_out")).distinct()
        df = df.join(own, df[column].cast("string") == own["_out"], "left_anti")
    return df


def restricted(records: DataFrame, sample: DataFrame | None, key: str = "log_id") -> tuple[DataFrame, DataFrame]:
    """The records whose run was drawn, and one row with the count of those outside; without a sample nothing is restricted."""
    if sample is None:
        return records, records.limit(0).agg(F.count(F.lit(1)).alias("outside"))
    drawn = sample.select(key).distinct()
    return records.join(drawn, key, "left_semi"), records.join(drawn, key, "left_anti").agg(F.count(F.lit(1)).alias("outside"))


def plain_id(column: Column) -> Column:
    """An id without its dashes."""
    return F.replace(column, F.lit("-"), F.lit(""))


def require_within(sample: DataFrame, frame: DataFrame, key: str = "log_id") -> DataFrame:
    """``sample``, refused if one of its ids (dashes aside) isn't in the frame."""
    drawn, known = sample.withColumn("_id", plain_id(F.col(key))), frame.select(plain_id(F.col(key)).alias("_id")).distinct()
    absent = drawn.join(known, "_id", "left_anti").select(key).limit(3).collect()  # a few to name
    if absent:
        raise ValueError(f"the sample isn't of this frame: {', '.join(str(r[0]) for r in absent)}")
    return sample


def first_usable(runs: DataFrame, most: int, usable: str = "usable", key: str = "log_id") -> DataFrame:
    """The first ``most`` usable runs in the order of their ids."""
    return runs.filter(usable).orderBy(key).limit(most)


def eligible(frame: DataFrame, objections: DataFrame | None = None) -> DataFrame:
    """Real, plausible, long enough, and not objected to."""
    out = frame.filter(~F.col("simulated") & plausible() & (F.col("duration_s") >= MIN_DURATION_S))
    return without_objections(out, objections) if objections is not None else out
