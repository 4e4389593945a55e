"""Capped stratified sampling with at most one run of a vehicle, in shuffled order.

The sequential rule walks the rows in order and takes a row unless its stratum is full or
its vehicle was taken before. It is reached in rounds: within each, a vehicle's first
remaining row is its candidate; strata that fill up at the earliest place close, and their
later rows go. A round closes one stratum at least, so there are at most as many rounds as
strata, and one more. All state on the driver is a few numbers for each stratum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordance.operators.tables import written


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``place``: a hash of seed and key, the same on every run and engine, ties by key."""
    return df.withColumn("place", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"))


def draw(frame: DataFrame, per_stratum: int, seed: int, strata: list[str] | None = None, log: str = "log_id", vehicle: str = "vehicle") -> DataFrame:
    """The rows of ``frame`` (with column stratum) that the sequential rule takes."""
    rows = shuffled(frame if strata is None else frame.filter(F.col("stratum").isin(strata)), log, seed)
    rows = written(rows.withColumn("_order", F.struct("place", F.col(log))), "places")  # read once a round
    closed: dict[str, tuple] = {}
    while True:
        open_rows = rows
        for name, (place, key) in closed.items():
            open_rows = open_rows.filter((F.col("stratum") != name) | (F.col("place") < place) | ((F.col("place") == place) & (F.col(log) <= key)))
        first = open_rows.groupBy(vehicle).agg(F.min("_order").alias("_first"))
        right = first.withColumnRenamed(vehicle, "_vehicle")
        firsts = open_rows.join(right, (open_rows[vehicle] == right["_vehicle"]) & (open_rows["_order"] == right["_first"]), "left_semi").unionByName(open_rows.filter(F.col(vehicle).isNull()))
        within = Window.partitionBy("stratum").orderBy("_order")
        taken = firsts.withColumn("_n", F.row_number().over(within))
        full = {r["stratum"]: (r["o"]["place"], r["o"][log]) for r in taken.filter(F.col("_n") == per_stratum).select("stratum", F.col("_order").alias("o")).collect() if r["stratum"] not in closed}
        if not full:
            return taken.filter(F.col("_n") <= per_stratum).drop("_n", "_order")
        soonest = min(full.values())
        closed |= {k: v for k, v in full.items() if v == soonest}


def one_per_group(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """One row of each group, the first in hash order."""
    rows = shuffled(df, key, seed)
    return rows.groupBy(group).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c != group]), F.struct("place", F.col(key))).alias("r")).select(group, "r.*")
