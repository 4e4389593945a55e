"""The given tables read as frames, pairs, telemetry and fields.

The tables hold no telemetry; each binding keeps the shapes of the studied data (clustered
rows, two-component estimates, cells with few runs) with columns derived from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.functions.classify import airframe_regime, season
from accordance.operators.frame import RETENTION_DAYS
from accordance.session import table

#: The verdict's band in metres a second, placed so that both outcomes occur in these tables.
BAND = 6.15
#: How market segments stand for airframe labels.
AIRFRAMES = {"AUTOMOBILE": "Ground Rover", "BUILDING": "Quadrotor", "FURNITURE": "Fixed Wing", "MACHINERY": "Tiltrotor VTOL", "HOUSEHOLD": "Hexarotor"}
COVERAGE = ("1995-01-01", "2000-12-31", "2002-12-31")


def airframe_label(segment: Column) -> Column:
    out = F.lit("Quadrotor")
    for key, value in AIRFRAMES.items():
        out = F.when(segment == key, value).otherwise(out)
    return out


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata frame: an order is a run, its customer the vehicle."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("log_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("log_date"), F.col("o_custkey").alias("vehicle"),
        airframe_label(F.col("c_mktsegment")).alias("mav_type"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("hw"),
        (F.col("o_orderpriority") == "5-LOW").alias("simulated"), (F.col("o_totalprice") / 5.0).alias("duration_s"),
        F.when(F.col("o_orderstatus") == "F", F.element_at(F.array(*map(F.lit, (0, 5, 8, 10))), (F.col("o_orderkey") % 4 + 1).cast("int"))).otherwise(-1).alias("wind"),
        F.col("c_nationkey").alias("nation"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired windows: an order line is a window of its order's run. Both levels of context, variances, axes."""
    lines, orders, customers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cutoff = orders.agg(F.date_sub(F.max(F.col("o_orderdate").cast("date")), RETENTION_DAYS).alias("cutoff"))
    side = F.when(F.col("o_orderdate").cast("date") >= F.col("cutoff"), "within").otherwise("older")
    runs = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey).join(regions, nations.n_regionkey == regions.r_regionkey).crossJoin(F.broadcast(cutoff))  # one row
    joined = lines.join(runs, F.col("l_orderkey") == F.col("o_orderkey"))  # the lines are the many: they are shuffled once, and narrow
    base = joined.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("o_custkey").alias("vehicle"), F.concat_ws("|", "r_name", side).alias("stratum"), F.col("n_name").alias("nation"),
        F.col("l_shipdate").cast("timestamp").alias("window_start"), (F.col("n_nationkey") * 5 - 60).cast("double").alias("lat"),
        ((F.col("l_quantity") - 25) / 5.0).alias("onboard_u"), (F.col("l_extendedprice") / 10000.0 - 5).alias("onboard_v"),
        (F.col("l_tax") * 100 - 4 + (F.col("l_partkey") % 97) / 97.0).alias("off_u"), (F.col("l_discount") * 100 - 5 + (F.col("l_suppkey") % 89) / 89.0).alias("off_v"),
        (F.col("l_linenumber") * 0.25).alias("sigma_u"), (F.col("l_linenumber") * 0.2).alias("sigma_v"),
        (F.col("l_quantity") / 2).alias("distance_km"), F.col("o_orderpriority").alias("hw"), airframe_label(F.col("c_mktsegment")).alias("mav_type"),
        (F.col("l_extendedprice") / 250 - 60).alias("height_m"),
    )
    out = base.withColumns({
        "var_u": F.col("sigma_u") * F.col("sigma_u"), "var_v": F.col("sigma_v") * F.col("sigma_v"),
        "u100": F.col("onboard_u") + F.col("off_u"), "v100": F.col("onboard_v") + F.col("off_v"),
        "u10": F.col("onboard_u") + F.col("off_u") * 0.8, "v10": F.col("onboard_v") + F.col("off_v") * 0.8,
        "airframe": airframe_regime(F.col("mav_type")), "has_airspeed": F.col("hw") != "5-LOW",
        "season": season(F.col("window_start"), F.col("lat")), "one": F.lit(1.0),
    })
    return out.drop("off_u", "off_v", "sigma_u", "sigma_v", "hw", "mav_type")


#: A total order of windows within a run.
TIES = ["run_id", "line", "part", "supp"]


def gappy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with missing context: null, and not a number."""
    base = pairs(spark, sf_dir)
    return base.withColumn("u10", F.when((F.col("line") == 6) & (F.col("distance_km") > 20), F.lit(None).cast("double")).otherwise(F.col("u10"))).withColumn("v100", F.when((F.col("line") == 3) & (F.col("distance_km") < 2), F.lit(float("nan"))).otherwise(F.col("v100")))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stratum, frame_size): orders of each region and side."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cutoff = orders.agg(F.date_sub(F.max(F.col("o_orderdate").cast("date")), RETENTION_DAYS).alias("cutoff"))
    side = F.when(F.col("o_orderdate").cast("date") >= F.col("cutoff"), "within").otherwise("older")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey).join(regions, nations.n_regionkey == regions.r_regionkey).crossJoin(F.broadcast(cutoff))  # one row
    return joined.groupBy(F.concat_ws("|", "r_name", side).alias("stratum")).agg(F.count(F.lit(1)).alias("frame_size"))


def objections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objections by vehicle (customers in debt) and by log (dear orders)."""
    vehicles = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.lit("vehicle_uuid").alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    logs = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.lit("log_id").alias("kind"), F.col("o_orderkey").cast("string").alias("value"))
    return vehicles.union(logs)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry: an event is a sample of its user's run; views and purchases are wind, clicks and signups positions."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    topic = F.when(F.col("event_type").isin("view", "purchase"), "wind").when(F.col("event_type").isin("click", "signup"), "position").otherwise("other")
    return events.select(
        F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), topic.alias("topic"),
        (F.col("value") / 50 - 2).alias("east"), F.when(F.col("event_type") == "view", k / 10 - 5).when(k % 10 != 3, k / 10 - 5).alias("north"),
        F.when(k % 4 != 1, k / 100).alias("var_u"), (k / 80).alias("var_v"), (k / 4 + 30).alias("lat"), (F.col("value") / 20 - 10).alias("lon"),
    )


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock readings: boot time a second for each event, some without a date, some receivers without any."""
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    utc = F.when(F.col("event_id") % 11 == 0, F.lit(0).cast("long")).when(F.col("event_id") % 13 == 0, F.lit(None).cast("long")).when(F.col("user_id") % 17 == 0, us - 1_500_000_000_000_000).otherwise(us)
    return events.select(F.col("user_id").alias("run_id"), (F.col("event_id") * 1_000_000).alias("boot_us"), utc.alias("utc_us"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete daily windows with a mean position, as asked of the field."""
    from accordance.operators.telemetry import windows

    return windows(samples(spark, sf_dir), "day").filter("complete").withColumn("quality_flags", F.array().cast("array<string>"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field: for each day of telemetry, every grid point that a window or its neighbour hour asks for, with values from its place."""
    from accordance.functions.geometry import grid_index

    asked = daily(spark, sf_dir).select("window_start", grid_index(F.col("lat")).alias("lat_index"), grid_index(F.col("lon")).alias("lon_index"))
    both = asked.union(asked.withColumn("window_start", F.col("window_start") + F.expr("interval 1 hours"))).distinct()
    hour = F.unix_micros("window_start") / 3_600_000_000
    wave = (F.col("lat_index") * 7 + F.col("lon_index") * 3 + hour.cast("long")) % 41
    return both.select(F.col("window_start").alias("time"), "lat_index", "lon_index", (wave / 8.0 - 2).alias("u100"), (wave / 10.0 - 1).alias("v100"), (wave / 16.0 - 2).alias("u10"), (wave / 20.0 - 1).alias("v10")).filter((F.col("lat_index") + F.col("lon_index")) % 10 != 0)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as runs whose labels may be missing, empty or unusable."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels.withColumnRenamed("doc_id", "labelled"), docs.doc_id == F.col("labelled"), "left")
    return joined.select(
        F.col("doc_id").alias("log_id"), F.concat_ws("|", "lang", F.when(F.col("doc_id") % 2 == 0, "within").otherwise("older")).alias("stratum"),
        F.col("labelled").isNotNull().alias("wind_present"), F.when(F.col("labelled").isNotNull(), F.col("quality")).otherwise(0).cast("long").alias("wind_rows"),
        (F.col("n_chars") > 800).alias("position_present"), F.when(F.col("n_chars") > 800, F.col("n_chars") - 900).otherwise(0).alias("position_rows"),
        (F.col("doc_id") % 7 != 0).alias("absolute_time"), (F.col("doc_id") % 5 != 0).alias("columns_present"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation log: each order was tried once or more; the outcome is null where nothing was seen."""
    lines = table(spark, sf_dir, "lineitem")
    outcome = F.when(F.col("l_returnflag") == "A", False).when(F.col("l_returnflag") == "R", F.lit(None).cast("boolean")).otherwise(True)
    return lines.groupBy(F.col("l_orderkey").alias("log_id"), F.col("l_linenumber").alias("attempt")).agg(F.max(outcome).alias("available"))
