"""Queries on telemetry and its context: clocks, windows, flags, grid joins, features, release markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.functions import geometry
from accordance.functions.classify import join_flags, release_marker, required_marker, rounded
from accordance.operators import context, ranking, telemetry
from accordance.plans import bindings
from accordance.sources.readers import hours_spanned, request_key
from accordance.streaming.hourly import hourly


def _iso(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def clock_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.clock_anchors(bindings.gps(spark, sf_dir))
    return found.select("run_id", "offset_us", rounded(F.col("spread_s")).alias("spread_s"), "samples", telemetry.trustworthy(F.col("spread_s")).alias("trusted"))


def clock_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with why it has no absolute time; the expected date is that of the run's first reading, or early for some runs."""
    gps = bindings.gps(spark, sf_dir)
    runs = bindings.samples(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("first"))
    expected = F.when(F.col("run_id") % 5 == 0, F.date_sub(F.to_date("first"), 30)).otherwise(F.to_date("first"))
    joined = runs.join(telemetry.clock_anchors(gps), "run_id", "left")
    return joined.select("run_id", F.coalesce(telemetry.anchor_reason(F.col("offset_us"), F.col("first_boot_us"), expected), F.lit("ok")).alias("reason"))


def _windows(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    out = telemetry.windows(bindings.samples(spark, sf_dir), unit)
    return out.select("run_id", _iso("window_start"), *[rounded(F.col(c)).alias(c) for c in ("onboard_u", "onboard_v", "var_u", "var_v", "lat", "lon")], "wind_samples", "position_samples", "complete")


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "hour")


def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "day")


def window_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = telemetry.windows(bindings.samples(spark, sf_dir), "day")
    out = telemetry.flagged(found, telemetry.clock_anchors(bindings.gps(spark, sf_dir)))
    return out.select("run_id", _iso("window_start"), F.array_join("quality_flags", ",").alias("flags"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.with_join_flags(context.nearest_join(bindings.daily(spark, sf_dir), bindings.grid(spark, sf_dir)))


def nearest_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joined(spark, sf_dir)
    return out.select("run_id", _iso("window_start"), *[rounded(F.col(c)).alias(c) for c in ("grid_lat", "grid_lon", "u100", "v100", "u10", "v10", "distance_km", "mismatch_s")])


def midpoint_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = context.midpoint(bindings.daily(spark, sf_dir), bindings.grid(spark, sf_dir))
    return out.select("run_id", _iso("window_start"), *[rounded(F.col(c)).alias(c) for c in context.VALUES])


def join_flags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of joins under narrow tolerances, so that both occur; nothing is dropped."""
    out = context.nearest_join(bindings.daily(spark, sf_dir), bindings.grid(spark, sf_dir))
    out = out.withColumn("distance_km", geometry.haversine_km(F.col("lat"), F.col("lon"), F.col("grid_lat"), F.col("grid_lon"))).withColumn("mismatch_s", context.mismatch_s(F.col("time"), F.col("window_start")))
    flags = join_flags(F.col("quality_flags"), F.col("distance_km"), F.col("mismatch_s"), 12.0, 1200.0)
    return out.select("run_id", _iso("window_start"), F.array_join(flags, ",").alias("flags"))


join_flags_query.__name__ = "join_flags"


def join_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows seen and paired, and the least, upper median and greatest distance to a grid point."""
    out = joined(spark, sf_dir).withColumn("all", F.lit("all"))
    counts = out.groupBy("all").agg(F.count(F.lit(1)).alias("seen"), F.count("u100").alias("paired"), rounded(F.min("distance_km"), 2).alias("least_km"), rounded(F.max("distance_km"), 2).alias("greatest_km"))
    middle = ranking.nearest_rank(out, ["all"], "distance_km", {"median_km": 0.5})
    return counts.join(middle.select("all", rounded(F.col("median_km"), 2).alias("median_km")), "all").drop("all")


def context_features_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features for each paired window, with flags and release marker."""
    out = joined(spark, sf_dir).filter("u100 is not null").withColumn("window", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).withColumn("flags", F.array_join("quality_flags", ","))
    names = {"u100": "wind_u_100m", "v100": "wind_v_100m", "u10": "wind_u_10m", "v10": "wind_v_10m"}
    tall = context.tall(out, ["run_id", "window", "flags"], names)
    return tall.withColumn("value", rounded(F.col("value")))


def haversine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every position sample to its nearest grid point, and the point."""
    rows = bindings.samples(spark, sf_dir).filter("topic = 'position' and lat is not null and lon is not null")
    lat, lon = geometry.snap(F.col("lat")), geometry.snap(F.col("lon"))
    km = geometry.haversine_km(F.col("lat"), F.col("lon"), lat, lon)
    return rows.select("event_id", rounded(lat).alias("grid_lat"), rounded(lon).alias("grid_lon"), rounded(km).alias("distance_km"), rounded(geometry.east_longitude(F.col("lon"))).alias("east_lon"), (km <= geometry.half_cell_km()).alias("inside_cell"))


def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each daily window the nearest of points that change by day: every place at which wind was sampled that day."""
    asked = bindings.daily(spark, sf_dir).withColumn("key", F.concat_ws("@", "run_id", F.date_format("window_start", "yyyy-MM-dd")))
    seen = bindings.samples(spark, sf_dir).filter("topic = 'wind' and lat is not null and lon is not null")
    points = seen.select(F.date_trunc("day", "ts").alias("time"), F.col("event_id").alias("point_id"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    out = context.irregular_nearest(asked, points, "key", 2.0)
    return out.select("key", "point_id", rounded(F.col("distance_km")).alias("distance_km"))


def nearest_station_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all suppliers (as stations) within 2 degrees of latitude, for each daily window."""
    from accordance.session import table

    asked = bindings.daily(spark, sf_dir).withColumn("key", F.concat_ws("@", "run_id", F.date_format("window_start", "yyyy-MM-dd")))
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 97 / 4.0 + 30).alias("plat"), (F.col("s_suppkey") % 89 / 6.0 - 10).alias("plon"))
    return context.fixed_nearest(asked, points, "key", 2.0)


def release_marker_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by release; the check runs before any read, and fails the query for a time outside the field."""
    rows = bindings.pairs(spark, sf_dir)
    marker = required_marker(F.col("window_start"), *bindings.COVERAGE)
    return rows.groupBy(F.date_format("window_start", "yyyy").alias("year"), marker.alias("marker")).agg(F.count(F.lit(1)).alias("n"))


release_marker_query.__name__ = "release_marker"


def release_markers_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted distinct markers of each stratum, comma-joined; null outside a shorter coverage is counted."""
    rows = bindings.pairs(spark, sf_dir).withColumn("marker", release_marker(F.col("window_start"), "1996-01-01", "1998-06-30", "2000-12-31"))
    return rows.groupBy("stratum").agg(F.array_join(F.array_sort(F.collect_set("marker")), ",").alias("markers"), F.count_if(F.col("marker").isNull()).alias("outside"))


def context_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's request for context: the hours spanned by its day's samples, refused across months, and the request's key."""
    rows = bindings.samples(spark, sf_dir)
    spans = rows.groupBy("run_id", F.date_trunc("day", "ts").alias("day")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    hours = hours_spanned(F.col("start"), F.col("end"))
    text = F.date_format("day", "yyyy-MM-dd")
    key = request_key(F.struct(text.alias("day"), F.size(hours).alias("hours"), F.col("run_id").alias("run")))
    return spans.select("run_id", text.alias("day"), F.size(hours).cast("long").alias("hours"), key.alias("key"))


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over the same rows as a batch."""
    rows = bindings.samples(spark, sf_dir).withColumnRenamed("east", "value")
    return hourly(rows).select("run_id", _iso("window_start"), "wind_samples", "position_samples", rounded(F.col("mean_value")).alias("mean_value"))


QUERIES = [clock_anchor, clock_rejects, hourly_windows, daily_windows, window_quality_flags, nearest_grid_join, midpoint_interpolation, join_flags_query, join_summary, context_features_tall, haversine_distance, nearest_station, nearest_station_all, release_marker_query, release_markers_seen, context_requests, hourly_counts]

R = lambda x, name: f"round({x}, 6) + 0e0 AS {name}"
SAMPLES = """samples AS (SELECT user_id AS run_id, event_id, ts, CASE WHEN event_type IN ('view', 'purchase') THEN 'wind' WHEN event_type IN ('click', 'signup') THEN 'position' ELSE 'other' END AS topic, value / 50 - 2 AS east,
  CASE WHEN event_type = 'view' THEN k / 10 - 5 WHEN k % 10 <> 3 THEN k / 10 - 5 END AS north, CASE WHEN k % 4 <> 1 THEN k / 100 END AS var_u, k / 80 AS var_v, k / 4 + 30 AS lat, value / 20 - 10 AS lon FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events))"""
GPS = """gps AS (SELECT user_id AS run_id, event_id * 1000000 AS boot_us, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN NULL WHEN user_id % 17 = 0 THEN epoch_us(ts) - 1500000000000000 ELSE epoch_us(ts) END AS utc_us FROM events),
  anchors AS (SELECT run_id, list(utc_us - boot_us ORDER BY utc_us - boot_us)[(floor(count(*) * 0.5e0) + 1)::BIGINT] AS offset_us, (max(utc_us - boot_us) - min(utc_us - boot_us)) / 1e6 AS spread_s, count(*) AS samples, min(boot_us) AS first_boot_us FROM gps WHERE utc_us <> 0 GROUP BY run_id)"""


def _win(unit: str) -> str:
    return f"""{SAMPLES}, win AS (SELECT run_id, date_trunc('{unit}', ts) AS window_start, avg(CASE WHEN w THEN east END) AS onboard_u, avg(CASE WHEN w THEN north END) AS onboard_v, avg(CASE WHEN w AND var_u IS NOT NULL THEN var_u END) AS var_u, avg(CASE WHEN w AND var_u IS NOT NULL THEN var_v END) AS var_v,
  count_if(w)::BIGINT AS wind_samples, count_if(p)::BIGINT AS position_samples, round(avg(CASE WHEN p THEN lat END), 10) AS lat, round(avg(CASE WHEN p THEN lon END), 10) AS lon, count_if(w) > 0 AND count_if(p) > 0 AS complete
  FROM (SELECT *, topic = 'wind' AND north IS NOT NULL AS w, topic = 'position' AS p FROM samples) WHERE w OR p GROUP BY ALL)"""


ISO = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start"
WINDOWS = f"SELECT run_id, {ISO}, {', '.join(R(c, c) for c in ('onboard_u', 'onboard_v', 'var_u', 'var_v', 'lat', 'lon'))}, wind_samples, position_samples, complete FROM win"
KM = lambda a, b, c, d: f"(2 * 6371.0088e0 * asin(sqrt((pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
FIELD = f"""{_win('day')}, daily AS (SELECT *, round_even(lat / 0.25e0, 0)::INT AS la, round_even(lon / 0.25e0, 0)::INT AS lo FROM win WHERE complete),
  cells AS (SELECT DISTINCT t AS time, la, lo FROM (SELECT window_start AS t, la, lo FROM daily UNION ALL SELECT window_start + INTERVAL 1 HOUR, la, lo FROM daily)),
  waves AS (SELECT *, (la * 7 + lo * 3 + (epoch_us(time) // 3600000000)) % 41 AS wave FROM cells WHERE (la + lo) % 10 <> 0), grid AS (SELECT time, la, lo, wave / 8e0 - 2 AS u100, wave / 10e0 - 1 AS v100, wave / 16e0 - 2 AS u10, wave / 20e0 - 1 AS v10 FROM waves),
  j AS (SELECT d.*, g.time, g.la * 0.25e0 AS grid_lat, g.lo * 0.25e0 AS grid_lon, u100, v100, u10, v10 FROM daily d LEFT JOIN grid g ON g.time = d.window_start AND g.la = d.la AND g.lo = d.lo), jd AS (SELECT *, {KM('lat', 'lon', 'grid_lat', 'grid_lon')} AS distance_km, CASE WHEN time IS NOT NULL THEN -1800e0 END AS mismatch_s FROM j)"""
PAIR_YEARS = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

ORACLES = {
    "clock_anchor": f"WITH {GPS} SELECT run_id, offset_us, {R('spread_s', 'spread_s')}, samples, spread_s <= 2 AS trusted FROM anchors",
    "clock_rejects": f"""WITH {GPS}, first AS (SELECT user_id AS run_id, min(ts) AS first FROM events GROUP BY user_id), e AS (SELECT f.run_id, CASE WHEN f.run_id % 5 = 0 THEN first::DATE - 30 ELSE first::DATE END AS expected, offset_us, first_boot_us FROM first f LEFT JOIN anchors a ON f.run_id = a.run_id)
      SELECT run_id, CASE WHEN offset_us IS NULL THEN 'no dated sample' WHEN first_boot_us + offset_us < 946684800000000 THEN 'before 2000' WHEN date_diff('day', expected, make_timestamp(first_boot_us + offset_us)::DATE) > 2 THEN 'after its upload' ELSE 'ok' END AS reason FROM e""",
    "hourly_windows": f"WITH {_win('hour')} {WINDOWS}",
    "daily_windows": f"WITH {_win('day')} {WINDOWS}",
    "window_quality_flags": f"""WITH {_win('day')}, {GPS} SELECT win.run_id, {ISO}, concat_ws(',', CASE WHEN NOT complete THEN 'incomplete_window' END, CASE WHEN wind_samples < 5 THEN 'few_wind_samples' END, CASE WHEN position_samples < 5 THEN 'few_position_samples' END, CASE WHEN spread_s > 2 THEN 'clock_anchor_uncertain' END) AS flags FROM win LEFT JOIN anchors USING (run_id)""",
    "nearest_grid_join": f"WITH {FIELD} SELECT run_id, {ISO}, {', '.join(R(c, c) for c in ('grid_lat', 'grid_lon', 'u100', 'v100', 'u10', 'v10', 'distance_km', 'mismatch_s'))} FROM jd",
    "midpoint_interpolation": f"WITH {FIELD} SELECT run_id, {ISO}, {', '.join(R(f'(j.{c} + n.{c}) / 2', c) for c in ('u100', 'v100', 'u10', 'v10'))} FROM j LEFT JOIN grid n ON n.time = j.window_start + INTERVAL 1 HOUR AND n.la = j.la AND n.lo = j.lo",
    "join_flags": f"WITH {FIELD} SELECT run_id, {ISO}, concat_ws(',', CASE WHEN distance_km > 12 THEN 'outside_spatial_tolerance' END, CASE WHEN abs(mismatch_s) > 1200 THEN 'outside_temporal_tolerance' END) AS flags FROM jd",
    "join_summary": f"WITH {FIELD} SELECT count(*) AS seen, count(u100) AS paired, round(min(distance_km), 2) + 0e0 AS least_km, round(max(distance_km), 2) + 0e0 AS greatest_km, (SELECT round(list(distance_km ORDER BY distance_km)[(floor(count(*) / 2) + 1)::BIGINT], 2) + 0e0 FROM jd WHERE distance_km IS NOT NULL) AS median_km FROM jd",
    "context_features_tall": f"""WITH {FIELD}, f AS (SELECT run_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS "window", concat_ws(',', CASE WHEN distance_km > 30 THEN 'outside_spatial_tolerance' END) AS flags, u100, v100, u10, v10 FROM jd WHERE u100 IS NOT NULL)
      {' UNION ALL '.join(f'''SELECT run_id, "window", flags, '{n}' AS feature_name, {R(c, 'value')}, 'm s-1' AS unit FROM f''' for c, n in (('u100', 'wind_u_100m'), ('v100', 'wind_v_100m'), ('u10', 'wind_u_10m'), ('v10', 'wind_v_10m')))}""",
    "haversine_distance": f"""WITH {SAMPLES}, g AS (SELECT *, round_even(lat / 0.25e0, 0) * 0.25e0 AS glat, round_even(lon / 0.25e0, 0) * 0.25e0 AS glon FROM samples WHERE topic = 'position') SELECT event_id, {R('glat', 'grid_lat')}, {R('glon', 'grid_lon')}, {R(KM('lat', 'lon', 'glat', 'glon'), 'distance_km')}, {R('lon - 360 * floor(lon / 360)', 'east_lon')}, {KM('lat', 'lon', 'glat', 'glon')} <= 6371.0088e0 * radians(0.25e0) / sqrt(2e0) AS inside_cell FROM g""",
    "nearest_station": f"""WITH {_win('day')}, s AS (SELECT date_trunc('day', ts) AS day, event_id AS point_id, lat AS plat, lon AS plon FROM samples WHERE topic = 'wind'), n AS (SELECT run_id || '@' || strftime(window_start, '%Y-%m-%d') AS key, point_id, {KM('lat', 'lon', 'plat', 'plon')} AS km FROM win JOIN s ON day = window_start AND abs(lat - plat) <= 2 WHERE complete),
      r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY km, point_id) AS rn FROM n) SELECT key, point_id, {R('km', 'distance_km')} FROM r WHERE rn = 1""",
    "nearest_station_all": f"""WITH {_win('day')}, s AS (SELECT s_suppkey AS point_id, s_suppkey % 97 / 4e0 + 30 AS plat, s_suppkey % 89 / 6e0 - 10 AS plon FROM supplier), n AS (SELECT run_id || '@' || strftime(window_start, '%Y-%m-%d') AS key, point_id, {R(KM('lat', 'lon', 'plat', 'plon'), 'km')} FROM win JOIN s ON abs(lat - plat) <= 2 WHERE complete)
      SELECT key, point_id, km AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY km, point_id) AS rn FROM n) WHERE rn = 1""",
    "release_marker": f"SELECT strftime(l_shipdate, '%Y') AS year, CASE WHEN l_shipdate::DATE <= DATE '2000-12-31' THEN '0001' ELSE '0005' END AS marker, count(*) AS n FROM {PAIR_YEARS} GROUP BY ALL",
    "release_markers_seen": f"""WITH cut AS (SELECT max(o_orderdate)::DATE - 365 AS cutoff FROM orders), m AS (SELECT r_name || '|' || (CASE WHEN o_orderdate::DATE >= cutoff THEN 'within' ELSE 'older' END) AS stratum, CASE WHEN l_shipdate::DATE < DATE '1996-01-01' THEN NULL WHEN l_shipdate::DATE <= DATE '1998-06-30' THEN '0001' WHEN l_shipdate::DATE <= DATE '2000-12-31' THEN '0005' END AS marker FROM {PAIR_YEARS}, cut)
      SELECT stratum, coalesce(array_to_string(list_sort(list(DISTINCT marker) FILTER (WHERE marker IS NOT NULL)), ','), '') AS markers, count_if(marker IS NULL)::BIGINT AS outside FROM m GROUP BY stratum""",
    "context_requests": """WITH s AS (SELECT user_id AS run_id, date_trunc('day', ts) AS day, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL), h AS (SELECT run_id, strftime(day, '%Y-%m-%d') AS day, date_diff('hour', date_trunc('hour', a), date_trunc('hour', b)) + 1 AS hours FROM s)
      SELECT run_id, day, hours, substr(sha256('{"day":"' || day || '","hours":' || hours || ',"run":' || run_id || '}'), 1, 16) AS key FROM h""",
    "hourly_counts": f"WITH {SAMPLES} SELECT run_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count_if(topic = 'wind')::BIGINT AS wind_samples, count_if(topic = 'position')::BIGINT AS position_samples, {R('avg(east)', 'mean_value')} FROM samples GROUP BY run_id, date_trunc('hour', ts)",
}
