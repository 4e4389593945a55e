"""Clocks, windows, flags, grids, frames, sources and sinks."""

import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from accordance.functions import classify, geometry
from accordance.operators import context, frame, telemetry
from accordance.sources import readers, sinks
from accordance.streaming.hourly import hourly

BASE = 1_768_480_496_000_000  # 2026-01-15T12:34:56Z in microseconds


def anchors(spark, rows):
    return telemetry.clock_anchors(spark.createDataFrame(rows, "run_id string, boot_us long, utc_us long"))


def test_anchor_ignores_undated_samples_and_outliers(spark):
    rows = [("a", i * 1_000_000, BASE + i * 1_000_000) for i in range(5)] + [("a", 9_000_000, 0), ("a", 9_000_000, None), ("a", 10_000_000, BASE + 20_000_000)]
    r = anchors(spark, rows).first()
    assert (r.offset_us, r.samples, r.spread_s) == (BASE, 6, 10.0) and not spark.range(1).select(telemetry.trustworthy(F.lit(r.spread_s))).first()[0]
    assert anchors(spark, [("a", 1, 0)]).count() == 0


@pytest.mark.parametrize(("offset", "expected", "want"), [(BASE, "2026-01-15", None), (BASE, "2027-01-01", None), (BASE, "2026-01-01", "after its upload"), (32_000_000, "2026-01-15", "before 2000"), (10**18, "2026-01-15", "unrepresentable"), (None, "2026-01-15", "no dated sample")])
def test_anchor_reasons(spark, offset, expected, want):
    df = spark.createDataFrame([(offset, 0, expected)], "o long, b long, e string")
    assert df.select(telemetry.anchor_reason(F.col("o"), F.col("b"), F.col("e"))).first()[0] == want


def test_window_keeps_components_apart_and_either_topic(spark):
    t = datetime(2026, 1, 15, 12, 10)
    rows = [("r", t, "wind", 4.0, 3.0, 0.04, 0.09, None, None)] * 6 + [("r", t, "position", None, None, None, None, 45.5, 9.25)] * 6 + [("r", datetime(2026, 1, 15, 14), "wind", 1.0, None, None, None, None, None), ("r", datetime(2026, 1, 15, 13), "position", None, None, None, None, 1.0, 2.0)]
    schema = "run_id string, ts timestamp, topic string, east double, north double, var_u double, var_v double, lat double, lon double"
    out = sorted(telemetry.windows(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.window_start)
    assert len(out) == 2 and (out[0].onboard_u, out[0].onboard_v, out[0].var_u, out[0].var_v, out[0].wind_samples) == (4.0, 3.0, pytest.approx(0.04), pytest.approx(0.09), 6)
    assert out[0].complete and not out[1].complete and out[1].onboard_u is None
    flags = telemetry.flagged(spark.createDataFrame(out), spark.createDataFrame([("r", 3.0)], "run_id string, spread_s double")).orderBy("window_start").collect()
    assert flags[0].quality_flags == ["clock_anchor_uncertain"] and flags[1].quality_flags == ["incomplete_window", "few_wind_samples", "few_position_samples", "clock_anchor_uncertain"]


@pytest.mark.parametrize(("at", "want"), [((45.51, 9.19), (45.5, 9.25)), ((45.62, 9.12), (45.5, 9.0)), ((-0.10, -0.10), (0.0, 0.0))])
def test_snap(spark, at, want):
    assert tuple(spark.range(1).select(*[geometry.snap(F.lit(x)) for x in at]).first()) == want


def test_distances(spark):
    km = lambda *p: spark.range(1).select(geometry.haversine_km(*[F.lit(float(x)) for x in p])).first()[0]
    assert km(0, 0, 0.25, 0) == pytest.approx(27.8, abs=0.01) and km(10, 20, 10, 20) == 0
    assert geometry.half_cell_km() == pytest.approx(19.66, abs=0.01)


def test_longitudes(spark):
    assert spark.range(1).select(geometry.east_longitude(F.lit(-122.25))).first()[0] == 237.75
    assert spark.range(1).select(geometry.signed_longitude(F.lit(237.75))).first()[0] == -122.25


def test_join_flags_keep_rows_and_mismatch_is_signed(spark):
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([("r", t, 45.5, 9.25, ["few_wind_samples"])], "run_id string, window_start timestamp, lat double, lon double, quality_flags array<string>")
    near = context.with_join_flags(df.withColumns({"time": F.col("window_start"), "grid_lat": F.col("lat"), "grid_lon": F.col("lon")})).first()
    far = context.with_join_flags(df.withColumns({"time": F.col("window_start"), "grid_lat": F.col("lat") + 0.5, "grid_lon": F.col("lon")})).first()
    assert near.mismatch_s == -1800 and near.quality_flags == ["few_wind_samples"] and far.quality_flags == ["few_wind_samples", "outside_spatial_tolerance"]
    none = context.with_join_flags(df.withColumns({"time": F.lit(None).cast("timestamp"), "grid_lat": F.lit(None).cast("double"), "grid_lon": F.lit(None).cast("double")})).first()
    assert none.distance_km is None and none.quality_flags == ["few_wind_samples"]


@pytest.mark.parametrize(("day", "want"), [("2026-04-30 23:00:00", "0001"), ("2026-05-01 00:00:00", "0005"), ("2026-08-20 23:00:00", "0005"), ("2026-08-21 00:00:00", None), ("1939-12-31 23:00:00", None)])
def test_release_boundaries(spark, day, want):
    c = F.lit(day).cast("timestamp")
    got = spark.range(1).select(classify.release_marker(c, "1940-01-01", "2026-04-30", "2026-08-20")).first()[0]
    assert got == want
    if want is None:
        with pytest.raises(Exception, match="outside the field"):
            spark.range(1).select(classify.required_marker(c, "1940-01-01", "2026-04-30", "2026-08-20")).collect()


FRAME = [("a", False, 600.0, 5, "flightreport", "2026-06-01", "Quadrotor", "v1"), ("b", False, 300.0, -1, "personal", "2026-06-02", "Fixed Wing", "v2"), ("c", False, 299.0, 0, "flightreport", "2026-06-03", "VTOL Standard", "v3"), ("d", True, 9000.0, -1, "personal", "2026-06-04", "Quadrotor", "v4"), ("e", False, 1e9, -1, None, "2025-06-05", "Hexarotor", None), ("f", False, 100.0, -1, "personal", "2026-06-06", "Ground Rover", "v5")]


def six(spark):
    return spark.createDataFrame(FRAME, "log_id string, simulated boolean, duration_s double, wind int, type string, log_date string, mav_type string, vehicle string")


def test_frame_counts(spark):
    r = frame.audit(six(spark)).first()
    assert (r.records, r.simulated, r.real, r.implausible, r.frame) == (6, 1, 5, 1, 2)
    assert {t.tier_s: t.n for t in frame.duration_tiers(six(spark)).collect()} == {120: 3, 180: 3, 300: 2, 600: 1}
    e = frame.retention(frame.eligible(six(spark))).first()
    assert (e.newest, e.cutoff) == ("2026-06-02", "2025-06-02")
    assert frame.retention(six(spark).limit(0)).count() == 0
    kinds = {x.k: x.f for x in six(spark).filter("not simulated").select(F.col("log_id").alias("k"), classify.airframe_family(F.col("mav_type")).alias("f")).collect()}
    assert kinds == {"a": "rotorcraft", "b": "fixed_wing_or_vtol", "c": "fixed_wing_or_vtol", "e": "rotorcraft", "f": "other"}
    assert spark.range(1).select(classify.airframe_family(F.lit("Tiltrotor VTOL"))).first()[0] == "fixed_wing_or_vtol"


def test_objections_cover_logs_and_vehicles(spark):
    out = spark.createDataFrame([("log_id", "a"), ("vehicle_uuid", "v2")], "kind string, value string")
    assert sorted(r.log_id for r in frame.without_objections(six(spark), out).collect()) == ["c", "d", "e", "f"]


@pytest.mark.parametrize(("reference", "want"), [("abc-1", "abc-1"), (" https://x.org/download/abc-1.ulg ", "abc-1"), ("https://x.org/plot?log_id=abc-1&x=2", "abc-1")])
def test_exclusion_references(spark, reference, want):
    assert spark.range(1).select(classify.exclusion_id(F.lit(reference))).first()[0] == want


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "dump.json.gz", "wt") as f:
        json.dump([{"log_id": "a", "duration_s": 3.5}, {"log_id": "b", "duration_s": None}], f)
    assert [r.duration_s for r in readers.json_array(spark, str(tmp_path / "dump.json.gz"), "log_id string, duration_s double").orderBy("log_id").collect()] == [3.5, None]
    (tmp_path / "ex.jsonl").write_text('{"kind":"log_id","value":"x","received":"2026-01-01"}\n\n')
    assert readers.exclusions(spark, str(tmp_path / "ex.jsonl")).count() == 1
    (tmp_path / "empty.jsonl").write_text("")
    assert readers.exclusions(spark, str(tmp_path / "empty.jsonl")).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"kind":"person","value":"x"}\n')
    with pytest.raises(Exception, match="invalid exclusion"):
        readers.exclusions(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.exclusions(spark, str(tmp_path / "none.jsonl")).collect()


def test_topics_tolerate_missing_columns_and_corrupt_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for run, table in (("r1", {"timestamp": [1, 2], "windspeed_north": [1.0, 2.0]}), ("r2", {"timestamp": [3], "windspeed_north": [1.0], "windspeed_east": [2.0]})):
        (tmp_path / run).mkdir()
        pq.write_table(pa.table(table), tmp_path / run / "wind.parquet")
    (tmp_path / "r3").mkdir()
    (tmp_path / "r3" / "wind.parquet").write_bytes(b"not parquet")
    out = {(r.run_id, r.n, r.e) for r in readers.topic(spark, str(tmp_path), "wind").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count("windspeed_east").alias("e")).collect()}
    assert out == {("r1", 2, 0), ("r2", 1, 1)}


def test_log_files_need_magic_and_length(spark, tmp_path):
    magic = bytes.fromhex(readers.LOG_MAGIC)
    for name, data in (("good", magic + bytes(5000)), ("short", magic), ("other", bytes(5000))):
        (tmp_path / f"{name}.ulg").write_bytes(data)
    assert {r.log_id: r.available for r in readers.log_files(spark, str(tmp_path)).collect()} == {"good": True, "short": False, "other": False}


def test_requests_span_hours_within_a_month(spark):
    hours = lambda a, b: spark.range(1).select(F.size(readers.hours_spanned(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")))).first()[0]
    assert hours("2026-01-01 10:59:00", "2026-01-01 12:01:00") == 3
    assert spark.range(1).select(readers.hours_spanned(F.lit("2026-01-31").cast("timestamp"), F.lit("2026-02-01").cast("timestamp"))).first()[0] is None


def test_records_of_written_tables(spark, tmp_path):
    first = sinks.recorded(spark.range(30).repartition(3), str(tmp_path / "a"), "a", seed=7, revision="abc", clean=True)
    r = first.first()
    assert (r.name, r.rows, r.columns, r.seed) == ("a", 30, "id bigint", 7) and r.part_files == 3
    again = sinks.recorded(spark.range(30).orderBy(F.desc("id")), str(tmp_path / "b"), "b").first()
    assert again.digest == r.digest and sinks.recorded(spark.range(31), str(tmp_path / "c"), "c").first().digest != r.digest
    kept = spark.createDataFrame([r], first.schema)
    assert [x.intact for x in sinks.intact(spark, kept).collect()] == [True] and sinks.publishable(kept).count() == 1
    spark.range(29).write.mode("overwrite").parquet(str(tmp_path / "a"))
    assert [x.intact for x in sinks.intact(spark, kept).collect()] == [False]
    with pytest.raises(Exception, match="not publishable"):
        sinks.publishable(kept.withColumn("clean", F.lit(False))).collect()


def test_samples_stay_within_their_frame(spark):
    known = spark.createDataFrame([("abc1",), ("abc2",)], "log_id string")
    assert frame.require_within(spark.createDataFrame([("ab-c1",)], "log_id string"), known).count() == 1
    with pytest.raises(ValueError, match="zz"):
        frame.require_within(spark.createDataFrame([("ab-c1",), ("zz",)], "log_id string"), known)
    inside, outside = frame.restricted(spark.createDataFrame([("abc1",), ("x",)], "log_id string"), known)
    assert (inside.count(), outside.first().outside) == (1, 1)
    whole, none = frame.restricted(known, None)
    assert (whole.count(), none.first().outside) == (2, 0)
    runs = spark.createDataFrame([(3, True), (1, False), (2, True), (4, True)], "log_id long, usable boolean")
    assert [r.log_id for r in frame.first_usable(runs, 2).collect()] == [2, 3]


def test_optional_joins_lose_no_pair(spark):
    pairs = spark.createDataFrame([(1, 5.0), (2, 6.0)], "run_id long, u double")
    heights, flags = spark.createDataFrame([(1, 30.0)], "run_id long, height_m double"), spark.createDataFrame([(2, True)], "run_id long, has_airspeed boolean")
    out = [tuple(r) for r in context.with_optional(pairs, heights, flags).orderBy("run_id").select("height_m", "has_airspeed", "stratum").collect()]
    assert out == [(30.0, False, "unknown"), (None, True, "unknown")]


def test_heights_need_validity(spark):
    df = spark.createDataFrame([(-3.0, True), (-3.0, False), (-3.0, None), (float("nan"), True), (float("inf"), True), (None, True)], "z double, ok boolean")
    assert [r.h for r in df.select(classify.height_above(F.col("z"), F.col("ok")).alias("h")).collect()] == [3.0, None, None, None, None, None]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", datetime(2026, 1, 1, h, 10), t, float(h)) for h in range(3) for t in ("wind", "position", "wind")]
    batch = spark.createDataFrame(rows, "run_id string, ts timestamp, topic string, value double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = hourly(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hourly_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("hourly_out").collect()) == sorted(hourly(batch).collect())


def test_nearest_of_all_fixed_points_equals_brute_force(spark):
    import math
    import random

    rng = random.Random(5)
    spots = [("w%d" % i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [("east", 10.0, 179.9), ("west", 10.0, -179.9), ("pole", 89.9, 0.0), ("tie", 0.0, 1.0), ("none", None, 1.0)]
    points = [(i, rng.uniform(-90, 90), rng.choice([1.0, 180.0]) * rng.uniform(-1, 1)) for i in range(1, 400)] + [(500, 10.0, -179.8), (501, 89.5, 170.0), (502, 0.0, 2.0), (503, 0.0, 0.0)]

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return round(2 * geometry.EARTH_RADIUS_KM * math.asin(math.sqrt(min(1, h))), 6)

    want = {k: min(near) for k, a, b in spots if a is not None and (near := [(km(a, b, c, d), i) for i, c, d in points if abs(a - c) <= 2])}
    out = context.fixed_nearest(spark.createDataFrame(spots, "key string, lat double, lon double"), spark.createDataFrame(points, "point_id long, plat double, plon double"), "key", 2.0)
    got = {r.key: (r.distance_km, r.point_id) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=2e-6) for k in want)


def test_the_search_for_nearest_points_does_not_pair_dense_windows_and_points(spark):
    import math
    import random

    rng = random.Random(7)
    windows = [("w%d" % i, 1 + i % 2, rng.uniform(30, 34), rng.uniform(-3, 1)) for i in range(1000)]
    points = [(i, 1 + i % 2, rng.uniform(30, 34), rng.uniform(-3, 1)) for i in range(2000)]
    asked = spark.createDataFrame(windows, "key string, day int, lat double, lon double").withColumn("window_start", F.make_date(F.lit(2024), F.lit(1), "day").cast("timestamp"))
    seen = spark.createDataFrame(points, "point_id long, day int, plat double, plon double").withColumn("time", F.make_date(F.lit(2024), F.lit(1), "day").cast("timestamp")).drop("day")
    copies = seen.union(seen.withColumn("point_id", F.col("point_id") + 5000))  # of the same places
    got = {r.key: r.point_id for r in context.irregular_nearest(asked, copies, "key", 2.0).collect()}

    def off(a, b, c, d):
        return math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2

    assert got == {k: min((off(a, b, c, d), i) for i, e, c, d in points if e == day and abs(a - c) <= 2)[1] for k, day, a, b in windows}
    placed = context._on_sphere(asked.withColumnsRenamed({"window_start": "time"}), "lat", "lon"), context._on_sphere(seen, "plat", "plon")
    sizes = [r.n for r in context.candidates(*placed, ["time"], 2.0, 0.0).select(F.size("near").alias("n")).collect()]
    assert len(sizes) == 1000 and max(sizes) < 200  # of the 1,000 points of a day


def test_the_order_of_samples_does_not_decide_the_grid_point(spark):
    lons = [0.1, 0.2, 0.3, -0.1]  # their mean is 0.125, halfway between two grid points
    rows = [(run, datetime(2024, 1, 1, 1, 0, i), "position", 0.0, 0.0, None, None, 30.0, lon) for run, order in ((1, lons), (2, lons[::-1]), (3, [0.3, 0.1, -0.1, 0.2])) for i, lon in enumerate(order)]
    df = spark.createDataFrame(rows, "run_id long, ts timestamp, topic string, east double, north double, var_u double, var_v double, lat double, lon double").coalesce(1)
    assert {r.lon for r in telemetry.windows(df).collect()} == {0.125}
