"""Grid chunks, footers, disclosure, nearest points on the sphere, versions and late rows."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordance.operators import context, disclosure
from accordance.sources import chunks, footers
from accordance.sources.versions import Versions
from accordance.streaming import late

# --- chunks -----------------------------------------------------------------------------------


@pytest.mark.parametrize("level", [None, 1])
def test_points_come_from_their_chunks_alone(spark, tmp_path, level):
    rng = random.Random(1)
    cells = {(rng.randrange(50), rng.randrange(20), rng.randrange(20)): (rng.random(), rng.choice([None, rng.random()])) for _ in range(300)}
    field = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "t long, la long, lo long, a double, b double")
    root, head = str(tmp_path / "field"), chunks.header((50, 20, 20), (8, 5, 6), level=level)
    written = {(r.variable, r.chunk): r.cells for r in chunks.write_chunks(field, root, ["a", "b"], head).collect()}
    assert sum(n for (v, _), n in written.items() if v == "a") == len(cells)
    assert {f for f in os.listdir(f"{root}/a") if not f.startswith(".")} == {c for v, c in written if v == "a"}
    asked = [*list(cells)[:40], *[(rng.randrange(50), rng.randrange(20), rng.randrange(20)) for _ in range(40)], (50, 0, 0), (-1, 0, 0), (None, 1, 1)]
    points = spark.createDataFrame(asked * 2, "t long, la long, lo long")
    got = {(r.t, r.la, r.lo): (r.a, r.b, r.opened) for r in chunks.read_points(points, root, ["a", "b"]).collect()}
    assert got.keys() == {p for p in asked if p[0] is not None and 0 <= p[0] < 50}
    for p, (a, b, opened) in got.items():
        assert (a, b) == cells.get(p, (None, None)) and opened == any((v, f"{p[0] // 8}.{p[1] // 5}.{p[2] // 6}") in written for v in "ab")
    for name in os.listdir(f"{root}/a"):  # a chunk that nobody asks for isn't opened, even if it is broken
        if not name.startswith(".") and name != "0.0.0":
            (tmp_path / "field" / "a" / name).write_bytes(b"broken")
    near = spark.createDataFrame([(0, 0, 0)], "t long, la long, lo long")
    assert chunks.read_points(near, root, ["a"]).count() == 1


def test_single_precision_and_an_unknown_compressor(spark, tmp_path):
    root = str(tmp_path / "f")
    field = spark.createDataFrame([(0, 0, 0, 0.1)], "t long, la long, lo long, a double")
    chunks.write_chunks(field, root, ["a"], chunks.header((4, 4, 4), (2, 2, 2), "<f4")).collect()
    assert chunks.read_points(field, root, ["a"]).first().a == float(np.float32(0.1))
    head = (tmp_path / "f" / "a" / ".zarray").read_text().replace('"zlib"', '"blosc"')
    (tmp_path / "f" / "a" / ".zarray").write_text(head)
    with pytest.raises(Exception, match="isn't supported"):
        chunks.read_points(field, root, ["a"]).collect()


# --- footers ----------------------------------------------------------------------------------


def test_footers_tell_of_null_columns_and_unreadable_files(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("timestamp"), F.lit(None).cast("double").alias("lat"))
    df.repartition(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "one" / "part-bad.parquet").write_bytes(b"PAR1 no")
    rows = footers.parquet_footers(spark, str(tmp_path)).collect()
    good, bad = [r for r in rows if r.readable], [r for r in rows if not r.readable]
    assert {(r.column, r["rows"], r.nulls, r.row_groups) for r in good} == {("timestamp", 10, 0, 1), ("lat", 10, 10, 1)}
    assert len(bad) == 1 and bad[0].reason and bad[0].column is None
    named = footers.parquet_footers(spark, str(tmp_path)).withColumn("run_id", F.lit("r")).withColumn("topic", F.when(F.col("readable"), "place").otherwise("wind"))
    out = {r.topic: r for r in footers.topic_presence(named, {"place": ["timestamp", "lat"]}).collect()}
    assert out["place"].complete and out["place"].columns == "lat,timestamp" and not out["wind"].complete and out["wind"]["rows"] is None


# --- disclosure -------------------------------------------------------------------------------


def pairs(spark, cells):
    """Rows of (a, b) cells with so many runs each."""
    rows, run = [], 0
    for (a, b), n in cells.items():
        for _ in range(n):
            run += 1
            rows.append((run, run, a, b))
    return spark.createDataFrame(rows, "run_id long, vehicle long, a string, b string")


def states(df):
    return {(r.axis, r.cell): r.state for r in df.collect()}


AXES = {"a": F.col, "b": F.col}


def guard(spark, cells, **more):
    return states(disclosure.guarded(pairs(spark, cells), {k: f(k) for k, f in AXES.items()}, 20, 10, **more))


def test_a_single_hidden_cell_takes_another_with_it(spark):
    out = guard(spark, {("x", "p"): 5, ("y", "p"): 40, ("z", "p"): 50})
    assert out == {("a", "x"): "primary", ("a", "y"): "complement", ("a", "z"): "published", ("b", "p"): "published"}


def test_several_hidden_cells_that_are_enough_together_need_no_other(spark):
    out = guard(spark, {("x", "p"): 15, ("w", "p"): 15, ("y", "p"): 40})
    assert out["a", "y"] == "published" and out["a", "x"] == out["a", "w"] == "primary"


def test_overlapping_axes_do_not_give_a_cell_away(spark):
    # y of the axis a and q of the axis b are the same rows: hiding y alone would be of no use
    cells = {("x", "p"): 5, ("y", "q"): 30, ("z", "p"): 60, ("z", "r"): 40}
    out = guard(spark, cells)
    shown = [np.ones(len(cells)), *[np.array([c[k[0] == "b"] == k[1] for c in cells], float) for k, s in out.items() if s == "published"]]
    hidden = np.array([np.array([c[k[0] == "b"] == k[1] for c in cells], float) for k, s in out.items() if s == "primary"])
    assert out["a", "x"] == "primary" and not disclosure.derivable(np.array(shown), hidden).any()
    naive = np.array([np.ones(4), [0, 1, 0, 0], [0, 0, 1, 1]])  # the total, q, and z
    assert disclosure.derivable(naive, np.array([[1.0, 0, 0, 0]]))[0]


def test_nothing_thin_nothing_hidden_and_too_many_cells(spark):
    assert set(guard(spark, {("x", "p"): 30, ("y", "q"): 30}).values()) == {"published"}
    with pytest.raises(ValueError, match="atoms"):
        guard(spark, {("x", "p"): 3, ("y", "q"): 3}, atoms=1)


def test_releases_that_differ_by_few_runs(spark):
    old, new = pairs(spark, {("x", "p"): 30, ("y", "p"): 30}), pairs(spark, {("x", "p"): 30, ("y", "p"): 35})
    out = {(r.axis, r.cell): (r.added, r.removed, r.open) for r in disclosure.release_gaps(old, new, {k: f(k) for k, f in AXES.items()}, 20).collect()}
    assert out == {("a", "x"): (0, 0, False), ("a", "y"): (5, 0, True), ("b", "p"): (5, 0, True)}


# --- the sphere -------------------------------------------------------------------------------


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


@pytest.mark.parametrize("n", [1, 5, 200])
def test_every_window_has_its_nearest_point(spark, n):
    rng = random.Random(n)
    place = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    points = [(i, *place()) for i in range(n)] + ([(900, 89.9, 10.0), (901, -90.0, 0.0), (902, 0.0, 179.95), (903, 10.0, 20.0), (899, 10.0, 20.0)] if n > 1 else [])
    windows = [(f"w{i}", *place()) for i in range(60)] + [("north", 90.0, -170.0), ("south", -89.99, 77.0), ("line", 0.0, -179.99), ("tie", 10.01, 20.0), ("turn", 0.0, 540.0)]
    df, at = spark.createDataFrame([*windows, ("none", None, 1.0)], "key string, lat double, lon double"), spark.createDataFrame([*points, (1000, None, None)], "point_id long, plat double, plon double")
    got = {r.key: (r.point_id, r.distance_km) for r in context.sphere_nearest(df, at, "key").collect()}
    assert len(got) == len(windows) + 1 and got["none"] == (None, None)
    for key, lat, lon in windows:
        best = min((round(km(lat, lon, a, b), 6), i) for i, a, b in points)
        assert got[key][1] == pytest.approx(best[0], abs=2e-6) and (got[key][0] == best[1] or n == 1), key
    assert n == 1 or got["tie"][0] == 899


def test_no_points_give_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "key string, lat double, lon double")
    out = context.sphere_nearest(df, spark.createDataFrame([], "point_id long, plat double, plon double"), "key", first=0.5).collect()
    assert [(r.key, r.point_id, r.distance_km) for r in out] == [("a", None, None)]


# --- versions ---------------------------------------------------------------------------------


def rows(df):
    return sorted((r.k, r.v, r.at) for r in df.collect())


def test_versions_upserts_and_reads_as_of(spark, tmp_path):
    made = Versions(spark, str(tmp_path / "t"), "k", 4)
    kind = "k long, v string, at long"
    one = spark.createDataFrame([(i, "a", 1) for i in range(20)], kind)
    assert made.current() is None and made.replace(one) == 1
    pinned = made.read()
    assert made.upsert(spark.createDataFrame([(3, "b", 2), (4, "old", 0), (50, "new", 1), (50, "newer", 2)], kind), "at", "s", 7) == 2
    now = dict((k, v) for k, v, _ in rows(made.read()))
    assert now[3] == "b" and now[4] == "a" and now[50] == "newer" and len(now) == 21
    assert rows(pinned) == rows(made.read(1)) == rows(one)
    assert sorted((r.key, r.change) for r in made.changes(1, 2).collect()) == [(3, "changed"), (50, "added")]
    assert sorted((r.key, r.change) for r in made.changes(2, 1).collect()) == [(3, "changed"), (50, "removed")]
    assert made.upsert(spark.createDataFrame([(3, "again", 9)], kind), "at", "s", 7) == 2 and dict((k, v) for k, v, _ in rows(made.read()))[3] == "b"  # played again
    same = made.manifest(1)["folders"], made.manifest(2)["folders"]
    assert any(same[0][b] == same[1][b] for b in same[0])  # buckets that the batch didn't touch are shared


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    made = Versions(spark, str(tmp_path / "t"), "k", 2)
    good = spark.createDataFrame([(1, "a", 1)], "k long, v string, at long")
    made.replace(good)
    broken = good.withColumn("v", F.raise_error(F.lit("halfway")).cast("string"))
    for work in (lambda: made.replace(broken), lambda: made.upsert(broken, "at")):
        with pytest.raises(Exception, match="halfway"):
            work()
    assert made.current() == 1 and rows(made.read()) == rows(good)
    with pytest.raises(ValueError, match="no version 9"):
        made.read(9)


def test_old_versions_go_and_what_is_shared_stays(spark, tmp_path):
    made = Versions(spark, str(tmp_path / "t"), "k", 3)
    kind = "k long, v string, at long"
    made.replace(spark.createDataFrame([(i, "a", 1) for i in range(9)], kind))
    for n in (2, 3):
        made.upsert(spark.createDataFrame([(1, f"v{n}", n)], kind), "at")
    assert made.expire(1) == [1, 2] and len(rows(made.read())) == 9
    with pytest.raises(ValueError, match="no version 1"):
        made.read(1)
    made.replace(spark.createDataFrame([], kind))
    assert rows(made.read()) == []


def test_a_stream_of_batches_is_upserted_once(spark, tmp_path):
    made, inbox = Versions(spark, str(tmp_path / "t"), "k", 2), str(tmp_path / "in")
    kind = "k long, v string, at long"
    for n in (1, 2):
        spark.createDataFrame([(1, f"v{n}", n), (n + 10, "x", 1)], kind).repartition(1).write.mode("append").parquet(inbox)
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(inbox)
    assert made.upsert_stream(stream(), "at", "in", str(tmp_path / "c")) == 2
    assert made.upsert_stream(stream(), "at", "in", str(tmp_path / "c")) == 2  # nothing new
    assert made.upsert_stream(stream(), "at", "in", str(tmp_path / "d")) == 2  # from the start, without the stream's own memory
    assert rows(made.read()) == [(1, "v2", 2), (11, "x", 1), (12, "x", 1)]


# --- late rows --------------------------------------------------------------------------------


def test_late_rows_are_given_out(spark, tmp_path):
    inbox = str(tmp_path / "in")
    for batch in ([("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 05:00:00", 2)], [("a", "2024-01-01 01:00:00", 3), ("b", "2024-01-01 02:59:59", 4), ("b", "2024-01-01 03:00:00", 5)]):
        spark.createDataFrame(batch, "run_id string, t string, i long").selectExpr("run_id", "timestamp(t) AS ts", "i").repartition(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("run_id string, ts timestamp, i long").option("maxFilesPerTrigger", 1).parquet(inbox)
    on_time, behind = late.split_stream(stream, "run_id", str(tmp_path / "out"))
    assert sorted((r.i, r.batch) for r in on_time.collect()) == [(1, 0), (2, 0), (5, 1)]
    assert sorted((r.i, r.batch) for r in behind.collect()) == [(3, 1), (4, 1)]  # their hours ended by 03:00, the watermark
    assert {r.i: r.seen for r in on_time.union(behind).collect()}[3] == 3


def test_late_rows_are_marked_by_a_few_calls_for_many_groups(spark, tmp_path):
    inbox = str(tmp_path / "in")
    for k in range(2):
        spark.range(300).selectExpr("CASE WHEN id > 1 THEN id DIV 2 + 9007199254740993 END AS run_id", "timestamp '2024-01-01 05:00:00' AS ts", f"id * 2 + {k} AS i").repartition(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("run_id long, ts timestamp, i long").option("maxFilesPerTrigger", 1).parquet(inbox)
    on_time, behind = late.split_stream(stream, "run_id", str(tmp_path / "out"))
    assert behind.count() == 0
    found = sorted((r.run_id or 0, r.batch, r.seen) for r in on_time.collect())
    assert found == sorted((i // 2 + 9007199254740993 if i > 1 else 0, k, 2 * (k + 1)) for i in range(300) for k in range(2))
    query = late.marked(stream, "run_id", buckets=4).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "few")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 5  # four buckets, and one of the rows without a run
