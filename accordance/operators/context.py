"""Windows joined to a gridded hourly field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.functions.classify import SPATIAL_TOLERANCE_KM, TEMPORAL_TOLERANCE_S, join_flags, rounded
from accordance.functions.geometry import GRID_DEG, grid_index, haversine_km
from accordance.operators.tables import written

VALUES = ("u100", "v100", "u10", "v10")
HALF_WINDOW_S = 1800
#: The search for nearest points: halvings of space at most and at a time, stations in a cube, and what straight distances may err (6 mm on the ground).
FINEST, STEP, HELD, SLACK = 16, 2, 16, 1e-9


def mismatch_s(context_time: Column, window_start: Column) -> Column:
    """Signed seconds from a window's centre to the field's time: -1800 for the hour's start, 0 for its middle."""
    return (F.unix_micros(context_time.cast("timestamp")) - F.unix_micros(window_start.cast("timestamp"))) / 1e6 - HALF_WINDOW_S


def nearest_join(windows: DataFrame, grid: DataFrame, offset_hours: int = 0, suffix: str = "") -> DataFrame:
    """Each window with the field at its hour and nearest grid point: an equi-join on snapped indices.

    grid(time, lat_index, lon_index, u100, ...). Unmatched windows keep nulls. Only one
    shuffle a side, or a broadcast if Spark finds the field small.
    """
    field = grid.select(F.col("time").alias(f"time{suffix}"), F.col("lat_index").alias("_lat"), F.col("lon_index").alias("_lon"), *[F.col(v).alias(v + suffix) for v in VALUES])
    asked = windows.window_start + F.expr(f"interval {offset_hours} hours")
    on = (asked == field[f"time{suffix}"]) & (grid_index(windows.lat) == field["_lat"]) & (grid_index(windows.lon) == field["_lon"])
    out = windows.join(field, on, "left")
    return out.withColumn(f"grid_lat{suffix}", F.col("_lat") * GRID_DEG).withColumn(f"grid_lon{suffix}", F.col("_lon") * GRID_DEG).drop("_lat", "_lon")


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Places as unit vectors in space, so that poles and the date line are places like any other, and their cubes at the finest level; rows without a place go."""
    flat = F.cos(F.radians(lat))
    df = df.filter(f"{lat} is not null and {lon} is not null and not isnan({lat}) and not isnan({lon})")
    out = df.withColumns({"_x": flat * F.cos(F.radians(lon)), "_y": flat * F.sin(F.radians(lon)), "_z": F.sin(F.radians(lat)), "_lat": F.col(lat)})
    return out.withColumns({f"_i{c}": F.floor((F.col(f"_{c}") + 1) * (1 << (FINEST - 1))).cast("long") for c in "xyz"})


def _cubes(side: str, level: int) -> dict[str, Column]:
    """A place's cube: space from -1 to 1 is halved ``level`` times along each axis."""
    return {f"{side}{c}": F.shiftright(f"_i{c}", FINEST - level) for c in "xyz"}


def candidates(asked: DataFrame, stations: DataFrame, by: list[str], reach_deg: float | None, least_edge: float) -> DataFrame | None:
    """``asked`` with ``near``, an array of the stations that may be the nearest of a place in its cube; None if there are no stations.

    Cubes of asked places meet cubes of stations from coarse to fine. Between the boxes of what lies in two
    cubes there is a least and a greatest distance; a pair goes on only if its least is no more than the smallest greatest one
    of its asked cube. So a cube keeps the few others around its nearest stations, however far these are, until no
    cube holds more than ``HELD`` stations. The work grows with cubes and windows, not with windows times stations.
    """
    axes, sides, pairs = ("_x", "_y", "_z", "_lat"), ("a", "p"), None
    names = {side: [f"{side}{c}" for c in "xyz"] for side in sides}
    for level in range(STEP, FINEST + 1, STEP):
        boxes = {}
        for side, df in zip(sides, (asked, stations), strict=True):
            ends = [f(c).alias(f"{side}{name}{c}") for c in axes for name, f in (("least", F.min), ("most", F.max))]
            boxes[side] = df.groupBy(*by, *[v.alias(k) for k, v in _cubes(side, level).items()]).agg(*ends, F.count(F.lit(1)).alias(f"{side}n"))
        fullest = boxes["p"].agg(F.max("pn")).first()[0]
        if fullest is None:
            return None
        if pairs is None:
            both = boxes["a"].join(boxes["p"], by) if by else boxes["a"].crossJoin(boxes["p"])  # the coarsest cubes: of a fixed number
        else:
            both = pairs.withColumnsRenamed({c: f"_u{c}" for c in (*names["a"], *names["p"])})
            for side in sides:
                up = {f"_u{c}": F.shiftright(c, STEP) for c in names[side]}
                both = both.join(boxes[side].withColumns(up), [*by, *up])
        least = {c: F.greatest(F.lit(0.0), F.col(f"aleast{c}") - F.col(f"pmost{c}"), F.col(f"pleast{c}") - F.col(f"amost{c}")) for c in axes}
        most = {c: F.greatest(F.col(f"amost{c}") - F.col(f"pleast{c}"), F.col(f"pmost{c}") - F.col(f"aleast{c}")) for c in axes}
        straight = lambda d: F.sqrt(d["_x"] * d["_x"] + d["_y"] * d["_y"] + d["_z"] * d["_z"])
        sure = straight(most)
        if reach_deg is not None:  # what lies partly out of reach may be found by none
            both, sure = both.filter(least["_lat"] <= reach_deg), F.when(most["_lat"] <= reach_deg, sure).otherwise(F.lit(float("inf")))
        met = both.select(*by, *names["a"], sure.alias("sure"), F.struct(straight(least).alias("least"), *names["p"]).alias("other"))
        met = met.groupBy(*by, *names["a"]).agg(F.min("sure").alias("sure"), F.collect_list("other").alias("others"))
        kept = met.select(*by, *names["a"], F.explode(F.filter("others", lambda o: o["least"] <= F.col("sure") + SLACK)).alias("o"))
        pairs = written(kept.select(*by, *names["a"], *[F.col("o")[c].alias(c) for c in names["p"]]), "cubes")
        if fullest <= HELD or 2.0 ** (1 - level) <= least_edge:
            break
    held = stations.groupBy(*by, *[v.alias(k) for k, v in _cubes("p", level).items()]).agg(F.collect_list(F.struct("point_id", "plat", "plon", "_x", "_y", "_z")).alias("held"))
    near = pairs.join(held, [*by, *names["p"]]).groupBy(*by, *names["a"]).agg(F.flatten(F.collect_list("held")).alias("near"))
    return asked.withColumns(_cubes("a", level)).join(near, [*by, *names["a"]]).drop(*names["a"])


def _nearest(windows: DataFrame, points: DataFrame, key: str, by: list[str], digits: int | None, reach_deg: float | None = None, least_edge: float = 0.0) -> DataFrame | None:
    """(key, point_id, distance_km) of the windows that have a nearest of points(by, point_id, plat, plon); None if there are no points.

    Of the points of one place the smallest has it. Distances are compared as they are, or to ``digits``; the smaller point_id wins a tie.
    """
    places = points.groupBy(*by, "plat", "plon").agg(F.min("point_id").alias("point_id"))
    stations = written(_on_sphere(places, "plat", "plon"), "stations")
    asked = written(_on_sphere(windows.select(F.col(key).alias("_key"), *by, "lat", "lon"), "lat", "lon"), "windows")
    found = candidates(asked, stations, by, reach_deg, least_edge)
    if found is None:
        return None
    if reach_deg is not None:
        found = found.withColumn("near", F.filter("near", lambda p: F.abs(F.col("lat") - p["plat"]) <= reach_deg)).filter("size(near) > 0")
    off = lambda p, c: (p[c] - F.col(c)) * (p[c] - F.col(c))
    found = found.withColumn("_off", F.transform("near", lambda p: F.sqrt(off(p, "_x") + off(p, "_y") + off(p, "_z"))))
    found = found.withColumn("_least", F.array_min("_off") + SLACK)
    close = F.filter("near", lambda _, i: F.get("_off", i) <= F.col("_least"))
    km = lambda p: haversine_km(F.col("lat"), F.col("lon"), p["plat"], p["plon"])
    best = F.array_min(F.transform(close, lambda p: F.struct((km(p) if digits is None else rounded(km(p), digits)).alias("km"), p["point_id"].alias("point_id"))))
    return found.select("_key", best.alias("best")).select(F.col("_key").alias(key), F.col("best.point_id").alias("point_id"), F.col("best.km").alias("distance_km"))


def _none(windows: DataFrame, points: DataFrame, key: str) -> DataFrame:
    return windows.select(key, F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.lit(None).cast("double").alias("distance_km"))


def irregular_nearest(windows: DataFrame, points: DataFrame, key: str, reach_deg: float) -> DataFrame:
    """The nearest of irregular points(time, point_id, plat, plon) of a window's time, at most ``reach_deg`` of latitude away, at any longitude.

    Windows without a point in reach are left out; distances are compared as they are, and the smaller point_id wins a tie.
    """
    out = _nearest(windows.withColumn("time", F.col("window_start")), points, key, ["time"], None, reach_deg)
    return _none(windows, points, key).limit(0) if out is None else out


def fixed_nearest(windows: DataFrame, points: DataFrame, key: str, reach_deg: float) -> DataFrame:
    """The nearest of all fixed points(point_id, plat, plon), at most ``reach_deg`` of latitude away, at any longitude.

    Windows without a point in reach are left out. Distances are compared to the millimetre; the smaller point_id wins a tie.
    """
    out = _nearest(windows, points, key, [], 6, reach_deg)
    return _none(windows, points, key).limit(0) if out is None else out


def midpoint(windows: DataFrame, grid: DataFrame) -> DataFrame:
    """The field at the window's middle: the mean of its hour and the next. ``later_time`` is that of the next hour, whose release the mean takes."""
    both = nearest_join(nearest_join(windows, grid), grid, 1, "_next")
    for v in VALUES:
        both = both.withColumn(v, (F.col(v) + F.col(f"{v}_next")) / 2)
    return both.withColumnRenamed("time_next", "later_time").drop("grid_lat_next", "grid_lon_next", *[f"{v}_next" for v in VALUES])


def source_metadata(marker: Column, coverage: tuple[str, str, str], retrieved: Column, dataset: str = "reanalysis") -> Column:
    """What a context value was read from: constants, the release and when it was read."""
    start, stop, preliminary = coverage
    return F.struct(F.lit(dataset).alias("dataset"), marker.alias("release"), F.struct(F.lit(start).alias("start"), F.lit(stop).alias("stop"), F.lit(preliminary).alias("stop_preliminary")).alias("coverage"), F.lit(GRID_DEG).alias("grid_deg"), retrieved.alias("retrieved_at"))


def with_optional(pairs: DataFrame, heights: DataFrame | None = None, airspeed: DataFrame | None = None, strata: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """Pairs with what other tables may know of their runs: height_m (else null), has_airspeed (else false), stratum (else unknown).

    Each of the tables (run, value) may be missing altogether; none of them loses a pair.
    """
    for other, name, default in ((heights, "height_m", F.lit(None).cast("double")), (airspeed, "has_airspeed", F.lit(False)), (strata, "stratum", F.lit("unknown"))):
        pairs = pairs.drop(name)
        if other is None:
            pairs = pairs.withColumn(name, default)
        else:
            known = other.select(F.col(run).alias("_run"), F.col(name).alias("_value"))
            pairs = pairs.join(known, pairs[run] == known["_run"], "left").withColumn(name, F.coalesce("_value", default)).drop("_run", "_value")
    return pairs


def with_join_flags(joined: DataFrame, context_time: str = "time", km: float = SPATIAL_TOLERANCE_KM, seconds: float = TEMPORAL_TOLERANCE_S) -> DataFrame:
    """Adds distance_km, mismatch_s and the join's quality flags; rows out of tolerance stay."""
    out = joined.withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("grid_lat"), F.col("grid_lon")))
    out = out.withColumn("mismatch_s", mismatch_s(F.col(context_time), F.col("window_start")))
    return out.withColumn("quality_flags", join_flags(F.col("quality_flags"), F.col("distance_km"), F.col("mismatch_s"), km, seconds))


def tall(pairs: DataFrame, keys: list[str], names: dict[str, str], unit: str = "m s-1") -> DataFrame:
    """One row for each window and variable: feature_name, value, unit."""
    renamed = pairs.select(*keys, *[F.col(c).alias(n) for c, n in names.items()])
    return renamed.unpivot(keys, list(names.values()), "feature_name", "value").withColumn("unit", F.lit(unit))


def sphere_nearest(windows: DataFrame, points: DataFrame, key: str, first: float = 0.0) -> DataFrame:
    """The nearest of all fixed points(point_id, plat, plon) for every window, however far: (key, point_id, distance_km).

    Cubes of an edge of at most ``first``, of a sphere of radius 1, are not cut again. Distances are compared to the millimetre; the smaller
    point_id wins a tie. Windows without a place get nulls; so do all if there are no points.
    """
    out = _nearest(windows, points, key, [], 6, None, first)
    return _none(windows, points, key) if out is None else windows.select(key).join(out, key, "left")
