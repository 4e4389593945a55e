"""Classifications of runs and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the studied method: markers, bands, thresholds.
FIXED_WING_MARKERS = ("Fixed", "Plane", "VTOL")
ROTORCRAFT_MARKERS = ("rotor", "copter", "helicopter")
WIND_LABELS = {-1: "not given", 0: "Calm", 5: "Breeze", 8: "Gale", 10: "Storm"}
SIGMA_BANDS = (0.5, 1.0)
ALTITUDE_BANDS = (50.0, 120.0)
PLAUSIBLE_HEIGHT_M = (-50.0, 5000.0)
SPATIAL_TOLERANCE_KM, TEMPORAL_TOLERANCE_S = 30.0, 3600.0
MIN_SAMPLES, MAX_SPREAD_S, MAX_DATE_DAYS = 5, 2.0, 2


def falsy(column: Column, default: str) -> Column:
    """``default`` for a null or empty string."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def _any_of(column: Column, markers: Sequence[str]) -> Column:
    return column.rlike("|".join(markers))


def airframe_family(kind: Column) -> Column:
    """fixed_wing_or_vtol by marker as written, else rotorcraft by marker in lower case, else other."""
    return F.when(_any_of(kind, FIXED_WING_MARKERS), "fixed_wing_or_vtol").when(_any_of(F.lower(kind), ROTORCRAFT_MARKERS), "rotorcraft").otherwise("other")


def airframe_cell(kind: Column) -> Column:
    """The sampling split: fixed_wing_or_vtol, or everything else."""
    return F.when(_any_of(kind, FIXED_WING_MARKERS), "fixed_wing_or_vtol").otherwise("rotorcraft")


def airframe_regime(kind: Column) -> Column:
    """The analysis split: plain fixed wing, or vtol."""
    return F.when(F.lower(F.trim(kind)) == "fixed wing", "fixed_wing").otherwise("vtol")


def wind_label(code: Column) -> Column:
    """A declared wind code's label; unknown codes as they are, null as not given."""
    code = F.coalesce(code, F.lit(-1))
    out = F.when(code == -1, WIND_LABELS[-1])
    for value, label in WIND_LABELS.items():
        out = out.when(code == value, label)
    return out.otherwise(code.cast("string"))


def season(when: Column, lat: Column) -> Column:
    """Meteorological season, turned by half a year south of the equator."""
    north = F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON")))
    quarter = F.floor((F.month(when) % 12) / 3).cast("int")
    return F.element_at(north, F.when(lat < 0, (quarter + 2) % 4).otherwise(quarter) + 1)


def sigma_band(var_u: Column, var_v: Column) -> Column:
    """The band of the mean reported sigma; unknown where a variance is null or not a number."""
    low, high = SIGMA_BANDS
    sigma = F.sqrt((var_u + var_v) / 2)
    return F.when(sigma.isNull() | F.isnan(sigma), "unknown").when(sigma < low, f"sigma_lt_{low}").when(sigma < high, f"sigma_{low}_to_{high}").otherwise(f"sigma_ge_{high}")


def altitude_band(height: Column) -> Column:
    """The band of a height above take-off; unknown where null or outside the plausible range."""
    (floor, ceiling), (low, high) = PLAUSIBLE_HEIGHT_M, ALTITUDE_BANDS
    return (
        F.when(height.isNull() | F.isnan(height) | ~height.between(floor, ceiling), "unknown")
        .when(height < low, f"agl_proxy_lt_{low:.0f}m")
        .when(height < high, f"agl_proxy_{low:.0f}_to_{high:.0f}m")
        .otherwise(f"agl_proxy_ge_{high:.0f}m")
    )


def height_above(z: Column, valid: Column) -> Column:
    """Height from a downward z; null unless it is marked valid and a finite number."""
    finite = ~F.isnan(z) & (F.abs(z) < F.lit(float("inf")))
    return F.when(F.coalesce(valid, F.lit(False)) & finite, -z)


def release_marker(when: Column, start: str, stop: str, stop_preliminary: str) -> Column:
    """0001 up to ``stop``, 0005 up to ``stop_preliminary``, boundary days included; null outside."""
    day = F.to_date(when)
    return F.when(day < F.lit(start).cast("date"), F.lit(None)).when(day <= F.lit(stop).cast("date"), "0001").when(day <= F.lit(stop_preliminary).cast("date"), "0005")


def required_marker(when: Column, start: str, stop: str, stop_preliminary: str) -> Column:
    """The release marker, failing the query for a time outside what the field holds."""
    marker = release_marker(when, start, stop, stop_preliminary)
    return F.when(marker.isNull(), F.raise_error(F.concat(F.lit("outside the field's coverage: "), F.coalesce(when.cast("string"), F.lit("null"))))).otherwise(marker)


def markers_of(marker: Column) -> Column:
    """An aggregate: a retrieval's distinct markers, sorted and comma-joined; the query fails if there is none, as its release can't be told any more."""
    found = F.array_sort(F.collect_set(F.when(F.trim(marker) != "", marker)))
    return F.when(F.size(found) == 0, F.raise_error(F.lit("no release marker"))).otherwise(F.array_join(found, ","))


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, in the given order."""
    return F.filter(F.array(*[F.when(condition, F.lit(name)) for name, condition in named]), lambda x: x.isNotNull())


def window_flags(winds: Column, positions: Column, complete: Column, spread_s: Column, least: int = MIN_SAMPLES, most_s: float = MAX_SPREAD_S) -> Column:
    """A window's own quality flags."""
    return flags(("incomplete_window", ~complete), ("few_wind_samples", winds < least), ("few_position_samples", positions < least), ("clock_anchor_uncertain", spread_s > most_s))


def join_flags(flags_before: Column, distance_km: Column, mismatch_s: Column, km: float = SPATIAL_TOLERANCE_KM, seconds: float = TEMPORAL_TOLERANCE_S) -> Column:
    """The window's flags and those of its join; nothing is dropped."""
    return F.concat(flags_before, flags(("outside_spatial_tolerance", distance_km > km), ("outside_temporal_tolerance", F.abs(mismatch_s) > seconds)))


def exclusion_id(reference: Column) -> Column:
    """A log's id from the id itself, a link to its file, or a link that names it as log_id."""
    reference = F.trim(reference)
    asked = F.regexp_extract(reference, r"log_id=([^&]*)", 1)
    last = F.element_at(F.split(reference, "/"), -1)
    linked = F.regexp_replace(F.when(reference.contains("log_id="), asked).otherwise(last), r"\.ulg$", "")
    return F.when(reference.contains("/") | reference.contains("?"), linked).otherwise(reference)


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines; no negative zero."""
    return F.round(column, digits) + F.lit(0.0)
