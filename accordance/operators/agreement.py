"""Agreement of two estimates: differences, limits, magnitudes, directions, regimes, suppression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.functions.classify import altitude_band, sigma_band
from accordance.functions.geometry import bearing_difference
from accordance.operators import ranking, resample
from accordance.operators.ranking import linear_quantiles, weighted_quantiles
from accordance.operators.tables import written

# Fixed values of the studied method.
Z, MIN_RUNS, MIN_VEHICLES, DRAWN = 1.96, 20, 10, 800
SPAN, HEADROOM = 3.2, 1.6
#: Cells up to which a run holds its cells as bits.
MASKED = 500
DIRECTION_THRESHOLD, CAPS_KM = 2.0, (10.0, 15.0, 20.0, 30.0)
LEVELS = {"100m": ("u100", "v100"), "10m": ("u10", "v10")}
MAGNITUDE_QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p97_5": 0.975}


def missing(column: Column) -> Column:
    """Null or not a number: both count as missing."""
    return column.isNull() | F.isnan(column)


def complete_split(pairs: DataFrame, columns: Sequence[str] = ("u100", "v100", "u10", "v10")) -> tuple[DataFrame, DataFrame]:
    """The rows with every value, and one row of counts of what was left out."""
    any_missing = F.lit(False)
    for c in columns:
        any_missing |= missing(F.col(c))
    counts = pairs.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~any_missing).alias("kept"), F.count_if(any_missing).alias("incomplete"), *[F.count_if(missing(F.col(c))).alias(f"missing_{c}") for c in columns])
    return pairs.filter(~any_missing), counts


def differences(pairs: DataFrame, levels: dict[str, tuple[str, str]] = LEVELS) -> DataFrame:
    """A row for each level: ctx_u, ctx_v, and context less onboard as du, dv, magnitude, dspeed."""
    entry = F.explode(F.array(*[F.struct(F.lit(name).alias("level"), F.col(u).alias("ctx_u"), F.col(v).alias("ctx_v")) for name, (u, v) in levels.items()]))
    out = pairs.withColumn("_l", entry).select(*pairs.columns, "_l.level", "_l.ctx_u", "_l.ctx_v")
    out = out.withColumn("du", F.col("ctx_u") - F.col("onboard_u")).withColumn("dv", F.col("ctx_v") - F.col("onboard_v"))
    out = out.withColumn("magnitude", F.sqrt(F.col("du") * F.col("du") + F.col("dv") * F.col("dv")))
    speed = lambda u, v: F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))
    return out.withColumn("dspeed", speed("ctx_u", "ctx_v") - speed("onboard_u", "onboard_v"))


def weighted_mean_sd(df: DataFrame, by: Sequence[str], values: Sequence[str], weight: Column | None = None) -> DataFrame:
    """mean_x and sd_x for each value: frequency weights with sum(w) - 1 below, 0 where that isn't positive.

    Unweighted, Spark's own one-pass deviation does. Weighted, two passes: squares are summed
    around the group's mean, so that large offsets cancel exactly; the means are a row for
    each group, which Spark broadcasts if small.
    """
    if weight is None:
        moments = [c for x in values for c in (F.avg(x).alias(f"mean_{x}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"sd_{x}"))]
        return df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("sum_w"), *moments)
    base = df.withColumn("_w", weight)
    means = base.groupBy(*by).agg(F.sum("_w").alias("sum_w"), *[(F.sum(F.col("_w") * F.col(x)) / F.sum("_w")).alias(f"mean_{x}") for x in values])
    right = means.withColumnsRenamed({b: f"_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on &= base[b].eqNullSafe(right[f"_{b}"])
    joined = base.join(right, on)
    square = lambda x: F.sum(F.col("_w") * (F.col(x) - F.col(f"mean_{x}")) * (F.col(x) - F.col(f"mean_{x}")))
    spread = lambda x: F.when(F.first("sum_w") - 1 > 0, F.sqrt(square(x) / (F.first("sum_w") - 1))).otherwise(F.lit(0.0))
    return joined.groupBy(*by).agg(F.first("sum_w").alias("sum_w"), *[c for x in values for c in (F.first(f"mean_{x}").alias(f"mean_{x}"), spread(x).alias(f"sd_{x}"))])


def bland_altman(df: DataFrame, by: Sequence[str], values: Sequence[str] = ("du", "dv", "dspeed"), weight: Column | None = None) -> DataFrame:
    """bias, sd and limits of agreement of signed differences. The magnitude has no such limits: it is skewed and summarised by quantiles."""
    return _limits(weighted_mean_sd(df, by, values, weight), by, values)


def _limits(out: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    columns = [c for x in values for c in (F.col(f"mean_{x}").alias(f"bias_{x}"), F.col(f"sd_{x}"), (F.col(f"mean_{x}") - Z * F.col(f"sd_{x}")).alias(f"loa_low_{x}"), (F.col(f"mean_{x}") + Z * F.col(f"sd_{x}")).alias(f"loa_high_{x}"))]
    return out.select(*by, *columns)


def distinct_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact counts of windows, runs and vehicles; they decide about publication."""
    runs = df.groupBy(*by, "run_id", "vehicle").agg(F.count(F.lit(1)).alias("_n"))  # far fewer rows to count distinct ids in
    return runs.groupBy(*by).agg(F.sum("_n").alias("n_windows"), F.count_distinct("run_id").alias("n_runs"), F.count_distinct("vehicle").alias("n_vehicles"))


def publishable(runs: Column, vehicles: Column, min_runs: int = MIN_RUNS, min_vehicles: int = MIN_VEHICLES) -> Column:
    return (runs >= min_runs) & (vehicles >= min_vehicles)


def suppressed_split(df: DataFrame, by: Sequence[str], min_runs: int = MIN_RUNS, min_vehicles: int = MIN_VEHICLES) -> DataFrame:
    """Every cell with its counts and whether it may be published; no identifier leaves."""
    return distinct_counts(df, by).withColumn("published", publishable(F.col("n_runs"), F.col("n_vehicles"), min_runs, min_vehicles))


def magnitude_limits(df: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """Mean, deviation and empirical quantiles of the vector difference's magnitude."""
    base = weighted_mean_sd(df, by, ["magnitude"], F.col(weight)).drop("sum_w")
    quantiles = weighted_quantiles(df, by, "magnitude", weight, MAGNITUDE_QUANTILES)
    return base.join(quantiles, list(by))


def with_direction(df: DataFrame, threshold: Column | float = DIRECTION_THRESHOLD) -> DataFrame:
    """angle: the bearing of context less that of onboard; null unless both speeds exceed the threshold."""
    fast = lambda u, v: F.hypot(F.col(u), F.col(v)) > threshold
    both = fast("onboard_u", "onboard_v") & fast("ctx_u", "ctx_v")
    return df.withColumn("angle", F.when(both, bearing_difference(F.col("ctx_u"), F.col("ctx_v"), F.col("onboard_u"), F.col("onboard_v"))))


def direction_statistics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of defined and undefined directions, absolute errors, and circular statistics of ``angle``."""
    sin, cos = F.avg(F.sin(F.radians("angle"))), F.avg(F.cos(F.radians("angle")))
    base = df.groupBy(*by).agg(F.count("angle").alias("n_defined"), F.count_if(F.col("angle").isNull()).alias("n_undefined"), F.avg(F.abs("angle")).alias("mean_abs"), sin.alias("_s"), cos.alias("_c"))
    base = base.withColumn("circular_mean", F.degrees(F.atan2("_s", "_c"))).withColumn("resultant", F.hypot("_s", "_c"))
    base = base.withColumn("circular_sd", F.when(F.col("resultant") > 0, F.degrees(F.sqrt(F.greatest(F.lit(0.0), F.lit(-2.0) * F.ln(F.least("resultant", F.lit(1.0)))))))).drop("_s", "_c")
    wide = linear_quantiles(df.filter("angle is not null").withColumn("abs_angle", F.abs("angle")), by, "abs_angle", {"median_abs": 0.5, "p90_abs": 0.9, "p95_abs": 0.95})
    return base.join(wide, list(by), "left")


def estimator_ratio(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Half-width of the limits of agreement over the mean reported sigma, for each component; null where no sigma is reported or it is 0."""
    sigma = df.groupBy(*by).agg(F.avg(F.sqrt("var_u")).alias("sigma_u"), F.avg(F.sqrt("var_v")).alias("sigma_v"))
    out = weighted_mean_sd(df, by, ["du", "dv"]).join(sigma, list(by))
    ratio = lambda x, s: F.when(F.col(s) > 0, F.lit(Z) * F.col(x) / F.col(s))
    return out.select(*by, "sigma_u", "sigma_v", ratio("sd_du", "sigma_u").alias("ratio_u"), ratio("sd_dv", "sigma_v").alias("ratio_v"))


def regime_axes(pooled: bool = False) -> dict[str, Column]:
    """The cell of a pair on each analysis axis; ``pooled``: also its stratum, and one cell for all."""
    cells = {
        "airframe": F.col("airframe"),
        "airspeed_topic": F.when(F.col("has_airspeed"), "present").otherwise("absent"),
        "estimator_sigma": sigma_band(F.col("var_u"), F.col("var_v")),
        "season": F.col("season"),
        "altitude_proxy": altitude_band(F.col("height_m")),
    }
    return cells | {"pooled": F.lit("all"), "stratum": F.col("stratum")} if pooled else cells


def regime_cells(df: DataFrame, pooled: bool = False) -> DataFrame:
    """Each row once for every analysis axis: (axis, cell); ``pooled``: also for its stratum and for all rows. One pass over the rows, whatever the axes."""
    entry = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), v.alias("cell")) for k, v in regime_axes(pooled).items()]))
    return df.withColumn("_a", entry).select(*df.columns, "_a.axis", "_a.cell")


def cell_number(cell: Column, numbers: dict[str, int]) -> Column:
    """The number of a cell, -1 for any other and for null."""
    out = None
    for name, i in numbers.items():
        out = F.when(cell == name, i) if out is None else out.when(cell == name, i)
    return F.lit(-1) if out is None else out.otherwise(-1)


def masked_counts(df: DataFrame, numbers: Sequence[Column], n: int, most: int = MASKED) -> DataFrame:
    """(_c, n_runs, n_vehicles) of cells that are numbered from 0 to n - 1; a row is in the cell of each of ``numbers``.

    A run's cells are bits of a few words, so that it stays one row whatever the axes. Beyond ``most`` cells rows are counted one by one.
    """
    if n > most:
        return distinct_counts(df.select("run_id", "vehicle", F.explode(F.array(*numbers)).alias("_c")).filter("_c >= 0"), ["_c"]).drop("n_windows")
    words = [f"_m{i}" for i in range((n + 62) // 63 or 1)]
    bit = lambda c, i: F.when((c >= 63 * i) & (c < 63 * i + 63), F.call_function("shiftleft", F.lit(1).cast("long"), c - 63 * i)).otherwise(F.lit(0).cast("long"))
    masks = [reduce(lambda a, b: a.bitwiseOR(b), [bit(c, i) for c in numbers]).alias(w) for i, w in enumerate(words)]
    ored = [F.bit_or(w).alias(w) for w in words]
    ids = written(df.select("run_id", "vehicle", *masks).groupBy("run_id", "vehicle").agg(*ored), "ids")
    held = [F.sum(F.shiftright(F.col(words[c // 63]), c % 63).bitwiseAND(F.lit(1).cast("long"))) for c in range(n)]
    sides = []
    for key, name in (("run_id", "n_runs"), ("vehicle", "n_vehicles")):
        one = ids.filter(F.col(key).isNotNull()).groupBy(key).agg(*ored).agg(F.array(*[F.coalesce(h, F.lit(0).cast("long")) for h in held]).alias("_h"))
        sides.append(one.select(F.posexplode("_h").alias("_c", name)))
    return sides[0].join(sides[1], "_c")


def cell_statistics(pairs: DataFrame, axes: Sequence[str], weights: dict[str, str | None], values: Sequence[str], quantiles: dict[str, float], levels: dict[str, tuple[str, str]] = LEVELS) -> DataFrame:
    """(axis, cell, level, n_windows, n_runs, n_vehicles, bias, sd, limits, quantiles, pooling) of the published cells.

    ``pairs`` has a column for each axis; ``weights`` names a weight column for each pooling, None for none. Rows that agree on
    all axes and weights are an atom, whose moments are added up to those of the cells; cells go by number, so that what is
    formed for every cell of a row is an integer. Cells are counted in the driver's plan: as many as the axes have.
    """
    names = list(levels)
    rows = differences(pairs, levels)
    kept = list(dict.fromkeys(w for w in weights.values() if w))
    moments = [m for x in values for m in (F.count(x).alias(f"n_{x}"), F.avg(x).alias(f"m_{x}"), (F.var_pop(x) * F.count(x)).alias(f"q_{x}"))]
    atoms = written(rows.groupBy(*axes, "level", *kept).agg(F.count(F.lit(1)).alias("n"), *moments), "atoms")
    entry = lambda df: df.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("cell")) for a in axes])).alias("_a")).select(*[c for c in df.columns if c not in axes], "_a.axis", "_a.cell")
    tall = entry(atoms)
    found = sorted((r["axis"], r["cell"]) for r in tall.select("axis", "cell").filter("cell is not null").distinct().collect())
    place = {k: i for i, k in enumerate(found)}
    spark, by = pairs.sparkSession, ["axis", "cell", "level"]
    keys = [F.struct(*[F.lit(x).alias(c) for c, x in zip([*by, "_c", "_g"], (*k, level, i, i * len(names) + j), strict=True)]) for k, i in place.items() for j, level in enumerate(names)]
    known = spark.range(1).select(F.inline(F.array(*keys).cast("array<struct<axis:string,cell:string,level:string,_c:int,_g:int>>")))

    number = lambda axis: cell_number(F.col(axis), {c: i for (a, c), i in place.items() if a == axis})
    numbers = [f"_c{i}" for i in range(len(axes))]  # formed once for a pair, -1 where a cell is null
    pairs = pairs.select("*", *[number(a).alias(c) for a, c in zip(axes, numbers, strict=True)])
    counts = masked_counts(pairs, [F.col(c) for c in numbers], len(place))
    counts = known.join(counts, "_c").join(tall.groupBy(*by).agg(F.sum("n").alias("n_windows")), by)
    counts = written(counts.filter(publishable(F.col("n_runs"), F.col("n_vehicles"))).select(*by, "_g", "n_windows", "n_runs", "n_vehicles"), "published")
    level = reduce(lambda rest, j: F.when(F.col("level") == names[j], F.lit(j)).otherwise(rest), range(len(names)), F.lit(0))
    rows = differences(pairs.select("onboard_u", "onboard_v", *kept, *numbers, *dict.fromkeys(c for two in levels.values() for c in two)), levels)
    numbered = rows.select("magnitude", *kept, ranking.octave_cell(F.col("magnitude")).alias("_o"), F.array(*[F.col(c) * len(names) + level for c in numbers]).alias("_gs"))
    numbered = numbered.select("magnitude", *kept, "_o", F.explode("_gs").alias("_g")).withColumn("_one", F.lit(1.0))
    out = None
    for pooling, weight in weights.items():
        moved = _added_up(tall, by, values, weight)
        size = ranking.weighted_quantiles(numbered, ["_g"], "magnitude", weight or "_one", quantiles, cell="_o")
        made = counts.join(moved, by).join(size, "_g").drop("_g").withColumn("pooling", F.lit(pooling))
        out = made if out is None else out.unionByName(made)
    return out


def _added_up(atoms: DataFrame, by: Sequence[str], values: Sequence[str], weight: str | None) -> DataFrame:
    """bias, sd and limits of agreement from the counts, means and squares of atoms, as ``bland_altman`` gives them from rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    whole = Window.partitionBy(*by)
    mass = {x: w * F.col("n" if weight else f"n_{x}") for x in values}  # without weights nulls aren't counted
    d = atoms.select("*", *[F.sum(mass[x]).over(whole).alias(f"w_{x}") for x in values])
    d = d.select("*", *[(F.sum(w * F.col(f"n_{x}") * F.col(f"m_{x}")).over(whole) / F.col(f"w_{x}")).alias(f"c_{x}") for x in values])
    columns = []
    for x in values:
        off, sw = F.col(f"m_{x}") - F.col(f"c_{x}"), F.max(f"w_{x}")
        square = F.sum(w * (F.col(f"q_{x}") + F.col(f"n_{x}") * off * off))
        columns += [F.max(f"c_{x}").alias(f"mean_{x}"), F.when(sw - 1 > 0, F.sqrt(square / (sw - 1))).otherwise(F.lit(0.0)).alias(f"sd_{x}")]
    return _limits(d.groupBy(*by).agg(*columns), by, values)


def looked_up(artifacts: DataFrame, asked: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The artifact of each asked (axis, cell, level); one that is missing fails the query."""
    keys = artifacts.sparkSession.createDataFrame(list(asked), "axis string, cell string, level string")
    found = keys.join(artifacts.withColumn("_found", F.lit(True)), ["axis", "cell", "level"], "left")
    name = F.concat_ws(" ", F.lit("no such artifact:"), "axis", "cell", "level")
    return found.withColumn("level", F.when(F.col("_found").isNull(), F.raise_error(name)).otherwise(F.col("level"))).drop("_found")


def with_weights(df: DataFrame, strata: DataFrame, drawn: int = DRAWN) -> DataFrame:
    """Design weights N_h / drawn; a row of a stratum that isn't listed fails the query."""
    right = strata.select(F.col("stratum").alias("_stratum"), (F.col("frame_size") / F.lit(float(drawn))).alias("design_weight"))
    right = written(right, "strata")  # so that Spark knows that it is small and doesn't deal all rows by their stratum
    out = df.join(right, df["stratum"] == right["_stratum"], "left").drop("_stratum")
    return out.withColumn("design_weight", F.when(F.col("design_weight").isNull(), F.raise_error(F.concat(F.lit("no such stratum: "), F.coalesce("stratum", F.lit("null"))))).otherwise(F.col("design_weight")))


def implied_population(df: DataFrame, strata: DataFrame, drawn: int = DRAWN) -> DataFrame:
    """N_h * usable runs / drawn for each stratum."""
    used = df.groupBy("stratum").agg(F.count_distinct("run_id").alias("n_runs"))
    return used.join(strata, "stratum").select("stratum", "n_runs", (F.col("frame_size") * F.col("n_runs") / F.lit(float(drawn))).alias("implied"))


def outside_frame(df: DataFrame, span: float = SPAN, headroom: float = HEADROOM) -> DataFrame:
    """How many points a plot leaves out at each level: differences or means beyond ``span`` times the widest limit, magnitudes beyond the next whole number above ``headroom`` times p97.5."""
    limits = bland_altman(df, ["level"], ("du", "dv")).join(weighted_quantiles(df.withColumn("_one", F.lit(1.0)), ["level"], "magnitude", "_one", {"p97_5": 0.975}), "level")
    widest = F.greatest(*[F.abs(f"loa_{side}_{x}") for side in ("low", "high") for x in ("du", "dv")])
    # written, so that Spark knows that it is small and doesn't deal all rows by their level
    limits = written(limits.select("level", (widest * span).alias("span"), F.ceil(F.col("p97_5") * headroom).alias("top")), "limits")
    joined = df.join(limits, "level")
    out = lambda d, a, b: F.count_if((F.abs(d) > F.col("span")) | (F.abs((F.col(a) + F.col(b)) / 2) > F.col("span")))
    return joined.groupBy("level").agg(out("du", "ctx_u", "onboard_u").alias("outside_u"), out("dv", "ctx_v", "onboard_v").alias("outside_v"), F.count_if(F.col("magnitude") > F.col("top")).alias("beyond"))


def tolerance_sensitivity(df: DataFrame, band: float, caps: Sequence[float] = CAPS_KM, min_runs: int = MIN_RUNS, min_vehicles: int = MIN_VEHICLES) -> DataFrame:
    """Bias, p97.5 and verdict for each distance cap, level and stratum; the floor for publication holds again under each cap."""
    fits = F.filter(F.array(*map(F.lit, caps)), lambda c: F.col("distance_km") <= c)
    rows = df.filter(F.col("distance_km").isNotNull()).withColumn("cap_km", F.explode(fits)).withColumn("_one", F.lit(1.0))
    by = ["cap_km", "level", "stratum"]
    cells = suppressed_split(rows, by, min_runs, min_vehicles)
    stats = rows.groupBy(*by).agg(F.avg("du").alias("bias_u"), F.avg("dv").alias("bias_v"))
    stats = stats.join(weighted_quantiles(rows, by, "magnitude", "_one", {"p97_5": 0.975}), by)
    out = cells.join(stats, by)
    shown = lambda c: F.when(F.col("published"), c)
    return out.select(*by, "n_windows", "n_runs", "n_vehicles", "published", shown(F.col("bias_u")).alias("bias_u"), shown(F.col("bias_v")).alias("bias_v"), shown(F.col("p97_5")).alias("p97_5"), shown(F.col("p97_5") <= band).alias("useful"))


def published_cells(pairs: DataFrame, axes: Sequence[str]) -> dict[str, dict[str, int]]:
    """The published cells of each axis, numbered from 0 over all axes."""
    found = sorted({(a, r[a]) for r in pairs.select(*axes).distinct().collect() for a in axes if r[a] is not None})
    numbers = [cell_number(F.col(a), {c: i for i, (b, c) in enumerate(found) if a == b}) for a in axes]
    counts = masked_counts(pairs, numbers, len(found)).filter(publishable(F.col("n_runs"), F.col("n_vehicles")))
    kept, out = sorted(r["_c"] for r in counts.collect()), {a: {} for a in axes}
    for i, c in enumerate(kept):
        out[found[c][0]][found[c][1]] = i
    return out


def artifact_intervals(pairs: DataFrame, axes: Sequence[str], weights: dict[str, str | None], levels: dict[str, tuple[str, str]] = LEVELS, n: int = resample.RESAMPLES, seed: int = resample.SEED) -> DataFrame:
    """(axis, cell, level, pooling, statistic, low, high) of the published cells; ``weights`` has a column for each pooling, None for none. The levels of a cell share their draws.

    ``pairs`` has a column for each axis, and is read more than once.
    """
    columns = list(dict.fromkeys(["onboard_u", "onboard_v", *[c for two in levels.values() for c in two]]))
    each = resample.cell_resamples(pairs, published_cells(pairs, axes), list(levels), lambda df: differences(df, levels), columns, cell_number, [F.col(w) if w else F.lit(1.0) for w in weights.values()], n, seed)
    by = ["axis", "cell", "level"]
    pooling = F.element_at(F.array(*map(F.lit, weights)), F.col("weighting") + 1)
    return resample.ends(each, by).select(*by, pooling.alias("pooling"), "statistic", "low", "high")


def cell_directions(pairs: DataFrame, axes: Sequence[str], levels: dict[str, tuple[str, str]] = LEVELS) -> DataFrame:
    """``direction_statistics`` of the published cells by axis, cell and level."""
    cells, names = published_cells(pairs, axes), list(levels)
    pairs = pairs.select("*", *[cell_number(F.col(a), own).alias(f"_c{i}") for i, (a, own) in enumerate(cells.items())])
    level = reduce(lambda rest, j: F.when(F.col("level") == names[j], F.lit(j)).otherwise(rest), range(len(names)), F.lit(0))
    rows = with_direction(differences(pairs, levels)).select("angle", F.explode(F.array(*[F.when(F.col(f"_c{i}") >= 0, F.col(f"_c{i}") * len(names) + level) for i in range(len(cells))])).alias("_g"))
    known = pairs.sparkSession.createDataFrame([(axis, cell, name, i * len(names) + j) for axis, own in cells.items() for cell, i in own.items() for j, name in enumerate(names)], "axis string, cell string, level string, _g int")
    return direction_statistics(rows.filter("_g is not null"), ["_g"]).join(F.broadcast(known), "_g").drop("_g")


def validation_artifacts(pairs: DataFrame, axes: Sequence[str], band: float, weights: dict[str, str | None]) -> DataFrame:
    """One nested record for each published regime cell, level and pooling."""
    by = ["axis", "cell", "level"]
    ends = F.map_from_entries(F.collect_list(F.struct("statistic", F.array("low", "high").alias("ends"))))
    drawn = artifact_intervals(pairs, axes, weights).groupBy(*by, "pooling").agg(ends.alias("_ci"))
    figures = cell_statistics(pairs, axes, weights, (*resample.SIGNED, "magnitude"), MAGNITUDE_QUANTILES)
    turn = written(cell_directions(pairs, axes), "directions")  # the same for every pooling
    out = figures.join(turn, by).join(drawn, [*by, "pooling"])
    limits = lambda x: F.struct(F.col(f"bias_{x}").alias("bias"), F.col(f"sd_{x}").alias("sd"), F.array(f"loa_low_{x}", f"loa_high_{x}").alias("limits_of_agreement"))
    return out.select(
        F.concat_ws("-", F.lit("agreement"), *by, "pooling").alias("validation_model_id"),
        F.struct(*by).alias("regime"),
        F.struct("n_windows", "n_runs", "n_vehicles").alias("support"),
        F.struct(limits("du").alias("u"), limits("dv").alias("v"), limits("dspeed").alias("speed"), F.struct(F.col("bias_magnitude").alias("mean"), F.col("sd_magnitude").alias("sd"), *MAGNITUDE_QUANTILES).alias("vector_difference_magnitude")).alias("statistics"),
        F.struct("n_defined", "n_undefined", "mean_abs", "median_abs", "p90_abs", "p95_abs", "circular_mean", "resultant", "circular_sd").alias("direction"),
        F.struct(F.lit("run").alias("unit"), F.lit(resample.RESAMPLES).alias("n_resamples"), F.lit(resample.SEED).alias("seed"), *[F.col("_ci")[s].alias(f"{s}_ci") for s in resample.STATISTICS]).alias("bootstrap"),
        (F.col("p97_5") <= band).alias("useful"),
    )
