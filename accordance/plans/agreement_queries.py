"""Queries on paired windows: agreement, quantiles, directions, regimes, suppression, resampling, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.functions.classify import rounded
from accordance.operators import agreement as ops
from accordance.operators import bootstrap, contracts, frame, ranking, sampling
from accordance.operators.tables import written
from accordance.plans import bindings
from accordance.plans.bindings import BAND, TIES

SEED = 20260827


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.differences(bindings.pairs(spark, sf_dir))


def _kept_levels(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """As ``_levels``, from a narrow table written once, for what reads the rows more than once."""
    columns = ["stratum", "onboard_u", "onboard_v", "u100", "v100", "u10", "v10", "one", *names]
    return ops.differences(written(bindings.pairs(spark, sf_dir).select(*columns), "pairs"))


#: What the axes of cells and the counts for publication read.
CELL_COLUMNS = ("run_id", "vehicle", "airframe", "has_airspeed", "var_u", "var_v", "season", "height_m")


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_weights(_levels(spark, sf_dir), bindings.strata(spark, sf_dir))


def rounded_doubles(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded for comparison; the rest as it is."""
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def paired_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.complete_split(bindings.gappy_pairs(spark, sf_dir))[1]


def pairs_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frame.without_objections(bindings.pairs(spark, sf_dir), bindings.objections(spark, sf_dir), "run_id", "vehicle")
    return ops.distinct_counts(kept, ["stratum"])


def difference_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean_u = (F.col("ctx_u") + F.col("onboard_u")) / 2
    return rounded_doubles(_levels(spark, sf_dir).select(*TIES, "level", "du", "dv", "magnitude", "dspeed", mean_u.alias("mean_u")))


def agreement_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _levels(spark, sf_dir)
    return rounded_doubles(ops.distinct_counts(base, ["level", "stratum"]).join(ops.bland_altman(base, ["level", "stratum"]), ["level", "stratum"]))


def agreement_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(ops.bland_altman(_levels(spark, sf_dir), ["level"]))


def agreement_reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(ops.bland_altman(weighted(spark, sf_dir), ["level"], weight=F.col("design_weight")))


def implied_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(ops.implied_population(bindings.pairs(spark, sf_dir), bindings.strata(spark, sf_dir)))


def magnitude_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.magnitude_limits(_kept_levels(spark, sf_dir), ["level", "stratum"], "one")
    return rounded_doubles(out.withColumn("useful", F.col("p97_5") <= BAND))


def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(ranking.weighted_quantiles(weighted(spark, sf_dir), ["level"], "magnitude", "design_weight", {"q0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p97_5": 0.975, "q1": 1.0}))


def direction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(ops.direction_statistics(ops.with_direction(_kept_levels(spark, sf_dir)), ["level", "stratum"]))


def direction_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions under several speed thresholds, in one pass."""
    rows = _kept_levels(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, (1.0, 2.0, 3.0)))))
    return rounded_doubles(ops.direction_statistics(ops.with_direction(rows, F.col("threshold")), ["level", "threshold"]))


def vector_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions between embedding components 1, 2 and 3, 4, by label."""
    from accordance.session import table

    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", e(0).alias("onboard_u"), e(1).alias("onboard_v"), e(2).alias("ctx_u"), e(3).alias("ctx_v"))
    return rounded_doubles(ops.direction_statistics(ops.with_direction(rows, 0.05), ["label"]))


def estimator_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(ops.estimator_ratio(_levels(spark, sf_dir), ["level", "stratum"]))


def regime_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.suppressed_split(ops.regime_cells(bindings.pairs(spark, sf_dir)), ["axis", "cell"])


def suppressed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin cells (nation and month): counts for all, figures only where published."""
    rows = ops.differences(bindings.pairs(spark, sf_dir), {"100m": ("u100", "v100")}).withColumn("month", F.date_format("window_start", "yyyy-MM"))
    by = ["nation", "month"]
    out = ops.suppressed_split(rows, by).join(rows.groupBy(*by).agg(F.avg("du").alias("bias_u")), by)
    return rounded_doubles(out.withColumn("bias_u", F.when(F.col("published"), F.col("bias_u"))))


def _axis_pairs(spark: SparkSession, sf_dir: str, pooled: bool = False, *more: str) -> tuple[DataFrame, list[str]]:
    """Pairs with their cells, written once and narrow, and the axes; ``pooled``: also by stratum and in all, with design weights."""
    axes, rows = ops.regime_axes(pooled), bindings.pairs(spark, sf_dir)
    weights = [*more, "design_weight"] if pooled else more
    rows = ops.with_weights(rows, bindings.strata(spark, sf_dir)) if pooled else rows
    return written(rows.select("run_id", "vehicle", "onboard_u", "onboard_v", "u100", "v100", "u10", "v10", *weights, *[v.alias(k) for k, v in axes.items()]), "pairs"), list(axes)


def regime_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, limits of agreement and quantiles of the published cells: a few rows, written, as several plans read them more than once."""
    return _regimes(*_axis_pairs(spark, sf_dir))


def _regimes(pairs: DataFrame, axes: list[str]) -> DataFrame:
    out = ops.cell_statistics(pairs, axes, {"sample": None}, ("du", "dv"), {"p50": 0.5, "p97_5": 0.975})
    return written(rounded_doubles(out.drop("pooling")), "regimes")


def tolerance_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(ops.tolerance_sensitivity(_kept_levels(spark, sf_dir, "run_id", "vehicle", "distance_km"), BAND), "cap_km")


def mismatch_constancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordance.operators.context import mismatch_s

    rows = bindings.pairs(spark, sf_dir).withColumn("mismatch_s", mismatch_s(F.date_trunc("hour", "window_start"), F.col("window_start")))
    return rows.groupBy("stratum").agg(F.array_join(F.transform(F.array_sort(F.collect_set("mismatch_s")), lambda x: x.cast("int").cast("string")), ",").alias("seen"), (F.count_distinct("mismatch_s") == 1).alias("constant"))


def one_window_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.differences(bindings.pairs(spark, sf_dir), {"100m": ("u100", "v100")}).select("run_id", F.concat_ws("-", *TIES).alias("row_key"), "du", "dv")
    return rounded_doubles(sampling.one_per_group(rows, "run_id", "row_key", SEED).select("run_id", "row_key", "du", "dv"))


def bootstrap_bias_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(bootstrap.bias_intervals(_levels(spark, sf_dir), 20, SEED, ["du", "dv", "magnitude"], ["level"]))


def bootstrap_quantile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = written(ops.differences(bindings.pairs(spark, sf_dir), {"100m": ("u100", "v100")}).select("stratum", "run_id", "level", "magnitude"), "magnitudes")
    drawn = bootstrap.draws(bootstrap.numbered_runs(base), 5, SEED)
    return rounded_doubles(bootstrap.quantile_interval(base, drawn, "magnitude", 0.975, ["level"]))


#: The weight column of each pooling.
POOLINGS = {"sample": None, "reweighted": "design_weight"}


def validation_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.validation_artifacts(*_axis_pairs(spark, sf_dir, True), BAND, POOLINGS)


def artifact_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of 2,000 resamples for every published cell, level, pooling and statistic."""
    return rounded_doubles(ops.artifact_intervals(*_axis_pairs(spark, sf_dir, True), POOLINGS))


def forest_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest plot's rows with the interval of p97.5, cut at the plot's edge, and whether it was cut."""
    pairs, axes = _axis_pairs(spark, sf_dir, False, "stratum")
    level = {"100m": ops.LEVELS["100m"]}
    ends = ops.artifact_intervals(pairs, axes, {"sample": None}, level).filter("statistic = 'p97_5'").select("axis", "cell", "low", "high")
    out = forest_places(_regimes(pairs, axes)).join(ends, ["axis", "cell"])
    return rounded_doubles(out.select("axis", "cell", "place", "p97_5", F.least("low", "clip").alias("low"), F.least("high", "clip").alias("high"), (F.col("high") > F.col("clip")).alias("cut"), "useful"))


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the pairs' features: missing values where gaps are, and distances beyond the tolerance."""
    rows = bindings.gappy_pairs(spark, sf_dir).withColumn("key", F.concat_ws("-", *TIES))
    number = lambda c: ~ops.missing(F.col(c))
    rules: list[tuple[str, str, Column]] = [("join.distance_to_grid_point_km", "maximum", F.col("distance_km") <= 24.5), *contracts.within("values", [(c, "number", number(c)) for c in ("u100", "v100", "u10", "v10")]), contracts.required("run_id"), contracts.at_least("distance_km", 0)]
    return contracts.violations(rows, "key", rules)


def variant_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the p97.5 of each published cell moves from the 100 m to the 10 m level: upper median, range, changed verdicts."""
    cells = regime_agreement(spark, sf_dir)
    base, other = (cells.filter(F.col("level") == name).select("axis", "cell", F.col("p97_5").alias(f"p_{name}")) for name in ("100m", "10m"))
    both = base.join(other, ["axis", "cell"]).withColumn("shift", rounded(F.col("p_10m") - F.col("p_100m")))
    middle = ranking.nearest_rank(both.withColumn("all", F.lit("all")), ["all"], "shift", {"median": 0.5})
    rest = both.agg(F.count(F.lit(1)).alias("n"), F.min("shift").alias("least"), F.max("shift").alias("most"), F.count_if((F.col("p_100m") <= BAND) != (F.col("p_10m") <= BAND)).alias("flips"))
    return rest.crossJoin(middle.drop("all"))  # one row each


def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.differences(bindings.pairs(spark, sf_dir), {"100m": ("u100", "v100")})
    out = ranking.ecdf(written(rows.select(*TIES, "stratum", "magnitude"), "magnitudes"), ["stratum"], "magnitude", TIES)
    return out.select(*TIES, "stratum", rounded(F.col("magnitude")).alias("magnitude"), rounded(F.col("share"), 9).alias("share"))


def forest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 m cells in the order of a forest plot: by axis, and within it from the largest p97.5 down; clipped at 1.15 times the largest."""
    from pyspark.sql import Window

    return forest_places(regime_agreement(spark, sf_dir))


def forest_places(cells: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    cells = cells.filter("level = '100m'")  # a few cells for each axis
    top = F.ceil(F.max("p97_5").over(Window.partitionBy("level")) * 1.15)
    place = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("p97_5"), "cell"))
    return cells.select("axis", "cell", place.cast("long").alias("place"), "p50", "p97_5", top.cast("long").alias("clip"), (F.col("p97_5") <= BAND).alias("useful"))


def outside_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that the plots of differences and of magnitudes would not show."""
    return ops.outside_frame(_levels(spark, sf_dir))


def altitude_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from accordance.functions.classify import altitude_band

    rows = bindings.pairs(spark, sf_dir).filter("height_m is not null")
    runs = ranking.linear_quantiles(rows, ["run_id"], "height_m", {"median_m": 0.5, "p90_m": 0.9})
    runs = runs.join(rows.groupBy("run_id").agg(F.max("height_m").alias("max_m"), F.count(F.lit(1)).alias("n")), "run_id")
    return rounded_doubles(runs.withColumn("band", altitude_band(F.col("median_m"))))


def route_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads of the field compared value by value: the pairs' own, and one written and read by itself. A null on either side stays null."""
    rows = bindings.gappy_pairs(spark, sf_dir).select(*TIES, "stratum", F.when(~F.isnan("v100"), F.col("u100")).alias("value"))
    other = written(bindings.gappy_pairs(spark, sf_dir).select(*TIES, F.col("u10").alias("other")), "route")
    same = (F.col("value") > 0) == (F.col("other") > 0)
    joined = written(rows.join(other, TIES).select("stratum", F.abs(F.col("value") - F.col("other")).alias("gap"), same.alias("same")), "gaps")
    middle = ranking.linear_quantiles(joined, ["stratum"], "gap", {"median_gap": 0.5})
    out = joined.groupBy("stratum").agg(F.count("gap").alias("compared"), F.max("gap").alias("largest_gap"), F.count_if("same").alias("agree"), F.count_if(~F.col("same")).alias("disagree"))
    return rounded_doubles(out.join(middle, "stratum", "left"))


QUERIES = [paired_complete, pairs_excluded, difference_series, agreement_by_stratum, agreement_pooled, agreement_reweighted, implied_population, magnitude_quantiles, weighted_quantiles, direction_stats, direction_sweep, vector_directions, estimator_ratio, regime_cells, suppressed_cells, regime_agreement, tolerance_sensitivity, mismatch_constancy, one_window_per_run, bootstrap_bias_ci, bootstrap_quantile_ci, validation_artifacts, artifact_intervals, forest_intervals, contract_violations, variant_shift, ecdf, forest_table, outside_frame, altitude_bands, route_comparison]

PAIRS = """cut AS (SELECT max(o_orderdate)::DATE - 365 AS cutoff FROM orders),
  b AS (SELECT l_orderkey AS run_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, o_custkey AS vehicle, r_name || '|' || (CASE WHEN o_orderdate::DATE >= cutoff THEN 'within' ELSE 'older' END) AS stratum, n_name AS nation,
    l_shipdate AS window_start, (n_nationkey * 5 - 60)::DOUBLE AS lat, (l_quantity - 25) / 5e0 AS onboard_u, l_extendedprice / 10000e0 - 5 AS onboard_v,
    l_tax * 100 - 4 + (l_partkey % 97) / 97e0 AS off_u, l_discount * 100 - 5 + (l_suppkey % 89) / 89e0 AS off_v, l_linenumber * 0.25e0 AS su, l_linenumber * 0.2e0 AS sv,
    l_quantity / 2 AS distance_km, o_orderpriority AS hw, c_mktsegment AS seg, l_extendedprice / 250 - 60 AS height_m
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, cut),
  pairs AS (SELECT *, su * su AS var_u, sv * sv AS var_v, onboard_u + off_u AS u100, onboard_v + off_v AS v100, onboard_u + off_u * 0.8e0 AS u10, onboard_v + off_v * 0.8e0 AS v10,
    CASE WHEN seg = 'FURNITURE' THEN 'fixed_wing' ELSE 'vtol' END AS airframe, hw <> '5-LOW' AS has_airspeed,
    (CASE WHEN lat < 0 THEN ['JJA', 'SON', 'DJF', 'MAM'] ELSE ['DJF', 'MAM', 'JJA', 'SON'] END)[(floor((month(window_start) % 12) / 3) + 1)::INT] AS season FROM b)"""
GAPPY = f"{PAIRS}, gappy AS (SELECT * REPLACE (CASE WHEN line = 6 AND distance_km > 20 THEN NULL ELSE u10 END AS u10, CASE WHEN line = 3 AND distance_km < 2 THEN 'nan'::DOUBLE ELSE v100 END AS v100) FROM pairs)"
LEVELS = f"""{PAIRS}, lv0 AS (SELECT *, '100m' AS level, u100 AS ctx_u, v100 AS ctx_v FROM pairs UNION ALL SELECT *, '10m', u10, v10 FROM pairs),
  lv AS (SELECT *, ctx_u - onboard_u AS du, ctx_v - onboard_v AS dv, sqrt((ctx_u - onboard_u) * (ctx_u - onboard_u) + (ctx_v - onboard_v) * (ctx_v - onboard_v)) AS magnitude, sqrt(ctx_u * ctx_u + ctx_v * ctx_v) - sqrt(onboard_u * onboard_u + onboard_v * onboard_v) AS dspeed FROM lv0)"""
STRATA = """st AS (SELECT r_name || '|' || (CASE WHEN o_orderdate::DATE >= cutoff THEN 'within' ELSE 'older' END) AS stratum, count(*) AS frame_size FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, cut GROUP BY 1)"""
R = lambda x, name: f"round({x}, 6) + 0e0 AS {name}"
CELLS = """rc AS (SELECT *, 'airframe' AS axis, airframe AS cell FROM lv UNION ALL SELECT *, 'airspeed_topic', CASE WHEN has_airspeed THEN 'present' ELSE 'absent' END FROM lv
  UNION ALL SELECT *, 'estimator_sigma', CASE WHEN sqrt((var_u + var_v) / 2) < 0.5 THEN 'sigma_lt_0.5' WHEN sqrt((var_u + var_v) / 2) < 1 THEN 'sigma_0.5_to_1.0' ELSE 'sigma_ge_1.0' END FROM lv UNION ALL SELECT *, 'season', season FROM lv
  UNION ALL SELECT *, 'altitude_proxy', CASE WHEN height_m IS NULL OR height_m < -50 OR height_m > 5000 THEN 'unknown' WHEN height_m < 50 THEN 'agl_proxy_lt_50m' WHEN height_m < 120 THEN 'agl_proxy_50_to_120m' ELSE 'agl_proxy_ge_120m' END FROM lv)"""


def _signed(values: tuple[str, ...]) -> str:
    return ", ".join(f"{R(f'avg({x})', f'bias_{x}')}, {R(f'coalesce(stddev_samp({x}), 0)', f'sd_{x}')}, {R(f'avg({x}) - 1.96e0 * coalesce(stddev_samp({x}), 0)', f'loa_low_{x}')}, {R(f'avg({x}) + 1.96e0 * coalesce(stddev_samp({x}), 0)', f'loa_high_{x}')}" for x in values)


def _quantiles(source: str, by: str, quantiles: dict[str, float], weight: str = "1e0", value: str = "magnitude", name: str = "wq", ties: str = "run_id, line, part, supp") -> str:
    """CTEs ending in ``name``: weighted quantiles at plotting positions, by neighbours."""
    picks = ", ".join(f"coalesce(max(CASE WHEN c <= {q}e0 AND {q}e0 < c2 THEN v + (v2 - v) * ({q}e0 - c) / (c2 - c) END), CASE WHEN {q}e0 < min(c) THEN min(v) ELSE max(v) END) AS {n}" for n, q in quantiles.items())
    return f"""{name}p AS (SELECT {by}, {value} AS v, {ties}, {weight} AS w, (sum({weight}) OVER (PARTITION BY {by} ORDER BY {value}, {weight}, {ties} ROWS UNBOUNDED PRECEDING) - 0.5e0 * {weight}) / sum({weight}) OVER (PARTITION BY {by}) AS c FROM {source}),
  {name}l AS (SELECT *, lead(v) OVER o AS v2, lead(c) OVER o AS c2 FROM {name}p WINDOW o AS (PARTITION BY {by} ORDER BY v, w, {ties})), {name} AS (SELECT {by}, {picks} FROM {name}l GROUP BY {by})"""


WRAP = lambda a: f"(CASE WHEN {a} + 180 - 360 * floor(({a} + 180) / 360) - 180 = -180 THEN 180e0 ELSE {a} + 180 - 360 * floor(({a} + 180) / 360) - 180 END)"


def _directions(source: str, by: str, threshold: str) -> str:
    angle = WRAP("degrees(atan2(ctx_v, ctx_u) - atan2(onboard_v, onboard_u))")
    return f"""dr AS (SELECT {by}, CASE WHEN sqrt(onboard_u * onboard_u + onboard_v * onboard_v) > {threshold} AND sqrt(ctx_u * ctx_u + ctx_v * ctx_v) > {threshold} THEN {angle} END AS angle FROM {source}),
  ds AS (SELECT {by}, count(angle) AS n_defined, count_if(angle IS NULL)::BIGINT AS n_undefined, {R('avg(abs(angle))', 'mean_abs')}, {R('quantile_cont(abs(angle), 0.5)', 'median_abs')}, {R('quantile_cont(abs(angle), 0.9)', 'p90_abs')}, {R('quantile_cont(abs(angle), 0.95)', 'p95_abs')},
    avg(sin(radians(angle))) AS s, avg(cos(radians(angle))) AS c FROM dr GROUP BY {by})
  SELECT * EXCLUDE (s, c), {R('degrees(atan2(s, c))', 'circular_mean')}, {R('sqrt(s * s + c * c)', 'resultant')}, {R('CASE WHEN s * s + c * c > 0 THEN degrees(sqrt(greatest(0e0, -2 * ln(least(1e0, sqrt(s * s + c * c)))))) END', 'circular_sd')} FROM ds"""


PUBLISHED = "count(DISTINCT run_id) >= 20 AND count(DISTINCT vehicle) >= 10"
COUNTS = "count(*) AS n_windows, count(DISTINCT run_id) AS n_runs, count(DISTINCT vehicle) AS n_vehicles"
REGIMES = f"""{LEVELS}, {CELLS}, {_quantiles('rc', 'axis, cell, level', {'p50': 0.5, 'p97_5': 0.975})},
  ra AS (SELECT axis, cell, level, {COUNTS}, {_signed(('du', 'dv'))} FROM rc GROUP BY ALL HAVING {PUBLISHED}),
  regimes AS (SELECT ra.*, {R('p50', 'p50')}, {R('p97_5', 'p97_5')} FROM ra JOIN wq USING (axis, cell, level))"""
RUNS = """runs AS (SELECT stratum, run_id, row_number() OVER (PARTITION BY stratum ORDER BY run_id) - 1 AS slot, count(*) OVER (PARTITION BY stratum) AS nr FROM (SELECT DISTINCT stratum, run_id FROM pairs))"""


def _draws(resamples: int) -> str:
    return f"""{RUNS}, picks AS (SELECT b, stratum, ('0x' || substr(md5('{SEED}:' || b || ':' || stratum || ':' || slot), 1, 8))::BIGINT % nr AS slot FROM runs, range({resamples}) AS x(b)),
  drawn AS (SELECT b, p.stratum, run_id, count(*) AS m FROM picks p JOIN runs r ON p.stratum = r.stratum AND p.slot = r.slot GROUP BY ALL)"""


ORACLES = {
    "paired_complete": f"""WITH {GAPPY} SELECT count(*) AS rows, count_if(u10 IS NOT NULL AND NOT isnan(v100))::BIGINT AS kept, count_if(u10 IS NULL OR isnan(v100))::BIGINT AS incomplete, 0::BIGINT AS missing_u100, count_if(isnan(v100))::BIGINT AS missing_v100, count_if(u10 IS NULL)::BIGINT AS missing_u10, 0::BIGINT AS missing_v10 FROM gappy""",
    "pairs_excluded": f"WITH {PAIRS} SELECT stratum, {COUNTS} FROM pairs WHERE run_id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 450000) AND vehicle NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY stratum",
    "difference_series": f"WITH {LEVELS} SELECT run_id, line, part, supp, level, {R('du', 'du')}, {R('dv', 'dv')}, {R('magnitude', 'magnitude')}, {R('dspeed', 'dspeed')}, {R('(ctx_u + onboard_u) / 2', 'mean_u')} FROM lv",
    "agreement_by_stratum": f"WITH {LEVELS} SELECT level, stratum, {COUNTS}, {_signed(('du', 'dv', 'dspeed'))} FROM lv GROUP BY level, stratum",
    "agreement_pooled": f"WITH {LEVELS} SELECT level, {_signed(('du', 'dv', 'dspeed'))} FROM lv GROUP BY level",
    "agreement_reweighted": f"""WITH {LEVELS}, {STRATA}, w AS (SELECT lv.*, frame_size / 800e0 AS w FROM lv JOIN st USING (stratum)), m AS (SELECT level, sum(w) AS sw, sum(w * du) / sum(w) AS mdu, sum(w * dv) / sum(w) AS mdv, sum(w * dspeed) / sum(w) AS mdspeed FROM w GROUP BY level),
      s AS (SELECT level, any_value(mdu) AS mdu, any_value(mdv) AS mdv, any_value(mdspeed) AS mdspeed, sqrt(sum(w * (du - mdu) * (du - mdu)) / (any_value(sw) - 1)) AS sdu, sqrt(sum(w * (dv - mdv) * (dv - mdv)) / (any_value(sw) - 1)) AS sdv, sqrt(sum(w * (dspeed - mdspeed) * (dspeed - mdspeed)) / (any_value(sw) - 1)) AS sdspeed FROM w JOIN m USING (level) GROUP BY level)
      SELECT level, {', '.join(f"{R(f'm{x}', f'bias_{x}')}, {R(f's{x}', f'sd_{x}')}, {R(f'm{x} - 1.96e0 * s{x}', f'loa_low_{x}')}, {R(f'm{x} + 1.96e0 * s{x}', f'loa_high_{x}')}" for x in ('du', 'dv', 'dspeed'))} FROM s""",
    "implied_population": f"WITH {PAIRS}, {STRATA} SELECT stratum, count(DISTINCT run_id) AS n_runs, {R('any_value(frame_size) * count(DISTINCT run_id) / 800e0', 'implied')} FROM pairs JOIN st USING (stratum) GROUP BY stratum",
    "magnitude_quantiles": f"""WITH {LEVELS}, {_quantiles('lv', 'level, stratum', {'p50': 0.5, 'p90': 0.9, 'p95': 0.95, 'p97_5': 0.975})} SELECT level, stratum, {R('m', 'mean_magnitude')}, {R('s', 'sd_magnitude')}, {', '.join(R(x, x) for x in ('p50', 'p90', 'p95', 'p97_5'))}, wq.p97_5 <= {BAND} AS useful
      FROM (SELECT level, stratum, avg(magnitude) AS m, coalesce(stddev_samp(magnitude), 0) AS s FROM lv GROUP BY level, stratum) JOIN wq USING (level, stratum)""",
    "weighted_quantiles": f"""WITH {LEVELS}, {STRATA}, w0 AS (SELECT lv.*, frame_size / 800e0 AS dw FROM lv JOIN st USING (stratum)), {_quantiles('w0', 'level', {'q0': 0.0, 'p10': 0.1, 'p50': 0.5, 'p90': 0.9, 'p97_5': 0.975, 'q1': 1.0}, 'dw')} SELECT level, {', '.join(R(x, x) for x in ('q0', 'p10', 'p50', 'p90', 'p97_5', 'q1'))} FROM wq""",
    "direction_stats": f"WITH {LEVELS}, {_directions('lv', 'level, stratum', '2e0')}",
    "direction_sweep": f"WITH {LEVELS}, sw AS (SELECT lv.*, threshold FROM lv, unnest([1e0, 2e0, 3e0]) AS x(threshold)), {_directions('sw', 'level, threshold', 'threshold')}",
    "vector_directions": f"WITH ev AS (SELECT label, embedding[1]::DOUBLE AS onboard_u, embedding[2]::DOUBLE AS onboard_v, embedding[3]::DOUBLE AS ctx_u, embedding[4]::DOUBLE AS ctx_v FROM embeddings), {_directions('ev', 'label', '0.05e0')}",
    "estimator_ratio": f"""WITH {LEVELS}, e AS (SELECT level, stratum, avg(sqrt(var_u)) AS su0, avg(sqrt(var_v)) AS sv0, stddev_samp(du) AS a, stddev_samp(dv) AS c FROM lv GROUP BY level, stratum) SELECT level, stratum, {R('su0', 'sigma_u')}, {R('sv0', 'sigma_v')}, {R('1.96e0 * a / su0', 'ratio_u')}, {R('1.96e0 * c / sv0', 'ratio_v')} FROM e""",
    "regime_cells": f"WITH {PAIRS}, lv AS (SELECT * FROM pairs), {CELLS} SELECT axis, cell, {COUNTS}, {PUBLISHED} AS published FROM rc GROUP BY axis, cell",
    "suppressed_cells": f"WITH {PAIRS} SELECT nation, strftime(window_start, '%Y-%m') AS month, {COUNTS}, {PUBLISHED} AS published, CASE WHEN {PUBLISHED} THEN round(avg(u100 - onboard_u), 6) + 0e0 END AS bias_u FROM pairs GROUP BY 1, 2",
    "regime_agreement": f"WITH {REGIMES} SELECT * FROM regimes",
    "tolerance_sensitivity": f"""WITH {LEVELS}, cp AS (SELECT lv.*, cap_km FROM lv, unnest([10e0, 15e0, 20e0, 30e0]) AS x(cap_km) WHERE distance_km <= cap_km), {_quantiles('cp', 'cap_km, level, stratum', {'p97_5': 0.975})}, g AS (SELECT cap_km, level, stratum, {COUNTS}, {PUBLISHED} AS published, avg(du) AS bu, avg(dv) AS bv FROM cp GROUP BY cap_km, level, stratum)
      SELECT g.* EXCLUDE (bu, bv), CASE WHEN published THEN round(bu, 6) + 0e0 END AS bias_u, CASE WHEN published THEN round(bv, 6) + 0e0 END AS bias_v, CASE WHEN published THEN round(p97_5, 6) + 0e0 END AS p97_5, CASE WHEN published THEN wq.p97_5 <= {BAND} END AS useful FROM g JOIN wq USING (cap_km, level, stratum)""",
    "mismatch_constancy": f"WITH {PAIRS}, m AS (SELECT stratum, (epoch_us(date_trunc('hour', window_start)) - epoch_us(window_start)) / 1000000 - 1800 AS s FROM pairs) SELECT stratum, array_to_string(list_sort(list(DISTINCT s::INT)), ',') AS seen, count(DISTINCT s) = 1 AS constant FROM m GROUP BY stratum",
    "one_window_per_run": f"""WITH {PAIRS}, k AS (SELECT *, run_id || '-' || line || '-' || part || '-' || supp AS row_key FROM pairs), h AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ('0x' || substr(md5('{SEED}:' || row_key), 1, 8))::BIGINT, row_key) AS rn FROM k)
      SELECT run_id, row_key, {R('u100 - onboard_u', 'du')}, {R('v100 - onboard_v', 'dv')} FROM h WHERE rn = 1""",
    "bootstrap_bias_ci": f"""WITH {LEVELS}, {_draws(20)}, s AS (SELECT level, stratum, run_id, count(*) AS n, sum(du) AS du, sum(dv) AS dv, sum(magnitude) AS magnitude FROM lv GROUP BY level, stratum, run_id),
      e AS (SELECT level, b, sum(m * du) / sum(m * n) AS du, sum(m * dv) / sum(m * n) AS dv, sum(m * magnitude) / sum(m * n) AS magnitude FROM s JOIN drawn USING (stratum, run_id) GROUP BY level, b),
      t AS (SELECT level, 'du' AS statistic, du AS v FROM e UNION ALL SELECT level, 'dv', dv FROM e UNION ALL SELECT level, 'magnitude', magnitude FROM e)
      SELECT level, statistic, {R('quantile_cont(v, 0.025)', 'low')}, {R('quantile_cont(v, 0.975)', 'high')} FROM t GROUP BY level, statistic""",
    "bootstrap_quantile_ci": f"""WITH {LEVELS}, {_draws(5)}, ex AS (SELECT lv.*, b, copy FROM lv JOIN drawn USING (stratum, run_id), unnest(range(1, m + 1)) AS y(copy) WHERE level = '100m'), {_quantiles('ex', 'level, b', {'v': 0.975}, ties='run_id, line, part, supp, copy', name='bq')}
      SELECT level, {R('quantile_cont(v, 0.025)', 'low')}, {R('quantile_cont(v, 0.975)', 'high')} FROM bq GROUP BY level""",
    "contract_violations": f"""WITH {GAPPY}, k AS (SELECT *, run_id || '-' || line || '-' || part || '-' || supp AS key FROM gappy) SELECT key, 'join.distance_to_grid_point_km' AS path, 'maximum' AS rule FROM k WHERE distance_km > 24.5 UNION ALL SELECT key, 'values.v100', 'number' FROM k WHERE isnan(v100) UNION ALL SELECT key, 'values.u10', 'number' FROM k WHERE u10 IS NULL""",
    "variant_shift": f"""WITH {REGIMES}, sh AS (SELECT x.p97_5 AS a, y.p97_5 AS c, round(y.p97_5 - x.p97_5, 6) + 0e0 AS shift FROM regimes x JOIN regimes y ON x.axis = y.axis AND x.cell = y.cell WHERE x.level = '100m' AND y.level = '10m')
      SELECT count(*) AS n, min(shift) AS least, max(shift) AS most, count_if((a <= {BAND}) <> (c <= {BAND}))::BIGINT AS flips, list(shift ORDER BY shift)[(floor(count(*) / 2) + 1)::BIGINT] AS median FROM sh""",
    "ecdf": f"WITH {PAIRS}, m AS (SELECT *, sqrt((u100 - onboard_u) * (u100 - onboard_u) + (v100 - onboard_v) * (v100 - onboard_v)) AS magnitude FROM pairs) SELECT run_id, line, part, supp, stratum, round(magnitude, 6) + 0e0 AS magnitude, round(row_number() OVER (PARTITION BY stratum ORDER BY magnitude, run_id, line, part, supp) / count(*) OVER (PARTITION BY stratum), 9) + 0e0 AS share FROM m",
    "forest_table": f"WITH {REGIMES} SELECT axis, cell, row_number() OVER (PARTITION BY axis ORDER BY p97_5 DESC, cell) AS place, p50, p97_5, ceil(max(p97_5) OVER () * 1.15e0)::BIGINT AS clip, p97_5 <= {BAND} AS useful FROM regimes WHERE level = '100m'",
    "outside_frame": f"""WITH {LEVELS}, {_quantiles('lv', 'level', {'p97_5': 0.975})}, l AS (SELECT level, greatest(abs(avg(du) - 1.96e0 * stddev_samp(du)), abs(avg(du) + 1.96e0 * stddev_samp(du)), abs(avg(dv) - 1.96e0 * stddev_samp(dv)), abs(avg(dv) + 1.96e0 * stddev_samp(dv))) * 3.2e0 AS span FROM lv GROUP BY level)
      SELECT level, count_if(abs(du) > span OR abs((ctx_u + onboard_u) / 2) > span)::BIGINT AS outside_u, count_if(abs(dv) > span OR abs((ctx_v + onboard_v) / 2) > span)::BIGINT AS outside_v, count_if(magnitude > ceil(p97_5 * 1.6e0))::BIGINT AS beyond FROM lv JOIN l USING (level) JOIN wq USING (level) GROUP BY level""",
    "altitude_bands": f"""WITH {PAIRS}, h AS (SELECT run_id, quantile_cont(height_m, 0.5) AS q5, quantile_cont(height_m, 0.9) AS q9, max(height_m) AS mx, count(*) AS n FROM pairs GROUP BY run_id) SELECT run_id, {R('q5', 'median_m')}, {R('q9', 'p90_m')}, {R('mx', 'max_m')}, n,
      CASE WHEN q5 < -50 OR q5 > 5000 THEN 'unknown' WHEN q5 < 50 THEN 'agl_proxy_lt_50m' WHEN q5 < 120 THEN 'agl_proxy_50_to_120m' ELSE 'agl_proxy_ge_120m' END AS band FROM h""",
    "route_comparison": f"WITH {GAPPY}, a AS (SELECT run_id, line, part, supp, stratum, CASE WHEN NOT isnan(v100) THEN u100 END AS x FROM gappy), g AS (SELECT stratum, x, y, abs(x - y) AS gap FROM a JOIN (SELECT run_id, line, part, supp, u10 AS y FROM gappy) USING (run_id, line, part, supp)) SELECT stratum, count(gap) AS compared, {R('max(gap)', 'largest_gap')}, count_if((x > 0) = (y > 0))::BIGINT AS agree, count_if((x > 0) <> (y > 0))::BIGINT AS disagree, {R('quantile_cont(gap, 0.5)', 'median_gap')} FROM g GROUP BY stratum",
}
