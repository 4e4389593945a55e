"""Agreement statistics on rows whose answers can be worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordance.functions import classify, geometry
from accordance.operators import agreement as ops
from accordance.operators import bootstrap, contracts, ranking, sampling
from accordance.plans import bindings

SCHEMA = "run_id string, vehicle string, stratum string, line int, onboard_u double, onboard_v double, u100 double, v100 double, u10 double, v10 double, var_u double, var_v double, distance_km double, one double"


def window(i=0, u=0.0, v=0.0, cu=0.0, cv=0.0, run=None, vehicle=None, stratum="a", distance=5.0, var=(0.25, 0.25)):
    return (run or f"r{i}", vehicle or f"v{i}", stratum, i, float(u), float(v), float(cu), float(cv), float(cu), float(cv), *map(float, var), float(distance), 1.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def levels(spark, rows):
    return ops.differences(frame(spark, rows), {"100m": ("u100", "v100")})


def test_difference_is_context_less_onboard(spark):
    r = levels(spark, [window(u=2, cu=5)]).first()
    assert (r.du, r.magnitude) == (3.0, 3.0)


def test_limits_of_agreement(spark):
    r = ops.bland_altman(levels(spark, [window(i, cu=x) for i, x in enumerate((1, 1, 3, 3))]), ["level"], ("du",)).first()
    sd = math.sqrt(4 / 3)
    assert r.bias_du == 2 and r.sd_du == pytest.approx(sd) and r.loa_low_du == pytest.approx(2 - 1.96 * sd) and r.loa_high_du == pytest.approx(2 + 1.96 * sd)


def test_one_row_has_no_spread_and_none_no_row(spark):
    assert ops.bland_altman(levels(spark, [window(cu=4)]), ["level"], ("du",)).first().sd_du == 0.0
    assert ops.bland_altman(levels(spark, []), ["level"], ("du",)).count() == 0


def test_unit_weights_change_nothing_and_swapping_negates(spark):
    data = [window(i, u=i % 3, cu=i % 5, cv=i % 2) for i in range(20)]
    plain = ops.bland_altman(levels(spark, data), ["level"]).first()
    weighted = ops.bland_altman(levels(spark, data), ["level"], weight=F.lit(1.0)).first()
    assert weighted[1:] == pytest.approx(plain[1:], rel=1e-12) and weighted.level == plain.level
    swapped = ops.bland_altman(levels(spark, [window(i, u=i % 5, v=i % 2, cu=i % 3) for i in range(20)]), ["level"]).first()
    assert swapped.bias_du == pytest.approx(-plain.bias_du)


def test_design_weights_pool_strata(spark):
    data = [window(i, cu=10, stratum="older") for i in range(385)] + [window(1000 + i, stratum="within") for i in range(486)]
    strata = spark.createDataFrame([("older", 10497), ("within", 6185)], "stratum string, frame_size long")
    pooled = ops.bland_altman(ops.with_weights(levels(spark, data), strata), ["level"], ("du",), F.col("design_weight")).first()
    share = 385 * 10497 / (385 * 10497 + 486 * 6185)
    assert pooled.bias_du == pytest.approx(10 * share)
    with pytest.raises(Exception, match="no such stratum"):
        ops.with_weights(levels(spark, [window(stratum="other")]), strata).collect()


@pytest.mark.parametrize(("angle", "want"), [(0, 0), (190, -170), (-190, 170), (540, 180), (180, 180), (-180, 180)])
def test_wrap(spark, angle, want):
    assert spark.range(1).select(geometry.wrap_degrees(F.lit(float(angle)))).first()[0] == pytest.approx(want)


def test_bearing_crosses_the_wrap_point(spark):
    at = lambda d: (F.lit(math.cos(math.radians(d))), F.lit(math.sin(math.radians(d))))
    assert spark.range(1).select(geometry.bearing_difference(*at(359), *at(1))).first()[0] == pytest.approx(-2)


def test_undefined_directions_are_counted(spark):
    data = [window(0, u=0.5, cu=0.4), window(1, u=5, cu=0.4), window(2, u=5, cv=5)]
    r = ops.direction_statistics(ops.with_direction(levels(spark, data), 2.0), ["level"]).first()
    assert (r.n_defined, r.n_undefined, round(r.mean_abs, 9)) == (1, 2, 90.0)


def test_circular_mean_is_not_an_average(spark):
    data = [window(0, u=5, cu=-4.92, cv=0.87), window(1, u=5, cu=-4.92, cv=-0.87)]
    r = ops.direction_statistics(ops.with_direction(levels(spark, data)), ["level"]).first()
    assert abs(r.circular_mean) == pytest.approx(180, abs=0.01) and r.resultant == pytest.approx(0.985, abs=0.001) and r.mean_abs == pytest.approx(170, abs=0.1)


def test_missing_values_are_counted_not_lost(spark):
    nan = float("nan")
    data = [window(0)[:8] + (None,) + window(0)[9:], window(1)[:7] + (nan,) + window(1)[8:], window(2)]
    kept, counts = ops.complete_split(frame(spark, data))
    c = counts.first()
    assert kept.count() == 1 and (c.rows, c.kept, c.incomplete, c.missing_u10, c.missing_v100) == (3, 1, 2, 1, 1)


def test_suppression_needs_runs_and_vehicles(spark):
    data = [window(i, stratum="thin", vehicle=f"v{i % 3}", run=f"t{i}") for i in range(25)] + [window(i, stratum="thick", vehicle=f"w{i % 12}", run=f"k{i}") for i in range(25)]
    out = {r.stratum: r for r in ops.suppressed_split(frame(spark, data), ["stratum"]).collect()}
    assert not out["thin"].published and (out["thin"].n_runs, out["thin"].n_vehicles) == (25, 3) and out["thick"].published


def test_verdict_moves_with_the_tolerance(spark):
    data = [window(i, cu=0.2, distance=5) for i in range(30)] + [window(100 + i, cu=8, distance=25) for i in range(30)]
    out = {r.cap_km: r for r in ops.tolerance_sensitivity(levels(spark, data), 3.0).collect()}
    assert out[10.0].useful and out[10.0].n_windows == 30 and out[30.0].useful is False and out[30.0].n_windows == 60
    few = [window(i, distance=5) for i in range(4)] + [window(100 + i, distance=25) for i in range(40)]
    thin = {r.cap_km: r for r in ops.tolerance_sensitivity(levels(spark, few), 3.0).collect()}[10.0]
    assert not thin.published and thin.n_runs == 4 and thin.useful is None


def quantile(values, weights, q):
    """Plotting positions by hand."""
    pairs = sorted(zip(values, weights, strict=True))
    total, before, points = sum(weights), 0.0, []
    for v, w in pairs:
        points.append(((before + w / 2) / total, v))
        before += w
    if q <= points[0][0]:
        return points[0][1]
    for (c, v), (c2, v2) in zip(points, points[1:], strict=False):
        if c <= q < c2:
            return v + (v2 - v) * (q - c) / (c2 - c)
    return points[-1][1]


def test_weighted_quantiles(spark):
    values = [0.4, 1.1, 2.2, 3.9, 5.0, 7.7, 9.1, 11.4]
    for weights in ([1.0] * 8, [40.0] + [1.0] * 7, [0.5, 3.0, 1.0, 2.0, 0.1, 7.0, 1.0, 4.0]):
        df = spark.createDataFrame([("g", i, v, w) for i, (v, w) in enumerate(zip(values, weights, strict=True))], "g string, i int, v double, w double")
        out = ranking.weighted_quantiles(df, ["g"], "v", "w", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}).first()
        for name, q in (("a", 0.0), ("b", 0.5), ("c", 0.9), ("d", 1.0)):
            assert out[name] == pytest.approx(quantile(values, weights, q))
    assert ranking.linear_quantiles(df, ["g"], "v", {"p": 0.9}).first().p == pytest.approx(9.79)


def test_ranks_with_ties_nulls_and_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 2.0), (None, 3, 1.0), ("g", 4, None), ("g", 5, float("nan")), ("g", 6, 3.0)], "g string, i int, v double")
    out = {r.i: (r["rank"], r.group_n) for r in ranking.ranked(df, ["g"], "v", ["i"]).collect()}
    assert out == {3: (1, 3), 1: (2, 3), 2: (3, 3), 6: (1, 1)}
    assert ranking.nearest_rank(df, ["g"], "v", {"m": 0.5}).filter("g is null").first().m == 2.0


def test_bootstrap_draws_runs_not_windows(spark):
    data = [window(0, cu=0, run="one")] + [window(i, cu=10, run="many") for i in range(1, 100)]
    base = levels(spark, data)
    runs = bootstrap.numbered_runs(base)
    r = bootstrap.bias_interval(base, bootstrap.draws(runs, 200, 7), ["du"], ["level"]).first()
    assert r.low < 1 and r.high == pytest.approx(10)
    q = bootstrap.quantile_interval(base, bootstrap.draws(runs, 20, 7), "magnitude", 0.975, ["level"]).first()
    assert 0 <= q.low <= q.high <= 10


def test_artifacts_hold_the_intervals_of_their_bootstrap(spark):
    import os

    from accordance.plans import registry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the given tables are not here")
    out = registry.queries()["validation_artifacts"](spark, "/root/testdata/sf0.001").select("statistics", "bootstrap").collect()
    assert out and all(r.bootstrap.n_resamples == 2000 for r in out)
    for r in out:
        low, high = r.bootstrap.p97_5_ci
        assert low < r.statistics.vector_difference_magnitude.p97_5 + 0.2 and high > r.statistics.vector_difference_magnitude.p97_5 - 0.2 and low < high
        assert r.bootstrap.bias_du_ci[0] < r.statistics.u.bias < r.bootstrap.bias_du_ci[1] and len(r.bootstrap.loa_high_dspeed_ci) == 2


def test_one_window_per_run_is_deterministic(spark):
    data = [window(i, run="long") for i in range(20)] + [window(100 + i) for i in range(5)]
    df = frame(spark, data).withColumn("key", F.concat_ws("-", "run_id", "line"))
    first = sorted(sampling.one_per_group(df, "run_id", "key", 3).select("key").collect())
    assert len(first) == 6 and first == sorted(sampling.one_per_group(df.repartition(3), "run_id", "key", 3).select("key").collect())


def sequential(rows, per_stratum):
    taken, used, sizes = [], set(), {}
    for place, log, vehicle, stratum in sorted(rows):
        if sizes.get(stratum, 0) >= per_stratum or (vehicle is not None and vehicle in used):
            continue
        sizes[stratum] = sizes.get(stratum, 0) + 1
        used.add(vehicle)
        taken.append(log)
    return sorted(taken)


@pytest.mark.parametrize("seed", range(4))
def test_sample_equals_the_sequential_rule(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *range(6)]), rng.choice("abc")) for i in range(40)]
    df = spark.createDataFrame(rows, "log_id long, vehicle long, stratum string")
    placed = sampling.shuffled(df, "log_id", seed).collect()
    assert sorted(r.log_id for r in sampling.draw(df, 3, seed).collect()) == sequential([(r.place, r.log_id, r.vehicle, r.stratum) for r in placed], 3)


def test_sigma_and_altitude_bands(spark):
    df = spark.createDataFrame([(0.01, 30.0), (0.64, 80.0), (4.0, 500.0), (None, -2347.0)], "v double, h double")
    out = [tuple(r) for r in df.select(classify.sigma_band(F.col("v"), F.col("v")), classify.altitude_band(F.col("h"))).collect()]
    assert out == [("sigma_lt_0.5", "agl_proxy_lt_50m"), ("sigma_0.5_to_1.0", "agl_proxy_50_to_120m"), ("sigma_ge_1.0", "agl_proxy_ge_120m"), ("unknown", "unknown")]


def test_seasons_turn_in_the_south(spark):
    df = spark.sql("select timestamp'2026-01-15 00:00:00' t, 45.0D n, -30.0D s")
    assert tuple(df.select(classify.season(F.col("t"), F.col("n")), classify.season(F.col("t"), F.col("s"))).first()) == ("DJF", "JJA")


def test_estimator_ratio_by_component(spark):
    data = [window(i, cu=i % 4, cv=i % 4, var=(0.25, 1.0)) for i in range(12)]
    r = ops.estimator_ratio(levels(spark, data), ["level"]).first()
    assert (r.sigma_u, r.sigma_v) == (0.5, 1.0) and r.ratio_u == pytest.approx(2 * r.ratio_v)


def test_broken_artifacts_name_their_path(spark):
    row = ("m", ((0.0, [1.0, 2.0]), None, (1.0, 2.0)), ("window",), (3, 4), (25, 25, 3))
    schema = "validation_model_id string, statistics struct<u:struct<bias:double,limits_of_agreement:array<double>>,v:struct<bias:double,limits_of_agreement:array<double>>,vector_difference_magnitude:struct<p50:double,p97_5:double>>, bootstrap struct<unit:string>, direction struct<n_defined:long,n_undefined:long>, support struct<n_windows:long,n_runs:long,n_vehicles:long>"
    paths = {(r.path, r.rule) for r in contracts.violations(spark.createDataFrame([row], schema), "validation_model_id", contracts.artifact_rules()).collect()}
    assert {("bootstrap.unit", "const"), ("statistics.v", "required"), ("direction", "partition"), ("support.n_vehicles", "minimum")} <= paths


@pytest.mark.parametrize("values", [[float(i % 7) for i in range(200)], [1e9] + [i / 1000 for i in range(300)], [0.0] * 120 + [float(i) for i in range(60)]])
def test_quantiles_by_cells_equal_sorting(spark, values, monkeypatch):
    import random

    monkeypatch.setattr(ranking, "SMALL", 5)
    monkeypatch.setattr(ranking, "CELLS", 8)
    rng = random.Random(3)
    weights = [rng.choice([0.5, 1.0, 4.0]) for _ in values]
    df = spark.createDataFrame([("g", v, w) for v, w in zip(values, weights, strict=True)], "g string, v double, w double")
    by_weight = ranking.weighted_quantiles(df, ["g"], "v", "w", {"a": 0.0, "b": 0.5, "c": 0.975}).first()
    for name, q in (("a", 0.0), ("b", 0.5), ("c", 0.975)):
        assert by_weight[name] == pytest.approx(quantile(values, weights, q))
    ordered, n = sorted(values), len(values)
    assert ranking.nearest_rank(df, ["g"], "v", {"m": 0.5, "top": 1.0}).first()[1:] == (ordered[n // 2], ordered[-1])
    place = 0.9 * (n - 1)
    low = int(place)
    assert ranking.linear_quantiles(df, ["g"], "v", {"p": 0.9}).first().p == pytest.approx(ordered[low] + (ordered[min(low + 1, n - 1)] - ordered[low]) * (place - low))
    assert ranking.around(df, ["g"], "v", [0.5], large=10).count() <= n


def test_schema_rules(spark):
    schema = {"required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"enum": ["x", "y"]}, "c": {"const": "run"}, "d": {"minItems": 1, "maxItems": 2}}}
    df = spark.createDataFrame([(1, "1", "x", "run", ["p"], None), (2, None, None, None, None, None), (3, "q", "z", "window", [], "more"), (4, "0", "y", "run", ["p", "q", "r"], None)], "key int, a string, b string, c string, d array<string>, e string")
    out = sorted((r.key, r.path, r.rule) for r in contracts.violations(df, "key", contracts.schema_rules(schema, ["a", "b", "c", "d", "e"])).collect())
    assert out == [(2, "a", "required"), (3, "a", "type"), (3, "b", "enum"), (3, "c", "const"), (3, "d", "minItems"), (3, "e", "additional"), (4, "a", "minimum"), (4, "d", "maxItems")]


def test_points_outside_of_a_plot(spark):
    data = [window(i, cu=1.0 if i % 2 else -1.0) for i in range(400)] + [window(1000, cu=90.0)]
    out = {r.level: r for r in ops.outside_frame(levels(spark, data)).collect()}
    assert out["100m"].outside_u == 1 and out["100m"].outside_v == 0 and out["100m"].beyond == 1


def test_a_missing_artifact_fails(spark):
    made = spark.createDataFrame([("season", "JJA", "100m", 3)], "axis string, cell string, level string, n int")
    assert ops.looked_up(made, [("season", "JJA", "100m")]).first().n == 3
    with pytest.raises(Exception, match="no such artifact"):
        ops.looked_up(made, [("season", "DJF", "100m")]).collect()


def test_buckets_of_ranks_are_cut_once(spark):
    df = spark.range(100).withColumn("g", F.lit("a"))
    plan = ranking.ranked(df, ["g"], "id", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan  # approximate cuts of two evaluations may differ


def test_rows_meet_small_tables_that_are_known_to_be_small(spark):
    rows = spark.createDataFrame([("a", "100m", float(i), 1.0, 2.0, 1.0, 0.5, 1.5, 2.5) for i in range(9)], "stratum string, level string, du double, dv double, magnitude double, ctx_u double, onboard_u double, ctx_v double, onboard_v double")
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("frame_size"))
    for out, aggregates in ((ops.with_weights(rows, sizes), 0), (ops.outside_frame(rows), 1)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == aggregates


def test_lines_are_joined_once_and_last(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = bindings.pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        inner = plan.children().head()
        while inner.nodeName() != "Join":
            inner = inner.children().head()
        assert inner.children().head().toString().count("Join") == 0  # one side is the lines alone
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_draws_of_a_quantile_meet_its_rows_once(spark):
    df = spark.createDataFrame([("s", i // 2, "100m", float(i)) for i in range(40)], "stratum string, run_id long, level string, v double")
    drawn = bootstrap.draws(bootstrap.numbered_runs(df), 7, 1)
    assert "Window" not in drawn._jdf.queryExecution().optimizedPlan().toString()  # numbers of runs are written
    out = bootstrap.quantile_interval(df, drawn, "v", 0.5, ["level"])
    m = {(r.b, r.run_id): r.m for r in drawn.collect()}
    medians = []
    for b in range(7):
        v = sorted(float(i) for i in range(40) for _ in range(m.get((b, i // 2), 0)))
        medians.append(float((v[len(v) // 2 - 1] + v[len(v) // 2]) / 2))
    low, high = np.quantile(medians, [0.025, 0.975])
    r = out.first()
    assert abs(r.low - low) < 1e-9 and abs(r.high - high) < 1e-9


def test_large_groups_are_ranked_in_more_buckets(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id < 3900 THEN 'a' ELSE 'b' END AS g", "(id * 7919) % 4000 AS v", "id AS i")
    few, many = ({(r.g, r.i): (r["rank"], r.group_n) for r in ranking.ranked(df, ["g"], "v", ["i"], full=n).collect()} for n in (1 << 30, 10))
    want = {}
    for g, lo, hi in (("a", 0, 3900), ("b", 3900, 4000)):
        for k, i in enumerate(sorted(range(lo, hi), key=lambda i: i * 7919 % 4000)):
            want[g, i] = (k + 1, hi - lo)
    assert few == many == want
