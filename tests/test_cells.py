"""Cells by atoms and bits against counting and ranking their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordance.operators import agreement as ops
from accordance.operators import ranking
from accordance.plans import agreement_queries, record_queries
from conftest import SMALL


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        run = int(rng.integers(0, 400))
        u = rng.normal(0, 3, 6).tolist()
        rows.append((run if i % 50 else None, run % 37 + (i % 100 == 0), "ab"[run % 2], str(run % 150) if i % 70 else None, *u[:5], u[5] if i % 90 else None, 2.0 if run % 2 else 0.5))
    df = spark.createDataFrame(rows, "run_id long, vehicle long, side string, part string, onboard_u double, onboard_v double, u100 double, v100 double, u10 double, v10 double, dw double")
    return df.cache()


@pytest.mark.parametrize("most", [500, 3])
def test_bits_count_what_rows_count(spark, pairs, most):
    """Over 63 cells, ids and cells that are null, runs of two vehicles."""
    cells = pairs.select("side").distinct().union(pairs.select("part").distinct()).dropna().collect()
    place = {r[0]: i for i, r in enumerate(cells)}
    numbers = [ops.cell_number(F.col(c), place) for c in ("side", "part")]
    got = {r["_c"]: (r["n_runs"], r["n_vehicles"]) for r in ops.masked_counts(pairs, numbers, len(place), most).collect()}
    tall = pairs.select("run_id", "vehicle", F.explode(F.array("side", "part")).alias("cell")).filter("cell is not null")
    assert len(place) > 63 and got == {place[r["cell"]]: (r["n_runs"], r["n_vehicles"]) for r in ops.distinct_counts(tall, ["cell"]).collect()}


@pytest.mark.parametrize("weight", [None, "dw"])
def test_statistics_of_atoms_are_those_of_rows(spark, pairs, weight):
    by = ["axis", "cell", "level"]
    rows = ops.differences(pairs).withColumn("_a", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("cell")) for a in ("side", "part")]))).select("*", "_a.*").withColumn("one", F.lit(1.0))
    want = ops.suppressed_split(rows, by).filter("published").drop("published")
    want = want.join(ops.bland_altman(rows, by, ("du", "dv"), weight and F.col(weight)), by).join(ranking.weighted_quantiles(rows, by, "magnitude", weight or "one", {"p50": 0.5, "p97_5": 0.975}), by)
    got = ops.cell_statistics(pairs, ["side", "part"], {"all": weight}, ("du", "dv"), {"p50": 0.5, "p97_5": 0.975}).drop("pooling")
    keyed = lambda df: {(r["axis"], r["cell"], r["level"]): r.asDict() for r in df.collect()}
    one, two = keyed(got), keyed(want)
    assert one.keys() == two.keys() and len(one) >= 4
    for k, r in two.items():
        assert one[k] == {c: pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x for c, x in r.items()}


@pytest.mark.parametrize("query", [record_queries.report_lines, agreement_queries.variant_shift])
def test_cells_are_computed_once(spark, monkeypatch, query):
    """Each pass over the pairs is done once, however often a plan reads the cells."""
    passes, made = [], ranking.around
    monkeypatch.setattr(ranking, "around", lambda *a, **k: passes.append(1) or made(*a, **k))
    plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert len(passes) <= 2 and "lineitem" not in plan and "pairs-" not in plan
