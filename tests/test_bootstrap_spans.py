"""Bias intervals by packed draws against draws as rows."""

import math

import numpy as np
import pytest

from accordance.operators import bootstrap
from accordance.plans import agreement_queries
from conftest import SMALL


def test_packed_draws_give_the_intervals_of_rows(spark, monkeypatch):
    """More resamples than are drawn abreast, several spans, tasks that give out early, runs without values, an infinite sum, null strata and runs."""
    for name, value in (("SPAN", 3), ("ABREAST", 7), ("HELD", 100)):
        monkeypatch.setattr(bootstrap, name, value)
    rng, rows = np.random.default_rng(6), []
    for run in range(70):
        for _ in range(int(rng.integers(1, 4))):
            for level in ("low", "high"):
                rows.append((level, "abc"[run % 3], run, float(rng.normal()), None if run % 9 == 0 else float(rng.normal()), math.inf if run == 5 else 1.0))
    rows += [("low", None, 80, 1.0, 1.0, 1.0), ("low", "a", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "level string, stratum string, run_id long, x double, y double, z double")
    runs = bootstrap.numbered_runs(df.filter("stratum IS NOT NULL AND run_id IS NOT NULL"))
    want = {(r.level, r.statistic): (r.low, r.high) for r in bootstrap.bias_interval(df, bootstrap.draws(runs, 24, 4), ["x", "y", "z"], ["level"]).collect()}
    got = {(r.level, r.statistic): (r.low, r.high) for r in bootstrap.bias_intervals(df, 24, 4, ["x", "y", "z"], ["level"]).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, nan_ok=True) for k in want)


def test_bias_intervals_make_no_row_of_a_draw(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a row for each draw")

    monkeypatch.setattr(bootstrap, "draws", refused)
    assert agreement_queries.bootstrap_bias_ci(spark, SMALL).count() == 6
