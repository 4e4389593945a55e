"""Resamples by blocks and buckets against plainly repeated rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordance.operators import resample, tables


def made(rng, runs, values=None):
    rows = []
    for run in range(runs):
        stratum, cell = "ab"[run % 2], "xy"[run % 5 == 0]
        for _ in range(int(rng.integers(1, 5))):
            u, v, s = rng.normal(1, 2, 3).tolist()
            size = float(np.hypot(u, v)) if values is None else float(rng.choice(values))
            for level in ("low", "high"):
                rows.append((cell, level, stratum, run, u, v, s, size + (level == "high"), 1.0, 2.0 if stratum == "a" else 0.5))
    return rows


SCHEMA = "cell string, level string, stratum string, run_id long, du double, dv double, dspeed double, magnitude double, one double, design double"


def plain(rows, n, seed, block):
    """Every statistic of every resample, from rows repeated by their runs' draws; one block only."""
    out = {}
    for cell in sorted({r[0] for r in rows}):
        drawn = {}
        for stratum in sorted({r[2] for r in rows if r[0] == cell}):
            runs = sorted({r[3] for r in rows if r[0] == cell and r[2] == stratum})
            for start, m in resample.multiplicities(cell, stratum, 0, [len(runs)], n, seed):
                for b, own in enumerate(m):
                    drawn |= {(start + b, stratum, run): int(k) for run, k in zip(runs, own, strict=True)}
        for level, (i, w), b in itertools.product(("low", "high"), ((0, 8), (1, 9)), range(n)):
            copies = [r for r in rows if r[0] == cell and r[1] == level for _ in range(drawn[b, r[2], r[3]])]
            weight = np.array([r[w] for r in copies])
            stats = {}
            for name, c in (("du", 4), ("dv", 5), ("dspeed", 6)):
                x = np.array([r[c] for r in copies])
                mean = np.average(x, weights=weight)
                sd = np.sqrt(max(0.0, (weight * (x - mean) ** 2).sum()) / (weight.sum() - 1)) if weight.sum() > 1 else 0.0
                stats |= {f"bias_{name}": mean, f"loa_low_{name}": mean - 1.96 * sd, f"loa_high_{name}": mean + 1.96 * sd}
            size = np.array([r[7] for r in copies])
            stats["mean_magnitude"] = np.average(size, weights=weight)
            order = np.lexsort((weight, size))
            ends = np.cumsum(weight[order])
            for q, at in resample.QUANTILES.items():
                stats[q] = float(np.interp(at, (ends - weight[order] / 2) / ends[-1], size[order]))
            out |= {(cell, level, i, k, b): v for k, v in stats.items()}
    return out


@pytest.mark.parametrize(("values", "most"), [(None, 4096), (None, 3), ([1.0, 2.0, 7.0], 4), ([1.0, 2.0, 7.0, 7.5], 4096)])
def test_resamples_equal_repeated_rows(spark, values, most):
    rows = made(np.random.default_rng(1), 60, values)
    df = spark.createDataFrame([*rows, ("x", "low", "a", 3, 1.0, 1.0, 1.0, None, 1.0, 1.0), ("x", "low", "a", 3, 1.0, float("nan"), 1.0, 1.0, 1.0, 1.0)], SCHEMA)
    got = {(r.cell, r.level, r.weighting, r.statistic, r.b): r.value for r in resample.resamples(df, ["cell", "level"], ["cell"], ["one", "design"], 12, 5, most=most).collect()}
    want = plain(rows, 12, 5, 1 << 20)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_blocks_share_one_multinomial_draw():
    sizes, n = [5, 3, 7, 0, 2, 2, 4, 1], 4000
    nodes = [[sum(sizes[i * (8 >> level) : (i + 1) * (8 >> level)]) for i in range(1 << level)] for level in range(4)]
    draws = np.array([resample.leaf_draws("k", "s", b, [nodes[level][b >> (3 - level)] for level in range(4)], n, 1) for b in range(8) if sizes[b]])
    assert (draws.sum(0) == sum(sizes)).all()  # every resample draws as many runs as there are
    share = np.array([s for s in sizes if s]) / sum(sizes)
    assert np.allclose(draws.mean(1), share * sum(sizes), atol=0.15)
    assert np.allclose(draws.var(1), share * (1 - share) * sum(sizes), rtol=0.12)
    (start, m), *_ = resample.multiplicities("k", "s", 2, [24, 15, 7, 7], n, 1)
    assert start == 0 and (m.sum(1) == draws[2][: len(m)]).all()


def test_many_blocks_give_the_intervals_of_one(spark):
    rows = made(np.random.default_rng(3), 400)
    df = spark.createDataFrame(rows, SCHEMA)
    ends = [{(r.cell, r.level, r.weighting, r.statistic): (r.low, r.high) for r in resample.intervals(df, ["cell", "level"], ["cell"], ["one", "design"], 800, 7, block=size).collect()} for size in (1 << 14, 16)]
    assert ends[0].keys() == ends[1].keys() and len(ends[0]) == 2 * 2 * 2 * len(resample.STATISTICS)
    for k, (low, high) in ends[0].items():
        assert abs(low - ends[1][k][0]) < 0.25 * (high - low) and abs(high - ends[1][k][1]) < 0.25 * (high - low)


def test_runs_are_drawn_whole(spark):
    """One window at 0, and 99 at 10 in one run: the interval spans from near 0 to 10."""
    rows = [("x", "low", "s", 0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)] + [("x", "low", "s", 1, 10.0, 10.0, 10.0, 10.0, 1.0, 1.0)] * 99
    out = {r.statistic: r for r in resample.intervals(spark.createDataFrame(rows, SCHEMA), ["cell", "level"], ["cell"], ["one"], 400).collect()}
    assert out["bias_du"].low < 1 and out["bias_du"].high == pytest.approx(10) and out["p95"].low == 0 and out["p95"].high == 10


def test_no_rows_and_null_keys(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert resample.intervals(df, ["cell", "level"], ["cell"], ["one"], 20).count() == 0
    rows = made(np.random.default_rng(4), 20)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit(None).cast("string"))
    assert resample.intervals(df, ["cell", "level"], ["cell"], ["one"], 20).count() == 2 * len(resample.STATISTICS)


def test_tables_between_are_small(spark, tmp_path, monkeypatch):
    """Rows are not written again for each group that they are in, only those near a quantile with their draws: few of many."""
    runs = 60_000
    rows = spark.range(4 * runs).select((F.col("id") % 3).alias("cell"), F.lit("low").alias("level"), (F.col("id") % 2).cast("string").alias("stratum"), (F.col("id") % runs).alias("run_id"), *[F.rand(i).alias(c) for i, c in enumerate(("du", "dv", "dspeed"))], F.exp(F.randn(9)).alias("magnitude"), F.lit(1.0).alias("one"))
    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(tmp_path))
    assert resample.intervals(rows, ["cell", "level"], ["cell"], ["one"], 40).count() == 3 * len(resample.STATISTICS)
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 20 * 4 * runs


def test_a_quantile_beyond_its_window_is_sought_in_a_wider_one(spark, monkeypatch):
    """A few runs hold most rows, and all rows of a run are equal: a resample's quantile is anywhere."""
    rng, rows = np.random.default_rng(8), []
    for run in range(300):
        size = float(rng.normal()) - run % 7
        for level in ("low", "high"):
            rows += [("x", level, "a", run, 0.0, 0.0, 0.0, size, 1.0, 1.0)] * (400 if run < 9 else 1)
    passes, made = [], resample._Draws.drawn
    monkeypatch.setattr(resample._Draws, "drawn", lambda *a: passes.append(1) or made(*a))
    monkeypatch.setattr(resample, "REACH", 0.5)
    got = {(r.cell, r.level, r.weighting, r.statistic, r.b): r.value for r in resample.resamples(spark.createDataFrame(rows, SCHEMA), ["cell", "level"], ["cell"], ["one", "design"], 40, 2, most=50).collect()}
    want = plain(rows, 40, 2, 1 << 20)
    assert len(passes) > 1 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
