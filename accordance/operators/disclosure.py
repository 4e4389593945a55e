"""Guards against differencing: a suppressed cell must not follow from what is published.

Every axis divides the same rows into cells, and the total is published too. Whoever knows the
total and all cells of an axis but one can subtract; cells of overlapping axes can be added and
subtracted as well, and two releases of one cell differ by the rows that came between. So:

1. Cells under the floor are suppressed (``primary``).
2. Where what an axis hides together is under the floor, or is one cell, its smallest published
   cell is hidden as well (``complement``): what can then be had by subtraction holds a publishable
   cell whole.
3. Over all axes at once, a hidden cell is derivable if its rows are a sum and difference of
   published cells, that is, if its indicator over the atoms (rows that agree on all axes) lies in the span of
   the published indicators. As long as there is such a cell, another one of its axis is hidden.

Counting is Spark's. The cells, and the atoms that occur, come to the driver: their number depends
on the axes, not on the rows, and is refused beyond ``ATOMS``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.operators.agreement import MIN_RUNS, MIN_VEHICLES, cell_number, masked_counts

ATOMS = 20_000
COUNTED = "axis string, cell string, n_windows long, n_runs long, n_vehicles long, state string"


def on_axes(rows: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Each row once for every axis: (axis, cell); null cells are ``unknown``."""
    entry = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.coalesce(v.cast("string"), F.lit("unknown")).alias("cell")) for k, v in axes.items()]))
    return rows.withColumn("_a", entry).select("*", "_a.axis", "_a.cell").drop("_a")


def derivable(published: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """Which rows of ``hidden`` are linear combinations of the rows of ``published``; columns are atoms."""
    if not len(hidden):
        return np.zeros(0, bool)
    u, s, _ = np.linalg.svd(published.T, full_matrices=False)
    base = u[:, s > 1e-9 * max(s.max(initial=0.0), 1.0)]
    left = hidden.T - base @ (base.T @ hidden.T)
    return np.abs(left).max(0) < 1e-7


def guarded(rows: DataFrame, axes: dict[str, Column], min_runs: int = MIN_RUNS, min_vehicles: int = MIN_VEHICLES, atoms: int = ATOMS) -> DataFrame:
    """(axis, cell, n_windows, n_runs, n_vehicles, state): published, primary or complement; ``rows`` has run_id and vehicle."""
    spark, names = rows.sparkSession, list(axes)
    xs = [f"_x{i}" for i in range(len(names))]
    placed = rows.select("run_id", "vehicle", *[F.coalesce(v.cast("string"), F.lit("unknown")).alias(x) for x, v in zip(xs, axes.values(), strict=True)])
    combos = placed.groupBy(*xs).agg(F.count(F.lit(1)).alias("n")).limit(atoms + 1).collect()
    windows: dict[tuple[str, str], int] = {}
    for row in combos:
        for axis, x in zip(names, xs, strict=True):
            windows[axis, row[x]] = windows.get((axis, row[x]), 0) + row["n"]
    if max(len(windows), len(combos)) > atoms:
        raise ValueError(f"more than {atoms} cells or atoms: fewer or coarser axes are needed")
    place = {k: i for i, k in enumerate(windows)}

    def counted(numbers: dict[tuple[str, str], int], n: int) -> dict[int, tuple[int, int]]:
        """Runs and vehicles of cells, or of unions of an axis' cells, by their number."""
        each = placed.select("run_id", "vehicle", *[cell_number(F.col(x), {c: i for (a, c), i in numbers.items() if a == axis}).alias(x) for axis, x in zip(names, xs, strict=True)])
        return {r["_c"]: (r["n_runs"], r["n_vehicles"]) for r in masked_counts(each, [F.col(x) for x in xs], n).collect()}

    sizes = counted(place, len(place))
    found = [{"axis": k[0], "cell": k[1], "n_windows": n, "n_runs": sizes[place[k]][0], "n_vehicles": sizes[place[k]][1]} for k, n in windows.items()]
    for r in found:
        r["ok"] = r["n_runs"] >= min_runs and r["n_vehicles"] >= min_vehicles
    state = {(r["axis"], r["cell"]): "published" if r["ok"] else "primary" for r in found}
    order = sorted(found, key=lambda r: (r["n_runs"], r["cell"]))

    def hide(axis: str) -> bool:
        """The smallest published cell of an axis; whether there was one."""
        small = next(((r["axis"], r["cell"]) for r in order if r["axis"] == axis and state[r["axis"], r["cell"]] == "published"), None)
        if small:
            state[small] = "complement"
        return small is not None

    # what each axis hides, as one cell: its runs and vehicles are counted, not added up
    hidden = {k: names.index(k[0]) for k, s in state.items() if s == "primary"}
    unions = counted(hidden, len(names)) if hidden else {}
    for i in sorted(set(hidden.values())):
        axis, (runs, vehicles) = names[i], unions[i]
        alone = sum(a == axis and s == "primary" for (a, _), s in state.items()) == 1
        if alone or runs < min_runs or vehicles < min_vehicles:
            hide(axis)
    inside = {k: np.array([row[names.index(k[0])] == k[1] for row in combos], float) for k in state}
    while True:
        shown = np.array([np.ones(len(combos)), *[inside[k] for k, s in state.items() if s == "published"]])
        kept = [k for k, s in state.items() if s != "published"]
        open_cells = [k for k, d in zip(kept, derivable(shown, np.array([inside[k] for k in kept]).reshape(len(kept), len(combos))), strict=True) if d and state[k] == "primary"]
        if not open_cells or not any([hide(axis) for axis in dict.fromkeys(a for a, _ in open_cells)] or [False]) and not any([hide(axis) for axis in names]):
            break
    return spark.createDataFrame([(*k, r["n_windows"], r["n_runs"], r["n_vehicles"], state[k]) for r in found for k in [(r["axis"], r["cell"])]], COUNTED)


def release_gaps(before: DataFrame, after: DataFrame, axes: dict[str, Column], min_runs: int = MIN_RUNS) -> DataFrame:
    """(axis, cell, added, removed, open): runs by which two releases of a cell differ; ``open`` where some do but fewer than ``min_runs``, so that the releases' difference tells of few."""
    runs = lambda df: on_axes(df, axes).select("axis", "cell", "run_id").distinct()
    one, two = runs(before).withColumn("_old", F.lit(1)), runs(after).withColumn("_new", F.lit(1))
    both = one.join(two, ["axis", "cell", "run_id"], "full")
    out = both.groupBy("axis", "cell").agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_new").isNull()).alias("removed"))
    changed = F.col("added") + F.col("removed")
    return out.withColumn("open", (changed > 0) & (changed < min_runs))
