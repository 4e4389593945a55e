"""Ranks and quantiles within groups of any size.

Ranks of all rows: a group is cut at approximate quantiles of its values into buckets, more of them
the larger it is; counts and weights of buckets are running-summed (a few rows a group), and rows are
numbered within their bucket. So the rows of one large group are ranked by many tasks, of so many rows
each, and ranks are exact.

Quantiles need no sort of all rows: a first read counts rows and weights in cells, of a width
in proportion to the values, whose running sums tell in which cells the asked quantiles lie. A
second read looks at the values of these cells alone, equal values as one. A cell with too many rows
is cut again into equal parts, until it is small or holds a single value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.operators.tables import written

#: Buckets of a group at least and at most, and rows of a bucket and of a task from which there are more of them.
BUCKETS, MANY, FULL, TASK = 32, 1024, 50_000, 500_000
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Cells of an octave; cells of a span, rows up to which a group or a cell isn't cut, and levels of cutting at most.
OCTAVE, CELLS, SMALL, LARGE, LEVELS = 256, 512, 1000, 1_000_000, 12


def _on(left: DataFrame, right: DataFrame, names: Sequence[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the null-safe condition."""
    right = right.withColumnsRenamed({n: f"_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition &= left[n].eqNullSafe(right[f"_{n}"]) if left.schema[n].nullable else left[n] == right[f"_{n}"]
    return right, condition


def ranked(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str] = (), weight: str | None = None, buckets: int = BUCKETS, large: int = LARGE, full: int = FULL) -> DataFrame:
    """``df`` with rank (from 1), group_n, and, if weighted, weight_before and group_weight.

    Rows are ordered by value and then by ``ties``, which should make the order total. A value
    of more than ``large`` rows has a bucket of its own, whose rows are ranked by the first of ``ties`` in
    the same way; so one value is numbered by many tasks as long as ties that are numbers tell its rows apart.
    Null values are left out, as are values that aren't numbers.
    """
    by = list(by) or ["_all"]
    df = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if by == ["_all"]:
        df = df.withColumn("_all", F.lit(1))
    many = max(MANY // buckets, 1) * buckets
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / many for i in range(1, many)], 4 * many).alias("_cuts"), F.count(F.lit(1)).alias("_size"))
    each = F.greatest(F.lit(1), F.least(F.lit(many // buckets), F.floor(F.lit(float(full) * many) / F.col("_size")))).cast("int")  # every so manyth cut
    cuts = cuts.select(*by, F.filter("_cuts", lambda _, i: (i + 1) % each == 0).alias("_cuts"), "_size")
    cuts = written(cuts, "cuts")  # approximate, so that a second evaluation may cut elsewhere; all that follows needs the same
    tasks = (cuts.agg(F.sum("_size")).first()[0] or 0) // TASK
    cuts = cuts.drop("_size")
    right, condition = _on(df, cuts, by)
    d = df.join(right, condition).drop(*[f"_{n}" for n in by])
    # how many cuts lie below the value, by bisection
    step = lambda at, width: F.when((at + width <= F.size("_cuts")) & (F.get("_cuts", at + width - 1) < F.col(value)), at + width).otherwise(at)
    d = d.withColumn("_bucket", F.aggregate(F.array(*[F.lit(1 << b) for b in range(many.bit_length() - 1, -1, -1)]), F.lit(0), step))
    own = F.coalesce(F.get("_cuts", "_bucket") == F.col(value), F.lit(False)).cast("int")  # a value that is a cut has a bucket of its own
    d = d.withColumn("_bucket", F.col("_bucket") * 2 + own).drop("_cuts")
    mass = F.col(weight) if weight else F.lit(1)
    sums = d.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum(mass).alias("_w"), (F.min(value) == F.max(value)).alias("_one"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"), F.sum("_n").over(whole).alias("group_n"), F.sum("_w").over(whole).alias("group_weight"), (F.col("_one") & (F.col("_n") > large)).alias("_hot"))
    splits = bool(ties) and dict(df.dtypes)[ties[0]] in _NUMBERS
    if splits:
        sums = written(sums, "buckets")
        splits = not sums.filter("_hot").isEmpty()
    if splits:  # a few buckets
        hot, condition = _on(d, sums.filter("_hot").select(*by, "_bucket"), [*by, "_bucket"])
        own = f"_in{len(by)}"  # the bucket is a key of the inner ranks
        inner = ranked(d.join(hot, condition, "left_semi").withColumnRenamed("_bucket", own), [*by, own], ties[0], ties[1:], weight, buckets, large, full)
        inner = inner.withColumnsRenamed({"rank": "_rn", own: "_bucket"}).drop("group_n", "group_weight")
        inner = inner.withColumnRenamed("weight_before", "_wr") if weight else inner
        hot, condition = _on(d, sums.filter("_hot").select(*by, "_bucket"), [*by, "_bucket"])
        d, rest = d.join(hot, condition, "left_anti"), inner
    sums = sums.drop("_hot")
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        d = d.repartition(tasks, *by, "_bucket")
    inside = Window.partitionBy(*by, "_bucket").orderBy(value, *ties)
    d = d.withColumn("_rn", F.row_number().over(inside))
    if weight:
        d = d.withColumn("_wr", F.sum(mass).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
    if splits:
        d = d.unionByName(rest)
    right, condition = _on(d, sums, [*by, "_bucket"])
    d = d.join(right, condition)
    d = d.withColumn("rank", F.col("_rn") + F.col("_n0"))
    if weight:
        d = d.withColumn("weight_before", F.col("_wr") + F.col("_w0"))
    else:
        d = d.drop("group_weight")
    return d.drop("_bucket", "_rn", "_wr", "_n0", "_w0", "_all", "__all", *[f"_{n}" for n in [*by, "_bucket"]])


def octave_cell(x: Column) -> Column:
    """Numbers in order as cells in order: each octave of magnitude is cut into ``OCTAVE`` equal cells. No look at the data is needed to place them.

    A logarithm that is rounded across a power of two is made good by the part within the octave.
    """
    size = F.abs(x)
    octave = F.floor(F.log2(size))
    inside = F.floor(size / F.pow(F.lit(2.0), octave) * OCTAVE) - OCTAVE
    place = F.when(size == float("inf"), F.lit(4000 * OCTAVE)).otherwise((octave + 1100) * OCTAVE + inside)
    return F.when(size > 0, F.signum(x) * place).otherwise(0).cast("int")


def around(df: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], weight: str | None = None, large: int = LARGE, cell: str | None = None) -> DataFrame:
    """The distinct values near the asked quantiles of each group, exact and in their place.

    ``by``, v, n and w (rows and weight of the value), w_min, w_max (of its rows), n0 and w0
    (rows and weight before it), group_n, group_w. All values are there whose rows lie within
    two rows' weights of a quantile's place. Nulls and values that aren't numbers are left out.
    ``cell`` names a column that holds the values' ``octave_cell`` already.
    """
    by = list(by)
    mass = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    x = F.col("_v").cast("double")
    at = F.coalesce(F.col(cell) if cell else octave_cell(F.col(value).cast("double")), F.lit(0))  # never null, so that joins needn't be null-safe
    rows, keys, whole = base.select(*by, F.col(value).alias("_v"), mass.alias("_w"), at.alias("_cell0")), [*by, "_cell0"], Window.partitionBy(*by)
    before = whole.orderBy("_cell0").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_cw"), F.max("_w").alias("_cm"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    sums = sums.select(*keys, "_lo", "_hi", "_n", "_cw", F.sum("_n").over(whole).alias("group_n"), F.sum("_cw").over(whole).alias("group_w"), F.max("_cm").over(whole).alias("_most"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_cw").over(before), F.lit(0.0)).alias("_w0"))
    near = F.lit(False)
    for q in quantiles:
        place, reach = F.col("group_w") * F.lit(float(q)), F.col("_most") * 2
        near |= (F.col("_w0") <= place + reach) & (F.col("_w0") + F.col("_cw") >= place - reach)
    spans = written(sums.filter(near).drop("_cw"), "spans")
    for level in range(1, LEVELS):
        if spans.filter((F.col("_n") > large) & (F.col("_hi") > F.col("_lo"))).isEmpty():
            break
        cell = F.when((F.col("_n") <= SMALL) | (F.col("_hi") <= F.col("_lo")), 0).otherwise(F.least(F.lit(CELLS - 1), F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CELLS))).cast("int")
        right, condition = _on(rows, spans.select(*keys, "_lo", "_hi", "_n"), keys)
        rows = rows.join(right, condition).withColumn(f"_cell{level}", cell).select(*keys, f"_cell{level}", "_v", "_w")
        sums = rows.groupBy(*keys, f"_cell{level}").agg(F.count(F.lit(1)).alias("_cn"), F.sum("_w").alias("_cw"), F.min(x).alias("_clo"), F.max(x).alias("_chi"))
        right, condition = _on(sums, spans.select(*keys, "_n0", "_w0", "group_n", "group_w", "_most"), keys)
        before = Window.partitionBy(*keys).orderBy(f"_cell{level}").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.join(right, condition).select(*keys, f"_cell{level}", F.col("_clo").alias("_lo"), F.col("_chi").alias("_hi"), F.col("_cn").alias("_n"), "group_n", "group_w", "_most", "_cw", (F.coalesce(F.sum("_cn").over(before), F.lit(0)) + F.col("_n0")).alias("_n0"), (F.coalesce(F.sum("_cw").over(before), F.lit(0.0)) + F.col("_w0")).alias("_w0"))
        keys = [*keys, f"_cell{level}"]
        spans = written(sums.filter(near).select(*keys, "_lo", "_hi", "_n", "group_n", "group_w", "_most", "_n0", "_w0"), "spans")
    right, condition = _on(rows, spans.select(*keys, "_n0", "_w0", "group_n", "group_w"), keys)
    values = rows.join(right, condition).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.min("_w").alias("w_min"), F.max("_w").alias("w_max"), *[F.first(c).alias(c) for c in ("_n0", "_w0", "group_n", "group_w")])
    before = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return values.select(*by, F.col("_v").alias("v"), "n", "w", "w_min", "w_max", (F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("_n0")).alias("n0"), (F.coalesce(F.sum("w").over(before), F.lit(0.0)) + F.col("_w0")).alias("w0"), "group_n", "group_w")


def weighted_quantiles(df: DataFrame, by: Sequence[str], value: str, weight: str, quantiles: dict[str, float], copies: bool = False, cell: str | None = None) -> DataFrame:
    """Quantiles at the plotting positions (weight before + half the own weight) / all weight, linear between, clamped at the ends.

    Rows of one value stand in the order of their weights, so that its first and last places
    follow from its least and greatest weight. ``copies``: a row stands for as many rows of weight one.
    """
    r = around(df, by, value, list(quantiles.values()), weight, cell=cell)
    least, most = (F.lit(1.0), F.lit(1.0)) if copies else (F.col("w_min"), F.col("w_max"))
    first, last = (F.col("w0") + least * 0.5) / F.col("group_w"), (F.col("w0") + F.col("w") - most * 0.5) / F.col("group_w")
    v = F.col("v").cast("double")
    aggregates = []
    for name, q in quantiles.items():
        inside = (first <= q) & (last > q)  # both neighbours have this value
        aggregates += [F.max(F.when(last <= q, F.struct(last.alias("c"), v.alias("v")))).alias(f"_lo_{name}"), F.min(F.when(first > q, F.struct(first.alias("c"), v.alias("v")))).alias(f"_hi_{name}"), F.max(F.when(inside, v)).alias(f"_at_{name}")]
    out = r.groupBy(*by).agg(*aggregates)
    for name, q in quantiles.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        between = lo["v"] + (hi["v"] - lo["v"]) * (F.lit(q) - lo["c"]) / (hi["c"] - lo["c"])
        out = out.withColumn(name, F.coalesce(f"_at_{name}", F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(between)))
    return out.select(*by, *quantiles)


def _at(place, value=None):
    """The value at a place counted from 1."""
    return F.max(F.when((F.col("n0") < place) & (place <= F.col("n0") + F.col("n")), F.col("v") if value is None else value))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The element at place floor(q * n) counted from 0 (the upper median at one half), at most the last."""
    r = around(df, by, value, list(quantiles.values()))
    place = lambda q: F.least(F.floor(F.col("group_n") * F.lit(q)), F.col("group_n") - 1) + 1
    return r.groupBy(*by).agg(*[_at(place(q)).alias(name) for name, q in quantiles.items()])


def linear_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation at place q * (n - 1) (type 7)."""
    r = around(df, by, value, list(quantiles.values()))
    v = F.col("v").cast("double")
    out = r.groupBy(*by).agg(F.max("group_n").alias("_n"), *[_at(f((F.col("group_n") - 1) * F.lit(q)) + 1, v).alias(f"_{side}_{name}") for name, q in quantiles.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    for name, q in quantiles.items():
        place = (F.col("_n") - 1) * F.lit(q)
        out = out.withColumn(name, F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place - F.floor(place)))
    return out.select(*by, *quantiles)


def ecdf(df: DataFrame, by: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """Each row's rank over its group's size; ties get successive steps."""
    return ranked(df, by, value, ties).withColumn("share", F.col("rank") / F.col("group_n"))
