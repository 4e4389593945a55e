"""Percentile intervals from resamples of whole runs, without a bound on a group's size.

A resample draws, in each stratum, as many runs as the stratum has, with replacement. Runs are
dealt by a hash into blocks of at most about ``BLOCK`` runs of a cell. How many of a resample's
draws fall into a block follows from halving: at each node of a binary tree over the blocks the
draws of the node are split by a binomial in the ratio of the halves' runs, and the leaf's draws
pick its runs evenly. So a block finds its own runs' multiplicities from its path alone, and all
blocks together are one multinomial draw. Random numbers are seeded by the node, so that the
result depends neither on partitions nor on lost tasks.

1. Runs are counted for each cell, stratum and block: what a path needs.
2. Rows are counted in cells of values, cut again where a quantile is near and they are too large, until the
   places ``REACH`` standard errors around each quantile are known: a window of few rows, as a standard error's rows
   grow with the root of the runs. Windows are cut into buckets of ``ROWS`` rows; a value of more rows is a
   bucket of its own, and what lies between windows is one bucket.
3. Rows are dealt to the blocks once, as they are, and get their cells and kinds there. A block multiplies the multiplicities by the sums of
   its runs: moments, and masses of the buckets. A task adds up its blocks. Of runs with rows in a window the
   multiplicities are kept, a byte for each resample.
4. The masses tell in which one or two buckets each resample's quantile lies, and the rows of these with their multiplicities
   the copies next to its place. Positions are (i - 1/2) / n of repeated rows, by weight, linear between. If a
   quantile lies outside its window, its group is drawn again with one twice as wide.

A task holds a block, a bucket or a group's masses, whatever the group's size; the driver a number of runs for each cell, stratum and block, and
the buckets. In a bucket of one value its least and greatest weight stand for those of its first and last drawn copy.

Weights are those of a sampling design: constant within a stratum (others end the run with an
error). Null values and values that aren't numbers are left out. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import os
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.operators.tables import written

RESAMPLES, SEED, Z = 2000, 20260827, 1.96
BLOCK, ROWS, CHUNK = 16_384, 4096, 200
SIGNED, SIZE = ("du", "dv", "dspeed"), "magnitude"
QUANTILES = {"p95": 0.95, "p97_5": 0.975}
STATISTICS = [f"{s}_{x}" for x in SIGNED for s in ("bias", "loa_low", "loa_high")] + ["mean_magnitude", *QUANTILES]
#: Moments of a run: rows, sums, and squares of what is signed.
MOMENTS = 1 + len(SIGNED) + 1 + len(SIGNED)
#: Half a window's width at first, in standard errors of a quantile of independent runs.
REACH = 4.0
#: Draws that are counted at a time, as many as a core's cache holds.
CACHED = 65_536
#: Bits of a value that a cell leaves open, at each level of cutting: at first an octave has 1,024 cells.
SHIFTS = (42, 32, 20, 0)
#: What a bucket is: between windows, one value of many rows, rows. Cells up to which a run holds its cells as bits. Bytes of sums that a task holds before it gives them out.
WIDE, ONE, ROWWISE = 0, 1, 2
MASKED, HELD = 500, 256_000_000


def _generator(*node: object) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b("|".join(map(str, node)).encode(), digest_size=16).digest())))


def leaf_draws(key: str, stratum: str, block: int, path: Sequence[int], resamples: int, seed: int, kept: dict[int, tuple[int, np.ndarray]] | None = None) -> np.ndarray:
    """How many of each resample's draws fall into a block; ``path`` has the runs of the nodes from the root to it. ``kept`` holds the last block's path, for the next."""
    draws, kept = np.full(resamples, path[0], np.int64), {} if kept is None else kept
    bits = len(path) - 1
    for level in range(bits):
        child = block >> (bits - level - 1)
        if kept.get(level, (-1,))[0] != child:
            left = path[level + 1] if child % 2 == 0 else path[level] - path[level + 1]
            to_left = _generator(seed, key, stratum, level, child >> 1).binomial(draws, left / path[level])
            kept[level] = child, to_left if child % 2 == 0 else draws - to_left
        draws = kept[level][1]
    return draws


def multiplicities(key: str, stratum: str, block: int, path: Sequence[int], resamples: int, seed: int, kept: dict[int, tuple[int, np.ndarray]] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first resample, resamples by runs): how often each run of a block is drawn, some resamples at a time."""
    draws, runs = leaf_draws(key, stratum, block, path, resamples, seed, kept), path[-1]
    for start in range(0, resamples, CHUNK):
        own, pick = draws[start : start + CHUNK], _generator(seed, key, stratum, "leaf", len(path), block, start)
        m = np.empty((len(own), runs), np.int64)
        step = max(1, CACHED // runs)
        for at in range(0, len(own), step):
            some = own[at : at + step]
            picks = pick.integers(0, runs, int(some.sum()))
            if len(some) > 1:
                picks += np.repeat(np.arange(len(some)) * runs, some)
            m[at : at + step] = np.bincount(picks, minlength=len(some) * runs).reshape(len(some), runs)
        yield start, m


def _importable(df: DataFrame) -> None:
    env, root = df.sparkSession.sparkContext.environment, str(Path(__file__).resolve().parents[2])  # so that workers can import this module
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root


def _tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has. Few rows may mean much work here, so that partitions must not be merged by their bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def _dealt(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.repartition(_tasks(df), *key)


def _matched(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """A null-safe join on columns of the same names; the right side's copies go."""
    other = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on &= F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return left.join(other, on, how).drop(*[f"_r_{n}" for n in names])


def _complete() -> Column:
    """Rows with every value."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in (*SIGNED, SIZE)])


def _order(values: np.ndarray) -> np.ndarray:
    """Numbers as integers in the same order: their bits."""
    bits = np.ascontiguousarray(values, np.float64).view(np.int64)
    return np.where(bits < 0, -(bits & np.int64(2**63 - 1)), bits)


def _value(place: int) -> float:
    return float(np.array([place if place >= 0 else -place - 2**63], np.int64).view(np.float64)[0])


def _numbered(runs: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as numbers from 0, in their order, null first."""
    if not runs.null_count and pa.types.is_integer(runs.type):
        return np.unique(runs.to_numpy(), return_inverse=True)[1]
    ids = runs.to_pylist()
    place = {x: i for i, x in enumerate(sorted(set(ids), key=lambda x: (x is not None, x)))}
    return np.array([place[x] for x in ids], np.int64)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


class _Draws:
    """Rows of cells, and what the passes over them share.

    ``narrow`` has stratum, run_id, w0, w1 and so on, and ``cells``: columns with the number of each cell that a row is in, null or
    negative for none. ``expand`` makes of it rows with a kind, numbered from 0, and the values. A group is a cell and a kind, numbered
    cell * kinds + kind; the kinds of a cell share its draws. ``keys`` names the cells.
    """

    def __init__(self, narrow: DataFrame, cells: Sequence[str], expand: Callable[[DataFrame], DataFrame], keys: Sequence[str], kinds: int, weights: int, resamples: int, seed: int, block: int, most: int):
        self.cells, self.keys, self.kinds, self.weights = list(cells), list(keys), kinds, weights
        self.resamples, self.seed, self.most, self.spark = resamples, seed, most, narrow.sparkSession
        ends = [f(f"w{i}").alias(f"{name}{i}") for i in range(weights) for name, f in (("least", F.min), ("top", F.max))]
        strata = sorted(expand(narrow).filter(_complete()).groupBy("stratum").agg(*ends).collect(), key=lambda r: (r["stratum"] is not None, r["stratum"]))
        if any(r[f"least{i}"] != r[f"top{i}"] for r in strata for i in range(weights)):
            raise ValueError("weights must be constant within a stratum")
        self.strata = [r["stratum"] for r in strata]
        self.w = np.array([[r[f"least{i}"] for r in strata] for i in range(weights)], np.float64).reshape(weights, len(strata))
        sids = self.spark.createDataFrame([(s, i) for i, s in enumerate(self.strata)], f"stratum {dict(narrow.dtypes)['stratum']}, sid int")
        hashed = F.shiftrightunsigned(F.xxhash64(F.xxhash64("stratum"), "run_id"), 40)
        self.narrow = _matched(narrow, F.broadcast(sids), ["stratum"]).withColumn("_h", hashed).drop("stratum", *[f"w{i}" for i in range(weights)])
        number = [F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(c) for c in self.cells]
        self.expand = lambda df: expand(df).filter(_complete()).select(*[c for c in ("_block", "_h") if c in df.columns], "sid", "run_id", *number, F.col("kind").cast("int").alias("kind"), *[F.col(c).cast("double").alias(c) for c in (*SIGNED, SIZE)])
        self._count(block)

    def _count(self, block: int) -> None:
        """How many runs of each cell and stratum each block holds. Up to ``MASKED`` cells a run holds its cells as bits, beyond it is a row for each."""
        n, rows = len(self.keys), self.expand(self.narrow)
        if n <= MASKED:
            of = lambda c, i: F.when((c >= 63 * i) & (c < 63 * i + 63), F.call_function("shiftleft", F.lit(1).cast("long"), c - 63 * i)).otherwise(F.lit(0).cast("long"))
            words = [reduce(lambda a, b: a.bitwiseOR(b), [of(F.col(c), i) for c in self.cells]).alias(f"_m{i}") for i in range((n + 62) // 63)]
            ids = written(rows.select("sid", "run_id", "_h", *words).groupBy("sid", "run_id", "_h").agg(*[F.bit_or(f"_m{i}").alias(f"_m{i}") for i in range(len(words))]), "ids")
            held = F.array(*[F.sum(F.shiftright(F.col(f"_m{c // 63}"), c % 63).bitwiseAND(F.lit(1).cast("long"))) for c in range(n)])
            counted = lambda df, by: df.groupBy(*by).agg(held.alias("_n")).select(*by, F.posexplode("_n").alias("cell", "runs")).filter("runs > 0")
        else:
            ids = written(rows.select("sid", "run_id", "_h", F.explode(F.array(*self.cells)).alias("cell")).filter("cell >= 0").distinct(), "ids")
            counted = lambda df, by: df.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("runs"))
        most = counted(ids, ["sid"]).groupBy("cell").agg(F.sum("runs").alias("runs")).agg(F.max("runs")).first()[0] or 0
        self.bits = max(0, math.ceil(math.log2(most / block))) if most else 0
        self.block = F.col("_h").bitwiseAND(F.lit((1 << self.bits) - 1).cast("long")).cast("int")
        self.runs: dict[tuple[int, int], np.ndarray] = {}
        for r in counted(ids.withColumn("_block", self.block), ["sid", "_block"]).collect():  # a number for each cell, stratum and block
            self.runs.setdefault((r["cell"], r["sid"]), np.zeros(1 << self.bits, np.int64))[r["_block"]] = r["runs"]
        size, square, self.top = (np.zeros((self.weights, n)) for _ in range(3))
        for (cell, sid), counts in self.runs.items():
            size[:, cell] += self.w[:, sid] * counts.sum()
            square[:, cell] += self.w[:, sid] ** 2 * counts.sum()
            self.top[:, cell] = np.maximum(self.top[:, cell], self.w[:, sid])
        #: The standard error of a share of one half, of independent runs.
        self.error = np.sqrt(square) / np.maximum(size, 1e-300)

    def counted(self, shift: int, inside: dict[int, np.ndarray]) -> DataFrame:
        """For each group and cell of values (their ``_order`` less its last ``shift`` bits): rows, least and greatest value, weights, and at one cell the sums of the group's values.

        ``inside`` has the groups that are asked for; beyond the first pass, the cells of the pass before that are cut here.
        """
        kinds, weights, w, cells = self.kinds, self.weights, self.w, self.cells
        first, before = shift == SHIFTS[0], SHIFTS[SHIFTS.index(shift) - 1] if shift != SHIFTS[0] else 0
        asked = np.zeros(len(self.keys) * kinds, bool)
        asked[list(inside)] = True
        shared = self.spark.sparkContext.broadcast(inside)
        schema = pa.schema([("gid", pa.int32()), ("cell", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), *[(f"{x}{i}", pa.float64()) for x in ("w", "least", "top") for i in range(weights)], *[(f"c{k}", pa.float64()) for k in range(4)]])

        def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
            columns = [np.concatenate(p) for p in zip(*parts, strict=True)]
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            if not len(order):
                return columns
            at = np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
            by = [None, None, np.add, np.minimum, np.maximum, *[np.add] * weights, *[np.minimum] * weights, *[np.maximum] * weights, *[np.add] * 4]
            return [c[at] if f is None else f.reduceat(c, at) for f, c in zip(by, columns, strict=True)]

        def part(batch: pa.RecordBatch) -> list[np.ndarray]:
            member = np.stack([batch.column(c).to_numpy() for c in cells], 1)
            row, col = np.nonzero(member >= 0)
            gid = member[row, col] * kinds + batch.column("kind").to_numpy()[row]
            kept = asked[gid]
            row, gid = row[kept], gid[kept].astype(np.int32)
            place = _order(batch.column(SIZE).to_numpy())
            if not first:
                kept, parent = np.zeros(len(row), bool), (place >> before)[row]
                for g, own in shared.value.items():
                    of = np.flatnonzero(gid == g)
                    kept[of] = np.isin(parent[of], own)
                row, gid = row[kept], gid[kept]
            mass = w[:, batch.column("sid").to_numpy()[row]]
            place = place[row]
            sums = [np.zeros(len(row)) for _ in range(4)]
            if first and len(row):
                at = np.unique(gid, return_index=True)
                for k, c in enumerate((*SIGNED, SIZE)):
                    sums[k][at[1]] = np.bincount(gid, batch.column(c).to_numpy()[row])[at[0]]
            return merged([[gid, place >> shift, np.ones(len(row), np.int64), place, place, *mass, *mass, *mass, *sums]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, held = [], 0
            for batch in batches:
                parts.append(part(batch))
                held += len(parts[-1][0])
                if held > 2_000_000:
                    parts = [merged(parts)]
                    held = -len(parts[0][0])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(merged(parts), schema.types, strict=True)], schema=schema)

        names = ", ".join([*[f"{x}{i} double" for x in ("w", "least", "top") for i in range(weights)], *[f"c{k} double" for k in range(4)]])
        each = self.expand(self.narrow).mapInArrow(run, f"gid int, cell long, n long, lo long, hi long, {names}")
        sums = [F.sum(c).alias(c) for c in ("n", *[f"w{i}" for i in range(weights)], *[f"c{k}" for k in range(4)])]
        return each.groupBy("gid", "cell").agg(*sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[f(f"{x}{i}").alias(f"{x}{i}") for x, f in (("least", F.min), ("top", F.max)) for i in range(weights)])

    def _near(self, shift: int, known: dict[int, dict | None], reach: float, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
        """Of a group's cells those that are near a quantile, small ones joined."""
        kinds, weights, most, top, error, before_shift = self.kinds, self.weights, self.most, self.top, self.error, SHIFTS[SHIFTS.index(shift) - 1]

        def near(group: pa.Table) -> pa.Table:
            group = group.sort_by("cell")
            g, cell, n, lo, hi = group.column("gid")[0].as_py(), *[group.column(c).to_numpy() for c in ("cell", "n", "lo", "hi")]
            mass, least, most_w = (np.stack([group.column(f"{x}{i}").to_numpy() for i in range(weights)]) for x in ("w", "least", "top"))
            ends, above = np.cumsum(mass, 1), known[g]
            if above is None:
                total, rows, centre = ends[:, -1], n.sum(), [group.column(f"c{k}").to_numpy().sum() / n.sum() for k in range(4)]
                start = ends - mass
            else:  # cells of the pass before: what lies before each is known
                total, rows, centre = above["total"], above["rows"], above["centre"]
                at = _starts(cell >> (before_shift - shift))
                size = np.diff(np.r_[at, len(cell)])
                base = np.stack([above["open"][c] for c in (cell >> (before_shift - shift))[at]], 1)
                start = ends - mass - np.repeat(ends[:, at] - mass[:, at], size, 1) + np.repeat(base, size, 1)
            parent = cell >> (before_shift - shift) if above else np.zeros(len(cell), np.int64)
            kept = np.zeros(len(cell), bool)
            for q in QUANTILES.values():
                for i in range(weights):
                    wide = reach * math.sqrt(q * (1 - q)) * error[i, g // kinds] * total[i] + 2 * top[i, g // kinds]
                    kept |= (start[i] <= q * total[i] + wide) & (start[i] + mass[i] >= q * total[i] - wide)
            out, last = [], -2
            for j in np.flatnonzero(kept):
                large = n[j] > most
                if out and last == j - 1 and parent[last] == parent[j] and not large and out[-1][3] <= most and out[-1][3] + n[j] <= most:  # joined with the cell before it
                    one = out[-1]
                    one[2], one[3], one[5] = (cell[j] + 1) << shift, one[3] + n[j], hi[j]
                else:
                    out.append([g, cell[j] << shift, (cell[j] + 1) << shift, n[j], lo[j], hi[j], *start[:, j], *total, *least[:, j], *most_w[:, j], rows, *centre])
                last = j
            return pa.Table.from_arrays([pa.array([int(x) if pa.types.is_integer(t) else float(x) for x in c], t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

        return near

    def windows(self, gids: Sequence[int], reach: float) -> dict[int, dict]:
        """For each group its cuts, what its buckets are, and the centres of its values.

        A window of ``reach`` standard errors around each quantile under each weighting is cut into buckets of ``most`` rows at most; a value
        of more rows is a bucket of its own. What lies between windows is one bucket.
        """
        weights, most = self.weights, self.most
        found: dict[int, dict] = {}
        inside: dict[int, np.ndarray] = {g: np.zeros(0, np.int64) for g in gids}
        schema = pa.schema([("gid", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), *[(f"{x}{i}", pa.float64()) for x in ("before", "total", "least", "top") for i in range(weights)], ("rows", pa.int64()), *[(f"c{k}", pa.float64()) for k in range(4)]])
        for shift in SHIFTS:
            counts, near = self.counted(shift, inside), self._near(shift, {g: found.get(g) for g in inside}, reach, schema)

            kinds_of = ", ".join([*[f"{x}{i} double" for x in ("before", "total", "least", "top") for i in range(weights)], "rows long", *[f"c{k} double" for k in range(4)]])
            opened: dict[int, list[int]] = {}
            for r in counts.groupBy("gid").applyInArrow(near, f"gid int, start long, stop long, n long, lo long, hi long, {kinds_of}").collect():
                own = found.setdefault(r["gid"], {"total": [r[f"total{i}"] for i in range(weights)], "rows": r["rows"], "centre": [r[f"c{k}"] for k in range(4)], "open": {}, "buckets": []})
                if r["n"] > most and r["lo"] < r["hi"]:  # too coarse
                    own["open"][r["start"] >> shift] = [r[f"before{i}"] for i in range(weights)]
                    opened.setdefault(r["gid"], []).append(r["start"] >> shift)
                else:
                    own["buckets"].append((r["start"], r["stop"], r["n"] <= most, r["lo"], *[(r[f"least{i}"], r[f"top{i}"]) for i in range(weights)]))
            inside = {g: np.array(c, np.int64) for g, c in opened.items()}
            for g in inside:
                found[g]["open"] = {c: found[g]["open"][c] for c in opened[g]}
            if not inside:
                break
        for own in found.values():
            own["cuts"] = np.array(sorted({x for b in own["buckets"] for x in b[:2]}), np.int64)
            own["kind"] = np.full(len(own["cuts"]) + 1, WIDE, np.int8)
            own["ends"] = {}
            for start, _, few, lo, *ends in own["buckets"]:
                at = int(np.searchsorted(own["cuts"], start, "right"))
                own["kind"][at] = ROWWISE if few else ONE
                if not few:
                    own["ends"][at] = (_value(lo), ends)
            del own["buckets"], own["open"]
        return found

    def drawn(self, windows: dict[int, dict]) -> DataFrame:
        """(gid, bucket, sid, v, data). sid -1: over a task's blocks, the moments (bucket -1 - k) or the bucket's mass, of each weighting and resample;
        else a run's values in a bucket of rows, and how often each resample draws it.
        """
        cells, kinds, weights, w, resamples, seed, bits, keys, strata, centres = self.cells, self.kinds, self.weights, self.w, self.resamples, self.seed, self.bits, self.keys, self.strata, np.zeros((len(self.keys) * self.kinds, 4))
        for g, own in windows.items():
            centres[g] = own["centre"]
        asked = np.zeros(len(centres), bool)
        asked[list(windows)] = True
        shared = self.spark.sparkContext.broadcast((self.runs, {g: (own["cuts"], own["kind"]) for g, own in windows.items()}))
        schema = pa.schema([("gid", pa.int32()), ("bucket", pa.int32()), ("sid", pa.int32()), ("v", pa.binary()), ("data", pa.binary())])
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        def of_block(rows: pa.Table, block: int, total: dict[int, np.ndarray], paths: dict) -> Iterator[pa.RecordBatch]:
            runs, cuts = shared.value
            member, kind, sid = np.stack([rows.column(c).to_numpy() for c in cells], 1), rows.column("kind").to_numpy(), rows.column("sid").to_numpy()
            ids, values = _numbered(rows.column("run_id")), np.stack([rows.column(c).to_numpy() for c in (*SIGNED, SIZE)])
            row, col = np.nonzero(member >= 0)
            cell = member[row, col].astype(np.int64)
            both = cell * len(strata) + sid[row]
            order = np.argsort(both, kind="stable")
            row, both = row[order], both[order]
            for begin, end in zip(at := _starts(both), [*at[1:], len(both)], strict=True):
                c, s = divmod(int(both[begin]), len(strata))
                own = row[begin:end]
                inside, idx = np.unique(ids[own], return_inverse=True)
                here = [g for g in range(c * kinds, c * kinds + kinds) if asked[g]]
                if not here:
                    continue
                counts = runs[c, s]
                path = [int(counts[(block >> (bits - level)) << (bits - level) : ((block >> (bits - level)) + 1) << (bits - level)].sum()) for level in range(bits + 1)]
                if path[-1] != len(inside):
                    raise ValueError(f"{len(inside)} runs in a block of {path[-1]}")
                dense, narrow, widths = [], [], []
                for g in here:
                    mine = np.flatnonzero(kind[own] == g % kinds)
                    cut, what = cuts[g]
                    bucket = np.searchsorted(cut, _order(values[3, own[mine]]), "right")
                    off = values[:, own[mine]] - centres[g][:, None]
                    wide = np.flatnonzero(what != ROWWISE)
                    place = np.zeros(len(what), np.int64)
                    place[wide] = np.arange(len(wide))
                    few = what[bucket] == ROWWISE
                    at, made = idx[mine], np.zeros((MOMENTS + len(wide), len(inside)))
                    for k, x in enumerate([None, *off, *(off[:3] ** 2)]):
                        made[k] = np.bincount(at, x, len(inside))
                    made[MOMENTS:] = np.bincount(place[bucket[~few]] * len(inside) + at[~few], minlength=len(wide) * len(inside)).reshape(len(wide), len(inside))
                    dense.append(made)
                    widths.append(wide)
                    for b, i, v in zip(bucket[few].tolist(), at[few].tolist(), values[3, own[mine[few]]].tolist(), strict=True):
                        narrow.append((g, b, i, v))
                    if g not in total:
                        total[g] = np.zeros((weights, MOMENTS + len(what), resamples))
                dense = np.concatenate(dense)
                narrow.sort()
                entries = [(*k, [x[3] for x in vs]) for k, vs in itertools.groupby(narrow, key=lambda x: x[:3])]
                which = np.array([e[2] for e in entries], np.int64)
                first = _starts(np.array([e[0] * 2**32 + e[1] for e in entries], np.int64))
                times = np.array([len(e[3]) for e in entries], np.int64)
                held = np.empty((len(entries), resamples), np.uint8)
                for start, m in multiplicities(keys[c], strata[s], block, path, resamples, seed, paths.setdefault((c, s), {})):
                    stop, base = start + len(m), 0
                    made = dense @ m.T.astype(np.float64)
                    for g, wide in zip(here, widths, strict=True):
                        part = made[base : base + MOMENTS + len(wide)]
                        base += len(part)
                        for i in range(weights):
                            total[g][i, :MOMENTS, start:stop] += w[i, s] * part[:MOMENTS]
                            total[g][i, MOMENTS + wide, start:stop] += w[i, s] * part[MOMENTS:]
                    if entries:
                        mine = m[:, which]
                        if mine.max() > 255:
                            raise OverflowError("a run is drawn more than 255 times")
                        held[:, start:stop] = mine.T
                        for j, one in zip(first, np.add.reduceat(mine * times, first, 1).T, strict=True):
                            for i in range(weights):
                                total[entries[j][0]][i, MOMENTS + entries[j][1], start:stop] += w[i, s] * one
                for begun in range(0, len(entries), 1000):
                    yield batch_of([(g, b, s, np.array(v).tobytes(), m.tobytes()) for (g, b, _, v), m in zip(entries[begun : begun + 1000], held[begun : begun + 1000], strict=True)])

        def flushed(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for g, sums in total.items():
                rows = [(g, -1 - k if k < MOMENTS else k - MOMENTS, -1, b"", np.ascontiguousarray(sums[:, k]).tobytes()) for k in range(sums.shape[1])]
                yield batch_of(rows)
            total.clear()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, paths, block, parts = {}, {}, None, []
            for batch in batches:
                blocks = batch.column("_block").to_numpy()
                for begin, end in zip(at := _starts(blocks), [*at[1:], len(blocks)], strict=True):
                    if blocks[begin] != block and parts:
                        yield from of_block(pa.Table.from_batches(parts), block, total, paths)
                        parts = []
                        if sum(t.nbytes for t in total.values()) > HELD:
                            yield from flushed(total)
                    block = int(blocks[begin])
                    parts.append(batch.slice(begin, end - begin))
            if parts:
                yield from of_block(pa.Table.from_batches(parts), block, total, paths)
            yield from flushed(total)

        tasks = min(1 << self.bits, _tasks(self.narrow))
        narrow = self.narrow.withColumn("_block", self.block)
        dealt = narrow.repartitionById(tasks, F.shiftright(F.col("_block").cast("long") * tasks, self.bits).cast("int")).sortWithinPartitions("_block")  # blocks next to each other: they share most of their path
        return written(self.expand(dealt).drop("_h").mapInArrow(run, "gid int, bucket int, sid int, v binary, data binary"), "draws")

    def summed(self, drawn: DataFrame) -> DataFrame:
        """(gid, bucket, data) over all blocks."""

        def run(group: pa.Table) -> pa.Table:
            made = sum(np.frombuffer(x, np.float64) for x in group.column("data").to_pylist())
            return pa.table({"gid": group.column("gid").slice(0, 1), "bucket": group.column("bucket").slice(0, 1), "data": pa.array([made.tobytes()], pa.binary())})

        return written(drawn.filter("sid < 0").select("gid", "bucket", "data").groupBy("gid", "bucket").applyInArrow(run, "gid int, bucket int, data binary"), "sums")

    def moments(self, sums: DataFrame, windows: dict[int, dict]) -> DataFrame:
        """(gid, weighting, statistic, b, value) of what follows from moments."""
        weights, centres, read = self.weights, {g: own["centre"] for g, own in windows.items()}, _reader(self)
        schema = pa.schema([("gid", pa.int32()), ("weighting", pa.int32()), ("statistic", pa.string()), ("b", pa.int32()), ("value", pa.float64())])

        def run(group: pa.Table) -> pa.Table:
            g, x = read(group, True)
            out = []
            for i in range(weights):
                b = np.flatnonzero(x[0, i] > 0)
                n, columns = x[0, i, b], {}
                for k, c in enumerate(SIGNED):
                    mean = x[k + 1, i, b] / n
                    square = np.maximum(0.0, x[k + 2 + len(SIGNED), i, b] - n * mean * mean)
                    sd = np.where(n > 1, np.sqrt(square / np.where(n > 1, n - 1, 1)), 0.0)
                    columns |= {f"bias_{c}": mean + centres[g][k], f"loa_low_{c}": mean + centres[g][k] - Z * sd, f"loa_high_{c}": mean + centres[g][k] + Z * sd}
                columns["mean_magnitude"] = x[1 + len(SIGNED), i, b] / n + centres[g][3]
                for name, v in columns.items():
                    out.append(pa.Table.from_arrays([pa.array(np.full(len(b), g, np.int32)), pa.array(np.full(len(b), i, np.int32)), pa.array([name] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(v)], schema=schema))
            return pa.concat_tables(out)

        return sums.filter("bucket < 0").groupBy("gid").applyInArrow(run, "gid int, weighting int, statistic string, b int, value double")

    def needed(self, sums: DataFrame, windows: dict[int, dict]) -> DataFrame:
        """(gid, weighting, q, b, bucket, kind, before, target, lo_c, lo_v, hi_c, hi_v): the buckets next to each resample's quantiles; the copies beside the quantile in a bucket of one value."""
        weights, top, kinds, read = self.weights, self.top, self.kinds, _reader(self)
        shared = self.spark.sparkContext.broadcast({g: (own["kind"], own["ends"]) for g, own in windows.items()})
        ints, doubles = ("gid", "weighting", "b", "bucket", "kind"), ("before", "target", "lo_c", "lo_v", "hi_c", "hi_v")
        schema = pa.schema([*[(c, pa.int32()) for c in ints], ("q", pa.string()), *[(c, pa.float64()) for c in doubles]])

        def run(group: pa.Table) -> pa.Table:
            g, x = read(group, False)
            kind, ends = shared.value[g]
            out = []
            for i in range(weights):
                mass = x[:, i].T
                after = np.cumsum(mass, 1)
                for name, q in QUANTILES.items():
                    target, most = q * after[:, -1:], top[i, g // kinds]
                    b, bucket = np.nonzero((mass > 0) & (after - mass <= target + most) & (after >= target - most))
                    found, t = np.full((len(b), 4), np.nan), target[b, 0]
                    start = (after - mass)[b, bucket]
                    for at, (v, pairs) in ends.items():  # the first and last copies of one value
                        own = np.flatnonzero(bucket == at)
                        first, last = start[own] + pairs[i][0] / 2, after[b[own], at] - pairs[i][1] / 2
                        below, above = first <= t[own], last > t[own]
                        found[own[below], 0], found[own[below], 1] = np.minimum(last, t[own])[below], v
                        found[own[above], 2], found[own[above], 3] = np.maximum(first, t[own])[above], v
                    columns = [np.full(len(b), g), np.full(len(b), i), b, bucket, kind[bucket]]
                    out.append(pa.Table.from_arrays([*[pa.array(c.astype(np.int32)) for c in columns], pa.array([name] * len(b), pa.string()), pa.array(start), pa.array(t), *[pa.array(c.copy(), mask=np.isnan(c)) for c in found.T]], schema=schema))
            return pa.concat_tables(out)

        kinds_of = ", ".join([*[f"{c} int" for c in ints], "q string", *[f"{c} double" for c in doubles]])
        return written(sums.filter("bucket >= 0").groupBy("gid").applyInArrow(run, kinds_of), "needed")

    def beside(self, drawn: DataFrame, need: DataFrame) -> DataFrame:
        """(gid, weighting, q, b, target, lo_c, lo_v, hi_c, hi_v): the copies next to each resample's quantile, from the rows of the needed buckets."""
        w, names = self.w, ["gid", "weighting", "q", "b", "target"]
        need = need.filter(f"kind = {ROWWISE}").select(*names, "bucket", "before")
        rows = drawn.filter("sid >= 0").join(F.broadcast(need.select("gid", "bucket").distinct()), ["gid", "bucket"], "left_semi")

        def run(group: pa.Table, wanted: pa.Table) -> pa.Table:
            found = np.full((len(wanted), 4), np.nan)
            if len(group) and len(wanted):
                each = [np.frombuffer(x, np.float64) for x in group.column("v").to_pylist()]
                entry = np.repeat(np.arange(len(each)), [len(x) for x in each])
                v, sid = np.concatenate(each), group.column("sid").to_numpy()[entry]
                m = np.stack([np.frombuffer(x, np.uint8) for x in group.column("data").to_pylist()])
                weighting, b, before, target = (wanted.column(c).to_numpy() for c in ("weighting", "b", "before", "target"))
                for i in np.unique(weighting):
                    order = np.lexsort((w[i][sid], v))
                    ww, vv, own = w[i][sid][order], v[order], entry[order]
                    for r in np.flatnonzero(weighting == i):
                        mass, t = m[:, b[r]][own] * ww, target[r] - before[r]
                        there = np.flatnonzero(mass > 0)
                        end, one = np.cumsum(mass[there]), ww[there]
                        first, last = end - mass[there] + one / 2, end - one / 2
                        below, above = np.searchsorted(first, t, "right") - 1, np.searchsorted(last, t, "right")
                        if below >= 0:
                            step = np.floor((t - first[below]) / one[below])
                            found[r, :2] = before[r] + min(last[below], first[below] + step * one[below]), vv[there[below]]
                        if above < len(there):
                            step = np.floor((t - first[above]) / one[above])
                            found[r, 2:] = before[r] + (first[above] if first[above] > t else first[above] + (step + 1) * one[above]), vv[there[above]]
            return pa.table({c: wanted.column(c) for c in names} | {c: pa.array(found[:, k].copy(), mask=np.isnan(found[:, k])) for k, c in enumerate(("lo_c", "lo_v", "hi_c", "hi_v"))})

        key = ["gid", "bucket"]
        return _dealt(rows, key).groupBy(*key).cogroup(_dealt(need, key).groupBy(*key)).applyInArrow(run, "gid int, weighting int, q string, b int, target double, lo_c double, lo_v double, hi_c double, hi_v double")

    def statistics(self) -> DataFrame:
        """(gid, weighting, statistic, b, value)."""
        gids = sorted({c * self.kinds + k for c, _ in self.runs for k in range(self.kinds)})
        out, reach = None, REACH
        while gids:
            windows = self.windows(gids, reach)
            drawn = self.drawn(windows)
            sums = self.summed(drawn)
            need = self.needed(sums, windows)
            out = self.moments(sums, windows) if out is None else out
            gids = sorted(r["gid"] for r in need.filter(f"kind = {WIDE}").select("gid").distinct().collect())  # a quantile beyond its window
            done = need.filter(~F.col("gid").isin(gids)) if gids else need
            names = ["gid", "weighting", "q", "b", "target", "lo_c", "lo_v", "hi_c", "hi_v"]
            both = self.beside(drawn, done).unionByName(done.filter(f"kind = {ONE}").select(*names))
            pair = lambda side, c: F.when(F.col(f"{side}_c").isNotNull(), F.struct(F.col(f"{side}_c").alias("c"), F.col(f"{side}_v").alias("v")))
            each = both.groupBy("gid", "weighting", "q", "b").agg(F.max(pair("lo", "c")).alias("lo"), F.min(pair("hi", "c")).alias("hi"), F.first("target").alias("target"))
            lo, hi = F.col("lo"), F.col("hi")
            between = lo["v"] + (hi["v"] - lo["v"]) * (F.col("target") - lo["c"]) / (hi["c"] - lo["c"])
            value = F.when(lo.isNull(), hi["v"]).when(hi.isNull() | (lo["v"] == hi["v"]), lo["v"]).otherwise(between)
            out = out.unionByName(each.select("gid", "weighting", F.col("q").alias("statistic"), "b", value.alias("value")))
            reach *= 2
        return out


def _reader(draws: _Draws) -> Callable[[pa.Table, bool], tuple[int, np.ndarray]]:
    """``_sums`` without the rest of ``draws``, for tasks."""
    weights, resamples = draws.weights, draws.resamples

    def read(group: pa.Table, moments: bool) -> tuple[int, np.ndarray]:
        group = group.sort_by([("bucket", "descending" if moments else "ascending")])
        return group.column("gid")[0].as_py(), np.stack([np.frombuffer(x, np.float64).reshape(weights, resamples) for x in group.column("data").to_pylist()])

    return read


def _named(draws: _Draws | None, names: DataFrame, by: list[str]) -> DataFrame:
    each = draws and draws.statistics()
    if each is None:  # no rows
        each = names.sparkSession.createDataFrame([], "gid int, weighting int, statistic string, b int, value double")
    return each.join(F.broadcast(names), "gid").select(*by, "weighting", "statistic", "b", "value")


def resamples(rows: DataFrame, by: Sequence[str], draw_by: Sequence[str], weights: Sequence[str], n: int = RESAMPLES, seed: int = SEED, block: int = BLOCK, most: int = ROWS) -> DataFrame:
    """(by, weighting, statistic, b, value): STATISTICS of each resample b; ``weighting`` counts the columns in ``weights`` from 0.

    ``rows`` has ``by``, stratum, run_id, du, dv, dspeed, magnitude and the weights. Groups that agree in
    ``draw_by``, some of the columns of ``by``, share their draws.
    """
    _importable(rows)
    by, draw_by, spark = list(by), list(draw_by), rows.sparkSession
    more = [c for c in by if c not in draw_by]
    found = rows.select(*by).distinct().collect()
    cells: dict[tuple, int] = {}
    kinds: dict[tuple, int] = {}
    numbers = [(*r, cells.setdefault(tuple(r[c] for c in draw_by), len(cells)), kinds.setdefault(tuple(r[c] for c in more), len(kinds))) for r in found]
    types = "".join(f"{c} {t}, " for c, t in rows.select(*by).dtypes)
    groups = spark.createDataFrame(numbers, f"{types}_cell int, kind int")
    own = [F.col(w).cast("double").alias(f"w{i}") for i, w in enumerate(weights)]
    narrow = _matched(rows.select(*by, "stratum", "run_id", *SIGNED, SIZE, *own), F.broadcast(groups), by).drop(*by)
    draws = cells and _Draws(narrow, ["_cell"], lambda df: df, ["|".join(map(str, k)) for k in cells], max(1, len(kinds)), len(weights), n, seed, block, most)
    return _named(draws or None, spark.createDataFrame([(*r[:-2], r[-2] * len(kinds) + r[-1]) for r in numbers], f"{types}gid int"), by)


def cell_resamples(pairs: DataFrame, cells: dict[str, dict[str, int]], levels: Sequence[str], expand: Callable[[DataFrame], DataFrame], columns: Sequence[str], number: Callable[[Column, dict[str, int]], Column], weights: Sequence[Column], n: int = RESAMPLES, seed: int = SEED, block: int = BLOCK, most: int = ROWS) -> DataFrame:
    """As ``resamples`` by axis, cell and level, from pairs that have a column for each axis: each pair is in a cell of each, and has a row at each level.

    ``cells`` numbers each axis's cells, from 0 over all; ``expand`` makes the rows of the levels, from ``columns``; ``number`` gives the number of a pair's cell.
    """
    _importable(pairs)
    spark, names = pairs.sparkSession, list(levels)
    keys = sorted((i, axis, cell) for axis, own in cells.items() for cell, i in own.items())
    own = [w.cast("double").alias(f"w{i}") for i, w in enumerate(weights)]
    narrow = pairs.select("stratum", "run_id", *columns, *own, *[number(F.col(axis), own).alias(f"_c{i}") for i, (axis, own) in enumerate(cells.items())])
    kind = reduce(lambda rest, j: F.when(F.col("level") == names[j], F.lit(j)).otherwise(rest), range(len(names)), F.lit(-1))
    draws = keys and _Draws(narrow, [f"_c{i}" for i in range(len(cells))], lambda df: expand(df).withColumn("kind", kind), [f"{axis}|{cell}" for _, axis, cell in keys], len(names), len(weights), n, seed, block, most)
    groups = [(axis, cell, level, i * len(names) + j) for i, axis, cell in keys for j, level in enumerate(names)]
    return _named(draws or None, spark.createDataFrame(groups, "axis string, cell string, level string, gid int"), ["axis", "cell", "level"])


def ends(each: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, weighting, statistic, low, high): the 2.5 and 97.5 percentiles of resamples; a group has as many values as resamples."""
    found = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy(*by, "weighting", "statistic").agg(found.alias("_e")).select(*by, "weighting", "statistic", F.col("_e")[0].alias("low"), F.col("_e")[1].alias("high"))


def intervals(rows: DataFrame, by: Sequence[str], draw_by: Sequence[str], weights: Sequence[str], n: int = RESAMPLES, seed: int = SEED, block: int = BLOCK, most: int = ROWS) -> DataFrame:
    """(by, weighting, statistic, low, high): the 2.5 and 97.5 percentiles of ``resamples``."""
    return ends(resamples(rows, by, draw_by, weights, n, seed, block, most), by)
