"""Vector code compression: Lloyd's rounds for each part of a vector, by ball k-means.

A vector's components become integers, floor(256 * x), and are cut into equal consecutive
parts. Each part position has a codebook of entries; an entry and the parts assigned to it are
a ball, whose radius is the distance of its farthest part. After the entries have moved:

- Entry j can take parts from entry i only if half their distance is within i's radius: the
  neighbours of i. A ball without neighbours is left alone.
- Parts nearer to their entry than half the distance to its nearest neighbour are the stable
  core: no other entry is computed for them.
- The rest lies in rings between the half distances to the first, second, ... neighbour. A part
  in ring k is compared with the first k neighbours only.

Only what cannot win is skipped, so assignments are those of the full search, ties included.
Radii are those of a task's own parts, which are smaller than or equal to the whole ball's, so
no extra pass over the table is needed for them. All distances are exact: squared integers.

A round is one pass: a task reads vectors and codes, assigns, and writes both again with its
partial sums of each entry, which Spark adds up; the driver holds nothing but the codebooks
(entries times components, whatever the table's size). The first assignment has no balls to
start from and computes all distances.

Defined cases: rows whose vector is null or holds null, NaN or infinite components go; repeated
vec_ids are all coded; null vec_ids are coded, and are the last to become entries; if fewer
than ``ENTRIES`` vectors are kept, so many entries there are; vectors whose length differs from
that of the smallest vec_id's vector get a null code and error and don't count in sums; a
length that ``PARTS`` doesn't divide gives parts whose lengths differ by one at most; an empty
table gives an empty table. Components must be small enough for 64-bit squared distances;
others end the run with an error that says so. Further columns go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import Scratch, importable, plus, saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """First and last component of each part."""
    cuts = [length * p // parts for p in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def full_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of each row of ``x`` by all distances, the lower index on ties."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for j, c in enumerate(entries):
        d = ((x - c) ** 2).sum(1)
        nearer = d < best
        best[nearer], at[nearer] = d[nearer], j
    return at, best


def ball_search(x: np.ndarray, entries: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``full_search``, from the entries that the rows belonged to; and how many distances were computed."""
    best = ((x - entries[was]) ** 2).sum(1)
    radius = np.zeros(len(entries), np.int64)
    np.maximum.at(radius, was, best)
    apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(apart, np.iinfo(np.int64).max)
    order = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, order, 1)
    # an entry j at half its distance or nearer may win or tie: d(i, j)**2 <= 4 * d(x, i)**2
    neighbours = (apart <= 4 * radius[:, None]).sum(1)
    ring = np.zeros(len(x), np.int64)
    by_entry = np.argsort(was, kind="stable")
    cuts = np.searchsorted(was[by_entry], np.arange(len(entries) + 1))
    for i in np.flatnonzero((neighbours > 0) & (np.diff(cuts) > 0)):
        own = by_entry[cuts[i] : cuts[i + 1]]
        ring[own] = np.searchsorted(apart[i, : neighbours[i]], 4 * best[own], "right")
    at, tried, live = was.copy(), len(x), np.flatnonzero(ring)
    k = 0
    while len(live):  # the k-th neighbour of all rows that lie in ring k or beyond
        other = order[was[live], k]
        d = ((x[live] - entries[other]) ** 2).sum(1)
        wins = (d < best[live]) | (d == best[live]) & (other < at[live])
        best[live[wins]], at[live[wins]] = d[wins], other[wins]
        tried, k = tried + len(live), k + 1
        live = live[ring[live] > k]
    return at, best, tried


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of float lists as floor(SCALE * x)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.r_[0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise ValueError("a vector's component is too large for 64-bit squared distances")
    return x.astype(np.int64), ends


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], length: int, first: bool, sums: bool) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, v, code, error), and at a task's end one row for each used entry: (part, entry, n, s)."""
    cut = bounds(length, len(books))
    count = [np.zeros(len(b), np.int64) for b in books]
    total = [np.zeros(b.shape, np.int64) for b in books]
    most = max((int(np.abs(b).max(initial=0)) for b in books), default=0)
    for batch in batches:
        if first:
            flat, ends = _integers(batch.column("v"))
        else:
            flat, ends = batch.column("v").flatten().to_numpy(), batch.column("v").offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
        rows = len(batch)
        fits = np.diff(ends) == length
        x = flat[np.repeat(fits, np.diff(ends))].reshape(int(fits.sum()), length)
        if length * (int(np.abs(x).max(initial=0)) + most) ** 2 >= 2**60:
            raise ValueError("a vector's component is too large for 64-bit squared distances")
        codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
        if not first and len(x):
            held = batch.column("code").combine_chunks() if isinstance(batch.column("code"), pa.ChunkedArray) else batch.column("code")
            was = np.frombuffer(b"".join(held.drop_null().to_pylist()), np.uint8).reshape(codes.shape)
        for p, (lo, hi) in enumerate(cut if len(x) else []):
            part = x[:, lo:hi]
            at, d = full_search(part, books[p]) if first else ball_search(part, books[p], was[:, p].astype(np.int64))[:2]
            codes[:, p], error = at, error + d
            if sums:
                count[p] += np.bincount(at, minlength=len(books[p]))
                np.add.at(total[p], at, part)
        code, errors = np.full(rows, None, object), np.zeros(rows, np.int64)
        code[fits], errors[fits] = [c.tobytes() for c in codes], error
        none = lambda kind: pa.nulls(rows, kind)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(code, pa.binary()), pa.array(errors, mask=~fits), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64())), pa.array(["row"] * rows)], _NAMES)
    if sums:
        used = [(p, j, int(n), total[p][j].tolist()) for p, c in enumerate(count) for j, n in enumerate(c) if n]
        if used:
            kinds = pa.schema(batch.schema.field(c) for c in ("vec_id", "label"))
            rest = [pa.nulls(len(used), k) for k in (kinds[0].type, kinds[1].type, pa.list_(pa.int64()), pa.binary(), pa.int64())]
            own = [pa.array([u[i] for u in used], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*rest, *own, pa.array(["sum"] * len(used))], _NAMES)


_NAMES = ["vec_id", "label", "v", "code", "error", "part", "entry", "n", "s", "kind"]
_KINDS = {"v": "array<long>", "code": "binary", "error": "long", "part": "int", "entry": "int", "n": "long", "s": "array<long>", "kind": "string"}


def moved(books: list[np.ndarray], table: DataFrame) -> list[np.ndarray]:
    """The entries at floor(sum / count) of their parts; at most entries times components rows reach the driver."""
    out = [b.copy() for b in books]
    each = table.filter("kind = 'sum'").select("part", "entry", "n", F.posexplode_outer("s").alias("i", "x"))
    for r in each.groupBy("part", "entry", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).filter("i is not null").collect():
        out[r["part"]][r["entry"], r["i"]] = r["x"] // r["n"]
    return out


def kept(vectors: DataFrame) -> DataFrame:
    """The rows whose vector is whole and finite, as (vec_id, label, v)."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), whole.alias("whole")).filter("whole").drop("whole")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (hexadecimal), error, label_error, codebooks_sha256 for every kept row.

    ``vectors`` has vec_id, label and embedding; ``entries`` is 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("a part's index takes one byte: 1 to 256 entries")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vector-codes")
    importable(spark)
    rows = kept(vectors)
    first = [np.floor(np.array(r["v"], np.float64) * SCALE) for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    first = [x.astype(np.int64) for x in first if len(x) == len(first[0])]
    length = len(first[0]) if first else 0
    books = [np.array([x[lo:hi] for x in first], np.int64).reshape(len(first), hi - lo) for lo, hi in bounds(length, parts)]
    schema = plus(rows.select("vec_id", "label").schema, **_KINDS)
    was = None
    for r in range(rounds + 1):
        last = r == rounds
        source = rows if was is None else was.filter("kind = 'row'").select("vec_id", "label", "v", "code")
        work = lambda it, b=books, f=was is None, s=not last: _coded(it, b, length, f, s)
        table = scratch.saved(source.mapInArrow(work, schema), f"round-{r}")
        if not last:
            books = moved(books, table)
        if was is not None:
            scratch.drop(was)
        was = table
    coded = was.filter("kind = 'row'").select("vec_id", "label", "code", "error")
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    out = out.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    out = saved(out, "codes")
    scratch.clear()
    return out
