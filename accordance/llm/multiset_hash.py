"""Document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

A text is the multiset of its paragraphs: here runs of at most ``RUN`` characters that end
after a line end or a sentence's mark, so that a change stays local also in texts without
line breaks. Each paragraph is hashed to a wide vector: ``LANES`` one-bit lanes, packed three
to a long at distances of 20 bits. A fingerprint is the sum of these vectors, word by word
modulo 2**60, with the number of paragraphs. Hence equal multisets have equal fingerprints
in any order, and a paragraph is inserted or deleted by adding or subtracting its vector
(``insert`` and ``delete``). Read as counts c of set bits among n paragraphs, the lanes
2c - n are random projections of the multiset, whose cosine estimates the likeness of two.

The next document is found in the only shuffle of texts: rows are dealt by ranges of doc_id,
the first row of a range is also sent to the range before it, and ``lead`` then never leaves
a range. The ranges are those of Spark's own range partitioning of the ids, so that clustered
ids do no harm; their number is a parameter, and a row finds its range by bisection, in steps
as many as the logarithm of that number.

Defined cases: a null text is empty; an empty text has the fingerprint of no paragraphs,
which is like itself (1.0) and like nothing else (0.0); rows with equal doc_id follow one
another by text; null doc_ids come first, also where the last document is followed by the
first; an only document is followed by itself; an empty table gives an empty table; only
doc_id and text are read, so that further columns, whatever their names, don't matter.
A field of a word is 20 bits wide: beyond 2**20 - 1 paragraphs (over 25 million characters)
fields carry into their neighbours. Equality, insertion and deletion stay exact then;
likeness doesn't, and is 1 or 0 as fingerprints are equal or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN, MOST = 48, (1 << 20) - 1
SHIFTS, SEEDS = 20, (17, 91)
LANES = 3 * SHIFTS * len(SEEDS)
_BITS, _MOD = (1 << 40) | (1 << 20) | 1, (1 << 60) - 1


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^.!?|;\n]{1,%d}[.!?|;\n]*|[.!?|;\n]+" % RUN), F.lit(0))


def _seeded(seed: int):
    return lambda u: F.xxhash64(F.lit(seed), u)


def _adds(shift: int):
    return lambda total, h: (total + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_BITS))).bitwiseAND(F.lit(_MOD))


def vectors(units: Column) -> list[Column]:
    """One array of hashes for each seed."""
    return [F.transform(units, _seeded(seed)) for seed in SEEDS]


def _sums(hashes: Column) -> list[Column]:
    return [F.aggregate(hashes, F.lit(0).cast("long"), _adds(shift)) for shift in range(SHIFTS)]


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: struct<n long, words array<long>>."""
    df = df.withColumn("_units", paragraphs(F.col(text)))
    for i, hashes in enumerate(vectors(F.col("_units"))):
        df = df.withColumn(f"_h{i}", hashes)
    words = [w for i in range(len(SEEDS)) for w in _sums(F.col(f"_h{i}"))]
    value = F.struct(F.size("_units").cast("long").alias("n"), F.array(*words).alias("words"))
    return df.withColumn(name, value).drop("_units", *[f"_h{i}" for i in range(len(SEEDS))])


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of the union of two multisets."""
    return F.struct((a["n"] + b["n"]).alias("n"), F.zip_with(a["words"], b["words"], lambda x, y: (x + y).bitwiseAND(F.lit(_MOD))).alias("words"))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint of multiset a without multiset b."""
    return F.struct((a["n"] - b["n"]).alias("n"), F.zip_with(a["words"], b["words"], lambda x, y: (x + F.lit(_MOD + 1) - y).bitwiseAND(F.lit(_MOD))).alias("words"))


def as_string(fp: Column) -> Column:
    return F.concat_ws("", F.lower(F.hex(fp["n"])), F.lit(":"), F.array_join(F.transform(fp["words"], lambda w: F.lpad(F.lower(F.hex(w)), 15, "0")), ""))


def lanes(fp: Column) -> Column:
    """The signed lanes, 2c - n."""
    low = F.lit((1 << 20) - 1)
    n = fp["n"]
    signed = lambda w, k: (F.shiftright(w, k).bitwiseAND(low) * 2 - n).cast("double")
    return F.flatten(F.transform(fp["words"], lambda w: F.array(signed(w, 0), signed(w, 20), signed(w, 40))))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, a_lanes: Column, b_lanes: Column) -> Column:
    """1 for equal fingerprints, else the lanes' cosine, not below 0; 0 beyond what the lanes can count."""
    norm = F.sqrt(_dot(a_lanes, a_lanes) * _dot(b_lanes, b_lanes))
    none = (a["n"] == 0) | (b["n"] == 0) | (a["n"] > MOST) | (b["n"] > MOST) | (norm == 0)
    return F.when(a == b, F.lit(1.0)).when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(a_lanes, b_lanes) / norm)))


def range_starts(docs: DataFrame, ranges: int) -> DataFrame:
    """One row: starts, the sorted first doc_ids of the ranges (at most ``ranges`` values; null ids stand before them), and the first doc_id of all."""
    dealt = docs.select("doc_id").repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id().alias("range")).agg(F.min("doc_id").alias("start"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    starts = F.array_sort(F.collect_list("start"))
    return dealt.agg(starts.alias("starts"), F.when(F.sum("nulls") == 0, F.min("start")).alias("first_id"))


def below(starts: Column, value: Column, ranges: int) -> Column:
    """How many of the sorted ``starts`` are at most ``value``, by bisection; 0 for null."""
    steps = F.array(*[F.lit(1 << b) for b in range(ranges.bit_length() - 1, -1, -1)])
    step = lambda at, width: F.when((at + width <= F.size(starts)) & (F.get(starts, at + width - 1) <= value), at + width).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``ranges``: four for each shuffle partition unless given.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.crossJoin(F.broadcast(range_starts(docs, ranges)))  # one row, of at most ``ranges`` ids
    base = base.withColumn("range", below(F.col("starts"), F.col("doc_id"), ranges))
    starts_range = F.coalesce(F.get("starts", F.col("range") - 1) == F.col("doc_id"), F.lit(False))
    to = lambda r, late: F.struct(r.alias("r"), F.lit(late).alias("late"))
    # the first document also stands behind the last one, in the last range
    copies = F.filter(F.array(to(F.col("range"), 0), F.when(starts_range, to(F.col("range") - 1, 1)), F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), to(F.size("starts"), 2))), lambda x: x.isNotNull())
    rows = base.select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.r", "to.late")
    rows = with_fingerprint(rows, "text", "fp")
    order = Window.partitionBy("r").orderBy("late", "doc_id", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).filter("late = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    rows = rows.drop("text", "next_text")
    rows = with_fingerprint(rows, "edited", "edited_fp")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fp", "edited_fp", "next_fp")
    rows = rows.withColumn("a", lanes(F.col("fp"))).withColumn("b", lanes(F.col("edited_fp"))).withColumn("c", lanes(F.col("next_fp")))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp"), F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), F.col("a"), F.col("c")).alias("near_next"))
