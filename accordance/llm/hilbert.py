"""Sharding along a Hilbert curve, in DataFrame operations only.

Several metadata dimensions are quantised to ``bits`` bits each and mapped to their place on
the Hilbert curve; rows are ordered by that place and cut into runs of equal row counts
(law ``rows``: the counts of two shards differ by one at most). Files written shard by
shard can then be pruned on any of the dimensions.

lang and source are coded by the rank of a value among the distinct values, scaled to 15
classes, so that neighbours on the curve are neighbours in the sorted values. Ranks are taken
among all distinct values: these are sorted in ranges, numbered within their range, and only the
classes' least values are kept. The third dimension is the size in steps of factor two.

Equal texts stay together: they take the place on the curve of their first document, and
within a place rows are ordered by a hash of the text, then by a hash of doc_id. Only the
cuts between shards, one fewer than there are shards, can part a group of equal texts.

The global row number is found without a global window. A place on the curve is split into
parts by its measured count: ranges of the text's hash, and for a text that is itself held
by more than ``PART`` rows, ranges of doc_id's hash. So a place or a text that holds a third
of all rows is numbered by many tasks. Counts of parts are running-summed along each place,
those of places along the curve, and joined back.

Defined cases: null dimensions have a code of their own; a null text has size 8 and the
CRC of nothing, 0, and stands with empty texts; rows with one doc_id and one text may stand
in either order; an empty table gives an empty table; columns of the input that are not
named in the result go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordance.llm.common import saved

SHARDS, BITS, PART = 24, 4, 1000


def curve_places(axes: int, bits: int) -> list[int]:
    """For each cell (its axes' codes written one after another in binary), its place on the Hilbert curve.

    Skilling's transform (AIP Conf. Proc. 707, 2004): undo the excess work from the highest
    bit down, Gray-encode, and interleave.
    """
    places = []
    for cell in range(1 << (axes * bits)):
        x = [cell >> (bits * (axes - 1 - i)) & ((1 << bits) - 1) for i in range(axes)]
        for q in range(bits - 1, 0, -1):
            low = (1 << q) - 1
            for i in range(axes):
                if x[i] >> q & 1:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[i]) & low
                    x[0] ^= swap
                    x[i] ^= swap
        for i in range(1, axes):
            x[i] ^= x[i - 1]
        turn = 0
        for q in range(bits - 1, 0, -1):
            if x[-1] >> q & 1:
                turn ^= (1 << q) - 1
        place = 0
        for q in range(bits - 1, -1, -1):
            for a in x:
                place = place << 1 | ((a ^ turn) >> q & 1)
        places.append(place)
    return places


def hilbert_index(axes: Sequence[Column], bits: int) -> Column:
    """The place on the curve of a point whose axes have ``bits`` bits: one look-up in a constant array of 2**(bits * axes) places."""
    cell = F.lit(0)
    for axis in axes:
        cell = F.shiftleft(cell, bits).bitwiseOR(axis)
    return F.element_at(F.split(F.lit(",".join(map(str, curve_places(len(axes), bits)))), ","), cell + 1).cast("int")


def classes(docs: DataFrame, name: str, bits: int) -> DataFrame:
    """One row: the least value of each class but the first; a value's class is the number of these at most as great, and one (0 is null's)."""
    most = (1 << bits) - 1
    values = docs.filter(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("v")).distinct()
    dealt = saved(values.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "values")  # ranges in ascending order
    # a few rows: one for each range
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = dealt.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("all"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("v")) - 1
    ranks = dealt.withColumn("rn", rank).join(F.broadcast(starts), "p").withColumn("rank", F.col("start") + F.col("rn"))
    # with fewer values than classes a value begins several classes
    times = F.size(F.filter(F.sequence(F.lit(1), F.lit(most - 1)), lambda i: F.ceil(F.col("all") * i / F.lit(most)) == F.col("rank")))
    return ranks.withColumn("times", times).filter("times > 0").agg(F.flatten(F.collect_list(F.array_repeat("v", F.col("times")))).alias(f"{name}_cuts"))


def _code(name: str) -> Column:
    return F.when(F.col(name).isNull(), 0).otherwise(F.size(F.filter(f"{name}_cuts", lambda c: c <= F.col(name).cast("string"))) + 1)


def _short_hash(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _share(key: str, parts: Column) -> Column:
    """Which of ``parts`` equal ranges of 60-bit hashes a hash lies in."""
    return F.floor(F.col(key) / F.ceil(F.lit(float(1 << 60)) / parts)).cast("long")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, part: int = PART) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve: every row in exactly one shard."""
    docs = docs.select("doc_id", "text", "lang", "source")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + F.lit(8)).cast("long")
    # one row each, of at most 2**bits values
    coded = docs.crossJoin(F.broadcast(classes(docs, "lang", bits))).crossJoin(F.broadcast(classes(docs, "source", bits)))
    rows = coded.select("doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), _short_hash(text).alias("text_key"), _short_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("id_key"), _code("lang").alias("d0"), _code("source").alias("d1"))
    # the third axis: the size in steps of factor two, from 8 bytes upwards
    rows = rows.withColumn("d2", F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.col("size"))).cast("int") - 3))
    rows = rows.withColumn("own", hilbert_index([F.col("d0"), F.col("d1"), F.col("d2")], bits)).drop("d0", "d1", "d2")
    rows = saved(rows, "places")  # narrow, and read several times
    # texts held by several rows: the place of their first document, and their count
    texts = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("held"), F.min(F.struct("id_key", "own"))["own"].alias("first")).filter("held > 1")
    rows = rows.join(texts, "text_key", "left").withColumn("curve", F.coalesce("first", "own")).withColumn("held", F.coalesce("held", F.lit(1)))
    rows = saved(rows, "rows")
    # a place's parts, in the order of texts; behind them, texts with more rows than a part have parts of their own
    places = rows.groupBy("curve").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    rows = rows.join(F.broadcast(places), "curve")  # at most 2**(bits * axes) rows
    hot = F.col("held") > part
    rows = rows.withColumn("part", _share("text_key", F.col("parts"))).withColumn("hot", F.when(hot, F.col("text_key")).otherwise(-1)).withColumn("sub", F.when(hot, _share("id_key", F.ceil(F.col("held") / part))).otherwise(0))
    key = ["curve", "part", "hot", "sub"]
    parts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("curve").orderBy("part", "hot", "sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before_part", F.coalesce(F.sum("n").over(within), F.lit(0)))
    cells = parts.groupBy("curve").agg(F.sum("n").alias("m"))
    # at most 2**(bits * axes) rows, whatever the input
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before_cell", F.coalesce(F.sum("m").over(along), F.lit(0)))
    cells = cells.withColumn("total", F.sum("m").over(Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    starts = parts.join(cells, "curve").select(*key, (F.col("before_part") + F.col("before_cell")).alias("start"), "total")
    order = Window.partitionBy(*key).orderBy("text_key", "id_key", "doc_id")
    place = rows.withColumn("rn", F.row_number().over(order) - 1).join(starts, key).withColumn("rank", F.col("start") + F.col("rn"))
    # the first total % shards shards take one row more
    small, more = F.floor(F.col("total") / shards), F.col("total") % shards
    edge = more * (small + 1)
    shard = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (small + 1))).otherwise(more + F.floor((F.col("rank") - edge) / F.greatest(small, F.lit(1))))
    first = shard * small + F.least(shard, more)
    return place.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("long").alias("curve"))
