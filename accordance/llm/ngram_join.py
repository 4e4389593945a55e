"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. Two link when 100 * |x & y| >= percent * |x | y|.
All sets are ordered by one order of shingles, rare ones first: by a count sketch of fixed
size over the whole corpus, then by hash. With a = ceil(percent * n / 100), the first
n - a + l shingles are the l-prefix. Of the shingles that two linked documents share, of which
there are ``needed`` at least, all but max(a - l, a' - l') lie in both prefixes; so that many
shared prefix shingles (min(l, l') at the very least) are asked for before a pair is verified.
Each document takes the l with the least estimated cost: its prefix's rows, the other holders
of its shingles by the sketch, and candidates to be verified, which fall as more shared
shingles are asked for. Ordinary texts stay at l = 1; texts with many near copies get long
prefixes.

1. Documents with equal sets form a class, of which the smallest doc_id goes on.
2. The 1-prefixes are an index. Each class is compared with one leader, the class with which
   it shares most prefix shingles among those that hold them earliest; where the two are at
   least ``NEAR`` below the asked similarity they join a family. A family is no component: it
   only gathers what is alike, linked or not. It costs rows as many as its postings.
3. Within families: sets meet in cells of bounded size, where shared shingles are counted for
   all pairs at once. A cell gives back each document's links and one edge to the smallest
   document that it reaches in the cell. So no link is lost, and a family's pairs, linked or
   nearly so, never become rows.
4. Between families: classes that meet in the index within the bounds of ``possible`` are
   pairs; those whose l-prefixes share enough shingles are candidates, all of which are
   verified by their full sets. (An index of l-prefixes would meet a pair once for each
   shingle of its longer prefixes.)
5. Edges and links give components; class sizes give every document's number of links.

Defined cases: null and empty texts, and texts without words, have no shingles and link with
nothing; with fewer words than ``words`` the whole sequence is one shingle; rows that share a
doc_id are taken for one document, and counted as rows in n_links; a null doc_id keeps its row
with component null and doesn't count as a link; ties in the order of shingles go by hash; an
empty table gives an empty table; only doc_id and text are read, so that further columns,
whatever their names, don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import Scratch, importable, mix64, prefix_hashes, saved, substring_hashes, text_buffers, word_bounds
from accordance.llm.components import components

WORDS, PERCENT, VERIFY = 4, 85, 0.25
SKETCH_LOG, SLICES = 21, 32
#: Up to so many ids (16 MB) are sent to every task, rather than shuffling the texts to them.
FEW_IDS = 1 << 21
#: Shingles and sets in a part of a cell, as a rule.
CELL, CELL_SETS = 1 << 18, 1024
#: Holders of shingles that a cell's block looks at at once.
MET = 1 << 17
#: How far below the asked percent two classes may lie and still be gathered in a family.
NEAR = 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD3 = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for every row of a column."""
    for a, b, data, offsets in text_buffers(texts, 1 << 19):
        data = _LOWER[data]
        starts, stops, row = word_bounds(data, offsets)
        w = substring_hashes(prefix_hashes(data), starts, stops)
        cuts = np.searchsorted(row, np.arange(b - a + 1))
        sh = w.copy()
        for j in range(1, words):
            if len(w) > j:
                sh[: len(w) - j] = mix64(sh[: len(w) - j] * np.uint64(3) + w[j:])
        for i in range(b - a):
            lo, hi = cuts[i], cuts[i + 1]
            if hi - lo >= words:
                yield a + i, np.unique(sh[lo : hi - words + 1])
            elif hi > lo:  # the whole sequence, salted by its length
                h = np.array([hi - lo], np.uint64) * _ODD3
                for x in w[lo:hi]:
                    h = mix64(h * np.uint64(5) + x)
                yield a + i, h
            else:
                yield a + i, np.zeros(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """A task's sketch, in slices."""
    counts = np.zeros(1 << SKETCH_LOG, np.uint32)
    for batch in batches:
        for _, own in shingle_sets(batch.column(0), words):
            np.add.at(counts, (own >> np.uint64(64 - SKETCH_LOG)).view(np.int64), np.uint32(1))  # in place: a bincount of all cells would be large
    if counts.any():
        lane = int(mix64(counts[:64].astype(np.uint64).sum(keepdims=True))[0] % np.uint64(16))
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([lane] * SLICES, pa.int32()), pa.array(parts, pa.binary())], ["slice", "lane", "counts"])


def _sum(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, key = None, None
    for batch in group:
        for at, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(part), np.uint32)
            total, key = x.copy() if total is None else total + x, at
    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "lane", "counts"])


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents hold a shingle of each of 2**SKETCH_LOG hash cells. Its size doesn't grow with the corpus."""
    schema = "slice int, lane int, counts binary"
    tasks = docs.select("text").mapInArrow(lambda it: _count(it, words), schema)
    by_lane = tasks.groupBy("slice", "lane").applyInArrow(_sum, schema)  # two levels keep groups small
    rows = by_lane.groupBy("slice").applyInArrow(_sum, schema).collect()
    out = np.zeros((SLICES, (1 << SKETCH_LOG) // SLICES), np.uint32)
    for r in rows:
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out.reshape(-1)


def adaptive_l(others: np.ndarray, n: int, least: int) -> int:
    """The l with the least estimated cost, from the estimated number of other holders of each token in order.

    A prefix costs a row for each of its tokens and one for each other holder; candidates, of
    which each uses up l of the other holders, cost ``VERIFY * n`` rows each. Longer prefixes
    are tried for as long as that lowers the cost.
    """
    read = np.cumsum(1.0 + others)[n - least :]
    met = np.cumsum(others)[n - least :]
    cost = read + VERIFY * n * met / np.arange(1, least + 1)
    rises = np.flatnonzero(cost[1:] >= cost[:-1])
    return int(rises[0]) + 1 if len(rises) else least


def _prefixes(batches: Iterator[pa.RecordBatch], sent, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    counts = sent.value
    usual = float(counts.mean()) + 3 * float(counts.mean()) ** 0.5  # what a cell holds of other shingles, at most as a rule
    for batch in batches:
        rows = len(batch)
        size, el, s1, s2 = np.zeros(rows, np.int64), np.zeros(rows, np.int32), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        tokens, places, ends = [], [], np.zeros(rows + 1, np.int64)
        for i, own in shingle_sets(batch.column(1), words):
            n = len(own)
            if n:
                size[i] = n
                s1[i], s2[i] = mix64(own).sum().view(np.int64), mix64(own * _ODD3).sum().view(np.int64)
                seen = counts[own >> np.uint64(64 - SKETCH_LOG)]
                order = np.argsort(seen, kind="stable")  # ties by hash, as own is sorted
                seen, own = seen[order], own[order]
                least = -(-percent * n // 100)
                el[i] = adaptive_l(np.maximum(seen - usual, 0.0), n, least)
                p = n - least + int(el[i])
                at = np.flatnonzero(seen[:p] > 1)  # a count of one: nobody else has it
                tokens.append(own[:p][at].view(np.int64))
                places.append(at.astype(np.int32))
                ends[i + 1] = len(at)
        ends = np.cumsum(ends).astype(np.int32)
        flat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat(x, k))) for x, k in ((tokens, np.int64), (places, np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(s1), pa.array(s2), pa.array(el), *lists], ["doc_id", "n", "s1", "s2", "l", "tokens", "places"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [x.view(np.int64) for _, x in shingle_sets(batch.column(1), words)]
        ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))], ["doc_id", "tokens"])


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id stands in ``ids``, one for each doc_id."""
    if ids.count() <= FEW_IDS:  # else both sides are shuffled
        ids = F.broadcast(ids)
    return df.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their full sets."""
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("both") * 100 >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def full_sets(docs: DataFrame, pairs: DataFrame, words: int, scratch: Scratch) -> DataFrame:
    """(doc_id, tokens) of every document in a pair."""
    ids = scratch.saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    return scratch.saved(only(docs, ids).mapInArrow(lambda it: _sets(it, words), "doc_id long, tokens array<long>"), "sets")


def overlap(n: Column, m: Column, percent: int) -> Column:
    """The least number of shared shingles of two linked sets of sizes n and m."""
    return F.floor((percent * (n + m) + (99 + percent)) / (100 + percent))


def possible(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether a shared shingle at these places may belong to a linked pair.

    It must lie in both 1-prefixes as the pair's sizes make them; and what is shared up to it
    (no more than the shingles before it that others hold too, nth) with what is left after
    it must reach the needed overlap.
    """
    needed = overlap(x["n"], y["n"], percent)
    inside = (x["place"] <= x["n"] - needed) & (y["place"] <= y["n"] - needed)
    return inside & (F.least(x["nth"], y["nth"]) + F.least(x["n"] - x["place"], y["n"] - y["place"]) >= needed)


def multi_match(made: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs whose l-prefixes share as many shingles as a link needs there."""
    ids = scratch.saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    lists = scratch.saved(only(made.select("doc_id", "n", "l", "tokens"), ids), "lists")
    one, two = (lists.select(F.col("doc_id").alias(side), F.struct("n", "l", "tokens").alias(f"p_{side}")) for side in "ab")
    both = pairs.join(one, "a").join(two, "b")
    p, q = F.col("p_a"), F.col("p_b")
    beyond = lambda x: F.ceil(x["n"] * percent / 100) - x["l"]
    return both.filter(F.size(F.array_intersect(p["tokens"], q["tokens"])) >= overlap(p["n"], q["n"], percent) - F.greatest(beyond(p), beyond(q))).select("a", "b")


def _cell_links(group: pa.Table, percent: int) -> pa.Table:
    """(doc_id, others, least) of each set of a cell: the weight of those it links with, across the cell's two parts or within its only one, and the smallest doc_id it reaches."""
    ids, part, weight = (group.column(c).to_numpy() for c in ("doc_id", "part", "m"))
    lists = group.column("tokens").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    token, of = lists.values.to_numpy(), np.repeat(np.arange(len(ids)), size)
    order = np.argsort(token, kind="stable")
    holder = of[order]
    starts = np.flatnonzero(np.r_[True, token[order[1:]] != token[order[:-1]]]) if len(token) else np.zeros(0, np.int64)
    held = np.diff(np.r_[starts, len(token)])
    begin, many = np.empty(len(token), np.int64), np.empty(len(token), np.int64)  # of each shingle of a set: where its holders stand, and how many
    begin[order], many[order] = np.repeat(starts, held), np.repeat(held, held)
    rows, ends = len(ids), np.r_[0, np.cumsum(size)]
    linked, apart = np.zeros((rows, rows), bool), len(np.unique(part)) > 1
    blocks = [slice(i, min(i + 256, rows)) for i in range(0, rows, 256)]  # whole matrices of numbers would be large
    for at in blocks:
        shared = np.zeros((at.stop - at.start) * rows, np.int64)
        own = np.arange(ends[at.start], ends[at.stop])
        own = own[many[own] > 1]
        met = np.cumsum(many[own])
        for some in np.split(own, np.searchsorted(met, np.arange(MET, met[-1], MET))) if len(own) else ():
            n = many[some]
            who = holder[np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            shared += np.bincount(np.repeat((of[some] - at.start) * rows, n) + who, minlength=len(shared))
        shared = shared.reshape(-1, rows)
        linked[at] = 100 * shared >= percent * (size[at, None] + size[None, :] - shared)
        if apart:
            linked[at] &= part[at, None] != part[None, :]
    if not apart:
        np.fill_diagonal(linked, False)
    least = ids.copy()  # the smallest document reached: minima along links, until they settle
    while True:
        near = np.concatenate([np.minimum(least[at], np.where(linked[at], least[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)) for at in blocks]) if rows else least
        if (near == least).all():
            break
        least = near
    others = np.concatenate([(linked[at] * weight[None, :]).sum(1) for at in blocks]) if rows else weight
    return pa.table({"doc_id": ids, "others": others, "least": least})


def family_links(docs: DataFrame, families: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, others, least) in one or more rows for each class of a family; families(doc_id, component, n, m)."""
    sums = families.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / CELL), F.ceil(F.count(F.lit(1)) / CELL_SETS)).alias("parts"))
    placed = scratch.saved(families.join(sums, "component").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))), "placed")
    texts = only(docs, placed.select("doc_id")).mapInArrow(lambda it: _sets(it, words), "doc_id long, tokens array<long>")
    sets = scratch.saved(texts.join(placed, "doc_id"), "family-sets")
    sent = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other"))
    return sent.select(cell.alias("cell"), "doc_id", "part", "m", "tokens").groupBy("cell").applyInArrow(lambda t: _cell_links(t, percent), "doc_id long, others long, least long")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ngram-join")
    importable(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = spark.sparkContext.broadcast(sketch(docs, words))
    made = docs.mapInArrow(lambda it: _prefixes(it, sent, words, percent), "doc_id long, n long, s1 long, s2 long, l int, tokens array<long>, places array<int>")
    made = scratch.saved(made, "prefixes")
    key = ["n", "s1", "s2"]
    # 1: classes
    classes = scratch.saved(made.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")), "classes")
    reps = made.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    weights = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.sum("m").alias("m"))
    # 2: an index, the leader of each shared shingle, and the best leader of each class
    entry = F.posexplode(F.arrays_zip("tokens", "places")).alias("nth", "t")
    postings = reps.select("doc_id", "n", "l", entry).select(F.col("t.tokens").alias("token"), F.col("doc_id").alias("doc"), "n", "l", F.col("t.places").alias("place"), "nth")
    postings = scratch.saved(postings.filter(F.col("place") <= F.floor(F.col("n") * (100 - percent) / 100)), "postings")
    leads = scratch.saved(postings.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min(F.struct("place", "doc", "n", "l", "nth")).alias("lead")).filter("holders > 1").select("token", "lead"), "leads")
    hits = scratch.saved(postings.join(leads, "token"), "hits")
    scratch.drop(postings)
    fits = lambda a, b: (a * 100 >= b * percent) & (b * 100 >= a * percent)
    lead = {c: F.col(f"lead.{c}") for c in ("doc", "n", "l", "nth", "place")}
    near = hits.filter((F.col("doc") != lead["doc"]) & fits(F.col("n"), lead["n"]) & possible({c: F.col(c) for c in lead}, lead, percent))
    stars = near.groupBy("doc", lead["doc"].alias("other")).agg(F.count(F.lit(1)).alias("shared"))
    stars = stars.groupBy("doc").agg(F.max(F.struct("shared", "other")).alias("best")).select(F.least("doc", "best.other").alias("a"), F.greatest("doc", "best.other").alias("b")).distinct()
    stars = scratch.saved(stars, "stars")
    family = components(verified(full_sets(docs, stars, words, scratch), stars, max(1, percent - NEAR)))
    # 4: candidates between families
    held = hits.drop("lead").join(family.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    held = scratch.saved(held, "held")
    scratch.drop(hits)
    open_tokens = held.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    held = scratch.saved(held.join(open_tokens, "token", "left_semi"), "open")
    x, y = ({c: F.col(f"{c}_{side}") for c in held.columns if c != "token"} for side in "xy")
    left, right = (held.select("token", *[F.col(c).alias(f"{c}_{side}") for c in held.columns if c != "token"]) for side in "xy")
    met = left.join(right, (left["token"] == right["token"]) & (x["doc"] < y["doc"]) & (x["component"] != y["component"]) & fits(x["n"], y["n"]) & possible(x, y, percent))
    pairs = scratch.saved(met.select(x["doc"].alias("a"), y["doc"].alias("b")).distinct(), "met")
    pairs = scratch.saved(multi_match(made, pairs, percent, scratch), "pairs")
    links = scratch.saved(verified(full_sets(docs, pairs, words, scratch), pairs, percent), "links")
    # 3: links within families
    inner = family.join(classes.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"), F.sum("m").alias("m")), "id").select(F.col("id").alias("doc_id"), "component", "n", "m")
    inside = scratch.saved(family_links(docs, inner, words, percent, scratch), "inside")
    # 5: components and degrees
    both = links.union(links.select("b", "a"))
    outside = both.join(weights.withColumnRenamed("doc_id", "b"), "b").select(F.col("a").alias("doc_id"), F.col("m").alias("others"))
    degree = inside.select("doc_id", "others").union(outside).groupBy(F.col("doc_id").alias("rep")).agg(F.sum("others").alias("others"))
    label = components(links.union(inside.select("doc_id", "least"))).withColumnRenamed("id", "rep")
    found = classes.join(label, "rep", "left").join(degree, "rep", "left")
    found = found.select(*key, F.coalesce("component", "rep").alias("component_id"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = F.col("doc_id").isNotNull()
    out = made.select("doc_id", *key).join(found, key, "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
    out = saved(out, "near-groups")
    scratch.clear()
    return out
