"""Line dedup by site-relative frequency.

A page is one row. Within each host, a line's share is the number of the host's pages that
contain it over the host's pages; lines whose share exceeds ``max_ratio`` are boilerplate and
leave every page of that host. Each distinct text of a host counts as one page, so that no
group of copies makes its own text boilerplate. A line needs ``min_pages`` pages in any case:
with fewer, no line can be told to repeat.

The ratio: a template's line stands on a good part of a site's pages, a phrase on a few in a
hundred. 0.07 leaves room on both sides; it is a parameter.

Plan: one aggregation of (host, 64-bit line hash), which combines on the map side, so that
a host with a third of all rows costs no more per task than any other; the lines that stay
above the ratio number at most (lines per page / max_ratio) for a host. They are written, and
their size is looked at: up to ``FEW_KEYS`` hashes are sent to the pages, which then aren't
shuffled; beyond that pages are dealt by (host, salt), so that no host stays in one task. A
rare line is lost by a hash collision only if it collides with one of its own host's few
boilerplate lines.

Defined cases: a null text stays null and counts as a page without lines; a null host is a
host of its own; blank lines are never boilerplate; a line that a page repeats counts once
for that page; repeated rows count as one page (by the text's 64-bit hash); very long texts are
split like others, within one row; an empty table gives an empty table; further columns of the input are kept, and names that clash with the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import saved

MAX_RATIO, MIN_PAGES = 0.07, 3
#: Hashes of 8 bytes, over all hosts, up to which a broadcast is cheaper than dealing the pages; and the salts beyond.
FEW_KEYS, SALTS = 1 << 20, 16


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_line_host, _line_drop): each host's boilerplate lines as hashes."""
    keys = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x)))
    counted = pages.select(F.col(host).alias("page_host"), F.xxhash64(text).alias("page_key"), keys.alias("line_keys"))
    counted = counted.groupBy("page_host", "page_key").agg(F.first("line_keys").alias("line_keys"))
    totals = counted.groupBy(F.col("page_host").alias("_line_host")).agg(F.count(F.lit(1)).alias("pages"))
    seen = counted.select(F.col("page_host").alias("line_host"), F.explode("line_keys").alias("line_key"))
    often = seen.groupBy("line_host", "line_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    over = often.join(totals, often["line_host"].eqNullSafe(totals["_line_host"])).filter(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("_line_host").agg(F.collect_list("line_key").alias("_line_drop"))


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, few_keys: int = FEW_KEYS) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and the counts n_lines and n_dropped."""
    over = saved(boilerplate(pages, host, text, max_ratio, min_pages), "over")
    held = over.agg(F.sum(F.size("_line_drop") + 1)).first()[0] or 0
    base = pages.drop("n_lines", "n_dropped", "_line_host", "_line_drop", "_line_kept", "_line_salt")
    if held <= few_keys:
        joined = base.join(F.broadcast(over), base[host].eqNullSafe(over["_line_host"]), "left")
    else:
        salted = over.withColumn("_line_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")
        joined = base.join(salted, base[host].eqNullSafe(salted["_line_host"]) & (salt == salted["_line_salt"]), "left")
    kept = F.filter(_lines(text), lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_line_drop"), F.xxhash64(x)))
    n_lines = F.coalesce(F.size(_lines(text)), F.lit(0))
    joined = joined.withColumn("_line_kept", F.when(F.col("_line_drop").isNotNull(), kept))
    n_dropped = F.when(F.col("_line_kept").isNotNull(), n_lines - F.size("_line_kept")).otherwise(F.lit(0))
    columns = [F.when(F.col("_line_kept").isNotNull(), F.array_join("_line_kept", "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in base.columns]
    return joined.select(*columns, F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
