"""Quality rules with verdicts on hosts.

Every document is judged by rules on its own words, lines and symbols. A host (``source``) is
then judged by how often its documents fail each rule. A share of few documents says little, so
shares are shrunk: over all hosts a beta prior is fitted to each rule (empirical Bayes), and a
host's rate is the posterior mean (failed + a) / (documents + a + b).

The prior comes from factorial moments, hosts weighing alike: the mean of k / n estimates the
mean rate, and that of k (k - 1) / (n (n - 1)), over hosts of two documents or more, the mean
square, free of the binomial noise. Both are summed in millionths of a millionth as integers, so
the result doesn't depend on the order of rows. Where hosts differ less than chance explains
(or there is one only), the prior is as strong as ``STRONGEST`` documents.

Verdicts, joined back to documents: a host whose rate for any rule exceeds ``REJECT`` goes as a
whole; where a rate exceeds ``WATCH`` times the prior's mean, and ``LEAST`` at least, the
documents that fail that rule themselves go. Documents that fail a base rule go in any case.

Hosts are counted with partial sums before the shuffle, so that a host of a third of all rows
costs one row a task; the table of hosts is joined back by Spark's choice of join.

Rules: ``short`` (fewer than 50 words) and ``repeats`` (more than half of the words lie in
repeated three-word windows) are the base; ``symbols`` (more than one symbol for ten words),
``lines`` (more than 30 % of the lines with a word repeat an earlier one) and ``length`` (words
of under 2.5 or over 12 code points on average) count for hosts only.

Defined cases: null texts have no words and fail ``short``; so do empty ones; a null source is
a host of its own; very long texts are read whole; repeated rows count each; an empty table
gives an empty table; columns of the same names as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import Scratch, importable, plus, saved

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
RULES = ["short", "repeats", "symbols", "lines", "length"]
BASE = ["short", "repeats"]
REJECT, WATCH, LEAST, STRONGEST = 0.5, 3.0, 0.05, 1000
_WIDE = 1 << 21
_STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long"}


def repeated_words(codes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each document, its words that lie in a three-word window which the document holds twice or more.

    ``codes`` numbers the words (equal numbers, equal words), ``doc`` their documents in order.
    """
    out = np.zeros(docs, np.int64)
    if len(codes) < 4:
        return out
    whole = doc[2:] == doc[:-2]
    if codes.max() >= _WIDE:  # pairs are numbered first, so that a window still fits one integer
        pair = np.unique(codes[:-1] << 32 | codes[1:], return_inverse=True)[1]
        window = pair[:-1] << 32 | codes[2:]
    else:
        window = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    at = np.flatnonzero(whole)
    at = at[np.lexsort((window[at], doc[at]))]
    same = (window[at[1:]] == window[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    again = np.zeros(len(at), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(codes), bool)
    for shift in range(3):
        covered[at[again] + shift] = True
    return out + np.bincount(doc[covered], minlength=docs)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _measure(texts: list[str | None]) -> list[list[int]]:
    """The columns of ``_STATS`` for some texts."""
    out, numbers, codes, sizes = [[0] * len(texts) for _ in _STATS], _Numbers(), [], []
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "replace").split() if text else []  # bytes are split at ASCII white space only
        codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        if words:
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            found = (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines))
            for column, x in zip(out, found, strict=True):
                column[i] = x
    out[4] = repeated_words(np.concatenate(codes), np.repeat(np.arange(len(texts)), sizes), len(texts)).tolist() if texts else []
    return out


def _measured(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, columns, some, held = batch.column("text").to_pylist(), [[] for _ in _STATS], [], 0
        for i, text in enumerate(texts):
            some.append(text)
            held += len(text or "")
            if held > most or i + 1 == len(texts):
                for column, x in zip(columns, _measure(some), strict=True):
                    column.extend(x)
                some, held = [], 0
        keep = [j for j, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in keep), *(pa.array(c, pa.int64()) for c in columns)], [*(batch.schema.names[j] for j in keep), *_STATS])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source and the figures that the rules read, for every row."""
    importable(docs.sparkSession)
    own = docs.select("doc_id", "source", "text")
    return own.mapInArrow(_measured, plus(own.drop("text").schema, **_STATS))


def failures() -> dict[str, Column]:
    """Each rule as a condition on the figures."""
    n = F.col("n_words")
    return {
        "short": n < 50, "repeats": 100 * F.col("n_repeat_words") > 50 * n, "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), "length": (n > 0) & ((10 * F.col("word_chars") < 25 * n) | (F.col("word_chars") > 12 * n)),
    }


def host_rates(failed: DataFrame, reject: float = REJECT, watch: float = WATCH, least: float = LEAST) -> DataFrame:
    """One row for each source: n, and for each rule its failures k_, shrunken rate r_, and the rule's mean m_ and strength s_; the verdicts ``rejected`` and w_.

    ``failed`` has source and a boolean f_ for each rule.
    """
    hosts = failed.groupBy(F.col("source").alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"f_{r}").cast("long")).alias(f"k_{r}") for r in RULES])
    share = lambda x, of: F.round(x / of * 1e12).cast("decimal(38,0)")
    pairs = F.col("n").cast("double") * (F.col("n") - 1)
    sums = []
    for r in RULES:
        k = F.col(f"k_{r}").cast("double")
        sums += [F.sum(share(k, F.col("n"))).cast("double").alias(f"a_{r}"), F.sum(F.when(F.col("n") > 1, share(k * (k - 1), pairs))).cast("double").alias(f"b_{r}")]
    prior = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.count(F.when(F.col("n") > 1, 1)).alias("larger"), *sums)
    for r in RULES:
        m, q = F.col(f"a_{r}") / F.col("hosts") / 1e12, F.col(f"b_{r}") / F.col("larger") / 1e12
        prior = prior.withColumn(f"m_{r}", m).withColumn(f"v_{r}", q - m * m)
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.least(F.lit(float(STRONGEST)), F.greatest(F.lit(0.0), m * (1 - m) / v - 1))).otherwise(F.lit(float(STRONGEST)))
        prior = prior.withColumn(f"s_{r}", strength)
    out = hosts.crossJoin(F.broadcast(prior.select(*[f"{x}_{r}" for r in RULES for x in "ms"])))  # one row
    for r in RULES:
        s, m = F.col(f"s_{r}"), F.col(f"m_{r}")
        out = out.withColumn(f"r_{r}", (F.col(f"k_{r}") + s * m) / (F.col("n") + s))
        out = out.withColumn(f"w_{r}", (F.col(f"r_{r}") > watch * m) & (F.col(f"r_{r}") > least))
    return out.withColumn("rejected", F.greatest(*[F.col(f"r_{r}") for r in RULES]) > reject)


def host_verdicts(docs: DataFrame, reject: float = REJECT, watch: float = WATCH, least: float = LEAST) -> DataFrame:
    """The figures of each row, base_failed, host_rejected, host_rate (the largest) and kept."""
    scratch = Scratch(docs.sparkSession, "host-rules")
    figures = measured(docs)
    for name, condition in failures().items():
        figures = figures.withColumn(f"f_{name}", condition)
    figures = scratch.saved(figures, "figures")
    hosts = host_rates(figures, reject, watch, least)
    hosts = hosts.select("host", "rejected", F.greatest(*[F.col(f"r_{r}") for r in RULES]).alias("host_rate"), *[f"w_{r}" for r in RULES])
    both = figures.join(hosts, figures["source"].eqNullSafe(hosts["host"]), "left")
    base, watched = F.lit(False), F.lit(False)
    for r in RULES:
        watched |= F.col(f"w_{r}") & F.col(f"f_{r}")
        base = base | F.col(f"f_{r}") if r in BASE else base
    out = both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.col("rejected").alias("host_rejected"), "host_rate", (~base & ~F.col("rejected") & ~watched).alias("kept"))
    out = saved(out, "verdicts")
    scratch.clear()
    return out
