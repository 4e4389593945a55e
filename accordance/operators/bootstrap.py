"""Percentile bootstrap that draws whole runs, with replacement, within strata: small numbers of resamples as rows.

A draw is a hash of (seed, resample, stratum, slot), so that it is the same on every run,
engine and partitioning, and SQL can make it too. Biases come from sufficient statistics of
runs, which meet their draws in spans of slots: a draw moves as four bytes, and no row is made of it. Quantiles
weigh each window by its run's number of draws, which stands for so many
repeated rows. For thousands of resamples see ``resample``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordance.operators.ranking import linear_quantiles, ranked, weighted_quantiles
from accordance.operators.tables import written

INTERVAL = {"low": 0.025, "high": 0.975}
#: Bits of a slot within a span; resamples drawn for a row at a time; draws that a task holds before it gives them out.
SPAN, ABREAST, HELD = 14, 20, 4_000_000


def _hashed(b: Column, seed: int) -> Column:
    """The first eight digits of a draw's hash; they pick a slot, modulo the stratum's runs."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), b, "stratum", "slot")), 1, 8)


def numbered_runs(df: DataFrame) -> DataFrame:
    """(stratum, run_id, slot, runs): runs numbered from 0 within their stratum, by id, or by a hash of ids that aren't numbers."""
    return _numbered(written(df.select("stratum", "run_id").distinct(), "runs"))


def _numbered(runs: DataFrame, *more: str) -> DataFrame:
    number = F.xxhash64("run_id") if dict(runs.dtypes)["run_id"] == "string" else F.col("run_id")
    runs = ranked(runs.withColumn("_number", number), ["stratum"], "_number", ["run_id"])
    return written(runs.select("stratum", "run_id", *more, (F.col("rank") - 1).alias("slot"), F.col("group_n").alias("runs")), "slots")  # read twice by draws


def draws(runs: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(b, stratum, run_id, m): how often each run is drawn in each resample; runs(stratum, run_id, slot, runs)."""
    slots = runs.select("stratum", "slot", "runs").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    pick = F.pmod(F.conv(_hashed(F.col("b"), seed), 16, 10).cast("long"), F.col("runs"))
    chosen = slots.select("b", "stratum", pick.alias("slot")).groupBy("b", "stratum", "slot").agg(F.count(F.lit(1)).alias("m"))
    return chosen.join(runs.select("stratum", "slot", "run_id"), ["stratum", "slot"]).select("b", "stratum", "run_id", "m")


def bias_interval(df: DataFrame, drawn: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """2.5 and 97.5 percentiles of the mean of each value over resamples, from (n, sum) of each run."""
    sums = df.groupBy(*by, "stratum", "run_id").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    each = sums.join(drawn, ["stratum", "run_id"]).groupBy(*by, "b").agg(*[(F.sum(F.col("m") * F.col(f"_s_{v}")) / F.sum(F.col("m") * F.col("_n"))).alias(v) for v in values])
    tall = each.unpivot([*by, "b"], list(values), "statistic", "value")
    return linear_quantiles(tall, [*by, "statistic"], "value", INTERVAL)


def packed_draws(slots: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(stratum, span, data): the picks of all slots, as numbers of the resample and of the slot in its span, four bytes each."""
    if resamples > 1 << (32 - SPAN):
        raise ValueError("too many resamples for four bytes a draw")
    first = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(ABREAST)))
    abreast = range(min(ABREAST, resamples))
    rows = slots.select("stratum", "slot", "runs", first.alias("b")).select("stratum", "b", "runs", *[F.unhex(_hashed(F.col("b") + k, seed)).alias(f"h{k}") for k in abreast])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for stratum, parts in held.items():
                span, code = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(span, kind="stable")
                span, code = span[order], code[order]
                at = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
                data = [code[begin:end].tobytes() for begin, end in zip(at, [*at[1:], len(code)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([stratum] * len(at), pa.string()), pa.array(span[at].astype(np.int64)), pa.array(data, pa.binary())], names=["stratum", "span", "data"])
            held.clear()

        for batch in batches:
            b = batch.column("b").to_numpy()
            strata = batch.column("stratum").dictionary_encode()
            of = strata.indices.to_numpy()
            hashes = [np.frombuffer(batch.column(f"h{k}").cast(pa.binary(4)).buffers()[1], ">u4", len(b)) for k in abreast]
            picks = np.stack(hashes, 1).astype(np.int64) % batch.column("runs").to_numpy()[:, None]
            each = b[:, None] + np.arange(picks.shape[1])
            for i, stratum in enumerate(strata.dictionary.to_pylist()):
                mine = of == i
                own, number = picks[mine], each[mine]
                there = number < resamples
                own, number = own[there], number[there]
                held.setdefault(stratum, []).append(((own >> SPAN).astype(np.uint32), (number << SPAN | own & (1 << SPAN) - 1).astype(np.uint32)))
                size += len(own)
            if size > HELD:
                yield from flushed()
                size = 0
        yield from flushed()

    return rows.mapInArrow(run, "stratum string, span long, data binary")


def bias_intervals(df: DataFrame, resamples: int, seed: int, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """As ``bias_interval`` of ``draws``: sums of runs are numbered with their slots, and each span of slots is multiplied by its draws in one task."""
    by, values = list(by), list(values)
    sums = df.filter("stratum IS NOT NULL AND run_id IS NOT NULL").groupBy("stratum", "run_id", *by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).cast("double").alias(f"_s{i}") for i, v in enumerate(values)])
    own = F.collect_list(F.struct(*by, "_n", *[f"_s{i}" for i in range(len(values))]))
    slots = _numbered(written(sums.groupBy("stratum", "run_id").agg(own.alias("_own")), "run-sums"), "_own")
    names = [f"_t{i}" for i in range(len(values))]
    kinds = dict(df.select(*by).dtypes)

    def run(runs: pa.Table, picks: pa.Table) -> pa.Table:
        span = 1 << SPAN
        code = np.concatenate([np.frombuffer(x, np.uint32) for x in picks.column("data").to_pylist()] or [np.zeros(0, np.uint32)])
        m = np.bincount(code, minlength=resamples << SPAN).reshape(resamples, span).astype(np.float64)
        lists = runs.column("_own").combine_chunks()
        place = np.repeat(runs.column("slot").to_numpy() & span - 1, lists.value_lengths().to_numpy())
        each = lists.flatten()
        keys = [each.field(c).to_pylist() for c in by]
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*keys, strict=True) if by else [()] * len(place)):
            groups.setdefault(k, []).append(i)
        out = []
        for k, mine in groups.items():
            at, columns = place[mine], {"_n": m[:, place[mine]] @ each.field("_n").to_numpy()[mine].astype(np.float64)}
            for i, name in enumerate(names):
                x = each.field(f"_s{i}").to_numpy(zero_copy_only=False)[mine].astype(np.float64)
                known = each.field(f"_s{i}").is_valid().to_numpy(zero_copy_only=False)[mine]
                usual = known & np.isfinite(x)
                total = m[:, at[usual]] @ x[usual]
                for j in np.flatnonzero(known & ~usual):  # only where it is drawn
                    total[m[:, at[j]] > 0] += x[j]
                columns[name] = pa.array(total, mask=~(m[:, at[known]] > 0).any(1))
            out.append(pa.table({c: pa.array([v] * resamples, each.field(c).type) for c, v in zip(by, k, strict=True)} | {"b": pa.array(np.arange(resamples, dtype=np.int32))} | columns))
        return pa.concat_tables(out) if out else pa.table({**{c: pa.array([], each.field(c).type) for c in by}, "b": pa.array([], pa.int32()), **{c: pa.array([], pa.float64()) for c in ("_n", *names)}})

    spark, key = df.sparkSession, ["stratum", "span"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)  # few bytes may be many draws
    runs = slots.select("stratum", F.shiftright("slot", SPAN).alias("span"), "slot", "_own").repartition(tasks, *key)
    picks = packed_draws(slots, resamples, seed).repartition(tasks, *key)
    each = runs.groupBy(*key).cogroup(picks.groupBy(*key)).applyInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in by], "b int", "_n double", *[f"{c} double" for c in names]]))
    each = each.groupBy(*by, "b").agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in names]).filter("_n > 0")
    each = written(each.select(*by, "b", *[(F.col(c) / F.col("_n")).alias(v) for c, v in zip(names, values, strict=True)]), "resamples")
    return linear_quantiles(each.unpivot([*by, "b"], values, "statistic", "value"), [*by, "statistic"], "value", INTERVAL)


def quantile_interval(df: DataFrame, drawn: DataFrame, value: str, quantile: float, by: Sequence[str]) -> DataFrame:
    """2.5 and 97.5 percentiles over resamples of a quantile at positions (i - 1/2) / n of the repeated rows, which stand as one row weighed by its draws."""
    # a row meets its run's draws once, at most one for each resample, and is repeated as it is read
    own = drawn.groupBy("stratum", "run_id").agg(F.collect_list(F.struct("b", "m")).alias("_drawn"))
    rows = written(df.select("stratum", "run_id", *by, value).join(own, ["stratum", "run_id"]).select(*by, value, "_drawn"), "drawn").select(*by, value, F.inline("_drawn"))
    each = weighted_quantiles(rows, [*by, "b"], value, "m", {"value": quantile}, copies=True)
    return linear_quantiles(each, list(by), "value", INTERVAL)
