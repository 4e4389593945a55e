"""Late rows of a stream, given out apart instead of being dropped.

Spark drops rows behind the watermark without a trace where a window is closed. Here a stateful
operator sees every row with the watermark that holds for its batch, and marks it: late, if the
window that it belongs to had ended by the watermark. Rows on time and late rows go to tables of
their own, one folder for each batch, so that a batch that is played again replaces what it wrote. State
is one counter for each group. A call of the operator costs more than its rows do, so that it is called for
buckets of many groups, each with its groups' counters; rows without a key are a bucket of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


#: Buckets of groups. A stream's state is dealt by it: another number needs another checkpoint.
BUCKETS = 1024


def marked(stream: DataFrame, key: str, window_s: int = 3600, delay: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """``stream`` (with ts) and ``late``, ``seen``: whether a row came after its window had been closed, and the group's rows so far."""
    timed = stream.withWatermark("ts", delay)
    kinds = ", ".join(f"`{c}` {t}" for c, t in timed.dtypes)

    def run(_, frames, state):
        import pandas as pd

        seen = dict(zip(*state.get)) if state.exists else {}
        mark = state.getCurrentWatermarkMs()
        for df in frames:
            ends = (df["ts"].astype("int64") // (10**9 if str(df["ts"].dtype).startswith("datetime64[ns") else 10**6) // window_s + 1) * window_s * 1000
            groups = [None if x != x else x for x in df[key].tolist()]  # a missing number comes as one that isn't equal to itself
            now = pd.Series(groups, dtype=object).value_counts(dropna=False).to_dict()
            for group, n in now.items():
                seen[group] = seen.get(group, 0) + n
            yield df.drop(columns="_bucket").assign(late=(ends <= mark) if mark > 0 else pd.Series(False, df.index), seen=[seen[x] for x in groups])
        state.update((list(seen), list(seen.values())))

    bucket = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).otherwise(-1)
    held = f"groups array<{dict(timed.dtypes)[key]}>, seen array<long>"
    return timed.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(run, f"{kinds}, late boolean, seen long", held, "append", GroupStateTimeout.NoTimeout)


def split_stream(stream: DataFrame, key: str, root: str, window_s: int = 3600, delay: str = "2 hours") -> tuple[DataFrame, DataFrame]:
    """Runs the stream over all that it has; (rows on time, late rows), each with the batch they came in."""
    spark = stream.sparkSession

    def work(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").partitionBy("late").parquet(f"{root}/rows/batch={batch}")

    marked(stream, key, window_s, delay).writeStream.foreachBatch(work).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    kinds = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    rows = spark.read.schema(f"{kinds}, seen long, late boolean, batch int").parquet(f"{root}/rows")
    return rows.filter("not late").drop("late"), rows.filter("late").drop("late")
