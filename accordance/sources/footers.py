"""What Parquet files say of themselves: schemas, row groups and row counts, read from footers in tasks.

No data page is read, and the table is as long as there are files and columns. A column whose
values are all null is present, as its file declares it. A file that can't be read gives one row with its reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = "path string, readable boolean, reason string, row_groups int, rows long, column string, kind string, nulls long"


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    names = [k.split()[0] for k in _KINDS.split(", ")]
    for df in frames:
        rows = []
        for path in df["path"]:
            try:
                where, at = fs.FileSystem.from_uri(path)
                with where.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
            except Exception as failed:  # noqa: BLE001  whatever is wrong with a file, it is said in its row
                rows.append((path, False, type(failed).__name__, None, None, None, None, None))
                continue
            groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
            for i in range(meta.num_columns):
                stats = [g.column(i).statistics for g in groups]
                nulls = sum(s.null_count for s in stats) if all(s is not None and s.has_null_count for s in stats) else None
                column = meta.schema.column(i)
                rows.append((path, True, None, meta.num_row_groups, meta.num_rows, column.path, str(column.logical_type) if str(column.logical_type) != "None" else column.physical_type, nulls))
        yield pd.DataFrame(rows, columns=names).astype({"row_groups": "Int32", "rows": "Int64", "nulls": "Int64"})


def parquet_footers(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, readable, reason, row_groups, rows, column, kind, nulls): a row for each column of each file under ``root``, one for an unreadable file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")  # no contents
    return files.repartition(max(2, spark.sparkContext.defaultParallelism)).mapInPandas(_footers, _KINDS)


def topic_presence(footers: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(run_id, topic, files, rows, columns, complete) from footers with run_id and topic: the columns that all files of a topic declare, and whether the required ones are among them.

    A topic without files has no row; one with a file that can't be read counts as absent: its rows and columns are null.
    """
    files = footers.groupBy("run_id", "topic", "path").agg(F.first("rows").alias("rows"), F.first("readable").alias("readable"), F.collect_set("column").alias("_c"))  # a file's columns
    shared = F.aggregate("_all", F.get("_all", F.lit(0)), lambda x, y: F.array_intersect(x, y))
    own = files.groupBy("run_id", "topic").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.bool_and("readable").alias("readable"), F.collect_set("_c").alias("_all")).withColumn("_c", F.array_sort(shared))
    complete = F.lit(True)
    for topic, columns in required.items():
        complete = F.when(F.col("topic") == topic, F.size(F.array_except(F.array(*map(F.lit, columns)), "_c")) == 0).otherwise(complete)
    return own.select("run_id", "topic", "files", F.when(F.col("readable"), F.col("rows")).alias("rows"), F.when(F.col("readable"), F.array_join("_c", ",")).alias("columns"), (F.col("readable") & complete).alias("complete"))
