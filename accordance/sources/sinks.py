"""Sinks, and a record of what was written: a table's shape and its content's digest.

The record is itself a DataFrame row, computed by Spark from the written table, so that it
works wherever Spark can read: no file is opened on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one file for each partition; Spark's commit makes them visible together."""
    df.write.mode(mode).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small summary as a single JSON file: one row, or a few."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_observations(df: DataFrame, path: str) -> None:
    """Adds to an observation log; the last attempt wins when it is read."""
    df.write.mode("append").parquet(path)


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and a digest that doesn't depend on their order: sums of two halves of each row's SHA-256, modulo 2**48."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(20,0)")
    total = lambda at: F.lpad(F.lower(F.conv(F.coalesce(F.sum(half(at)) % F.lit(1 << 48), F.lit(0)).cast("string"), 10, 16)), 12, "0")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat(total(1), total(13)).alias("digest"))


def recorded(df: DataFrame, path: str, name: str, seed: int | None = None, revision: str | None = None, clean: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet and gives its record, made from what can be read back."""
    spark: SparkSession = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    parts = back.select(F.col("_metadata.file_path").alias("file")).distinct().agg(F.count(F.lit(1)).alias("part_files"))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in back.schema.fields)
    shape = content_digest(back).crossJoin(parts)  # one row each
    return shape.select(F.lit(name).alias("name"), F.lit(path).alias("path"), "rows", "part_files", F.lit(columns).alias("columns"), "digest", F.lit(seed).cast("long").alias("seed"), F.lit(revision).cast("string").alias("revision"), F.lit(clean).alias("clean"))


def intact(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(name, intact): whether each recorded table still has the rows and digest of its record. Records are few: one for each table."""
    found = None
    for r in records.select("name", "path", "columns", "rows", "digest").toLocalIterator():
        now = content_digest(spark.read.schema(r["columns"]).parquet(r["path"])).select(F.lit(r["name"]).alias("name"), ((F.col("rows") == r["rows"]) & (F.col("digest") == r["digest"])).alias("intact"))
        found = now if found is None else found.unionByName(now)
    return found if found is not None else spark.createDataFrame([], "name string, intact boolean")


def publishable(records: DataFrame) -> DataFrame:
    """The records, failing the query for one whose code is unknown or has changes."""
    known = F.col("clean") & F.col("revision").isNotNull()
    return records.withColumn("clean", F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("not publishable, its code isn't a known state: "), F.col("name")))))


def write_arrays(df: DataFrame, path: str) -> None:
    """JSON arrays of records, one file for each partition."""

    def bracketed(frames):
        import pandas as pd

        lead = "["
        for frame in frames:
            if len(frame):
                lines = [f"{lead if not i else ','}{x}" for i, x in enumerate(frame["value"])]
                lead = ","
                yield pd.DataFrame({"value": lines})
        yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})

    whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    df.select(whole).mapInPandas(bracketed, "value string").write.mode("overwrite").text(path)


#: What a manifest must hold: what was made, from what, by which code and versions.
MANIFEST = {
    "type": "object", "required": ["name", "rows", "digest", "inputs", "versions"],
    "properties": {
        "name": {"type": "string", "minLength": 1}, "rows": {"type": "integer", "minimum": 0}, "digest": {"type": "string", "pattern": "^[0-9a-f]{24}$"},
        "inputs": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["name", "rows", "digest"], "properties": {"name": {"type": "string"}, "rows": {"type": "integer", "minimum": 0}, "digest": {"type": "string", "pattern": "^[0-9a-f]{24}$"}}}},
        "versions": {"type": "object", "required": ["spark", "python"], "additionalProperties": {"type": "string"}},
    },
}


def manifest(record: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """(name, manifest) from the record of a written table: its inputs' rows and digests beside its own, and the versions it was made with, as JSON."""
    import platform

    read = None
    for name, df in inputs.items():
        own = content_digest(df).select(F.lit(name).alias("name"), "rows", "digest")
        read = own if read is None else read.unionByName(own)
    many = read.agg(F.array_sort(F.collect_list(F.struct("name", "rows", "digest"))).alias("inputs"))  # one row for each input
    versions = F.struct(F.lit(record.sparkSession.version).alias("spark"), F.lit(platform.python_version()).alias("python"))
    return record.crossJoin(F.broadcast(many)).select("name", F.to_json(F.struct("name", "rows", "digest", "inputs", versions.alias("versions"), "seed", "revision", "columns")).alias("manifest"))
