"""Sources: metadata dumps, line-delimited JSON, topic files, exclusion lists, magic bytes, fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXCLUSION_SCHEMA = "kind string, value string, received string"
# Fixed value: a flight log's first bytes.
LOG_MAGIC, LOG_LEAST = "554C6F67011235", 4096
TOPIC_COLUMNS = {
    "wind": "timestamp long, windspeed_north double, windspeed_east double, variance_north double, variance_east double",
    "vehicle_gps_position": "timestamp long, time_utc_usec long",
    "vehicle_global_position": "timestamp long, lat double, lon double",
    "vehicle_local_position": "z double, z_valid boolean",
}


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array file, also gzipped. It can't be split: write it as Parquet once."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """Line-delimited JSON; blank lines are skipped. ``strict``: a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def topic(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One topic of all runs under ``root`` (run/topic.parquet), with run_id from the path. Columns that a file lacks are null, unreadable files count as absent."""
    schema = T._parse_datatype_string(TOPIC_COLUMNS[name])
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(root).withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def run_directories(spark: SparkSession, root: str) -> DataFrame:
    """(run_id) of every directory with a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("run_id")).distinct()


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Objections. A missing list or a malformed line fails; an empty list is valid."""
    rows = json_lines(spark, path, EXCLUSION_SCHEMA, strict=True)
    valid = F.col("kind").isin("log_id", "vehicle_uuid") & (F.trim(F.coalesce("value", F.lit(""))) != "")
    return rows.withColumn("kind", F.when(valid, F.col("kind")).otherwise(F.raise_error(F.lit("invalid exclusion"))))


def topic_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(run_id, topic, rows, columns) of one topic written by run and topic: row counts, and the columns that hold anything."""
    kinds = T._parse_datatype_string(TOPIC_COLUMNS[name]).fields
    schema = T.StructType([*kinds, T.StructField("run_id", T.LongType()), T.StructField("topic", T.StringType())])
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(root).filter(F.col("topic") == name)
    present = [F.max(F.when(F.col(k.name).isNotNull(), F.lit(k.name))) for k in kinds]
    return rows.groupBy("run_id", "topic").agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(",", *present).alias("columns"))


def is_log(content: Column, length: Column, magic: str = LOG_MAGIC, least: int = LOG_LEAST) -> Column:
    """Long enough and with the first bytes of a log."""
    return (length >= least) & (F.hex(F.substring(content, 1, len(magic) // 2)) == magic)


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """(log_id, available) of the files under ``root``; only the first bytes of a file are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")  # no contents
    magic, least = bytes.fromhex(LOG_MAGIC), LOG_LEAST

    def first_bytes(batches):
        from pyarrow import fs

        for batch in batches:
            good = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                where, at = fs.FileSystem.from_uri(path)
                with where.open_input_stream(at) as f:
                    good.append(bool(length >= least and f.read(len(magic)) == magic))
            yield batch.assign(available=good)[["path", "available"]]

    name = F.element_at(F.split("path", "/"), -1)
    return found.mapInPandas(first_bytes, "path string, available boolean").select(F.regexp_replace(name, r"\.[^.]*$", "").alias("log_id"), "available")


def hours_spanned(start: Column, end: Column) -> Column:
    """Every hour from that of ``start`` to that of ``end``, both included; null unless start <= end in one month."""
    lo, hi = F.date_trunc("hour", start), F.date_trunc("hour", end)
    return F.when((start <= end) & (F.trunc(start, "month") == F.trunc(end, "month")), F.sequence(lo, hi, F.expr("interval 1 hour")))


def asked_hours(start: Column, end: Column) -> Column:
    """As ``hours_spanned``, but a span that runs backwards, crosses a month or has no end fails the query."""
    hours = hours_spanned(start, end)
    said = F.when(start.isNull() | end.isNull(), "a request without start or end").when(end < start, "a request that ends before it starts").otherwise("a request over more than one month; split it")
    return F.when(hours.isNull(), F.raise_error(said)).otherwise(hours)


def request_key(request: Column) -> Column:
    """A short digest of a request's canonical JSON; give a struct with its fields in sorted order."""
    return F.substring(F.sha2(F.to_json(request), 256), 1, 16)
