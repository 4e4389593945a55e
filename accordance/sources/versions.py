"""Tables with versions: whole replacement, upserts by key, reads as of a version, differences.

A version is a manifest: for each bucket of keys the folder that holds its rows. A write stages new
folders and then moves one small file, the pointer, into place, which is all that makes it visible:
a write that fails leaves the old version, and readers keep the version that they began with. An upsert
rewrites only the buckets that its keys fall into. What a streamed batch has done is noted with the version, so
that a batch that is played again changes nothing.

One writer at a time. Folders that no kept version names go with ``expire``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """A table below ``root``, dealt by ``key`` into ``buckets``."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 16):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda p: self._hadoop.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- pointer and manifests -----------------------------------------------------------------

    def _text(self, path: str) -> str | None:
        if not self._fs.exists(self._path(path)):
            return None
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        """Writes a small file beside its place and moves it there in one step."""
        part = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.OVERWRITE
        context.rename(self._path(part), self._path(path), options)

    def current(self) -> int | None:
        """The last version, None before the first."""
        text = self._text(f"{self.root}/_current")
        return int(text) if text else None

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        text = self._text(f"{self.root}/_versions/{version}.json")
        if text is None:
            raise ValueError(f"no version {version} of {self.root}")
        return json.loads(text)

    # --- reads ---------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the current one by default; later writes don't touch what is read."""
        made = self.manifest(version)
        reader = self.spark.read.schema(made["schema"])
        folders = [f for _, f in sorted(made["folders"].items())]
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], made["schema"])

    def changes(self, before: int, after: int) -> DataFrame:
        """(key, change): added, removed or changed between two versions. Buckets whose folders are the same aren't read."""
        one, two = self.manifest(before), self.manifest(after)
        differ = [b for b in {*one["folders"], *two["folders"]} if one["folders"].get(b) != two["folders"].get(b)]
        if one["schema"] != two["schema"]:
            raise ValueError("versions of different columns can't be compared")

        def rows(made: dict, name: str) -> DataFrame:
            folders = [made["folders"][b] for b in differ if b in made["folders"]]
            df = self.spark.read.schema(made["schema"]).parquet(*folders) if folders else self.spark.createDataFrame([], made["schema"])
            return df.select(F.col(self.key).alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))

        both = rows(one, "old").join(rows(two, "new"), "key", "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
        return both.select("key", change.alias("change")).filter("change is not null")

    # --- writes --------------------------------------------------------------------------------

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _stage(self, df: DataFrame) -> dict[str, str]:
        """Writes rows by bucket into a new folder; the folders that came to be."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        self._bucketed(df).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(folder)
        found = self._fs.listStatus(self._path(folder))
        names = [found[i].getPath().getName() for i in range(len(found))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def _publish(self, folders: dict[str, str], schema: str, batches: dict[str, int]) -> int:
        version = (self.current() or 0) + 1
        self._put(f"{self.root}/_versions/{version}.json", json.dumps({"version": version, "schema": schema, "folders": folders, "batches": batches}))
        self._put(f"{self.root}/_current", str(version))
        return version

    def replace(self, df: DataFrame) -> int:
        """A version with these rows alone."""
        return self._publish(self._stage(df), ", ".join(f"`{c}` {t}" for c, t in df.dtypes), {})

    def upsert(self, batch: DataFrame, order: str, source: str | None = None, batch_id: int | None = None) -> int:
        """A version in which each key has the row of the greatest ``order``; of equal ones, the batch's. A batch_id of a source that is not beyond its last one changes nothing."""
        now = self.current()
        made = self.manifest(now) if now else {"schema": ", ".join(f"`{c}` {t}" for c, t in batch.dtypes), "folders": {}, "batches": {}}
        if source is not None and batch_id is not None and made["batches"].get(source, -1) >= batch_id:
            return now
        columns = [c for c, _ in batch.dtypes]
        touched = [str(r["_bucket"]) for r in self._bucketed(batch).select("_bucket").distinct().collect()]  # at most ``buckets``
        old = [made["folders"][b] for b in touched if b in made["folders"]]
        rows = batch.withColumn("_fresh", F.lit(1))
        if old:
            rows = self.spark.read.schema(made["schema"]).parquet(*old).select(*columns).withColumn("_fresh", F.lit(0)).unionByName(rows)
        best = F.max_by(F.struct(*columns), F.struct(F.col(order), F.col("_fresh"), F.xxhash64(*columns)))
        merged = rows.groupBy(F.col(self.key).alias("_key")).agg(best.alias("r")).select("r.*")
        batches = made["batches"] | ({source: batch_id} if source is not None and batch_id is not None else {})
        return self._publish(made["folders"] | self._stage(merged), made["schema"], batches)

    def upsert_stream(self, stream: DataFrame, order: str, source: str, checkpoint: str):
        """Upserts all that a stream has, batch by batch, and ends; started again it goes on where it ended."""
        work = lambda df, i: self.upsert(df, order, source, i) and None
        query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.current()

    def expire(self, keep: int = 2) -> list[int]:
        """Removes all versions but the last ``keep``, and the folders that only they name; the versions that went."""
        now = self.current() or 0
        known = {v: self.manifest(v) for v in range(1, now + 1) if self._fs.exists(self._path(f"{self.root}/_versions/{v}.json"))}
        gone = [v for v in known if v <= now - keep]
        held = {f for v, m in known.items() if v not in gone for f in m["folders"].values()}
        for v in gone:
            for folder in set(known[v]["folders"].values()) - held:
                self._fs.delete(self._path(folder), True)
            self._fs.delete(self._path(f"{self.root}/_versions/{v}.json"), False)
        return gone
