"""Helpers that the training-data operators share: tables, the shared folder, byte kernels."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
_BATCH_BYTES, BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Makes Python workers, which serve many stages, give large freed blocks back to the system.
_GIVE_BACK = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}
ROOT = str(Path(__file__).resolve().parents[2])
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Puts this package on the Python workers' path when it is run from a checkout.

    On a cluster the package is installed or sent with ``--py-files``; the path added here
    is then simply absent. The session keeps the path, the workers' settings of memory and the
    smaller batches, as plans are lazy and run after the operator has returned.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    for name, value in _GIVE_BACK.items():
        env.setdefault(name, value)
    for name, most in ((_BATCH, ROWS_PER_BATCH), (_BATCH_BYTES, BYTES_PER_BATCH)):
        have = spark.conf.get(name)
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a local session gets a temporary one, as in tests; a cluster is refused.

    On a cluster a machine's own folder would lose rows without an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _OWN.setdefault("folder", tempfile.mkdtemp(prefix="spark-accordance-"))
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables of one run in a folder of their own below the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back, which cuts its lineage.

        Where Spark has the setting, the shuffle files of the written query go when it has ended.
        """
        self.tables += 1
        path = f"{self.folder}/{self.tables}-{name}"
        was = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, was) if was else self.spark.conf.unset(_CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Empties tables that nothing reads any more: each is overwritten by one without rows."""
        for df in tables:
            for file in df.inputFiles()[:1]:
                self._empty(df.schema, file.rsplit("/", 1)[0])

    def clear(self) -> None:
        """Empties the whole folder; nothing that is still to be read may lie in it."""
        if self.tables:
            self._empty(T.StructType([T.StructField("gone", T.IntegerType())]), self.folder)

    def _empty(self, schema: T.StructType, path: str) -> None:
        """createDataFrame would make executors start Python workers of their own kind, beside those of the operators."""
        self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(path)


def saved(df: DataFrame, label: str) -> DataFrame:
    """A table that a result still reads, in a folder of its own."""
    return Scratch(df.sparkSession, label).saved(df, "table")


def text_buffers(column: pa.Array, most: int = 4 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of about ``most`` bytes and at most ``rows`` rows.

    Yields (first row, row after the last, bytes, offsets from the run's start); null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, row + rows)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


# --- 64-bit hashing in numpy; products and sums wrap, which is meant -------------------------

ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


#: Substrings are hashed by polynomials in two bases modulo the prime 2**31 - 1. (A power of two as
#: modulus would be defeated by words like Thue and Morse's, whatever the base.)
PRIME = (1 << 31) - 1
_P, _S31P = np.uint64(PRIME), np.uint64(31)
_BASES = (1_664_525_013, 1_013_904_223)
#: A random value for each byte in either lane.
BYTE_CODE = np.stack([mix64(np.arange(1, 257, dtype=np.uint64) * ODD + np.uint64(k)) % _P for k in (0, 1)])
_POWERS: dict[str, np.ndarray] = {"up": np.ones((2, 1), np.uint32), "down": np.ones((2, 1), np.uint32)}
#: Bytes that are hashed at once, and by which the table of powers grows; a worker keeps 16 bytes for each byte of its longest text.
_BLOCK = 1 << 17


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & _P) + (x >> _S31P)
    return np.where(x >= _P, x - _P, x)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i of both lanes for i < n."""
    have = _POWERS["up"].shape[1]
    if have < n:
        size = -(-n // _BLOCK) * _BLOCK
        for name, bases in (("up", _BASES), ("down", tuple(pow(b, -1, PRIME) for b in _BASES))):
            out = np.empty((2, size), np.uint32)
            out[:, :have] = _POWERS[name]
            done = have
            while done < size:  # what follows is what is there, times base**done
                more = np.array([[pow(b, done, PRIME)] for b in bases], np.uint64)
                step = min(done, size - done, _BLOCK)
                out[:, done : done + step] = _reduced(out[:, :step] * more)
                done += step
            _POWERS[name] = out
    return _POWERS["up"][:, :n], _POWERS["down"][:, :n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[:, i] = sum of code(byte j) * base**j over j < i in both lanes, so that any substring's hash is a difference."""
    up, _ = _powers(len(data) + 1)
    h = np.zeros((2, len(data) + 1), np.uint64)
    for lane in range(2):
        for at in range(0, len(data), _BLOCK):
            stop = min(at + _BLOCK, len(data))
            np.cumsum(_reduced(BYTE_CODE[lane][data[at:stop]] * up[lane, at:stop]), out=h[lane, at + 1 : stop + 1])
            h[lane, at + 1 : stop + 1] += h[lane, at]
    return h


def substring_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, stop), equal for equal strings wherever they stand."""
    _, down = _powers(h.shape[1])
    one, two = (_reduced(_reduced(h[lane, stop] - h[lane, start]) * down[lane, start]) for lane in range(2))
    return mix64((one << _S31P | two) + (stop - start).astype(np.uint64) * _M1)


def plus(schema: T.StructType, **kinds: str) -> T.StructType:
    """``schema`` with further fields, given as name=type."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in kinds.items())).fields])


#: ASCII white space, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and row of each word; words are runs without ASCII white space and don't cross texts."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    first[edge] = solid[edge]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    # a word ends at the next white space or at the end of its text
    gaps = np.flatnonzero(~solid)
    at = np.searchsorted(gaps, starts)
    stops = np.where(at < len(gaps), gaps[np.minimum(at, max(len(gaps) - 1, 0))], len(data)) if len(gaps) else np.full(len(starts), len(data))
    return starts, np.minimum(stops, offsets[row + 1]), row
