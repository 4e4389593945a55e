"""Fields in chunk files, as grid archives hold them: one variable's values over a box of space and a span of time.

A store is a folder for each variable with a ``.zarray`` (shape, chunks, dtype, compressor zlib or none,
order C, fill_value: version 2 of the common chunked array layout) and a file for each chunk, named by
its place (``time.lat.lon``). Chunks of fill values only have no file.

A point read opens the chunks that are asked for and no others: distinct points are dealt by their
chunk, so that a chunk is opened by one task, once, and a chunk's points are no more than its cells.
Writing is the same the other way round. Chunk files are moved into place under their own names when they
are whole, so that a task that is run again writes the same file.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("t", "la", "lo")


def _fs(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _importable(spark: SparkSession) -> None:
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])  # so that workers can import this module
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root


def header(shape: Sequence[int], chunks: Sequence[int], dtype: str = "<f8", level: int | None = 1) -> dict:
    return {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "order": "C", "fill_value": "NaN", "filters": None, "compressor": None if level is None else {"id": "zlib", "level": level}}


def chunk_of(chunks: Sequence[int]) -> Column:
    """The name of the chunk that holds a place (t, la, lo)."""
    return F.concat_ws(".", *[F.floor(F.col(a) / n).cast("string") for a, n in zip(AXES, chunks, strict=True)])


def write_chunks(field: DataFrame, root: str, variables: Sequence[str], head: dict) -> DataFrame:
    """Writes (t, la, lo, variables...) as chunk files; gives (variable, chunk, cells) of what was written.

    Null values are left out; a chunk has at most as many rows as cells.
    """
    _importable(field.sparkSession)
    where, base = _fs(root)
    for v in variables:
        where.create_dir(f"{base}/{v}", recursive=True)
        with where.open_output_stream(f"{base}/{v}/.zarray") as f:
            f.write(json.dumps(head).encode())
    size = head["chunks"]

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        variable, chunk = rows["variable"].iloc[0], rows["chunk"].iloc[0]
        box = np.full(size, np.nan, head["dtype"])
        box[tuple(rows[a].to_numpy() % n for a, n in zip(AXES, size, strict=True))] = rows["value"]
        data = box.tobytes()
        if head["compressor"]:
            data = zlib.compress(data, head["compressor"]["level"])
        to, folder = _fs(root)
        part = f"{folder}/{variable}/.{chunk}-{uuid.uuid4().hex}"
        with to.open_output_stream(part) as f:
            f.write(data)
        to.move(part, f"{folder}/{variable}/{chunk}")
        return pd.DataFrame({"variable": [variable], "chunk": [chunk], "cells": [len(rows)]})

    tall = field.select(*[F.col(a).cast("long").alias(a) for a in AXES], *variables).unpivot(list(AXES), list(variables), "variable", "value").filter("value is not null")
    return tall.withColumn("chunk", chunk_of(size)).groupBy("variable", "chunk").applyInPandas(write, "variable string, chunk string, cells long")


def read_points(points: DataFrame, root: str, variables: Sequence[str]) -> DataFrame:
    """The distinct points (t, la, lo) with a column for each variable, null where the field has nothing, and ``opened``: whether the point's chunk has a file.

    Places outside the field's shape have no value; nulls among the points are no places.
    """
    spark = points.sparkSession
    _importable(spark)
    where, base = _fs(root)
    heads = {}
    for v in variables:
        with where.open_input_stream(f"{base}/{v}/.zarray") as f:
            heads[v] = json.loads(f.read())
    if len({(tuple(h["chunks"]), tuple(h["shape"])) for h in heads.values()}) != 1:
        raise ValueError("variables that are read together share their shape and chunks")
    shape, size = heads[variables[0]]["shape"], heads[variables[0]]["chunks"]

    def load(to, folder: str, variable: str, chunk: str) -> np.ndarray | None:
        from pyarrow import fs

        path, head = f"{folder}/{variable}/{chunk}", heads[variable]
        if to.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with to.open_input_stream(path) as f:
            data = f.read()
        if head["compressor"]:
            if head["compressor"]["id"] != "zlib":
                raise ValueError(f"compressor {head['compressor']['id']} isn't supported")
            data = zlib.decompress(data)
        return np.frombuffer(data, head["dtype"]).reshape(size, order=head["order"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, folder = _fs(root)
        held: tuple[str, dict[str, np.ndarray | None]] = ("", {})
        for df in frames:
            out = []
            for chunk, rows in df.groupby("chunk", sort=False):
                if held[0] != chunk:  # rows come sorted by chunk
                    held = (chunk, {v: load(to, folder, v, chunk) for v in variables})
                at = tuple(rows[a].to_numpy() % n for a, n in zip(AXES, size, strict=True))
                made = rows[list(AXES)].assign(opened=any(x is not None for x in held[1].values()))
                for v in variables:
                    made[v] = held[1][v][at].astype(float) if held[1][v] is not None else np.nan
                out.append(made)
            if out:
                yield pd.concat(out)[[*AXES, "opened", *variables]]

    inside = F.lit(True)
    for a, n in zip(AXES, shape, strict=True):
        inside &= (F.col(a) >= 0) & (F.col(a) < n)
    asked = points.select(*[F.col(a).cast("long").alias(a) for a in AXES]).filter(inside).distinct().withColumn("chunk", chunk_of(size))
    found = asked.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(read, "t long, la long, lo long, opened boolean, " + ", ".join(f"{v} double" for v in variables))
    return found.select(*AXES, "opened", *[F.when(~F.isnan(v), F.col(v)).alias(v) for v in variables])
