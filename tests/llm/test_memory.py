"""What Python workers hold: the join's cells, the tokenizer's memos, and emptied tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from accordance.llm import bpe, ngram_join
from accordance.llm.common import Scratch
from accordance.llm.queries import tokenizer


def cell(sets, parts):
    n = len(sets)
    return pa.table({"cell": pa.array([1] * n), "doc_id": pa.array(range(n)), "part": pa.array([i % parts for i in range(n)]), "m": pa.array([1 + i % 3 for i in range(n)]), "tokens": pa.array([sorted(x) for x in sets], pa.list_(pa.int64()))})


def test_cell_links_equal_all_pairs():
    rng = np.random.default_rng(7)
    sets = [{int(x) for x in rng.choice(24, rng.integers(14, 24), replace=False)} for _ in range(200)]
    for parts in (1, 2):
        out = ngram_join._cell_links(cell(sets, parts), 80)
        link = [[j for j, y in enumerate(sets) if j != i and (parts == 1 or (i - j) % 2) and 100 * len(x & y) >= 80 * len(x | y)] for i, x in enumerate(sets)]
        assert any(link) and not all(link) and out.column("others").to_pylist() == [sum(1 + j % 3 for j in js) for js in link]
        least = list(range(len(sets)))
        for _ in sets:
            least = [min([least[i], *(least[j] for j in js)]) for i, js in enumerate(link)]
        assert out.column("least").to_pylist() == least


def test_cell_links_hold_no_matrix_of_numbers():
    rng = np.random.default_rng(8)
    table = cell([{*map(int, rng.integers(0, 400, 20))} for _ in range(2048)], 2)
    tracemalloc.start()
    try:
        ngram_join._cell_links(table, 80)
        assert tracemalloc.get_traced_memory()[1] < 7 * 2048 * 2048  # a matrix of 64-bit numbers alone has 8
    finally:
        tracemalloc.stop()


def test_memos_hold_ids_once():
    matches = bpe.Matches(*tokenizer())
    text = "Unremarkable zyxwvutsrqp quadrilaterals, interdisciplinary 12345 misunderstandings."
    assert bpe.joined_ids(matches.of(text)).tolist() == [i for x in matches.split(text) for i in matches.encoder.merge(x.encode())]
    assert {type(x) for x in matches.new.values()} == {bytes}
    a, b = matches.encoder.ranks[b"the"], matches.encoder.ranks[b"\n"]
    known = matches.encoder.pair(a, b)
    assert known == (a, b) and any(k is known for k in matches.encoder.pairs)


def test_tables_are_emptied_without_python_workers(spark, monkeypatch):
    scratch = Scratch(spark, "emptied")
    df = scratch.saved(spark.sql("SELECT 1L AS `a.b`, array(struct('x' AS y)) AS c"), "one")
    other = scratch.saved(df, "two")
    monkeypatch.delattr(SparkSession, "createDataFrame")
    scratch.drop(df)
    assert spark.read.parquet(df.inputFiles()[0].rsplit("/", 1)[0]).count() == 0 and other.count() == 1
    scratch.clear()
    assert spark.read.parquet(scratch.folder).columns == ["gone"]
