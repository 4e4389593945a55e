"""The pipeline against a plain version over the smallest tables, and the shape of its stages."""

import importlib
import os

import pytest

import corpus_pipeline
from accordance.llm import decontaminate, langid, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the given tables are not here")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], SMALL)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return out


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "tokens"]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in steps[:-1])


def test_language_stage_drops_what_is_rejected(spark, steps):
    kept = {r.doc_id for r in steps[1].collect()}
    said = langid.identify(steps[0], langid.train(steps[0])).collect()
    assert kept == {r.doc_id for r in said if not r.rejected} and len(kept) >= 0.97 * len(said)


def test_lines_stage_equals_counting(steps):
    from collections import Counter

    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[1:3])
    distinct = {(r.source, r.text) for r in before.values()}
    pages, seen = Counter(s for s, _ in distinct), Counter()
    for source, text in distinct:
        seen.update({(source, x) for x in (text or "").split("\n") if x.strip(" ")})
    for i, r in before.items():
        want = "\n".join(x for x in (r.text or "").split("\n") if not (x.strip(" ") and seen[r.source, x] >= 3 and seen[r.source, x] > 0.07 * pages[r.source]))
        assert after[i].text == want and after[i].n_chars == len(want)


def test_near_copies_stage_keeps_one_of_each_group(steps):
    import re

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for r in steps[2].collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low))
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert {r.doc_id for r in steps[3].collect()} == {i for i in label if label[i] == i}


def test_benchmark_stage_drops_occurrences(spark, steps):
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in steps[4].collect()}
    for r in steps[3].collect():
        text = decontaminate.normal(r.text)
        if any(len(i) >= decontaminate.MIN_CHARS and i in text for i in items):
            assert r.doc_id not in kept
    assert len(kept) >= 0.8 * steps[3].count()


def test_tokens_stage_round_trips(steps):
    before = {r.doc_id: r.text for r in steps[4].collect()}
    out = steps[5].collect()
    assert {r.doc_id: r.text for r in out} == before and all(r.n_tokens == len(r["ids"]) for r in out)


def test_run_equals_the_stages(spark, steps):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(r.doc_id for r in steps[5].collect())


def test_queries_cover_all_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert importlib.import_module("__spark_entry__").queries().keys() >= queries.QUERIES.keys() | {"pipeline"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, sql = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert sorted(map(tuple, df.select(sql.columns).collect()), key=repr) == sorted(sql.fetchall(), key=repr)  # some hold nulls


def test_lines_stage_leaves_copies_to_the_join(spark):
    copy = "first line of a copied page\nsecond line of it with some more words"
    rows = [(i, copy if i < 10 else f"menu\npage {i} has words of its own", "en", "s", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.lines(spark, docs, SMALL)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert all(kept[i] == copy for i in range(10)) and all(kept[i] == f"page {i} has words of its own" for i in range(10, 30))
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, out, SMALL).collect()} >= {0} and not {r.doc_id for r in corpus_pipeline.near_copies(spark, out, SMALL).collect()} & set(range(1, 10))
