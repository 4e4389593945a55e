"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from accordance.llm import bpe, decontaminate, hilbert, langid, line_dedup, multiset_hash, ngram_join, pii, quality, suffix_dedup
from accordance.llm.queries import tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that results or inner steps of the operators use.
CLASHES = ["n_lines", "n_dropped", "n", "l", "tokens", "places", "component_id", "component", "n_links", "lang_pred", "score", "rejected", "spans", "n_added", "personal", "ids", "decoded", "fp", "range", "r", "starts", "fingerprint", "shard", "slot", "size", "curve", "part", "lang_cuts", "items", "n_items", "contaminated", "text_key", "runs", "n_bytes", "held_out", "id", "rep"]
rng = random.Random(21)
WORDS = ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are"]
LONG = " ".join(rng.choice(WORDS) + str(rng.randint(0, 9999)) for _ in range(60_000)) + " x" + "y" * 100_000
ITEM = "which of these words was on the list that it is for and to in"
ROWS = [
    (1, "the of and to in is that it was for", "en", "a", 0), (1, "the of and to in is that it was for", "en", "a", 0), (2, None, "en", "a", 0), (3, "", None, None, 0),
    (None, "a text without an id, mail x@y.example.com or 10.0.0.1", "en", "b", None), (None, None, None, None, None), (4, LONG, "en", "a", len(LONG)), (5, "the of and to in is that it was for", "de", "b", 0),
    (6, f"before {ITEM} after", "en", "b", 0), (7, "12345 !!", "en", "c", 0), (8, "é\u0000 🎉\n\n\n", "fr", "c", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def runs(spark, docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (None, 1), (9, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, "")], "item_id long, text string")
    language, field, model = langid.train(docs), pii.train(docs, examples=8), quality.train(docs, labels)
    return {
        "lines": lambda d: line_dedup.line_dedup(d), "join": lambda d: ngram_join.near_groups(d), "language": lambda d: langid.identify(d, language), "pii": lambda d: pii.find(d, field),
        "quality": lambda d: quality.score(d, model), "bpe": lambda d: bpe.round_trip(d, *tokenizer()), "digests": lambda d: bpe.token_digests(d, *tokenizer()), "fingerprints": lambda d: multiset_hash.fingerprints(d),
        "shards": lambda d: hilbert.hilbert_shards(d), "benchmark": lambda d: decontaminate.contamination(d, items), "suffixes": lambda d: suffix_dedup.suffix_dedup(d),
    }


NAMES = ["lines", "join", "language", "pii", "quality", "bpe", "digests", "fingerprints", "shards", "benchmark", "suffixes"]


def plain(df, columns):
    return sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", NAMES)
def test_rows_stay_whole_and_clashing_columns_do_not_matter(docs, runs, name):
    out = runs[name](docs)
    own = plain(out, [c for c in out.columns if c not in CLASHES or c in runs[name](docs.limit(0)).columns])
    assert len(own) == len(ROWS)
    clashing = docs.select("*", *[F.lit("old").alias(c) for c in CLASHES])
    assert plain(runs[name](clashing), out.columns) == plain(out, out.columns)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, runs, name):
    out = runs[name](docs.limit(0))
    assert out.count() == 0 and out.columns


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("shards", "fingerprints", "suffixes")])
def test_repeated_rows_are_treated_alike(docs, runs, name):
    rows = runs[name](docs).filter("doc_id = 1").collect()
    assert len(rows) == 2 and rows[0] == rows[1]


def test_null_and_empty_texts(docs, runs):
    row = lambda name, i: runs[name](docs).filter(F.col("doc_id") == i).first()
    assert row("language", 2).lang_pred == row("language", 3).lang_pred == row("language", 7).lang_pred == "und"
    assert row("pii", 2).spans == row("pii", 3).spans == "" and not row("pii", 2).personal
    assert row("digests", 2).n_tokens == 0 and row("join", 3).n_links == 0 and row("lines", 2).text is None
    assert row("suffixes", 2).n_bytes == 0 and not row("suffixes", 2).repeated and row("shards", 2).size == 8


def test_links_count_copies_and_skip_missing_ids(docs, runs):
    out = {r.doc_id: r for r in runs["join"](docs).collect()}
    assert out[1].n_links == out[5].n_links == 2 and out[1].component_id == out[5].component_id == 1
    assert out[None].component_id is None and out[None].n_links == 0


def test_equal_cosines_go_to_the_first_language(spark):
    rows = [(i, "the of and to in is that", x, "s", 0) for i, x in enumerate(["zz", "aa"] * 3)]
    df = spark.createDataFrame(rows, DOC)
    assert {r.lang_pred for r in langid.identify(df, langid.train(df)).collect()} == {"aa"}


def test_equal_rows_and_hot_texts_are_sharded_evenly(spark):
    rows = [(7, "same", "en", "hot", 4)] * 50 + [(i, "same", "en", "hot", 4) for i in range(300)] + [(i, f"text {i}", "en", "hot", 4) for i in range(300, 500)]
    out = hilbert.hilbert_shards(spark.createDataFrame(rows, DOC), part=20).collect()
    sizes = [sum(r.shard == s for r in out) for s in range(24)]
    assert len(out) == 550 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s])) for s in range(24))


def test_ties_of_items_and_long_texts(spark):
    text = "q " * 50_000 + ITEM + " z" * 50_000
    df = spark.createDataFrame([(1, text, "en", "s", 0), (2, ITEM + " " + ITEM.replace("list", "lost"), "en", "s", 0)], DOC)
    items = spark.createDataFrame([(5, ITEM), (4, ITEM), (9, "it")], "item_id long, text string")
    out = {r.doc_id: r["items"] for r in decontaminate.contamination(df, items).collect()}
    assert out == {1: "4:0,5:0,9:0", 2: "4:0,5:0,9:0"}
    inside = spark.createDataFrame([(1, "bits and pieces", "en", "s", 0)], DOC)  # a short item as part of a longer word doesn't count
    assert not decontaminate.contamination(inside, items).first().contaminated


def test_many_blocks_equal_one(spark):
    rows = [(i, f"{ITEM} number {i}", "en", "s", 0) for i in range(6)]
    df, items = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, f"{ITEM} number {i}") for i in range(6)], "item_id long, text string")
    whole, parts = (sorted((r.doc_id, tuple(sorted(r["items"].split(",")))) for r in decontaminate.contamination(df, items, block_chars=n).collect()) for n in (1 << 20, 100))
    assert whole == parts


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, docs, stage):
    name, work = corpus_pipeline.STAGES[stage]
    small = "/root/testdata/sf0.001"
    clashing = docs.select("*", *[F.lit("old").alias(c) for c in CLASHES])
    out = work(spark, clashing, small)
    assert out.count() <= len(ROWS) and (stage == 4 or out.columns == corpus_pipeline.COLUMNS)
    assert work(spark, docs.limit(0), small).count() == 0
    ids = [r.doc_id for r in out.collect()]
    if name in ("lines", "benchmark", "tokens"):
        assert len(ids) == len(ROWS)  # nothing here holds an item of that benchmark
    if name == "near_copies":
        assert 5 not in ids and ids.count(None) == 2 and {1, 2, 3, 4, 6, 7, 8} <= set(ids)


def test_classes_of_shards_rank_all_distinct_values(spark):
    from accordance.llm import hilbert

    for n in (0, 1, 3, 40, 9000):
        names = sorted(f"s{i * 7919 % 100_003}" for i in range(n))
        df = spark.createDataFrame([(v,) for v in [*names, *names[:50], None]], "source string")
        cuts = sorted(hilbert.classes(df, "source", 4).first().source_cuts)
        assert cuts == [names[at] for i in range(1, 15) if (at := -(-n * i // 15)) < n]
