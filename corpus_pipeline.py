"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

1. language: documents that language identification rejects go.
2. lines: lines that many pages of a source share leave their documents; copies of a text count as one page.
3. near_copies: of each group of near copies (word 5-grams, similarity 0.8 or more), the
   document with the smallest doc_id stays.
4. benchmark: documents in which a benchmark item occurs, up to its error budget, go.
5. tokens: token ids and the text decoded from them.

Every stage works on all that the one before it kept. All but the last return the columns
of ``documents``; n_chars follows the text. A stage's table is emptied once the next stage
is written; the last one stays for the reader.

Defined cases: null and letterless texts go in the first stage; in later stages a null text
stays null and has no lines, copies or items, and no tokens (its decoded text is empty); empty
texts are copies of nothing and stay; repeated rows share a doc_id and stay or go together;
rows without doc_id stay; very long texts are treated whole; an empty table gives an empty
table; further columns, whatever their names, go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordance.llm import bpe, decontaminate, langid, line_dedup, ngram_join
from accordance.llm.common import Scratch, saved, table
from accordance.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = langid.identify(docs.select(*COLUMNS), langid.train(docs))
    return out.filter(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.near_groups(docs, words=5, percent=80)
    extra = saved(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "extra")
    return docs.select(*COLUMNS).join(extra, "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.filter(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(docs.select(*COLUMNS), *tokenizer())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: Language centroids, edit distances and merges have no SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    scratch, before = Scratch(spark, "pipeline"), []
    for name, stage in STAGES:
        docs = scratch.saved(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [docs]
    return docs
