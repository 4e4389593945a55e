"""Language, quality and fingerprints against plain versions, and what the methods do: trees, prefixes, shards, ranges, added spans."""

import math
import random
import re
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accordance.llm import bpe, hilbert, langid, multiset_hash, ngram_join, pii, quality
from accordance.llm.queries import tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def docs(spark, texts, langs=None, sources=None):
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], DOC)


# --- 3: a plain TF-IDF cosine -----------------------------------------------------------------


def plain_vector(text, idf):
    full = (1 << 32) - 1
    code = [int(langid._CLASS[b]) for b in text.lower().encode()]
    counts = {}
    for n in (2, 3):
        for i in range(len(code) - n + 1):
            if all(c == 32 for c in code[i : i + n]):
                continue
            mixed = [code[i + k] * int(langid._MUL[k]) & full for k in range(n)]
            h = mixed[0] ^ n
            for m in mixed[1:]:
                h = h + (m ^ m >> 15) & full
            h = (h ^ h >> 13) * int(langid._MUL[1]) & full
            counts[h >> 32 - langid.DIMS_LOG] = counts.get(h >> 32 - langid.DIMS_LOG, 0) + 1
    vector = {k: math.log1p(v) * float(idf[k]) for k, v in counts.items()}
    norm = math.sqrt(sum(v * v for v in vector.values())) or 1.0
    return {k: v / norm for k, v in vector.items()}


def test_language_scores_equal_plain_cosines(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(base.filter("doc_id % 2 = 0"))
    for r in langid.identify(base.filter("doc_id % 2 = 1"), model).limit(40).collect():
        vector = plain_vector(r.text, model.idf)
        cosines = [sum(v * float(c[k]) for k, v in vector.items()) for c in model.centres]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        assert r.lang_pred == model.names[best] and r.score == pytest.approx(cosines[best], abs=1e-4)


# --- 5: a plain follow-the-regularised-leader -------------------------------------------------


def test_quality_scores_equal_plain_updates():
    rng = random.Random(31)
    words = ["good", "plain", "text", "BAD!!", "spam", "x1", "of", "the"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    labels = [int("BAD!!" not in t) for t in texts]
    rows = []
    for t in texts:
        found = quality.features(*_bytes(t))[1].tolist()
        rows.append({**{f: found.count(f) * quality.SCALE / len(found) for f in found}, "one": 1.0})
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -math.copysign(abs(z[k]) - quality.L1, z[k]) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for x, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g, old = (p - y) * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w[k]
                n[k] = old + g * g
    model = quality.Model().fit(pa.array(texts), labels)
    for t, x in zip(texts, rows, strict=True):
        want = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
        assert float(model.score(*_bytes(t))[0]) == pytest.approx(want, abs=1e-4)


def _bytes(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


# --- 7: plain fingerprints --------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    units = re.findall(r"[^.!?|;\n]{1,%d}[.!?|;\n]*|[.!?|;\n]+" % multiset_hash.RUN, text)
    mask, words = (1 << 40) | (1 << 20) | 1, []
    for seed in multiset_hash.SEEDS:
        start = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
        hashes = [xxhash.xxh64(u.encode(), seed=start).intdigest() for u in units]
        words += [sum(h >> k & mask for h in hashes) % (1 << 60) for k in range(multiset_hash.SHIFTS)]
    return len(units), words


def plain_likeness(a, b):
    if a == b:
        return 1.0
    lanes = [[2 * (w >> k & (1 << 20) - 1) - n for w in words for k in (0, 20, 40)] for n, words in (a, b)]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    norm = math.sqrt(dot(lanes[0], lanes[0]) * dot(lanes[1], lanes[1]))
    return 0.0 if not (a[0] and b[0] and norm) else max(0.0, min(1.0, dot(*lanes) / norm))


def test_fingerprints_equal_a_plain_version(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(25).collect()] + ["", "one. two! three\n"]
    out = multiset_hash.fingerprints(docs(spark, texts), ranges=7).orderBy("doc_id").collect()
    show = lambda f: f"{f[0]:x}:" + "".join(f"{w:015x}" for w in f[1])
    for i, r in enumerate(out):
        own, after = texts[i], texts[(i + 1) % len(texts)]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        prints = [plain_fingerprint(t) for t in (own, edited, after)]
        assert (r.fingerprint, r.edited_fingerprint) == (show(prints[0]), show(prints[1]))
        assert r.near_edited == pytest.approx(plain_likeness(prints[0], prints[1])) and r.near_next == pytest.approx(plain_likeness(prints[0], prints[2]))


def test_ranges_are_found_by_bisection_and_bounded_by_their_parameter(spark):
    rows = spark.range(1600).select((F.col("id") * F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    starts = multiset_hash.range_starts(rows, 8).first()
    assert len(starts.starts) <= 8 and starts.first_id == 0  # whatever the number of rows
    one = spark.createDataFrame([(starts.starts, v) for v in (-1, 0, 5, 1 << 40, None)], "s array<long>, v long")
    got = [r[0] for r in one.select(multiset_hash.below(F.col("s"), F.col("v"), 8)).collect()]
    assert got == [sum(s <= v for s in starts.starts) if v is not None else 0 for v in (-1, 0, 5, 1 << 40, None)]


# --- 2, 4, 6, 8: what the methods do ----------------------------------------------------------


def test_prefixes_grow_with_copies_and_spare_candidates():
    import numpy as np

    n, least = 300, 255
    assert ngram_join.adaptive_l(np.zeros(n), n, least) == 1
    grown = [ngram_join.adaptive_l(np.full(n, float(k)), n, least) for k in (1, 100)]
    assert 1 < grown[0] <= grown[1] <= least
    met = np.cumsum(np.full(n, 100.0))
    cost = lambda el: (n - least + el) + met[n - least + el - 1] * (1 + ngram_join.VERIFY * n / el)
    assert cost(grown[1]) == pytest.approx(min(map(cost, range(1, least + 1))))


def test_the_tree_joins_what_is_no_token_and_long_runs_are_quick(spark):
    import time

    ranks = bpe.load_ranks(tokenizer()[0])
    encoder = bpe.Encoder(ranks)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).collect()]
    import regex

    for piece in {m for t in texts for m in regex.findall(tokenizer()[1], t)}:
        before = encoder.joins, len(encoder.nodes)
        ids = encoder.encode(piece.encode())
        assert len(ids) == 1 or encoder.joins > before[0] or len(encoder.nodes) == before[1]
    assert encoder.joins > 1000  # every match of more than one token comes out of the tree
    for c in (b"-", b"a", b" ", b"=-", "é".encode()):
        start = time.process_time()
        ids = encoder.encode(c * (100_000 // len(c)))
        assert time.process_time() - start < 1 and encoder.decode(ids) == c * (100_000 // len(c))


def test_equal_texts_are_cut_between_shards_at_most(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = base.union(base.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("source", F.lit("mirror")))
    shards = hilbert.hilbert_shards(more).join(more.select("doc_id", "text"), "doc_id")
    torn = shards.groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count()
    assert torn <= 23


def test_the_field_finds_planted_layouts_and_leaves_clean_words_alone(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    some = lambda k: " ".join(word() for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    train = [f"{some(5)} {x} {some(5)}" for _ in range(60) for x in (f"{word()}.{rng.randint(1, 99)}@mail.example.com", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7", f"{rng.randint(1, 40)}.")]
    field = pii.train(docs(spark, train))
    planted, clean = [], []
    for _ in range(60):
        planted += [f"{some(4)} password={hexes(18)} {some(4)}", f'{some(4)} token = "{hexes(40)}" {some(4)}', f"{some(4)} AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))} {some(4)}", f"{some(4)} {rng.randint(200, 999)}-555-{rng.randint(1000, 9999)} {some(4)}", f"{some(4)} {word()} [at] mail.example.com {some(4)}"]
        clean += [f"{some(4)} version {rng.randint(1, 9)}.{rng.randint(0, 9)} {some(4)}", f"{some(4)} in {rng.randint(1900, 2030)} {some(4)}", f"{some(4)} {rng.randint(1, 30)}. {some(4)}", some(9)]
    found = {r.doc_id: r.n_added for r in pii.find(docs(spark, planted), field).collect()}
    alone = pii.find(docs(spark, clean), field).filter("not personal").count() / len(clean)
    by_layout = [sum(found[i] > 0 for i in range(k, len(planted), 5)) / 60 for k in range(5)]
    assert min(by_layout) >= 0.8 and alone >= 0.95, (by_layout, alone)
