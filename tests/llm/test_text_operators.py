"""Training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from accordance.llm import bpe, components, decontaminate, hilbert, langid, line_dedup, multiset_hash, ngram_join, pii, quality, suffix_dedup
from accordance.llm.common import mix64, prefix_hashes, substring_hashes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, langs=None, more=""):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


# --- hashing ----------------------------------------------------------------------------------


def test_equal_substrings_have_equal_hashes():
    data = np.frombuffer(b"abcabcabc" * 5, np.uint8)
    h = prefix_hashes(data)
    a = np.array([0, 3, 1])
    assert len(set(substring_hashes(h, a, a + 3).tolist())) == 2
    assert len(np.unique(mix64(np.arange(10_000, dtype=np.uint64)))) == 10_000


def test_words_that_defeat_a_modulus_of_a_power_of_two_differ(spark):
    text = "a"
    for _ in range(12):
        text += text.translate(str.maketrans("ab", "ba"))
    other = text.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((text + other).encode(), np.uint8)
    starts = np.array([0, len(text)])
    assert len(set(substring_hashes(prefix_hashes(data), starts, starts + len(text)).tolist())) == 2
    out = ngram_join.near_groups(docs(spark, [text, other, "some words more than one"])).collect()
    assert all(r.n_links == 0 and r.component_id == r.doc_id for r in out)


# --- 1: line dedup ----------------------------------------------------------------------------


def test_line_dedup_drops_by_site(spark):
    texts = [f"menu\nbody {i}\n\nend" for i in range(10)] + ["menu\nonly", None, "", "menu"]
    sources = ["a"] * 10 + ["b", "b", None, None]
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs(spark, texts, sources), max_ratio=0.5).collect()}
    assert out[0].text == "body 0\n" and out[0].n_dropped == 2 and out[0].n_lines == 4
    assert out[10].text == "menu\nonly" and out[11].text is None and out[11].n_lines == 0 and out[12].text == "" and out[13].text == "menu"
    assert line_dedup.line_dedup(docs(spark, []).limit(0)).count() == 0


def test_line_dedup_counts_a_line_once_a_page_and_keeps_other_columns(spark):
    from pyspark.sql import functions as F

    df = docs(spark, ["x\nx\nx", "y", "z", "w"]).withColumn("n_dropped", F.lit("old")).withColumn("extra", F.lit(1))
    out = line_dedup.line_dedup(df, max_ratio=0.3, min_pages=2).orderBy("doc_id").collect()
    assert out[0].text == "x\nx\nx" and out[0].extra == 1 and out[0].n_dropped == 0


# --- 2: n-gram join ---------------------------------------------------------------------------


def brute_components(rows, words, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    degree = dict.fromkeys(sets, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {i: (len(sets[i]), label[i], degree[i]) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_near_groups_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(200)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(6)]
    texts = []
    for _ in range(150):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append((" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts += ["", None, "   ", "a", "A", "a b c", "a  b\tc", "a b", "é É", "É é", "x" * 5000]
    want = brute_components(list(enumerate(texts)), words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_groups(docs(spark, texts), words, percent).collect()}
    assert got == want


def test_near_groups_edge_tables(spark):
    assert ngram_join.near_groups(docs(spark, []).limit(0)).count() == 0
    df = docs(spark, ["a b c d e", None]).union(docs(spark, ["a b c d e"])).unionByName(spark.createDataFrame([(None, "a b c d e", None, None, None)], DOC))
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_groups(df).collect())
    assert out == [("0", 2, "0"), ("0", 2, "0"), ("1", 0, "1"), ("None", 2, "None")]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 5), (7, 7)], "a long, b long")
    out = {r.id: r.component for r in components.components(chain).collect()}
    assert out == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# --- 3: language ------------------------------------------------------------------------------

WORDS = {"en": "the of and to in is that it for was on are".split(), "de": "der die und das ist nicht ein zu mit sich".split(), "xx": "żółć gęś jaźń łoś źdźbło ćma śnieg ńe".split()}


def sentences(lang, n, rng):
    return [" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(6, 30))) for _ in range(n)]


def test_language_held_out(spark):
    rng = random.Random(3)
    langs = [x for x in WORDS for _ in range(60)]
    texts = [t for x in WORDS for t in sentences(x, 60, rng)]
    model = langid.train(docs(spark, texts, langs=langs))
    fresh = [t for x in WORDS for t in sentences(x, 20, rng)] + [None, "", "123 !!", "Q"]
    out = langid.identify(docs(spark, fresh), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out[:60]] == [x for x in WORDS for _ in range(20)] and not any(r.rejected for r in out[:60])
    assert [(r.lang_pred, r.score, r.rejected) for r in out[60:63]] == [("und", 0.0, True)] * 3
    assert out[63].lang_pred in WORDS and all(0 <= r.score <= 1 for r in out)


def test_language_rejects_by_distance_and_keeps_short_clean_texts(spark):
    rng = random.Random(8)
    langs = [x for x in ("en", "de") for _ in range(60)] + ["en"]
    texts = [t for x in ("en", "de") for t in sentences(x, 60, rng)] + ["zq xj kw vv qq jx wq zk"]  # one odd row
    model = langid.train(docs(spark, texts, langs=langs))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan."
    junk = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(300))
    clean = ["the of and", "der und das ist", "is on", "that it was for the", "und"]
    out = langid.identify(docs(spark, [polish, finnish, junk, "1234567890 " * 30 + "q", *clean]), model).orderBy("doc_id").collect()
    assert [r.rejected for r in out] == [True] * 4 + [False] * 5


def test_language_without_training_rows(spark):
    model = langid.train(docs(spark, ["a"], langs=[None]))
    assert langid.identify(docs(spark, ["a b", None]), model).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.identify(docs(spark, []).limit(0), model).count() == 0


# --- 4: personal data -------------------------------------------------------------------------


def brute_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(8000):
        text = "".join(rng.choice("a.@1 2-+0()%9é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("x" * 200_000 + " a@b.c") == [("email", 200_001, 200_006)]
    assert pii.base_spans("9" * 100_000) == []


def test_field_adds_what_the_patterns_miss_and_keeps_the_base(spark):
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"of the and to {x} was is that" for _ in range(80) for x in (f"user.{number(2)}@mail{number(1)}.example.com", f"+1 ({number(3)}) {number(3)}-{number(4)}", f"10.{rng.randint(0, 255)}.3.4", "version 2.0.")]
    fresh = ["call 212-555-0153 now", "nothing here", None, "", "License 4.0.", "mail a.b@c.example.com", "é +1 (212) 555-0153 x"]
    field = pii.train(docs(spark, texts))
    out = pii.find(docs(spark, fresh), field).orderBy("doc_id").collect()
    assert out[0].spans == "phone:5:17" and out[0].n_phone == 0 and out[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.spans for r in out[1:5]] == ["", "", "", ""]
    for r, t in zip(out, fresh, strict=True):
        base = [f"{k}:{a}:{b}" for k, a, b in brute_spans(t or "")]
        assert set(base) <= set(r.spans.split(",")) | {""} and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert pii.find(docs(spark, fresh), pii.train(docs(spark, ["no digits"]))).filter("n_added > 0").count() == 0


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(6)
    field = pii.Crf(["O", "B-email", "I-email"])
    field.emit, field.step, field.first = rng.normal(size=(pii.DIMS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    rows = [[[int(x) for x in rng.integers(0, pii.DIMS, pii.WIDE)] for _ in range(n)] for n in (1, 2, 5, 3, 5)]
    score = lambda r, y: field.first[y[0]] + sum(field.emit[r[t]].sum(0)[y[t]] for t in range(len(r))) + sum(field.step[a, b] for a, b in itertools.pairwise(y))
    for r, got in zip(rows, field.viterbi(rows), strict=True):
        best = max(itertools.product(range(3), repeat=len(r)), key=lambda y: score(r, y))
        assert tuple(got) == best


# --- 5: quality -------------------------------------------------------------------------------


def test_quality_held_out(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(WORDS["en"]) for _ in range(40))
    bad = lambda: " ".join([rng.choice(WORDS["en"]).upper() + "!!" for _ in range(40)]) if rng.random() < 0.5 else " ".join([rng.choice(WORDS["de"])] * 40)
    texts, labels = zip(*[(good(), 1) if rng.random() < 0.7 else (bad(), 0) for _ in range(400)], strict=True)
    table = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs(spark, list(texts)), table)
    fresh = [good() for _ in range(30)] + [bad() for _ in range(30)] + [None, "", "word"]
    out = quality.score(docs(spark, fresh), model).orderBy("doc_id").collect()
    assert sum(r.score >= 0.3 for r in out[:30]) == 30 and sum(r.score < 0.3 for r in out[30:60]) >= 28
    assert out[60].score == out[61].score and all(0 <= r.score <= 1 for r in out)
    none = quality.train(docs(spark, ["a"]), table.limit(0))
    assert quality.score(docs(spark, ["a", None]), none).filter("score <> 0.5").count() == 0


# --- 6: byte-level BPE ------------------------------------------------------------------------

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokens():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_tree_equals_plain_merging(tokens):
    rng = random.Random(8)
    encoder = bpe.Encoder(bpe.load_ranks(PATH))
    for i in range(1500):
        alphabet = rng.choice(["ab", "abcdefghijklmnop ", "aA1!é\n ", "=-_", "thehinganr"])
        piece = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60 if i % 20 else 600))).encode()
        ids = encoder.encode(piece)
        assert list(ids) == tokens._encode_single_piece(piece) and encoder.decode(ids) == piece


def test_encoding_equals_the_library_and_round_trips(spark, tokens):
    texts = ["Hello world!  It's 2024\n\n", "", None, "日本語 🎉 café", "a" * 3000, " " * 50 + "x", "<|endoftext|>", "\x00\x01"]
    out = bpe.token_digests(docs(spark, texts), PATH, PATTERN).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        ids = tokens.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs(spark, texts), PATH, PATTERN), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == [t or "" for t in texts]
    assert bpe.encode(docs(spark, []).limit(0), PATH, PATTERN).count() == 0


# --- 7: fingerprints --------------------------------------------------------------------------


def test_fingerprints_and_edits(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS["en"]) + str(rng.randint(0, 999)) for _ in range(120)) + "." for _ in range(40)] + ["", None, "one line", "é🎉 ü"]
    texts += [texts[3]]
    out = multiset_hash.fingerprints(docs(spark, texts)).orderBy("doc_id").collect()
    full = [t or "" for t in texts]
    for i, r in enumerate(out):
        half, after = len(full[i]) // 2, full[(i + 1) % len(full)]
        assert (r.n_chars, r.edited_sha256) == (len(full[i]), hashlib.sha256((full[i][: len(full[i]) - half] + after[:half]).encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert out[3].fingerprint == out[-1].fingerprint and len({r.fingerprint for r in out}) == len(set(full))
    assert np.mean([r.near_edited for r in out[:39]]) > 0.35 and np.mean([r.near_next for r in out[:39]]) < 0.15
    assert out[40].near_next == 1.0 and out[41].near_next == 0.0
    assert multiset_hash.fingerprints(docs(spark, []).limit(0)).count() == 0
    assert multiset_hash.fingerprints(docs(spark, ["alone"])).first().near_next == 1.0


def test_fingerprints_form_a_group(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a\nb\nc\n", "c\na\nb\n", "a\nb\n", "c\n")], "x string, y string, z string, w string")
    for c in "xyzw":
        df = multiset_hash.with_fingerprint(df, c, f"f{c}")
    r = df.select((F.col("fx") == F.col("fy")).alias("order"), (multiset_hash.insert(F.col("fz"), F.col("fw")) == F.col("fx")).alias("insert"), (multiset_hash.delete(F.col("fx"), F.col("fw")) == F.col("fz")).alias("delete")).first()
    assert tuple(r) == (True, True, True)


# --- 8: sharding ------------------------------------------------------------------------------


def test_curve_is_a_path():
    places = hilbert.curve_places(3, 3)
    cells = {p: c for c, p in enumerate(places)}
    point = lambda c: (c >> 6 & 7, c >> 3 & 7, c & 7)
    assert sorted(places) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(point(cells[i]), point(cells[i + 1]), strict=True)) == 1 for i in range(511))


@pytest.mark.parametrize("n", [0, 1, 23, 24, 500])
def test_shards_are_even_and_gapless(spark, n):
    import zlib

    texts = [None if i % 9 == 0 else f"t{i % 5}é" * (i % 40) for i in range(n)]
    out = hilbert.hilbert_shards(docs(spark, texts, ["hot" if i % 3 else f"s{i}" for i in range(n)], [None if i % 2 else "en" for i in range(n)])).collect()
    assert len(out) == n and all(r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in out)
    shards = {s: sorted(r.slot for r in out if r.shard == s) for s in range(24)}
    sizes = [len(x) for x in shards.values()]
    assert max(sizes) - min(sizes) <= 1 and all(x == list(range(len(x))) for x in shards.values())
    along = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along) and {r.law for r in out} <= {"rows"}


# --- 9: decontamination -----------------------------------------------------------------------


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(10)
    items = [" ".join(rng.choice(WORDS["en"]) + rng.choice("abc") for _ in range(20)) for _ in range(6)] + ["short", None, ""]
    texts = []
    for _ in range(60):
        w = list(decontaminate.normal(items[rng.randrange(6)]))
        for _ in range(rng.choice([0, 1, 3, 5, 8, 12])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["q"], [w[k], "z"]])
        texts.append(("prefix " if rng.random() < 0.5 else "") + "".join(w).upper() + rng.choice(["", "\n tail"]))
    texts += [None, "", "clean text of no item at all"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    out = decontaminate.contamination(docs(spark, texts), table, block_chars=200).orderBy("doc_id").collect()
    for r, t in zip(out, texts, strict=True):
        want = {}
        for i, item in enumerate(items):
            n = decontaminate.normal(item)
            if len(n) >= decontaminate.MIN_CHARS and (d := brute_distance(n, decontaminate.normal(t))) <= int(decontaminate.RATE * len(n)):
                want[i] = d
        assert {int(a): int(b) for a, b in (x.split(":") for x in r["items"].split(",") if x)} == want
        assert r.contaminated == bool(want) and r.n_items == len(want)
    assert decontaminate.contamination(docs(spark, texts), table.limit(0)).filter("contaminated").count() == 0


# --- 10: suffixes -----------------------------------------------------------------------------


def brute_cut(texts, length):
    from collections import Counter

    seen = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    bases = ["".join(rng.choice("abcd é\n") for _ in range(900)) for _ in range(4)]
    texts = []
    for i in range(60):
        x = list(rng.choice(bases))
        if i % 3 == 0:
            a = rng.randint(0, 500)
            x = x[a : a + rng.randint(50, 400)] + list(rng.choice(bases)[100:600])
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        texts.append("".join(x))
    texts += [None, "", "ab" * 400, "a" * 1000, texts[4], bases[0] + bases[0]]
    want = brute_cut([(t or "").encode() for t in texts], 120)
    get = lambda: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs(spark, texts), 120, 48).orderBy("doc_id").collect()]
    assert get() == want
    assert suffix_dedup.suffix_dedup(docs(spark, []).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "q" * 500, "x"), (None, None, "y"), (7, "unique", "z")], "doc_id long, text string, spans string")
    assert sorted(r.n_removed for r in suffix_dedup.suffix_dedup(nulls).collect()) == [0, 0, 500]


def test_sorted_triples_equal_brute_force(spark):
    rng = random.Random(13)
    bases = ["".join(rng.choice("abcd é\n") for _ in range(1500)) for _ in range(3)]
    texts = []
    for i in range(24):
        x = list(rng.choice(bases))[rng.randint(0, 400) :]
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        texts.append("".join(x))
    texts += [None, "", "ab" * 400, "a" * 1000, texts[4], bases[0] + bases[0], "q" * 399, "q" * 400]
    get = lambda m: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs(spark, texts), method=m).orderBy("doc_id").collect()]
    assert get("triples") == get("content") == brute_cut([(t or "").encode() for t in texts], 400)


def test_long_texts_are_cut_into_pieces_without_losing_windows(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(suffix_dedup, "_MOST", 1000)
    text = "".join(rng.choice("abcdef") for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["doc_id", "text_key", "text"])
    windows = sorted(p for out in suffix_dedup._anchors(iter([batch]), 100, 30) for lo, k in zip(out.column("lo").to_pylist(), out.column("k").to_pylist(), strict=True) for p in range(lo, lo + k))
    assert windows == list(range(5000 - 100 + 1))
