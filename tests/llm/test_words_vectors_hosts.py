"""Spelling variants, vector codes and host rules against brute force, and their defined cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordance.llm import host_rules, spelling, vector_codes

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VEC = "vec_id long, label int, embedding array<float>"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", sources[i] if sources else "s", 0) for i, t in enumerate(texts)], DOC)


# --- 11: spelling variants --------------------------------------------------------------------


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    lower, counts = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}), Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    by, form = {w: [v for v in n if near(w, v)] for w in n}, {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return out


def as_set(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def made_texts(rng, n=120):
    heads = ["station", "général", "ctarion", "straße", "ÀÉÎõü", "aaaaaa", "ababab", "Boulder", "colour"]
    pool = []
    for w in heads:
        pool += [w] * 12
        for _ in range(5):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            pool.append(w[:at] + rng.choice(["", "", "x", "é"])[:kind] + w[at + (kind != 1) :])
    return [" ".join(rng.choice(pool) for _ in range(60)) + rng.choice([".", " – “quoted”", "\n×÷", ""]) for _ in range(n)]


def test_spelling_variants_equal_brute_force(spark):
    rows = [*enumerate(made_texts(random.Random(4))), (None, "station stations statons " * 9), (500, None), (501, ""), (3, "station " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_set(spelling.spelling_variants(df))
    assert got == brute_spelling(rows)
    assert any(form and root != form for _, form, root, *_ in got) or any(form for _, form, *_ in got)


def test_a_chunk_of_many_words_is_dealt_into_parts(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"common{a}{b}" for a in letters for b in letters[:12]] + ["common", "commona", "kommonab"]
    df = spark.createDataFrame([(w, i + 5) for i, w in enumerate(words)], "word string, n long")
    pairs = {tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, part=16).collect()}
    assert pairs == {tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if near(a, b)}


def test_forms_chain_to_a_root(spark):
    words = {"planets": 700, "planet": 100, "plannet": 18, "plannett": 3}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    rows = {r.word: r for r in spelling.spelling_variants(docs(spark, [text]), slip=1 << 40, often=3).collect()}
    assert (rows["plannett"].form, rows["plannett"].root) == ("plannet", "planets") and rows["planets"].root == "planets"
    assert rows["plannet"].form == "planet" and rows["planet"].form_n == 700


def test_chains_longer_than_one_jump(spark, tmp_path):
    from accordance.llm.common import Scratch

    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(27)], "word string, form string")
    assert {r.root for r in spelling.roots(forms, Scratch(spark, "chain")).collect()} == {"w27"}


def test_spelling_edge_cases(spark):
    assert spelling.spelling_variants(docs(spark, []).limit(0)).count() == 0
    assert spelling.spelling_variants(docs(spark, [None, "", "12 34", "tiny few"])).count() == 0
    long = "q" * 100_000
    df = docs(spark, [" ".join([long] * 5 + [long + "z"] * 5)]).select("*", F.lit("old").alias("word"), F.lit("old").alias("n"), F.lit("old").alias("root"))
    assert {(len(r.word), r.n_near) for r in spelling.spelling_variants(df, slip=1 << 40).collect()} == {(100_000, 1), (100_001, 1)}
    tie = docs(spark, ["letters " * 50 + "lettera " * 50 + "letterz " * 5])
    assert {r.word: r.form for r in spelling.spelling_variants(tie, slip=1 << 40).collect()} == {"letters": None, "lettera": None, "letterz": "lettera"}


def test_counts_are_sent_when_a_task_holds_many_words(spark, monkeypatch):
    rows = list(enumerate(made_texts(random.Random(5), 30)))
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in rows]
    monkeypatch.setattr(spelling, "HELD", 10)
    total = Counter()
    for b in spelling._counts(iter(batches), 199, 6):
        total.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    monkeypatch.setattr(spelling, "HELD", 1 << 30)
    (whole,) = spelling._counts(iter(batches), 199, 6)
    assert total == Counter(dict(zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True)))


# --- 12: vector codes -------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [1, 3, 40, 2000])
def test_ball_search_equals_full_search(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (24, 4))
    entries[7] = entries[3]  # equal entries: the lower index
    x = np.r_[rng.integers(-spread, spread + 1, (3000, 4)), entries]
    at, best = vector_codes.full_search(x, entries)
    for was in (rng.integers(0, 24, len(x)), at):
        got, d, tried = vector_codes.ball_search(x, entries, was)
        assert (got == at).all() and (d == best).all()
        if was is at:
            assert tried < len(x) * 24 * 2 / 3  # the core and the rings leave out most distances


def test_stable_core_computes_one_distance():
    entries = np.array([[0, 0], [1000, 0], [0, 1000]])
    x = np.repeat(entries, 50, 0) + np.random.default_rng(1).integers(-20, 20, (150, 2))
    was = np.repeat([0, 1, 2], 50)
    at, _, tried = vector_codes.ball_search(x, entries, was)
    assert (at == was).all() and tried == len(x)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, k, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    step, out = len(kept[0][2]) // parts, {}
    first = sorted(kept, key=lambda r: r[0])[:entries]
    cut = lambda v, p: v[p * step : p * step + step]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    nearest = lambda v, b: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(b))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for _, _, v in kept:
                held.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(held[j]) for c in zip(*held[j], strict=True)] if j in held else e for j, e in enumerate(book)]
    for i, k, v in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), k)
    label = Counter()
    for _, d, k in out.values():
        label[k] += d
    return {i: (code, d, label[k]) for i, (code, d, k) in out.items()}


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(i) % 3 if i % 4 else None, rng.normal(0, 0.3, 32).astype(np.float32).tolist()) for i in rng.permutation(150)]
    rows += [(200 + i, 1, rows[0][2]) for i in range(60)]  # many equal vectors
    rows += [(300, 1, None), (301, 1, [None] * 32), (302, 1, [float("nan")] * 32), (303, 1, [float("-inf")] + [0.0] * 31)]
    df = spark.createDataFrame(rows, VEC).select("*", F.lit("old").alias("code"), F.lit("old").alias("v"))
    out = vector_codes.vector_codes(df.repartition(5)).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in out} == brute_codes(rows)
    assert len({r.codebooks_sha256 for r in out}) == 1


def test_vector_codes_edge_cases(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VEC)).count() == 0
    rows = [(1, None, [0.5] * 20), (1, None, [0.5] * 20), (None, 2, [0.25] * 20), (5, 2, [1.0] * 7), (6, 2, [])]
    out = vector_codes.vector_codes(spark.createDataFrame(rows, VEC)).collect()
    by = {(r.vec_id, r.error) for r in out}
    assert len(out) == 5 and (1, 0) in by and (5, None) in by and (6, None) in by
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, 1, [1e30] * 16)], VEC)).count()


# --- 13: host rules ---------------------------------------------------------------------------


def brute_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered, seen, again = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_figures_equal_brute_force(spark):
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "é🎉", "#x", "\x85y", "z z", "<|>"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    texts += [None, "", " \t\r\x0b\x0c", "one two three", "a a a a", "a a a", "x\n x\nx\n\n\nx ", "word " * 30_000]
    out = {r.doc_id: r for r in host_rules.host_verdicts(docs(spark, texts)).collect()}
    for i, text in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_figures(text), repr(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_windows_of_wide_vocabularies(monkeypatch):
    codes, doc = np.array([5, 6, 7, 1, 5, 6, 7, 5, 6, 7]), np.array([0] * 7 + [1] * 3)
    assert host_rules.repeated_words(codes, doc, 2).tolist() == [6, 0]
    monkeypatch.setattr(host_rules, "_WIDE", 2)
    assert host_rules.repeated_words(codes, doc, 2).tolist() == [6, 0]


GOOD = " ".join(f"sensible{i}" for i in range(60))
LINES = "\n".join(["again and again the same line"] * 9 + [" ".join(f"other{i}" for i in range(90))])


def test_hosts_are_judged_by_shrunken_rates(spark):
    texts, sources = [], []
    for h in range(30):
        texts, sources = texts + [GOOD] * 40, sources + [f"fine{h}"] * 40
    texts, sources = texts + ["few words"] * 70 + [GOOD] * 30, sources + ["bad"] * 100
    texts, sources = texts + ["few words"] + [GOOD], sources + ["tiny"] * 2  # half of two documents: no evidence
    texts, sources = texts + [LINES] * 30 + [GOOD] * 70, sources + ["lines"] * 100
    texts, sources = texts + [LINES], sources + ["fine0"]
    out = host_rules.host_verdicts(docs(spark, texts, sources)).collect()
    kept = Counter((sources[r.doc_id], texts[r.doc_id], r.kept) for r in out)
    assert kept["bad", GOOD, False] == 30 and kept["fine3", GOOD, True] == 40
    assert kept["tiny", GOOD, True] == 1 and kept["tiny", "few words", False] == 1
    assert kept["lines", GOOD, True] == 70 and kept["lines", LINES, False] == 30  # watched: what fails the rule itself goes
    assert kept["fine0", LINES, True] == 1  # the same text stays elsewhere


def test_prior_by_hand(spark):
    rows = [("a", k < 2) for k in range(10)] + [("b", k < 6) for k in range(10)]
    df = spark.createDataFrame(rows, "source string, f boolean").select("source", *[F.col("f").alias(f"f_{r}") for r in host_rules.RULES])
    r = {x.host: x for x in host_rules.host_rates(df).collect()}
    m, q = 0.4, (2 * 1 / 90 + 6 * 5 / 90) / 2
    strength = m * (1 - m) / (q - m * m) - 1
    assert r["a"].m_short == pytest.approx(m) and r["a"].s_short == pytest.approx(strength)
    assert r["b"].r_short == pytest.approx((6 + strength * m) / (10 + strength))


def test_host_rules_edge_cases(spark):
    assert host_rules.host_verdicts(docs(spark, []).limit(0)).count() == 0
    rows = [(1, GOOD, "en", None, 0), (1, GOOD, "en", None, 0), (None, GOOD, "en", "a", 0), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC).select("*", F.lit("old").alias("kept"), F.lit("old").alias("n_words"), F.lit("old").alias("host"))
    out = host_rules.host_verdicts(df).collect()
    assert len(out) == 4 and sorted((r.doc_id is None, r.kept) for r in out) == [(False, False), (False, True), (False, True), (True, True)]
