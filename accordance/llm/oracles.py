"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from accordance.llm import hilbert, host_rules, vector_codes

OP1 = """
    WITH p AS (SELECT DISTINCT source, text FROM documents),
    lines AS (SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS line FROM p),
    totals AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
    often AS (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line HAVING count(*) >= 3),
    over AS (SELECT o.source, list(o.line) AS bad FROM often o JOIN totals t ON o.source IS NOT DISTINCT FROM t.source WHERE o.n > 0.07 * t.pages GROUP BY o.source),
    cut AS (SELECT d.*, o.bad, string_split(d.text, chr(10)) AS ls FROM documents d LEFT JOIN over o ON d.source IS NOT DISTINCT FROM o.source),
    kept AS (SELECT *, CASE WHEN bad IS NULL OR text IS NULL THEN ls ELSE list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(bad, x)) END AS ks FROM cut)
    SELECT doc_id, source, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(ks), 0)::BIGINT AS n_dropped,
           CASE WHEN text IS NULL THEN NULL ELSE array_to_string(ks, chr(10)) END AS text FROM kept
"""

#: All pairs that share a shingle are counted; components by the smallest id reached.
OP2 = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS x(i) WHERE len(ws) > 0),
    n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce((SELECT min(b) FROM r WHERE a = n.doc_id), n.doc_id)) AS component_id, (SELECT count(*) FROM l WHERE a = n.doc_id) AS n_links FROM n
"""


def op8(shards: int = hilbert.SHARDS, bits: int = hilbert.BITS) -> str:
    """The curve's places stand in the SQL as a list; CRC-32 byte by byte from its table."""
    places = ", ".join(map(str, hilbert.curve_places(3, bits)))
    most = (1 << bits) - 1
    code = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 + ((SELECT count(DISTINCT o.{c}) FROM documents o WHERE o.{c} < d.{c}) * {most}) // (SELECT count(DISTINCT {c}) FROM documents) END"  # noqa: E731
    return f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size, {code('lang')} AS d0, {code('source')} AS d1, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS tk, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS ik FROM documents d),
    o AS (SELECT *, ([{places}])[(d0 * {1 << 2 * bits} + d1 * {1 << bits} + least({most}, floor(log2(size))::INT - 3) + 1)::INT] AS own FROM t),
    f AS (SELECT *, first_value(own) OVER (PARTITION BY tk ORDER BY ik, own) AS curve FROM o),
    k AS (SELECT *, row_number() OVER (ORDER BY curve, tk, ik, doc_id) - 1 AS rank, count(*) OVER () AS total FROM f),
    p AS (SELECT *, total // {shards} AS small, total % {shards} AS more FROM k),
    q AS (SELECT *, CASE WHEN rank < more * (small + 1) THEN rank // (small + 1) ELSE more + (rank - more * (small + 1)) // greatest(small, 1) END AS shard FROM p),
    z AS (SELECT text, {crc32('text')} AS crc FROM (SELECT DISTINCT text FROM t))
    SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (rank - (shard * small + least(shard, more)))::BIGINT AS slot, NULL::INT AS grown_shard, curve::BIGINT AS curve FROM q JOIN z USING (text)
    """


OP10 = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 800)) AS k FROM d, unnest(range(n - 399)) AS x(p)),
    r AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
    m AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
    g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM m),
    s AS (SELECT doc_id, min(p) AS s, max(p) + 400 AS e FROM g GROUP BY doc_id, g),
    e AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM s),
    c AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS head, max(e) AS last, sum(e - s) AS gone, count(*) AS k, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM e JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(from_hex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(spans, '') AS spans, gone IS NOT NULL AS repeated FROM d LEFT JOIN c USING (doc_id)
"""

def crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8 bytes, byte by byte from the table of steps."""
    steps = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        steps.append(i)
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda c, b: xor(c >> 8, ([{', '.join(map(str, steps))}])[(xor(c, b) & 255) + 1])))"


#: Near words share what is left of them when one code point is deleted: of both at the same place, or of the longer one.
OP11 = f"""
    WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT d, unnest(regexp_extract_all(text, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM t),
    g AS (SELECT d, w, count(*) AS k FROM w GROUP BY d, w),
    h AS (SELECT w, k, {crc32("d || ':' || w")} AS h FROM g),
    s AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM h),
    v AS (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS r(i)),
    e AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
    f AS (SELECT a AS word, count(*) AS n_near, max(v.n) AS most, min_by(b, (-v.n, encode(b))) AS form FROM e JOIN v ON v.word = e.b GROUP BY a),
    o AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.most >= 5 * v.n THEN f.form END AS form, CASE WHEN f.most >= 5 * v.n THEN f.most END AS form_n FROM v LEFT JOIN f USING (word)),
    up(word, root, step) AS (SELECT word, form, 1 FROM o WHERE form IS NOT NULL UNION ALL SELECT up.word, o.form, step + 1 FROM up JOIN o ON o.word = up.root WHERE o.form IS NOT NULL),
    z AS (SELECT word, max_by(root, step) AS root FROM up GROUP BY word)
    SELECT o.word, o.form, coalesce(z.root, o.word) AS root, o.n, o.n_near, o.form_n FROM o LEFT JOIN z USING (word)
"""


def op12(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """All distances of all parts to all entries; each round is a table expression."""
    distance = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)"
    down = "((sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE"
    out = f"""
    WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {vector_codes.SCALE})) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    p AS (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM k, unnest(range({parts})) AS r(part)),
    c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"""
    for r in range(rounds + 1):
        out += f""",
    a{r} AS (SELECT vec_id, p.part, label, any_value(p.v) AS v, min((({distance}) * {entries} + entry)::BIGINT) AS best FROM p JOIN c{r} c ON p.part = c.part GROUP BY vec_id, p.part, label)"""
        if r < rounds:
            out += f""",
    s{r} AS (SELECT part, best % {entries} AS entry, i, {down} AS x FROM (SELECT part, best, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL),
    c{r + 1} AS (SELECT c.part, c.entry, coalesce(s.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM s{r} GROUP BY ALL) s ON s.part = c.part AND s.entry = c.entry)"""
    hexed = f"string_agg(lpad(lower(to_hex(best % {entries})), 2, '0'), '' ORDER BY part)"
    return f"""{out},
    o AS (SELECT vec_id, label, {hexed} AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label),
    l AS (SELECT label, sum(error)::BIGINT AS label_error FROM o GROUP BY label),
    d AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, label_error, codebooks_sha256 FROM o JOIN l ON o.label IS NOT DISTINCT FROM l.label CROSS JOIN d
    """


def op13() -> str:
    """Windows are compared as lists of words; the prior from sums in millionths of a millionth."""
    rules, strongest = host_rules.RULES, float(host_rules.STRONGEST)
    sums = ", ".join(f"sum(round(k_{r}::DOUBLE / n * 1e12)::DECIMAL(38, 0))::DOUBLE / count(*) / 1e12 AS m_{r}, sum(CASE WHEN n > 1 THEN round(k_{r}::DOUBLE * (k_{r}::DOUBLE - 1) / (n::DOUBLE * (n - 1)) * 1e12)::DECIMAL(38, 0) END)::DOUBLE / count(*) FILTER (n > 1) / 1e12 AS q_{r}" for r in rules)
    strengths = ", ".join(f"m_{r}, CASE WHEN q_{r} - m_{r} * m_{r} > 0 THEN least({strongest}, greatest(0.0, m_{r} * (1 - m_{r}) / (q_{r} - m_{r} * m_{r}) - 1)) ELSE {strongest} END AS s_{r}" for r in rules)
    rates = ", ".join(f"(k_{r} + s_{r} * m_{r}) / (n + s_{r}) AS r_{r}, m_{r}" for r in rules)
    watched = " OR ".join(f"(f_{r} AND r_{r} > {host_rules.WATCH} * m_{r} AND r_{r} > {host_rules.LEAST})" for r in rules)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS ls FROM d),
    g AS (SELECT k, i, ws[i : i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS x(i)),
    r AS (SELECT k, i FROM g QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
    c AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r, unnest(range(3)) AS y(j) GROUP BY k),
    f AS (SELECT doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c USING (k)),
    b AS (SELECT *, n_words < 50 AS f_short, 100 * n_repeat_words > 50 * n_words AS f_repeats, 10 * n_symbols > n_words AS f_symbols, 10 * n_dup_lines > 3 * n_lines AS f_lines, n_words > 0 AND (10 * word_chars < 25 * n_words OR word_chars > 12 * n_words) AS f_length FROM f),
    h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (f_{r}) AS k_{r}" for r in rules)} FROM b GROUP BY source),
    m AS (SELECT {sums} FROM h), s AS (SELECT {strengths} FROM m),
    p AS (SELECT source, {rates} FROM h CROSS JOIN s),
    j AS (SELECT b.*, greatest({", ".join(f"r_{r}" for r in rules)}) > {host_rules.REJECT} AS host_rejected, {watched} AS watched FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short OR f_repeats AS base_failed, host_rejected, NOT (f_short OR f_repeats OR host_rejected OR watched) AS kept FROM j
    """


ORACLES = {"op1_line_dedup": OP1, "op2_ngram_join": OP2, "op8_hilbert_shards": op8(), "op10_suffix_dedup": OP10, "op11_spelling_variants": OP11, "op12_vector_codes": op12(), "op13_host_rules": op13()}
