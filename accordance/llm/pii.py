"""Personal data and secrets: fixed patterns, and a linear-chain conditional random field that adds to them.

The fixed patterns (kinds email, ip, card, phone) give the base spans, which always stay.
The field labels the words of segments: runs of words around any word with a digit, ``@``,
``+`` or a spelled-out mark such as ``[at]``, as nothing else can start a span. Its features
are hashed word shapes of the word and its neighbours, and what the word is made of; its
labels are outside, or begin and inside of a kind, among them ``secret``: keys, tokens and
passwords, for which there is no base pattern. Its spans that touch no base span are added as
they are, but for marks around them and a name before ``=``. Decoding is Viterbi in numpy, for
batches of segments of similar length.

The labelled table is small: segments of at most about ``SAMPLE`` documents, labelled by
their base spans; the same with the spans re-written in layouts that the patterns miss; and
``WRITTEN`` sentences of each kind of secret and of harmless look-alikes, written from
templates by a seeded generator. Finding is one pass of ``mapInArrow`` without a shuffle.

Defined cases: a null text is empty and has no spans; all offsets are code points, ends
exclusive; matches that fail their test are dropped without another try; spans of different
kinds may overlap; with no document to train from, the written sentences remain; very long
texts and words cost linear time; ties of labels go to the first in the list; an empty table
gives an empty table; repeated rows are treated alike; only doc_id and text are read, so that
further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordance.llm.common import importable

KINDS = ("email", "ip", "card", "phone")
#: The kinds in the order of their spans; base patterns exist for the first four.
ALL_KINDS = (*KINDS, "secret")
SAMPLE, WRITTEN, EPOCHS, REACH, DIMS, WIDE, LONGEST = 800, 40, 40, 2, 1 << 12, 8, 24
#: How many digits an added span of a kind may have, as in the base.
_DIGITS = {"phone": (10, 15), "card": (14, 19)}
#: An @ with its domain. What stands before it is looked up by hand, so that long runs cost linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAY = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@+]|[\[(<{](?:at|dot)[\])>}]", re.IGNORECASE)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then by kind."""
    if not text or not _MAY.search(text):
        return []
    found: list[Span] = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- segments and features --------------------------------------------------------------------

LABELS = ["O"] + [f"{p}-{k}" for k in ALL_KINDS for p in "BI"]
Word = tuple[int, int]


def segments(text: str, reach: int = REACH) -> list[list[Word]]:
    """Runs of words (start, end) within ``reach`` words of a trigger."""
    marks = [m.start() for m in _TRIGGER.finditer(text)]
    if not marks:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    out: list[list[Word]] = []
    done, last = 0, -1
    for at in sorted({bisect.bisect_right(starts, m) - 1 for m in marks}):
        if out and at - reach <= last + reach:  # the same run goes on
            stop = min(len(words), at + reach + 1)
            out[-1] += words[done:stop]
        else:
            stop = min(len(words), at + reach + 1)
            out.append(words[max(done, at - reach) : stop])
        done, last = stop, at
    return out


_SHAPES = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters and digits by class, runs shortened with digits' count kept."""
    return _RUNS.sub(lambda m: m[1] + (str(min(len(m[0]), 9)) if m[1] == "d" else ""), word.translate(_SHAPES))


def _hash(kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind} {value}".encode(), digest_size=4).digest(), "little") % DIMS


class Features:
    """Hashed features of words, with a bounded memo by shape."""

    def __init__(self):
        self.memo: dict[tuple[str, str], int] = {}

    def number(self, kind: str, value: str) -> int:
        key = kind, value
        if (n := self.memo.get(key)) is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            n = self.memo[key] = _hash(kind, value)
        return n

    def of(self, words: list[str]) -> list[list[int]]:
        shapes = ["^"] + [shape(w) for w in words] + ["$"]
        rows = []
        for i, w in enumerate(words, 1):
            digits, classes = sum("0" <= c <= "9" for c in w), w.translate(_SHAPES)
            turns = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
            made = f"{min(len(w) // 4, 12)} {min(digits, 8)} {'x' in classes} {'X' in classes} {min(turns // 2, 6)}"
            rows.append([self.number("made", made), self.number("kinds", f"{'x' in classes} {'X' in classes} {min(turns, 6)} {digits > 1} {len(w) > 11}"), self.number("here", shapes[i]), self.number("before", shapes[i - 1]), self.number("after", shapes[i + 1]), self.number("both", f"{shapes[i - 1]} {shapes[i]}"), self.number("marks", "".join(sorted(set(re.sub(r"\w", "", w)))) + f" {min(digits, 20)}"), self.number("edge", f"{w[:1] if not w[:1].isalpha() else 'a'} {'@' in w} {w.count('.') if digits else ''}")])
        return rows


class Crf:
    """Emission weights by feature and label, and a transition matrix."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels, self.emit, self.step, self.first = labels, np.zeros((DIMS, k)), np.zeros((k, k)), np.zeros(k)

    def _padded(self, rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, rows))
        x = np.zeros((len(rows), longest, len(rows[0][0])), np.int64)
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
        return x, np.array([len(r) for r in rows])

    def fit(self, rows: list[list[list[int]]], tags: list[list[int]], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-4) -> Crf:
        """Maximum likelihood by full-batch Adam, gradients from forward and backward sums."""
        x, size = self._padded(rows)
        n, longest, _ = x.shape
        k = len(self.labels)
        inside = np.arange(longest)[None] < size[:, None]
        y = np.zeros((n, longest), int)
        for i, t in enumerate(tags):
            y[i, : len(t)] = t
        gold = np.zeros((n, longest, k))
        np.put_along_axis(gold, y[..., None], 1.0, 2)
        gold *= inside[..., None]
        params = [self.emit, self.step, self.first]
        moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for epoch in range(1, epochs + 1):
            e = self.emit[x].sum(2)
            weight, move = np.exp(e - e.max(2, keepdims=True)), np.exp(self.step)
            # sums over paths, scaled to 1 at each place
            ahead, back, scale = np.zeros((n, longest, k)), np.ones((n, longest, k)), np.ones((n, longest, 1))
            for t in range(longest):
                now = (np.exp(self.first) if not t else ahead[:, t - 1] @ move) * weight[:, t]
                scale[:, t] = np.where(inside[:, t, None], now.sum(1, keepdims=True), 1.0)
                ahead[:, t] = np.where(inside[:, t, None], now / scale[:, t], 0.0)
            for t in range(longest - 2, -1, -1):
                back[:, t] = np.where(inside[:, t + 1, None], (weight[:, t + 1] * back[:, t + 1] / scale[:, t + 1]) @ move.T, 1.0)
            node = ahead * back * inside[..., None]
            pair = np.zeros((k, k))
            for t in range(1, longest):
                pair += move * (ahead[:, t - 1].T @ (weight[:, t] * back[:, t] / scale[:, t] * inside[:, t, None]))
            real = np.zeros((k, k))
            np.add.at(real, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
            off = (node - gold)[inside]
            g = np.zeros_like(self.emit)
            for f in range(x.shape[2]):
                np.add.at(g, x[..., f][inside], off)
            for i, grad in enumerate((g / n + decay * self.emit, (pair - real) / n + decay * self.step, (node[:, 0] - gold[:, 0]).sum(0) / n)):
                moment[i] = 0.9 * moment[i] + 0.1 * grad
                second[i] = 0.99 * second[i] + 0.01 * grad * grad
                params[i] -= rate * (moment[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-8)
        return self

    def viterbi(self, rows: list[list[list[int]]]) -> list[list[int]]:
        """The best labels of each segment, in batches of similar length."""
        out: list[list[int]] = [[] for _ in rows]
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and len(rows[order[stop]]) <= 2 * len(rows[order[at]]) and (stop - at) * len(rows[order[stop]]) < 200_000:
                stop += 1
            own = order[at:stop]
            x, size = self._padded([rows[i] for i in own])
            e = self.emit[x].sum(2)
            best, back = self.first + e[:, 0], np.zeros((len(own), x.shape[1], len(self.labels)), np.int8)
            stay = np.arange(len(self.labels))
            for t in range(1, x.shape[1]):
                s = best[:, :, None] + self.step
                back[:, t] = s.argmax(1)
                live = (t < size)[:, None]
                best = np.where(live, s.max(1) + e[:, t], best)
                back[:, t] = np.where(live, back[:, t], stay)
            label = best.argmax(1)
            path = np.zeros((len(own), x.shape[1]), int)
            for t in range(x.shape[1] - 1, -1, -1):
                path[:, t] = label
                label = back[np.arange(len(own)), t, label]
            for j, i in enumerate(own):
                out[i] = path[j, : size[j]].tolist()
            at = stop
        return out


# --- training table ---------------------------------------------------------------------------


def _tags(words: list[Word], spans: list[Span]) -> list[int]:
    tags = [0] * len(words)
    for kind, a, b in spans:
        own = [i for i, (s, e) in enumerate(words) if s < b and e > a]
        for j, i in enumerate(own):
            if not tags[i]:
                tags[i] = LABELS.index(("I-" if j else "B-") + kind)
    return tags


def rewritten(kind: str, value: str) -> list[str]:
    """Layouts of a value that the fixed patterns miss."""
    digits = _digits(value)
    if kind == "email":
        local, _, domain = value.partition("@")
        return [f"{local} @ {domain}", f"{local}@ {domain}", f"{local} [at] {domain}"]
    if kind == "phone":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"({a}){b}-{c}"]
    if kind == "card":
        return [mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for mark in (".", "/", "_", " - ")]
    return []


def written(count: int = WRITTEN, seed: int = 4) -> list[tuple[str, list[Span]]]:
    """Sentences with their labelled spans: secrets in their usual layouts, and harmless words that look alike."""
    rng = random.Random(seed)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper, hexes, mixed, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"
    word = lambda: draw(low, rng.randint(2, 9)).capitalize() if rng.random() < 0.15 else draw(low, rng.randint(2, 9))
    name = lambda: rng.choice(["password", "passwd", "secret", "token", "api_key", "key", "auth"])
    value = lambda: draw(*rng.choice([(hexes, rng.randint(14, 44)), (mixed, rng.randint(14, 44))]))
    secret = [
        lambda: ("", draw("AKS", 2) + draw(upper, rng.randint(16, 22)), ""), lambda: (f"{name()}=", value(), ""), lambda: (f"{name()}: ", value(), ""),
        lambda: (f'{name()} = "', value(), '"'), lambda: (f"{name()} = '", value(), "'"), lambda: ("Bearer ", value(), ""), lambda: ("", rng.choice(["sk-", "ghp_", "xoxb-"]) + value(), ""),
        lambda: ("", draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", rng.randint(18, 24)), ""),
    ]
    harmless = [
        lambda: f"{rng.randint(1, 30)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1990, 2030)}", lambda: f"{draw(low, 4)}{rng.randint(1, 99)}", lambda: f"{draw(upper[:26], 3)}-{rng.randint(1, 999)}",
        lambda: f"{rng.randint(1, 999)},{rng.randint(100, 999)}", lambda: f"${rng.randint(1, 99)}.{rng.randint(10, 99)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 40)}.", lambda: f"{name()} = {rng.randint(1, 99)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 999)} {word()} {rng.randint(1, 999)}",
    ]
    out = []
    for _ in range(count):
        for make in secret:
            before, inside, after = make()
            head = " ".join(word() for _ in range(rng.randint(1, 5))) + " " + before
            out.append((f"{head}{inside}{after} {' '.join(word() for _ in range(rng.randint(1, 5)))}", [("secret", len(head), len(head) + len(inside))]))
        for make in harmless:
            out.append((f"{' '.join(word() for _ in range(rng.randint(1, 5)))} {make()} {' '.join(word() for _ in range(rng.randint(1, 5)))}", []))
    return out


def labelled(texts: list[str], more: list[tuple[str, list[Span]]] = ()) -> list[tuple[list[str], list[int]]]:
    """The labelled table: the words of a segment and their labels; long segments in pieces of ``LONGEST`` words."""
    out = []

    def add(words: list[str], tags: list[int]) -> None:
        out.extend((words[i : i + LONGEST], tags[i : i + LONGEST]) for i in range(0, len(words), LONGEST))

    for text, known in [*((t, None) for t in texts), *more]:
        spans = base_spans(text)
        spans += [s for s in known or () if not any(b < s[2] and e > s[1] for _, b, e in spans)]
        for words in segments(text):
            own = [s for s in spans if s[1] >= words[0][0] and s[2] <= words[-1][1]]
            if known is None and any(_looks_secret(text[a:b]) for a, b in words):
                continue  # not labelled by the patterns: the written sentences say what these are
            add([text[a:b] for a, b in words], _tags(words, own))
            if known is None and len(own) == 1:
                kind, a, b = own[0]
                for other in rewritten(kind, text[a:b]):
                    lo, hi = words[0][0], words[-1][1]
                    new = text[lo:a] + other + text[b:hi]
                    bounds = [m.span() for m in _WORD.finditer(new)]
                    add([new[s:e] for s, e in bounds], _tags(bounds, [(kind, a - lo, a - lo + len(other))]))
    return out


def _looks_secret(word: str) -> bool:
    """Long, of letters and digits in turns, and no address: such a word isn't taken for harmless in training."""
    return len(word) > 13 and "@" not in word and any(c.isdigit() for c in word) and sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:], strict=False)) > 1 and any(c.isalpha() for c in word)


def train(docs: DataFrame, sample: int = SAMPLE, examples: int = WRITTEN) -> Crf:
    """The field, from the segments of at most about ``sample`` documents and ``examples`` sentences of each template."""
    able = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    n = able.count()
    drawn = able.filter(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 20)) < min(1.0, sample / max(n, 1)) * (1 << 20)).orderBy("doc_id", "text")
    rows = labelled([r["text"] for r in drawn.select("text").toLocalIterator()], written(examples))
    field, features = Crf(LABELS), Features()
    return field.fit([features.of(w) for w, _ in rows], [t for _, t in rows]) if rows else field


def added_spans(text: str, words: list[Word], tags: list[int], base: list[Span]) -> list[Span]:
    """The field's spans that touch no base span, without marks around them and a name before a secret; phones and cards have as many digits as in the base."""
    out: list[Span] = []
    i = 0
    while i < len(tags):
        if not tags[i]:
            i += 1
            continue
        kind = LABELS[tags[i]][2:]
        j = i + 1
        while j < len(tags) and LABELS[tags[j]] == f"I-{kind}":
            j += 1
        a, b = words[i][0], words[j - 1][1]
        if kind == "secret" and (m := re.match(r"\w+[=:](?=.)", text[a:b])):
            a += m.end()
        while a < b and text[a] in "\"'<[{,;:=.":
            a += 1
        while b > a and text[b - 1] in "\"'>]},;:!?.":
            b -= 1
        least, most = _DIGITS.get(kind, (0, 1 << 30))
        if a < b and least <= len(_digits(text[a:b])) <= most and not any(s < b and e > a for _, s, e in base):
            out.append((kind, a, b))
        i = j
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Crf) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, personal (any span)."""
    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans", "personal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, features = sent.value, Features()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            base = [base_spans(x) for x in texts]
            where, runs = [], []
            for i, text in enumerate(texts):
                for words in segments(text):
                    where.append((i, words))
                    runs.append(features.of([text[a:b] for a, b in words]))
            extra: list[list[Span]] = [[] for _ in texts]
            if runs and field.emit.any():
                for (i, words), tags in zip(where, field.viterbi(runs), strict=True):
                    extra[i] += added_spans(texts[i], words, tags, base[i])
            every = [sorted(a + b, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2])) for a, b in zip(base, extra, strict=True)]
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(x) for x in every], pa.string()), pa.array([len(x) for x in extra], pa.int64()), pa.array([len(x) for x in every], pa.int64()), pa.array([bool(x) for x in every], pa.bool_())], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long, n_spans long, personal boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
