"""How well the field finds layouts that it wasn't trained on: each is left out of training in turn, by kind."""

import random

import pytest

from accordance.llm import pii

LOW = "abcdefghijklmnopqrstuvwxyz"
#: Layouts that others of their kind stand in for, and those that nothing in training is like.
LIKE_OTHERS = [("email", 0), ("email", 1), ("email", 2), ("phone", 1), ("phone", 2), ("phone", 4), ("phone", 5), ("card", 0), ("card", 1), ("card", 2)]
UNLIKE = [("phone", 0), ("phone", 3), ("card", 3)]  # the only ones whose words are split by spaces


def made(rng):
    word = lambda: "".join(rng.choice(LOW) for _ in range(rng.randint(2, 9)))
    some = lambda: " ".join(word() for _ in range(rng.randint(3, 8)))

    def card():
        head = "".join(str(rng.randint(0, 9)) for _ in range(15))
        return next(head + str(c) for c in range(10) if pii.luhn(head + str(c)))

    return some, {"email": lambda: f"{word()}.{word()}@{word()}.com", "phone": lambda: f"+1{rng.randint(2000000000, 9999999999)}", "card": card}


def fitted(texts):
    rows, features = pii.labelled(texts, pii.written(24)), pii.Features()
    return pii.Crf(pii.LABELS).fit([features.of(w) for w, _ in rows], [t for _, t in rows])


def share_found(field, cases):
    """The share of (text, kind, start, stop) that an added span of the kind meets."""
    features, hits = pii.Features(), 0
    for text, kind, a, b in cases:
        base, found = pii.base_spans(text), []
        for words in pii.segments(text):
            found += pii.added_spans(text, words, field.viterbi([features.of([text[x:y] for x, y in words])])[0], base)
        hits += any(k == kind and s < b and e > a for k, s, e in found)
    return hits / len(cases)


@pytest.mark.parametrize(("kind", "at"), LIKE_OTHERS + UNLIKE)
def test_layouts_left_out_of_training(monkeypatch, kind, at):
    rng = random.Random(at + 10)
    some, value = made(rng)
    texts, whole, cases = [f"{some()} {value[k]()} {some()}." for _ in range(60) for k in value], pii.rewritten, []
    for _ in range(60):
        head, shown = f"{some()} ", whole(kind, value[kind]())[at]
        cases.append((f"{head}{shown} {some()}", kind, len(head), len(head) + len(shown)))
    assert share_found(fitted(texts), cases) >= 0.95  # trained on
    monkeypatch.setattr(pii, "rewritten", lambda k, v: [x for i, x in enumerate(whole(k, v)) if (k, i) != (kind, at)])
    found = share_found(fitted(texts), cases)
    assert found >= (0.8 if (kind, at) in LIKE_OTHERS else 0.0), found


@pytest.mark.parametrize("mark", ["Bearer ", "='", " = '", 'd = "', "ghp_"])
def test_secrets_left_out_of_training(monkeypatch, mark):
    whole = pii.written
    cases = [(text, *spans[0]) for text, spans in whole(60, 99) if spans and mark in text]
    monkeypatch.setattr(pii, "written", lambda count=40, seed=4: [x for x in whole(count, seed) if mark not in x[0]])
    assert not cases or share_found(fitted([]), cases) >= 0.6


def test_clean_numbers_are_left_alone():
    rng = random.Random(5)
    some, value = made(rng)
    field = fitted([f"{some()} {value[k]()} {some()}." for _ in range(60) for k in value])
    shown = [lambda: f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 9)},{rng.randint(100, 999)},{rng.randint(100, 999)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1, 999)} of {rng.randint(1, 999)}", lambda: f"room{rng.randint(1, 99)}"]
    cases = [(f"{some()} {make()} {some()}", k, 0, 1 << 20) for _ in range(30) for make in shown for k in (rng.choice(["phone", "card", "secret", "email"]),)]
    assert share_found(field, cases) <= 0.03
