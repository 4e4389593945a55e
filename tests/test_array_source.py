"""A JSON array read by ranges, against the standard library's parser."""

import gzip
import json
import random

import numpy as np
import pytest

from accordance.sources import array_source
from accordance.sources.array_source import split_json_array

SCHEMA = "id long, text string, tags array<string>, inner struct<a:long,b:string>"


def made(rng, n):
    bits = ['"', "\\", "\\\\", "{", "}", "[", "]", ",", "é", "🎉", "\n", "plain ", '\\"', "]}", "x" * 30]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    return [{"id": i, "text": rng.choice([text(), None]), "tags": [text() for _ in range(rng.randrange(3))], "inner": {"a": i % 7, "b": text()}, "unknown": [[{}]]} for i in range(n)]


def as_rows(df):
    return sorted((r.id, r.text, tuple(r.tags or ()), (r.inner.a, r.inner.b)) for r in df.collect())


def want(rows):
    return sorted((r["id"], r["text"], tuple(r["tags"]), (r["inner"]["a"], r["inner"]["b"])) for r in rows)


@pytest.mark.parametrize("span", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_find_every_record_once(tmp_path, span, indent):
    rng = random.Random(span)
    for k in range(6):
        rows = made(rng, rng.randrange(8))
        file = tmp_path / f"{k}-{span}.json"
        file.write_text(json.dumps(rows, ensure_ascii=bool(k % 2), indent=indent))
        size, inside, depth, found = file.stat().st_size, 0, 0, []
        for start in range(0, size, span):
            data = np.frombuffer(file.read_bytes()[start : start + span], np.uint8)
            found += array_source.records(str(file), start, min(start + span, size), size, bool(inside), depth)
            quotes, plain, quoted = array_source.summary(data, array_source._escaped(str(file), start, b""))
            depth += quoted if inside else plain
            inside = (inside + quotes) % 2
        assert [json.loads(x) for x in found] == rows


def test_many_tasks_read_one_file(spark, tmp_path):
    rows = made(random.Random(3), 400)
    (tmp_path / "one.json").write_text(json.dumps(rows))
    df = split_json_array(spark, str(tmp_path / "one.json"), SCHEMA, span=2000)
    assert as_rows(df) == want(rows)
    with gzip.open(tmp_path / "two.json.gz", "wt") as f:
        json.dump(rows[:20], f)
    (tmp_path / "three.json").write_text(" [ ]\n")
    (tmp_path / "four.json").write_text("")
    assert as_rows(split_json_array(spark, str(tmp_path), SCHEMA, span=4096)) == want(rows + rows[:20])


@pytest.mark.parametrize("text", ['{"id": 1}', "[1, 2]", '[{"id": 1}, null]', '[{"id": 1}, {"id": 2'])
def test_what_is_no_array_of_objects_fails(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="JSON array|isn't an object|inside a record"):
        split_json_array(spark, str(tmp_path / "bad.json"), "id long").collect()


def test_a_range_reads_little_beyond_its_end(tmp_path, monkeypatch):
    file, read = tmp_path / "a.json", []
    file.write_text(json.dumps([{"id": i, "text": "x" * 80} for i in range(4000)]))
    size, own = file.stat().st_size, array_source._read
    monkeypatch.setattr(array_source, "_read", lambda p, at, n: read.append(n) or own(p, at, n))
    found, inside, depth = 0, 0, 0
    for start in range(0, size, 1 << 14):
        stop = min(start + (1 << 14), size)
        found += len(list(array_source.records(str(file), start, stop, size, bool(inside), depth)))
        data = np.frombuffer(file.read_bytes()[start:stop], np.uint8)
        quotes, plain, quoted = array_source.summary(data, False)
        inside, depth = (inside + quotes) % 2, depth + (quoted if inside else plain)
    assert found == 4000 and sum(read) < 2 * size
