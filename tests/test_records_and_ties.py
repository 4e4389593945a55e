"""What fails a query, ranks of one value by many tasks, manifests."""

import json

import pytest
from pyspark.sql import functions as F

from accordance.functions.classify import exclusion_id, markers_of
from accordance.operators import json_schema, ranking
from accordance.sources import readers, sinks


def test_markers_are_sorted_and_must_be_there(spark):
    df = spark.createDataFrame([("a", "0005"), ("a", "0001"), ("a", "0001"), ("b", "0001"), ("b", None), ("b", " ")], "g string, m string")
    assert {r.g: r.m for r in df.groupBy("g").agg(markers_of(F.col("m")).alias("m")).collect()} == {"a": "0001,0005", "b": "0001"}
    with pytest.raises(Exception, match="no release marker"):
        df.filter("m is null or m = ' '").groupBy("g").agg(markers_of(F.col("m"))).collect()


@pytest.mark.parametrize(("start", "end", "said"), [("2024-01-02 00:00", "2024-01-01 00:00", "ends before"), ("2024-01-31 23:00", "2024-02-01 00:00", "more than one month"), (None, "2024-01-01 00:00", "without start")])
def test_requests_that_cannot_be_asked_fail(spark, start, end, said):
    df = spark.createDataFrame([(start, end)], "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    with pytest.raises(Exception, match=said):
        df.select(readers.asked_hours(F.col("a"), F.col("b"))).collect()


def test_request_hours(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 01:59:00' AS a, timestamp'2024-01-01 03:00:00' AS b")
    assert [h.hour for h in df.select(readers.asked_hours(F.col("a"), F.col("b")).alias("h")).first().h] == [1, 2, 3]


def test_references_of_every_form(spark):
    forms = {" abc ": "abc", "https://x.example/f/abc.ulg": "abc", "https://x.example/plot?log_id=abc&p=1": "abc", "abc.ulg": "abc.ulg", "https://x.example/abc": "abc"}
    rows = spark.createDataFrame(list(forms.items()), "a string, want string").withColumn("got", exclusion_id(F.col("a"))).collect()
    assert all(r.got == r.want for r in rows)


@pytest.mark.parametrize("weighted", [False, True])
def test_one_value_is_ranked_by_many_tasks(spark, weighted):
    rows = [("g", 5.0 if i % 3 else float(i % 7), i * 37 % 500, i, 1.0 + i % 2) for i in range(500)] + [("h", 1.0, i % 2, i, 1.0) for i in range(40)] + [(None, 2.0, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, a long, b long, w double")
    whole, split = ({(r.g, r.b): (r["rank"], r.group_n, *([r.weight_before, r.group_weight] if weighted else [])) for r in ranking.ranked(df, ["g"], "v", ["a", "b"], "w" if weighted else None, large=n).collect()} for n in (1 << 30, 20))
    assert whole == split and len(whole) == len(rows)
    order = sorted(r[1:4] for r in rows if r[0] == "g")
    assert all(split["g", b][0] == i + 1 for i, (_, _, b) in enumerate(order))


def test_arrays_are_written_by_partition(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"]', None), (2, "b\n", 2.5)], "k long, t string, x double")
    sinks.write_arrays(df.repartition(3), str(tmp_path / "a"))
    found = [r for f in (tmp_path / "a").glob("part-*") for r in json.loads(f.read_text())]
    assert sorted(found, key=lambda r: r["k"]) == [{"k": 1, "t": 'a"]', "x": None}, {"k": 2, "t": "b\n", "x": 2.5}]


def test_a_manifest_names_its_inputs_and_keeps_its_rules(spark, tmp_path):
    df = spark.range(5)
    record = sinks.recorded(df, str(tmp_path / "t"), "t", 1, "r", True)
    made = sinks.manifest(record, {"b": df, "a": df.limit(2)})
    text = json.loads(made.first().manifest)
    assert [(i["name"], i["rows"]) for i in text["inputs"]] == [("a", 2), ("b", 5)] and text["versions"]["spark"] == spark.version
    assert json_schema.violations(made, "name", "manifest", sinks.MANIFEST).count() == 0
    cut = made.withColumn("manifest", F.lit(json.dumps(text | {"inputs": [], "digest": "x"})))
    assert {(r.path, r.rule) for r in json_schema.violations(cut, "name", "manifest", sinks.MANIFEST).collect()} == {("inputs", "minItems"), ("digest", "pattern")}
