"""Compiled schemas on nested records, rule by rule."""

import json

import pytest

from accordance.operators.json_schema import Compiler, violations

POINT = {"$id": "https://example.org/point.json", "type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "number", "exclusiveMinimum": 0}, "label": {"type": ["string", "null"], "enum": ["low", "high", None]}}}
SCHEMA = {
    "$defs": {"code": {"type": "string", "pattern": "^[A-Z]{2}[0-9]+$", "maxLength": 5}},
    "type": "object", "required": ["id", "points"], "additionalProperties": False,
    "properties": {
        "id": {"$ref": "#/$defs/code"}, "n": {"type": ["integer", "null"], "minimum": 1}, "unit": {"const": "run"}, "deep": {"allOf": [{"type": "object"}, {"required": ["a"]}]},
        "points": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "point.json"}}, "free": {"type": "object", "additionalProperties": {"type": "array", "items": {"type": "array", "items": {"type": "boolean"}}}},
    },
}
GOOD = {"id": "AB12", "points": [{"x": 1}]}
CASES = [
    (GOOD, set()),
    (GOOD | {"n": None, "unit": "run", "free": {"a": [[True], []]}, "deep": {"a": None}}, set()),
    (GOOD | {"n": 2.0}, set()),
    (GOOD | {"n": 2.5}, {("n", "type")}),
    (GOOD | {"n": "2"}, {("n", "type")}),
    (GOOD | {"n": 0}, {("n", "minimum")}),
    (GOOD | {"n": True}, {("n", "type")}),
    (GOOD | {"unit": None}, {("unit", "const")}),
    (GOOD | {"id": "ab"}, {("id", "pattern")}),
    (GOOD | {"id": "AB123456"}, {("id", "maxLength")}),
    (GOOD | {"deep": {}}, {("deep.a", "required")}),
    (GOOD | {"deep": [1]}, {("deep", "type")}),
    (GOOD | {"more": 1}, {("more", "additionalProperties")}),
    (GOOD | {"points": []}, {("points", "minItems")}),
    (GOOD | {"points": {"x": 1}}, {("points", "type")}),
    (GOOD | {"points": [{"x": 1}, {"x": 0, "y": 1}, {"label": "mid"}]}, {("points[1].x", "exclusiveMinimum"), ("points[1].y", "additionalProperties"), ("points[2].x", "required"), ("points[2].label", "enum")}),
    (GOOD | {"points": [{"x": 1}, 7, None]}, {("points[1]", "type"), ("points[2]", "type")}),
    (GOOD | {"free": {"a": [[True, 1], 2], "b": None}}, {("free.a[0][1]", "type"), ("free.a[1]", "type"), ("free.b", "type")}),
    ({"id": "AB1"}, {("points", "required")}),
    ([], {("", "type")}),
    (None, {("", "type")}),
]


def test_every_rule_reports_its_path(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(CASES)] + [(100, "{broken"), (101, None)]
    found = {}
    for r in violations(spark.createDataFrame(rows, "id long, doc string"), "id", "doc", SCHEMA, {"point.json": POINT}).collect():
        found.setdefault(r.key, set()).add((r.path, r.rule))
    for i, (_, want) in enumerate(CASES):
        assert found.get(i, set()) == want, CASES[i][0]
    assert found[100] == found[101] == {("", "json")}


def test_what_cannot_be_judged_is_refused(spark):
    from pyspark.sql import functions as F

    v = F.parse_json(F.lit("{}"))
    for schema, said in (({"oneOf": []}, "oneOf"), ({"$ref": "gone.json"}, "no such schema"), ({"$defs": {"a": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}, "leads back"), ({"enum": [[1]]}, "enum and const")):
        with pytest.raises(ValueError, match=said):
            Compiler(schema).compiled(v)


def test_a_value_is_parsed_once_however_many_rules_name_it(spark):
    df = spark.createDataFrame([(1, "{}")], "id long, doc string")
    rules = {f"p{i}": {"type": "integer", "minimum": 0, "maximum": 9} for i in range(4)}
    plan = violations(df, "id", "doc", {"type": "object", "properties": {"a": {"type": "object", "properties": rules}}})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SchemaOfVariant.schemaOfVariant") <= 6  # one for each schema, and only of scalars
