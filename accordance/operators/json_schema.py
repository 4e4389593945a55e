"""JSON schemas compiled into one expression: every violation of a nested record with its full path.

A record is a VARIANT (``parse_json`` of a text). The compiler walks the schema once, on the driver,
through $ref, nested objects, array items, type unions and patterns; what comes out is a
column of native functions that Spark evaluates in its tasks. Only the schema is walked by Python, never
the data.

Supported: type (one or several), enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum,
minLength, maxLength, pattern, minItems, maxItems, items, required, properties, additionalProperties
(a boolean or a schema), allOf, $ref to ``#/...`` or to a schema of the registry by its $id or name.
Annotations are ignored, formats too, as validators do by default; any other keyword is refused, so
that no rule is passed over. References that lead back to themselves are refused.

Defined cases: a field that is absent is judged by ``required`` alone; null is a value, of type null; a
number without a fraction is an integer; a value of the wrong type is reported as such, and its
other rules are not judged; lengths count code points; a text that isn't JSON, or no text, violates ``json`` at the
root. Paths read ``a.b[2].c``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Schema = dict[str, Any] | bool
_ANNOTATIONS = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
_RULES = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "items", "required", "properties", "additionalProperties", "allOf", "$ref"}
#: Keywords that look into a value, or lead to schemas that may.
_NESTED = {"items", "minItems", "maxItems", "required", "properties", "additionalProperties", "$ref", "allOf"}
_FOUND = "array<struct<path:string,rule:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it: nested expressions share nothing of themselves."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(v: Column, names: list[str] | None, fields: Column | None = None, elements: Column | None = None) -> Column:
    """The JSON type of a variant; numbers without a fraction are integers where ``names``, the types that are asked for, tell these apart.

    Given as a map and as an array, only scalars are asked for their schema: that of an object or array is a walk over all that is in it.
    """
    number = F.lit("number")
    if names and "integer" in names and "number" not in names:
        number = _once(F.try_variant_get(v, "$", "double"), lambda x: F.when(x == F.floor(x), "integer").otherwise("number"))
    nested = lambda name: F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").otherwise(number)
    scalar = _once(F.schema_of_variant(v), lambda name: F.when(name == "STRING", "string").when(name == "BIGINT", "integer").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise(number if fields is not None else nested(name)))
    return scalar if fields is None else F.when(fields.isNotNull(), "object").when(elements.isNotNull(), "array").otherwise(scalar)


def _is(kind: Column, names: list[str]) -> Column:
    return kind.isin([*names, "integer"] if "number" in names else names)


def _equals(v: Column, kind: Column, x: Any) -> Column:
    if x is None:
        return kind == "null"
    if isinstance(x, bool):
        return (kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == x)
    if isinstance(x, (int, float)):
        return kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == float(x))
    if isinstance(x, str):
        return (kind == "string") & (F.try_variant_get(v, "$", "string") == x)
    raise ValueError("enum and const are supported for null, booleans, numbers and strings")


def _broken(holds: Column, path: Column, rule: str) -> Column:
    return F.when(~F.coalesce(holds, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(F.array().cast(_FOUND))


def _join(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def _all(parts: list[Column]) -> Column:
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0] if parts else F.array().cast(_FOUND)


class Compiler:
    """``registry``: further schemas by the names that references use."""

    def __init__(self, root: Schema, registry: dict[str, Schema] | None = None):
        self.registry = dict(registry or {})
        for schema in list(self.registry.values()):
            if isinstance(schema, dict) and "$id" in schema:
                self.registry[schema["$id"]] = schema
        self.root = root

    def resolved(self, ref: str, root: Schema) -> tuple[Schema, Schema]:
        """(schema, the document it stands in) that a reference names."""
        name, _, pointer = ref.partition("#")
        if name:
            found = self.registry.get(name) or next((s for k, s in self.registry.items() if k.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]), None)
            if found is None:
                raise ValueError(f"no such schema: {ref}")
            root = found
        schema = root
        for step in pointer.strip("/").split("/") if pointer.strip("/") else []:
            schema = schema[step.replace("~1", "/").replace("~0", "~")]
        return schema, root

    def compiled(self, v: Column) -> Column:
        """The violations of a variant, an array of (path, rule)."""
        return self._schema(self.root, self.root, v, F.lit(""), ())

    def _schema(self, schema: Schema, root: Schema, v: Column, path: Column, seen: tuple[str, ...]) -> Column:
        if isinstance(schema, bool):
            return self._judged(schema, root, v, v, v, v, path, seen)
        if not _NESTED & schema.keys():  # scalars alone, so that an object or array is an exception
            names = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type")
            return _once(v, lambda x: _once(_kind(x, names), lambda kind: self._judged(schema, root, x, F.lit(None), F.lit(None), kind, path, seen)))
        seen_as = lambda x: F.struct(x.alias("v"), F.try_variant_get(x, "$", "map<string,variant>").alias("fields"), F.try_variant_get(x, "$", "array<variant>").alias("elements"))
        judged = lambda b: _once(_kind(b["v"], ["integer"], b["fields"], b["elements"]), lambda kind: self._judged(schema, root, b["v"], b["fields"], b["elements"], kind, path, seen))
        return _once(v, lambda x: _once(seen_as(x), judged))

    def _judged(self, schema: Schema, root: Schema, v: Column, fields: Column, elements: Column, kind: Column, path: Column, seen: tuple[str, ...]) -> Column:
        if isinstance(schema, bool):
            return F.array().cast(_FOUND) if schema else _broken(F.lit(False), path, "false")
        if unknown := schema.keys() - _RULES - _ANNOTATIONS:
            raise ValueError(f"keywords that aren't supported: {', '.join(sorted(unknown))}")
        names = schema.get("type")
        names = [names] if isinstance(names, str) else names
        parts: list[Column] = []
        typed = _is(kind, names) if names else F.lit(True)
        if "$ref" in schema:
            key = f"{id(root)}{schema['$ref']}"
            if key in seen:
                raise ValueError(f"a reference that leads back to itself: {schema['$ref']}")
            target, document = self.resolved(schema["$ref"], root)
            parts.append(self._judged(target, document, v, fields, elements, kind, path, (*seen, key)))
        for one in schema.get("allOf", ()):
            parts.append(self._judged(one, root, v, fields, elements, kind, path, seen))
        if "enum" in schema:
            among = F.lit(False)
            for x in schema["enum"]:
                among |= _equals(v, kind, x)
            parts.append(_broken(among, path, "enum"))
        if "const" in schema:
            parts.append(_broken(_equals(v, kind, schema["const"]), path, "const"))
        number, text, size = F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string"), F.size(elements)
        limits: dict[str, tuple[list[str], Callable[[Any], Column]]] = {
            "minimum": (["number"], lambda x: number >= x), "maximum": (["number"], lambda x: number <= x),
            "exclusiveMinimum": (["number"], lambda x: number > x), "exclusiveMaximum": (["number"], lambda x: number < x),
            "minLength": (["string"], lambda x: F.length(text) >= x), "maxLength": (["string"], lambda x: F.length(text) <= x), "pattern": (["string"], lambda x: text.rlike(x)),
            "minItems": (["array"], lambda x: size >= x), "maxItems": (["array"], lambda x: size <= x),
        }
        for rule, (of, test) in limits.items():
            if rule in schema and (names is None or set(names) & {*of, "integer"}):
                parts.append(_broken(~_is(kind, of) | test(schema[rule]), path, rule))
        if "items" in schema:
            each = F.transform(elements, lambda x, i: self._schema(schema["items"], root, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen))
            parts.append(F.when(kind == "array", F.flatten(each)).otherwise(F.array().cast(_FOUND)))
        if {"required", "properties", "additionalProperties"} & schema.keys():
            parts.append(F.when(kind == "object", self._object(schema, root, fields, path, seen)).otherwise(F.array().cast(_FOUND)))
        whole = _all(parts)
        return F.when(typed, whole).otherwise(_broken(F.lit(False), path, "type")) if names else whole

    def _field(self, schema: Schema, root: Schema, path: Column, seen: tuple[str, ...], v: Column) -> Column:
        return F.when(v.isNotNull(), self._schema(schema, root, v, path, seen)).otherwise(F.array().cast(_FOUND))

    def _object(self, schema: dict[str, Any], root: Schema, fields: Column, path: Column, seen: tuple[str, ...]) -> Column:
        known = schema.get("properties", {})
        field = lambda name: F.try_element_at(fields, F.lit(name))  # noqa: E731  # a JSON null is a value, an absent field is none
        parts = [_broken(field(name).isNotNull(), _join(path, F.lit(name)), "required") for name in schema.get("required", ())]
        for name, inner in known.items():
            use = partial(self._field, inner, root, _join(path, F.lit(name)), seen)
            parts.append(_once(field(name), lambda x: use(x)))  # called at once
        more = schema.get("additionalProperties", True)
        if more is not True:
            others = F.map_entries(F.map_filter(fields, lambda k, _: ~k.isin(list(known)) if known else F.lit(True)))
            judged = lambda e: self._schema(more, root, e["value"], _join(path, e["key"]), seen) if more else F.array(F.struct(_join(path, e["key"]).alias("path"), F.lit("additionalProperties").alias("rule")))
            parts.append(F.flatten(F.transform(others, judged)))
        return _all(parts)


def violations(df: DataFrame, key: str, text: str, schema: Schema, registry: dict[str, Schema] | None = None) -> DataFrame:
    """(key, path, rule) for each rule that the JSON text of a row breaks."""
    parsed = F.try_parse_json(text)
    found = F.when(F.col("_v").isNull(), _broken(F.lit(False), F.lit(""), "json")).otherwise(Compiler(schema, registry).compiled(F.col("_v")))
    return df.select(F.col(key).alias("key"), parsed.alias("_v")).select("key", F.explode(found).alias("e")).select("key", "e.path", "e.rule")
