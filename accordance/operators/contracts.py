"""Contracts of records as queries: every broken rule with its path. Nothing is dropped by a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, Column]


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, path, rule) for each rule (path, name, holds) that doesn't hold; a null outcome is a violation."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(name).alias("rule"))) for path, name, holds in rules]), lambda x: x.isNotNull())
    return df.select(F.col(key).alias("key"), F.explode(broken).alias("v")).select("key", "v.path", "v.rule")


def within(path: str, rules: list[Rule]) -> list[Rule]:
    """A nested record's rules under the path of its field."""
    return [(f"{path}.{p}", name, holds) for p, name, holds in rules]


def required(path: str) -> Rule:
    return path, "required", F.col(path).isNotNull()


def one_of(path: str, values: list[str]) -> Rule:
    return path, "enum", F.col(path).isin(values)


def at_least(path: str, least: float, null_ok: bool = True) -> Rule:
    return path, "minimum", (F.col(path) >= least) | (F.col(path).isNull() if null_ok else F.lit(False))


#: How a field's declared type is tested, on values that may have been read as strings.
_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string"}


def schema_rules(schema: dict, columns: list[str]) -> list[Rule]:
    """Rules of a JSON schema's required, type, enum, const, minimum, maximum, minItems and maxItems; fields that it doesn't name must be absent.

    A null is only judged by ``required``; a value of the wrong type is only reported as such.
    """
    rules = [required(c) for c in schema.get("required", ())]
    for name, kind in schema.get("properties", {}).items():
        if name not in columns:
            continue
        value = F.col(name)
        typed = F.expr(f"try_cast(`{name}` AS {_TYPES[kind['type']]})") if kind.get("type") in _TYPES else value
        absent = value.isNull() | (typed.isNull() if "type" in kind else F.lit(False))
        tests = {"enum": lambda v, x: x.isin(list(v)), "const": lambda v, x: x == F.lit(v), "minimum": lambda v, x: x >= v, "maximum": lambda v, x: x <= v, "minItems": lambda v, x: F.size(x) >= v, "maxItems": lambda v, x: F.size(x) <= v}
        if kind.get("type") in _TYPES:
            rules.append((name, "type", value.isNull() | typed.isNotNull()))
        rules += [(name, rule, absent | test(kind[rule], typed)) for rule, test in tests.items() if rule in kind]
    if not schema.get("additionalProperties", False):
        rules += [(c, "additional", F.col(c).isNull()) for c in columns if c not in schema.get("properties", {})]
    return rules


def artifact_rules() -> list[Rule]:
    """Rules of a validation artifact: resampled by run, both components present, ordered limits, counts that add up."""
    ordered = lambda c: (f"statistics.{c}.limits_of_agreement", "ordered", F.col(f"statistics.{c}.limits_of_agreement")[0] <= F.col(f"statistics.{c}.limits_of_agreement")[1])
    return [
        required("validation_model_id"), required("statistics.u"), required("statistics.v"),
        ("bootstrap.unit", "const", F.col("bootstrap.unit") == "run"), ordered("u"), ordered("v"),
        ("statistics.vector_difference_magnitude", "monotone", F.col("statistics.vector_difference_magnitude.p50") <= F.col("statistics.vector_difference_magnitude.p97_5")),
        ("direction", "partition", F.col("direction.n_defined") + F.col("direction.n_undefined") == F.col("support.n_windows")),
        ("support.n_runs", "minimum", F.col("support.n_runs") >= 20), ("support.n_vehicles", "minimum", F.col("support.n_vehicles") >= 10),
    ]


def feature_rules() -> list[Rule]:
    """Rules of a context feature: what is required, non-negative distances, and both ids of an uncertainty if any."""
    both = F.col("context_uncertainty.validation_model_id").isNotNull() & F.col("context_uncertainty.validation_regime").isNotNull()
    return [required("run_id"), required("window_start"), required("feature_name"), at_least("distance_km", 0), ("context_uncertainty", "required", F.col("context_uncertainty").isNull() | both)]
