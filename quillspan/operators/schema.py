"""JSON Schema as one column expression: every violation of a JSON text, with its place and rule.

A schema is compiled once, on the driver, into nested array functions over VARIANT values; no row leaves the JVM. The
keywords are type, enum, const, pattern, minLength, maxLength, minimum, maximum, required, properties,
additionalProperties (false), items, minItems, maxItems and $ref into the schema's own $defs. A keyword holds for values
of its kind only, so a value of a wrong type violates the type rule alone.

Defined results: a text that is no JSON violates the rule json at the root; a null text too. A missing property violates
required where the schema asks for it, and nothing else; null is a value of its own kind. 1.0 is an integer.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import bound, col

VIOLATIONS = "array<struct<path:string,rule:string>>"
_NONE = f"cast(array() as {VIOLATIONS})"
_KEYWORDS = {"type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "$ref"}
_NOTES = {"$schema", "$id", "$defs", "title", "description", "default", "examples", "$comment"}


def _kind(v: Column) -> Column:
    """object, array, string, boolean, null, integer or number."""
    s = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    whole = F.when(number == F.floor(number), "integer").otherwise("number")
    named = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer"}
    out = None
    for start, kind in named.items():
        out = F.when(s.startswith(start), kind) if out is None else out.when(s.startswith(start), kind)
    return out.otherwise(whole)


def _resolve(schema: dict, root: dict) -> dict:
    seen = 0
    while "$ref" in schema:
        ref, seen = schema["$ref"], seen + 1
        if not ref.startswith("#/") or seen > 20:
            raise ValueError(f"can't follow {ref}")
        found = root
        for part in ref[2:].split("/"):
            found = found[part]
        schema = {**found, **{k: v for k, v in schema.items() if k != "$ref"}}
    unknown = set(schema) - _KEYWORDS - _NOTES
    if unknown:
        raise ValueError(f"keywords not supported: {sorted(unknown)}")
    return schema


def _node(schema: dict, root: dict, v: Column, path: Column, depth: int) -> Column:
    """Violations of one value; v is bound to a variable, so that it is computed once."""
    if depth > 30:
        raise ValueError("the schema refers to itself")
    schema = _resolve(schema, root)

    def of_kind(kind: Column) -> Column:
        checks, parts = [], []

        def rule(name: str, broken: Column, at: Column = path) -> None:
            checks.append(F.when(F.coalesce(broken, F.lit(False)), F.struct(at.alias("path"), F.lit(name).alias("rule"))))

        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            rule("type", ~kind.isin(*kinds, *(["integer"] if "number" in kinds else [])))
        if "enum" in schema or "const" in schema:
            allowed = schema.get("enum", [schema["const"]] if "const" in schema else [])
            rule("enum" if "enum" in schema else "const", ~F.to_json(v).isin(*(json.dumps(a, ensure_ascii=False) for a in allowed)))
        text, number, is_number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double"), kind.isin("integer", "number")
        if "pattern" in schema:
            rule("pattern", (kind == "string") & ~text.rlike(schema["pattern"]))
        if "minLength" in schema:
            rule("minLength", (kind == "string") & (F.length(text) < schema["minLength"]))
        if "maxLength" in schema:
            rule("maxLength", (kind == "string") & (F.length(text) > schema["maxLength"]))
        if "minimum" in schema:
            rule("minimum", is_number & (number < schema["minimum"]))
        if "maximum" in schema:
            rule("maximum", is_number & (number > schema["maximum"]))
        if {"required", "properties", "additionalProperties"} & set(schema):
            parts.append(F.when(kind == "object", bound(F.try_variant_get(v, "$", "map<string,variant>"), lambda m: _object(schema, root, m, path, depth))))
        if {"items", "minItems", "maxItems"} & set(schema):
            parts.append(F.when(kind == "array", bound(F.try_variant_get(v, "$", "array<variant>"), lambda a: _array(schema, root, a, path, depth))))
        own = F.array_compact(F.array(*checks)).cast(VIOLATIONS) if checks else F.expr(_NONE)
        return F.concat(own, *(F.coalesce(p, F.expr(_NONE)) for p in parts))

    return bound(_kind(v), of_kind)


def _object(schema: dict, root: dict, m: Column, path: Column, depth: int) -> Column:
    out = [F.array_compact(F.array(*(F.when(~F.map_contains_key(m, k), F.struct(F.concat(path, F.lit(f"/{k}")).alias("path"), F.lit("required").alias("rule"))) for k in schema["required"]))).cast(VIOLATIONS)] if schema.get("required") else []
    known = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        extra = F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.isin(*known) if known else F.lit(True)))
        out.append(F.transform(extra, lambda k: F.struct(F.concat(path, F.lit("/"), k).alias("path"), F.lit("additionalProperties").alias("rule"))))

    def held(k: str, s: dict) -> Column:
        child = bound(F.try_element_at(m, F.lit(k)), lambda c: _node(s, root, c, F.concat(path, F.lit(f"/{k}")), depth + 1))
        return F.when(F.map_contains_key(m, F.lit(k)), child).otherwise(F.expr(_NONE))

    out += [held(k, s) for k, s in known.items()]
    return F.concat(*out) if out else F.expr(_NONE)


def _array(schema: dict, root: dict, a: Column, path: Column, depth: int) -> Column:
    sized = [F.when(broken, F.struct(path.alias("path"), F.lit(name).alias("rule"))) for name, broken in (("minItems", F.size(a) < schema.get("minItems", 0)), ("maxItems", F.size(a) > schema.get("maxItems", 1 << 30))) if name in schema]
    own = F.array_compact(F.array(*sized)).cast(VIOLATIONS) if sized else F.expr(_NONE)
    if "items" not in schema:
        return own
    return F.concat(own, F.flatten(F.transform(a, lambda e, i: _node(schema["items"], root, e, F.concat(path, F.lit("/"), i.cast("string")), depth + 1))))


def violations(text: Column | str, schema: dict) -> Column:
    """All violations of a JSON text, as an array of structs path (like /entities/0/id, the root being empty) and rule."""
    whole = bound(F.try_parse_json(col(text)), lambda v: F.when(v.isNotNull(), _node(schema, schema, v, F.lit(""), 0)))
    return F.coalesce(whole, F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("rule"))).cast(VIOLATIONS))
