"""JSON schemas compiled to column expressions: what a text breaks of its schema, found where the text lies.

A schema becomes one expression over the parsed text that gives the list of everything that is wrong, each with its path. Known words: type,
enum, minimum, maximum, pattern, minLength, format (date-time), required, properties, additionalProperties (false), items, minItems, maxItems.
Any other word is an error, so that no rule is passed over in silence.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = {"type", "enum", "minimum", "maximum", "pattern", "minLength", "format", "required", "properties", "additionalProperties", "items", "minItems", "maxItems"}
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _own(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _shown(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("null"))


def _is(value: Column, shape: Column, kind: str) -> Column:
    number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    whole = _own(value, "double")
    return {
        "object": shape.startswith("OBJECT"), "array": shape.startswith("ARRAY"), "string": shape == "STRING", "boolean": shape == "BOOLEAN", "null": shape == "VOID",
        "number": number, "integer": number & (whole == F.floor(whole)),
    }[kind]


def _join(lists: list[Column]) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.coalesce(x, none) for x in lists])


def violations(value: Column, schema: Mapping, path: Column) -> Column:
    """Array of "path: what is wrong", empty if nothing is. value: a variant; one that is missing altogether breaks nothing by itself."""
    if unknown := set(schema) - WORDS:
        raise ValueError(f"schema words {sorted(unknown)} are not known")
    shape = F.schema_of_variant(value)
    found: list[Column] = []

    def rule(broken: Column, *said: Column | str) -> None:
        text = F.concat(path, F.lit(": "), *[F.lit(s) if isinstance(s, str) else s for s in said])
        found.append(F.when(F.coalesce(broken, F.lit(False)), F.array(text)))

    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        rule(~reduce(Column.__or__, [_is(value, shape, k) for k in kinds]), f"not of type {kinds}")
    if "enum" in schema:
        texts = [x for x in schema["enum"] if x is not None]
        if not all(isinstance(x, str) for x in texts):
            raise ValueError("an enum holds texts and null only")
        fits = (shape == "STRING") & _own(value, "string").isin(texts)
        rule(~(fits | (shape == "VOID") if None in schema["enum"] else fits), f"not one of {schema['enum']}")
    number = F.when(_is(value, shape, "number"), _own(value, "double"))
    if "minimum" in schema:
        rule(number < schema["minimum"], _shown(value), f" is below {schema['minimum']}")
    if "maximum" in schema:
        rule(number > schema["maximum"], _shown(value), f" is above {schema['maximum']}")
    text = F.when(shape == "STRING", _own(value, "string"))
    if "pattern" in schema:
        rule(~text.rlike(schema["pattern"]), _shown(value), f" does not match {schema['pattern']}")
    if "minLength" in schema:
        rule(F.char_length(text) < schema["minLength"], f"shorter than {schema['minLength']}")
    if schema.get("format") == "date-time":
        rule(~text.rlike(DATE_TIME), _shown(value), " is not a date and time")
    if "required" in schema or "properties" in schema:
        members = F.when(shape.startswith("OBJECT"), _own(value, "map<string,variant>"))
        keys = F.map_keys(members)
        for name in schema.get("required", []):
            rule(~F.array_contains(keys, name), f"lacks {name}")
        known = list(schema.get("properties", {}))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(keys, F.array(*[F.lit(k) for k in known]).cast("array<string>"))
            found.append(F.transform(extra, lambda k: F.concat(path, F.lit(": may not have "), k)))
        for name, inner in schema.get("properties", {}).items():
            member = members[name]
            found.append(F.when(member.isNotNull(), violations(member, inner, F.concat(path, F.lit(f".{name}")))))
    if "items" in schema or "minItems" in schema or "maxItems" in schema:
        items = F.when(shape.startswith("ARRAY"), _own(value, "array<variant>"))
        if "minItems" in schema:
            rule(F.size(items) < schema["minItems"], f"fewer than {schema['minItems']} items")
        if "maxItems" in schema:
            rule(F.size(items) > schema["maxItems"], f"more than {schema['maxItems']} items")
        if "items" in schema:
            each = F.transform(items, lambda x, i: violations(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            found.append(F.flatten(each))
    return _join(found)


def broken(ready: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """(path, problem): everything that the artifacts (path, kind, json) break of their kinds' schemas; a text that is no JSON, and a kind without a schema, too.

    Each kind is one plan over its own artifacts, so that none is checked against another kind's expression.
    """
    value = F.try_parse_json("json")
    known = ready.where(F.col("kind").isin(list(schemas)))
    out = ready.where(~F.coalesce(F.col("kind").isin(list(schemas)), F.lit(False))).select("path", F.concat(F.lit("$: no schema of kind "), F.coalesce("kind", F.lit("null"))).alias("problem"))
    for kind, schema in schemas.items():
        own = known.where(F.col("kind") == kind).withColumn("_value", value)
        problems = F.when(F.col("_value").isNull(), F.array(F.lit("$: no JSON"))).otherwise(violations(F.col("_value"), schema, F.lit("$")))
        out = out.unionByName(own.select("path", F.explode(problems).alias("problem")))
    return out
