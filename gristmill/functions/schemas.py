"""Strict JSON schemas as Column expressions over VARIANT: what `connectors.violations` says, in the JVM."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORDS = frozenset({"type", "enum", "properties", "required", "additionalProperties", "items"})
#: How schema_of_variant names a value of each type; a whole number of 19 digits or more is a decimal there.
KINDS = {
    "object": r"\AOBJECT<",
    "array": r"\AARRAY<",
    "string": r"\ASTRING\z",
    "boolean": r"\ABOOLEAN\z",
    "integer": r"\A(BIGINT|DECIMAL\((19|[23][0-9]),0\))\z",
    "number": r"\A(BIGINT|DECIMAL\(.*|DOUBLE|FLOAT)\z",
}
NONE = "array<string>"


def parsed(text: Column) -> Column:
    """A JSON text as a VARIANT, null where it is none; nothing may follow the value, and no object repeats a key.

    The parser stops after a value. So it is given the value in brackets and in braces: what would end the one
    early is an error in the other.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    braced = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & braced.isNotNull(), F.get(listed, F.lit(0)))


def _one(message: Column) -> Column:
    return F.array(message)


def _check(value: Column, schema: Mapping[str, Any], at: Column) -> Column:
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"no such keyword: {', '.join(sorted(unknown))}")
    kind, found = schema.get("type"), []
    if "enum" in schema:
        # JSON tells 1 from true and "1", as the schema's type does
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]
        shown = F.to_json(value)
        found.append(F.when(~shown.isin(*allowed), _one(F.concat(at, F.lit(": "), shown, F.lit(" is not allowed")))).otherwise(F.array().cast(NONE)))
    if kind == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        own = lambda x, i: _check(x, schema.get("items", {}), F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))
        found.append(F.flatten(F.transform(items, own)))
    if kind == "object":
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        keys, known = F.map_keys(fields), schema.get("properties", {})
        for k in schema.get("required", ()):
            found.append(F.when(F.array_contains(keys, k), F.array().cast(NONE)).otherwise(_one(F.concat(at, F.lit(f".{k}: missing")))))
        if schema.get("additionalProperties") is False:
            extra = F.filter(keys, lambda k: ~k.isin(*known)) if known else keys
            found.append(F.transform(extra, lambda k: F.concat(at, F.lit("."), k, F.lit(": unknown"))))
        for k, own in known.items():
            found.append(F.when(F.array_contains(keys, k), _check(F.element_at(fields, k), own, F.concat(at, F.lit(f".{k}")))).otherwise(F.array().cast(NONE)))
    inside = F.concat(*found) if found else F.array().cast(NONE)
    if not kind:
        return inside
    return F.when(F.schema_of_variant(value).rlike(KINDS[kind]), inside).otherwise(_one(F.concat(at, F.lit(f": not {kind}"))))


def violations(text: Column, schema: Mapping[str, Any]) -> Column:
    """What a JSON text does that its schema forbids, as an array of "path: problem": types, enums, missing and extra fields.

    The schema is compiled to one expression; a keyword that it cannot express is a ValueError. An empty array is a
    valid text, null stays null, and what is no JSON is said to be so. A number with an exponent is shown as the JVM writes it.
    """
    value = parsed(text)
    found = F.when(value.isNull(), _one(F.lit("$: not JSON"))).otherwise(_check(value, schema, F.lit("$")))
    return F.when(text.isNotNull(), found)
