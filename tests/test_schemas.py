"""Schemas as expressions say what the plain check says."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import schemas
from gristmill.sources import connectors

ANY = {"type": "object", "properties": {"a": {"type": "number"}, "b": {"enum": ["x", 1, True, None]}, "c": {"type": "array", "items": {"type": "array", "items": {"type": "integer", "enum": [0, 1]}}}, "d e": {}}, "required": ["a", "z"]}
SCHEMAS = {"batch": connectors.BATCH_SCHEMA, "context": connectors.CONTEXT_SCHEMA, "metadata": connectors.METADATA_SCHEMA, "any": ANY}


def made(rnd, schema, wrong):
    """A value that fits a schema but for a share of faults."""
    if rnd.random() < wrong:
        return rnd.choice([None, True, 0, 1, 7, -1.5, 10**20, "", "high", "é\"\n", [], {}, [None], {"rows": 1}, [[2, "x"]]])
    if "enum" in schema:
        return rnd.choice(schema["enum"])
    kind = schema.get("type", "string")
    if kind == "object":
        out = {k: made(rnd, v, wrong) for k, v in schema.get("properties", {}).items() if rnd.random() > wrong}
        return out | ({"more": 1} if rnd.random() < wrong else {})
    if kind == "array":
        return [made(rnd, schema.get("items", {}), wrong) for _ in range(rnd.randint(0, 3))]
    return {"string": "text", "integer": 3, "number": 2.5, "boolean": False}[kind]


@pytest.mark.parametrize("name", SCHEMAS)
def test_verdicts_are_those_of_the_plain_check(spark, name):
    rnd, schema = random.Random(name), SCHEMAS[name]
    texts = [json.dumps(made(rnd, schema, wrong), ensure_ascii=rnd.random() < 0.5) for wrong in (0.0, 0.05, 0.2) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", schemas.violations(F.col("t"), schema).alias("v"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in found.collect():
        assert sorted(r.v) == sorted(connectors.violations(json.loads(texts[r.i]), schema)), texts[r.i]


def test_texts_that_are_no_json(spark):
    texts = ["", "{", "5 6", '{"rows": []} and more', '{"rows": []}{"rows": []}', '5],[6', '5}, {"v":6', "[1,]", '{"a":1,"a":2}', "nul", None, ' {"rows": []} ', '{"rows": [], "x": 1}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.v for r in rows.select("i", schemas.violations(F.col("t"), connectors.BATCH_SCHEMA).alias("v")).collect()}
    assert all(got[i] == ["$: not JSON"] for i in range(10)) and got[10] is None and got[11] == [] and got[12] == ["$.x: unknown"]
    with pytest.raises(ValueError, match="minLength"):
        schemas.violations(F.col("t"), {"type": "string", "minLength": 1})
