"""Compiled schemas: every keyword on values that hold and values that don't."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sorrel.operators import schemas

LINE = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 2}, "uniqueItems": True}}, "additionalProperties": False}
CASES = [
    ({"type": "integer"}, [(1, []), (1.0, []), (1.5, ["|type"]), ("1", ["|type"]), (None, ["|type"]), (True, ["|type"])]),
    ({"type": ["number", "null"]}, [(1, []), (1.5, []), (None, []), ([], ["|type"]), ({}, ["|type"])]),
    ({"enum": ["a", 1, None, [1, 2]]}, [("a", []), (1, []), (None, []), ([1, 2], []), ("b", ["|enum"]), ("1", ["|enum"])]),
    ({"const": {"b": 1, "a": 2}}, [({"a": 2, "b": 1}, []), ({"a": 2}, ["|const"])]),
    ({"pattern": "^a+$", "minLength": 2, "maxLength": 3}, [("aa", []), ("a", ["|minLength"]), ("aaaa", ["|maxLength"]), ("bb", ["|pattern"]), (7, [])]),
    ({"minimum": 1, "exclusiveMaximum": 3}, [(1, []), (0.5, ["|minimum"]), (3, ["|exclusiveMaximum"]), ("x", [])]),
    ({"maximum": 1, "exclusiveMinimum": 0}, [(1, []), (1.5, ["|maximum"]), (0, ["|exclusiveMinimum"])]),
    ({"format": "date"}, [("2024-02-29", []), ("2023-02-29", ["|format"]), ("2024-2-9", ["|format"]), (5, [])]),
    ({"format": "date-time"}, [("2024-02-29T10:00:00Z", []), ("2024-02-29 10:00:00", ["|format"])]),
    ({"format": "uri"}, [("https://a.example/x", []), ("no uri", ["|format"])]),
    ({"required": ["a", "b/c"]}, [({"a": None, "b/c": 1}, []), ({}, ["/a|required", "/b~1c|required"]), ([], [])]),
    ({"additionalProperties": {"type": "integer"}, "properties": {"a": True}}, [({"a": "x", "b": 1}, []), ({"b": "x"}, ["/b|type"])]),
    ({"properties": {"a": False}}, [({"b": 1}, []), ({"a": 1}, ["/a|false"])]),
    ({"items": {"$ref": "#/$defs/line"}, "minItems": 1, "maxItems": 2, "$defs": {"line": LINE}}, [
        ([{"n": 1, "tags": ["a"]}], []), ([], ["|minItems"]), ([{"n": 1}] * 3, ["|maxItems"]), ([{"n": 0}, {"tags": ["a", "a"], "x": 1}], ["/0/n|minimum", "/1/n|required", "/1/tags|uniqueItems", "/1/x|additionalProperties"]), ([{"n": 1, "tags": ["a", "long", 3]}, 5], ["/0/tags/1|maxLength", "/0/tags/2|type", "/1|type"])]),
    ({"contains": {"const": 1}}, [([2, 1], []), ([2], ["|contains"]), ("x", [])]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, [(1, []), (2.5, []), (3, ["|oneOf"]), (1.5, ["|oneOf"])]),
    ({"anyOf": [{"type": "null"}, {"const": True}]}, [(None, []), (True, []), (False, ["|anyOf"])]),
    ({"allOf": [{"type": "integer"}, {"minimum": 2}]}, [(2, []), (1, ["|minimum"]), (1.5, ["|minimum", "|type"])]),
    ({"not": {"type": "string"}}, [(1, []), ("x", ["|not"])]),
    ({"if": {"properties": {"k": {"const": "a"}}, "required": ["k"]}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}, [({"k": "a", "x": 1}, []), ({"k": "a"}, ["/x|required"]), ({"k": "b"}, ["/y|required"]), ({"y": 1}, [])]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_keywords(spark, case):
    schema, values = CASES[case]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(values)], "k int, doc string")
    got = {r["k"]: [f"{x['path']}|{x['rule']}" for x in r["v"]] for r in df.select("k", schemas.violations(F.col("doc"), schema).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(values)}


def test_texts_that_are_no_documents(spark):
    df = spark.createDataFrame([("{",), (None,), ("[" + ",".join(["1"] * 30) + "]",)], "doc string").select(schemas.violations(F.col("doc"), {"items": {"type": "string"}}).alias("v"))
    assert [[(x["path"], x["rule"]) for x in r["v"]] for r in df.collect()] == [[("", "json")], [], sorted((f"/{i}", "type") for i in range(30))[:10]]


def test_what_cannot_be_compiled():
    for schema in ({"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"$ref": "http://x"}, {"dependentSchemas": {}}, {"format": "idn"}):
        with pytest.raises(ValueError):
            schemas.Compiler(schema).check(schema)


def test_a_text_is_parsed_once(spark):
    df = spark.range(3).selectExpr("id", "concat('{\"a\":{\"b\":', id, '}}') AS doc")
    schema = {"required": ["c"], "properties": {"a": {"type": "object", "properties": {"b": {"maximum": 1, "minimum": 0}}}}}
    plan = df.select(schemas.violations(F.col("doc"), schema).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json(") + plan.lower().count("parsejson(") <= 1


def test_containers_are_not_written_with_their_children(spark, monkeypatch):
    from sorrel.operators import nested

    written, own = [], nested.kept
    monkeypatch.setattr(nested, "kept", lambda df, name: written.append(own(df, name)) or written[-1])
    df = spark.createDataFrame([(1, '{"a":[1,{"b":null}],"c":{}}')], "k int, doc string")
    got = {(r["pointer"], r["kind"], r["value"]) for r in nested.leaves(df, ["k"], "doc").collect()}
    assert got == {("/a/0", "number", "1"), ("/a/1/b", "null", None), ("/c", "object", "{}")}
    assert written and sum(x.where("_pos IS NOT NULL AND _v IS NOT NULL").count() for x in written) == 0
