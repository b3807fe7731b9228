"""Strict reading of JSON lines: one broken rule at a time."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail.sources import readers, sinks

SMALL = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.BooleanType()),
                      T.StructField("d", T.DoubleType()), T.StructField("e", T.ArrayType(readers.RECT)), T.StructField("f", T.ArrayType(T.StringType()))])
RECT = '{"x":0,"y":0.5,"width":1,"height":0.25}'
GOOD = '{"a":1,"b":"t","c":true,"d":0.5,"e":[' + RECT + '],"f":["u"]}'

CASES = {
    GOOD: "", GOOD.replace('"d":0.5', '"d":2'): "", GOOD.replace("[" + RECT + "]", "[]"): "", " " + GOOD + " ": "",
    '{"a":null,"b":null,"c":null,"d":null,"e":null,"f":null}': "",
    "": "empty_line", "   ": "empty_line", "{": "malformed", GOOD + " x": "malformed", GOOD + "," + GOOD: "malformed", GOOD + GOOD: "malformed", "]" + GOOD + "[": "malformed", GOOD + "] x": "malformed", GOOD + ',""] x': "malformed",
    GOOD.replace("0.5", "NaN"): "malformed", "[1]": "not_object", "3": "not_object", "null": "not_object",
    GOOD.replace('"a":1', '"a":1,"a":1'): "repeated_member", GOOD.replace('"x":0', '"x":0,"x":0'): "repeated_member",
    GOOD.replace('"a":1', '"a":1.0'): "type:a", GOOD.replace('"a":1', '"a":true'): "type:a", GOOD.replace('"b":"t"', '"b":7'): "type:b", GOOD.replace("true", "1"): "type:c",
    GOOD.replace('"d":0.5', '"d":"0.5"'): "type:d", GOOD.replace('"x":0', '"x":"0"'): "type:e", GOOD.replace('"x":0', '"x":null'): "type:e", GOOD.replace('"x":0,', ""): "type:e",
    GOOD.replace('"x":0', '"x":0,"z":0'): "type:e", GOOD.replace(RECT, RECT + "," + RECT.replace('"x":0,', "")): "type:e", GOOD.replace("[" + RECT + "]", RECT): "type:e",
    GOOD.replace('["u"]', '["u",1]'): "type:f", GOOD.replace('"c":true,', ""): "missing:c", GOOD.replace('"a":1', '"z":1,"y":2'): "missing:a,unknown:y,unknown:z",
}


@pytest.fixture(scope="module")
def judged(spark):
    lines = spark.createDataFrame([(line,) for line in CASES], "value string")
    rows = readers.parse_strict(lines, SMALL, {}).select("value", F.array_join("errors", ",").alias("errors"), "row").collect()
    return {r.value: r for r in rows}


@pytest.mark.parametrize("line", CASES)
def test_each_broken_rule_is_named(judged, line):
    assert judged[line].errors == CASES[line]
    assert (judged[line].row is None) == bool(CASES[line])


def test_null_line_and_clashing_columns(spark):
    frame = spark.createDataFrame([(None, 1), (GOOD, 2)], "value string, v int")
    rows = {r.v: r.errors for r in readers.parse_strict(frame, SMALL, {}).collect()}
    assert rows == {1: ["empty_line"], 2: []}


def test_written_results_are_strict(spark, tmp_path):
    values = {f.name: None for f in readers.RESULT_ROW.fields} | {
        "row_id": "r", "schema_version": 1, "seed": 20260827, "psnr_db": "Infinity", "ssim": 1.0, "eligible": True, "tamper_ground_truth": [(0.0, 0.0, 0.5, 0.5)], "limitations": []}
    from decimal import Decimal
    values["seed"] = Decimal(20260827)
    rows = spark.createDataFrame([tuple(values.values())], readers.RESULT_ROW)
    sinks.write_results(rows, str(tmp_path / "out"))
    back, rejected = readers.read_strict(spark, str(tmp_path / "out" / "results.jsonl"))
    assert rejected.collect() == [] and back.collect() == rows.collect()


def test_members_of_open_and_crafted_objects(spark):
    """The type of a whole object must not let through what its members, asked one by one, would not."""
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("c", T.BooleanType()), T.StructField("f", T.ArrayType(T.StringType()))])
    cases = {'{"a":{"k":1},"c":true,"f":[]}': "", '{"a":{"k":{"l":[1]}},"c":null,"f":["u","v"]}': "", '{"a":{"k":{}},"b":{"k":1},"c":true,"f":null}': "unknown:b",
             '{"a":{"k":1,"x>, c: BOOLEAN, f: ARRAY<VOID":2},"c":1,"f":[]}': "type:c", '{"a: STRING, c":"t","f":[]}': "missing:a,missing:c,unknown:a: STRING, c",
             '{"a":"t","c":true,"f":[null]}': "type:f", '{"a":"t","c":true,"f":["u",null]}': "type:f", '{"a":[1],"c":true,"f":[["u"]]}': "type:a,type:f"}
    lines = spark.createDataFrame([(line,) for line in cases], "value string")
    for kinds in ({"a": "STRING|OBJECT<.*>"}, {"a": "STRING|OBJECT<.+>"}):
        found = readers.parse_strict(lines, schema, kinds).select("value", F.array_join("errors", ",").alias("errors")).collect()
        assert {r.value: r.errors for r in found} == cases


def test_rules_are_compiled(spark):
    """No rule of a member stands in a generator with a loop or under one: Spark would interpret all of them for every line."""
    text = readers.parse_strict(spark.createDataFrame([(GOOD,)], "value string"), SMALL, {})._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in text.split("\n") if "Generate explode" in line and "lambdafunction" in line]
    assert "filter(array(CASE WHEN" not in text
