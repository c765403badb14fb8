"""Schemas, cascades, contracts and incremental derivation, beyond their queries."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import cascade, chain, schema
from quillspan.sources import incremental


def test_schema_rules(spark):
    s = {
        "type": "object",
        "additionalProperties": False,
        "required": ["id", "items"],
        "properties": {
            "id": {"type": "string", "pattern": "^E[0-9]+$", "minLength": 2, "maxLength": 4},
            "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 5},
            "k": {"enum": ["a", 3]},
            "c": {"const": "x"},
            "items": {"type": "array", "minItems": 1, "maxItems": 4, "items": {"$ref": "#/$defs/x"}},
        },
        "$defs": {"x": {"type": "object", "required": ["v"], "properties": {"v": {"type": "number", "minimum": 0}}}},
    }
    cases = {
        '{"id":"E1","items":[{"v":1}]}': [],
        '{"id":"X","items":[],"n":9,"zz":1}': [("/id", "minLength"), ("/id", "pattern"), ("/items", "minItems"), ("/n", "maximum"), ("/zz", "additionalProperties")],
        '{"id":5,"n":1.5,"k":"c","items":[{"v":-1},{"w":2},3,{"v":"x"}]}': [("/id", "type"), ("/items/0/v", "minimum"), ("/items/1/v", "required"), ("/items/2", "type"), ("/items/3/v", "type"), ("/k", "enum"), ("/n", "type")],
        "nope": [("", "json")],
        None: [("", "json")],
        "[1]": [("", "type")],
        "{}": [("/id", "required"), ("/items", "required")],
        '{"id":"E1","items":[{"v":1e-3},{"v":1.0}],"n":null,"k":3,"c":"x"}': [],
        '{"id":"E12345","items":null,"n":2.0,"k":null,"c":"y"}': [("/c", "const"), ("/id", "maxLength"), ("/items", "type"), ("/k", "enum")],
        '{"id":"Eé","items":[{"v":0},{"v":0},{"v":0},{"v":0},{"v":true}]}': [("/id", "pattern"), ("/items", "maxItems"), ("/items/4/v", "type")],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r["k"]: sorted(map(tuple, r["v"])) for r in rows.select("k", schema.violations("t", s).alias("v")).collect()}
    assert got == dict(enumerate(cases.values()))
    for bad in ({"oneOf": []}, {"$ref": "other.json"}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}):
        with pytest.raises(ValueError):
            schema.violations("t", bad)


def test_cascade(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, None), (1, 5.0), (1, 4.0), (2, -1.0)], "k int, x double")
    c = cascade.cascade(rows, {"low": F.col("x") > 0, "high": F.col("x") < 100})
    kept = cascade.keep_best(c, ["k"], [F.desc("x")], "second")
    assert sorted(map(tuple, cascade.diagnostics(kept, ["k"], ["low", "high", "second"]).collect())) == [(1, 4, 1, 0, 2, 1), (2, 1, 1, 0, 0, 0)]


def test_clean_runs_have_no_faults(spark):
    jobs = spark.createDataFrame([(0, "d1_a", "d1"), (1, "d1_b", "d1"), (2, "d2_a", "d2")], "position long, job_id string, document_id string")
    gold, index = jobs.select("position", "document_id"), jobs.select("position", "job_id", F.col("position").alias("record_index"))
    segs = jobs.select("job_id", F.lit("S1").alias("segment_id"), F.lit("text").alias("text"), F.lit(3).alias("start"), F.lit(7).alias("end"))
    assert chain.input_faults(jobs, gold, index, segs).count() == 0
    assert {r["rule"] for r in chain.input_faults(jobs, gold.limit(2), index, segs.withColumn("job_id", F.concat(F.lit("z"), "job_id"))).collect()} == {"missing_gold", "unknown_segment_job", "no_segments"}
    e = jobs.select("position", F.col("job_id").alias("job"))
    log = e.select("job", F.when(F.col("position") == 2, "failed").otherwise("success").alias("status"))
    part = e.filter("position < 2").select("job", F.lit("x").alias("digest"))
    done = e.select("position", "job", F.when(F.col("position") < 2, "x").alias("digest"), F.when(F.col("position") < 2, 1).otherwise(0).alias("n_items"))
    assert chain.run_faults(e, log, part, done, e.select("job"), {"f1": 3}).count() == 0
    assert [tuple(r) for r in chain.run_faults(e, log, part, done, e.select("job"), {"f1": 4}).collect()] == [("denominator:f1", None)]


def test_provenance(spark):
    e = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position long, job string")
    row = "position long, job string, document_id string, method_name string, train_graph_only boolean, leave_current_document_out boolean, source_documents array<string>"
    good = [(0, "a", "d1", "m", True, True, ["d2"]), (1, "b", "d2", "m", True, True, []), (2, "c", "d3", "m", True, True, None)]
    assert chain.provenance_faults(e, spark.createDataFrame(good, row), "m").count() == 0
    bad = [(1, "a", "d1", "x", None, False, ["d1"]), (1, "b", "d2", "m", True, True, []), (1, "b", "d2", "m", True, True, []), (3, "z", "d3", "m", True, True, None)]
    assert sorted(tuple(r) for r in chain.provenance_faults(e, spark.createDataFrame(bad, row), "m").collect()) == [("leave_current_document_out", "a"), ("method_name", "a"), ("missing", "c"), ("order", "a"), ("repeated", "b"), ("train_graph_only", "a"), ("unknown", "z"), ("uses_own_document", "a")]


def test_native_rows(spark):
    span, rel = "array<struct<start:int,end:int,type:string>>", "array<struct<head:int,tail:int,type:string>>"
    native = spark.createDataFrame([("a", ["Signal", "failure", "here"], [(0, 2, "E"), (2, 3, "L")], [(0, 1, "at")]), ("b", ["x"], [(0, 1, "E")], []), ("c", [], [], []), ("d", ["x"], [], [])], f"job string, tokens array<string>, entities {span}, relations {rel}")
    jobs = spark.createDataFrame([("a", "Signal failure here"), ("b", "y"), ("c", ""), ("e", "")], "job string, text string")
    gold = spark.createDataFrame([("a", [(0, 14, "E"), (15, 19, "L")], [(0, 1, "at")]), ("b", [(0, 1, "F")], [(0, 0, "at")]), ("c", [], []), ("d", [], [])], f"job string, entities {span}, relations array<struct<source:int,target:int,type:string>>")
    assert sorted(tuple(r) for r in chain.native_faults(native, jobs, gold).collect()) == [("entities", "b"), ("missing_gold", "e"), ("missing_job", "d"), ("missing_native", "e"), ("relations", "b"), ("text", "b")]


def test_incremental(spark, tmp_path):
    source, folder, seen = str(tmp_path / "s"), str(tmp_path / "d"), []
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "a", "b", "c/d e", None])], "k int, p string")
    rows.write.partitionBy("p").parquet(source)

    def work(df):
        seen.append(1)
        return df.filter("k < 100").select((F.col("k") * 2).alias("double"), "p")

    def run(version="1"):
        out, stale = incremental.derive(spark, source, "p", folder, work, version)
        return sorted((r["double"], r["p"]) for r in out.collect()), stale

    want = [(0, "a"), (2, "a"), (4, "b"), (6, "c/d e"), (8, None)]
    got, stale = run()
    assert (got, len(stale), len(seen)) == (want, 4, 1)
    assert run() == (want, []) and len(seen) == 1  # nothing is derived, nothing but the manifest read
    spark.createDataFrame([(7, "b")], "k int, p string").write.mode("append").partitionBy("p").parquet(source)
    assert run() == ([(0, "a"), (2, "a"), (4, "b"), (6, "c/d e"), (8, None), (14, "b")], ["b"])
    incremental.drop(spark, f"{folder}/rows/p=a")  # an output that someone lost
    assert run()[1] == ["a"]
    incremental.drop(spark, f"{source}/p=b")
    assert run() == ([(0, "a"), (2, "a"), (6, "c/d e"), (8, None)], [])
    incremental.drop(spark, f"{source}/p=a")
    spark.createDataFrame([(500, "a")], "k int, p string").write.mode("append").partitionBy("p").parquet(source)
    assert run() == ([(6, "c/d e"), (8, None)], ["a"])  # it derives to nothing now
    assert run()[1] == []
    assert len(run("2")[1]) == 3


def test_candidates_meet_their_text_once(spark):
    """Exits of a job's candidates come from one row a job, without a join or a window."""
    c = [(0, 3, "ab", "P", 0.5), (0, 2, None, "Q", 0.5), (0, 2, None, "P", 0.9), (1, 2, None, "P", 0.9), (4, 9, None, "P", 0.9), (None, 2, None, "P", 0.9), (0, 2, None, "X", 0.9), (0, 2, None, None, 0.9), (0, 2, None, "P", 0.1), (0, 2, None, "P", None), (2, 3, None, "P", 0.9), (3, 5, "cd!", "P", 0.9), (3, 5, "cd", "P", float("nan")), (3, 5, "cd", "Q", 0.9)]
    jobs = spark.createDataFrame([(1, "ab cd", c), (2, None, c[:1]), (3, "ab cd", []), (4, "ab", None), (5, "\u00a0ab\u00a0", [(0, 4, "ab", "P", 0.5)])], "k int, t string, c array<struct<start:int,end:int,predicted:string,label:string,score:double>>")
    got = cascade.entity_candidates(jobs, "c", "t", ["k"], ["P", "Q"], 0.3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    rows = got.collect()
    assert [r["exit"] for r in rows if r["k"] == 1] == ["deduplicated", "deduplicated", None, *["dropped_span"] * 3, "dropped_label", "dropped_label", "below_threshold", "below_threshold", "dropped_span", "dropped_span", None, "deduplicated"]
    assert [(r["start"], r["end"]) for r in rows if r["k"] == 1][:3] == [(0, 2)] * 3
    assert [(r["k"], r["exit"]) for r in rows if r["k"] != 1] == [(2, "dropped_span"), (5, "dropped_span")]
