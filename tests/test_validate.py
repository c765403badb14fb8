from pyspark.sql import functions as F

from quillspan.operators import learn, validate

EV = "array<struct<text:string,segment_id:string>>"


def test_quality_issues_and_queue(spark):
    ents = spark.createDataFrame([("D1", "E1", "火灾", "EVENT", [("火灾", "S1")]), ("D1", "E2", "灭火器", "ASSET", [("灭火器", "S1")])], f"j string, id string, text string, type string, evidence {EV}")
    rels = spark.createDataFrame([("D1", "R1", "E1", "involves", "E2", "explicit", [("火灾", "S1")])], f"j string, id string, source_id string, type string, target_id string, claim_status string, evidence {EV}")
    sig = spark.createDataFrame([("involves", "EVENT", "ASSET")], "relation string, source_type string, target_type string")
    seg = spark.createDataFrame([("D1", "S1", "火灾和灭火器")], "j string, segment_id string, text string")
    got = validate.quality_issues(rels, ents, sig, ["explicit"], seg, ["j"])
    assert [(r["id"], r["issue"]) for r in got.collect()] == [("R1", "relation_evidence_missing_entity")]
    q = validate.review_queue(got, rels.select("j", "id"), "j").first()
    assert (q["priority"], q["relation_rejected_count"]) == ("high", 1)


def test_evidence_errors_and_schema(spark):
    items = spark.createDataFrame([("D", "E1", "bc", "S1.2", 1, 3), ("D", "E2", "xx", "S1", 1, 3), ("D", "E3", "bc", "S9", 1, 30)], "j string, id string, text string, segment_id string, start int, end int")
    doc = spark.createDataFrame([("D", "abcd")], "j string, doc_text string")
    seg = spark.createDataFrame([("D", "S1")], "j string, segment_id string")
    got = {r["id"]: r["reasons"] for r in validate.evidence_errors(items, doc, seg, ["j"]).collect()}
    assert got == {"E2": ["text"], "E3": ["segment", "offsets", "text"]}
    e = spark.createDataFrame([("E1", "a", "T", 0.5, "ok", ["x"]), ("1", "", "U", 2.0, "ok", [])], "id string, text string, type string, confidence double, review_status string, evidence array<string>")
    bad = validate.entity_schema_errors(e, ["T"], ["ok"]).collect()
    assert [r["reasons"] for r in bad] == [["id", "text", "type", "confidence", "evidence"]]


def test_renumber_and_context(spark):
    e = spark.createDataFrame([("J", "x", 2), ("J", "y", 1)], "j string, id string, i int")
    r = spark.createDataFrame([("J", "r", "x", "y", 1), ("J", "s", "x", "gone", 2)], "j string, id string, source_id string, target_id string, i int")
    ents, rels = validate.renumber_annotation(e, r, ["j"], "i")
    assert {(x["i"], x["id"]) for x in ents.collect()} == {(1, "E1"), (2, "E2")}
    assert [(x["id"], x["source_id"], x["target_id"]) for x in rels.collect()] == [("R1", "E2", "E1")]
    ctx = spark.createDataFrame([("do it\n\nKG_RULES:\nold", [("a", "T")], [("a", "r", "b")])], "t string, an array<struct<text:string,type:string>>, ed array<struct<source:string,relation:string,target:string>>")
    assert ctx.select(validate.render_context("an", "ed", "t")).first()[0] == "do it\n\nKG_RULES:\n- T: a\n- a --r--> b"


def test_text_classifier(spark):
    rows = spark.createDataFrame([(k, "signal failure" if k % 2 else "harbour view", float(k % 2)) for k in range(40)], "id int, t string, y double")
    model = learn.text_classifier(rows, "t", "y", dims=1 << 12)
    got = learn.text_scores(model, rows, "t")
    assert got.filter(F.col("prediction") != F.col("y")).count() == 0
