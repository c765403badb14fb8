import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import contracts, corpus, decode, gate, graph, kg, metrics, splitting, relaxed
from quillspan.sources import readers

SIG = [("involves", "EVENT", "ASSET"), ("performed_by", "OPERATION", "ACTOR")]
EV = "array<struct<text:string,segment_id:string>>"
ENT = f"j string, id string, text string, type string, evidence {EV}, i int"
REL = f"j string, id string, source_id string, type string, target_id string, claim_status string, evidence {EV}"


def entities(spark, rows):
    return spark.createDataFrame([("J", i, t, k, [(e, "S1")], n) for n, (i, t, k, e) in enumerate(rows)], ENT)


def relations(spark, rows):
    return spark.createDataFrame([("J", i, s, k, t, c, [(e, "S1")] if e is not None else []) for i, s, k, t, c, e in rows], REL)


def test_verifier_collects_all_reasons(spark):
    ents = entities(spark, [("E1", "火灾", "EVENT", "火灾"), ("E2", "灭火器", "ASSET", "灭火器")])
    rels = relations(spark, [("R1", "E1", "involves", "E2", "explicit", "火灾涉及灭火器"), ("R2", "E2", "involves", "E1", "x", "火灾"), ("R3", "E1", "no", "E9", None, None), ("R4", "E1", "involves", "E1", "explicit", "火灾")])
    sig = spark.createDataFrame(SIG, "relation string, source_type string, target_type string")
    got = {r["id"]: r["reasons"] for r in gate.verify_relations(rels, ents, sig, ["explicit"], ["j"]).collect()}
    assert got["R1"] == ["accepted"]
    assert got["R2"] == ["illegal_entity_type_signature", "missing_or_unknown_claim_status", "entities_not_co_present_in_relation_evidence"]
    assert got["R3"] == ["unknown_entity_reference", "unknown_relation_type", "missing_or_unknown_claim_status", "missing_or_malformed_relation_evidence"]
    assert "self_relation" in got["R4"]


def test_inverse_repair(spark):
    ents = entities(spark, [("E1", "a", "ACTOR", "a"), ("E2", "b", "OPERATION", "b")])
    rels = relations(spark, [("R1", "E1", "performed_by", "E2", "explicit", "a b"), ("R2", "E1", "other", "E2", "explicit", "a b")])
    sig = spark.createDataFrame(SIG, "relation string, source_type string, target_type string")
    run = lambda repair: {r["id"]: (r["direction"], r["source_id"]) for r in gate.repair_direction(rels, ents, sig, ["j"], repair).collect()}
    assert run(True) == {"R1": ("repaired", "E2"), "R2": ("rejected", "E1")}
    assert run(False)["R1"] == ("rejected", "E1")


def test_fusion(spark):
    v1 = entities(spark, [("X", "signal  failure", "FAILURE", "")])
    v2 = entities(spark, [("E1", "Signal failure", "FAILURE", ""), ("E2", "the driver", "ACTOR", ""), ("E3", "the train", "ASSET", ""), ("E4", "unsupported", "HAZARD", ""), ("E5", "signal failure", "FAILURE", "")])
    ver = spark.createDataFrame([("J", "the driver", "ACTOR", "the train", "ASSET")], "j string, source_text string, source_type string, target_text string, target_type string")
    anchors = spark.createDataFrame([("J", "the train", "ASSET")], "j string, name string, type string")
    f = gate.fuse_entities(v1, v2, ver, anchors, ["j"], "i")
    got = {r["id"]: (r["accepted"], r["reasons"]) for r in f.collect()}
    assert {k for k, v in got.items() if v[0]} == {"E1", "E2", "E3"}
    assert got["E3"][1] == ["source_gated_anchor_type_match", "verified_relation_endpoint"]
    assert got["E4"][1] == ["no_acceptance_signal"]
    assert got["E5"][1][-1] == "duplicate_normalized_text_and_type"
    kept = gate.surviving_relations(relations(spark, [("R1", "E2", "x", "E3", "", ""), ("R2", "E4", "x", "E3", "", "")]), f.filter("accepted"), ["j"])
    assert [r["id"] for r in kept.collect()] == ["R1"]


def test_metrics(spark):
    g = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "u int, k string")
    p = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "d")], "u int, k string")
    sets = metrics.micro(metrics.key_counts(g, p, ["u"], ["k"])).first()
    assert (sets["gold"], sets["predicted"], sets["correct"]) == (3, 2, 1)
    lists = metrics.micro(metrics.multiset_counts(g, p, ["u"], ["k"])).first()
    assert (lists["gold"], lists["predicted"], lists["correct"]) == (4, 4, 2)
    none = metrics.prf(spark.createDataFrame([(0, 0, 0)], "gold int, predicted int, correct int")).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    rows = spark.createDataFrame([(0,)] * 9 + [(1,)], "l int")
    assert [r["weight"] for r in metrics.class_weights(rows, "l", [0, 1, 2], "binary_sqrt").orderBy("l").collect()] == [0.3333, 1.0, 1.0]
    assert metrics.trailing_mean(spark.createDataFrame([(1, k, float(k)) for k in range(12)], "u int, t int, v double"), "v", ["u"], ["t"]).orderBy(F.desc("t")).first()["trailing_mean"] == 6.5


def test_error_classes(spark):
    kind = "j string, s_name string, s_type string, type string, t_name string, t_type string"
    gold = spark.createDataFrame([("J", "a", "A", "causes", "b", "B")], kind)
    pred = spark.createDataFrame([("J", "a", "A", "involves", "b", "B"), ("J", "b", "B", "causes", "a", "A"), ("J", "z", "A", "x", "y", "B"), ("J", "a", "X", "x", "y", "B")], kind)
    ents = spark.createDataFrame([("J", "a", "A"), ("J", "b", "B")], "j string, name string, type string")
    got = {(r["s_name"], r["s_type"]): r["category"] for r in metrics.classify_predicted(pred, gold, ents, ["j"]).collect()}
    assert got == {("a", "A"): "wrong_relation_type", ("b", "B"): "reversed_direction", ("z", "A"): "unsupported_or_hallucinated_endpoint", ("a", "X"): "entity_type_or_boundary_error"}
    assert metrics.classify_missed(gold, pred, ents, ["j"]).first()["category"] == "wrong_relation_type_or_claim"


def test_segments_and_chunks(spark):
    parts = spark.createDataFrame([("d", 0, " first page "), ("d", 1, "  "), ("d", 2, "second page")], "d string, k int, text string")
    got = corpus.make_segments(parts, ["d"], "k").orderBy("k").collect()
    text = "first page\n\nsecond page"
    assert [text[r["start"] : r["end"]] for r in got] == ["first page", "second page"]
    run = lambda e: spark.range(1).select(e.alias("x")).first()[0]
    assert run(corpus.chunk_numbers(F.array(*map(F.lit, (5, 5, 20, 3, 8))), 10)) == [1, 1, 2, 3, 4]
    assert [run(corpus.representative_positions(F.lit(n), k)) for n, k in ((10, 3), (2, 3), (10, 1))] == [[0, 5, 9], [0, 1], [5]]


def test_components_and_near_clusters(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert {got[k] for k in range(1, 41)} == {1}
    assert got[101] == 100
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, "the quick brown fox jumps over the lazy dog again and again today"), (3, "completely different words stand in this line, nothing alike")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["cluster"] for r in corpus.near_clusters(corpus.simhash(docs)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_bio(spark):
    labels = ["I-A", "I-A", "O", "I-E", "I-E"]
    t = spark.createDataFrame([(1, k, lab, 10 * k, 10 * k + 9, 0.5 + k / 10) for k, lab in enumerate(labels)], "s int, k int, label string, start int, end int, score double")
    assert [r["repaired"] for r in decode.repair_bio(t, ["s"], "k").orderBy("k").collect()] == ["B-A", "I-A", "O", "B-E", "I-E"]
    got = decode.decode_bio(t, ["s"], "k").orderBy("start").collect()
    assert [(r["type"], r["start"], r["end"], round(r["score"], 2)) for r in got] == [("A", 0, 19, 0.5), ("E", 30, 49, 0.8)]
    assert decode.viterbi(np.array([[5.0, 4, 0], [0, 0, 6]]), ["O", "B-X", "I-X"]) == ["B-X", "I-X"]
    assert relaxed.most_matches(2, 2, [[0, 1], [0]]) == 2


def test_knowledge_graph(spark):
    m = spark.createDataFrame([("d1", "en", "EVENT", "Fire"), ("d2", "en", "EVENT", "fire"), ("d2", "en", "ASSET", "fire engine")], "doc_id string, lang string, type string, text string")
    cat = kg.anchor_catalog(kg.build_concepts(m))
    seg = spark.createDataFrame([("d1", "en", "A fire  engine met the FIRE")], "doc_id string, lang string, text string")
    got = kg.exact_anchors(seg, cat, min_purity=0.0).orderBy("rank").collect()
    assert [(r["name"], r["support"]) for r in got] == [("fire engine", 1), ("fire", 2)]
    zh = spark.createDataFrame([("d1", "zh", "EVENT", "火灾"), ("d2", "zh", "EVENT", "火灾"), ("d2", "zh", "ASSET", "灭火器"), ("d1", "zh", "EVENT", "检修")], "doc_id string, lang string, type string, text string")
    seg = spark.createDataFrame([("d1", "zh", "火灾涉及灭火器"), ("d1", "zh", "检修")], "doc_id string, lang string, text string")
    assert {r["name"] for r in kg.exact_anchors(seg, kg.anchor_catalog(kg.build_concepts(zh))).collect()} == {"火灾", "灭火器"}
    rows = spark.createDataFrame([("EVENT", "a", 10), ("EVENT", "b", 9), ("ASSET", "c", 1)], "type string, name string, n int").withColumn("g", F.lit(1))
    assert {r["name"] for r in kg.round_robin(rows, ["g"], "type", [F.desc("n")], 2).collect()} == {"a", "c"}


def test_splits(spark):
    d = spark.createDataFrame([(k, k % 2) for k in range(40)], "id int, g int")
    got = splitting.split_15_15_70(d, "g", "id").groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in got} == {(g, s): n for g in (0, 1) for s, n in (("test", 3), ("validation", 3), ("train", 14))}
    rows = spark.createDataFrame([(k, ["a" if k % 2 else "b"]) for k in range(6)], "id int, labels array<string>")
    picked = splitting.label_cover(rows, "labels", "id", 4).collect()
    assert len(picked) == 4
    assert {x for r in picked for x in r["labels"]} == {"a", "b"}


def test_contracts(spark):
    jobs = spark.createDataFrame([("J1", 0), ("J2", 1)], "job string, position int")
    a, b = spark.createDataFrame([("J2", 1)], "job string, v int"), spark.createDataFrame([("J1", 2)], "job string, v int")
    assert [r["job"] for r in contracts.union_shards([a, b], ["job"], jobs).orderBy("position").collect()] == ["J1", "J2"]
    for bad in ([a, a], [a]):
        with pytest.raises(ValueError):
            contracts.union_shards(bad, ["job"], jobs)
    bad = contracts.count_checks(spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "gold int, predicted int, correct int")).collect()
    assert bad[0]["reasons"] == ["correct_over_gold", "correct_over_predicted"]
    states = contracts.run_checks(spark, {"good": lambda: a.filter("false"), "bad": lambda: a, "broken": lambda: 1 / 0})
    assert {r["name"]: r["status"] for r in states.collect()} == {"good": "passed", "bad": "failed", "broken": "failed"}
    assert contracts.forbidden_fields(spark.createDataFrame([], "a int, b array<struct<gold:int>>"), {"gold"}) == ["b.gold"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("一\n\n二".encode("gb18030"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hi</w:t><w:tab/><w:t>you</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.zip").write_bytes(b"PK\x03\x04 cut")
    inv = readers.inventory(spark, str(tmp_path))
    kinds = {r["path"][-5:]: r["actual_format"] for r in inv.collect()}
    assert kinds == {"a.txt": "txt", "b.pdf": "pdf", ".docx": "docx", "d.zip": "invalid_zip"}
    got = {r["path"][-5:]: r for r in readers.extract_parts(inv).collect()}
    assert [p["text"] for p in got["a.txt"]["parts"]] == ["一", "二"]
    assert got[".docx"]["parts"][0]["text"] == "Hi\tyou"
    assert got["b.pdf"]["status"] == "failed"
    assert got["d.zip"]["status"] == "unsupported"


def test_json_lines(spark, tmp_path):
    good, cut, bad = tmp_path / "g.jsonl", tmp_path / "c.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2}\n')
    cut.write_text('{"a": 1}\n{"a": 2}\n{"a":')
    bad.write_text('{"a": 1}\n{"a":\n{"a": 3}')
    assert readers.read_jsonl(spark, str(good), "a int").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.read_jsonl(spark, str(cut), "a int").collect()
    rows, lines = readers.read_jsonl_tolerant(spark, str(cut), "a int")
    assert (rows.count(), lines.count()) == (2, 1)
    assert readers.repaired_tail(spark, str(cut), "a int").count() == 2
    with pytest.raises(ValueError):
        readers.repaired_tail(spark, str(bad), "a int")
    with pytest.raises(ValueError):
        readers.safe_path("data/test/gold.jsonl")


def test_relations_of_one_line(spark):
    """Relations that share a long line are judged alike; groups without a name keep their relations."""
    line = "Ann works at Acme " + "x" * 20_000
    ev = "array<struct<text:string,segment_id:string>>"
    ents = spark.createDataFrame([(None, f"E{k}", "Ann" if k % 2 else "Acme", "PER" if k % 2 else "ORG", [(line, "S1")]) for k in range(200)], f"j string, id string, text string, type string, evidence {ev}")
    rels = spark.createDataFrame([(None, f"R{k}", f"E{k}", "works_for", f"E{k + 1}", "explicit", [(line, "S1")]) for k in range(1, 199, 2)], f"j string, id string, source_id string, type string, target_id string, claim_status string, evidence {ev}")
    sig = spark.createDataFrame([("works_for", "PER", "ORG")], "relation string, source_type string, target_type string")
    ents, rels = (df.withColumn("j", F.coalesce("j", F.lit("a"))) for df in (ents, rels))
    got = gate.verify_relations(rels, ents, sig, ["explicit"], ["j"])
    rows = got.collect()
    assert len(rows) == 99 and all(r["accepted"] and r["evidence"][0]["text"] == line and r["relation_segment_ids"] == ["S1"] for r in rows)
    lost = rels.withColumn("j", F.lit(None).cast("string"))
    assert {r["reasons"][0] for r in gate.verify_relations(lost, ents, sig, ["explicit"], ["j"]).collect()} == {"unknown_entity_reference"}
    assert gate.verify_relations(lost, ents, sig, ["explicit"], ["j"]).count() == 99


def test_a_line_is_written_once(spark, tmp_path):
    """Mentions of a long line don't each carry it into the written table."""
    import os

    from quillspan.plans import fixtures

    words = " ".join(f"word{k * 7919 % 100_003}" for k in range(20_000))
    spark.createDataFrame([(1, words, "en", "s", len(words))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    m = fixtures.mentions(spark, str(tmp_path))
    lines = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in m.inputFiles()})
    assert lines.count() == 1 and m.count() > 1000 and m.select("seg_text").distinct().first()[0] == words
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in m.inputFiles()) < 3 * len(words)
