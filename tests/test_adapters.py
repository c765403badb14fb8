"""Adapters, tolerant places and negative spans against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.operators import adapters

SF = "/root/testdata/sf0.001"


def test_unranking(spark):
    for n, width in [(0, 3), (1, 1), (1, 5), (4, 9), (7, 3), (64, 12), (30, 30), (2, 1)]:
        want = [(a, w) for a in range(n) for w in range(1, min(width, n - a) + 1)]
        total = spark.range(1).select(adapters.span_count(F.lit(n), width).alias("t")).first()["t"]
        assert total == len(want)
        got = spark.range(len(want)).select("id", adapters.unrank(F.col("id"), F.lit(n), width).alias("s")).orderBy("id").collect()
        assert [(r["s"]["start"], r["s"]["width"]) for r in got] == want


def test_negative_spans(spark):
    rows = [(1, 6, [(0, 1), (2, 2)]), (2, 1, [(0, 1)]), (3, 0, []), (4, 200, None), (5, 3, [(9, 1)])]
    c = spark.createDataFrame(rows, "k int, n int, p array<struct<start:int,width:int>>")
    got = {r["k"]: [tuple(s) for s in r["negatives"]] for r in adapters.negative_spans(c, "n", "p", F.col("k"), 3, 4.0, 8).collect()}
    assert len(got[1]) == 8 and not set(got[1]) & {(0, 1), (2, 2)}
    assert got[2] == got[3] == []
    assert len(got[4]) == 8
    assert len(got[5]) == 6  # all spans of three tokens; the positive is none of them
    for k, n, _ in rows:
        assert len(set(got[k])) == len(got[k])
        assert all(0 <= a and 1 <= w <= 3 and a + w <= n for a, w in got[k])
    again = adapters.negative_spans(c, "n", "p", F.col("k"), 3, 4.0, 8, seed=1)
    assert {r["k"]: [tuple(s) for s in r["negatives"]] for r in again.collect()}[4] != got[4]


def test_align():
    assert adapters.align("Signal failure, Leeds", ["Signal", "failure", ",", "Leeds"]) == [(0, 6), (7, 14), (14, 15), (16, 21)]
    assert adapters.align(" a\n b", ["a", "", "b"]) == [(1, 2), (2, 2), (4, 5)]
    assert adapters.align("ab", ["a", "c"]) is None
    assert adapters.align("", []) == []


def test_tolerant_spans_equal_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab- -\n\tü") for _ in range(rng.randrange(25)))
        needle = "".join(rng.choice("ab- -") for _ in range(rng.randrange(1, 6)))
        words = needle.split()
        want = []
        if words:
            pattern = re.compile(r"\s+".join(re.escape(w).replace(r"\-", r"-\s*") for w in words))
            at = 0
            while m := pattern.search(text, at):
                end = m.end()
                want.append((m.start(), m.start() + len(m[0].rstrip())))
                at = end
        assert adapters.FoldedText(text).spans(needle) == want, (text, needle)


def test_located_across_segments(spark):
    segs = [(1, 0, "S1", 0, "low-\nspeed low-speed"), (1, 1, "S2", 100, "low-  speed"), (2, 0, "S1", 0, None)]
    segments = spark.createDataFrame(segs, "job int, index int, segment_id string, start int, text string")
    uses = spark.createDataFrame([(1, k, "low-speed") for k in range(4)] + [(1, 9, "absent"), (2, 0, "x"), (3, 0, "x")], "job int, position int, text string")
    got = sorted((r["job"], r["position"], r["segment_id"], r["start"], r["end"]) for r in adapters.located(uses, segments, ["job"]).collect())
    assert got == [(1, 0, "S1", 0, 10), (1, 1, "S1", 11, 20), (1, 2, "S2", 100, 111), (1, 3, "S2", 100, 111), (1, 9, None, None, None), (2, 0, None, None, None), (3, 0, None, None, None)]


def test_next_unused(spark):
    uses = spark.createDataFrame([(1, 0, "ab", "ab AB ab"), (1, 1, "Ab", "ab AB ab"), (1, 2, "ab", "ab AB ab"), (1, 3, "ab", "ab AB ab"), (1, 4, "AB", "ab AB ab"), (2, 0, None, None)], "job int, position int, text string, source string")
    got = {(r["job"], r["position"]): (r["start"], r["end"]) for r in adapters.next_unused(uses, ["job"]).collect()}
    assert got == {(1, 0): (0, 2), (1, 1): (3, 5), (1, 2): (6, 8), (1, 3): (None, None), (1, 4): (None, None), (2, 0): (None, None)}


@pytest.fixture
def types():
    return ["Drug", "Adverse_Effect"], ["treats"]


def test_lists(spark, types):
    row = (1, "Aspirin treats pain; aspirin again", [("aspirin", "drug"), ("ASPIRIN", "DRUG"), ("pain", "adverse effect"), ("fever", "odd"), (None, None)], [("Aspirin", "Treats", "pain"), ("ghost", "causes", "pain")])
    rows = spark.createDataFrame([row, (2, None, None, None)], "job int, text string, entities array<struct<name:string,type:string>>, relations array<struct<head:string,relation:string,tail:string>>")
    e, r, i = adapters.from_lists(rows, "job", *types)
    got = {x["id"]: (x["text"], x["type"], x["start"], x["end"]) for x in e.collect()}
    assert got == {"E1": ("aspirin", "Drug", 21, 28), "E2": ("Aspirin", "Drug", 0, 7), "E3": ("pain", "Adverse_Effect", 15, 19), "E4": ("fever", "odd", None, None), "E5": ("", "UNKNOWN", None, None), "E6": ("ghost", "UNKNOWN", None, None)}
    assert {x["id"]: tuple(x)[2:] for x in r.collect()} == {"R1": ("E1", "treats", "E3", 15, 28), "R2": ("E6", "causes", "E3", None, None)}
    issues = sorted((x["kind"], x["position"], x["detail"]) for x in i.collect())
    assert issues == [("relation_endpoint_missing", 1, "ghost"), ("unknown_entity_type", 1, "UNKNOWN"), ("unknown_entity_type", 3, "odd"), ("unknown_entity_type", 4, "UNKNOWN"), ("unknown_relation_type", 1, "causes"), ("unresolved_entity_span", 1, "ghost"), ("unresolved_entity_span", 3, "fever"), ("unresolved_entity_span", 4, "")]


def test_token_spans_and_compact(spark, types):
    row = (1, "Aspirin treats pain", ["Aspirin", "treats", "pain"], [(0, 1, "Drug"), (2, 3, "Adverse_Effect"), (2, 9, "Drug"), (0, 1, "odd")], [(0, 1, "treats"), (0, 2, "treats"), (0, 1, "odd")])
    rows = spark.createDataFrame([row, (2, "a b", ["a"], [(0, 1, "Drug")], None), (3, None, None, None, None)], "job int, text string, tokens array<string>, entities array<struct<start:int,end:int,type:string>>, relations array<struct<head:int,tail:int,type:string>>")
    e, r, i = adapters.from_token_spans(rows, "job", *types)
    assert sorted(map(tuple, e.collect())) == [(1, "E1", "Aspirin", "Drug", 0, 7), (1, "E2", "pain", "Adverse_Effect", 15, 19)]
    assert list(map(tuple, r.collect())) == [(1, "R1", "E1", "treats", "E2", 0, 19)]
    assert sorted((x["job"], x["kind"]) for x in i.collect()) == [(1, "invalid_entity_span"), (1, "invalid_relation_endpoint"), (1, "unknown_entity_type"), (1, "unknown_relation_type"), (2, "tokens_differ_from_text")]
    compact = spark.createDataFrame([(1, [("E1", "low-speed", "A"), ("E2", "gone", "A"), ("E3", " ", "A"), ("E4", "rail", None)], [("R1", "E1", "x", "E1"), ("R2", "E1", "x", "E2"), ("R3", None, "x", "E1")])], "job int, entities array<struct<id:string,text:string,type:string>>, relations array<struct<id:string,source_id:string,type:string,target_id:string>>")
    segments = spark.createDataFrame([(1, 0, "S1", 10, "a low- speed rail")], "job int, index int, segment_id string, start int, text string")
    e, r, i = adapters.from_compact(compact, segments, "job")
    assert list(map(tuple, e.collect())) == [(1, "E1", "low-speed", "A", "S1", 12, 22)]
    assert list(map(tuple, r.collect())) == [(1, "R1", "E1", "x", "E1", 12, 22)]
    assert sorted((x["kind"], x["position"], x["detail"]) for x in i.collect()) == [("endpoint_rejected", 1, "R2"), ("missing_endpoint_id", 2, "R3"), ("missing_fields", 2, "text"), ("missing_fields", 3, "type"), ("not_located", 1, "gone")]


def test_list_query(spark):
    """Every mention has its own place, exact or but for case, and the first free one when it was taken."""
    got = entry.queries()["adapt_list_entities"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    per = {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r)
    for doc, rows in per.items():
        spans = [(r["start"], r["end"]) for r in rows if r["start"] is not None]
        assert len(set(spans)) == len(spans)
        assert all(texts[doc][r["start"] : r["end"]] == r["text"] for r in rows if r["start"] is not None)
        assert sorted(int(r["id"][1:]) for r in rows) == list(range(1, len(rows) + 1))


def test_token_spans_without_joins(spark):
    """Ends of relations come from the job's own array, and texts are aligned as align() does it, odd white space too."""
    rng = random.Random(5)
    alphabet = ["a", "\u00e9", "\U0001f600", " ", "\n", "\x1c", "\u3000", "\u200b"]
    rows = []
    for k in range(80):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        cut = sorted(rng.randrange(len(text) + 1) for _ in range(3))
        tokens = [text[a:b] or rng.choice(["", None]) for a, b in zip([0, *cut], [*cut, len(text)])]
        rows.append((k, text if k % 9 else text + "b", tokens, [(0, 4, "P"), (3, 9, "P"), (0, 1, "Z"), None], [(0, 0, "r"), (0, 1, "r"), (0, -1, "r"), (None, 0, "r"), (0, 0, "s"), (0, 7, "r")]))
    rows.append((99, None, None, None, None))
    d = spark.createDataFrame(rows, "job int, text string, tokens array<string>, entities array<struct<start:int,end:int,type:string>>, relations array<struct<head:int,tail:int,type:string>>")
    got = {r["job"]: r["p"] and [tuple(p) for p in r["p"]] for r in d.select("job", adapters.aligned_tokens("text", "tokens").alias("p")).collect()}
    assert got == {r[0]: adapters.align(r[1] or "", r[2] or []) for r in rows} and any(v is None for v in got.values())
    e, r, i = adapters.from_token_spans(d, "job", ["P"], ["r"])
    assert all("Join" not in x._jdf.queryExecution().executedPlan().toString() for x in (e, r, i))
    good = {k for k, v in got.items() if v is not None and k != 99}
    assert {x["job"] for x in e.collect()} == {x["job"] for x in r.collect()} == good
    want = [("invalid_entity_span", 1), ("invalid_entity_span", 3), ("invalid_relation_endpoint", 1), ("invalid_relation_endpoint", 2), ("invalid_relation_endpoint", 3), ("invalid_relation_endpoint", 5), ("unknown_entity_type", 2), ("unknown_relation_type", 4)]
    found = {}
    for x in i.collect():
        found.setdefault(x["job"], []).append((x["kind"], x["position"]))
    assert all(sorted(found[k], key=str) == want for k in good) and {k for k, v in found.items() if v == [("tokens_differ_from_text", None)]} == set(got) - good - {99}
