import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import spans as S
from quillspan.functions import text as T
from quillspan.functions.ids import confidence, document_id
from quillspan.operators.windows import budget_ranges


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_markup_and_norm(spark):
    got = [one(spark, T.canonical_text(F.lit(x))) for x in ("《安全生产法》", "危险与可操作性分析（HAZOP）", "（主要指粉尘太大）", " Straße  X ", "《（abc）》", "()")]
    assert got == ["安全生产法", "危险与可操作性分析（hazop）", "主要指粉尘太大", "strasse x", "abc", ""]


def test_small_text_functions(spark):
    assert one(spark, T.clip(F.lit("x" * 200))) == "x" * 179 + "…"
    assert one(spark, T.language_hint(F.lit("火灾后再次发生火灾事故报告"))) == "zh"
    assert one(spark, T.language_hint(F.lit("short"))) == "unknown"
    assert one(spark, T.relation_name(F.lit("Works-For  X"))) == "works_for_x"
    assert one(spark, T.canonical_label(F.lit("Work for"), ["WORK_FOR"], "none"))["known"]
    assert one(spark, T.boundary_overlap(F.lit("a signal failure"), F.lit("signal failure")))
    assert not one(spark, T.boundary_overlap(F.lit(""), F.lit("x")))
    assert one(spark, T.overlapping_starts(F.lit("aaa"), F.lit("aa"))) == [0, 1]
    assert one(spark, T.slice_text(F.lit("a😀bc"), F.lit(1), F.lit(3))) == "😀b"
    assert [one(spark, confidence(F.lit(x))) for x in ("0.5", "nan", "7", "x", None)] == [0.5, 0.0, 1.0, 0.0, 0.0]
    assert one(spark, document_id(F.lit("a/b"))).startswith("doc_")


def test_spans():
    assert S.flexible_span("Collision at Shalesmoor,\nSheffield", "Shalesmoor, Sheffield") == (13, 34)
    for bad in ("Leeds", "aa"):
        with pytest.raises(ValueError):
            S.flexible_span("aaa Sheffield", bad)
    segs = [{"segment_id": "S1", "start": 10, "text": "Signal failure occurred."}, {"segment_id": "S2", "start": 40, "text": "The driver stopped."}]
    assert S.unique_in_segments(segs, "Signal failure") == ("S1", 10, 24)
    assert S.mention_spans("signal failure caused a failure", "failure") == [(7, 14), (24, 31)]
    assert S.choose_spans([(0, 14, "FAILURE"), (7, 14, "HAZARD"), (22, 31, "FAILURE")]) == [(0, 14, "FAILURE"), (22, 31, "FAILURE")]
    both = [(0, 7, "ACTOR", 0.9), (0, 12, "ACTOR", 0.6)]
    assert S.choose_spans(both, "confidence")[0][1] == 7
    assert S.choose_spans(both, "longest")[0][1] == 12
    assert budget_ranges(np.ones((1, 10), int), [3], 1) == [(0, 3), (2, 5), (4, 7), (6, 9), (8, 10)]
    assert budget_ranges(np.array([[1, 9, 1, 1, 1], [1, 1, 1, 5, 1]]), [3, 5], 0) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert budget_ranges(np.ones((1, 0), int), [3]) == []
    segs = [{"segment_id": "S1", "start": 100, "text": "火灾后再次发生火灾"}]
    assert S.resolve_span(segs, "火灾", "S1", 107) == ("resolved", 107, 109)
    assert S.resolve_span(segs, "火灾")[0] == "ambiguous"
    assert S.resolve_span(segs, "")[0] == "not_found"


def test_parts_cover_the_text():
    t = "One sentence. Another one! And a third? " * 40
    parts = S.semantic_parts(t, 100, 20)
    assert parts[0][0] == 0
    assert parts[-1][1] == len(t)
    assert all(b - a <= 100 for a, b in parts)
    assert all(y[0] <= x[1] for x, y in zip(parts, parts[1:], strict=False))
    a, b = S.focus("x" * 1000 + "\nneedle here.\n" + "y" * 1000, ["needle"])
    assert "needle" in ("x" * 1000 + "\nneedle here.\n" + "y" * 1000)[a:b]


def test_json_repair():
    assert S.extract_annotation('note {"a": 1} then {"entities": [{"id": "E1"}, "relations": []}')["entities"] == [{"id": "E1"}]
    assert json.loads(S.close_json('{"entities": [1, 2], "relations": [{"x": "}"'))["relations"] == [{"x": "}"}]
    assert S.close_json('{"a": "open') is None
    with pytest.raises(ValueError):
        S.extract_annotation("nothing")
    assert S.unwrap_json('```json\n{"a": [1]}\n```') == '{"a": [1]}'


def test_casefold_of_every_character(spark):
    from quillspan.functions import text as T

    chars = [c for c in map(chr, range(1, 0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (c.casefold() != c or ord(c) % 97 == 0)]
    rows = [(k, "".join(chars[k : k + 50])) for k in range(0, len(chars), 50)] + [(-1, "PLAIN Ascii"), (-2, ""), (-3, None)]
    got = {r["k"]: r["f"] for r in spark.createDataFrame(rows, "k int, t string").select("k", T.casefold("t").alias("f")).collect()}
    assert got == {k: t.casefold() if t is not None else None for k, t in rows}


def test_strip_markup_to_the_end(spark):
    from quillspan.functions import text as T

    rows = ["(" * 30 + "x" + ")" * 30, "《 (a) 》", "()", "(a) b", "", None, "[(]", "(a)(b)"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(T.strip_markup("t")).collect()]
    assert got == ["x", "a", "", "(a) b", "", None, "(", "a)(b"]
