"""Chunks, windows and rescue windows against plain versions."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.functions.spans import choose_spans, focus
from quillspan.operators import chunking, decode, windows

SF = "/root/testdata/sf0.001"


def plain_runs(tokens, labels, scores, gap=1):
    out, cur = [], None
    for (a, b), label, s in zip(tokens, labels, scores, strict=True):
        if b <= a or label is None:
            continue
        if label == "O":
            cur = None
        elif cur and label[0] == "I" and cur[2] == label[2:] and a <= cur[1] + gap:
            cur[1], cur[3] = b, min(cur[3], s)
        else:
            cur = [a, b, label[2:], s]
            out.append(cur)
    return [tuple(x) for x in out]


@pytest.mark.parametrize(("size", "stride"), [(8, 3), (5, 0), (64, 16), (2, 1)])
def test_stitched_chunks_are_the_whole_text(spark, size, stride):
    rng = random.Random(size)
    rows = []
    for k in range(40):
        at, tokens = 0, []
        for _ in range(rng.choice([0, 1, size, size + 1, 60])):
            n = rng.choice([0, 1, 4])
            tokens.append((at, at + n))
            at += n + rng.choice([0, 1, 1, 3])
        labels = [rng.choice(["O", "B-A", "I-A", "I-A", "I-B", None]) for _ in tokens]
        rows.append((k, tokens, labels, [rng.random() for _ in tokens]))
    docs = spark.createDataFrame(rows, "k int, tokens array<struct<start:int,end:int>>, known array<string>, sure array<double>")
    chunks = chunking.overlapping_chunks(docs, "tokens", size, stride)
    lost = lambda x, i: F.when((i >= F.col("own_from")) & (i < F.col("own_end")), x).otherwise("B-WRONG")
    seen = chunks.withColumn("labels", F.transform(F.slice("known", F.col("first") + 1, F.lit(size)), lost)).withColumn("scores", F.slice("sure", F.col("first") + 1, F.lit(size)))
    assert all(len(r["tokens"]) <= size and r["own_end"] <= len(r["tokens"]) for r in chunks.collect())
    got = {(r["k"], r["start"], r["end"], r["type"], r["score"]) for r in chunking.runs(chunking.stitched(seen, ["k"], "tokens", "labels", "scores")).collect()}
    assert got == {(k, *r) for k, *x in rows for r in plain_runs(*x)}


def test_subwords_and_repair(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "Signal failure at Leeds station"), (2, ""), (3, None)], "k int, text string")
    t = chunking.subword_places(docs, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["k"]: r["tokens"] for r in t.collect()}
    assert got[2] == got[3] == []
    assert "".join(docs.first()["text"][x["start"] : x["end"]] for x in got[1]) == docs.first()["text"]
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(14).alias("end"), F.lit("EVENT").alias("type")))
    c = chunking.labelled(chunking.overlapping_chunks(t.withColumn("spans", spans), "tokens", 1, 0), "tokens", "spans")
    first = sorted((r["chunk"], r["labels"], r["repaired"]) for r in c.filter("k = 1").collect())
    assert first[0] == (0, ["B-EVENT"], 0)
    assert first[1] == (1, ["B-EVENT"], 1)  # a chunk can't go on with what the one before began
    assert [(r["labels"], r["repaired"]) for r in c.filter("k > 1").collect()] == [([], 0)] * 2


def test_entity_rows(spark):
    rows = [(1, "  Leeds and LEEDS, York ", 0, 8, "LOC", 0.5), (1, "  Leeds and LEEDS, York ", 11, 17, "LOC", 0.9), (1, "  Leeds and LEEDS, York ", 18, 24, "LOC", 0.1234567), (1, "  Leeds and LEEDS, York ", 0, 2, "LOC", 1.0)]
    s = spark.createDataFrame(rows, "k int, text string, start int, end int, type string, score double")
    got = sorted(tuple(r) for r in chunking.entity_rows(s, ["k"], offset=F.lit(100)).select("id", "text", "start", "end", "evidence.start", "confidence").collect())
    assert got == [("E1", "Leeds", 2, 7, [102], 0.5), ("E2", "York", 19, 23, [119], 0.123457)]


def test_consolidation_query(spark):
    c = entry.windowing._chunk_outputs(spark, SF).select("doc_id", "chunk", "tokens", "labels", "scores")
    per = {}
    for r in c.collect():
        tokens = [(t["start"], t["end"]) for t in r["tokens"]]
        per.setdefault(r["doc_id"], []).extend(plain_runs(tokens, r["labels"], r["scores"]))
    want = set()
    for doc, found in per.items():
        best, taken = {}, set()
        for a, b, kind, s in found:
            best[a, b, kind] = max(s, best.get((a, b, kind), s))
        for a, b, kind in sorted(best, key=lambda k: (-best[k], -(k[1] - k[0]), k[0], k[2])):
            if not taken & set(range(a, b)):
                taken |= set(range(a, b))
                want.add((doc, a, b, kind, best[a, b, kind]))
    got = {(r["doc_id"], r["start"], r["end"], r["type"], r["score"]) for r in entry.queries()["chunk_consolidation"](spark, SF).collect()}
    assert got == want
    rng = random.Random(1)
    for mode in ("longest", "confidence"):
        for _ in range(50):
            c = [(a, a + rng.randrange(5), rng.choice("AB"), rng.random()) for a in (rng.randrange(20) for _ in range(15))]
            kept = choose_spans(c, mode)
            assert kept == sorted(kept)
            assert all(x[1] <= y[0] for x, y in zip(kept, kept[1:], strict=False))


def test_budgets(spark):
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, overlap = int(rng.integers(0, 30)), int(rng.integers(0, 3))
        costs, budgets = rng.integers(0, 12, (2, n)), [20, 15]
        got = windows.budget_ranges(costs, budgets, overlap)
        fits = lambda a, b: (costs[:, a:b].sum(1) <= budgets).all()  # noqa: B023, E731
        assert [x for a, b in got for x in range(a, b) if x >= 0] == [] or set(range(n)) == {x for a, b in got for x in range(a, b)}
        for a, b in got:
            assert b == a + 1 or fits(a, b)
            assert b == n or not fits(a, b + 1)
    rows = spark.createDataFrame([(1, 0, 9, None), (1, 1, 1, 1), (1, 2, 1, 1)], "d int, o int, c int, e int")
    got = [tuple(r) for r in windows.budgeted_windows(rows, "d", "o", {"c": 5, "e": 1}, 0).orderBy("window").collect()]
    assert got == [(1, 1, 0, 1, True), (1, 2, 1, 2, False), (1, 3, 2, 3, False)]
    with pytest.raises(ValueError):
        windows.budget_ranges(np.ones((1, 3)), [1], -1)


@pytest.mark.parametrize("crop", [None, 30])
def test_rescue_windows_equal_enumeration(spark, crop):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "epsilon. ", "zeta\n"]
    segs = [(d, k, f"S{rng.randrange(3)}", " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 25])))) for d in range(6) for k in range(7)]
    rels = []
    for d in range(6):
        for k in range(12):
            ev = [(rng.choice(["alpha beta", "beta gamma", "", None, "nowhere"]), f"S{rng.randrange(4)}") for _ in range(rng.randrange(3))]
            rels.append((d, f"R{k}", rng.choice(words[:4]), f"S{rng.randrange(3)}", rng.choice([*words[:4], "absent", ""]), f"S{rng.randrange(3)}", ev or None))
    segments = spark.createDataFrame([(*s, len(s[3])) for s in segs], "d int, index int, segment_id string, text string, cost int")
    relations = spark.createDataFrame(rels, "d int, id string, source_text string, source_segment string, target_text string, target_segment string, evidence array<struct<text:string,segment_id:string>>")
    budget = 60 if crop is None else 14
    got = {(r["d"], r["id"]): (r["status"], r["indices"], r["tokens"]) for r in windows.rescue_windows(relations, segments, ["d"], budget, crop=crop, overhead=3).collect()}
    for d, rid, st, ss, tt, ts, ev in rels:
        own = {k: (s, t) for dd, k, s, t in segs if dd == d}
        src, tgt = ([k for k, (s, t) in own.items() if s == at and needle and needle in t] for at, needle in ((ss, st), (ts, tt)))
        evidence = {}
        for quote, at in ev or []:
            here = [k for k, (s, _) in own.items() if s == at]
            for k in [k for k in here if quote and quote in own[k][1]] or here:
                evidence.setdefault(k, set()).add(quote or "")
        best = None
        for i, j, e in product(src, tgt, list(evidence) or [None]):
            chosen = sorted({i, j} | ({e} if e is not None else set()))
            tokens = 3
            for k in chosen:
                text = own[k][1]
                if crop is None:
                    tokens += len(text)
                else:
                    needles = [st] * (k == i) + [tt] * (k == j) + sorted(evidence[k] if k == e else ())
                    a, b = focus(text, needles, crop)
                    tokens += len(text[a:b].split())
            if tokens <= budget:
                best = min(best, (len(chosen), tokens, chosen)) if best else (len(chosen), tokens, chosen)
        want = ("endpoint_absent", None, None) if not src or not tgt else ("over_budget", None, None) if best is None else ("ok", best[2], best[1])
        if got[d, rid][0] == "endpoint_absent":
            assert want[0] == "endpoint_absent"
        else:
            assert got[d, rid] == want


def test_labels_without_comparing_all(spark):
    """Labels of many tokens and overlapping spans are those of each token compared with each span, whatever their order."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        a = np.cumsum(rng.integers(0, 4, int(rng.integers(0, 40))))
        t = [(int(x), int(x + rng.integers(0, 3))) if rng.random() > 0.05 else None for x in (a if k % 3 else rng.permutation(a))]
        s = [(int(x), int(x + rng.integers(0, 9)), str(rng.choice(["P", "Q"])) if rng.random() > 0.1 else None) for x in rng.integers(-2, 60, int(rng.integers(0, 8)))]
        rows.append((k, t, None if k == 7 else s))
    d = spark.createDataFrame(rows, "k int, tokens array<struct<start:int,end:int>>, spans array<struct<start:int,end:int,type:string>>")
    old = F.transform("tokens", lambda t: F.when(t["end"] > t["start"], decode.bio_label(t["start"], t["end"], F.col("spans"))))
    got = d.select("k", chunking.token_labels("tokens", "spans").alias("new"), old.alias("old")).collect()
    assert all(r["new"] == r["old"] for r in got) and sum(x not in (None, "O") for r in got for x in r["new"]) > 50
    texts = [(0, "ab  c\nd"), (1, None), (2, ""), (3, " \n "), (4, "\u00e9\U0001f600 x\tz"), (5, "a" * 9)]
    d = spark.createDataFrame(texts, "k int, t string").coalesce(1)
    assert all(r[0] == r[1] for r in d.select(chunking.word_places("t"), chunking.token_places("t", "[^ \n]+")).collect())


def test_runs_and_choices_by_batches(spark):
    """Runs are found and spans chosen for many texts at once: no group of pandas for each, null scores passed over."""
    t = [(1, [(0, 1), (2, 3), None, (4, 4), (5, 6)], ["B-P", "I-P", "I-P", "I-P", "I-P"], [0.5, None, 0.1, 0.1, 0.9]), (2, None, None, None), (3, [(0, 1)], ["O"], [0.2]), (4, [(0, 1), (1, 2)], ["I-P", "I-Q"], [None, 0.3])]
    d = spark.createDataFrame(t, "k int, tokens array<struct<start:int,end:int>>, labels array<string>, scores array<double>")
    r = chunking.runs(d)
    assert sorted(map(tuple, r.collect()), key=str) == [(1, 0, 3, "P", 0.5), (1, 5, 6, "P", 0.9), (4, 0, 1, "P", None), (4, 1, 2, "Q", 0.3)]
    got = chunking.consolidated(r.filter("score is not null").unionByName(r.filter("k = 1").selectExpr("k", "start", "end + 3 as end", "type", "0.6D as score")), ["k"])
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 0, 3, "P", 0.5), (1, 5, 6, "P", 0.9), (4, 1, 2, "Q", 0.3)]
