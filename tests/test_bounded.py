"""What an operator holds at once doesn't grow with its input, and results stay those of the plain way."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.functions import digests, spans, text
from quillspan.functions.ids import h16
from quillspan.operators import adapters, chunking, context, corpus, decode, gate, kg, relaxed, resample, resolve, splitting
from quillspan.plans import fixtures


def test_places_without_objects(spark):
    assert chunking.place_array(iter([[(0, 2), (3, 5)], None, []])).to_pylist() == [[{"start": 0, "end": 2}, {"start": 3, "end": 5}], None, []]
    d = spark.createDataFrame([(1, "ab  c"), (2, None), (3, "")], "k int, t string")
    got = {r["k"]: [tuple(p) for p in r["p"]] for r in d.select("k", chunking.token_places("t").alias("p")).collect()}
    assert got == {1: [(0, 2), (4, 5)], 2: [], 3: []}
    d = spark.createDataFrame([(1, "ab c", ["a", "b", "c"]), (2, "ab", ["x"]), (3, None, None)], "k int, t string, w array<string>")
    got = {r["k"]: r["p"] and [tuple(p) for p in r["p"]] for r in d.select("k", adapters.aligned_tokens("t", "w").alias("p")).collect()}
    assert got == {1: [(0, 1), (1, 2), (3, 4)], 2: None, 3: []}


def test_many_sequences_decoded_together(spark):
    rng, labels = np.random.default_rng(4), ["O", "B-X", "I-X", "B-Y", "I-Y"]
    seqs = [np.round(rng.normal(size=(n, 5)), 1) for n in rng.integers(1, 30, 300)]
    rows = [(k, i, x.tolist()) for k, s in enumerate(seqs) for i, x in enumerate(s)]
    got = decode.viterbi_tokens(spark.createDataFrame(rows, "k int, i int, x array<double>"), ["k"], "i", "x", labels).collect()
    want = {(k, i): y for k, s in enumerate(seqs) for i, y in enumerate(decode.viterbi(s, labels))}
    assert {(r["k"], r["i"]): r["label"] for r in got} == want and len(got) == len(rows)


def test_similarities_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(kg, "TILE", 7)
    rng = np.random.default_rng(5)
    vecs = rng.integers(-2, 3, (60, 4)).astype(float) + 0.5
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "id long, vec array<double>")
    got = {(r["query"], r["rank"]): r["match"] for r in kg.cosine_topk(base.filter("id % 3 = 0"), base, 5).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for q in range(0, 60, 3):
        best = sorted((k for k in range(60) if k != q), key=lambda k: (-np.round(unit[q] @ unit[k], 12), k))[:5]
        have = [got[q, r] for r in range(1, 6)]
        assert np.allclose([unit[q] @ unit[k] for k in have], [unit[q] @ unit[k] for k in best])
    assert len(got) == 100


def test_units_are_not_broadcast(spark):
    u = spark.range(40).select(F.col("id").alias("doc_id"), *((F.col("id") % m).alias(c) for m, c in zip((5, 4, 3, 4, 2), resample.COUNTS, strict=True)))
    got = resample.bootstrap(u, "doc_id", 20)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 20 and [r["k"] for r in resample.numbered(u, "doc_id").orderBy("doc_id").collect()] == list(range(40))


def test_edges_leave_a_task_only_if_they_can_rank(spark):
    """A line with many names and all edges between them: the best stay, ties and the job's own document included."""
    names = [f"n{k:02d}x" for k in range(30)]
    rows = [("en", a, r, b, list(range(100, 100 + 1 + (7 * i + 3 * j) % 11)) + ([1] if (i + j) % 3 == 0 else [])) for i, a in enumerate(names) for j, b in enumerate(names) for r in ("p", "q") if a != b]
    edges = spark.createDataFrame(rows, "lang string, source string, relation string, target string, docs array<long>")
    segs = spark.createDataFrame([(1, 0, "en", " ".join(names)), (2, 0, "en", "N00x and n01x"), (2, 1, "en", "n02x"), (3, 0, "de", "n00x n01x")], "doc_id long, seg int, lang string, text string")

    def want(doc, held):
        x = [(-(len(d) - (doc in d)), -len(a + b), r, a, b) for _, a, r, b, d in rows if a in held and b in held and len(d) - (doc in d) > 0]
        return sorted(x)[:3]

    got = context.edge_priors(edges, segs, ["doc_id"], "seg", 3).collect()
    for doc, held in ((1, names), (2, names[:2]), (3, [])):
        assert sorted((-r["support"], -len(r["source"] + r["target"]), r["relation"], r["source"], r["target"]) for r in got if r["doc_id"] == doc) == want(doc, held)
    near = context.edges_in_segments(edges.selectExpr("lang", "source", "relation", "target", "size(docs) as _n"), segs, ["doc_id"], 3).filter("doc_id = 1").count()
    assert near < len(rows) / 4


def test_edges_go_to_texts_in_tiers(spark, monkeypatch):
    """Frequent edges go first; a text whose job has enough of them isn't written for the next tier; results stay."""
    names = [f"m{k:02d}y" for k in range(12)] + ["two words"]
    rows = [("en" if (i + j) % 4 else "unknown", a, "p", b, list(range(100, 102 + (5 * i + 3 * j) % 17))) for i, a in enumerate(names) for j, b in enumerate(names) if a != b]
    edges = spark.createDataFrame(rows, "lang string, source string, relation string, target string, docs array<long>")
    texts = [(d, 0, "en", " ".join(names[k] for k in range(13) if (d * 7 + k * k) % 5 < 3).upper() + "\x1c") for d in range(20)] + [(50, 0, "en", None), (51, 0, None, "m01y  two\twords m00y"), (52, 0, "en", "xm01y m02yz"), (52, 1, "en", "m03y-m01y")]
    segs = spark.createDataFrame(texts, "doc_id long, seg int, lang string, text string")
    n = edges.selectExpr("lang", "source", "relation", "target", "size(docs) as _n")
    kept = []
    monkeypatch.setattr(context, "written", lambda df, label: kept.append(spark.createDataFrame(df.collect(), df.schema)) or kept[-1])
    got = {tuple(r) for r in context.edges_in_segments(n, segs, ["doc_id"], 3, block=20, first=5).collect()}
    left = [k.filter("_text is not null").count() for k in kept]
    assert len(left) > 3 and left[-1] == 0 and left[0] > left[-2]
    for doc in {t[0] for t in texts}:
        held = [(e[0], e[1], e[2], e[3], len(e[4])) for e in rows if any(e[0] in (t[2], "unknown") and e[1] in (x := spans.norm_text(t[3])) and e[3] in x for t in texts if t[0] == doc and t[3])]
        least = sorted((e[4] - 1 for e in held), reverse=True)[2:3]
        must = {(doc, *e) for e in held if not least or e[4] > least[0]}
        assert must <= {g for g in got if g[0] == doc} <= {(doc, *e) for e in held}
    odd = "".join(map(chr, [9, 10, 11, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8203, 8232, 8239, 8287, 12288, 6158]))
    d = spark.createDataFrame([(c + "A" + c + "\u00df" + c + " x" + c,) for c in odd] + [(odd,), ("",)], "t string")
    assert all(r[0] == spans.norm_text(r[1]) for r in d.select(text.norm("t"), "t").collect())


def test_spans_resolved_by_batches(spark):
    """No group of pandas for each job; two entities of one id stay two rows; other columns stay as they are."""
    segs = spark.createDataFrame([(1, "S2", 10, "b a\tx b"), (1, "S1", 0, "a b  c"), (3, "S1", 0, "zz")], "doc_id long, segment_id string, start int, text string")
    rows = [(1, "E1", "b", "S1", None), (1, "E1", "x", None, None), (1, "E2", "b", "S2", None), (1, "E3", "b", "S2", 16), (1, "E4", "a x", "S1", None), (1, "E5", "b c", None, 0), (1, "E6", None, "S9", 0), (2, "E1", "a", "S1", 0), (3, "E1", "z", "S1", None)]
    e = spark.createDataFrame(rows, "doc_id long, id string, text string, segment_id string, given_start int").withColumn("more", F.array("id"))
    got = resolve.resolve_spans(e, segs, ["doc_id"])
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(1, "E1", "b", "resolved", 2, 3), (1, "E1", "x", "resolved", 14, 15), (1, "E2", "b", "ambiguous", None, None), (1, "E3", "b", "resolved", 16, 17), (1, "E4", "a x", "resolved", 12, 15), (1, "E5", "b c", "resolved", 2, 6), (1, "E6", None, "not_found", None, None), (2, "E1", "a", "not_found", None, None), (3, "E1", "z", "ambiguous", None, None)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["id"], r["text"], r["status"], r["start"], r["end"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert all(r["more"] == [r["id"]] for r in got.collect())


def test_mentions_chosen_by_arrays(monkeypatch):
    """Second bytes of digests, and lines cut the same way however many texts are held at once."""
    heads, tails = np.array([0, 9, 10, 10, 12345678901234567, 7]), np.array([0, 99, 100, 9_999_999, 12, 10**15])
    for tag in (b"", b"x1:"):
        want = [hashlib.md5(tag + b"%d:%d" % (h, t)).digest()[1] for h, t in zip(heads.tolist(), tails.tolist(), strict=True)]
        assert digests.md5_second_bytes(tag, heads, tails).tolist() == want
    texts = ["", "a\n\nb  c", "東京都 " * 50 + "\n😀😀😀 abc" * 30, "abc def ghi jkl\n" * 50, " \n abc"]
    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "lang": "en", "text": t} for k, t in enumerate(texts)])
    lines = pa.Table.from_batches(fixtures._chosen(iter([batch]))).to_pylist()
    sizes = []
    plain = fixtures.md5_second_bytes
    monkeypatch.setattr(fixtures, "SIZE", 64)
    monkeypatch.setattr(fixtures, "md5_second_bytes", lambda tag, h, t: sizes.append(len(h)) or plain(tag, h, t))
    assert pa.Table.from_batches(fixtures._chosen(iter([batch]))).to_pylist() == lines
    assert max(sizes) <= 200 and len(lines) > 10
    for row in lines:
        assert row["seg_text"] == texts[row["doc_id"]].split("\n")[row["seg"]]
        for x in row["items"]:
            assert texts[row["doc_id"]][x["start"] :].startswith(x["tok"]) and len(x["tok"]) >= 3
            assert x["in_gold"] == (hashlib.md5(b"%d:%d" % (row["doc_id"], x["i"])).digest()[1] % 16 == 0)


def test_no_group_of_pandas_for_each_job(spark):
    """Matching and places of list items take a job as one row; texts aren't copied for each of its items."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    gold = spark.createDataFrame([(1, "Anna Smith", "PER"), (1, "Bo", "PER"), (1, "anna", "ORG"), (2, "x", "PER")], "doc_id long, text string, type string")
    pred = spark.createDataFrame([(1, "anna", "PER"), (1, "smith", "PER"), (1, "bo", None), (3, "x", "PER")], "doc_id long, text string, type string")
    for mode, most in (("boundary_type", 1), ("boundary_text", 3)):
        got = relaxed.entity_matches(gold, pred, ["doc_id"], mode)
        assert "InPandas" not in plan(got)
        assert {r["doc_id"]: (r["gold"], r["predicted"], r["matched"]) for r in got.collect()} == {1: (3, 3, most), 2: (1, 0, 0), 3: (0, 1, 0)}
    rows = spark.createDataFrame([(1, "Bo and bo", [("bo", "per"), ("bo", "per"), ("bo", "per")], None), (2, "x", [("x", "per")], None)], "job int, text string, entities array<struct<name:string,type:string>>, relations array<struct<head:string,relation:string,tail:string>>")
    e = adapters.from_lists(rows, "job", ["PER"], ["r"])[0]
    assert "InPandas" not in plan(e)
    assert sorted((r["job"], r["text"], r["start"], r["end"]) for r in e.collect() if r["start"] is not None) == [(1, "bo", 7, 9), (2, "x", 0, 1)]


def test_texts_fold_by_short_ways(spark):
    """Every character folds as in Python, alone and among others; a digest is computed once in each row."""
    chars = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + ["Straße ÀÉ Ž", "ΣΑΣ ẞ", "İI ı", "ŉ ſ ǰ µ ß", ""]
    d = spark.createDataFrame(list(enumerate(chars)), "k int, t string")
    got = dict(d.select("k", text.casefold("t"), text.casefold(F.concat(F.lit("Aß"), "t"))).rdd.map(lambda r: (r[0], (r[1], r[2]))).collect())
    assert all(got[k] == (c.casefold(), "ass" + c.casefold()) for k, c in enumerate(chars))
    assert all(re.match(f"[{text._PLAIN}]", c) is None or c.casefold() == c.lower().replace("ß", "ss") for c in chars[:-5])
    docs = spark.createDataFrame([(1, "A  b"), (2, "a B"), (3, None), (4, None), (5, "a b ")], "doc_id int, text string")
    same = corpus.overlap_quarantine(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "doc_id", "doc_id")
    assert "isnotnull(sha2" not in same._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["doc_id"], r["matches"]) for r in same.collect()] == [(2, [1, 5])]


def test_anchors_leave_a_task_only_if_they_can_rank(spark):
    """A line with many names: only the first of a type leave it, whatever the blocks; own witnesses don't count."""
    names = [(f"name{k:02d}" + "x" * (k % 5), "AB"[k % 2], 1 + k % 3, [1] if k % 4 == 0 else [1, 7] if k % 4 == 1 else [9]) for k in range(40)]
    catalog = spark.createDataFrame([("en", n, t, 1.0, s, d) for n, t, s, d in names], "lang string, name string, type string, purity double, support long, docs array<long>")
    line = " ".join(n for n, *_ in names)
    jobs = spark.createDataFrame([(1, "en", line[:200]), (1, "en", line[200:]), (2, "en", line), (9, "en", line), (3, "de", line), (4, "en", None)], "doc_id long, lang string, text string")
    got = sorted((r["doc_id"], r["rank"], r["name"]) for r in kg.exact_anchors(jobs, catalog).collect())
    want = []
    for doc, texts in ((1, [line[:200], line[200:]]), (2, [line]), (9, [line])):
        held = sorted((-len(n), -s, t, n) for n, t, s, d in names if any(n in x for x in texts) and (len(d) > 1 or d != [doc]))
        first = [h for h in held if sum(g[2] == h[2] and g <= h for g in held) <= 2]
        want += [(doc, k + 1, h[3]) for k, h in enumerate(first)]
    assert got == sorted(want)
    fit = catalog.selectExpr("lang", "name", "type", "purity", "support", "size(docs) > 1 as _several", "docs[0] as _witness")
    for block in (200_000, 7):
        n = kg.anchors_in_segments(fit, jobs.filter("doc_id = 2"), 2, block).count()
        assert n <= 4 * -(-40 // block)


def test_fingerprints_of_many_texts_at_once(spark):
    rng = np.random.default_rng(6)
    alphabets = ["ab", "abc \u00e9\u00df", "\u6f22\u5b57 x", "\U0001f600 a", "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))]
    texts = ["".join(rng.choice(list(a), n)) for a in alphabets for n in (5, 7, 8, 90, 3000)] + ["".join(rng.choice(list("abcdefgh"), 90_000))]
    texts = [t for t in map(corpus._normal, texts) if len(t) >= 5]
    for kind, step, cap in (("md5", 3, 20_000), ("md5", 1, 300), ("blake2b", 2, 50)):
        assert corpus._prints(texts, kind, 5, step, cap).tolist() == [corpus._plain_print(t, kind, 5, step, cap) for t in texts]
    keys = rng.integers(0, 256, (20_000, 17)).astype(np.uint8)
    assert digests.md5_first_eight(keys).tobytes() == b"".join(hashlib.md5(bytes(k)).digest()[:8] for k in keys)
    odd = [f"A {chr(c)} {chr(c)}b{chr(c)}" for c in range(0x3100) if c] + [" \t", "", "\x1c a \x85"]
    for r in spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.norm("t").alias("n")).collect():
        assert corpus._normal(r["t"]) == r["n"]
    got = corpus.simhash(spark.createDataFrame([(1, None), (2, "ab"), (3, "x" * 9)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_chars"], r["fingerprint"]) for r in got} == {k: (len(t), corpus._plain_print(t, "md5", 5, 3, 20_000)) for k, t in ((1, ""), (2, "ab"), (3, "x" * 9))}


def test_texts_are_read_once_for_clusters_and_their_splits(spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    prints = spark.createDataFrame([(k, 100, (k // 3) << 20) for k in range(60)], "doc_id long, n_chars int, fingerprint long").mapInArrow(watched, "doc_id long, n_chars int, fingerprint long")
    assert corpus.near_clusters(prints).count() == 60 and seen.value == 60
    seen.value = 0
    rows = spark.createDataFrame([(k // 2, "a", "x") for k in range(60)], "cluster long, source string, lang string").mapInArrow(watched, "cluster long, source string, lang string")
    got = splitting.allocate_clusters(rows, {"train": 40, "test": 20}, ["source", "lang"])
    assert got.count() == 30 and seen.value == 60


def test_best_pairs_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(gate, "SOURCES", 3)
    legal = spark.createDataFrame([("r", "A", "B"), ("q", "A", "B"), ("p", "A", "A"), ("q", "B", "B"), ("z", "C", "A")], "relation string, source_type string, target_type string")
    rng = np.random.default_rng(7)
    rows = [(1, int(rng.integers(0, 3)), f"E{k}", str(rng.choice(list("ABC")))) for k in range(40)]  # an id in one segment
    rows += [(2, int(rng.integers(0, 3)), f"E{rng.integers(0, 8)}", str(rng.choice(list("ABC")))) for _ in range(60)]
    rows += [(3, 0, "E1", "A"), (4, None, "E1", "A"), (4, None, "E2", "A"), (None, 0, "E1", "A"), (None, 0, "E2", "A")]
    m = spark.createDataFrame(rows, "doc_id long, seg int, id string, type string")
    for tag, part in (("", 7), ("x", 2), ("y", 1)):  # many equal scores
        score = lambda kind: h16(F.concat(F.lit(tag), F.col("doc_id").cast("string"), "source_id", kind, "target_id")) % part  # noqa: B023, E731
        got = gate.best_pairs(m, legal, ["doc_id"], score, part // 2)
        c = gate.candidate_pairs(m, legal, ["doc_id"]).withColumn("score", score(F.col("type")))
        want = gate.keep_best(c, ["doc_id", "source_id", "target_id"], "score", "type").filter(F.col("score") >= part // 2)
        order = ["doc_id", "source_id", "target_id", "type", "score"]
        assert sorted(map(tuple, got.select(order).collect())) == sorted(map(tuple, want.select(order).collect())) != []
    made = entry.queries()["best_per_pair"](spark, "/root/testdata/sf0.001")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", made._jdf.queryExecution().executedPlan().toString())
    assert sum("source_id" in d for d in dealt) == 1  # of the pairs of repeated ids
