"""The training-data operators against plain versions of themselves, with awkward tables."""

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import common, components, language_model, licenses, line_dedup, media, near_dup, packing, quality_classifier, quality_rules, sentencepiece_codec, warc

LINE = "This line is long enough to be a key of its own, surely."
ROWS = [
    (1, f"  {LINE.upper()} \nalpha beta gamma delta epsilon zeta eta theta iota kappa", "en"),
    (2, f"{LINE}\n{LINE}\nshort", "en"),
    (3, f"x\n{LINE}\t\n", "de"),
    (4, LINE, "de"),
    (5, f"\n{LINE}", None),
    (6, "", "en"),
    (7, None, "fr"),
    (8, "one two", "fr"),
    (8, "one two", "fr"),
    (None, "a null id " * 30, "en"),
    (9, "word " * 3000 + "é漢😀 end", "es"),
]
SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    common.tune(spark)
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n_lines", F.lit("clash")).withColumn("SCORE", F.lit("clash"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_lines(rows, min_docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(common.ASCII_SPACE))
    low = -(1 << 63)
    holders: dict = {}
    for n, (i, t, *_) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append((low if i is None else i, n))
    out = []
    for i, t, *_ in rows:
        gone = [len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)])[0] != (low if i is None else i) for x in (t or "").split("\n")]
        out.append((i, len(gone), sum(gone), "\n".join(x for x, g in zip((t or "").split("\n"), gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("resident", [1 << 20, 0])
def test_line_dedup(docs, resident):
    got = line_dedup.dedup_lines(docs, resident_bytes=resident, hot_share=2)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == brute_lines(ROWS)
    assert got.filter("doc_id = 5").first()["n_dropped"] == 0


def test_line_dedup_empty(none):
    assert line_dedup.dedup_lines(none).collect() == []


def test_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(-(1 << 63), 1 << 63, (2, 5000), dtype=np.int64)
    n = np.arange(5000)
    h = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(h1, h2, n, n * 7).to_bytes())
    at = h.find(h1, h2)
    assert sorted(at) == list(range(5000))
    assert (h.largest[at] == n * 7).all()
    assert (h.find(h1 + 1, h2 + 1) == -1).all()


WRAPPED = """Some words before.

Permission is hereby granted, free of charge, to any person obtaining
a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including

Words after it."""


def test_license_scan(spark, none):
    rows = [
        (1, "x\nReleased under the MIT License.\ny"),
        (2, "She renewed her driving license at the office."),
        (3, None),
        (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, ""),
        (6, "All rights reserved.\nLicensed under CC BY-NC 4.0."),
        (7, "This is free and unencumbered software released into the domain."),
        (8, WRAPPED),
        (9, "SPDX-License-Identifier: GPL-2.0-only\n\nThe MIT License (MIT)"),
        (9, "word " * 50_000 + "\nReleased under the BSD 2-Clause License."),
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("families", F.lit("clash")).withColumn("_scan", F.lit("own")).withColumn("_cued", F.lit("own"))
    out = licenses.scan_licenses(d)
    assert out.columns == ["doc_id", "text", "_scan", "_cued", "n_paragraphs", "n_scored", "licenses", "families"]
    got = sorted((r["doc_id"], r["families"], [x["paragraph"] for x in r["licenses"]], r["n_paragraphs"]) for r in out.collect())
    assert got == [(1, ["mit"], [1], 3), (2, [], [], 1), (3, [], [], 1), (4, ["gpl"], [0], 1), (5, [], [], 1), (6, ["cc-by-nc", "proprietary"], [0, 1], 2), (7, ["unlicense"], [0], 1), (8, ["mit"], [2], 7), (9, ["bsd"], [1], 2), (9, ["gpl", "mit"], [0, 2], 3)]
    assert licenses.scan_licenses(none).collect() == []


def scan_by_hand(text):
    """The model and its confirmation in plain Python."""
    weights, bias, heat = licenses.model()
    own = set(licenses.grams(text))
    z = np.array(bias) + sum((np.array(weights[x]) for x in own if x in weights), np.zeros(len(bias)))
    p = np.exp((z - z.max()) * heat)
    p = p / p.sum()
    name = ["", *licenses.FAMILIES][int(p.argmax())]
    similarity = max((len(own & set(licenses.pairs_of(t))) / len(licenses.pairs_of(t)) for t in licenses.TEMPLATES.get(name, [])), default=0)
    return name if name and p.max() >= licenses.MIN_PROBABILITY and similarity >= licenses.MIN_SIMILARITY else None, p.max()


def test_license_probabilities_equal_the_model(spark):
    texts = [t for f in licenses.FAMILIES for t in licenses.TEMPLATES[f]] + licenses.OTHERS
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(licenses.scan_paragraph(F.col("t"))).collect()]
    right = 0
    for t, g in zip(texts, got, strict=True):
        family, p = scan_by_hand(t)
        assert g["probability"] == pytest.approx(p, abs=2e-6)
        assert g["family"] == family
        own = next((f for f in licenses.FAMILIES if t in licenses.TEMPLATES[f]), None)
        right += family == own
        assert own is not None or family is None
    assert right >= 0.98 * len(texts)


def test_cues_lose_no_paragraph_that_could_be_confirmed():
    """Whatever 2-grams of a template a paragraph lacks, if it has enough of them then it has a cue."""
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            own = licenses.pairs_of(t)
            without = sum(not any(c in g for c in licenses.cues()) for g in own)
            assert without < licenses.MIN_SIMILARITY * len(own)


def test_scan_and_model_agree_on_documents(spark):
    """Every line of documents: found by the scan if and only if the model confirms it."""
    d = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    found = {(r["doc_id"], x["paragraph"], x["family"]) for r in licenses.scan_licenses(d).collect() for x in r["licenses"]}
    want = set()
    for r in d.collect():
        for k, line in enumerate((r["text"] or "").split("\n")):
            if (family := scan_by_hand(line)[0]) is not None:
                want.add((r["doc_id"], k, family))
    assert want
    assert want <= found
    assert {x[0] for x in found} == {x[0] for x in want}  # no notice is wrapped there


def test_planted_licenses(spark):
    """Precision and recall on lines planted in documents, wrapped and not, of wording that training had in part."""
    base = [r["text"] or "" for r in common.table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(60).collect()]
    rows, want = [], {}
    for k, t in enumerate(base):
        family = licenses.FAMILIES[k % len(licenses.FAMILIES)]
        notice = licenses.TEMPLATES[family][k % len(licenses.TEMPLATES[family])]
        words = ("Copyright 2020 Some One. " + notice).split()
        wrapped = "\n".join(" ".join(words[j : j + 7]) for j in range(0, len(words), 7))
        rows.append((k, f"{t}\n\n{wrapped}\n\n{licenses.OTHERS[k % len(licenses.OTHERS)]}" if k % 2 else f"{t}\n\n{licenses.OTHERS[k % len(licenses.OTHERS)]}"))
        want[k] = {family} if k % 2 else set()
    got = {r["doc_id"]: set(r["families"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    planted = [k for k in want if want[k]]
    assert sum(want[k] <= got[k] for k in planted) >= 0.9 * len(planted)
    own = {k: {f for x in base[k].split("\n") if (f := scan_by_hand(x)[0])} for k in want}
    assert sum(not (got[k] - own[k] - want[k]) for k in want) >= 0.95 * len(want)


def brute_near(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(sets)
    link = [[i != j and (sets[i] == sets[j] or (len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j])))) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in range(n) if link[i][j])]) for i in range(n)]
    return label, [sum(r) for r in link]


def near_rows():
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)] * 3
    for _ in range(30):
        w = list(base)
        w[int(rng.integers(120))] = f"z{rng.integers(1000)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [f"q{k}" for k in range(60)]), "", None, " \n", "one two", "one  two", "x y z"]
    return texts


@pytest.mark.parametrize(("block", "part"), [(1024, 1_000_000), (7, 2)])
def test_near_duplicates(spark, block, part, monkeypatch):
    """Also with components of many blocks, frequent prefixes spread over several, and frequent join keys dealt in parts."""
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    monkeypatch.setattr(near_dup, "PART_ROWS", part)
    texts = near_rows()
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").withColumn("node", F.lit("clash"))
    label, links = brute_near(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_dup.near_duplicates(d).collect()}
    assert got == {k: (label[k], links[k]) for k in range(len(texts))}
    kept = near_dup.stage_near_duplicates(spark, d, "")
    assert kept.columns == d.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted({label[k] for k in range(len(texts))})


def near_pairs(n, rng):
    """Texts in pairs of a similarity just above 4/5, where a forest loses most."""
    out = []
    for k in range(n):
        w = [f"p{k}w{j}" for j in range(100)]
        v = list(w)
        v[2] = v[50] = "other"
        out += [" ".join(w), " ".join(v[:-1] if rng.random() < 0.5 else v)]
    return out


def test_forest_recall(spark):
    """Of the links of documents whose id is divisible by 20, against all pairs."""
    texts = near_pairs(400, np.random.default_rng(1)) + [" ".join(f"x{k}y{j}" for j in range(30)) for k in range(200)]
    label, links = brute_near(texts[:800])
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_links"] for r in near_dup.near_duplicates(d).collect()}
    asked = range(0, 800, 20)
    assert sum(links[k] for k in asked) >= 40
    assert sum(got[k] for k in asked) >= 0.9 * sum(links[k] for k in asked)
    assert sum(got.values()) >= 0.998 * sum(links)
    assert all(got[k] == 0 for k in range(800, 1000))


def test_prefixes_shorten_level_by_level(spark, monkeypatch):
    """A target that no depth reaches goes down one level after another; counts are those of the components as they are
    at each level, so that no link counts twice."""
    steps = []
    true_recall = near_dup.recall
    monkeypatch.setattr(near_dup, "RECALL", 1.1)
    monkeypatch.setattr(near_dup, "recall", lambda seen, depth: steps.append((depth, seen.sum())) or true_recall(seen, depth))
    texts = near_pairs(150, np.random.default_rng(2))
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    n_links = sum(r["n_links"] for r in near_dup.near_duplicates(d).collect())
    assert [depth for depth, _ in steps] == [5, 4]
    assert steps[0][1] <= steps[1][1] <= n_links / 2 == sum(brute_near(texts)[1]) / 2


def test_recall_estimate():
    """Links near the threshold ask for shorter prefixes, those far above don't."""
    high, low = np.zeros(101), np.zeros(101)
    high[96], low[80] = 50, 50
    assert near_dup.recall(high, near_dup.DEPTH) > near_dup.RECALL
    assert near_dup.recall(low, near_dup.DEPTH) < near_dup.RECALL < near_dup.recall(low, 4)
    assert near_dup.recall(np.zeros(101), near_dup.DEPTH) < near_dup.RECALL


def test_near_duplicates_null_ids_repeats_and_none(spark, none):
    d = spark.createDataFrame([(None, "a b c d e f"), (None, "g h i j k l"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id bigint, text string")
    got = near_dup.near_duplicates(d).collect()
    assert Counter(r["n_links"] for r in got) == {2: 3, 0: 1}
    assert near_dup.stage_near_duplicates(spark, d, "").count() == 2
    assert near_dup.near_duplicates(none).collect() == []
    assert near_dup.stage_near_duplicates(spark, none, "").collect() == []
    words = [f"w{k}" for k in range(60)]
    near = spark.createDataFrame([(5, " ".join(words)), (5, " ".join(words)), (6, " ".join([*words[:-1], "z"]))], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in near_dup.near_duplicates(near).collect()) == [(5, 5, 2), (5, 5, 2), (6, 5, 2)]
    assert [r["doc_id"] for r in near_dup.stage_near_duplicates(spark, near, "").collect()] == [5]
    named = spark.createDataFrame([("b", " ".join(words)), ("a", " ".join(words)), ("c", "one two")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["n_links"]) for r in near_dup.near_duplicates(named).collect()) == [("a", 1), ("b", 1), ("c", 0)]


def test_maybe_in(spark):
    keys = spark.range(0, 5000, 5)
    seen = spark.range(5000).withColumn("hit", common.MaybeIn(keys, "id")(F.col("id"))).toPandas()
    assert seen["hit"][seen["id"] % 5 == 0].all()
    assert seen["hit"][seen["id"] % 5 != 0].mean() < 0.1


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(200, 100), (100, 300), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}


def test_language_model(docs, none):
    rows = [t or "" for _, t, _ in ROWS]
    model = language_model.train(docs, 3)
    got = {(r["doc_id"], r["n_tokens"]): r for r in language_model.score(docs, model).collect()}
    toks = [[*t.encode().lower().split(), b"\n"] for t in rows]
    count = Counter(w for t in toks for w in t)
    n, v = sum(count.values()), len(count)
    assert (model.trained, model.vocabulary) == (n, v)
    for (i, _, _), t in zip(ROWS, toks, strict=True):
        r = got[i, len(t)]
        assert r["n_known"] == len(t)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(t)))
    assert len(got) == len({(i, len(t)) for (i, _, _), t in zip(ROWS, toks, strict=True)})
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert language_model.score(none, model).collect() == []
    empty = language_model.train(none, 2)
    assert all(r["score"] == pytest.approx(0) for r in language_model.score(docs, empty).collect())


def test_ogg(docs, none):
    def crc(data):
        r = 0
        for b in data:
            r ^= b << 24
            for _ in range(8):
                r = ((r << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else r << 1
        return r
    assert media.ogg_crc(b"OggS and so on\xff\x00") == crc(b"OggS and so on\xff\x00")
    got = media.decode_ogg(media.encode_ogg(docs)).collect()
    for r in got:
        raw = (r["text"] or "").encode()
        assert bytes(r["payload"]) == raw + b"\xff" * (len(r["payload"]) - len(raw))
        assert len(r["payload"]) % 576 == 0 < len(r["payload"])
        assert r["media_error"] is None
    assert media.decode_ogg(media.encode_ogg(none)).collect() == []
    whole = media.ogg_bytes(bytes(576 * 300))
    assert media.ogg_features(whole)[0] == bytes(576 * 300)
    for bad in (whole[:-1], whole[:100] + b"\x01" + whole[101:], whole[5:]):
        with pytest.raises(ValueError):
            media.read_ogg(bad)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    want = []
    for i, t, _ in ROWS:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, k, 64 * k, len(ids[64 * k : 64 * k + 64]), zlib.crc32(struct.pack(f"<{len(ids[64 * k : 64 * k + 64])}I", *ids[64 * k : 64 * k + 64]))) for k in range(-(-len(ids) // 64))]
    got = packing.pack_documents(docs, path, 64).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert packing.pack_documents(none, path).collect() == []


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    texts = ["It's <|endoftext|>x Ünï ß µ ª² x́ é İstanbul ΣΑΣ a\x1cb\x00c\x85d 12'll don't 日本 ​ ﬁ Å Å naïve's", "", " \n\t", "á ́b", "x" * 300, "A,b;C--d 3.14 \xa0 　y"]
    for a, b in zip(enc(texts) + enc(texts), texts + texts, strict=True):
        assert np.frombuffer(a, "<u4").tolist() == tok.encode(b, add_special_tokens=False).ids


def test_plan_fills_sequences():
    rng = np.random.default_rng(5)
    hist = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 50, 40), strict=True)}
    rows = packing.plan(hist, 100)
    used: dict = {}
    for length, a, b, first, offset in rows:
        for k in range(b - a):
            assert used.get(first + k, 0) == offset
            used[first + k] = offset + length
    assert max(used.values()) <= 100
    assert {k: sum(b - a for length, a, b, _, _ in rows if length == k) for k in hist} == hist
    assert packing.plan({}) == []


def test_quality_classifier(spark, none):
    good, bad = "Plain words make a calm line, number {}.", "LOUD### WORDS!! | {} | $$$ here%%%"
    rows = [(k, (bad if k % 4 == 0 else good).format(k)) for k in range(400)] + [(1000, None), (1001, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(300)] + [(7, None), (8, 5)], "doc_id bigint, quality int")
    model = quality_classifier.train(quality_classifier.featurize(d), labels)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(d, model).collect()}
    other = {r["doc_id"]: r["score"] for r in quality_classifier.score_features(quality_classifier.featurize(d), model).collect()}
    assert got == other
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= 0.3) == (k % 4 != 0) for k in range(300, 400)]) >= 0.97
    assert got[1000] == got[1001]
    alone = quality_classifier.train(quality_classifier.featurize(d), labels.filter("quality = 1"))
    assert all(r["score"] > 0.99 for r in quality_classifier.score_documents(d, alone).collect())
    assert quality_classifier.score_documents(none, quality_classifier.train(quality_classifier.featurize(none), labels)).collect() == []


def test_features_pack():
    x = np.array([0, 1, 300, 65535], "<u2")
    assert quality_classifier.unpacked(quality_classifier.packed(x)).tolist() == x.tolist()
    assert len(quality_classifier.unpacked(quality_classifier.packed(x[:0]))) == 0


def brute_rules(t):
    words, lines = (t or "").encode().split(), (t or "").split("\n")
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(runs)
    hit = {k for i, r in enumerate(runs) if n[r] > 1 for k in range(i, i + 5)}
    full = [x for x in lines if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(hit)


def test_rule_features(docs, none, monkeypatch):
    want = sorted(str((i, *brute_rules(t))) for i, t, _ in ROWS)
    run = lambda: sorted(str(tuple(r[c] for c in ("doc_id", *quality_rules.FEATURES[:5]))) for r in quality_rules.rule_features(docs).collect())
    assert run() == want
    assert quality_rules.rule_features(none).collect() == []
    w = ("a b c d e f " * 40 + "g h i j").encode().split()
    expect = quality_rules.repeat_words(w)
    monkeypatch.setattr(quality_rules, "ARRAY_WORDS", 0)
    assert quality_rules.repeat_words(w) == expect == brute_rules(" ".join(x.decode() for x in w))[4]


def test_thresholds(spark, docs):
    assert quality_rules.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality_rules.binomial_tail(3, 50, 0.1) == pytest.approx(sum(np.prod([(50 - j) / (j + 1) for j in range(i)]) * 0.1**i * 0.9 ** (50 - i) for i in range(4)))
    rows = [(k, "en", " ".join(f"w{k}{c}" + ("###" if k % 5 == 0 else "") for c in "abcdefghij")) for k in range(4000)]
    d = spark.createDataFrame([(a, c, b) for a, b, c in rows], SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(4000)], "doc_id bigint, quality int")
    f = quality_rules.rule_features(d).drop("text")
    cut = quality_rules.fit_thresholds(quality_rules.labelled_features(f, labels))
    assert "symbols" in cut["en"]
    x = f.select("doc_id", F.size(quality_rules.rejected_by(cut)).alias("n")).collect()
    assert all((r["n"] > 0) == (r["doc_id"] % 5 == 0) for r in x)
    few = quality_rules.fit_thresholds(quality_rules.labelled_features(f, labels.filter("doc_id < 50")))
    assert not any(few.values())


def test_sentencepiece(docs, none):
    import sentencepiece as spm

    path = sentencepiece_codec.model_path()
    sp, c = spm.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    rng = np.random.default_rng(2)
    letters = list("aaaabbbeeetthhiinno   \n\té漢😀.,##ABCS012   ▁")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(2000)] + [t or "" for _, t, _ in ROWS]
    for t in texts:
        ids = np.frombuffer(c.encode(t), "<u4").tolist()
        assert ids == sp.encode(t), t
        assert c.decode(ids) == t.replace("▁", " ")
    e = sentencepiece_codec.StreamingEncoder(c.v)
    long = "▁" + "theinere" * 3000 + "a" * 5000
    out = [i for k in range(0, len(long), 777) for i in e.feed(long[k : k + 777])]
    assert e.widest < 2000
    assert out + e.close() == sp.encode(long[1:])
    got = sentencepiece_codec.decode_pieces(sentencepiece_codec.encode_pieces(docs, path), path).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    assert sentencepiece_codec.encode_pieces(none, path).collect() == []


def test_warc(spark):
    big, small = "x" * 200, "y"
    rows = [(3, "http://a/ b", big), (2, None, big), (2, None, big), (9, "u", big), (4, "v", small), (5, "w", small), (6, "z", None), (7, "L", "é" * 50_000), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    back = warc.read_archives(warc.write_archives(warc.revisit_targets(pages), 1000, 5000)).collect()
    got = sorted(str((r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None, r["digest"][7:])) for r in back)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        ref = 2 if len(raw) >= 100 and t == big and i != 2 else None
        want.append(str((i, "revisit" if ref else "response", ref, None if ref else raw, hashlib.sha256(raw).hexdigest())))
    assert got == sorted(want)
    assert warc.read_archives(warc.write_archives(warc.revisit_targets(pages.limit(0)))).collect() == []
    for bad in (b"5\r\nab", b"2\r\nabXX0\r\n\r\n", b"0\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_warc_missing_segment(spark):
    recs = warc.page_records("r", 1, "u", b"z" * 5000, None, 1000)
    frame = lambda parts: spark.createDataFrame([(bytearray(b"".join(parts)),)], "content binary")
    assert warc.read_archives(frame(recs[::-1])).first()["payload"] == b"z" * 5000
    with pytest.raises(Exception, match="missing"):
        warc.read_archives(frame(recs[:2] + recs[3:])).collect()
