"""The pipeline's stages keep columns, take effect, and lead to what a plain Python version of them gives."""

import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import common, near_dup, packing, quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    names = docs.columns
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stash(stage(spark, docs, SF), "t")
        assert docs.columns == names
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= left, name
        left = now
        if name == "quality rules":
            assert quality_rules.rule_features(docs).filter(quality_rules.base_failed()).count() == 0
    assert near_dup.near_duplicates(docs).filter("node <> class_id").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == left
    assert len(left) > 100


AWKWARD = "doc_id bigint, text string, lang string, score string, n_words string, node string, _line_hits string, SEQUENCE_ID string"


def awkward_rows():
    words = " ".join(f"word{k}" for k in range(40))
    long = " ".join(f"long{k % 997} text{k}" for k in range(20_000))
    rows = [(1, words, "en"), (1, words, "en"), (2, None, None), (3, "", "en"), (None, words + " tail", None), (4, long, "xx"), (5, words.replace("word3 ", "other "), "en"), (6, "same line of at least forty characters, here it is\n" * 3 + words, "en")]
    return [(*r, "own score", "own n", "own node", "own hits", "own id") for r in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, name):
    """Nulls, empty and very long texts, repeated rows, ties, no rows, and columns named like operators' own."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(awkward_rows(), AWKWARD)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "best-fit packing":
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r[0] for r in awkward_rows())
    else:
        assert out.columns == docs.columns
        assert all(tuple(r)[3:] == ("own score", "own n", "own node", "own hits", "own id") for r in rows)
        assert 4 in {r["doc_id"] for r in rows}
    if name == "n-gram Jaccard join":
        assert sorted(str(r["doc_id"]) for r in rows) == ["2", "4", "6", "None"]  # a null id ranks lowest
    assert stage(spark, docs.limit(0), SF).collect() == []


def plain_level(rule, f):
    """How many of a rule's cutoffs a document exceeds."""
    top, under = re.fullmatch(r"(\w+) / greatest\((\w+), 1\)", quality_rules.RULES[rule][0]).groups()
    return min(quality_rules.GRID, max(0, math.ceil(f[top] / max(f[under], 1) / quality_rules.RULES[rule][1]) - 1))


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_pipeline(rows, labels, cutoffs, model):
    """rows: doc_id, lang, text. The rules' cutoffs and the fitted model are given; all else is done by hand."""
    kept = []
    for i, lang, t in rows:
        words = t.encode().split() if t else []
        text = t or ""
        wins = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        rep = len({j for k in range(len(words) - 4) if wins[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)})
        if len(words) < 10 or 100 * rep > 20 * len(words):
            continue
        f = dict(zip(quality_rules.FEATURES, quality_rules.features(text), strict=True))
        if any(plain_level(rule, f) >= round(cut / quality_rules.RULES[rule][1]) for rule, cut in cutoffs.get(lang or "*", {}).items()):
            continue
        kept.append((i, text))
    f = quality_classifier.Featurizer()
    kept = [(i, t) for i, t in kept if model.scores([f(t)])[0] >= quality_classifier.THRESHOLD]
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(common.ASCII_SPACE))
    holders: dict = {}
    for i, t in kept:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append(i)
    kept = [(i, "\n".join(x for x in t.split("\n") if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != i))) for i, t in kept]
    sets = [shingle_set(t) for _, t in kept]
    label = list(range(len(kept)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(kept)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] == sets[b] or n * 9 >= 4 * (len(sets[a]) + len(sets[b])):
                label[root(a)] = root(b)
    least: dict = {}
    for k, (i, _) in enumerate(kept):
        least[root(k)] = min(least.get(root(k), i), i)
    return [(i, t) for k, (i, t) in enumerate(kept) if least[root(k)] == i]


def test_run_equals_a_plain_version(spark):
    from tokenizers import Tokenizer

    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    rules = quality_rules.rule_features(docs.select("doc_id", "lang", "text")).drop("text")
    cutoffs = quality_rules.fit_thresholds(quality_rules.labelled_features(rules, labels))
    passed = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    model = quality_classifier.train(quality_classifier.featurize(passed.select("doc_id", "text")).drop("text"), labels)
    want = plain_pipeline([(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()], labels, cutoffs, model)
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out["doc_id"]) == {i for i, _ in want}
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in want:
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        own = out[out["doc_id"] == i].sort_values("piece")
        assert own["length"].tolist() == [min(4096, n - k) for k in range(0, n, 4096)]
        assert own["start"].tolist() == list(range(0, n, 4096))
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == np.r_[0, s["length"].cumsum()[:-1]].tolist()
        assert s["length"].sum() <= 4096


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert out.count() > 100
