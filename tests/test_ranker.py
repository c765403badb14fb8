"""Candidate ranking: graph features leave the own document out; a fitted ranker learns them and its threshold."""

import random

from quillspan.operators import ranker


def test_graph_features_leave_the_own_document_out(spark):
    rel = spark.createDataFrame([(1, "en", "a", "X", "r", "b", "Y"), (1, "en", "a", "X", "r", "b", "Y"), (2, "en", "c", "X", "q", "d", "Y"), (3, "en", "c", "X", "q", "d", "Y")], "doc int, lang string, source string, source_type string, relation string, target string, target_type string")
    c = spark.createDataFrame([(1, "en", " A", "X", "r", "b", "Y"), (9, "en", "A", "X", "r", "B", "Y"), (2, "en", "c", "X", "q", "d", "Y"), (9, "de", "a", "X", "r", "b", "Y"), (9, "en", None, "Z", "r", "b", "Y")], "doc int, lang string, source_text string, source_type string, relation string, target_text string, target_type string")
    edges, patterns = ranker.graph_facts(rel, "doc")
    got = sorted((r["doc"], r["lang"], r["source_type"], r["relation"], r["edge_prior"], r["semantic_pattern"]) for r in ranker.graph_features(c, edges, patterns, "doc").collect())
    assert got == [(1, "en", "X", "r", False, False), (2, "en", "X", "q", True, True), (9, "de", "X", "r", False, True), (9, "en", "X", "r", True, True), (9, "en", "Z", "r", False, False)]
    text = ranker.graph_features(c, edges, patterns, "doc").filter("doc = 1").select(ranker.feature_text()).first()[0]
    assert text == "language=en | source_type=X | source=a | relation=r | target_type=Y | target=b | kg_edge_prior=no | kg_semantic_pattern=no"


def test_fitted_ranker(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        prior = rng.random() < 0.5
        for rel in ("r", "q"):
            right = prior and rel == "r"
            rows.append((k % 3, k, "en", "a" + str(k % 7), "X", rel, "b", "Y", right, False, right))
    df = spark.createDataFrame(rows, "part int, pair int, lang string, source_text string, source_type string, relation string, target_text string, target_type string, edge_prior boolean, semantic_pattern boolean, positive boolean")
    train, dev, test = (df.filter(f"part = {k}") for k in range(3))
    got = ranker.train_and_rank(train, dev, test, ["pair"], [0.1, 0.3, 0.5, 0.7, 0.9]).collect()
    assert len(got) == 100
    assert sum(r["accepted"] == r["positive"] for r in got) >= 95
    assert all(r["relation"] == "r" for r in got if r["positive"])
