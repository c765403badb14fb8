"""The quality classifier's fit and the quality rules' cutoffs against plain versions, and a chunk of very many words."""

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillspan.llm import language_model, quality_classifier, quality_rules


def plain_features(text):
    """Hashes of words and of runs of one to three shapes, by the definition."""
    shape = lambda w: re.sub(rb"(.)\1+", rb"\1", bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in w), flags=re.DOTALL)
    words = text.encode().split()
    shapes = [shape(w) for w in words]
    found = {zlib.crc32(w) for w in words}
    found |= {zlib.crc32(b"\0".join((b"shape", *shapes[k : k + n]))) for n in (1, 2, 3) for k in range(len(shapes) - n + 1)}
    return sorted({x % quality_classifier.DIMS for x in found})


def test_features_and_ratios_by_hand(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "Beta", "GAMMA", "d3lta", "a1" * 20 + "b", "a1" * 20 + "2", "x" * 500, "é!"]
    docs = [(k, " ".join(rng.choice(vocabulary, int(rng.integers(0, 9))))) for k in range(120)]
    labels = [(k, int(rng.integers(0, 2))) for k in range(0, 120, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    feats = quality_classifier.featurize(d).drop("text")
    got = {r["doc_id"]: quality_classifier.unpacked(r["features"]).tolist() for r in feats.collect()}
    want = {k: plain_features(t) for k, t in docs}
    assert got == want
    assert plain_features(vocabulary[4]) != plain_features(vocabulary[5])  # words that differ after forty runs
    model = quality_classifier.train(feats, spark.createDataFrame(labels, "doc_id long, quality int"))
    n = {q: Counter() for q in (0, 1)}
    for k, q in labels:
        if zlib.crc32(str(k).encode()) % 5:
            n[q].update(want[k])
    total = {q: sum(c.values()) + quality_classifier.SMOOTH * quality_classifier.DIMS for q, c in n.items()}
    ratio = lambda f: math.log((n[1][f] + 1) / total[1]) - math.log((n[0][f] + 1) / total[0])
    for f in {f for w in want.values() for f in w}:
        assert model.ratios[f] == pytest.approx(ratio(f))


def test_hinge_optimum_and_curve():
    rng = np.random.default_rng(2)
    d, rows = 12, [np.flatnonzero(rng.random(12) < 0.5) for _ in range(40)]
    y = np.where(rng.random(40) < 0.4, 1, -1)
    ratios, cost = rng.normal(size=d), 0.7
    w, b = quality_classifier.fit_hinge(rows, y, ratios, cost=cost, epochs=5000)
    x = np.zeros((40, d + 1))
    for k, r in enumerate(rows):
        x[k, r] = ratios[r] / max(np.sqrt((ratios[r] ** 2).sum()), 1e-12)
        x[k, d] = 1.0
    c = np.array([cost * 40 / (2 * (y == s).sum()) for s in y])
    primal = lambda v: 0.5 * v @ v + (c * np.maximum(0, 1 - y * (x @ v))).sum()
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20_000):  # projected gradient on the dual
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, c)
    dual = alpha.sum() - 0.5 * alpha @ q @ alpha
    ours = primal(np.r_[w, b])
    assert dual - 1e-6 <= ours <= dual + 0.01 * abs(dual)
    m = rng.normal(size=200)
    t = np.where(m + rng.normal(size=200) > 0, 1, -1)
    up, down = (t == 1).sum(), (t != 1).sum()
    target = np.where(t == 1, (up + 1) / (up + 2), 1 / (down + 2))

    def loss(a, o):
        z = a * m + o
        return (np.logaddexp(0, z) - target * z).sum() + 0.5e-3 * a * a

    a, o = quality_classifier.fit_logistic(m, t)
    assert all(loss(a, o) <= loss(a + i, o + j) + 1e-9 for i in (-0.01, 0, 0.01) for j in (-0.01, 0, 0.01))


def plain_level(rule, f):
    top, under = {"symbols": ("n_symbols", "word_chars"), "shouting": ("n_upper", "word_chars"), "exclaims": ("n_exclaims", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}[rule]
    step = quality_rules.RULES[rule][1]
    return min(quality_rules.GRID, max(0, math.ceil(f[top] / max(f[under], 1) / step) - 1))


def tail(k, n, p):
    p = Fraction(p).limit_denominator(10**6)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def plain_cutoffs(rows, alpha, delta):
    """rows: features, language, quality. The tightest cutoff of each language and rule that a sequence of exact tests from
    the loosest on reaches, or the loosest that rejects 99 % of what it does; each rule has its share of the risk."""
    strata = sorted({lang or "*" for _, lang, _ in rows})
    out = {}
    for s in strata:
        for rule in quality_rules.RULES:
            good, bad = ([plain_level(rule, f) for f, lang, q in rows if (lang or "*") == s and q == k] for k in (1, 0))
            reached = []
            for j in range(quality_rules.GRID - 1, -1, -1):
                k = sum(x > j for x in good)
                if not good or k > alpha / 5 * len(good) or tail(k, len(good), alpha / 5) > delta / (5 * len(strata)):
                    break
                reached.append(j)
            hits = {j: sum(x > j for x in bad) for j in reached}
            best = max(hits.values(), default=0)
            chosen = next((j for j in reached if best and hits[j] >= 0.99 * best), None)
            if chosen is not None:
                out.setdefault(s, {})[rule] = chosen + 1
    return out


def test_cutoffs_and_verdicts_equal_a_plain_version(spark):
    """Two languages have enough good labels for cutoffs, one has not, and rows without a language are one more."""
    rng = np.random.default_rng(3)
    rows = []
    for lang, n in (("en", 1400), ("de", 1200), ("fr", 60), (None, 1000)):
        for _ in range(n):
            q = int(rng.random() < 0.8)
            words = int(rng.integers(10, 60))
            f = {"n_words": words, "word_chars": 5 * words, "n_lines": 10, "n_repeat_words": 0, "n_symbols": 0, "n_upper": 0, "n_exclaims": 0, "n_dup_lines": 0}
            if not q:
                f["n_symbols"], f["n_exclaims"] = int(rng.integers(0, 3 * words)), int(rng.integers(0, words))
                f["n_dup_lines"] = int(rng.integers(0, 9)) if lang == "de" else 0
            elif rng.random() < 0.003:
                f["n_symbols"] = words
            rows.append((f, lang, q))
    frame = spark.createDataFrame([(k, lang, q, *(f[c] for c in quality_rules.FEATURES)) for k, (f, lang, q) in enumerate(rows)], "doc_id long, lang string, quality int, " + ", ".join(f"{c} long" for c in quality_rules.FEATURES))
    got = quality_rules.fit_thresholds(frame)
    want = plain_cutoffs(rows, quality_rules.ALPHA, quality_rules.DELTA)
    assert {s: {r: round(v / quality_rules.RULES[r][1]) for r, v in c.items()} for s, c in got.items() if c} == want
    assert sum(bool(c) for c in want.values()) >= 3 and "fr" not in want
    verdict = {r["doc_id"]: r["rules"] for r in frame.select("doc_id", quality_rules.rejected_by(got).alias("rules")).collect()}
    for k, (f, lang, _) in enumerate(rows):
        assert verdict[k] == [r for r in quality_rules.RULES if r in want.get(lang or "*", {}) and plain_level(r, f) >= want[lang or "*"][r]]
    for s in ("en", "de"):  # the promise itself
        good = [k for k, (_, lang, q) in enumerate(rows) if lang == s and q]
        assert sum(bool(verdict[k]) for k in good) <= quality_rules.ALPHA * len(good)


def test_chunks_of_any_size_have_their_pairs():
    """Numbers of contexts, words and rows whose product is beyond 64 bits give the same pairs as small ones."""
    rng = np.random.default_rng(4)
    words = np.sort(rng.integers(1, 1 << 62, 50).astype(np.uint64))
    word, before, row = rng.integers(0, 50, 400), rng.integers(0, 50, 400), rng.integers(0, 30, 400)
    split = language_model.Split(words[:3].copy(), np.array([2, 3, 2]))
    small = language_model.pairs_by_shard(language_model.Tokens(words, word, before, row), split, 4)
    large = language_model.pairs_by_shard(language_model.Tokens(words, word, before, row + (1 << 55)), split, 4)
    assert [x.tolist() for x in small[:1] + small[2:5]] == [x.tolist() for x in large[:1] + large[2:5]]
    assert (small[1] + (1 << 55)).tolist() == large[1].tolist()
    assert [(s, a, b) for s, a, b in small[5]] == [(s, a, b) for s, a, b in large[5]]
