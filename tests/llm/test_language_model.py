"""The Pitman-Yor model against exact numbers of tables and a sampler that seats customers one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import common, language_model, pitman_yor

D, A, D_UP, A_UP = 0.5, 2.0, 0.4, 5.0


def test_stirling_numbers():
    s = pitman_yor.stirling(0.3, 6).astype(float)
    assert np.exp(s[3, 1:4]) == pytest.approx([0.7 * 1.7, 3 - 3 * 0.3, 1], rel=1e-5)
    x = np.array([0.02, 1.5, 16.0, 400.0])
    import math

    assert pitman_yor.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x])


@pytest.mark.parametrize("d", [0.05, 0.3, 0.5, 0.8, 0.95])
@pytest.mark.parametrize("c", [2, 3, 9, 300, 1000])
def test_tables_follow_their_distribution(c, d):
    """Small and large numbers of customers, from one table to hundreds."""
    exact = pitman_yor.stirling.__wrapped__(d, c)[c, 1:].astype(float)
    k = np.arange(1, c + 1)
    for x in (0.02, 0.5, 5.0, 80.0):
        p = exact + k * np.log(x)
        p = np.exp(p - p.max())
        drawn = pitman_yor.draw_tables(np.full(4000, c), np.full(4000, x), d, np.random.default_rng(4))
        assert drawn.min() >= 1 and drawn.max() <= c
        assert drawn.mean() == pytest.approx((p * k).sum() / p.sum(), rel=0.05)


def corpus():
    rng = np.random.default_rng(8)
    words = ["a", "b", "c", "d", "Night", "day", "é"]
    nxt = rng.dirichlet(np.full(len(words), 0.3), len(words))
    out = []
    for _ in range(40):
        at, text = int(rng.integers(7)), []
        for _ in range(int(rng.integers(3, 14))):
            text.append(words[at])
            at = int(rng.choice(7, p=nxt[at]))
        out.append(" ".join(text))
    return out


def one_by_one(texts, asked, sweeps, burn_in):
    """Mean probabilities by a sampler that takes out and seats single customers."""
    rng = np.random.default_rng(2)
    toks = [["", *t.lower().split(), "\n"] for t in texts]
    pairs = [(u, w) for t in toks for u, w in zip(t, t[1:], strict=False)]
    v = len({w for _, w in pairs})
    rest: dict = {}  # (context or None, word) -> sizes of its tables

    def total(u):
        sizes = [x for (c, _), x in rest.items() if c == u]
        return sum(map(sum, sizes)), sum(map(len, sizes))

    def prob(u, w):
        d, a = (D_UP, A_UP) if u is None else (D, A)
        c, t = total(u)
        own = rest.get((u, w), [])
        up = 1 / (v + 1) if u is None else prob(None, w)
        return (max(sum(own) - d * len(own), 0) + (a + d * t) * up) / (a + c)

    def add(u, w):
        d, a = (D_UP, A_UP) if u is None else (D, A)
        own = rest.setdefault((u, w), [])
        up = 1 / (v + 1) if u is None else prob(None, w)
        weight = np.array([*(x - d for x in own), (a + d * total(u)[1]) * up])
        k = int(rng.choice(len(weight), p=weight / weight.sum()))
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            if u is not None:
                add(None, w)

    def remove(u, w):
        own = rest[u, w]
        k = int(rng.choice(len(own), p=np.array(own) / sum(own)))
        own[k] -= 1
        if not own[k]:
            del own[k]
            if u is not None:
                remove(None, w)

    for p in pairs:
        add(*p)
    out = np.zeros(len(asked))
    for k in range(sweeps):
        for p in pairs:
            remove(*p)
            add(*p)
        if k >= burn_in:
            out += [prob(*p) for p in asked]
    return out / (sweeps - burn_in)


@pytest.mark.parametrize("split_tokens", [1_000_000, 20])
def test_scores_equal_those_of_single_seats(spark, monkeypatch, split_tokens):
    """Also with contexts in parts, and texts in several chunks."""
    calls = iter([(D, A)] + [(D_UP, A_UP), (D, A)] * 60)
    monkeypatch.setattr(pitman_yor, "draw_hyperparameters", lambda grid, rng: next(calls))
    texts = corpus()
    asked = ["a b c", "night day é a", "zzz d", ""]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    model = language_model.train(d, 3, 2, burn_in=2, samples=12, split_tokens=split_tokens)
    assert (len(model.split.hashes) > 0) == (split_tokens == 20)
    q = spark.createDataFrame([(k, t) for k, t in enumerate(asked)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score(q, model).collect()}
    toks = [["", *t.split(), "\n"] for t in asked]
    pairs = [p for t in toks for p in zip(t, t[1:], strict=False)]
    p = iter(np.log10(one_by_one(texts, pairs, 60, 10)))
    for k, t in enumerate(toks):
        want = sum(next(p) for _ in t[1:])
        assert got[k] == pytest.approx(want, abs=0.04 * (len(t) - 1))


def test_probabilities_sum_to_one(spark):
    """The parent's, over all words known and one unknown; and a word's after another never exceed what is left."""
    texts = corpus()
    model = language_model.train(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"), 2, 2)
    shards = [language_model.unpacked(r["blob"]) for r in model.words.filter(F.col("kind") == language_model.WORDS).collect()]
    answers = [language_model.WordAnswers(w, (model.samples, 1 / (model.vocabulary + 1))) for w in shards]
    unknown = answers[0].p[:, -1]
    assert sum(a.p[:, :-1].sum(1) for a in answers) + unknown == pytest.approx(np.ones(len(unknown)))


def test_long_texts_and_pieces(spark, monkeypatch):
    """Cutting a text into pieces or chunks changes no count."""
    text = " ".join(f"w{k % 37} Word{k % 11}" for k in range(4000))
    assert b" ".join(language_model.pieces(text, 100)).split() == text.lower().encode().split()
    assert len(list(language_model.pieces(text, 100))) > 50
    rows = [(0, text), (1, None), (2, ""), (3, " \n "), (None, "w1 word1"), (2, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    seen = []
    for chars in (1 << 20, 64):
        monkeypatch.setattr(language_model, "CHUNK_CHARS", chars)
        model = language_model.train(common.tune(spark) and d, 2, 2)
        got = language_model.score(d, model)
        assert got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]
        seen.append((model.trained, model.vocabulary, sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["score"], 9)) for r in got.collect())))
    assert seen[0] == seen[1]
    assert [x[:3] for x in seen[0][2]] == [("0", 8001, 8001), ("1", 1, 1), ("2", 1, 1), ("2", 1, 1), ("3", 1, 1), ("None", 3, 3)]
