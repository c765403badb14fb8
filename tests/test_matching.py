"""Matching, the CRF and the allocator against plain versions."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

import __spark_entry__ as entry
from quillspan.operators import decode, relaxed, splitting

SF = "/root/testdata/sf0.001"
PAIRS = dict(["[]", "()", "《》"])


def kuhn(n, edges):
    owner = {}

    def place(u, seen):
        for v in edges[u]:
            if v not in seen:
                seen.add(v)
                if v not in owner or place(owner[v], seen):
                    owner[v] = u
                    return True
        return False

    return sum(place(u, set()) for u in range(n))


def test_most_matches():
    rng = random.Random(1)
    for _ in range(500):
        a, b = rng.randrange(9), rng.randrange(9)
        edges = [[v for v in range(b) if rng.random() < 0.3] for _ in range(a)]
        assert relaxed.most_matches(a, b, edges) == kuhn(a, edges)
    n = 20_000  # a path through all nodes: no recursion
    assert relaxed.most_matches(n, n, [[k + 1, k] if k + 1 < n else [k] for k in range(n)]) == n


def test_near_names():
    rng = random.Random(2)
    names = lambda: ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 5, 9, 60, 70]))) for _ in range(40)]
    for _ in range(20):
        left, right = names(), names()
        got = relaxed.near_names(left, right)
        assert {k: sorted(v) for k, v in got.items()} == {a: sorted({b for b in right if relaxed.overlaps(a, b)}) for a in left}


def strip(x):
    while len(x) >= 2 and PAIRS.get(x[0]) == x[-1]:
        x = x[1:-1].strip()
    return x


def matches(p, g, mode):
    (a, s), (b, t) = p, g
    if not a or not b:
        return False
    if mode == "strict":
        return a == b and s == t
    if mode == "text":
        return a == b
    if mode == "outer_markup":
        return strip(a) == strip(b) and s == t
    return relaxed.overlaps(a, b) and (mode == "boundary_text" or s == t)


@pytest.mark.parametrize("mode", relaxed.MODES)
def test_modes(spark, mode):
    rng = random.Random(3)
    texts = ["rail", "(rail)", "Rail  car", "[rail car]", "car", "《(car)》", "a", None, " ", "railway"]
    make = lambda: [(d, rng.choice(texts), rng.choice(["A", "B"])) for d in range(8) for _ in range(rng.randrange(9))]
    gold, predicted = make(), make()
    frame = lambda rows: spark.createDataFrame(rows, "d int, text string, type string")
    got = {r["d"]: tuple(r)[1:] for r in relaxed.entity_matches(frame(gold), frame(predicted), ["d"], mode).collect()}
    norm = lambda x: " ".join((x or "").split()).casefold()
    for d in {r[0] for r in gold + predicted}:
        sides = []
        for rows in (gold, predicted):
            items = [(norm(t), k) for dd, t, k in rows if dd == d]
            sides.append(list({t: (t, k) for t, k in items}.values()) if mode in ("text", "boundary_text") else list(dict.fromkeys(items)))
        edges = [[j for j, g in enumerate(sides[0]) if matches(p, g, mode)] for p in sides[1]]
        assert got[d] == (len(sides[0]), len(sides[1]), kuhn(len(sides[1]), edges))
    rel = lambda: [(d, rng.choice("xy"), rng.choice(texts), rng.choice("AB"), rng.choice(texts), rng.choice("AB")) for d in range(8) for _ in range(rng.randrange(7))]
    gold, predicted = rel(), rel()
    frame = lambda rows: spark.createDataFrame(rows, "d int, type string, source_text string, source_type string, target_text string, target_type string")
    got = {r["d"]: tuple(r)[1:] for r in relaxed.relation_matches(frame(gold), frame(predicted), ["d"], mode).collect()}
    for d in {r[0] for r in gold + predicted}:
        g, p = ([(k, (norm(a), s), (norm(b), t)) for dd, k, a, s, b, t in rows if dd == d] for rows in (gold, predicted))
        edges = [[j for j, y in enumerate(g) if x[0] == y[0] and matches(x[1], y[1], mode) and matches(x[2], y[2], mode)] for x in p]
        assert got[d] == (len(g), len(p), kuhn(len(p), edges))


def test_boundary_queries(spark):
    from quillspan.plans import fixtures as fx
    from quillspan.plans import matching

    m = fx.mentions(spark, SF)
    sides = []
    for w in ("gold", "v2"):
        per = {}
        for r in matching._entities(m, w).select("doc_id", "text", "type").collect():
            per.setdefault(r["doc_id"], {})[" ".join(r["text"].split()).casefold(), r["type"]] = 1
        sides.append(per)
    for r in entry.queries()["boundary_match"](spark, SF).collect():
        g, p = (list(s.get(r["doc_id"], {})) for s in sides)
        assert (r["gold"], r["predicted"]) == (len(g), len(p))
        assert r["matched"] == kuhn(len(p), [[j for j, y in enumerate(g) if matches(x, y, "boundary_type")] for x in p])
    text = entry.queries()["boundary_relations"](spark, SF).collect()
    strict = {r["doc_id"]: r["matched"] for r in entry.queries()["relaxed_relations"](spark, SF).filter("mode = 'text'").collect()}
    assert text and all(r["matched"] >= strict[r["doc_id"]] and r["matched"] <= min(r["gold"], r["predicted"]) for r in text)


def test_crf(spark):
    rng = np.random.default_rng(4)
    crf = decode.Crf(rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
    rows, want = [], {}
    for k in range(30):
        n = int(rng.integers(0, 6))
        e, y = rng.normal(size=(n, 3)), rng.integers(0, 3, n)
        rows.append((k, e.tolist(), y.tolist()))
        if n:
            value = lambda p: crf.start[p[0]] + crf.end[p[-1]] + sum(e[t, p[t]] for t in range(n)) + sum(crf.transitions[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            scores = {p: value(p) for p in product(range(3), repeat=n)}
            best = max(scores, key=scores.get)
            z = float(np.log(np.exp(list(scores.values())).sum()))
            want[k] = (list(best), scores[best], z, scores[tuple(y.tolist())], z - scores[tuple(y.tolist())])
        else:
            want[k] = ([], 0.0, 0.0, 0.0, 0.0)
    rows.append((99, None, None))
    want[99] = ([], 0.0, 0.0, 0.0, 0.0)
    df = spark.createDataFrame(rows, "k int, e array<array<double>>, y array<int>")
    for r in decode.crf_sequences(df, "e", "y", crf).collect():
        assert r["path"] == want[r["k"]][0]
        assert list(r)[2:] == pytest.approx(list(want[r["k"]][1:]))


def test_allocator(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice("ab"), rng.choice("xyz")) for c in range(300) for _ in range(rng.choice([1, 1, 1, 2, 5]))]
    targets = {"train": 400, "validation": 130, "test": 120}
    got = splitting.allocate_clusters(spark.createDataFrame(rows, "cluster int, source string, lang string"), targets, ["source", "lang"])
    split = {r["cluster"]: r["split"] for r in got.collect()}
    assert got.count() == len(split) == 300
    size = Counter(split[c] for c, *_ in rows)
    assert all(size[s] <= n for s, n in targets.items())
    for k in (1, 2):  # every kind is spread in proportion
        kinds = Counter((r[k], split[r[0]]) for r in rows)
        totals = Counter(r[k] for r in rows)
        assert all(abs(kinds[v, s] / totals[v] - size[s] / len(rows)) < 0.1 for v in totals for s in targets)
    hot = spark.range(30_000).selectExpr("id as cluster", "'a' as source", "'x' as lang")
    counts = {r["split"]: r["n"] for r in splitting.allocate_clusters(hot, {"train": 20_000, "test": 10_000}, ["source", "lang"]).groupBy("split").agg(splitting.F.count("*").alias("n")).collect()}
    assert counts == {"train": 20_000, "test": 10_000}
    with pytest.raises(Exception, match="no split"):
        splitting.allocate_clusters(hot, {"train": 20_000, "test": 9_000}, ["source", "lang"]).count()
    made = {r["cluster"]: r["split"] for r in entry.queries()["split_allocator"](spark, SF).collect()}
    clusters = {r["doc_id"]: r["cluster"] for r in entry.queries()["near_dup_clusters"](spark, SF).collect()}
    assert set(made) == set(clusters.values())
