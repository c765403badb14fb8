import itertools

import numpy as np
import pytest

import __spark_entry__ as entry
from quillspan.operators import resample
from quillspan.plans import queries

UNITS = [(5, 4, 3, 5, 4), (3, 3, 1, 2, 2), (6, 5, 3, 6, 5), (2, 2, 1, 2, 2), (5, 4, 3, 5, 4), (4, 5, 2, 4, 3), (7, 6, 4, 7, 6), (3, 2, 1, 3, 3), (4, 4, 2, 4, 4), (6, 6, 3, 5, 5)]


def diff(x):
    g, pa, xa, pb, xb = x.T
    return 2 * xb / (g + pb) - 2 * xa / (g + pa)


@pytest.fixture
def units(spark):
    return spark.createDataFrame([(f"d{k}", *u) for k, u in enumerate(UNITS)], "doc_id string, " + ", ".join(f"{c} long" for c in resample.COUNTS))


def test_many_draws_equal_brute_force(units):
    u = np.array(UNITS)
    got = [r["diff"] for r in resample.bootstrap_many(units, 20_000).collect()]
    want = diff(u[np.random.default_rng(1).integers(0, len(u), (20_000, len(u)))].sum(1))
    assert len(got) == 20_000
    assert np.quantile(got, [0.025, 0.5, 0.975]) == pytest.approx(np.quantile(want, [0.025, 0.5, 0.975]), abs=0.005)
    every = diff(np.array([[v[[0, 3, 4, 1, 2]] if s else v for v, s in zip(u, swap, strict=True)] for swap in itertools.product([0, 1], repeat=len(u))]).sum(1))
    observed = diff(u.sum(0)[None])[0]
    p = resample.p_value(resample.permutation_many(units, 20_000), observed - 1e-9).first()["p"]
    assert p == pytest.approx((np.abs(every) >= observed - 1e-9).mean(), abs=0.002)
    assert p < 1 / 51


def test_many_draws_of_nothing(units):
    assert [r["diff"] for r in resample.bootstrap_many(units.limit(0), 150).collect()] == [0] * 150
    assert [r["diff"] for r in resample.permutation_many(units.limit(0), 150).collect()] == [0] * 150


def test_full_queries(spark):
    assert queries.ITERATIONS == 20_000
    ci, p = (entry.queries()[n](spark, "/root/testdata/sf0.001").first() for n in ("bootstrap_ci_full", "permutation_p_full"))
    assert ci["lower"] <= ci["upper"] and 1 / 20_001 - 1e-5 <= p["p"] <= 1
