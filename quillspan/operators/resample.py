"""Paired bootstrap and permutation over units with counts of two systems.

Draws come from hashes of (iteration, position), so results don't depend on partitioning. A draw joins the unit at its
place; per iteration only sums travel on.

``bootstrap_many`` and ``permutation_many`` are for as many iterations as wanted: units with equal counts are one kind, and
an iteration draws how often each kind is taken (multinomial) or swapped (binomial), which has the same distribution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.ids import f1, h16
from quillspan.operators.audit import positions

BLOCK = 100  # iterations drawn with one seed
COUNTS = ["gold", "pred_a", "correct_a", "pred_b", "correct_b"]


def numbered(units: DataFrame, order: str) -> DataFrame:
    """Units with k from 0, numbered by ranges of the order."""
    return positions(units, [order]).withColumnRenamed("position", "k")


def _f1s(sums: DataFrame) -> DataFrame:
    a, b = f1("gold", "pred_a", "correct_a", None), f1("gold", "pred_b", "correct_b", None)
    return sums.select("iter", a.alias("f1_a"), b.alias("f1_b"), (b - a).alias("diff"))


def bootstrap(units: DataFrame, order: str, iterations: int, seed: str = "b") -> DataFrame:
    """iter, f1_a, f1_b, diff: pooled F1 of as many units as there are, drawn with replacement."""
    u = numbered(units, order)
    n = u.count()
    draws = units.sparkSession.range(iterations * n).select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("iter"), (F.col("id") % F.lit(max(n, 1))).alias("d"))
    place = h16(F.concat(F.lit(f"{seed}:"), F.col("iter").cast("string"), F.lit(":"), F.col("d").cast("string"))).cast("bigint") * 65536 + h16(F.concat(F.lit(f"{seed}2:"), F.col("iter").cast("string"), F.lit(":"), F.col("d").cast("string")))
    sums = draws.select("iter", (place % F.lit(max(n, 1))).alias("k")).join(u.hint("shuffle_merge"), "k").groupBy("iter").agg(*(F.sum(c).alias(c) for c in COUNTS))  # units never reach the driver
    return _f1s(sums)


def permutation(units: DataFrame, order: str, iterations: int, seed: str = "p") -> DataFrame:
    """iter, diff: pooled F1 difference with the systems swapped in a random half of the units."""
    u = numbered(units, order)
    x = u.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    swap = h16(F.concat(F.lit(f"{seed}:"), F.col("iter").cast("string"), F.lit(":"), F.col("k").cast("string"))) % 2 == 1
    pick = lambda a, b: F.sum(F.when(swap, F.col(b)).otherwise(F.col(a)))
    sums = x.groupBy("iter").agg(F.sum("gold").alias("gold"), pick("pred_a", "pred_b").alias("pred_a"), pick("correct_a", "correct_b").alias("correct_a"), pick("pred_b", "pred_a").alias("pred_b"), pick("correct_b", "correct_a").alias("correct_b"))
    return _f1s(sums).select("iter", "diff")


def _many(units: DataFrame, iterations: int, draw: Callable[[np.ndarray, np.ndarray, int, np.random.Generator], np.ndarray], seed: int) -> DataFrame:
    """The draws' f1s. Kinds of units reach the driver: units are documents' sums of an evaluation set, not corpus rows."""
    rows = sorted(tuple(r) for r in units.groupBy(*COUNTS).agg(F.count("*")).collect())
    kinds, times = np.array([r[:-1] for r in rows], np.int64).reshape(-1, len(COUNTS)), np.array([r[-1] for r in rows], np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block in f["id"]:
                n = min(BLOCK, iterations - block * BLOCK)
                out = pd.DataFrame(draw(kinds, times, n, np.random.default_rng([seed, block])), columns=COUNTS)
                out.insert(0, "iter", np.arange(n) + block * BLOCK)
                yield out

    blocks = -(-iterations // BLOCK)
    sums = units.sparkSession.range(0, blocks, 1, min(blocks, 24)).mapInPandas(run, "iter long, " + ", ".join(f"{c} long" for c in COUNTS))
    return _f1s(sums)


def bootstrap_many(units: DataFrame, iterations: int, seed: int = 11) -> DataFrame:
    """As bootstrap()."""

    def draw(kinds: np.ndarray, times: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        if not len(times):
            return np.zeros((n, len(COUNTS)), np.int64)
        return rng.multinomial(times.sum(), times / times.sum(), n) @ kinds

    return _many(units, iterations, draw, seed)


def permutation_many(units: DataFrame, iterations: int, seed: int = 12) -> DataFrame:
    """As permutation()."""

    def draw(kinds: np.ndarray, times: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        return times @ kinds + rng.binomial(times, 0.5, (n, len(times))) @ (kinds[:, [0, 3, 4, 1, 2]] - kinds)

    return _many(units, iterations, draw, seed).select("iter", "diff")


def interval(samples: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """Percentile interval of 95 %."""
    return samples.agg(F.round(F.percentile(value, F.lit(0.025)), digits).alias("lower"), F.round(F.percentile(value, F.lit(0.975)), digits).alias("upper"))


def p_value(samples: DataFrame, observed: float, value: str = "diff") -> DataFrame:
    """Share of samples at least as extreme, with one added to both numbers."""
    return samples.agg(F.round((F.count_if(F.abs(value) >= abs(observed)) + 1) / (F.count("*") + 1), 5).alias("p"))
