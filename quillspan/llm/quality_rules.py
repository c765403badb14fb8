"""Quality rules with risk-controlled thresholds.

Features are counted from whole texts. Each rule compares one ratio with a cutoff. Per stratum (language) and rule, the
cutoffs of a fixed grid are tested from the most lenient on: a cutoff is admissible if an exact binomial bound shows,
from the labelled good documents of the stratum, that it rejects at most ``alpha / rules`` of good documents. The
sequence stops at the first cutoff that fails (fixed-sequence testing), and ``delta`` is divided by the number of
strata and rules (Bonferroni), so with probability 1 - delta all rules together reject at most alpha of the good
documents in every stratum. Of the admissible cutoffs the most lenient one is taken that catches nearly all bad
documents any of them catches; a rule that catches none is off.

Every language is a stratum. One with so few good documents that no cutoff can be proven, whatever it rejects, has none:
only the base rule rejects there. Cutoffs of the others reach the driver, no more of them than labels by that number.

Defined results: null and empty texts have no words and fail the base rule. A null language is the stratum '*'. Labels
with null quality are ignored; a document labelled more than once counts once per label. With no labels only the base
rule rejects. Input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import ASCII_SPACE, aside, drop_stash, stash, table, texts, widened, with_columns

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
ALPHA, DELTA, GRID = 0.05, 0.05, 40
#: Rule: ratio, step of its grid of cutoffs (step, 2 step, ... GRID steps).
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", 0.0125),
    "shouting": ("n_upper / greatest(word_chars, 1)", 0.025),
    "exclaims": ("n_exclaims / greatest(n_words, 1)", 0.025),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.025),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.025),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")
#: Beyond this many words, repeats are found by ranking windows in arrays rather than in a set of tuples.
ARRAY_WORDS = 100_000
_UPPER = bytes(range(65, 91))
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a window of five words which the list holds twice or more, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) <= ARRAY_WORDS:
        windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(windows)) == n:
            return 0
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        hit = np.fromiter((seen[w] > 1 for w in windows), np.bool_, n)
    else:
        ids: dict[bytes, int] = {}
        first = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        rank = first[:n]
        for i in range(1, WINDOW):  # rank of the first i + 1 words among all such runs
            rank = np.unique(rank * len(ids) + first[i : i + n], return_inverse=True)[1]
        hit = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def features(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, _UPPER)),
        text.count("!"),
    )


def rule_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the columns of FEATURES (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t) for t in texts(b, text_col)], np.int64).reshape(-1, len(FEATURES))
            yield with_columns(b, {k: pa.array(rows[:, i]) for i, k in enumerate(FEATURES)})

    return df.mapInArrow(run, widened(df.schema, {k: T.LongType() for k in FEATURES}))


def base_failed():
    """The fixed part of the rules, over FEATURES."""
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k), X binomial (n, p): the exact p-value of k errors against a risk of p or more."""
    if k >= n:
        return 1.0
    log_c = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    term = math.exp(log_c + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > 1e-18 * max(total, 1e-300):
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p) if i else 0.0
        i -= 1
    return min(1.0, total)


def select_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> int | None:
    """Index of the chosen cutoff, or None. good, bad: documents by level, the number of cutoffs that reject them."""
    n = int(good.sum())
    rejected = lambda by_level, j: int(by_level[j + 1 :].sum())
    admissible = []
    for j in range(len(good) - 2, -1, -1):
        k = rejected(good, j)
        if not n or k > alpha * n or binomial_tail(k, n, alpha) > delta:
            break
        admissible.append(j)
    best = max((rejected(bad, j) for j in admissible), default=0)
    return next((j for j in admissible if best and rejected(bad, j) >= 0.99 * best), None)


def _level(rule: str):
    ratio, step = RULES[rule]
    return F.least(F.lit(GRID), F.greatest(F.lit(0), F.ceil(F.expr(ratio) / F.lit(step)) - 1)).cast("int")


def fit_thresholds(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA, lang_col: str = "lang") -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule. labelled: FEATURES, the language and quality, of all labelled documents.

    Counts over all labelled rows are made by Spark; of strata that can have a cutoff, rules x (GRID + 1) x 2 of them
    reach the driver. Documents that fail the base rule are rejected anyway and take no part.
    """
    held = labelled.filter(F.col("quality").isin(0, 1)).withColumn("_lang", F.coalesce(F.col(lang_col).cast("string"), F.lit("*"))).filter(~base_failed())
    strata = held.groupBy("_lang").agg(F.count_if(F.col("quality") == 1).alias("good"))
    tests = strata.count() * len(RULES)
    least = math.log(delta / max(tests, 1)) / math.log1p(-alpha / len(RULES))  # with fewer, no rejection at all is proof
    names = sorted(r[0] for r in strata.filter(F.col("good") >= least).collect())
    rows = (
        held.filter(F.col("_lang").isin(names))
        .select(F.col("_lang").alias("s"), "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _level(r).alias("level")) for r in RULES))).alias("x"))
        .groupBy("s", "x.rule", "x.level", "quality")
        .count()
        .collect()
    )
    count = {(s, r): np.zeros((2, GRID + 1), np.int64) for s in names for r in RULES}
    for r in rows:
        count[r["s"], r["rule"]][r["quality"], r["level"]] += r["count"]
    out: dict[str, dict[str, float]] = {s: {} for s in names}
    for (s, rule), (bad, good) in count.items():
        j = select_cutoff(good, bad, alpha / len(RULES), delta / tests)
        if j is not None:
            out[s][rule] = RULES[rule][1] * (j + 1)
    return out


def rejected_by(cutoffs: dict[str, dict[str, float]], lang_col: str = "lang"):
    """Column: the rules whose cutoff the document's ratio exceeds, in the order of RULES."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("*"))
    hit = []
    for rule in RULES:
        steps = [(s, round(c[rule] / RULES[rule][1])) for s, c in sorted(cutoffs.items()) if rule in c]
        over = F.lit(False)
        for s, j in steps:
            over = over | ((lang == s) & (_level(rule) >= j))
        hit.append(F.when(over, F.lit(rule)))
    return F.array_compact(F.array(*hit))


def labelled_features(feats: DataFrame, labels: DataFrame) -> DataFrame:
    return feats.join(labels.select("doc_id", "quality"), "doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule features and verdict."""
    feats = stash(rule_features(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"), "rules")
    cutoffs = fit_thresholds(labelled_features(feats, table(spark, sf_dir, "labels")))
    return feats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), rejected_by(cutoffs).alias("rules")).select(
        "*", (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept")
    )


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects; null and empty texts go, since they fail the base rule. Repeated rows are
    judged each. An empty table stays empty. All columns stay as they are, whatever their names."""
    labels = table(spark, sf_dir, "labels")
    feats = stash(rule_features(docs.select("doc_id", "lang", "text")).drop("text"), "rules")
    cutoffs = fit_thresholds(labelled_features(feats, labels))
    drop_stash(feats)
    own, back = aside(docs, ["doc_id", "lang", "text"])
    return back(rule_features(own).filter(~base_failed() & (F.size(rejected_by(cutoffs)) == 0)))
