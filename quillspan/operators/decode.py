"""BIO labels to entities, native and by constrained Viterbi."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bio_label(offset_start, offset_end, spans):
    """Label of a token for an array of spans (start, end, type): B- at a span's start, I- inside, else O."""
    hit = F.filter(spans, lambda s: (offset_start >= s["start"]) & (offset_end <= s["end"]))
    first = F.get(hit, F.lit(0))
    return F.when(F.size(hit) == 0, F.lit("O")).otherwise(F.concat(F.when(offset_start == first["start"], F.lit("B-")).otherwise(F.lit("I-")), first["type"]))


def repair_bio(tokens: DataFrame, by: list[str], order: str, label: str = "label") -> DataFrame:
    """Adds repaired: an I- label that no label of its type precedes becomes B-. A repaired label counts as one of its type."""
    kind = F.substring(label, 3, 1000)
    before = F.lag(label).over(Window.partitionBy(*by).orderBy(order))
    alone = F.col(label).startswith("I-") & ~F.coalesce(F.substring(before, 3, 1000) == kind, F.lit(False))
    return tokens.withColumn("repaired", F.when(alone, F.concat(F.lit("B-"), kind)).otherwise(F.col(label)))


def decode_bio(tokens: DataFrame, by: list[str], order: str, label: str = "label", gap: int = 1) -> DataFrame:
    """Entities (by, type, start, end, score) of labelled tokens with start, end and score: runs of one type that no B-
    and no gap interrupts; an I- label after another type begins a run. The score is the least of the run's."""
    w = Window.partitionBy(*by).orderBy(order)
    t = tokens.filter("end > start").withColumn("_type", F.when(F.col(label) != "O", F.substring(label, 3, 1000)))
    begins = F.col("_type").isNotNull() & (F.col(label).startswith("B-") | ~F.coalesce(F.lag("_type").over(w) == F.col("_type"), F.lit(False)) | (F.col("start") > F.lag("end").over(w) + gap))
    t = t.withColumn("_run", F.sum(begins.cast("int")).over(w)).filter("_type IS NOT NULL")
    return t.groupBy(*by, "_run").agg(F.first("_type").alias("type"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score")).drop("_run")


def viterbi(logits: np.ndarray, labels: list[str]) -> list[str]:
    """Best path in which an I- label follows a label of its type only, and none begins with I-."""
    x = logits - logits.max(1, keepdims=True)
    x = x - np.log(np.exp(x).sum(1, keepdims=True))
    no = -1e30
    allowed = np.array([[no if b.startswith("I-") and a[2:] != b[2:] else 0.0 for b in labels] for a in labels])
    score = x[0] + np.array([no if b.startswith("I-") else 0.0 for b in labels])
    back = []
    for row in x[1:]:
        step = score[:, None] + allowed
        back.append(step.argmax(0))
        score = step.max(0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [labels[i] for i in reversed(path)]


def padded(sequences: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of rows of this width as one array (sequence, place, label), zeros behind their ends; and their lengths."""
    n = np.array([len(s) for s in sequences], int)
    out = np.zeros((len(sequences), max(1, n.max(initial=0)), width))
    for k, s in enumerate(sequences):
        if len(s):
            out[k, : len(s)] = np.stack(s)
    return out, n


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Crf:
    """A linear-chain CRF: scores of transitions (from, to), of starts and of ends. Sequences of any lengths go through it
    together, place by place; a sequence that has ended keeps its values. An empty one has path () and all values 0."""

    def __init__(self, transitions: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.transitions, self.start, self.end = (np.asarray(x, float) for x in (transitions, start, end))

    def partition(self, emissions: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log of the sum over all paths of exp(score)."""
        alpha = self.start + emissions[:, 0]
        for t in range(1, emissions.shape[1]):
            after = _logsum(alpha[:, :, None] + self.transitions, 1) + emissions[:, t]
            alpha = np.where((t < n)[:, None], after, alpha)
        return np.where(n > 0, _logsum(alpha + self.end, 1), 0.0)

    def score(self, emissions: np.ndarray, n: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Score of the given paths; what stands behind a sequence's end isn't looked at."""
        rows, at = np.arange(len(n))[:, None], np.arange(emissions.shape[1])[None]
        inside = at < n[:, None]
        y = np.where(inside, labels, 0)
        total = (emissions[rows, at, y] * inside).sum(1) + (self.transitions[y[:, :-1], y[:, 1:]] * inside[:, 1:]).sum(1)
        return np.where(n > 0, total + self.start[y[:, 0]] + self.end[y[np.arange(len(n)), np.maximum(n - 1, 0)]], 0.0)

    def decode(self, emissions: np.ndarray, n: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
        """Best paths, of equal ones that with the least labels from the end, and their scores."""
        best, back = self.start + emissions[:, 0], []
        for t in range(1, emissions.shape[1]):
            step = best[:, :, None] + self.transitions
            back.append(step.argmax(1))
            best = np.where((t < n)[:, None], step.max(1) + emissions[:, t], best)
        last = best + self.end
        at, paths = last.argmax(1), np.zeros((len(n), emissions.shape[1]), int)
        for t in range(emissions.shape[1] - 1, -1, -1):
            paths[:, t] = at
            if t:
                at = np.where(t < n, back[t - 1][np.arange(len(n)), at], at)
        return [p[:k].tolist() for p, k in zip(paths, n.tolist(), strict=True)], np.where(n > 0, last.max(1), 0.0)


def crf_sequences(rows: DataFrame, emissions: str, labels: str, crf: Crf) -> DataFrame:
    """rows' other columns with path (array of labels' numbers), best (its score), log_partition, gold_score of the given
    labels and nll, their negative log probability. rows: one sequence each, emissions an array of arrays. Batches of
    sequences go through the model together."""
    kept = [c for c in rows.columns if c not in (emissions, labels)]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x, n = padded([[] if e is None else list(e) for e in f[emissions]], len(crf.start))
            y = np.zeros(x.shape[:2], int)
            for k, given in enumerate(f[labels]):
                if given is not None and len(given):
                    y[k, : len(given)] = given
            z, gold = crf.partition(x, n), crf.score(x, n, y)
            paths, best = crf.decode(x, n)
            yield f[kept].assign(path=paths, best=best, log_partition=z, gold_score=gold, nll=z - gold)

    return rows.select(*kept, emissions, labels).mapInPandas(run, f"{fields}, path array<int>, best double, log_partition double, gold_score double, nll double")


def _viterbi_paths(x: np.ndarray, n: np.ndarray, labels: list[str]) -> np.ndarray:
    """viterbi() of many sequences of at least one row (sequence, place, label), place by place; what stands behind a
    sequence's end has no meaning."""
    x = x - x.max(2, keepdims=True)
    x = x - np.log(np.exp(x).sum(2, keepdims=True))
    no = -1e30
    allowed = np.array([[no if b.startswith("I-") and a[2:] != b[2:] else 0.0 for b in labels] for a in labels])
    score, back = x[:, 0] + np.array([no if b.startswith("I-") else 0.0 for b in labels]), []
    for t in range(1, x.shape[1]):
        step = score[:, :, None] + allowed
        back.append(step.argmax(1))
        score = np.where((t < n)[:, None], step.max(1) + x[:, t], score)
    at, paths, every = score.argmax(1), np.zeros(x.shape[:2], int), np.arange(len(n))
    for t in range(x.shape[1] - 1, -1, -1):
        paths[:, t] = at
        if t:
            at = np.where(t < n, back[t - 1][every, at], at)
    return paths


def viterbi_tokens(tokens: DataFrame, by: list[str], order: str, logits: str, labels: list[str]) -> DataFrame:
    """by, order, label: the best path of each sequence. A sequence is one row, and many of like lengths are decoded together."""
    fields = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in by)
    kind = tokens.schema[order].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.iloc[np.argsort([len(v) for v in f["_x"]], kind="stable")]
            for k in range(0, len(f), 512):
                part = f.iloc[k : k + 512]
                x, n = padded([list(v) for v in part["_x"]], len(labels))
                paths = _viterbi_paths(x, n, labels)
                yield part[[*by, "_o"]].assign(label=[[labels[i] for i in p[:m]] for p, m in zip(paths.tolist(), n.tolist(), strict=True)])

    whole = tokens.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(logits).cast("array<double>").alias("x")))).alias("_s"))
    rows = whole.select(*by, F.transform("_s", lambda s: s["o"]).alias("_o"), F.transform("_s", lambda s: s["x"]).alias("_x"))
    got = rows.mapInPandas(run, f"{fields}, `_o` array<{kind}>, label array<string>")
    return got.select(*by, F.explode(F.arrays_zip(F.col("_o").alias("o"), F.col("label").alias("l"))).alias("_r")).select(*by, F.col("_r.o").alias(order), F.col("_r.l").alias("label"))
