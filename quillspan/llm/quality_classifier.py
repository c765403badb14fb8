"""Quality classifier: naive Bayes support vectors (NBSVM).

A document's features are indicators of hashed n-grams: its words, and runs of one to three word shapes (letters become
'a' or 'A', digits '0', runs of one class count once). Class log-count ratios of all labelled training documents scale
the indicators; a linear hinge-loss model on them is fitted by dual coordinate descent, on at most ``TRAIN_ROWS``
training documents, those with the smallest hashes of their ids. A quarter of these is left out of the fit, and their
margins calibrate scores between 0 and 1 by a logistic curve.

Defined results: null texts are empty; an empty text has no features and gets the score of the intercept. Labels other
than 0 and 1 are ignored. Without training rows of both classes, every score is the share of label 1, or 0.5 with none.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import aside, crc_mod, drop_stash, stash, table, texts, widened, with_columns

BITS = 16
DIMS = 1 << BITS
#: The hinge-loss model is fitted on at most so many labelled rows.
TRAIN_ROWS = 8192
HELD_OUT_MOD = 5
THRESHOLD = 0.3
EPOCHS, COST, SMOOTH = 12, 0.1, 1.0
_SHAPE = bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256))
_MEMO_WORDS, _MEMO_BYTES = 100_000, 256
_PACK, _UNPACK = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


class Shapes(dict):
    """Shapes of translated words: each run of a class once. Words have few distinct translations; long ones aren't kept."""

    def __missing__(self, word: bytes) -> bytes:
        got = re.sub(rb"(.)\1+", rb"\1", word, flags=re.DOTALL)
        if len(word) <= _MEMO_BYTES:
            if len(self) > _MEMO_WORDS:
                self.clear()
            self[word] = got
        return got


def packed(features: np.ndarray) -> bytes:
    """Sorted distinct numbers below DIMS as differences, low bytes before high ones, compressed: about a byte each."""
    steps = np.diff(features.astype("<u2"), prepend=np.uint16(0)).astype("<u2")
    return _PACK.compress(steps.view(np.uint8).reshape(-1, 2).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(2, -1)
    return np.cumsum(planes[0].astype(np.int64) + (planes[1].astype(np.int64) << 8))


class Featurizer:
    """Texts to their features, packed."""

    def __init__(self) -> None:
        self.shapes = Shapes()
        self.runs: dict[tuple, int] = {}

    def _run(self, run: tuple) -> int:
        if len(self.runs) > _MEMO_WORDS:
            self.runs.clear()
        got = zlib.crc32(b"\0".join((b"shape", *run))) & (DIMS - 1)
        if sum(map(len, run)) <= _MEMO_BYTES:
            self.runs[run] = got
        return got

    def __call__(self, text: str) -> bytes:
        raw = text.encode("utf-8")
        shapes = list(map(self.shapes.__getitem__, raw.translate(_SHAPE).split()))  # white space stays, so words are alike
        runs = {(s,) for s in set(shapes)} | set(zip(shapes, shapes[1:], strict=False)) | set(zip(shapes, shapes[1:], shapes[2:], strict=False))
        found = {zlib.crc32(w) & (DIMS - 1) for w in set(raw.split())}
        known = self.runs
        found.update(known[r] if r in known else self._run(r) for r in runs)
        return packed(np.sort(np.fromiter(found, "<u2", len(found))))


def featurize(df: DataFrame, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """Adds the features as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer()
        for b in batches:
            yield with_columns(b, {out_col: pa.array([f(t) for t in texts(b, text_col)], pa.binary())})

    return df.mapInArrow(run, widened(df.schema, {out_col: T.BinaryType()}))


@dataclass
class Model:
    ratios: np.ndarray  # log-count ratios by feature
    weights: np.ndarray  # fitted weights by feature, times the ratios
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, feats: np.ndarray) -> float:
        """Of a row that is scaled to length 1, as in the fit."""
        length = float(np.sqrt((self.ratios[feats] ** 2).sum()))
        return float(self.weights[feats].sum()) / max(length, 1e-12) + self.bias

    def scores(self, feats: list[bytes]) -> np.ndarray:
        z = np.array([self.slope * self.margin(unpacked(f)) + self.offset for f in feats])
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    p, q = pos + smooth, neg + smooth
    return np.log((p / p.sum()) / (q / q.sum()))


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss with an L2 penalty. Returns the weights of the scaled indicators, by feature, and the bias.

    Rows are scaled to length 1, the intercept is one more feature of value 1. Classes weigh alike.
    """
    w, b, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    norm = np.array([max(np.sqrt((ratios[r] ** 2).sum()), 1e-12) for r in rows])
    per_class = {c: cost * len(rows) / max(2 * int((y == c).sum()), 1) for c in (-1, 1)}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, s = rows[i], y[i]
            x = ratios[r] / norm[i]
            q = float(x @ x) + 1.0
            g = s * (float(w[r] @ x) + b) - 1
            new = min(max(alpha[i] - g / q, 0.0), per_class[s])
            if d := (new - alpha[i]) * s:
                w[r] += d * x
                b += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return w, b


def fit_logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and offset of Platt's curve, by Newton's method on smoothed targets."""
    up, down = int((y == 1).sum()), int((y != 1).sum())
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -35, 35)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.clip(np.linalg.solve(h, g), -5, 5)
        a, c = max(a - step[0], 0.0), c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(c)


def train(feats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """feats: doc_id and features of all documents. Counts cover all training rows; the fit a bounded sample of them."""
    rows = feats.join(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", "quality"), "doc_id").filter(crc_mod("doc_id", HELD_OUT_MOD) != 0).select("doc_id", "features", "quality")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, DIMS + 1), np.int64)  # one more, for the rows of each class
        for b in batches:
            for f, q in zip(b.column("features").to_pylist(), b.column("quality").to_pylist(), strict=True):
                n[q, unpacked(f)] += 1
                n[q, DIMS] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[0, at]), pa.array(n[1, at])], names=["feature", "neg", "pos"])

    total = rows.select("features", F.col("quality").cast("int").alias("quality")).mapInArrow(counts, "feature int, neg long, pos long").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()
    n = np.zeros((2, DIMS + 1))
    n[:, total["feature"].to_numpy(int)] = total[["neg", "pos"]].to_numpy(float).T
    down, up = n[:, DIMS]
    if not down or not up:
        share = up / (up + down) if up + down else 0.5
        return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    h = F.xxhash64("doc_id")
    if up + down > 2 * train_rows:  # all but about twice as many as are wanted go before the sort
        sample = rows.filter(F.pmod(h, F.lit(1 << 30)) < int(2.0 * train_rows / (up + down) * (1 << 30)))
    else:
        sample = rows
    got = sample.orderBy(F.pmod(h, F.lit(1 << 30)), "doc_id", "quality").limit(train_rows).select("features", "quality").collect()
    x = [unpacked(r["features"]) for r in got]
    y = np.array([1 if r["quality"] == 1 else -1 for r in got])
    ratios = log_count_ratios(n[1, :DIMS], n[0, :DIMS])
    kept_out = np.arange(len(x)) % 4 == 3
    w, b = fit_hinge([r for r, k in zip(x, kept_out, strict=True) if not k], y[~kept_out], ratios)
    model = Model(ratios, w * ratios, b)
    if kept_out.any():
        model.slope, model.offset = fit_logistic(np.array([model.margin(r) for r, k in zip(x, kept_out, strict=True) if k]), y[kept_out])
    return model


def score_features(feats: DataFrame, model: Model) -> DataFrame:
    """Adds score, from the features column."""
    shared = feats.sparkSession.sparkContext.broadcast(model)  # two arrays of DIMS doubles: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield with_columns(b, {"score": pa.array(shared.value.scores(b.column("features").to_pylist()), pa.float64())})

    return feats.mapInArrow(run, widened(feats.schema, {"score": T.DoubleType()}))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds score, from the texts, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer()
        for b in batches:
            yield with_columns(b, {"score": pa.array(shared.value.scores([f(t) for t in texts(b, text_col)]), pa.float64())})

    return docs.mapInArrow(run, widened(docs.schema, {"score": T.DoubleType()}))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    feats = stash(featurize(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "features")
    model = train(feats, table(spark, sf_dir, "labels"))
    return score_features(feats, model).select("doc_id", (crc_mod("doc_id", HELD_OUT_MOD) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the threshold; null and empty texts have the score of no features. Repeated
    rows are judged each. An empty table stays empty. All columns stay as they are, whatever their names. Texts aren't
    shuffled: features are made again while filtering."""
    labels = table(spark, sf_dir, "labels")
    feats = stash(featurize(docs.select("doc_id", "text")).drop("text"), "features")
    model = train(feats, labels)
    drop_stash(feats)
    own, back = aside(docs, ["doc_id", "text"])
    return back(score_documents(own, model).filter(F.col("score") >= THRESHOLD))
