"""Interaction of corpus filters: what each of five filters removes in every order they can be applied in.

A worker sees a batch's texts as one Arrow buffer. NumPy classifies its bytes by a table, and prefix sums of the classes,
read at the texts' borders, count words, code points, capitals and symbols. A word's hash is a difference of prefix sums
too: bytes' random values times powers of an odd number, divided by the power of the word's place. The buffer is gone
through in blocks of a fixed size, whatever the lengths of texts and words; a word or text that a block's end cuts is
carried on. Distinct words are runs in the hashes sorted by text; neighbours of equal hash are compared byte by byte, and
a text in which they differ is counted by its words themselves.

Each text leaves the scan as a mask of failed filters and a digest. Equal texts are found by aggregation: rows are summed
by digest and stratum with their least id before any shuffle, so a text with many copies is a few rows. Masks with their
counts then say everything about any order: at most 32 rows of counts for each part.

Defined results: a null text is empty; a null part is the empty string; a null id is never a copy of a smaller one, nor
smaller than any; rows of equal id and text are no copies of each other. Labels of a repeated id count if any of its
rows has them. An empty table has no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import table

FILTERS = "ABCDE"
#: Bytes that one step of the scan looks at, and words it holds before it keeps one of each text's equal ones only.
BLOCK, HELD_WORDS = 1 << 20, 1 << 20
_SPACE, _CAPITAL, _SYMBOL, _INNER = 1, 2, 4, 8


def _classes(symbols: bytes) -> np.ndarray:
    """Byte classes: ASCII white space, A-Z, the symbols, continuation bytes of UTF-8."""
    c = np.zeros(256, np.uint8)
    c[[0x20, *range(0x09, 0x0E)]] |= _SPACE
    c[ord("A") : ord("Z") + 1] |= _CAPITAL
    c[list(symbols)] |= _SYMBOL
    c[0x80:0xC0] |= _INNER
    return c


class _Powers:
    """Random values of the 256 bytes, and powers of an odd number and of its inverse modulo 2^64, for one block."""

    STEP = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.values = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
        grow = lambda p: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK, p, np.uint64))])
        self.up, self.down = grow(self.STEP), grow(pow(self.STEP, -1, 1 << 64))


_POWERS: list[_Powers] = []


class TextScan:
    """Counts of the texts of one Arrow string column: n_words, n_chars, n_capitals, n_symbols, n_distinct."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, symbols: bytes = b"#$%&*|") -> None:
        if not _POWERS:
            _POWERS.append(_Powers())
        self.data, self.offsets, self.classes, self.powers = data, offsets, _classes(symbols), _POWERS[0]
        n = len(offsets) - 1
        self.n_words, self.n_chars, self.n_capitals, self.n_symbols = (np.zeros(n, np.int64) for _ in range(4))
        self._held: list[tuple[np.ndarray, ...]] = []
        self._n_held = 0
        self._unsure: set[int] = set()
        self._open: tuple[int, int, int] | None = None  # start, end and hash so far of a word that may go on in the next block
        for a in range(int(offsets[0]), int(offsets[-1]), BLOCK):
            self._block(a, min(a + BLOCK, int(offsets[-1])))
            if self._n_held > HELD_WORDS:
                self._fold()
        self._fold()
        self.n_distinct = np.bincount(self._held[0][0], minlength=n).astype(np.int64) if self._held else np.zeros(n, np.int64)
        for i in self._unsure:
            self.n_distinct[i] = len(set(data[offsets[i] : offsets[i + 1]].tobytes().split()))

    def _block(self, a: int, b: int) -> None:
        data, offsets, pw = self.data, self.offsets, self.powers
        x = data[a:b]
        c = self.classes[x]
        word = (c & _SPACE) == 0
        first, end = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        cuts = np.clip(offsets[first : end + 1], a, b) - a
        born = np.unique(cuts[(offsets[first : end + 1] >= a) & (cuts < b - a)])  # places where a text begins
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[born] = word[born]
        goes_on = a > 0 and word[0] and self._open is not None and not (len(born) and born[0] == 0)
        begins[0] = word[0] and not goes_on
        for out, mask in ((self.n_words, begins), (self.n_chars, (c & _INNER) == 0), (self.n_capitals, (c & _CAPITAL) > 0), (self.n_symbols, (c & _SYMBOL) > 0)):
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
            out[first:end] += np.diff(sums[cuts])
        begins[0] = word[0]  # from here on the rest of a cut word is a piece of its own
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        stops[born[born > 0] - 1] = word[born[born > 0] - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if not len(s):
            self._close()
            return
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(pw.values[x] * pw.up[: b - a])])
        h = (sums[e] - sums[s]) * pw.down[s]
        starts, ends = s + a, e + a
        if goes_on:
            start, _, before = self._open
            h[0] = (before + pow(pw.STEP, a - start, 1 << 64) * int(h[0])) & ((1 << 64) - 1)
            starts[0] = start
            self._open = None
        else:
            self._close()
        if e[-1] == b - a and b < offsets[-1] and offsets[end] > b:  # the text goes on, and maybe this word
            self._open = int(starts[-1]), int(ends[-1]), int(h[-1])
            starts, ends, h = starts[:-1], ends[:-1], h[:-1]
        self._hold(starts, ends, h)

    def _close(self) -> None:
        """The word that the last block cut ended right there."""
        if self._open is not None:
            start, end, h = self._open
            self._open = None
            self._hold(np.array([start]), np.array([end]), np.array([h], np.uint64))

    def _hold(self, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        if len(starts):
            doc = np.searchsorted(self.offsets, starts, "right") - 1
            self._held.append((doc, starts, ends - starts, h))
            self._n_held += len(starts)

    def _fold(self) -> None:
        """Keep one of each text's words of equal hash, once neighbours were compared."""
        if not self._held:
            return
        doc, start, length, h = (np.concatenate(x) for x in zip(*self._held, strict=True))
        order = np.lexsort((h, doc))
        doc, start, length, h = doc[order], start[order], length[order], h[order]
        same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1])) + 1
        unlike = length[same] != length[same - 1]
        self._unsure.update(doc[same[unlike]].tolist())
        self._verify(doc, start, length, same[~unlike])
        keep = np.ones(len(doc), bool)
        keep[same] = False
        self._held = [(doc[keep], start[keep], length[keep], h[keep])]
        self._n_held = int(keep.sum())

    def _verify(self, doc: np.ndarray, start: np.ndarray, length: np.ndarray, same: np.ndarray) -> None:
        """Compare words with the one before, some BLOCK bytes at a time, a long word by itself."""
        upto = np.cumsum(length[same])
        at = 0
        while at < len(same):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
            k = same[at:to]
            if len(k) == 1:
                n, i, j = int(length[k[0]]), int(start[k[0]]), int(start[k[0] - 1])
                if not np.array_equal(self.data[i : i + n], self.data[j : j + n]):
                    self._unsure.add(int(doc[k[0]]))
            else:
                n = length[k]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                differs = self.data[np.repeat(start[k], n) + inner] != self.data[np.repeat(start[k - 1], n) + inner]
                if differs.any():
                    self._unsure.update(np.repeat(doc[k], n)[differs].tolist())
            at = to


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its texts' borders in them; null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The kept columns with n_words, n_distinct, n_chars, n_capitals, n_symbols (of #$%&*|) and the text's sha256."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffers(b.column(text))
            s = TextScan(data, offsets)
            digest = [hashlib.sha256(data[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counts = [pa.array(x) for x in (s.n_words, s.n_distinct, s.n_chars, s.n_capitals, s.n_symbols)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *counts, pa.array(digest, pa.binary())], names=[*keep, "n_words", "n_distinct", "n_chars", "n_capitals", "n_symbols", "digest"])

    return docs.select(*keep, text).mapInArrow(run, f"{schema}, n_words long, n_distinct long, n_chars long, n_capitals long, n_symbols long, digest binary")


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask (bit k: the k-th of FILTERS fails), good, toxic, n: how many documents there are of each kind."""
    fails = [F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words"), 100 * F.col("n_capitals") > 10 * F.col("n_chars"), F.col("n_symbols") > 0]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    texts = scan(docs, keep=("doc_id", part)).select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), "digest")
    marked = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = marked.select("doc_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    rows = texts.join(marked, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("copies"))
    by_text = by_id.groupBy(*kind, F.col("doc_id").isNull().alias("nameless")).agg(F.sum("copies").alias("n"), F.min("doc_id").alias("low"), F.min_by("copies", "doc_id").alias("n_low"))
    least = F.min("low").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("nameless"), F.col("n")).when(F.col("low") == least, F.col("n_low")).otherwise(0)
    split = by_text.withColumn("firsts", firsts).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("m"))
    return split.groupBy("part", "m.mask", "good", "toxic").agg(F.sum("m.n").alias("n")).filter("n > 0")


def orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of the filters; for each order and step the filter's bit, and the bits of those before it."""
    names = ["".join(p) for p in permutations(FILTERS)]
    bit = np.array([[1 << FILTERS.index(f) for f in p] for p in names])
    return names, bit, np.cumsum(bit, axis=1) - bit


def interactions(counts: DataFrame) -> DataFrame:
    """What masks() returns to one row for each part, order and step; see op11_filter_audit()."""
    kinds = F.array_sort(F.collect_list(F.struct("mask", "good", "toxic", "n")))  # 128 at most
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, bit, before = orders()
        m = np.arange(1 << len(FILTERS))
        met, now = (m & before[..., None]) > 0, (m & bit[..., None]) > 0
        for f in frames:
            for part, kinds_ in f.itertuples(index=False):
                n, good, toxic = (np.zeros(len(m), np.int64) for _ in range(3))
                for k in kinds_:
                    n[k["mask"]] += k["n"]
                    good[k["mask"]] += k["n"] * bool(k["good"])
                    toxic[k["mask"]] += k["n"] * bool(k["toxic"])
                removed = (~met & now) @ n
                shapley = {b: int(removed[bit == b].sum()) for b in np.unique(bit)}
                values = [(~met & ~now) @ n, removed, (met & now) @ n, n[bit], (~met & now) @ good, (~met & now) @ toxic, np.vectorize(shapley.get)(bit)]
                steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names))
                yield pd.DataFrame({"part": part, "filter_order": np.repeat(names, len(FILTERS)), "step": steps, **{c: v.reshape(-1) for c, v in zip(_COUNTS, values, strict=True)}})

    return counts.groupBy("part").agg(kinds.alias("kinds")).mapInPandas(run, schema)


_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part (language), order of the filters A to E and step: documents kept after it, removed by it, failing it
    but removed before, failing it alone, good and toxic ones removed by it, and its removals over all orders."""
    return interactions(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
   coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
c AS MATERIALIZED (SELECT part, list_sum([CASE WHEN fails[k] THEN 1 << (k - 1) ELSE 0 END for k in [1, 2, 3, 4, 5]])::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f GROUP BY ALL),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c2.x || d2.x || e.x AS filter_order FROM a, a b, a c2, a d2, a e WHERE a.x <> b.x AND c2.x NOT IN (a.x, b.x) AND d2.x NOT IN (a.x, b.x, c2.x) AND e.x NOT IN (a.x, b.x, c2.x, d2.x)),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
  list_sum([1 << (ascii(substr(filter_order, k, 1)) - 65) for k in range(1, step)]) AS before FROM p, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE mask & (bit | coalesce(before, 0)::INT) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & coalesce(before, 0)::INT > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER (WHERE mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""
}
