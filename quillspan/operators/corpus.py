"""Corpus operators: inventory, duplicates, segments, chunks, SimHash and near-duplicate clusters."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.digests import md5_first_eight
from quillspan.functions.text import hamming, norm
from quillspan.operators.graph import connected_components
from quillspan.sources.scratch import spread, written


def mark_duplicates(rows: DataFrame, digest: str, ident: str) -> DataFrame:
    """Adds duplicate_of: the first row with the same digest, null for that row itself.

    The first is aggregated before the shuffle and joined back, so a digest with very many rows is no single task.
    """
    first = rows.groupBy(digest).agg(F.min(ident).alias("_first"))
    return rows.join(first, digest).withColumn("duplicate_of", F.when(F.col("_first") != F.col(ident), F.col("_first"))).drop("_first")


def make_segments(parts: DataFrame, by: list[str], order: str, separator: int = 2) -> DataFrame:
    """Parts with segment_id, start and end in the document's text, whose parts are stripped, not empty, and joined by a
    separator of so many characters. parts: by, order, text and whatever else."""
    p = parts.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text <> ''")
    w = Window.partitionBy(*by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + separator).over(before), F.lit(0))
    return p.withColumn("segment_id", F.concat(F.lit("S"), F.row_number().over(w))).withColumn("start", start.cast("int")).withColumn("end", (start + F.length("text")).cast("int"))


def line_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of the texts with their offsets in the original text; empty lines are left out. No shuffle: offsets come
    from the array of lines of one row."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    d = docs.select(id_col, lines.alias("_lines"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("_lines", zero, lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")))["starts"]
    z = d.select(id_col, "_lines", starts.alias("_starts")).select(id_col, F.posexplode(F.arrays_zip("_lines", "_starts")).alias("k", "s"))
    z = z.select(id_col, "k", F.col("s._lines").alias("text"), F.col("s._starts").alias("start"))
    return z.filter("text <> ''").select(id_col, F.concat(F.lit("S"), F.col("k") + 1).alias("segment_id"), "start", (F.col("start") + F.length("text")).alias("end"), "text")


def chunk_numbers(lengths: Column, budget: int) -> Column:
    """For an array of segment lengths, each segment's chunk, from 1: a chunk takes segments while the budget lasts, and
    a segment over the budget has a chunk of its own."""
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(budget + 1).alias("size"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, n: Column) -> Column:
        fits = (a["size"] + n) <= budget
        chunk = F.when(fits, a["chunk"]).otherwise(a["chunk"] + 1)
        size = F.when(fits, a["size"] + n).when(n > budget, F.lit(budget + 1)).otherwise(n)
        return F.struct(chunk.alias("chunk"), size.alias("size"), F.array_append(a["out"], chunk).alias("out"))

    return F.aggregate(lengths, zero, step)["out"]


def representative_positions(count: Column, limit: int) -> Column:
    """Evenly spread positions below count, both ends included; all for a limit of 0 or of count and more."""
    every = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    if limit <= 0:
        return every
    if limit == 1:
        return F.when(count <= 1, every).otherwise(F.array(F.floor(count / 2)))
    d = limit - 1
    spread = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(d).cast("bigint")), lambda k: F.floor((k * (count - 1) + d // 2) / d))
    return F.when(count <= limit, every).otherwise(spread)


def _digest(kind: str):
    if kind == "md5":  # of the first eight bytes, four for the upper bits and four for the lower ones
        return lambda x: hashlib.md5(x).digest()[:8]  # noqa: S324
    return lambda x: hashlib.blake2b(x, digest_size=8).digest()


def _digests(kind: str, keys: np.ndarray) -> np.ndarray:
    """Eight bytes for each row of bytes."""
    if kind == "md5" and keys.shape[1] < 56:
        return md5_first_eight(keys)
    return np.frombuffer(b"".join(map(_digest(kind), map(bytes, keys))), np.uint8).reshape(-1, 8)


_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NO_SPACES = re.compile("[\x1c-\x1f]")  # that split() takes for white space


def _normal(t: str) -> str:
    """What functions.text.norm() makes of a text."""
    t = _SPACES.sub(" ", t).strip(" ") if _NO_SPACES.search(t) else " ".join(t.split())
    return t.casefold()


def _shingles(t: str, size: int, step: int, cap: int) -> list[str]:
    """What functions.text.shingle_array() makes of a normal form."""
    out = list({t[i : i + size] for i in range(0, max(len(t) - size + 1, 1), step)})
    if len(out) > cap:
        every = max(len(out) // cap, 1)
        out = sorted(out)[::every][:cap]
    return out


def _plain_print(t: str, kind: str, size: int, step: int, cap: int) -> int:
    v = np.frombuffer(b"".join([_digest(kind)(x.encode()) for x in _shingles(t, size, step, cap)]), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(v, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(v)).tobytes(), "big", signed=True)


def _ramps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... below each count, one after another, and the place of the count that each is of."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts), of


def _utf8(letters: np.ndarray, known: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of letters (numbers in known) as rows of bytes, by their number of bytes: places and bytes."""
    coded = [c.encode() for c in known]
    width = np.array([len(c) for c in coded])
    table = np.frombuffer(b"".join(c.ljust(4, b"\0") for c in coded), np.uint8).reshape(-1, 4)
    total = width[letters].sum(axis=1)
    for n in np.unique(total).tolist():
        rows = np.flatnonzero(total == n)
        if n == letters.shape[1]:
            yield rows, table[letters[rows], 0]
            continue
        out, at = np.empty((len(rows), n), np.uint8), np.zeros(len(rows), np.int64)
        for own in letters[rows].T:
            for j in range(4):
                has = np.flatnonzero(width[own] > j)
                out[has, at[has] + j] = table[own[has], j]
            at += width[own]
        yield rows, out


def _prints(texts: list[str], kind: str, size: int, step: int, cap: int) -> np.ndarray:
    """Fingerprints of normal forms of size letters at least. A shingle is one number: its text's place, then its letters as
    digits; sorted, a text's distinct shingles are in the order of their letters."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    used = np.zeros(int(chars.max()) + 1, np.int64)
    used[chars] = 1
    known = np.flatnonzero(used)
    base = len(known)
    if len(texts) * base**size >= 1 << 63:
        if len(texts) == 1:
            return np.array([_plain_print(texts[0], kind, size, step, cap)], np.int64)
        half = len(texts) // 2
        return np.concatenate([_prints(part, kind, size, step, cap) for part in (texts[:half], texts[half:])])
    used[known] = np.arange(base)
    codes = used[chars]
    lengths = np.array([len(t) for t in texts])
    nth, of = _ramps((lengths - size) // step + 1)
    at = (np.cumsum(lengths) - lengths)[of] + step * nth
    keys = of
    for k in range(size):
        keys = keys * base + codes[at + k]
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    counts = np.diff(np.searchsorted(keys, np.arange(len(texts) + 1) * base**size))
    if counts.max() > cap:
        nth, of = _ramps(counts)
        every = np.maximum(counts // cap, 1)[of]
        keys = keys[(counts[of] <= cap) | (nth % every == 0) & (nth // every < cap)]
        counts = np.diff(np.searchsorted(keys, np.arange(len(texts) + 1) * base**size))
    letters = np.empty((len(keys), size), np.int64)
    for k in reversed(range(size)):
        keys, letters[:, k] = np.divmod(keys, base)
    v = np.empty((len(keys), 8), np.uint8)
    for rows, own in _utf8(letters, list(map(chr, known.tolist()))):
        v[rows] = _digests(kind, own)
    # A byte holds sums of 255 bits: eight sums are added as one number, by parts of so many shingles of one text.
    bits = np.unpackbits(v, axis=1).view(np.uint64)
    nth, of = _ramps(-(-counts // 255))
    parts = np.add.reduceat(bits, (np.cumsum(counts) - counts)[of] + 255 * nth, axis=0).view(np.uint8)
    ones = np.add.reduceat(parts, np.flatnonzero(nth == 0), axis=0, dtype=np.int64)
    return np.packbits(2 * ones >= counts[:, None], axis=1).view(">i8")[:, 0].astype(np.int64)


TEXTS, LETTERS = 512, 1 << 20  # texts, and letters, whose shingles are held at once; a longer text is held alone


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str = "md5", size: int = 5, step: int = 3, cap: int = 20_000) -> DataFrame:
    """id, n_chars, fingerprint (bigint): bit b is set if at least half of the shingles' digests have it. digest: md5, or
    blake2b with 64 bits. A document's shingles never leave its row, so nothing is shuffled; those of many documents are
    hashed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, TEXTS) for whole in batches for k in range(0, whole.num_rows, TEXTS)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = np.zeros(len(texts), np.int64)
            held: dict[int, str] = {}
            n = 0
            for k, t in enumerate(map(_normal, texts)):
                if len(t) < size:
                    prints[k] = _plain_print(t, digest, size, step, cap)
                    continue
                if held and n + len(t) > LETTERS:
                    prints[list(held)] = _prints(list(held.values()), digest, size, step, cap)
                    held, n = {}, 0
                held[k] = t
                n += len(t)
            if held:
                prints[list(held)] = _prints(list(held.values()), digest, size, step, cap)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int32()), pa.array(prints)], names=[id_col, "n_chars", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_chars int, fingerprint bigint")


def simhash_blake2b(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with 64-bit BLAKE2b digests."""
    return simhash(docs, id_col, text_col, "blake2b").drop("n_chars")


def _classes(fingerprints: DataFrame, id_col: str) -> DataFrame:
    """Documents equal in fingerprint and length as one: fingerprint, n_chars, and id, the least of theirs. Written, as
    both sides of a join read them."""
    return written(fingerprints.groupBy("fingerprint", "n_chars").agg(F.min(id_col).alias("id")), "fingerprint-classes")


def _near(classes: DataFrame, max_distance: int = 8, min_length_ratio: float = 0.35) -> DataFrame:
    bands = F.posexplode(F.array(*(F.shiftrightunsigned("fingerprint", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)))).alias("band", "value")
    x = classes.select("id", "fingerprint", "n_chars", bands)
    y = x.select(F.col("id").alias("id2"), F.col("fingerprint").alias("f2"), F.col("n_chars").alias("n2"), "band", "value")
    near = x.join(y, ["band", "value"]).filter("id < id2").withColumn("distance", hamming("fingerprint", "f2"))
    ok = (F.col("distance") <= max_distance) & (F.least("n_chars", "n2") >= min_length_ratio * F.greatest("n_chars", "n2"))
    return near.filter(ok).select(F.col("id").alias("a"), F.col("id2").alias("b"), "distance").distinct()


def simhash_pairs(fingerprints: DataFrame, id_col: str = "doc_id", max_distance: int = 8, min_length_ratio: float = 0.35) -> DataFrame:
    """a < b, distance: pairs that share one of four 16-bit bands, are near in length and in fingerprint.

    Documents equal in fingerprint and length are one class, represented by the least id, so copies make no pairs among
    themselves; near classes are joined on (band, value).
    """
    return _near(_classes(fingerprints, id_col), max_distance, min_length_ratio)


def near_clusters(fingerprints: DataFrame, id_col: str = "doc_id", **limits) -> DataFrame:
    """id and cluster, the least id of it, for every document. Fingerprints are made once and written, as are their
    classes."""
    prints = written(fingerprints.select(id_col, "fingerprint", "n_chars"), "fingerprints")
    classes = _classes(prints, id_col)
    comp = connected_components(_near(classes, **limits).select("a", "b"))
    named = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("fingerprint", "n_chars", F.coalesce("component", "id").alias("cluster"))
    return prints.join(named, ["fingerprint", "n_chars"]).select(id_col, "cluster")


def normalized_digest(text: Column | str) -> Column:
    return F.sha2(norm(text), 256)


def overlap_quarantine(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text") -> DataFrame:
    """Rows of left whose normalized text right has too, with the sorted ids there. Texts are joined by digest, which is
    never null: else Spark would compute it once more to leave nulls out of the join."""
    digest = F.coalesce(normalized_digest(text), F.lit(""))
    left, right = (d.filter(F.col(text).isNotNull()) for d in (left, right))
    r = right.select(digest.alias("_h"), F.col(right_id).alias("_r")).groupBy("_h").agg(F.array_sort(F.collect_set("_r")).alias("matches"))
    return left.withColumn("_h", digest).join(r, "_h").drop("_h").select(left_id, "matches")
