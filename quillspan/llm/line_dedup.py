"""Line dedup through sharded minimal perfect hashes.

Every distinct line key that enough documents hold is indexed: keys fall into shards by hash, and each shard has a
minimal perfect hash (levels of bit arrays, each key at the first level where it is alone) that leads into compact
arrays of fingerprints, document counts and largest ids. Documents probe these arrays; lines are never joined.

If all arrays together have at most ``RESIDENT_BYTES`` they are broadcast and documents are probed where they are read.
Beyond, only the keys of at least one in ``HOT_SHARE`` of all held lines are broadcast (no more than HOT_SHARE keys can
be that frequent, so this size is bounded), the probes of all others go to the shard that has them, a small group each,
and the hits return by document. Both ways drop the same lines.

Defined results: null and empty texts are one empty line. A row is a document; rows that share the largest id all keep
the line, and null ids rank lowest. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import ASCII_SPACE, aside, drop_stash, stash, table, texts, widened, with_columns

MIN_CHARS, MIN_DOCS = 40, 5
RESIDENT_BYTES, HOT_SHARE, SHARD_KEYS, SHARD_PROBES = 32 << 20, 10_000, 1 << 16, 500_000
#: Of a key in a worker: 20 in the arrays, the bits of its levels, and the unpacked bits and ranks of about 2.5 slots.
KEY_BYTES = 44
NO_ID = -(1 << 63)
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def line_hash(line: str, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    """Two signed 64-bit halves of the key's hash, or None if the key is shorter than min_chars code points."""
    key = line.strip(ASCII_SPACE)
    if len(key) < min_chars:
        return None
    h = xxhash.xxh3_128_digest(key.encode("utf-8").lower())  # bytes.lower() changes A-Z alone
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1.view(np.uint64) + np.uint64(level + 1) * _GOLD
        x = (x ^ (x >> np.uint64(30))) * _M1 ^ h2.view(np.uint64)
        x = (x ^ (x >> np.uint64(27))) * _M2
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct pairs (h1, h2), with arrays by its numbers: fingerprint h2, count, largest id."""

    LEVELS = 40

    def __init__(self, bits: list[np.ndarray], fingerprint: np.ndarray, count: np.ndarray, largest: np.ndarray) -> None:
        self.bits, self.fingerprint, self.count, self.largest = bits, fingerprint, count, largest
        ones = [np.unpackbits(b) for b in bits]
        base = np.cumsum([0, *(int(o.sum()) for o in ones)])
        self.rank = [np.cumsum(o, dtype=np.int64) - 1 + s for o, s in zip(ones, base[:-1], strict=True)]
        self.set = ones

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, largest: np.ndarray) -> PerfectHash:
        bits: list[np.ndarray] = []
        order: list[np.ndarray] = []
        left = np.arange(len(h1))
        while len(left):
            if len(bits) == cls.LEVELS:
                raise ValueError("two keys have the same 128-bit hash")
            size = -(-max(2 * len(left), 8) // 8) * 8
            slot = _slot(h1[left], h2[left], len(bits), size)
            alone = np.bincount(slot, minlength=size)[slot] == 1
            flags = np.zeros(size, np.uint8)
            flags[slot[alone]] = 1
            bits.append(np.packbits(flags))
            order.append(left[alone][np.argsort(slot[alone])])
            left = left[~alone]
        at = np.concatenate(order) if order else left
        return cls(bits, h2[at], count[at], largest[at])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Numbers of the pairs, -1 for those that the fingerprints don't know."""
        out, left = np.full(len(h1), -1), np.arange(len(h1))
        for level, (flags, rank) in enumerate(zip(self.set, self.rank, strict=True)):
            if not len(left):
                break
            slot = _slot(h1[left], h2[left], level, len(flags))
            here = flags[slot] == 1
            out[left[here]] = rank[slot[here]]
            left = left[~here]
        found = out >= 0
        out[found] = np.where(self.fingerprint[out[found]] == h2[found], out[found], -1)
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.bits), len(self.count), *map(len, self.bits)], "<i8").tobytes()
        return head + b"".join(x.tobytes() for x in (*self.bits, self.fingerprint.astype("<i8"), self.count.astype("<i4"), self.largest.astype("<i8")))

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels, n = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", levels, 16).tolist()
        at, bits = 16 + 8 * levels, []
        for s in sizes:
            bits.append(np.frombuffer(data, np.uint8, s, at))
            at += s
        return cls(bits, np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<i4", n, at + 8 * n), np.frombuffer(data, "<i8", n, at + 12 * n))


class Shards:
    """Perfect hashes by shard number; what a document task probes."""

    def __init__(self, n: int, blobs: dict[int, bytes]) -> None:
        self.n, self.blobs, self.loaded = n, blobs, {}

    def __getstate__(self):
        return self.n, self.blobs

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def dropped(self, pairs: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For rows of (h1, h2) and the ids of their documents: whether the line goes."""
        out = np.zeros(len(pairs), bool)
        if not self.blobs:
            return out
        shard = shard_of(pairs[:, 0], self.n)
        for s in np.unique(shard):
            if (blob := self.blobs.get(int(s))) is None:
                continue
            h = self.loaded.get(int(s)) or self.loaded.setdefault(int(s), PerfectHash.from_bytes(blob))
            at = np.flatnonzero(shard == s)
            k = h.find(np.ascontiguousarray(pairs[at, 0]), np.ascontiguousarray(pairs[at, 1]))
            out[at] = (k >= 0) & (h.largest[k] != ids[at])
        return out


def shard_of(h1: np.ndarray, n: int) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(20)).astype(np.int64) % n


def _lines(batch: pa.RecordBatch, text_col: str, id_col: str, min_chars: int) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines by row; of the long keys: row and line, the hash halves, and the row's id."""
    rows = [t.split("\n") for t in texts(batch, text_col)]
    ids = [NO_ID if i is None else i for i in batch.column(id_col).to_pylist()]
    where, pairs, own = [], [], []
    for r, lines in enumerate(rows):
        for k, line in enumerate(lines):
            if len(line) >= min_chars and (h := line_hash(line, min_chars)):
                where.append((r, k))
                pairs.append(h)
                own.append(ids[r])
    return rows, np.array(where, np.int64).reshape(-1, 2), np.array(pairs, np.int64).reshape(-1, 2), np.array(own, np.int64)


def line_counts(docs: DataFrame, text_col: str, id_col: str, min_chars: int) -> DataFrame:
    """h1, h2, n (documents), largest (id) of every distinct key; summed by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, where, pairs, own = _lines(b, text_col, id_col, min_chars)
            seen = pd.DataFrame({"h1": pairs[:, 0], "h2": pairs[:, 1], "row": where[:, 0], "own": own}).drop_duplicates(["h1", "h2", "row"])
            g = seen.groupby(["h1", "h2"], sort=False).agg(n=("row", "size"), largest=("own", "max")).reset_index()
            yield pa.RecordBatch.from_pandas(g.astype("int64"), preserve_index=False)

    return docs.mapInArrow(run, "h1 long, h2 long, n long, largest long").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))


def build_shards(keys: DataFrame, n: int) -> DataFrame:
    """shard, blob: a perfect hash for each of n shards."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        h = PerfectHash.build(g["h1"].to_numpy(), g["h2"].to_numpy(), g["n"].clip(upper=2**31 - 1).to_numpy(), g["largest"].to_numpy())
        return pd.DataFrame({"shard": [g["shard"].iloc[0]], "blob": [h.to_bytes()]})

    shard = F.pmod(F.shiftrightunsigned("h1", 20), F.lit(n)).alias("shard")
    return keys.select(shard, "h1", "h2", "n", "largest").groupBy("shard").applyInPandas(build, "shard long, blob binary")


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, resident_bytes: int = RESIDENT_BYTES, hot_share: int = HOT_SHARE) -> DataFrame:
    """docs with texts that lack the repeated lines, n_lines (before) and n_dropped. The id is an integer."""
    spark = docs.sparkSession
    all_keys = line_counts(docs.select(id_col, text_col), text_col, id_col, min_chars)
    keys = stash(all_keys.filter(F.col("n") >= min_docs), "line-keys")
    n_keys, held = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    whole = n_keys * KEY_BYTES <= resident_bytes
    # Beyond, all long lines are sent to the shards, unique ones too.
    asked_for = held if whole else all_keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_shards = max(1, -(-n_keys // SHARD_KEYS), -(-asked_for // SHARD_PROBES))
    near = keys if whole else keys.filter(F.col("n") * hot_share > held)
    hot_n = n_shards if whole else 1
    resident = spark.sparkContext.broadcast(Shards(hot_n, {r["shard"]: r["blob"] for r in build_shards(near, hot_n).collect()}))
    hits_col = "_line_hits"
    while hits_col in {c.lower() for c in docs.columns}:
        hits_col += "_"
    schema = widened(docs.schema, {text_col: T.StringType(), "n_lines": T.LongType(), "n_dropped": T.LongType()})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = resident.value
        for b in batches:
            rows, where, pairs, own = _lines(b, text_col, id_col, min_chars)
            gone = shards.dropped(pairs, own)
            if not whole:
                hits = [{(x["h1"], x["h2"]) for x in h or ()} for h in b.column(hits_col).to_pylist()]
                gone |= np.fromiter(((int(p[0]), int(p[1])) in hits[r] for (r, _), p in zip(where, pairs, strict=True)), bool, len(pairs))
                b = b.select([c for c in b.schema.names if c != hits_col])  # noqa: PLW2901
            drop: dict[int, set[int]] = {}
            for r, k in where[gone].tolist():
                drop.setdefault(r, set()).add(k)
            kept = ["\n".join(x for k, x in enumerate(lines) if k not in drop[r]) if r in drop else "\n".join(lines) for r, lines in enumerate(rows)]
            yield with_columns(b, {text_col: pa.array(kept, pa.string()), "n_lines": pa.array(map(len, rows), pa.int64()), "n_dropped": pa.array([len(drop.get(r, ())) for r in range(len(rows))], pa.int64())})

    if whole:
        return docs.mapInArrow(apply, schema)

    far = build_shards(keys.filter(F.col("n") * hot_share <= held), n_shards)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the keys that the broadcast arrays lack."""
        for b in batches:
            _, _, pairs, own = _lines(b, text_col, id_col, min_chars)
            if len(pairs):
                known = np.zeros(len(pairs), bool)
                for h in map(PerfectHash.from_bytes, resident.value.blobs.values()):
                    known |= h.find(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])) >= 0
                pairs, own = pairs[~known], own[~known]
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(pairs[:, 0].copy(), n_shards)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(own)], names=["shard", "h1", "h2", "own"])

    def answer(asked: pd.DataFrame, blob: pd.DataFrame) -> pd.DataFrame:
        if blob.empty or asked.empty:
            return asked[["h1", "h2", "own"]].iloc[:0]
        shards = Shards(n_shards, dict(zip(blob["shard"], blob["blob"], strict=True)))
        return asked.loc[shards.dropped(asked[["h1", "h2"]].to_numpy(), asked["own"].to_numpy()), ["h1", "h2", "own"]].drop_duplicates()

    asked = docs.select(id_col, text_col).mapInArrow(probes, "shard long, h1 long, h2 long, own long")
    hits = asked.groupBy("shard").cogroup(far.groupBy("shard")).applyInPandas(answer, "h1 long, h2 long, own long")
    by_doc = hits.groupBy("own").agg(F.collect_list(F.struct("h1", "h2")).alias(hits_col))
    own = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    return docs.join(by_doc, own == by_doc["own"], "left").drop("own").mapInArrow(apply, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated long lines."""
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the lines that dedup_lines() keeps; a null text becomes an empty one. Repeated rows hold their
    lines each. An empty table stays empty. All other columns stay as they are, whatever their names."""
    own, back = aside(docs, ["doc_id", "text"])
    return back(dedup_lines(own))


ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_key, length(lower_key) >= 40 AS long
  FROM (SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))
), keys AS (
  SELECT lower_key, max(doc_id) AS largest FROM lines WHERE long GROUP BY lower_key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, k.lower_key IS NOT NULL AND l.doc_id <> k.largest AS gone
  FROM lines l LEFT JOIN keys k ON l.long AND l.lower_key = k.lower_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
