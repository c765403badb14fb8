"""LM scoring with a hierarchical Pitman-Yor model.

A word's restaurant is that of the word before it; all these context restaurants share one parent, whose base is uniform
over the known words and one unknown. A customer of a context is a token, and every table of a context is a customer of
the parent. Contexts are the words themselves, so restaurants, dishes and customers all grow with the corpus.

Gibbs sampling goes by turns, and each turn seats all customers anew:

* Contexts, given the parent's distribution: with a gamma variate of each restaurant's total given, its dishes are
  independent, and the seating of a dish's customers is drawn at once, as its number of tables (see pitman_yor). Contexts
  are in shards that work in parallel; only sums by word leave a shard.
* The parent, given all contexts' tables: its seating likewise, then its distribution as gamma variates of its
  customers. Its words are in shards too, which answer what each context shard asked for.
* Discount and concentration of both levels, from their likelihood on a grid.

After ``BURN_IN`` turns ``SAMPLES`` of them are kept, and a token's probability is the mean of their predictions.

A dish with one customer has one table always: such entries (most of them) are written once, and only the others go
through the turns. A context whose word has over ``SPLIT_TOKENS`` tokens is split by the word that follows into parts,
each a context of some shard; their totals (few, by definition) are exchanged. A word too frequent for one shard so
never is in one.

Scoring sends each chunk of documents' distinct words and pairs to the shards that have them, and joins their answers by
chunk. Shards grow in number with the text, not in size. Words of a context are told apart by 40 bits of their hash.

Defined results: a null or empty text is the end token alone. A null id counts as the empty text and so is in training.
With no training documents every word is unknown and its probability 1. Repeated rows are scored, and learned, each. Of
the input only the text and the id are read.
"""

from __future__ import annotations

import gc
import pickle
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import pitman_yor as py
from quillspan.llm.common import crc_mod, drop_stash, stash, table, texts

HELD_OUT_MOD, HELD_OUT_REMAINDER = 7, 2
BURN_IN, SAMPLES, SEED = 2, 3, 11
#: Characters of text for one shard of contexts, one of words, and a chunk.
SHARD_CHARS, WORD_SHARD_CHARS, CHUNK_CHARS, MIN_SHARDS = 24_000_000, 96_000_000, 8_000_000, 6
#: Documents are scored in so many passes, each with its shuffles removed before the next.
PASSES = 3
#: Contexts with more tokens are split; of more than MOST_SPLIT such, the most frequent.
SPLIT_TOKENS, MOST_SPLIT = 2_000_000, 65_536
_KEY = np.uint64(40)
_START, _END = np.uint64(0x5F3D2A1B9C8E7D61), np.uint64(0xA7C9E1F30B4D6825)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Kinds of rows: what shards keep, what they tell each other, what documents ask and what they get.
PAIRS, FIXED, MOVING, SUMS, WORDS, CHANCES, ASKED, TEXT, OF_WORDS, OF_PAIRS = range(10)
_TEXTS = 1 << 61  # dests of TEXT rows, past those of shards
_ROW = "dest long, kind int, src long, blob binary"
_TOLD = "dest long, kind int, src long, blob binary, note binary"


def packed(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def unpacked(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))  # our own packed()


def small(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def planes(keys: np.ndarray) -> bytes:
    """The keys' 40 bits, byte by byte over all of them."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(5, -1).T
    return out.view("<u8").ravel()


def key_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(24)


def histogram(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers, the second below 2**31, and how often each is there."""
    both, n = np.unique(a.astype(np.int64) << 31 | b.astype(np.int64), return_counts=True)
    return both >> 31, both & (1 << 31) - 1, n


def word_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of keys, so that the order of words is also one by shard."""
    return ((keys * np.uint64(shards)) >> _KEY).astype(np.int64)


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def found(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the wanted are, or -1."""
    if not len(sorted_):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


# --- tokens -------------------------------------------------------------------------------------------------------------


def pieces(text: str, chars: int) -> Iterator[bytes]:
    """The text in lower case, cut at white space into pieces of about so many characters."""
    data = text.encode("utf-8").lower()  # bytes.lower() changes A-Z alone
    at = 0
    while len(data) - at > 2 * chars:
        cut = at + chars
        while cut < len(data) and data[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes: eight bytes at a time, all words at once."""
    data = data + b" " * 8
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = edges if space[0] else np.r_[0, edges]
    first, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the eight bytes from every byte on

    def block(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        over = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        return eight[at] << over >> over

    h = _mixed(block(first, size) ^ size.astype(np.uint64) * _GOLD)
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        h[more] = _mixed(h[more] * _MIX ^ block(first[more] + at, size[more] - at))
        at += 8
        more = more[size[more] > at]
    return first, h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _GOLD
    return x ^ (x >> np.uint64(32))


@dataclass
class Tokens:
    """Distinct words' hashes, ascending; of each token its word, the word before it (numbers) and its row."""

    hashes: np.ndarray
    word: np.ndarray
    before: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, held: list[tuple[int, int, bytes, bool]]) -> Tokens:
        """held: row, the hash of the word before the piece, the piece, whether the text ends here."""
        first, h = words_of(b" ".join(x[2] for x in held))
        begin = starts(np.array([len(x[2]) + 1 for x in held], np.int64))
        n = np.diff(np.r_[np.searchsorted(first, begin), len(first)])
        ends = np.array([x[3] for x in held], bool)
        size = n + ends
        last = (np.cumsum(size) - 1)[ends]
        every = np.full(int(size.sum()), _END, np.uint64)
        inner = np.ones(len(every), bool)
        inner[last] = False
        every[inner] = h
        hashes, word = np.unique(np.r_[every, _START, np.array([x[1] for x in held], np.uint64)], return_inverse=True)
        word, start = word[: len(every)], word[len(every) + 1 :]
        before = np.r_[0, word[:-1]][: len(word)]
        before[starts(size)[size > 0]] = start[size > 0]
        return cls(hashes, word, before, np.repeat([x[0] for x in held], size).astype(np.int64))


def chunks(batches: Iterable[pa.RecordBatch], text_col: str, id_col: str | None = None, chars: int = 0) -> Iterator[tuple[list, Tokens]]:
    """The rows' ids and tokens of chunks of about so many characters. A longer text is in several chunks; with an id
    column it is in one."""
    chars = chars or CHUNK_CHARS
    ids: list = []
    held: list[tuple[int, int, bytes, bool]] = []
    size = 0
    for b in batches:
        own = b.column(id_col).to_pylist() if id_col else [None] * b.num_rows
        for i, t in zip(own, texts(b, text_col), strict=True):
            before, rest = int(_START), None
            for p in pieces(t, chars):
                if rest is not None:
                    held.append((len(ids), before, rest, False))
                    size += len(rest)
                    if word := rest.rsplit(None, 1)[-1:]:
                        before = int(words_of(word[0])[1][0])
                    if size >= chars and id_col is None:
                        yield ids, Tokens.of(held)
                        held, size = [], 0
                rest = p
            held.append((len(ids), before, rest, True))
            size += len(rest) + 16
            ids.append(i)
            if size >= chars:
                yield ids, Tokens.of(held)
                ids, held, size = [], [], 0
    if held:
        yield ids, Tokens.of(held)


@dataclass
class Split:
    """Hashes of the words whose contexts are split, ascending, and into how many parts."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The parts' contexts, ascending, and the word that each is of."""
        word = np.repeat(np.arange(len(self.hashes)), self.parts)
        part = np.arange(len(word)) - np.repeat(starts(self.parts), self.parts)
        keys = part_key(self.hashes[word], part)
        order = np.argsort(keys)
        return keys[order], word[order]


def part_key(hashes: np.ndarray, part: np.ndarray) -> np.ndarray:
    x = (hashes ^ (part.astype(np.uint64) + np.uint64(1)) * _GOLD) * _MIX
    return x ^ (x >> np.uint64(29))


def contexts(tok: Tokens, split: Split, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts' keys, by shard and key; their shards; of each token its context's number among them."""
    n = len(tok.hashes)
    at = found(split.hashes, tok.hashes)
    parts = np.where(at >= 0, split.parts[at] if len(split.parts) else 1, 1)
    first = starts(parts)
    key = np.repeat(tok.hashes, parts)
    of = np.repeat(np.arange(n), parts)
    cut = at[of] >= 0
    key[cut] = part_key(key[cut], (np.arange(len(of)) - first[of])[cut])
    part = (key_of(tok.hashes)[tok.word] % parts[tok.before].astype(np.uint64)).astype(np.int64)
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((key, shard))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return key[order], shard[order], rank[first[tok.before] + part]


def _slices(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            yield int(shard[a]), slice(a, b)


def pairs_by_shard(tok: Tokens, split: Split, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Iterator]:
    """Sorted (context, word) of each token with its row; where pairs begin; contexts' pairs; and for each shard its
    contexts and pairs, as slices."""
    key, shard, ctx = contexts(tok, split, shards)
    n, rows = len(tok.hashes), int(tok.row.max()) + 1 if len(tok.row) else 1
    pair = ctx * n + tok.word
    if len(key) * n * rows < 1 << 63:  # all three in one number: one sort
        x = np.sort(pair * rows + tok.row)
        pair, row = x // rows, x % rows
    else:
        order = np.lexsort((tok.row, pair))
        pair, row = pair[order], tok.row[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    pair = pair[first]
    sizes = np.bincount(pair // n, minlength=len(key))
    some = sizes > 0
    key, shard, sizes = key[some], shard[some], sizes[some]
    begin = starts(sizes)

    def each() -> Iterator[tuple[int, slice, slice]]:
        for s, c in _slices(shard):
            a = int(begin[c.start])
            yield s, c, slice(a, int(begin[c.stop - 1] + sizes[c.stop - 1]))

    return pair % n, row, np.r_[first, len(row)], key, sizes, each()


def _rows(rows: list[tuple], names: tuple[str, ...] = ("dest", "kind", "src", "blob")) -> pa.RecordBatch:
    types = {"dest": pa.int64(), "kind": pa.int32(), "src": pa.int64(), "blob": pa.binary(), "note": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for c, n in zip(cols, names, strict=True)], names=list(names))


def by_dest(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """Rows sorted by dest: each dest with its rows (kind, src, blob), which are read as they come."""

    def flat() -> Iterator[tuple[int, int, int, bytes]]:
        for b in batches:
            for k in range(b.num_rows):
                yield tuple(b.column(c)[k].as_py() for c in ("dest", "kind", "src", "blob"))

    from itertools import groupby

    for dest, group in groupby(flat(), key=lambda r: r[0]):
        yield dest, (r[1:] for r in group)


# --- shards of contexts -------------------------------------------------------------------------------------------------


class Merged:
    """Sums of (context, key) -> count, put in as they come."""

    MOST = 3_000_000

    def __init__(self) -> None:
        self.parts, self.pending = [], 0

    def put(self, ctx: np.ndarray, sizes: np.ndarray, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((ctx, sizes, keys, n))
        self.pending += len(keys)
        if self.pending > self.MOST:
            self.parts = [self.all()]
            self.pending = len(self.parts[0][2]) // 2

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ctx = np.unique(np.concatenate([p[0] for p in self.parts]))
        if len(ctx) >= 1 << 24:
            raise ValueError("too many contexts in a shard")
        both = np.concatenate([np.repeat(np.searchsorted(ctx, c).astype(np.uint64) << _KEY, s) | k for c, s, k, _ in self.parts])
        n = np.concatenate([p[3] for p in self.parts]).astype(np.int64)
        self.parts = []
        order = np.argsort(both)
        both, n = both[order], n[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        both, n = both[first], np.add.reduceat(n, first)
        return ctx, np.bincount((both >> _KEY).astype(np.int64), minlength=len(ctx)), both & ((np.uint64(1) << _KEY) - np.uint64(1)), n


@dataclass
class Contexts:
    """What moves in a shard: the entries of at least two customers, in contexts that have some."""

    at: np.ndarray  # contexts' numbers in the shard
    once: np.ndarray  # their entries with one customer
    c: np.ndarray  # their customers
    sizes: np.ndarray  # their entries here
    keys: bytes
    n: np.ndarray  # the entries' customers
    t: np.ndarray  # and tables
    group: np.ndarray  # the split word that a context is of, or -1
    alone: tuple[np.ndarray, np.ndarray]  # other contexts: their customers (as many tables), how often
    alone_group: tuple[np.ndarray, np.ndarray]  # of split words: which, customers
    samples: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, m: Merged, split: Split) -> tuple[Contexts, bytes]:
        """Also the packed entries that never change."""
        ctx, sizes, keys, n = m.all()
        part, word = split.keys()
        at = found(part, ctx)
        group = np.where(at >= 0, word[at] if len(word) else -1, -1)
        where = np.repeat(np.arange(len(ctx)), sizes)
        one = n == 1
        once, c = np.bincount(where[one], minlength=len(ctx)), np.bincount(where, n, minlength=len(ctx)).astype(np.int64)
        fixed = packed((ctx, small(c), small(once), planes(keys[one])))
        moving = sizes - once
        some = np.flatnonzero(moving)
        rest = np.flatnonzero((moving == 0) & (group < 0))
        cut = np.flatnonzero((moving == 0) & (group >= 0))
        dishes = n[~one]
        return cls(some, once[some], c[some], moving[some], planes(keys[~one]), dishes, np.ones(len(dishes), np.int64), group[some], np.unique(c[rest], return_counts=True), (group[cut], c[cut])), fixed

    def turn(self, chance: np.ndarray, d: float, a: float, totals: np.ndarray, shard: int, turn: int) -> None:
        """All seats anew. chance: the parent's probabilities of words(); totals: tables of the split words' contexts."""
        rng = np.random.default_rng([SEED, turn + 1, shard])
        tables = self.tables()
        cut = self.group >= 0
        tables[cut] = totals[self.group[cut]]
        y = rng.standard_gamma(a / d + tables)
        for k in np.flatnonzero(cut):  # all parts of a restaurant have one variate
            y[k] = np.random.default_rng([SEED, turn + 1, 1 << 40, self.group[k]]).standard_gamma(a / d + tables[k])
        _, of = np.unique(from_planes(self.keys), return_inverse=True)
        self.t = py.draw_tables(self.n, d * np.repeat(y, self.sizes) * chance[of], d, rng)

    def tables(self) -> np.ndarray:
        ends = np.cumsum(self.sizes)
        total = np.r_[0, np.cumsum(self.t)]
        return self.once + total[ends] - total[ends - self.sizes]

    def words(self) -> np.ndarray:
        return np.unique(from_planes(self.keys))

    def sums(self) -> np.ndarray:
        """Tables by word, in the order of words()."""
        w, of = np.unique(from_planes(self.keys), return_inverse=True)
        return np.bincount(of, self.t, minlength=len(w)).astype(np.int64)

    def note(self) -> bytes:
        """For the driver: likelihoods on the grid, and what parts of split contexts have."""
        tables, cut = self.tables(), self.group >= 0
        c, t, n = histogram(self.c[~cut], tables[~cut])
        rest = py.restaurant_terms(np.r_[c, self.alone[0]], np.r_[t, self.alone[0]], np.r_[n, self.alone[1]])
        terms = py.table_terms(*histogram(self.n, self.t))
        g = np.r_[self.group[cut], self.alone_group[0]]
        ids, of = np.unique(g, return_inverse=True)
        c, t = (np.bincount(of, np.r_[x[cut], self.alone_group[1]], minlength=len(ids)).astype(np.int64) for x in (self.c, tables))
        return packed((rest + terms[:, None], ids, c, t))


# --- shards of words ----------------------------------------------------------------------------------------------------


@dataclass
class Words:
    """A shard of the parent's dishes."""

    hashes: np.ndarray
    count: np.ndarray  # tokens
    once: np.ndarray  # customers from entries that never change
    asks: dict[int, np.ndarray] = field(default_factory=dict)  # of each shard of contexts, the words that it has
    c: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    t: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def turn(self, told: dict[int, np.ndarray], d: float, a: float, tables: float, base: float, shard: int, turn: int) -> np.ndarray:
        """All seats anew; the words' part of the parent's distribution, as gamma variates."""
        rng = np.random.default_rng([SEED, turn + 1, shard, 1])
        c = self.once.copy()
        for src, sums in told.items():
            np.add.at(c, self.asks[src], sums)
        self.c = c
        y = float(np.random.default_rng([SEED, turn + 1, 1 << 41]).standard_gamma(a / d + max(tables, 1)))
        self.t = np.zeros(len(c), np.int64)
        some = c > 0  # all, but for words that another one's 40 bits hide
        self.t[some] = py.draw_tables(c[some], np.full(int(some.sum()), d * y * base), d, rng)
        return rng.standard_gamma(np.maximum(c - d * self.t, 0))

    def note(self, total: float) -> bytes:
        return packed((py.table_terms(*histogram(self.c[self.c > 0], self.t[self.c > 0])), int(self.c.sum()), int(self.t.sum()), total))


# --- training -----------------------------------------------------------------------------------------------------------


@dataclass
class Sample:
    """Discount, concentration, and the parent's totals; a kept turn."""

    d: float
    a: float
    d_up: float
    a_up: float
    c: int
    t: int
    split_t: np.ndarray


@dataclass
class LanguageModel:
    first: DataFrame
    moving: DataFrame
    words: DataFrame
    shards: int
    word_shards: int
    split: Split
    split_c: np.ndarray
    samples: list[Sample]
    vocabulary: int
    trained: int

    def drop(self) -> None:
        for df in {id(x): x for x in (self.first, self.moving, self.words)}.values():
            drop_stash(df)


def collected_garbage(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that nothing refers to any more; its cleaner works in the background."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()  # noqa: SLF001
        time.sleep(0.3)


def _only(df: DataFrame, *kinds: int) -> DataFrame:
    return df.filter(F.col("kind").isin(*kinds)).select("dest", "kind", "src", "blob")


def _met(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, each dest's together: what is kept first."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.repartition("dest").sortWithinPartitions("dest", "kind", "src")


def _notes(df: DataFrame, kind: int) -> list:
    return [unpacked(r["note"]) for r in df.filter(F.col("kind") == kind).select("note").toLocalIterator()]


def _counted(docs: DataFrame, text_col: str, word_shards: int, split_tokens: int) -> DataFrame:
    """Rows of Words' hashes and counts; note: tokens, words, and the words that may be split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tok in chunks(batches, text_col):
            n = np.bincount(tok.word, minlength=len(tok.hashes))
            h, n = tok.hashes[n > 0], n[n > 0]
            yield _rows([(r, WORDS, 0, packed((h[s], small(n[s])))) for r, s in _slices(word_shard(key_of(h), word_shards))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dest, rows in by_dest(batches):
            parts, size = [], 0
            for _, _, blob in rows:
                parts.append(unpacked(blob))
                size += len(parts[-1][0])
                if size > 4_000_000:
                    parts = [_summed(parts)]
                    size = len(parts[0][0]) // 2
            h, n = _summed(parts)
            big = n > split_tokens
            yield _rows([(dest, WORDS, 0, packed((h, small(n))), packed((int(n.sum()), len(h), h[big], n[big])))], ("dest", "kind", "src", "blob", "note"))

    return _met(docs.select(text_col).mapInArrow(count, _ROW)).mapInArrow(merge, _TOLD)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(n, first)


def train(docs: DataFrame, shards: int, word_shards: int = 2, text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES, split_tokens: int = SPLIT_TOKENS) -> LanguageModel:
    """docs: the training documents."""
    spark = docs.sparkSession
    counted = stash(_counted(docs, text_col, word_shards, split_tokens), "lm-words")
    notes = _notes(counted, WORDS)
    trained, vocabulary = sum(x[0] for x in notes), sum(x[1] for x in notes)
    base = 1 / (vocabulary + 1)
    h, n = (np.concatenate([x[k] for x in notes] or [np.zeros(0, t)]) for k, t in ((2, np.uint64), (3, np.int64)))
    big = n > trained / MOST_SPLIT  # so there are at most that many
    h, n = h[big], n[big]
    split = Split(np.sort(h), -(-n[np.argsort(h)] // split_tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tok in chunks(batches, text_col):
            word, _, first, ctx, sizes, each = pairs_by_shard(tok, split, shards)
            keys, n = key_of(tok.hashes)[word], np.diff(first)
            yield _rows([(s, PAIRS, 0, packed((ctx[c], small(sizes[c]), planes(keys[p]), small(n[p])))) for s, c, p in each])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dest, rows in by_dest(batches):
            m = Merged()
            for _, _, blob in rows:
                ctx, sizes, keys, n = unpacked(blob)
                m.put(ctx, sizes.astype(np.int64), from_planes(keys), n)
            now, fixed = Contexts.of(m, split)
            del m
            lone, times = np.unique(from_planes(unpacked(fixed)[3]), return_counts=True)
            words, sums = now.words(), now.sums()
            out: dict[int, list] = {}
            for k, (w, v) in enumerate(((words, sums), (lone, times))):
                for r, s in _slices(word_shard(w, word_shards)):
                    out.setdefault(r, [None, None])[k] = (planes(w[s]), small(v[s]))
            yield _rows([(dest, FIXED, 0, fixed, None), (dest, MOVING, 0, packed(now), now.note())] + [(r, SUMS, dest, packed(x), None) for r, x in out.items()], ("dest", "kind", "src", "blob", "note"))

    low = stash(_met(docs.select(text_col).mapInArrow(count, _ROW)).mapInArrow(seat, _TOLD), "lm-contexts", "kind")
    collected_garbage(spark)
    first_low = low
    state = Sample(0.5, 1.0, 0.5, 1.0, 0, vocabulary, np.ones(len(split.hashes)))
    rng = np.random.default_rng(SEED)
    split_c = np.zeros(len(split.hashes))

    def learn_low(df: DataFrame) -> None:
        nonlocal split_c
        grid, c, t = np.zeros((len(py.DISCOUNTS), len(py.CONCENTRATIONS))), *np.zeros((2, len(split.hashes)))
        for g, ids, cc, tt in _notes(df, MOVING):
            grid += g
            c[ids] += cc
            t[ids] += tt
        split_c, state.split_t = c, np.maximum(t, 1)
        grid += py.restaurant_terms(c, state.split_t, np.ones(len(c)))
        state.d, state.a = py.draw_hyperparameters(grid, rng)

    learn_low(low)
    old_words, kept = counted, []
    for turn in range(-1, burn_in + samples):
        keep = turn >= burn_in
        if turn >= 0:
            low_args = (state.d, state.a, state.split_t, total, spare * base)  # noqa: F821

            def lower(batches: Iterator[pa.RecordBatch], args: tuple = low_args, turn: int = turn, keep: bool = keep) -> Iterator[pa.RecordBatch]:
                d, a, totals, whole, rest = args
                for dest, rows in by_dest(batches):
                    now, chances = None, []
                    for kind, _, blob in rows:
                        if kind == MOVING:
                            now = unpacked(blob)
                        else:
                            chances.append(unpacked(blob))
                    chance = (np.concatenate([*chances, np.zeros(0, np.float32)]).astype(np.float64) + rest) / whole
                    now.turn(chance, d, a, totals, dest, turn)
                    if keep:
                        now.samples.append(small(now.t))
                    sums, r = now.sums(), word_shard(now.words(), word_shards)
                    yield _rows([(dest, MOVING, 0, packed(now), now.note())] + [(k, SUMS, dest, packed(small(sums[s])), None) for k, s in _slices(r)], ("dest", "kind", "src", "blob", "note"))

            new = stash(_met(_only(low, MOVING), _only(old_words, CHANCES)).mapInArrow(lower, _TOLD), "lm-contexts", "kind")
            if low is not first_low:
                drop_stash(low)
            low = new
            learn_low(low)

        def upper(batches: Iterator[pa.RecordBatch], args: tuple = (state.d_up, state.a_up, state.t), turn: int = turn, keep: bool = keep) -> Iterator[pa.RecordBatch]:
            d, a, tables = args
            for dest, rows in by_dest(batches):
                now, told = None, {}
                for kind, src, blob in rows:
                    if kind == WORDS:
                        now = unpacked(blob)
                    else:
                        told[src] = blob
                if turn < 0:
                    h, n = now if now else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    now = Words(h, n, np.zeros(len(h), np.int64))
                    keys = key_of(h)
                    for src, blob in told.items():
                        moving, lone = unpacked(blob)
                        if lone:
                            np.add.at(now.once, np.searchsorted(keys, from_planes(lone[0])), lone[1])
                        if moving:
                            now.asks[src] = np.searchsorted(keys, from_planes(moving[0])).astype(np.int32)
                            told[src] = moving[1]
                    told = {s: x for s, x in told.items() if s in now.asks}
                else:
                    told = {s: unpacked(x) for s, x in told.items()}
                gammas = now.turn(told, d, a, tables, base, dest, turn)
                if keep:
                    now.samples.append((small(now.c), small(now.t)))
                yield _rows([(dest, WORDS, 0, packed(now), now.note(float(gammas.sum())))] + [(s, CHANCES, dest, packed(gammas[at].astype(np.float32)), None) for s, at in now.asks.items()], ("dest", "kind", "src", "blob", "note"))

        new = stash(_met(_only(old_words, WORDS), _only(low, SUMS)).mapInArrow(upper, _TOLD), "lm-words", "kind")
        drop_stash(old_words)
        old_words = new
        notes = _notes(new, WORDS)
        state.c, state.t, total = sum(x[1] for x in notes), sum(x[2] for x in notes), sum(x[3] for x in notes)
        grid = sum((x[0] for x in notes), np.zeros(len(py.DISCOUNTS)))[:, None] + py.restaurant_terms(*(np.array([max(x, 1)]) for x in (state.c, state.t)), np.ones(1))
        state.d_up, state.a_up = py.draw_hyperparameters(grid, rng)
        spare = float(rng.standard_gamma(state.a_up + state.d_up * state.t))
        total += spare
        if keep:
            kept.append(Sample(state.d, state.a, state.d_up, state.a_up, state.c, state.t, state.split_t.copy()))
    return LanguageModel(first_low, low, old_words, shards, word_shards, split, split_c, kept, vocabulary, trained)


# --- scoring ------------------------------------------------------------------------------------------------------------


class WordAnswers:
    """Of a shard of words: what documents ask."""

    def __init__(self, w: Words, model: tuple) -> None:
        samples, base = model
        self.hashes = w.hashes
        self.count = np.r_[w.count, 0]
        self.p = np.stack([np.r_[np.maximum(c - s.d_up * t, 0) + (s.a_up + s.d_up * s.t) * base, (s.a_up + s.d_up * s.t) * base] / (s.a_up + s.c) for (c, t), s in zip(w.samples, samples, strict=True)]) if w.samples else np.zeros((0, len(self.count)))

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens in training, and the parent's probability by sample."""
        at = found(self.hashes, hashes)
        return self.count[at], self.p[:, at]


class PairAnswers:
    """Of a shard of contexts: what documents ask."""

    def __init__(self, fixed: bytes, moving: Contexts | None, split: Split, split_c: np.ndarray, split_t: list[np.ndarray]) -> None:
        self.ctx, c, once, lone = unpacked(fixed)
        where = np.repeat(np.arange(len(self.ctx), dtype=np.uint64) << _KEY, once)
        self.once = where | from_planes(lone)
        m = moving
        self.moving = np.repeat(m.at.astype(np.uint64) << _KEY, m.sizes) | from_planes(m.keys)
        self.n, self.samples = m.n, m.samples
        self.c = c.astype(np.int64)
        self.t = []
        part, word = split.keys()
        at = found(part, self.ctx)
        cut = at >= 0
        ends = np.cumsum(m.sizes)
        for k, s in enumerate(m.samples):
            t = once.astype(np.int64)
            total = np.r_[0, np.cumsum(s, dtype=np.int64)]
            t[m.at] += total[ends] - total[ends - m.sizes]
            t[cut] = split_t[k][word[at[cut]]]
            self.t.append(t)
        self.c[cut] = split_c[word[at[cut]]]

    def get(self, ctx: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple:
        """Contexts' customers and tables by sample; pairs' likewise. All 0 if unseen."""
        at = found(self.ctx, ctx)
        want = np.repeat(np.maximum(at, 0).astype(np.uint64) << _KEY, sizes) | keys
        known = np.repeat(at >= 0, sizes)
        n = ((found(self.once, want) >= 0) & known).astype(np.int64)
        i = found(self.moving, want)
        more = (i >= 0) & known
        n[more] = self.n[i[more]]
        t = []
        for s in self.samples:
            x = np.minimum(n, 1)
            x[more] = s[i[more]]
            t.append(small(x))
        return small(np.where(at >= 0, self.c[at], 0)), [small(np.where(at >= 0, x[at], 0)) for x in self.t], small(n), t


def score(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The id column, n_tokens, n_known, base_score, score and perplexity of every document."""
    shards, word_shards, split = model.shards, model.word_shards, model.split
    kept, trained, vocabulary, split_c = model.samples, model.trained, model.vocabulary, model.split_c
    id_type = docs.schema[id_col].dataType
    chars = CHUNK_CHARS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of words are below 0. src: the chunk."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for k, (ids, tok) in enumerate(chunks(batches, text_col, id_col, chars)):
            word, row, first, ctx, sizes, each = pairs_by_shard(tok, split, shards)
            keys = key_of(tok.hashes)
            # A task's rows leave its worker as they are made, so the chunk's arrays are in memory once.
            yield _rows([(_TEXTS + part + k, TEXT, part + k, packed((ids, small(np.bincount(tok.row, minlength=len(ids))), small(word), small(sizes), small(np.diff(first)), small(row))))])
            yield _rows([(-1 - r, ASKED, part + k, packed(tok.hashes[s])) for r, s in _slices(word_shard(keys, word_shards))])
            yield _rows([(s, ASKED, part + k, packed((ctx[c], small(sizes[c]), planes(keys[word[p]])))) for s, c, p in each])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dest, rows in by_dest(batches):
            have, fixed = None, None
            for kind, src, blob in rows:
                if kind == TEXT:
                    yield _rows([(src, TEXT, src, blob)])
                elif kind == FIXED:
                    fixed = blob
                elif kind == MOVING:
                    have = PairAnswers(fixed, unpacked(blob), split, split_c, [s.split_t for s in kept])
                    fixed = None
                elif kind == WORDS:
                    have = WordAnswers(unpacked(blob), (kept, 1 / (vocabulary + 1)))
                elif dest < 0:
                    n, p = have.get(unpacked(blob)) if have else (np.zeros(len(unpacked(blob)), np.int64), None)
                    yield _rows([(src, OF_WORDS, -1 - dest, packed((small(n), None if p is None else p.astype(np.float32))))])
                else:
                    ctx, sizes, keys = unpacked(blob)
                    zero = np.zeros(len(ctx), np.uint8), [np.zeros(len(ctx), np.uint8)] * len(kept), np.zeros(len(keys) // 5, np.uint8), [np.zeros(len(keys) // 5, np.uint8)] * len(kept)
                    yield _rows([(src, OF_PAIRS, dest, packed(have.get(ctx, sizes, from_planes(keys)) if have else zero))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_dest(batches):
            head, words, pairs = None, [], []
            for kind, _, blob in rows:
                if kind == TEXT:
                    head = unpacked(blob)
                else:
                    (words if kind == OF_WORDS else pairs).append(unpacked(blob))
            ids, n_tokens, word, sizes, times, row = head
            n_tokens = n_tokens.astype(np.int64)
            count = np.concatenate([x[0] for x in words]).astype(np.int64)
            total = np.zeros(len(word))
            for k, s in enumerate(kept):
                unseen = (s.a_up + s.d_up * s.t) / (vocabulary + 1) / (s.a_up + s.c)
                up = np.concatenate([np.full(len(n), unseen) if p is None else p[k] for n, p in words])[word].astype(np.float64)
                c, t = (np.repeat(np.concatenate(x).astype(np.float64), sizes) for x in ([x[0] for x in pairs], [x[1][k] for x in pairs]))
                n, own = (np.concatenate(x).astype(np.float64) for x in ([x[2] for x in pairs], [x[3][k] for x in pairs]))
                p = (np.maximum(n - s.d * own, 0) + (s.a + s.d * t) * up) / (s.a + c)
                total += np.where(c > 0, p, up)
            log_p = np.log10(total / len(kept))
            base = np.log10(count + 1.0) - np.log10(trained + vocabulary + 1.0)
            each = np.repeat(np.arange(len(word)), times)
            known, base, log_p = (np.bincount(row, x[each], minlength=len(ids)) for x in ((count > 0)[word].astype(np.float64), base[word], log_p))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_id), pa.array(n_tokens), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(log_p), pa.array(10.0 ** (-log_p / n_tokens))], names=[id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    words = _only(model.words, WORDS).withColumn("dest", -1 - F.col("dest"))
    asked = docs.select(id_col, text_col).mapInArrow(ask, _ROW)
    answers = _met(asked, _only(model.first, FIXED), _only(model.moving, MOVING), words).mapInArrow(answer, _ROW)
    return _met(answers).mapInArrow(gather, f"`{id_col}` {id_type.simpleString()}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the model of six in seven documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    at_least = lambda size: max(MIN_SHARDS, -(-chars // size))
    model = train(docs.filter(crc_mod("doc_id", HELD_OUT_MOD) != HELD_OUT_REMAINDER), at_least(SHARD_CHARS), at_least(WORD_SHARD_CHARS))
    out = None
    for k in range(PASSES):
        own = stash(score(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PASSES)) == k), model), "lm-scores")
        out = out.unionByName(own) if out else own
        collected_garbage(spark)
    model.drop()
    held_out = crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT_REMAINDER
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.trained).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
