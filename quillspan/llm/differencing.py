"""Packing into windows of equal capacity by Karmarkar-Karp multiway differencing.

Texts become token ids once and are cut there: whole windows first, which need no partner; the rest of a document once
more, into a multiple of ``GRAIN`` and a short tail, which gives the differencing something fine to level with. Only
lengths, places and checksums of pieces go on.

Pieces are dealt at random into groups of about ``WINDOWS`` windows. In a group each piece starts as a partial partition:
itself in one window, the others empty. The two partitions of the largest imbalance are merged again and again, the fullest
windows of one with the emptiest of the other, so that their imbalances cancel out. If a window of the last one exceeds the
capacity, the number of windows rises. Groups don't grow with the input, only their number does.

Defined results: a null or empty text is the end token alone. Repeated rows are packed each. An empty table has no
pieces. Extra columns are left out.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import stash, table, texts
from quillspan.llm.packing import _byte_letters, tokenizer_path

CAPACITY, END_ID = 2048, 1
VOCABULARY = "byte_bpe_50k.json"
#: Windows of one group, about, and what the longer part of a document's rest is a multiple of.
WINDOWS, GRAIN = 256, 128
#: Pieces of one group, about, where they are so short that fewer windows hold them.
GROUP_PIECES = 65_536
_MEMO_WORDS, _MEMO_CHARS = 300_000, 64
#: The byte-level vocabulary's pattern of word parts (fixed values).
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MARKS = '.,;:!?"()[]{}#$%&*|+-=/<>@\\^_`~'


class _OddSpace(Exception):
    """White space other than single blanks and line ends between words."""


class _Words(dict):
    """Words (of no white space) to their ids as little-endian uint32 bytes, with a blank before them or not."""

    def __init__(self, encode, piece, lead: str) -> None:
        self.encode, self.piece, self.lead = encode, piece, lead

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha() and max(core) < "ɐ":  # letters, then marks: two parts
            ids = self.piece((self.lead + core).encode()) + (self.piece(word[len(core) :].encode()) if len(core) < len(word) else [])
        elif not word or any(map(str.isspace, word)):
            raise _OddSpace
        else:
            ids = self.encode(self.lead + word)
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= _MEMO_CHARS:
            if len(self) >= _MEMO_WORDS:
                self.clear()
            self[word] = out
        return out


class ByteEncoder:
    """Texts to ids as little-endian uint32 bytes, equal to the tokenizer's.

    A blank or line end between two characters that aren't white space is always a border of the pattern's parts, so
    words are encoded by themselves and remembered. Other texts are encoded whole; those with special tokens or very long
    runs of white space by the tokenizer itself.
    """

    _WHOLE = re.compile(r"<\||\s{256}")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        letters = {c: b for b, c in _byte_letters().items()}
        vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if all(c in letters for c in t) and not t.startswith("<|")}
        plain = tiktoken.Encoding("words", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})
        self.encode = plain.encode_ordinary
        piece = plain._core_bpe.encode_single_piece  # noqa: SLF001
        self.bare, self.led = _Words(self.encode, piece, ""), _Words(self.encode, piece, " ")
        self.line_end = np.array(self.encode("\n"), "<u4").tobytes()

    def _line(self, line: str) -> bytes:
        words = line.split(" ")
        first = self.bare[words[0]]
        return first + b"".join(map(self.led.__getitem__, words[1:])) if len(words) > 1 else first

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self._WHOLE.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        try:
            return self.line_end.join(map(self._line, text.split("\n")))
        except _OddSpace:
            return np.array(self.encode(text), "<u4").tobytes()


_ENCODERS: dict[str, ByteEncoder] = {}


def cut(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths of the pieces of n tokens: whole windows, a multiple of the grain, a tail."""
    whole, rest = divmod(n, capacity)
    return [capacity] * whole + [k for k in (rest // grain * grain, rest % grain) if k]


def token_pieces(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """The id column, start, length, ids_crc32, doc_tokens and slot, a number of its own for each piece."""
    id_type = docs.schema[id_col].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ByteEncoder(path)
        encode, slot = _ENCODERS[path], TaskContext.get().partitionId() << 40
        for b in batches:
            rows, start, length, crc, total = [], [], [], [], []
            for r, text in enumerate(texts(b, text_col)):
                ids = encode(text) + end
                at, n = 0, len(ids) // 4
                for k in cut(n, capacity, grain):
                    rows.append(r)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + k)]))
                    total.append(n)
                    at += k
            slots = range(slot, slot + len(rows))
            slot += len(rows)
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, slots))], names=[id_col, *_FIELDS, "slot"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {', '.join(f'{f} long' for f in [*_FIELDS, 'slot'])}")


_FIELDS = ["start", "length", "ids_crc32", "doc_tokens"]


def differencing(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window of each length: partial partitions are merged with opposing imbalances, largest imbalances first.

    A partition is its windows' sums in ascending order, less the least. How a merge mixed the windows is kept as a
    permutation; from the last partition back, these tell each piece its window."""
    sums, made = [], []
    for n in lengths:
        s = np.zeros(windows, np.int32)
        s[-1] = n
        sums.append(s)
        made.append(None)
    heap = [(-int(n), i) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        s = sums[a] + sums[b][::-1]
        order = np.argsort(s, kind="stable")
        s = s[order]
        sums[a] = sums[b] = None
        sums.append(s - s[0])
        made.append((a, b, order))
        heapq.heappush(heap, (-int(s[-1] - s[0]), len(sums) - 1))
    out = np.zeros(len(lengths), np.int64)
    todo = [(heap[0][1], np.arange(windows))] if heap else []
    while todo:
        k, at = todo.pop()
        if made[k] is None:
            out[k] = at[-1]
            continue
        a, b, order = made[k]
        of_a = np.empty(windows, np.int64)
        of_a[order] = at
        todo += [(a, of_a), (b, of_a[::-1])]
    return out


def windows_of(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each length, none above the capacity. The number of windows starts at the least possible and rises,
    by ever larger steps, while one is exceeded; then the least number between the last two is sought by halving."""

    def tried(k: int) -> np.ndarray | None:
        at = differencing(lengths, k)
        return at if np.bincount(at, lengths, k).max(initial=0) <= capacity else None

    low, step = max(1, -(-int(lengths.sum()) // capacity)), 1
    best = tried(low)
    high = low
    while best is None:
        low, high, step = high, min(high + step, len(lengths)), step * 2
        best = tried(high)
    while high - low > 1:
        middle = (low + high) // 2
        found = tried(middle)
        if found is None:
            low = middle
        else:
            best, high = found, middle
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", windows: int = WINDOWS) -> DataFrame:
    """pieces (from a table, with length and a slot of their own) with sequence_id and offset, without slot."""
    kept = [c for c in pieces.columns if c.lower() not in ("slot", "sequence_id", "offset")]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    whole = pieces.filter(F.col("length") == capacity).select(*kept, (-F.col("slot") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < capacity)
    n_pieces, total = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, round(total / (capacity * windows)), -(-n_pieces // GROUP_PIECES))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        n = t.column("length").to_numpy()
        at = windows_of(n, capacity)
        order = np.argsort(at, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        first = np.concatenate([[True], at[order][1:] != at[order][:-1]])
        offset = np.empty(len(n), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        return t.select(kept).append_column("sequence_id", pa.array((t.column("_group").to_numpy() << 24) + at)).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("_group").applyInArrow(place, schema))


def op13_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences."""
    return pack(stash(token_pieces(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY)), "kk-pieces")).select("doc_id", *_FIELDS, "sequence_id", "offset")
