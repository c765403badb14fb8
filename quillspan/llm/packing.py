"""Best-fit packing, planned over a histogram of lengths.

Texts become token ids once; only lengths, places and checksums of their pieces go on. How many pieces have each length
is all that the planner sees: it goes through lengths from the longest down and puts each length's pieces into the
fullest sequences with room, whole runs of equally full sequences at a time. Its plan maps runs of ranks within a
length to runs of sequence numbers, so its size depends on the number of distinct lengths, never on the number of
documents. Pieces then take the slot of their rank within their length.

Ranks are made in two steps, since one length may be very frequent: within salted parts of a length, and by running
sums of the parts' sizes.

Defined results: a null or empty text is the end token alone. Repeated rows are packed once each. Extra columns are
left out.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import stash, table, texts

CAPACITY, END_ID = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces in one salted part of a length, about.
PART_ROWS = 200_000
_MEMO_WORDS, _MEMO_CHARS = 200_000, 64


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 letters stand for themselves, other bytes for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Texts to ids as little-endian uint32 bytes, equal to the tokenizer's, by words.

    The tokenizer takes white space as a border that nothing crosses and drops it, so a text's ids are its words' ids.
    A word of characters below U+0130 is normal already once it is in lower case, so its parts go to the model at once;
    any other is encoded by the whole tokenizer. Words are remembered in two generations: a word that is asked for
    moves to the younger one, and when this is full, the older one goes.
    """

    _PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _word(self, word: bytes) -> bytes:
        s = word.decode("utf-8")
        if "<|" in s or not (s.isascii() or max(s) < "\u0130"):
            return np.array(self.tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        low, ids = s.lower(), []
        for part in (low,) if low.isalpha() else self._PART.findall(low):
            if not (part.isascii() and part.isprintable()):
                part = part.encode("utf-8").decode("latin-1").translate(self.letters)  # noqa: PLW2901
            ids += [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, batch: list[str]) -> list[bytes]:
        split = [t.encode("utf-8").split() for t in batch]
        young, old, now = self.young, self.old, {}
        for w in set(chain.from_iterable(split)):
            ids = young.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    ids = self._word(w)
                if len(w) <= _MEMO_CHARS:
                    young[w] = ids
            now[w] = ids
        if len(young) > _MEMO_WORDS:
            self.young, self.old = {}, young
        return [b"".join(map(now.__getitem__, words)) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The id column, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian uint32)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, got in enumerate(enc(texts(b, text_col))):
                stream = got + end
                for k, at in enumerate(range(0, len(stream), 4 * capacity)):
                    part = stream[at : at + 4 * capacity]
                    rows.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [b.column(id_col).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())] if with_ids else cols, names=[*names, "ids"] if with_ids else names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts. Rows (length, first rank, end rank, first sequence, offset): the piece of this length and
    of rank r in the run goes to sequence first + r - first rank, at the offset."""
    room: dict[int, list[tuple[int, int]]] = {}  # sequences (first, end) by the room they have left
    open_rooms = 0  # bit r: there are sequences with room r
    out, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            above = open_rooms >> length
            if above:
                r = length + (above & -above).bit_length() - 1  # least room that is enough
                first, end = room[r].pop()
                if not room[r]:
                    open_rooms &= ~(1 << r)
            else:
                r, each = capacity, capacity // length
                first, end = fresh, fresh + -(-left // each)
                fresh = end
            n = min(end - first, left)
            out.append((length, rank, rank + n, first, capacity - r))
            if first + n < end:
                room.setdefault(r, []).append((first + n, end))
                open_rooms |= 1 << r
            if r - length:
                room.setdefault(r - length, []).append((first, first + n))
                open_rooms |= 1 << (r - length)
            rank, left = rank + n, left - n
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """pieces (from a table, with a length) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    parts = max(1, -(-max(histogram.values(), default=1) // PART_ROWS))
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64(F.col(id_col), "start", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(id_col, "start", "ids_crc32")) - 1).join(sizes, ["length", "_part"])
    slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)  # by length and first rank
    shared = spark.sparkContext.broadcast((slots[:, 0] << np.int64(48)) + slots[:, 1]), spark.sparkContext.broadcast(slots)
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rows = (x.value for x in shared)
        for b in batches:
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(starts, (b.column("length").to_numpy(zero_copy_only=False) << 48) + rank, side="right") - 1
            slot = rows[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in keep)
    return ranked.select(*keep, (F.col("_rank") + F.col("_base")).cast("long").alias("_rank")).mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces() and pack() of them: null and empty texts are one piece, the end id; repeated rows are packed each."""
    return pack(stash(token_pieces(docs, path, capacity=capacity), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def stage_best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences. A null or empty text is one piece, the end id alone. Repeated rows
    are packed each; of equal lengths any order may come. An empty table has no pieces. Other columns are left out."""
    return pack_documents(docs, tokenizer_path())
