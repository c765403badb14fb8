"""SentencePiece encoding and decoding by a streaming Viterbi lattice.

Nodes of the lattice are the borders between characters, edges the pieces. The vocabulary file is a BPE model, so a path
is not scored by a sum: an edge survives if the piece is compatible with the piece before it, which means that merging
their characters in rank order ends in just these two. Every border then has one surviving backpointer, and following
these from the end gives exactly the ids of the library's merges. New edges start at the last borders only, as many as
the longest piece has characters; ids are committed up to a border as soon as the backpointers from all these meet there.

Some borders are certain beforehand, because no piece crosses them: those before a run of the space sign, at line ends,
and between a word and such punctuation as no piece has after a letter. The ids of short stretches between these are
remembered up to a bound.

Defined results: null and empty texts have no ids and decode to the empty text. Characters without a piece become byte
pieces. Ids decode to the bytes they came from; invalid UTF-8, which only foreign ids can give, becomes U+FFFD.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspan.llm.common import table, texts, widened, with_columns

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
_MEMO_WORDS, _MEMO_CHARS, _MEMO_PAIRS = 200_000, 48, 300_000


def model_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces, ranks (a lower id merges first) and, for each longer piece, the two that its last merge joins."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        normal = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        #: Pieces of one, two, ... space signs. They aren't edges: what is longer than one merges after all else.
        self.space, self.runs = sp.piece_to_id(SPACE), []
        all_ids = {self.pieces[i]: i for i in normal}
        while (i := all_ids.get(SPACE * (len(self.runs) + 1))) is not None:
            self.runs.append(i)
        normal = [i for i in normal if i == self.space or self.pieces[i].strip(SPACE)]
        self.ids = {self.pieces[i]: i for i in normal}
        #: Merges go by score, the best first; single characters have none.
        self.rank = {i: k for k, i in enumerate(sorted(normal, key=lambda i: (-sp.get_score(i), i)))}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        #: Length of the longest piece by its last two characters.
        self.reach: dict[str, int] = {}
        for p in sorted(self.ids, key=len):
            if len(p) > 1:
                self.reach[p[-2:]] = len(p)
        self.spaced = sorted((p for p in self.ids if SPACE in p.lstrip(SPACE)), key=len)
        self.bytes = [p.replace(SPACE, " ").encode("utf-8") for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        for i in range(len(self.pieces)):
            if sp.is_control(i):
                self.bytes[i] = b""
        before: dict[str, set[str]] = {c: set() for c in string.punctuation}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                if b in before and re.match(r"\w", a):
                    before[b].add(a)
        #: Punctuation that pieces have after few or no letters and digits, and these few.
        self.breaks = {c for c, found in before.items() if len(found) <= 3}
        self.sticky = {a for c in self.breaks for a in before[c]}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for i in sorted((i for i in normal if len(self.pieces[i]) > 1), key=self.rank.__getitem__):
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None and (len(p) == 2 or self._reachable(a) and self._reachable(b) and self._keeps(a, b, self.rank[i])):
                    self.split[i] = (a, b)
                    break

    def _reachable(self, i: int) -> bool:
        return len(self.pieces[i]) == 1 or i in self.split

    def _keeps(self, a: int, b: int, limit: float) -> bool:
        """Whether no merge of a rank below the limit crosses the border of a and b before both are complete.

        Undoes merges, the latest first, and looks at each state for a merge over the border that would have come first.
        """
        rank, ids, pieces = self.rank, self.ids, self.pieces
        over = limit
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None and rank[joined] < over:
                return False
            ra = rank[a] if a in self.split else -1
            rb = rank[b] if b in self.split else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of merges of one rank the left one is the first: one over the border comes after a's
                over, a = ra, self.split[a][1]
            else:  # and before b's
                over, b = rb + 0.5, self.split[b][0]

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > _MEMO_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self._keeps(a, b, float("inf"))
        return got


class StreamingEncoder:
    """Feed a text in parts; each call gives the ids that became certain. close() gives the rest.

    buf has the characters of the window, back[k] the border before and the piece that ends at border k of it. A piece
    of -2 - c is the character c, which has no piece. Space signs that merged with nothing are counted in spaces.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.v, self.buf, self.back, self.spaces, self.widest = vocab, "", [(0, -1)], 0, 0

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        step = 8 * self.v.longest
        for k in range(0, len(part), step):
            self._extend(part[k : k + step])
            self.widest = max(self.widest, len(self.back))
            if len(self.back) > step:
                out += self._commit()
        return out

    def _extend(self, part: str) -> None:
        v, back, at = self.v, self.back, len(self.buf)
        self.buf = buf = self.buf + part
        reach, get, pairs, compatible = v.reach, v.ids.get, v.pairs, v.compatible
        for end in range(at + 1, len(buf) + 1):
            n = reach.get(buf[end - 2 : end], 1) if end > 1 else 1
            for start in range(end - n if end > n else 0, end):
                i = get(buf[start:end])
                if i is None:
                    continue
                before = back[start][1]
                if before < 0:
                    break
                good = pairs.get((before, i))
                if good or good is None and compatible(before, i):
                    break
            else:
                start, i = end - 1, -2 - ord(buf[end - 1])
            back.append((start, i))

    def _commit(self) -> list[int]:
        """Ids up to the border that the paths to all borders of the window share."""
        back = self.back
        alive = set(range(len(back) - self.v.longest, len(back)))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last][0])
        (meet,) = alive
        out = self._path(meet)
        self.back = [(0, back[meet][1])] + [(a - meet, i) for a, i in back[meet + 1 :]]
        self.buf = self.buf[meet:]
        return out

    def _path(self, at: int) -> list[int]:
        path: list[int] = []
        while at > 0:
            at, i = self.back[at]
            path.append(i)
        out: list[int] = []
        for i in reversed(path):
            if i == self.v.space:
                self.spaces += 1
                continue
            if self.spaces:
                out += self._spaces()
            if i >= 0:
                out.append(i)
            else:
                out += [self.v.byte_ids[b] for b in chr(-2 - i).encode("utf-8")]
        return out

    def _spaces(self) -> list[int]:
        """Pieces of space signs alone tie in score, the lowest: they merge last, from the left."""
        runs, n = self.v.runs, self.spaces
        out = [runs[-1]] * (n // len(runs)) + ([runs[n % len(runs) - 1]] if n % len(runs) else [])
        self.spaces = 0
        return out

    def close(self) -> list[int]:
        out = self._path(len(self.back) - 1) + self._spaces()
        self.__init__(self.v)
        return out


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        sticky, breaks = (re.escape("".join(sorted(x))) for x in (self.v.sticky | {"_"}, self.v.breaks))
        run = rf"(?:[{sticky}]|[^\w{SPACE}\n])*[^\W{sticky}]*"  # other characters, then letters and digits
        more = rf"(?:[{sticky}]|[^\w{SPACE}\n{breaks}])"  # other characters that a piece may join to letters
        whole = self.v.spaced or any("\n" in x for x in self.v.ids)
        self.unit = re.compile(r"[\s\S]+" if whole else rf"\n|(?=[^\n]){SPACE}*{run}(?:{more}{run})*")

    def _encode_unit(self, unit: str) -> bytes:
        got = self.old.get(unit)
        if got is None:
            enc = StreamingEncoder(self.v)
            ids = enc.feed(unit) + enc.close()
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= _MEMO_CHARS:
            self.young[unit] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32."""
        if not text:
            return b""
        if len(self.young) > _MEMO_WORDS:  # units asked for since move on to the next generation
            self.young, self.old = {}, self.young
        memo, one = self.young, self._encode_unit
        return b"".join([memo.get(u) or one(u) for u in self.unit.findall(SPACE + text.replace(" ", SPACE))])

    def decode(self, ids: Iterable[int]) -> str:
        """The text; the space that encoding puts in front goes."""
        known = self.v.bytes
        raw = b"".join([known[i] for i in ids])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_pieces(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds the ids as binary, little-endian uint32. A clashing column is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield with_columns(b, {out_col: pa.array([c.encode(t) for t in texts(b, text_col)], pa.binary())})

    return df.mapInArrow(run, widened(df.schema, {out_col: T.BinaryType()}))


def decode_pieces(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the texts of ids; null ids are none. A clashing column is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield with_columns(b, {out_col: pa.array([c.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(ids_col).to_pylist()], pa.string())})

    return df.mapInArrow(run, widened(df.schema, {out_col: T.StringType()}))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, by number and checksum, and whether they decode to its text."""
    path = model_path()
    both = decode_pieces(encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").to_pylist()
            same = [a == d for a, d in zip(texts(b, "text"), b.column("decoded").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return both.mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
