"""MD5 of many short keys at once, for tables whose rows are chosen by hash: an array for each step, no call for each key."""

from __future__ import annotations

from math import floor, sin

import numpy as np

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(floor(abs(sin(k + 1)) * 2**32)) for k in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
BLOCK = 16_384  # keys whose arrays stay in a core's cache


def _registers(words: np.ndarray, length: int, rounds: int) -> tuple[np.ndarray, ...]:
    """The four registers after so many rounds for keys of one length, below 56 bytes. words: one row for each of the
    padded keys' words that may differ from 0."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, x) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    parts = dict(enumerate(words))
    for k in range(rounds):
        if k < 16:  # d ^ (b & (c ^ d))
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
            at = k
        elif k < 32:  # c ^ (d & (b ^ c))
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
            at = (5 * k + 1) % 16
        elif k < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            at = (3 * k + 5) % 16
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
            at = 7 * k % 16
        np.add(f, a, out=f)
        np.add(f, np.uint32((int(_SINES[k]) + (8 * length if at == 14 else 0)) % 2**32), out=f)
        if at in parts:
            np.add(f, parts[at], out=f)
        np.left_shift(f, np.uint32(_SHIFTS[k]), out=g)
        np.right_shift(f, np.uint32(32 - _SHIFTS[k]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return a, b, c, d


def _first_words(words: np.ndarray, length: int) -> np.ndarray:
    """The first 32 bits (little-endian) of the digests. The first register has its final value after 61 of 64 rounds."""
    return _registers(words, length, 61)[1] + _START[0]


def md5_first_eight(keys: np.ndarray) -> np.ndarray:
    """The first eight bytes of the MD5 of each row of bytes, below 56 a row."""
    n, length = keys.shape
    out = np.empty((n, 2), "<u4")
    for first in range(0, n, BLOCK):
        own = keys[first : first + BLOCK]
        padded = np.zeros((len(own), (length // 4 + 1) * 4), np.uint8)
        padded[:, :length] = own
        padded[:, length] = 0x80
        a, b, _, _ = _registers(np.ascontiguousarray(padded.view("<u4").T), length, 64)
        out[first : first + BLOCK, 0], out[first : first + BLOCK, 1] = a + _START[0], b + _START[1]
    return out.view(np.uint8)


def md5_second_bytes(tag: bytes, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The second byte of the MD5 of tag, head, a colon and tail, for whole numbers head and tail >= 0 in decimal digits."""
    out = np.empty(len(heads), np.uint8)
    known, at = np.unique(heads, return_inverse=True)
    prefixes = [tag + b"%d:" % h for h in known.tolist()]
    sizes = np.array([len(p) for p in prefixes], np.int64)
    digits = np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), tails, side="right") + 1
    kinds = sizes[at] * 32 + digits
    for kind in np.unique(kinds).tolist():
        size, n_digits = divmod(kind, 32)
        rows = np.flatnonzero(kinds == kind)
        table = np.zeros((len(known), size), np.uint8)
        for k in np.flatnonzero(sizes == size).tolist():
            table[k] = np.frombuffer(prefixes[k], np.uint8)
        length = size + n_digits
        for own in (rows[k : k + BLOCK] for k in range(0, len(rows), BLOCK)):
            keys = np.zeros((len(own), (length // 4 + 1) * 4), np.uint8)
            keys[:, :size] = table[at[own]]
            left = tails[own].astype(np.int64)
            for k in range(length - 1, size - 1, -1):
                left, digit = np.divmod(left, 10)
                keys[:, k] = digit + 48
            keys[:, length] = 0x80
            words = np.ascontiguousarray(keys.view("<u4").T)
            out[own] = (_first_words(words, length) >> np.uint32(8)).astype(np.uint8)
    return out
