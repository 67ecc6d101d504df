"""Coins from md5, many at once: whether the md5 of seed|replicate|row begins with a bit 0, as `safe.uniform` < 0.5 has it."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
#: A message of one block, and how many coins are made at once.
SHORT, COINS = 55, 1 << 16


def _words(parts: list[bytes], at: int, end: bool) -> np.ndarray:
    """Words of one block per part, which begins at byte `at`; with `end`, the message ends with it."""
    raw = np.zeros((len(parts), 64), np.uint8)
    for row, part in zip(raw, parts, strict=True):
        row[at : at + len(part)] = np.frombuffer(part, np.uint8)
        if end:
            row[at + len(part)] = 0x80
            row[56:60] = np.frombuffer(np.uint32(8 * (at + len(part))).astype("<u4").tobytes(), np.uint8)
    return raw.view("<u4").astype(np.uint32)


def _first_bits(heads: list[bytes], rows: list[bytes]) -> np.ndarray:
    """Rows by heads: the first bit of md5(head + row). Heads are equally long, messages of one block."""
    size = len(heads[0])
    head, row = _words(heads, 0, False), _words(rows, size, True)
    message = [row[:, k, None] + head[None, :, k] if 4 * k < size else row[:, k, None] for k in range(16)]
    shape = len(rows), len(heads)
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the digest's first word is set by then
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += message[k] + np.uint32(_SINES[i])
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        f <<= np.uint32(turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(_START[0]) >> np.uint32(7)) & np.uint32(1)


def tails(seed: str, first: int, last: int, rows: list[str | None]) -> np.ndarray:
    """Rows by replicates first to last: 1 where the coin shows tails (the first bit is 0)."""
    out = np.empty((len(rows), last - first + 1), np.int8)
    keys = [None if r is None else r.encode() for r in rows]
    lo = first
    while lo <= last:  # replicates of as many digits
        hi = min(last, 10 ** len(str(lo)) - 1)
        heads = [f"{seed}|{r}|".encode() for r in range(lo, hi + 1)]
        short = [i for i, k in enumerate(keys) if k is not None and len(heads[0]) + len(k) <= SHORT]
        step = max(1, COINS // len(heads))
        for at in range(0, len(short), step):
            some = short[at : at + step]
            out[some, lo - first : hi - first + 1] = 1 - _first_bits(heads, [keys[i] for i in some])
        for i in set(range(len(keys))) - set(short):  # long or missing ids, one by one
            texts = [h + keys[i] if keys[i] is not None else h[:-1] for h in heads]
            out[i, lo - first : hi - first + 1] = [hashlib.md5(x).digest()[0] < 128 for x in texts]
        lo = hi + 1
    return out
