"""Words, word windows and their hashes, vectorised over the raw UTF-8 of many texts at once.

`span_hash` and `Windows` are quick and can be made to collide: they serve where a collision only adds a candidate or a
feature. What decides a result is named exactly (`names`, `run_names`) or by 128 bits of BLAKE2b (`digests`).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All of those bytes are ASCII, so looking at bytes and
looking at code points gives the same words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate runs of letters: ASCII other than A-Z and a-z.
NOT_LETTER = np.arange(256) < 128
NOT_LETTER[[*range(65, 91), *range(97, 123)]] = False
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEQ = 0xD6E8FEB86659FD93 | 1
_POWERS: dict[int, np.ndarray] = {}
#: Words of more bytes are hashed one by one by a cryptographic hash.
LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 19), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 22:  # powers for a huge text are not kept
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


class Words:
    """Words of a slice of texts: byte spans, the range of words of each text, and a hash per word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold_case: bool = False, between: np.ndarray = _SPACE):
        n = len(raw)
        inside = ~between[raw]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[offsets] = False  # a word does not run on into the next text
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[offsets] = False
        self.start = np.flatnonzero(inside & ~before[:n])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.raw = _LOWER[raw] if fold_case else raw
        self._padded = None

    def __len__(self) -> int:
        return len(self.start)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of raw[start:end] for many spans: eight bytes at a time, each block stirred into what came before."""
        if self._padded is None:
            self._padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.raw) + 1, "<u8", self._padded, strides=(1,))
        left = np.asarray(end - start)
        h = mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        h = mix(h ^ (eight[start] & _FIRST_BYTES[np.minimum(left, 8)]))
        going = np.flatnonzero((left > 8) & (left <= LONG_WORD))
        for k in range(8, LONG_WORD, 8):
            if not len(going):
                break
            h[going] = mix(h[going] ^ (eight[start[going] + k] & _FIRST_BYTES[np.minimum(left[going] - k, 8)]))
            going = going[left[going] > k + 8]
        for i in np.flatnonzero(left > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.raw[start[i] : end[i]], digest_size=8).digest(), "little")
        return h

    def _encoded(self) -> pa.DictionaryArray:
        n = len(self)
        size = self.end - self.start
        offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        data = self.raw[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return words.dictionary_encode()

    def names(self) -> np.ndarray:
        """A number per word; words of these texts have the same one only if they are the same word."""
        return np.asarray(self._encoded().indices).astype(np.int64)

    def named_digests(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' names, and by name the two 64-bit halves of the word's BLAKE2b digest."""
        encoded = self._encoded()
        each = [hashlib.blake2b(w, digest_size=16).digest() for w in encoded.dictionary.to_pylist()]
        return np.asarray(encoded.indices).astype(np.int64), np.frombuffer(b"".join(each), np.uint64).reshape(-1, 2)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def run_names(words: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n consecutive words, given as exact numbers: the same only for the same run.

    Runs are named by doubling: a run of 2k words is the pair of its halves' names, so no name is a hash.
    """

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = min(len(a), len(b))
        return np.unique(a[:m] * (int(b.max(initial=0)) + 1) + b[:m], return_inverse=True)[1].astype(np.int64)

    out, have, power, reach = words, 0, words, 1
    while True:
        if n & reach:
            out = paired(out, power[have:]) if have else power
            have += reach
        if have == n:
            return out
        power, reach = paired(power, power[reach:]), 2 * reach


class Windows:
    """Hashes of runs of consecutive words."""

    def __init__(self, hashes: np.ndarray, base: int = _SEQ):
        self.sums = _sums(hashes * powers(base, len(hashes)))
        self.inv = powers(inverse(base), len(hashes) + 1)

    def at(self, start: np.ndarray, n) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.inv[start] + np.asarray(n, np.uint64))


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window of n words fits into its text, and how many each text has."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    total = int(count.sum())
    begin = np.cumsum(count) - count
    return np.arange(total) - np.repeat(begin - first[:-1], count), count
