"""Vectorised word scanning for Arrow batches of texts.

A batch of texts becomes one UTF-8 byte buffer; words (runs of bytes that are
not ASCII white space) and their 64-bit hashes come from array arithmetic, so
no Python code runs per word.  A word is hashed eight bytes at a time, with a
non-linear mixer after each eight; equal byte strings always have equal hashes,
wherever they stand in the buffer.  Where a decision must not rest on a public
hash, prf() gives words the values of a keyed pseudo-random function (SipHash),
and codes() gives them numbers that are compared byte by byte.
"""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes per block of texts that are scanned together.
BLOCK_BYTES = 1 << 20
#: Words of more bytes than this are hashed one by one, so that steps do not grow with the longest word.
LONG_WORD = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (xor-shift-multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


_STEP = 0x9E3779B97F4A7C15
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _sip_rounds(state: list[np.ndarray], n: int) -> list[np.ndarray]:
    """n rounds of SipHash on four arrays of words."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    a, b, c, d = state
    for _ in range(n):
        a = a + b
        b = turn(b, 13) ^ a
        a = turn(a, 32)
        c = c + d
        d = turn(d, 16) ^ c
        a = a + d
        d = turn(d, 21) ^ a
        c = c + b
        b = turn(b, 17) ^ c
        c = turn(c, 32)
    return [a, b, c, d]


def _absorb(state: list[np.ndarray], block: np.ndarray) -> list[np.ndarray]:
    a, b, c, d = state
    a, b, c, d = _sip_rounds([a, b, c, d ^ block], 2)
    return [a ^ block, b, c, d]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: True for bytes of a word: everything but space and 0x09-0x0D.
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


@dataclass
class Words:
    """Words of consecutive texts: text i owns words first[i]:first[i + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    text_start: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _chunks(self):
        """(words with a k-th eight bytes, their bytes left from there, the eight as little-endian numbers) for k = 0, 1, ...; bytes past a word's end are 0."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eights = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))
        size = self.end - self.start
        who = np.flatnonzero(size <= LONG_WORD)
        left, at = size[who], self.start[who]
        while len(who):
            yield who, left, eights[at] & _FIRST_BYTES[np.minimum(left, 8)]
            more = np.flatnonzero(left > 8)
            who, at, left = who[more], at[more] + 8, left[more] - 8

    def _digests(self, out: np.ndarray, key: bytes = b"") -> np.ndarray:
        """out with the values of long words put in."""
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
        return out

    def hashes(self) -> np.ndarray:
        """One uint64 per word."""
        out = (self.end - self.start).astype(np.uint64)
        for who, _, eight in self._chunks():
            if len(who) == len(out):
                out = mix((out * np.uint64(_STEP)) ^ eight)
            else:
                out[who] = mix((out[who] * np.uint64(_STEP)) ^ eight)
        return self._digests(out)

    def prf(self, key: tuple[int, int]) -> np.ndarray:
        """SipHash-2-4 of each word's bytes under a 128-bit key; BLAKE2b under that key of long words."""
        k0, k1 = np.uint64(key[0]), np.uint64(key[1])
        size = (self.end - self.start).astype(np.uint64)
        # The start of the published function
        state = [np.full(len(size), k ^ np.uint64(c), np.uint64) for k, c in ((k0, 0x736F6D6570736575), (k1, 0x646F72616E646F6D), (k0, 0x6C7967656E657261), (k1, 0x7465646279746573))]
        tail = size << np.uint64(56)  # the last block: the length and the bytes past a multiple of eight
        for who, left, eight in self._chunks():
            short = left < 8
            tail[who[short]] |= eight[short]
            full = who[~short]
            if len(full):
                for v, x in zip(state, _absorb([v[full] for v in state], eight[~short]), strict=True):
                    v[full] = x
        state = _absorb(state, tail)
        state[2] = state[2] ^ np.uint64(0xFF)
        a, b, c, d = _sip_rounds(state, 4)
        return self._digests(a ^ b ^ c ^ d, key[0].to_bytes(8, "little") + key[1].to_bytes(8, "little"))

    def same(self, like: np.ndarray) -> np.ndarray:
        """Whether each word's bytes are those of word like[i]."""
        same = (self.end - self.start) == (self.end - self.start)[like]
        have = np.zeros(len(like), np.uint64)
        for who, _, eight in self._chunks():
            have[who] = eight
            same[who] &= have[like[who]] == eight
        for i in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            j = int(like[i])
            same[i] &= np.array_equal(self.data[self.start[i] : self.end[i]], self.data[self.start[j] : self.end[j]])
        return same

    def bytes_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of some words in a row, their sizes)."""
        sizes = self.end[which] - self.start[which]
        before = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.start[which] - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def codes(self) -> np.ndarray:
        """A number per word: equal for equal words and, unlike a hash, only for these."""
        _, first, code = np.unique(self.hashes(), return_index=True, return_inverse=True)
        if self.same(first[code]).all():
            return code
        seen: dict[bytes, int] = {}
        raw = self.data.tobytes()
        return np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)), np.int64, len(code))

    def sequences(self) -> list[bytes]:
        """The words of each text, joined by one space."""
        data, keep = self.data.copy(), np.zeros(len(self.data) + 1, np.int8)
        keep[self.start] += 1
        keep[self.end + 1] -= 1  # a word and what separates it from the next
        data[self.end] = 0x20
        joined = data[np.cumsum(keep[:-1], dtype=np.int8) > 0].tobytes()
        edge = np.concatenate(([0], np.cumsum(self.end - self.start + 1)))[self.first].tolist()
        return [joined[a : max(a, b - 1)] for a, b in zip(edge, edge[1:], strict=False)]

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def scan(texts: list[bytes], lower: bool = False, table: np.ndarray = _WORD) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; lower maps A-Z to a-z first.

    table may mark other bytes as those of words; it must not mark the line feed.
    """
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    if lower:
        data = _LOWER[data]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text_start = np.concatenate(([0], np.cumsum(sizes)))
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.take(table, data, out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    return Words(data, start, end, np.searchsorted(start, text_start), text_start)


def blocks(texts: list, most: int = BLOCK_BYTES):
    """(offset, encoded texts) in runs of at most `most` bytes, one long text alone; None counts as empty."""
    out, size, at = [], 0, 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if out and size + len(raw) > most:
            yield at, out
            out, size, at = [], 0, i
        out.append(raw)
        size += len(raw) + 1
    if out:
        yield at, out
    release()


def release() -> None:
    """Give freed memory back to the system, as idle Python workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_GRAM = [0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5, 0xF7C2EBC08F67F2B5, 0x8CB92BA72F3D8DD7, 0xAAAAAAAAAAAAAAAB]


def grams(h: np.ndarray, n: int, seed: int = _GRAM[0]) -> np.ndarray:
    """Hash of h[i:i + n] for every i, by a polynomial over word hashes and a mixer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(seed | 1) + h[k : len(h) - n + 1 + k]
        return mix(out + np.uint64(n))


def gram_owner(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, texts) of the n-grams that lie within one text."""
    owner = words.owner()
    if len(owner) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    return at, owner[at]


def exact_grams(code: np.ndarray, n: int) -> np.ndarray:
    """A number for code[i:i + n] for every i: equal for equal sequences of codes and only for these."""
    if len(code) < n:
        return np.empty(0, np.uint64)
    g = grams(mix(code.astype(np.uint64)), n)
    order = np.argsort(g, kind="stable")
    one, two = order[1:], order[:-1]
    equal = g[one] == g[two]
    one, two = one[equal], two[equal]
    if all((code[one + k] == code[two + k]).all() for k in range(n)):
        return g
    out = code[: len(code) - n + 1]
    for k in range(1, n):
        out = np.unique(out.astype(np.int64) * (int(code.max()) + 1) + code[k : len(code) - n + 1 + k], return_inverse=True)[1]
    return out.astype(np.uint64)
