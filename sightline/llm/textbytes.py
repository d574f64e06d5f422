"""Words, word hashes and shingles of many texts at once, on their UTF-8 bytes.

Both word classes used here end at ASCII bytes, so a word never cuts a
multi-byte character and everything can be done on one byte buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space that separates words of [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: The bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_cache: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _cache.get(name)
    if have is None or len(have) < n:
        have = _cache[name] = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def blocks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text each, one row at least."""
    n = len(texts)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


class Words:
    """The words of some texts, in order, as byte ranges of one padded buffer."""

    def __init__(self, texts: pa.Array, word: np.ndarray, lower: bool):
        """texts: strings, null counts as empty; word: which bytes belong to words."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        padded = pc.binary_join_element_wise(filled, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        if isinstance(padded, pa.ChunkedArray):
            padded = padded.combine_chunks()
        n = len(padded)
        off = np.frombuffer(padded.buffers()[1], np.int64, n + 1, padded.offset * 8)
        raw = np.frombuffer(padded.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
        self.buf = LOWER[raw] if lower else raw
        self._sums: np.ndarray | None = None
        self.doc_off = off - off[0] if n else np.zeros(1, np.int64)
        inside = word[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(inside) else np.zeros(0, np.int64)
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]  # every text ends in a space, so edges pair up
        #: word_off[d]: the first word of text d
        self.word_off = np.searchsorted(self.starts, self.doc_off)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.word_off)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.word_off) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every block."""
        return self.range_hashes(self.starts, self.ends)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range, equal for equal bytes."""
        n = len(self.buf)
        if not len(starts):
            return np.zeros(0, np.uint64)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_SALT[self.buf] * _power("up", int(_ODD), n), dtype=np.uint64, out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * _power("down", _inverse(int(_ODD)), n)[starts])

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words joined by one space: the bytes (with eight spare ones), each word's start and length."""
        keep = np.zeros(len(self.buf), bool)
        size = self.ends - self.starts
        # mark word bytes and the one separator behind each
        step = np.zeros(len(self.buf) + 1, np.int8)
        step[self.starts] = 1
        step[self.ends + 1] -= 1
        keep = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        out = np.concatenate([self.buf[keep], np.zeros(8, np.uint8)])
        at = np.cumsum(size + 1) - (size + 1)
        out[at + size] = 0x20
        return out, at, size


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, len(h) - k + 1 of them; texts' borders are the caller's matter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, width, level = None, 0, 1, h.copy()
    while True:
        if k & width:
            part = level[at : at + n]
            out = part.copy() if out is None else mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
            at += width
        width *= 2
        if width > k:
            return out
        half = width // 2
        level = mix(level[:-half] * np.uint64(0xA0761D6478BD642F) + level[half:]) if len(level) > half else level[:0]


#: The primes of the XXH64 specification.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of the byte ranges [at, at + size) of buf, which has eight spare bytes at its end."""
    import xxhash

    out = np.zeros(len(at), np.uint64)
    wide = np.ndarray((max(0, len(buf) - 7),), "<u8", buf, strides=(1,))
    short = size < 32
    i = np.flatnonzero(short)
    if len(i):
        order = i[np.argsort(size[i], kind="stable")]
        p, n = at[order].copy(), size[order]
        acc = np.uint64(seed) + _P5 + n.astype(np.uint64)
        for lane in range(3):
            f = int(np.searchsorted(n, 8 * (lane + 1)))  # from here on they have this lane
            if f == len(n):
                break
            k = wide[p[f:]] * _P2
            k = _rot(k, 31) * _P1
            acc[f:] = _rot(acc[f:] ^ k, 27) * _P1 + _P4
            p[f:] += 8
        rest = n - (p - at[order])
        four = np.flatnonzero(rest >= 4)
        if len(four):
            k = (wide[p[four]] & np.uint64(0xFFFFFFFF)) * _P1
            acc[four] = _rot(acc[four] ^ k, 23) * _P2 + _P3
            p[four] += 4
            rest[four] -= 4
        for b in range(3):
            one = np.flatnonzero(rest > b)
            if len(one):
                k = buf[p[one] + b].astype(np.uint64) * _P5
                acc[one] = _rot(acc[one] ^ k, 11) * _P1
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
        out[order] = acc
    long = np.flatnonzero(~short)
    if len(long):
        view = memoryview(buf)
        digest = xxhash.xxh64_intdigest
        out[long] = np.fromiter((digest(view[a : a + s], seed) for a, s in zip(at[long].tolist(), size[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def segment_sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of x over [off[i], off[i+1]), zero for empty ranges."""
    sums = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]
