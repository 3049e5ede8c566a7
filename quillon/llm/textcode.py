"""Byte-level text primitives in numpy: word bounds and the hashes of arbitrary substrings.

A text's prefix hash is H[i] = sum of b[j] * B**j for j < i, modulo 2**64. B is odd, so it has an inverse
and the hash of bytes i..k is (H[k] - H[i]) * B**-i whatever stands before them: one cumulative sum
hashes every word, stem and character n-gram of a text without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are worked on in pieces of at most this many bytes, cut at white space where there is any.
PIECE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE, PIECE + 1), _powers(INVERSE, PIECE + 1)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words whose high bits depend on all input bits."""
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of at most PIECE bytes, cut after any ASCII white space; a word is divided only if it is longer than a piece."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        cut = max(data.rfind(bytes([c]), at, end) for c in np.flatnonzero(_SPACE))
        end = cut + 1 if cut > at else end
        yield data[at:end]
        at = end
    yield data[at:] if at else data


class Coded:
    """The words of one piece: bytes, bounds and substring hashes."""

    def __init__(self, data: bytes, space_only: bool):
        """space_only: words are runs without ASCII white space; else runs of letters and digits (all bytes over 127 included)."""
        b = np.frombuffer(data, np.uint8)
        inside = ~_SPACE[b] if space_only else _WORD[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
        self.bytes, self.starts, self.ends = b, edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[: len(b)], dtype=np.uint64)))

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes before mixing: that of two strings in a row is the first's and B**(its length) times the second's."""
        with np.errstate(over="ignore"):
            return (self.prefix[ends] - self.prefix[starts]) * _DOWN[starts]

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))

    def words(self) -> np.ndarray:
        return self.between(self.starts, self.ends)


def word_hashes(data: bytes, space_only: bool = True) -> np.ndarray:
    """64-bit hashes of the words of data, in order; a word that pieces divide is one word."""
    if len(data) <= PIECE:
        return Coded(data, space_only).words()
    found, open_, size = [], 0, 0  # hash and length of the word that the last piece ended in
    for p in pieces(data):
        c = Coded(p, space_only)
        raw = c.raw(c.starts, c.ends)
        ended = bool(size)
        if size and len(raw) and not c.starts[0]:
            raw[0] = np.uint64((open_ + int(raw[0]) * pow(BASE, size, 1 << 64)) % (1 << 64))
            ended = False
        if ended:
            found.append(np.array([open_], np.uint64))
        if len(raw) and c.ends[-1] == len(p):
            joined = size if len(raw) == 1 and not c.starts[0] and not ended else 0
            open_, size = int(raw[-1]), joined + int(c.ends[-1] - c.starts[-1])
            raw = raw[:-1]
        else:
            size = 0
        found.append(raw)
    if size:
        found.append(np.array([open_], np.uint64))
    return mix(np.concatenate(found))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; with fewer words the whole sequence is one; without words there are none."""
    k = min(n, len(words))
    if not k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(BASE) + words[i : len(words) - k + 1 + i])
    return out
