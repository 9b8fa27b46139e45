"""Words and hashes of whole texts as array arithmetic over Arrow buffers.

A batch of texts is one byte buffer. Words are runs of bytes of a class; as UTF-8 keeps bytes
below 128 for ASCII alone, classes that hold all of the others split no character. Hashes are
64 bits, taken eight bytes at a time and the same on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Words are runs of anything but the six white-space bytes: ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
#: Words are runs of ASCII letters, digits and all of non-ASCII.
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, the rest unchanged.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for the ordered pair."""
    return mix(a * _C + mix(b ^ _C))


@dataclass
class Words:
    """Words of a batch: where they are in ``raw``, and the text (row) of each."""

    raw: np.ndarray  # bytes, folded
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    n: np.ndarray  # words per row

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each row."""
        return np.cumsum(self.n) - self.n

    def beginnings(self) -> np.ndarray:
        """The first eight bytes of each word (and what follows it, where it is shorter)."""
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        return np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))[self.starts]

    def hashes(self, seed: int = 0) -> np.ndarray:
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        at8 = np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))
        left = self.ends - self.starts
        at = self.starts
        h = mix((at8[at] & _MASK[np.minimum(left, 8)]) ^ mix(left.astype(np.uint64) + np.uint64(seed * 2 + 1)))
        where = np.flatnonzero(left > 8)
        at, left = at[where] + 8, left[where] - 8
        while len(where):
            h[where] = mix(h[where] * _C + (at8[at] & _MASK[np.minimum(left, 8)]))
            more = left > 8
            where, at, left = where[more], at[more] + 8, left[more] - 8
        return h


def buffer(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each (and of the end)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(texts: pa.StringArray, keep: np.ndarray = NOT_SPACE, fold: np.ndarray | None = None) -> Words:
    raw, offsets = buffer(texts)
    if fold is not None:
        raw = fold[raw]
    inside = np.zeros(len(raw) + 2, bool)
    if keep is NOT_SPACE:
        inside[1:-1] = (raw > 32) | (raw < 9) | ((raw > 13) & (raw < 32))
    else:
        inside[1:-1] = keep[raw]
    turns = np.flatnonzero(inside[1:] != inside[:-1])  # where words start and end, in turns
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # texts that meet without a gap
    if len(cuts):
        turns = np.insert(turns, np.repeat(np.searchsorted(turns, cuts), 2), np.repeat(cuts, 2))
    starts, ends = turns[::2], turns[1::2]
    n = np.diff(np.searchsorted(starts, offsets))
    return Words(raw, starts, ends, np.repeat(np.arange(len(n)), n), n)
