"""Words, lines and n-grams of many texts at once, on NumPy arrays over UTF-8 bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Those separators are ASCII, so
cutting the UTF-8 bytes gives the same words as cutting code points.  Every function works on a
*block*: whole texts of some rows, laid end to end.  Blocks hold about ``BLOCK_BYTES`` bytes, or a
single longer text, so memory follows the longest text and not the Arrow batch.

Fingerprints are 64-bit.  A word's bytes are taken eight at a time, each step multiplied and then
scrambled by a bijection; longer ranges go to BLAKE2.  Sequences are hashed as trees of pairs, scrambled
at each node, so no two sequences collide by their form.  There are two independent families; they are the
same on every machine and in every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
#: Odd multipliers and seeds of the two families of fingerprints.
_STEP = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
_SEED = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))
_PAIR = (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))
#: Ranges of more bytes are hashed by BLAKE2.
_LONG = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0x9FB21C651E98DF25)
    x ^= x >> _U(32)
    return x


@dataclass
class Block:
    """Rows ``first`` to ``first + n`` of a batch: ``data`` bytes cut at ``offsets`` (n + 1 of them)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole texts of an Arrow string column, null as empty, about ``limit`` bytes at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield Block(at, raw[off[at] : off[end]], off[at : end + 1] - off[at])
        at = end


@dataclass
class Words:
    """Words of a block: byte ranges, the text each belongs to, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


#: The separators and all ASCII punctuation and control characters.
NOT_PLAIN = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)], bool)


def words(block: Block, separator: np.ndarray = SEPARATOR) -> Words:
    """Runs of bytes that are no separators, inside each text."""
    inside = ~separator[block.data]
    edge = np.zeros(len(block.data) + 1, bool)
    edge[block.offsets] = True
    start, end = inside.copy(), inside.copy()
    if len(inside):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    bounds = np.searchsorted(s, block.offsets)
    return Words(s, e, np.repeat(np.arange(block.n), np.diff(bounds)), bounds)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each byte range."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) * _STEP[which] + _SEED[which])
    long_ = size > _LONG
    rest = np.flatnonzero((size > 0) & ~long_)
    at = 0
    while len(rest):
        part = eight[start[rest] + at] & _LOW_BYTES[np.minimum(size[rest] - at, 8)]
        out[rest] = mix((out[rest] ^ part) * _STEP[which] + _SEED[which])
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(long_).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def gram_hashes(values: np.ndarray, at: np.ndarray, size: np.ndarray | int, which: int = 0) -> np.ndarray:
    """A fingerprint of values[at : at + size] for each at.

    A range is cut into parts of 1, 2, 4... values by the bits of its size; a part is a tree of pairs.
    """
    at = np.array(at, np.int64)
    size = np.asarray(size, np.int64)
    most = int(size.max()) if size.size else 0
    out = mix(np.zeros(len(at), np.uint64) + size.astype(np.uint64) * _STEP[which] + _SEED[which])
    part, width = values, 1
    while width <= most and len(at):
        if size.ndim:
            some = np.flatnonzero(size & width)
            out[some] = mix((out[some] ^ part[at[some]]) * _STEP[which] + _SEED[which])
            at[some] += width
        elif size & width:
            out = mix((out ^ part[at]) * _STEP[which] + _SEED[which])
            at += width
        if width * 2 <= most:
            part = mix(part[:-width] * _PAIR[which] ^ mix(part[width:] + _SEED[which]))
        width *= 2
    return out


def gram_starts(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all n-grams that stay inside one text, and the text of each."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    of = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(len(of)) - first[of] + bounds[:-1][of], of


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n positions lies in one of the half-open ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i] : bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
