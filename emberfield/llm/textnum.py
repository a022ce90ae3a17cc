"""Numpy helpers that turn a batch of texts into word hashes.

A word is a maximal run of characters other than space and U+0009..U+000D,
with A-Z lower-cased. A batch becomes one byte array, and every step below is
a whole-array operation, so the cost is some nanoseconds a byte.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (1 << 64))
        x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        return x ^ (x >> U64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), U64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS = [np.zeros(0, U64), np.zeros(0, U64)]
KEPT_POWERS = 2_000_000


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next batch unless a very long text needed them."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    up, down = _powers(_BASE, n + n // 8), _powers(_INVERSE, n + n // 8)
    if n <= KEPT_POWERS:
        _POWERS[:] = up, down
    return up[:n], down[:n]


def release() -> None:
    """Give freed buffers back to the system, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # not glibc


def words(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in text order, first word of each text, one more at the end).

    A null text counts as empty. Texts are joined with spaces, so no word
    crosses two of them; the hash of a word depends on its bytes alone.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    starts_of_text = np.concatenate([[0], np.cumsum(sizes)])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lower = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    first = np.searchsorted(begin, starts_of_text)
    if not len(begin):
        return np.zeros(0, U64), first
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum((lower.astype(U64) + U64(1)) * up[: len(data)], dtype=U64)])
        hashes = (total[end] - total[begin]) * down[begin]
    return mix(hashes), first


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of one text's shingles of `width` words.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, U64)
        for k in range(width):
            out = (out ^ hashes[k : k + n]) * U64(0x9E3779B97F4A7C15)
            out ^= out >> U64(31)
    return np.unique(out)


def slices(sizes, most: int):
    """Ranges of rows whose sizes sum to about `most`, at least one row each."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += int(n)
    if len(sizes) > at:
        yield at, len(sizes)


def packed(x: np.ndarray, width: int = 1) -> bytes:
    """Numbers as `width` bytes each, and the larger ones in full after them."""
    most = (1 << 8 * width) - 1
    x = x.astype("<u8")
    large = x >= U64(most)
    small = np.where(large, U64(most), x).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.uint32(len(x)).tobytes() + np.ascontiguousarray(small.T).tobytes() + x[large].tobytes()


def unpacked(data: bytes, width: int = 1) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, 4).reshape(width, n).T
    out = out.view("<u8").ravel()
    out[out == U64((1 << 8 * width) - 1)] = np.frombuffer(data, "<u8", -1, 4 + n * width)
    return out


def packed_keys(keys: np.ndarray, width: int) -> bytes:
    """Ascending keys by the distance of each to the one before it, in `width` bytes if that is enough."""
    return packed(np.diff(keys, prepend=U64(0)), width)


def unpacked_keys(data: bytes, width: int) -> np.ndarray:
    return np.cumsum(unpacked(data, width), dtype=U64)


def cuts(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Where each shard begins among ascending keys of so many bits: shards are equal ranges of the key's high bits."""
    high = keys >> U64(bits - 32) if bits > 32 else keys << U64(32 - bits)
    return np.searchsorted((high * U64(shards)) >> U64(32), np.arange(shards + 1, dtype=U64))
