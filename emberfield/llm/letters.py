"""Numpy views of texts as lower-case letters, for the classifiers."""

from __future__ import annotations

import numpy as np

from . import textnum as N

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    """Which code points are letters; planes 0 to 3 by str.isalpha, made once in a process."""
    if not _LETTER[97]:
        _LETTER[: 0x40000] = [chr(c).isalpha() for c in range(0x40000)]
    return _LETTER


def spaced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, first position of each text and the end): texts in lower case, with every run
    of other characters than letters as one space, and a space before and after each text."""
    parts = [f" {t.lower()} " for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    start = np.concatenate([[0], np.cumsum(size)])
    keep = letter | np.concatenate([[True], letter[:-1]])
    keep[start[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, codes, 32)[keep].astype(np.uint32), kept[start]


def gram_counts(texts: list[str], dims: int, most: int = 3) -> np.ndarray:
    """Counts of hashed character 1- to `most`-grams, a row for each text. A gram does not start with a space unless a letter follows."""
    codes, first = spaced(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    out = np.zeros(len(texts) * dims, np.int64)
    wide = codes.astype(N.U64)
    with np.errstate(over="ignore"):
        value = np.zeros(len(codes), N.U64)
        for n in range(1, most + 1):
            value = (value[: len(codes) - n + 1] if n > 1 else value) * N.U64(0x100000001B3) + wide[n - 1 :]
            inside = row[: len(value)] == row[n - 1 :]
            if n == 1:
                inside &= codes != 32
            mixed = (value * N.U64(0x9E3779B97F4A7C15 + 2 * n)) >> N.U64(40)
            out += np.bincount((row[: len(value)] * dims + (mixed % N.U64(dims)).astype(np.int64))[inside], minlength=len(out))
    return out.reshape(len(texts), dims)


def word_features(texts: list[str], space: int, prefixes: tuple[int, ...] = (4, 5, 6)) -> list[np.ndarray]:
    """For each text the distinct hashed features: its words, and their first letters where a word is longer."""
    codes, first = spaced(texts)
    edge = np.diff(np.concatenate([[False], codes != 32, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = N.powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, N.U64), np.cumsum((codes.astype(N.U64) + N.U64(1)) * up[: len(codes)], dtype=N.U64)])
        size = end - begin
        found, row = [], []
        text = np.searchsorted(first, begin, "right") - 1
        for p in (0, *prefixes):
            ok = size > p
            stop = end[ok] if not p else begin[ok] + p
            value = N.mix((total[stop] - total[begin[ok]]) * down[begin[ok]], 31 + p)
            found.append((value % N.U64(space)).astype(np.int64))
            row.append(text[ok])
    both = np.unique(np.concatenate(row) * space + np.concatenate(found))
    cut = np.searchsorted(both, np.arange(len(texts) + 1) * space)
    return [both[cut[i] : cut[i + 1]] - i * space for i in range(len(texts))]
