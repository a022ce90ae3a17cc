"""Sum-of-squares packing of documents into fixed windows of tokens.

Each task packs the rows it reads, online: a document's last piece goes to the fill
level that keeps the sum of squared counts of partly filled windows smallest, so levels
stay evenly used and windows fill up. Counts and open windows by level are arrays; a
document costs one pass over the levels, whatever came before. At the end of a task,
the fullest windows still open are filled up with pieces of the emptiest, cut where
a window is full; what the last one holds is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import gc
import itertools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N

#: Characters that str.split() takes for white space and the tokenizer does not, and the mark of special tokens.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


class _Numbers(dict):
    """Numbers chunks as they come; the new ones are listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordTokens:
    """Token ids of whole texts by a tokenizer that never joins what white space parts.

    Ids of a chunk are kept and used again; the memory is emptied of what was met once when it is full. Marks after a
    letter or digit at a chunk's end are tokens of their own, so a chunk is learnt from its stem. Stems of
    letters alone are encoded many to a text, and told apart by the tokenizer's word ends.
    Texts with characters on which the two might differ go to the tokenizer as they are.
    """

    def __init__(self, path: str, most: int = 1_400_000, suffix: str = "</w>"):
        from tokenizers import Tokenizer

        self.encoder, self.most = Tokenizer.from_file(path), most
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.index, self.stems = _Numbers(), {}
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Make room: only chunks that were met again stay."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > self.most // 2:
            return self._clear()
        words = list(self.index)
        self.index, self.stems = _Numbers(), {}
        self.index.update((words[k], n) for n, k in enumerate(keep.tolist()))
        n = self.length[keep]
        first = np.cumsum(n) - n
        self.flat = self.flat[np.repeat(self.start[keep] - first, n) + np.arange(int(n.sum()))]
        self.start, self.length, self.used = first, n, self.used[keep]

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)]

    def _stem_ids(self, stems: list[str]) -> None:
        """Fill self.stems."""
        letters = [s for s in stems if s.isalpha()]
        for k in range(0, len(letters), 400):
            group = letters[k : k + 400]
            ids = self._encode([" ".join(group)])[0]
            cut = (np.flatnonzero(self.ends[np.array(ids, np.int64)]) + 1).tolist() if ids else []
            if len(cut) == len(group):
                self.stems.update(zip(group, (ids[a:b] for a, b in zip([0, *cut], cut)), strict=True))  # noqa: B905
            else:
                self.stems.update(zip(group, self._encode(group), strict=True))
        other = [s for s in stems if not s.isalpha()]
        self.stems.update(zip(other, self._encode(other), strict=True))

    def _learn(self) -> None:
        words, self.index.new = self.index.new, []
        stems = self.stems
        bases = [w.lower() if w.isascii() else w for w in words]
        tails = [""] * len(bases)
        for k, w in enumerate(bases):
            if w[-1] in ".,!?" and len(w) > 1 and w[-2].lower().isalnum():
                bases[k], tails[k] = w[:-1], w[-1]
        stems[""] = []
        self._stem_ids(list((set(bases) | set(tails)) - stems.keys()))
        ids = [stems[b] + stems[t] if t else stems[b] for b, t in zip(bases, tails)]  # noqa: B905
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(length.sum()))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) + len(self.stems) > self.most:
            self._shrink()
        number = self.index.__getitem__
        chunks = [None if any(o in t for o in _ODD) else t.split() for t in texts]
        plain = [c if c is None else np.fromiter(map(number, c), np.int64, len(c)) for c in chunks]
        del chunks
        if self.index.new:
            gc.disable()  # very many lists of ids and no cycles among them: looking for these takes a fifth of the time
            try:
                self._learn()
            finally:
                gc.enable()
        self.used = np.concatenate([self.used, np.zeros(len(self.index) - len(self.used), np.int64)])
        self.used += np.bincount(np.concatenate([np.zeros(0, np.int64), *[a for a in plain if a is not None]]), minlength=len(self.used))
        out = []
        for t, at in zip(texts, plain, strict=True):
            if at is None:
                out.append(np.array(self.encoder.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            n = self.length[at]
            first = np.cumsum(n) - n
            out.append(self.flat[np.repeat(self.start[at] - first, n) + np.arange(int(n.sum()))])
        return out


_KEPT: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The process's tokens of this file: a Python worker that runs several tasks goes on with what it has learnt."""
    if path not in _KEPT:
        _KEPT[path] = WordTokens(path)
    return _KEPT[path]


class Windows:
    """Open windows by fill level. Pieces are (document, start, length)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.moved = 0

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece of at most one window somewhere; returns the window if that fills it."""
        n = piece[2]
        if n == self.size:
            return [piece]
        levels = np.arange(self.size - n + 1)
        # change of the sum of squares; level 0 opens a window, a full window no longer counts
        change = 2 * self.count[n : self.size + 1] + 1
        change[-1] = 0
        change -= np.where(levels > 0, 2 * self.count[: self.size - n + 1] - 1, 0)
        usable = self.count[: self.size - n + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        best = int(change[::-1].argmin())  # the fullest of equals
        level = self.size - n - best
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window.append(piece)
        if level + n == self.size:
            return window
        self.open.setdefault(level + n, []).append(window)
        self.count[level + n] += 1
        return None

    def rest(self) -> Iterator[list[tuple]]:
        """All open windows, filled: the pieces of the emptiest are cut to fill the gaps of the fullest, until one is left,
        whose pieces go to windows of powers of two. `moved` counts the pieces that leave the window of their placement."""
        windows = deque(w for level in sorted(self.open) for w in self.open[level])
        givers: list[tuple] = []  # the next piece is the last
        while windows:
            window = windows.pop()
            gap = self.size - sum(p[2] for p in window)
            while gap and (givers or windows):
                if not givers:
                    givers = windows.popleft()[::-1]
                    self.moved += len(givers)
                    continue
                d, start, n = givers.pop()
                part = min(n, gap)
                window.append((d, start, part))
                gap -= part
                if part < n:
                    givers.append((d, start + part, n - part))
            if gap:  # no other is left: what this one holds is the rest
                self.moved += len(window)
                givers = window[::-1]
            else:
                yield window
        givers = givers[::-1]
        left, room, window = sum(p[2] for p in givers), 0, []
        for d, start, n in givers:
            while n:
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                part = min(n, room)
                window.append((d, start, part))
                start, n, room, left = start + part, n - part, room - part, left - part
                if not room:
                    yield window
                    window = []


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, slice_chars: int = 2_000_000, shared: bool = True) -> DataFrame:
    """Pack whole documents into sequences of at most `window` tokens.

    docs: doc_id and text; other columns are ignored. A null or empty text is its end token
    alone. A document longer than a window fills windows of its own and its remainder is
    placed like any other piece, at the fullest of levels that are equally good. Repeated rows are packed as often as they occur;
    an empty table gives an empty table. Returns one
    row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Sequence ids carry the task's number, so they are unique and come out the same when a task runs again.
    shared: a worker keeps what it learnt of the tokenizer for its next task, which takes some 200 MB; else a task forgets it.
    Each task holds its open pieces' numbers, never more texts than a batch.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, windows = word_tokens(tokenizer) if shared else WordTokens(tokenizer, 200_000), Windows(window)
        base, made = TaskContext.get().partitionId() << 40, 0
        kept: dict[int, tuple] = {}  # of documents with an open piece: id, tokens, open pieces' ids by start
        serial = 0

        def rows(full: list[list[tuple]]) -> pd.DataFrame:
            nonlocal made
            out = []
            for w in full:
                at = 0
                for d, start, n in w:
                    doc_id, tokens, first, ids = kept[d]
                    out.append((doc_id, start, n, zlib.crc32(ids[start - first : start - first + n].tobytes()), tokens, base + made, at))
                    at += n
                made += 1
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            return frame.astype({c: "int64" for c in frame.columns[1:]} | {"doc_id": "Int64"})

        for pdf in batches:
            texts = ["" if t is None else t for t in pdf["text"]]
            ids_of = pdf["doc_id"].tolist()
            for a, b in N.slices([len(t) for t in texts], slice_chars):
                full = []
                for i, ids in enumerate(encode(texts[a:b]), a):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    whole = len(ids) // window * window
                    doc_id = None if pd.isna(ids_of[i]) else int(ids_of[i])
                    for start in range(0, whole, window):
                        kept[serial] = (doc_id, len(ids), 0, ids)
                        full.append([(serial, start, window)])
                    if whole < len(ids):
                        kept[serial] = (doc_id, len(ids), whole, ids[whole:]) if not whole else (doc_id, len(ids), 0, ids)
                        if done := windows.place((serial, whole, len(ids) - whole)):
                            full.append(done)
                    serial += 1
                if full:
                    yield rows(full)
                # only the open pieces stay
                alive = {p[0]: p for level in windows.open.values() for w in level for p in w}
                kept = {d: (kept[d][0], kept[d][1], p[1], kept[d][3][p[1] - kept[d][2] :].copy()) if kept[d][2] != p[1] else kept[d] for d, p in alive.items()}
            N.release()
        if rest := list(windows.rest()):
            yield rows(rest)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(task, out)
