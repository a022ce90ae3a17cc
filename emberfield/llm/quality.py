"""Document quality by a sparse ensemble of rules.

Statistics of whole texts (shares of capitals, marks, repeated words, and the most extreme line) feed boosted trees of small
depth. Every path from a root to a node is a rule, a conjunction of comparisons of statistics. A logistic regression with an L1
penalty weighs the rules and drops most; those that are left become one Spark column expression, so scoring a table of
statistics needs no Python.

The ensemble is fitted on a bounded sample of about `rows` labelled documents, picked by a hash of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as N

#: The statistics, in order; all but the first three are shares between 0 and 1.
STATISTICS = (
    "log_words", "word_bytes", "line_words", "upper", "digits", "marks", "doubled_marks", "marked_ends", "mark_words",
    "short_words", "long_words", "distinct_words", "repeats", "commonest_word", "distinct_lines",
    "line_upper", "line_doubled", "line_mark_words", "line_repeats", "line_short",
)
LINE_WORDS = 4  # lines of fewer words are not looked at for the extremes
SLICE_BYTES = 500_000


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return np.diff(total[bounds]).astype(float)


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of STATISTICS for each text; all zero for a text that is null or has no word. Letters are ASCII letters and all bytes from 128."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    hashes, first = N.words(texts)
    if not len(hashes):
        return np.zeros((len(texts), len(STATISTICS)))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    mark = ~(space | upper | lower | digit)
    doubled = mark & np.concatenate([[False], data[1:] == data[:-1]])
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - begin
    letters = np.concatenate([[0], np.cumsum(upper | lower, dtype=np.int64)])
    marks_only = letters[end] == letters[begin]
    ends = mark[end - 1] & ~marks_only
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])])
    # lines: from the byte after a line end to the next; the join put one after each text
    line_at = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    line_word = np.searchsorted(begin, line_at)
    line_text = np.searchsorted(text_at, line_at[:-1], "right") - 1
    in_line = np.diff(line_word).astype(float)
    by_text = lambda x: _sums(x, first)
    by_line = lambda x: _sums(x, line_word)
    words, chars = np.diff(first).astype(float), _sums(~space, text_at)
    alphabetic = _sums(upper | lower, text_at)
    long_line = in_line >= LINE_WORDS

    def extreme(share: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        np.maximum.at(out, line_text[long_line], share[long_line])
        return out

    # distinct and commonest words, distinct lines (by the sum of their mixed word hashes)
    order = np.lexsort((hashes, text))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])])
    run, owner = np.diff(np.append(np.flatnonzero(new), len(new))), text[order][new]
    most = np.zeros(len(texts))
    np.maximum.at(most, owner, run)
    full = in_line > 0
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, N.U64), np.cumsum(hashes * (np.arange(len(hashes), dtype=N.U64) - np.repeat(line_word[:-1], np.diff(line_word)).astype(N.U64) + N.U64(1)), dtype=N.U64)])
        line_hash = total[line_word[1:]] - total[line_word[:-1]]
    lines = pd.DataFrame({"t": line_text[full], "h": line_hash[full]})
    n_lines = np.bincount(lines["t"], minlength=len(texts))
    kinds = np.bincount(lines.drop_duplicates()["t"], minlength=len(texts))
    line_letters = _sums(upper | lower, line_at)
    word_doubled = _sums(doubled, np.append(begin, len(data))) > 0
    out = [
        np.log1p(words), _share(chars, words), _share(words, n_lines), _share(_sums(upper, text_at), alphabetic), _share(_sums(digit, text_at), chars),
        _share(_sums(mark, text_at), chars), _share(by_text(word_doubled), words), _share(by_text(ends), words), _share(by_text(marks_only), words),
        _share(by_text(size <= 3), words), _share(by_text(size >= 10), words), _share(np.bincount(owner, minlength=len(texts)), words),
        _share(by_text(same), words), _share(most, words), _share(kinds, n_lines),
        extreme(_share(_sums(upper, line_at), line_letters)), extreme(_share(by_line(word_doubled), in_line)), extreme(_share(by_line(marks_only), in_line)),
        extreme(_share(by_line(same), in_line)), extreme(_share(by_line(size <= 3), in_line)),
    ]
    return np.where(words[:, None] > 0, np.column_stack(out), 0.0)


def text_statistics(text: str = "text") -> Column:
    """struct of the STATISTICS of a text column; only the texts go to Python. A very long text is a slice of its own."""

    @F.pandas_udf(", ".join(f"{c} double" for c in STATISTICS))
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, out = list(batch), np.zeros((len(batch), len(STATISTICS)))
            for a, b in N.slices([len(t) if t is not None else 0 for t in texts], SLICE_BYTES):
                out[a:b] = statistics(texts[a:b])
            yield pd.DataFrame(out, columns=STATISTICS)
            N.release()

    return compute(text)


#: A rule: comparisons (statistic, above, threshold) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


class Trees:
    """Boosted trees for the logistic loss, kept only for the paths in them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.binned = np.column_stack([np.searchsorted(c, v) for c, v in zip(self.cuts, x.T, strict=True)]) + np.arange(x.shape[1]) * bins
        self.bins, self.least, self.rules = bins, least, {}
        score = np.zeros(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            self.gradient, self.hessian = y - p, np.maximum(p * (1 - p), 1e-6)
            score += rate * self._grow(np.arange(len(y)), (), depth, len(y))

    def _grow(self, rows: np.ndarray, path: Rule, depth: int, n: int) -> np.ndarray:
        if path:
            self.rules.setdefault(path, None)
        g, h = self.gradient[rows], self.hessian[rows]
        out = np.zeros(n)
        out[rows] = np.clip(g.sum() / (h.sum() + 1), -4, 4)
        if not depth or len(rows) < 2 * self.least:
            return out
        features = self.binned.shape[1]
        flat = self.binned[rows].ravel()
        size = features * self.bins
        hist = [np.bincount(flat, np.repeat(v, features), size).reshape(features, self.bins).cumsum(1)[:, :-1] for v in (g, h, np.ones(len(rows)))]
        gain = hist[0] ** 2 / (hist[1] + 1) + (g.sum() - hist[0]) ** 2 / (h.sum() - hist[1] + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(hist[2] < self.least) | (len(rows) - hist[2] < self.least)] = -1
        f, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[f, b] <= 1e-6:
            return out
        cut = float(self.cuts[f][b])
        above = self.binned[rows, f] - f * self.bins > b
        out = self._grow(rows[~above], (*path, (int(f), False, cut)), depth - 1, n)
        return out + self._grow(rows[above], (*path, (int(f), True, cut)), depth - 1, n)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """Which rules hold in which rows, as numbers."""
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, above, cut in rule:
            out[:, k] *= (x[:, f] > cut) == above
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> np.ndarray:
    """Weights with the constant last and unpenalised: accelerated proximal gradient on the mean loss plus penalty times the L1 norm."""
    x = np.column_stack([x, np.ones(len(x))])
    step = 4 * len(x) / max(np.linalg.norm(x, 2) ** 2, 1e-9)
    w = ahead = np.zeros(x.shape[1])
    t, shrink = 1.0, np.full(x.shape[1], penalty * step)
    shrink[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        moved = ahead - step * (x.T @ (p - y)) / len(x)
        new = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + (before - 1) / t * (new - w)
    return w


class RuleEnsemble:
    """Weighted rules and a constant. `fit` chooses the penalty by the loss on held-out folds."""

    def __init__(self, rules: list[Rule], weights: np.ndarray, constant: float):
        self.rules, self.weights, self.constant = rules, weights, constant

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, fold: np.ndarray, penalties: tuple[float, ...] = (3e-3, 1e-3, 3e-4), most_rules: int = 400) -> RuleEnsemble:
        rules = list(Trees(x, y).rules)[:most_rules] if 0 < y.sum() < len(y) else []
        held = holds(rules, x)
        kinds, at = np.unique(held, axis=1, return_index=True)  # rules that hold in the same rows are one
        rules, held = [rules[i] for i in at], kinds
        loss = []
        for penalty in penalties if rules else ():
            p = np.full(len(y), y.mean())
            for k in np.unique(fold):
                if 0 < (fold != k).sum():
                    w = lasso_logistic(held[fold != k], y[fold != k], penalty)
                    p[fold == k] = 1 / (1 + np.exp(-np.clip(held[fold == k] @ w[:-1] + w[-1], -30, 30)))
            p = np.clip(p, 1e-9, 1 - 1e-9)
            loss.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if not rules:
            mean = (y.sum() + 0.5) / (len(y) + 1)
            return cls([], np.zeros(0), float(np.log(mean / (1 - mean))))
        w = lasso_logistic(held, y, penalties[int(np.argmin(loss))])
        keep = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
        return cls([rules[i] for i in keep], w[keep], float(w[-1]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(holds(self.rules, x) @ self.weights + self.constant)))

    def column(self, stats: Column) -> Column:
        """The score as one expression over a struct of STATISTICS."""

        def rule(r: Rule) -> Column:
            return reduce(Column.__and__, [stats[STATISTICS[f]] > F.lit(cut) if above else stats[STATISTICS[f]] <= F.lit(cut) for f, above, cut in r])

        terms = [F.when(rule(r), F.lit(float(w))).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)]
        total = reduce(Column.__add__, terms, F.lit(float(self.constant)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, good: Column, rows: int = 10_000, folds: int = 3) -> RuleEnsemble:
    """Fit on labelled documents; `good` is a condition on labels.

    Rows of labels with a null doc_id or condition are left out, and those whose document is missing; a repeated doc_id counts
    once, good if all its labels say so, with its least text. Without labelled documents the ensemble says 0.5.
    """
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("_y")).dropna()
    n = known.count()
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 20)) < min(1 << 20, rows * (1 << 20) // max(1, n) + 1))
    sample = sample.groupBy("doc_id").agg(F.min("_y").alias("_y"))
    # the sample has about `rows` rows of a few bytes, whatever the size of labels
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    got = texts.select("doc_id", "_y", text_statistics().alias("s")).select("doc_id", "_y", "s.*").toPandas().sort_values("doc_id")
    fold = (N.mix(got["doc_id"].to_numpy().astype(np.int64).view(N.U64), 5) % N.U64(folds)).astype(int)
    return RuleEnsemble.fit(got[list(STATISTICS)].to_numpy(float), got["_y"].to_numpy(float), fold)


def rate_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, rows: int = 10_000) -> DataFrame:
    """doc_id, held_out, score (the probability of good quality) and predicted (1 from `threshold` on, else 0) of every document.

    docs: doc_id, text; labels: doc_id, quality (1 is good); other columns are ignored. `held_out` is a condition on doc_id; labels of
    rows where it holds are never read. A null text counts as empty, and empty texts have the score of all-zero statistics. Repeated rows are rated as often as
    they occur, alike; a null doc_id is rated, but never learnt from. Statistics are of whole texts, however long. An empty
    table gives an empty table.
    """
    ensemble = fit(docs, labels.where(~held_out), F.col("quality") == 1, rows)
    rated = docs.select("doc_id", held_out.alias("held_out"), text_statistics().alias("_s"))
    rated = rated.select("doc_id", "held_out", ensemble.column(F.col("_s")).alias("score"))
    return rated.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
