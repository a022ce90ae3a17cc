"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another. Each has a logistic regression over the presence of
hashed words and word beginnings and over a few bounded shape features; later models also
get the earlier categories' probabilities. For training these are out-of-fold: made
by models that have not seen the row, so that a later model learns how far to trust them.

The chain is fitted on a bounded sample of about `rows` labelled documents, picked by a hash of
doc_id; features are selected by chi-square on that sample. Prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .letters import word_features

SPACE, BINS = 1 << 20, 12
SLICE_CHARS = 500_000


def _shape(text: str) -> list[int]:
    """Features from SPACE on: bins of the share of repeated words, capitals, marks and digits."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    shares = (len(set(words)) / n, sum(map(str.isupper, words)) / n, text.count("!") / n, text.count("|") / n, sum(map(text.count, "0123456789")) / size * 4)
    return [SPACE + k * BINS + min(BINS - 1, int(s * BINS)) for k, s in enumerate(shares)]


def features(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text."""
    for a, b in N.slices([len(t) for t in texts], SLICE_CHARS):
        for t, words in zip(texts[a:b], word_features(texts[a:b], SPACE), strict=True):
            yield np.concatenate([words, np.array(_shape(t))])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Weights with the constant last, by Newton steps with an L2 penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * weight[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """Models of the categories in turn, on selected features and the probabilities before."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, most: int = 400, least: float = 15.0):
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), list(map(len, rows)))
        held = np.bincount(flat, minlength=SPACE + 5 * BINS).astype(float)
        self.models, before = [], np.zeros((len(rows), 0))
        for y in labels.T.astype(float):
            hit = np.bincount(flat, y[owner], len(held))
            n, m = len(y), y.sum()
            with np.errstate(all="ignore"):
                expect = held * m / n
                chi = np.nan_to_num((hit - expect) ** 2 / np.maximum(expect * (1 - m / n) * (1 - held / n), 1e-9))
            chosen = np.argsort(-chi, kind="stable")[:most]
            chosen = np.sort(chosen[chi[chosen] > least])
            x = np.column_stack([self.dense(rows, chosen), before])
            p = np.empty(n)
            for k in np.unique(fold):
                out = fold == k
                p[out] = _probability(x[out], _logistic(x[~out], y[~out])) if (~out).any() else y.mean()
            self.models.append((chosen, _logistic(x, y)))
            before = np.column_stack([before, p])

    @staticmethod
    def dense(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
        flat, owner = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), list(map(len, rows)))
        at = np.searchsorted(chosen, flat)
        ok = (at < len(chosen)) & (np.append(chosen, -1)[at] == flat)
        out = np.zeros((len(rows), len(chosen)))
        out[owner[ok], at[ok]] = 1
        return out

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        before = np.zeros((len(rows), 0))
        for chosen, w in self.models:
            before = np.column_stack([before, _probability(np.column_stack([self.dense(rows, chosen), before]), w)])
        return before


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = 6000, folds: int = 5) -> Chain | None:
    """Fit a chain on labelled documents. categories: name to a condition on labels, in chain order. None without labelled rows.

    Rows of labels with a null doc_id or category are left out, and those whose document is missing. Documents that repeat a
    doc_id count once, with the least text.
    """
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(f"_y{k}") for k, c in enumerate(categories.values())]).dropna()
    n = known.count()
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < min(1 << 20, rows * (1 << 20) // max(1, n) + 1))
    sample = sample.groupBy("doc_id").agg(*[F.max(f"_y{k}").alias(f"_y{k}") for k in range(len(categories))])
    # the sample has about `rows` rows of a few bytes, whatever the size of labels
    ys = [f"_y{k}" for k in range(len(categories))]
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", *ys).agg(F.min("text").alias("text"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = features(["" if t is None else t for t in pdf["text"]])
            yield pdf.drop(columns="text").assign(data=[x.astype(np.int32).tobytes() for x in found])

    schema = "doc_id long, " + ", ".join(f"{y} boolean" for y in ys) + ", data binary"
    got = joined.mapInPandas(task, schema).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "data"])  # the same model whatever order tasks end in
    found = [np.frombuffer(d, np.int32).astype(np.int64) for d in got["data"]]
    fold = (N.mix(got["doc_id"].to_numpy().astype(np.int64).view(N.U64), 3) % N.U64(folds)).astype(int)
    return Chain(found, got[ys].to_numpy(bool), fold)


def probabilities(chain: Chain | None, categories: list[str], text: str = "text") -> Column:
    """struct of a double p_<category> for each category of a text column; only the texts go to Python.

    A null text counts as empty. Without a chain every probability is 0. A very long text is one slice of its own.
    """
    names = [f"p_{c}" for c in categories]

    @F.pandas_udf(", ".join(f"`{c}` double" for c in names))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.zeros((len(batch), len(names)))
            texts = ["" if t is None else t for t in batch]
            for a, b in N.slices([len(t) + SLICE_CHARS // 128 for t in texts] if chain else [], SLICE_CHARS):
                p[a:b] = chain.predict(list(features(texts[a:b])))
            yield pd.DataFrame(p, columns=names)
            N.release()

    return predict(text)


def score(docs: DataFrame, chain: Chain | None, categories: list[str]) -> DataFrame:
    """Adds the columns of probabilities() to docs, which needs only text. Columns of these names are replaced."""
    names = [f"p_{c}" for c in categories]
    free = next(f"_predicted{k}" for k in range(len(docs.columns) + 1) if f"_predicted{k}" not in docs.columns)
    out = docs.withColumn(free, probabilities(chain, categories))
    return out.select(*[c for c in docs.columns if c not in names], *[F.col(free)[c].alias(c) for c in names])


def standard_categories() -> dict[str, Column]:
    """The categories that the labels table knows: poor quality, then toxicity."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def rate_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = 6000) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and the decision toxic (p_toxic of at least `threshold`) for every document.

    docs: doc_id, text; labels: doc_id, quality, toxic; other columns are ignored. A null text counts as empty; a null doc_id is
    rated, but never learnt from. Repeated rows are rated as often as they occur, alike; labels that repeat a doc_id count once,
    toxic or of poor quality if one of them says so. Without labelled documents nothing is toxic; an empty table gives an empty table.
    """
    categories = standard_categories()
    out = score(docs.select("doc_id", "text"), fit(docs, labels, categories, rows), list(categories))
    return out.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"))
