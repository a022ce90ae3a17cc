"""Language identification by nearest centroid.

A text is a normalised vector of hashed character 1- to 3-grams, weighted by sublinear count and
inverse document frequency. Each language has several centroids, found by spherical k-means among its labelled
texts; a text takes the language of the centroid with the largest cosine.

A text is rejected if its cosine is under half of what is usual in its language at its length. What is usual comes from
labelled rows against centroids that were learnt without them: the median of each length bin (powers of two of the
number of distinct grams, so that repetition adds no length), with straight lines between. Where too many labelled rows
of a language would fall under that, a low quantile of their own shares is the bound.

The model is fitted on a bounded sample of labelled rows of each language (see fit), picked by a hash of doc_id. Prediction reads
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .common import durable, forget, join_small
from .letters import gram_counts

ANY_LETTER = regex.compile(r"\p{L}")
SLICE_CHARS, SLICE_ROWS = 500_000, 128
#: Beyond so many times in one text a gram counts no more: counts of labelled texts travel in 16 bits.
MOST_OF_GRAM = 65_535
#: The least share of the usual cosine that is accepted, the part of labelled rows that may fall under it, and
#: the rows that a language needs for a quantile of its own, and a bin for its median.
SHARE, UNUSUAL, OWN_ROWS, BIN_ROWS = 0.5, 0.003, 200, 5


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    return N.slices([len(t) + SLICE_CHARS // SLICE_ROWS for t in texts], SLICE_CHARS)


class Centroids:
    """The fitted model: idf, centroids with their languages, and the least cosine that is accepted by language and length."""

    def __init__(self, counts: np.ndarray, langs: np.ndarray, clusters: int = 4, rounds: int = 8):
        self.dims = counts.shape[1]
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x = self.vectors(counts)
        self.names = sorted(set(langs))
        self.centres, self.owner = self._cluster(x, langs, clusters, rounds)
        fold, best = np.arange(len(x)) % 2, np.zeros(len(x))
        for f in (0, 1) if len(x) > 1 else ():
            others, _ = self._cluster(x[fold != f], langs[fold != f], clusters, rounds)
            best[fold == f] = (x[fold == f] @ others.T).max(1)
        self._bound((counts > 0).sum(1), best, langs)

    def _cluster(self, x: np.ndarray, langs: np.ndarray, clusters: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, the language number of each)."""
        centres, owner = [], []
        for k, name in enumerate(self.names):
            own = x[langs == name]
            if not len(own):
                continue
            seeds = [own.mean(0)]  # then the text least like the seeds so far
            for _ in range(min(clusters, len(own)) - 1):
                seeds.append(own[np.argmin(np.max(own @ np.stack(seeds).T, 1))])
            c = self._unit(np.stack(seeds))
            for _ in range(rounds):
                near = np.argmax(own @ c.T, 1)
                c = self._unit(np.stack([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
            centres.append(c)
            owner += [k] * len(c)
        return np.concatenate(centres).astype(np.float32), np.array(owner)

    def _bound(self, size: np.ndarray, best: np.ndarray, langs: np.ndarray) -> None:
        """Fit usual (per language: log2 of the distinct grams, cosine) and share (the least accepted part of it)."""
        log, some = np.log2(np.maximum(size, 1)), size > 0
        self.usual, shares = [], []
        for name in self.names:
            own = some & (langs == name)
            bins = [own & (np.floor(log) == b) for b in np.unique(np.floor(log[own]))]
            bins = [b for b in bins if b.sum() >= BIN_ROWS] or bins
            self.usual.append(([0.0, *(log[b].mean() for b in bins)], [0.0, *(np.median(best[b]) for b in bins)]))
            expected = np.interp(log[own], *self.usual[-1])
            shares.append(best[own] / np.maximum(expected, 1e-12))
        every = np.concatenate(shares)
        self.share = [min(SHARE, float(np.quantile(s, UNUSUAL))) if len(s) else 0.0 for s in (s if len(s) >= OWN_ROWS else every for s in shares)]

    def least(self, name: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The least accepted cosine of texts with these language numbers and numbers of distinct grams."""
        log = np.log2(np.maximum(size, 1))
        return np.select([name == k for k in range(len(self.names))], [np.interp(log, *u) * s for u, s in zip(self.usual, self.share, strict=True)])

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of texts. A gram counts MOST_OF_GRAM times at most, where a model is fitted and where it is used."""
        x = np.log1p(np.minimum(counts, MOST_OF_GRAM).astype(np.float32)) * self.idf
        return self._unit(x).astype(np.float32)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, cosine) of each row."""
        cosine = self.vectors(counts) @ self.centres.T
        best = cosine.argmax(1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)


def fit(docs: DataFrame, per_language: int = 800, dims: int = 2048, clusters: int = 4, sample_rows: int = 20_000, least_rows: int = 8) -> Centroids | None:
    """Fit on rows with doc_id, text and lang; None if no row has all three.

    Every language is learnt. The sample that the driver fits on has about `per_language` rows of each; with many languages
    their number falls, so that the sample has about `sample_rows` rows, but not below `least_rows` of each. Rows of a language that repeat
    a doc_id count once, with the least text. Null ids, texts and languages are left out.
    """
    docs = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    hashed = docs.withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)))
    found = durable(hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    rows = min(per_language, max(least_rows, sample_rows // max(1, found.count())))
    # a share of the hash range for each language, which holds one of its rows at least: one row a language
    shares = found.select("lang", F.greatest("first", F.expr(f"bigint({rows}) * {1 << 20} div n")).alias("share"))
    picked = join_small(hashed, shares, "lang").where("at <= share").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["text"])
            for a, b in _slices(texts):
                found = np.minimum(gram_counts(texts[a:b], dims), MOST_OF_GRAM).astype(np.uint16)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[a:b], "lang": pdf["lang"].to_numpy()[a:b], "data": [x.tobytes() for x in found]})

    rows = picked.mapInPandas(features, "doc_id long, lang string, data binary").toPandas()
    forget(found)
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "doc_id", "data"])  # the same model whatever order tasks end in
    return Centroids(np.stack([np.frombuffer(d, np.uint16) for d in rows["data"]]), rows["lang"].to_numpy(), clusters)


def predicted(model: Centroids | None, text: str = "text") -> Column:
    """struct(lang_pred, score, lang_rejected) of a text column; only the texts go to Python.

    score is the cosine, 0 to 1; of centroids with one cosine the first counts, by language and then by order of clusters. A
    null text, or one without a letter, is `und` with score 0 and rejected; so is every text if there is no model. A very
    long text is one slice of its own, in memory linear in its length.
    """

    @F.pandas_udf("lang_pred string, score double, lang_rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            lang, score, least = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in _slices(texts) if model else ():
                counts = gram_counts(texts[a:b], model.dims)
                name, cosine = model.predict(counts)
                least[a:b] = model.least(name, (counts > 0).sum(1))
                letters = np.array([bool(ANY_LETTER.search(t)) for t in texts[a:b]])
                lang[a:b][letters] = np.array(model.names, object)[name[letters]]
                score[a:b][letters] = cosine[letters]
            yield pd.DataFrame({"lang_pred": lang, "score": score, "lang_rejected": (lang == "und") | (score < least)})
            N.release()

    return predict(text)


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """Adds lang_pred, score and lang_rejected of predicted() to docs, which needs only text. Columns of these names are replaced."""
    names = ("lang_pred", "score", "lang_rejected")
    free = next(f"_predicted{k}" for k in range(len(docs.columns) + 1) if f"_predicted{k}" not in docs.columns)
    out = docs.withColumn(free, predicted(model))
    return out.select(*[c for c in docs.columns if c not in names], *[F.col(free)[c].alias(c) for c in names])


def training_rows(docs: DataFrame, parts: int = 3) -> DataFrame:
    """The rows to learn from: crc32 of doc_id as text, modulo `parts`, is not 1."""
    return docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) != 1)


def predict_languages(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_rejected of every document, learnt from those not held out.

    docs: doc_id, text, lang; other columns are ignored. A null doc_id is not held out and not learnt from. Repeated rows are
    predicted as often as they occur, alike; an empty table gives an empty table. Nulls, ties and very long texts: see predicted().
    """
    model = fit(training_rows(docs), per_language)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
