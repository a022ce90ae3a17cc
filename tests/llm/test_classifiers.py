import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.llm import language, letters, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_gram_counts_by_hand():
    out = letters.gram_counts(["aB  9b", "", "ab b"], 64)
    assert (out[0] == out[2]).all() and out[1].sum() == 0
    # a b b; " a" "ab" "b " " b" "b "; " ab" "ab " "b b" " b "
    assert out[0].sum() == 3 + 5 + 4


def test_word_features_are_per_text():
    a, b, both = letters.word_features(["Abcdefg!", "x-abcd", "abcdefg x abcd"], 1 << 20)
    assert set(a) | set(b) == set(both) and len(a) == 4 and len(b) == 2


def test_language_rows(spark):
    rows = [(i, ("the cat and that hat " if i % 2 else "der hund und das haus ") * 5, "en" if i % 2 else "de", "x") for i in range(90)]
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "12 !?", "de", "x"), (1003, "that hat", None, "x"), (None, "das haus", "de", "x"), (1004, "das haus " * 50000, None, "x"), (1003, "that hat", None, "x")]
    got = {r["doc_id"]: r for r in language.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()}
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["lang_rejected"]) == ("und", 0.0, True)
    assert got[1003]["lang_pred"] == "en" and got[1004]["lang_pred"] == "de" and got[None]["held_out"] is False
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(1200):  # each language has letters of its own
        letters_ = [chr(0x4E00 + 6 * k + c) for c in range(6)]
        rows += [(3 * len(rows), " ".join("".join(rng.choice(letters_, 3)) for _ in range(12)), f"lang{k:04}") for _ in range(2)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dims=512, clusters=1)
    assert len(model.names) == 1200
    got = language.identify(spark.createDataFrame(rows[::40], "doc_id long, text string, lang string"), model).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95


def test_predictions_equal_brute_force(spark):
    """Grams, weights and cosines by dictionaries, with the fitted centroids."""
    rows = [(i, ("the cat and that hat " if i % 2 else "der hund und das haus ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(80)] + [(900, "das hat the und", None), (901, "Zwölf cats!", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, dims=256)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    for i, text, _ in rows:
        count = letters.gram_counts([text], 256)[0]
        v = {d: math.log1p(int(c)) * float(model.idf[d]) for d, c in enumerate(count) if c}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [(sum(x * float(c[d]) for d, x in v.items()) / norm, -k) for k, c in enumerate(model.centres)]
        best, k = max(cosines)
        assert got[i] == (model.names[model.owner[-k]], pytest.approx(best, abs=1e-5))


def test_language_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.predict_languages(empty).collect() == []
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.predict_languages(none).first()["lang_pred"] == "und"


@needs_data
def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language.predict_languages(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").toPandas()
    right = out["lang"] == out["lang_pred"]
    assert right.mean() > 0.98 and right[out["n_chars"] > 200].mean() > 0.99
    assert out["lang_rejected"].mean() < 0.01


@needs_data
def test_foreign_texts_and_random_words_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    rng = np.random.default_rng(3)
    words = lambda k, low, n: " ".join("".join(chr(low + c) for c in rng.integers(0, n, rng.integers(2, 10))) for _ in range(k))
    finnish = "Tämä on suomenkielinen kappale, jossa kerrotaan metsäpalojen jälkeisestä maaston kartoituksesta. Tutkijat kävelevät suolla ja mittaavat turpeen syvyyttä useissa kohdissa. "
    polish = "Każdy człowiek ma prawo do wolności i bezpieczeństwa swojej osoby. Nie wolno nikogo czynić niewolnikiem ani nakładać na nikogo służebności. "
    foreign = [finnish, finnish * 8, polish, polish * 8] + [words(k, low, n) for k in (20, 200, 1000) for low, n in ((97, 26), (0x430, 32))]
    labelled = docs.where("n_chars BETWEEN 3 AND 400").orderBy("doc_id").limit(40).toPandas()["text"].tolist()  # short, but labelled
    rows = [(i, t) for i, t in enumerate([*foreign, *labelled])]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).toPandas().set_index("doc_id").sort_index()["lang_rejected"]
    letters_in = np.array([bool(language.ANY_LETTER.search(t)) for _, t in rows])
    assert out[: len(foreign)].all()
    assert letters_in[len(foreign) :].sum() > 5 and not out[len(foreign) :][letters_in[len(foreign) :]].any()


@needs_data
def test_repetition_does_not_reject(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    text = docs.where("lang = 'en' AND n_chars BETWEEN 300 AND 600").orderBy("doc_id").first()["text"]
    out = language.identify(spark.createDataFrame([(1, text), (2, f"{text} " * 40)], "doc_id long, text string"), model)
    assert not any(r["lang_rejected"] for r in out.collect())


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.3
    second = first & (rng.random(600) < 0.9)
    rows = [np.unique(np.append(rng.integers(1000, 9000, 20), 7 if f else 8)) for f in first]
    chain = toxicity.Chain(rows, np.stack([first, second], 1), np.arange(600) % 5)
    p = chain.predict(rows)
    assert ((p[:, 0] > 0.5) == first).mean() > 0.97 and ((p[:, 1] > 0.5) == second).mean() > 0.9
    assert len(chain.models[1][1]) == len(chain.models[1][0]) + 2


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "vile words", "x")], "doc_id long, text string, p_toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["toxic"] for r in toxicity.rate_toxicity(docs, none).collect()] == [False] * 4
    some = spark.createDataFrame([(1, 1, 0), (2, None, 1), (9, 0, 1), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.rate_toxicity(docs, some).count() == 4
    assert toxicity.rate_toxicity(docs.limit(0), some).count() == 0


def test_toxicity_equals_brute_force(spark):
    """The chain's weights applied by hand; a tie at the threshold is toxic; a very long text is read to its end."""
    rng = np.random.default_rng(1)
    common = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, " ".join([*rng.choice(common, 12), *(["foul"] if i % 4 == 0 else []), *(["bad"] if i % 3 == 0 else [])])) for i in range(240)]
    docs = spark.createDataFrame([*rows, (999, "alpha " * 300_000 + "foul"), (998, "alpha " * 300_000)], "doc_id long, text string")
    names = toxicity.standard_categories()
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, names)
    out = {r["doc_id"]: r for r in toxicity.rate_toxicity(docs, labels).collect()}
    for i, text in rows[:40]:
        own, before = set(next(toxicity.features([text])).tolist()), []
        for chosen, w in chain.models:
            x = [float(c in own) for c in chosen.tolist()] + before
            before.append(1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, w[:-1], strict=True)) + w[-1]))))
        assert (out[i]["p_low_quality"], out[i]["p_toxic"]) == (pytest.approx(before[0], abs=1e-9), pytest.approx(before[1], abs=1e-9))
        assert out[i]["toxic"] == (i % 4 == 0)
    assert out[999]["toxic"] and not out[998]["toxic"]
    tie = out[5]["p_toxic"]
    assert {r["doc_id"]: r["toxic"] for r in toxicity.rate_toxicity(docs, labels, threshold=tie).collect()}[5]


@needs_data
def test_toxicity_on_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where(F.col("doc_id") % 2 == 0)
    out = toxicity.rate_toxicity(docs, fitted).join(labels.where(F.col("doc_id") % 2 == 1).withColumnRenamed("toxic", "truth"), "doc_id").toPandas()
    caught = out.loc[out["truth"] == 1, "toxic"].mean()
    wrong = out.loc[out["truth"] == 0, "toxic"].mean()
    assert wrong < 0.05 and caught > 0.5  # some twenty toxic rows to learn from


def test_numbers_in_other_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta", "en") for i in range(30)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    texts = ["\u00b2", "\u00bd 12", "\u2460_\u0967", "\u2167", "a\u00b2", "\u4e2d", "\u02b0"]  # powers, fractions, circled and other digits, a Roman numeral sign; letters
    got = language.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, True, False, False, False]


def test_counts_are_cut_alike_in_fitting_and_use():
    counts = np.random.default_rng(0).integers(0, 9, (40, 64)).astype(np.int64)
    model = language.Centroids(counts, np.array(["a", "b"] * 20))
    counts[0, 3] = 10**6
    cut = np.minimum(counts, language.MOST_OF_GRAM)
    assert np.array_equal(model.vectors(counts), model.vectors(cut))
