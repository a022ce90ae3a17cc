import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from emberfield.llm import language, mixing, toxicity
from emberfield.llm.queries import tokenizer_path
from tests.llm.test_ngram_join import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_against_brute_force(spark, tmp_path):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = documents.union(documents.limit(3))  # repeated rows
    seen = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        assert k == 4 or out.columns == documents.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.toPandas())
    raw, known, clean, single, mix, pieces = seen
    first = spark.read.parquet(f"{DATA}/documents.parquet").union(documents.limit(3))
    model = language.fit(language.training_rows(first))
    kept = {r["doc_id"] for r in language.identify(first, model).where("NOT lang_rejected").collect()}
    assert set(known.doc_id) == kept and len(known) > 0.97 * len(raw)
    frame = spark.read.parquet(str(tmp_path / "0"))
    names = toxicity.standard_categories()
    chain = toxicity.fit(frame, spark.read.parquet(f"{DATA}/labels.parquet"), names)
    p = chain.predict(list(toxicity.features(list(known.text))))[:, 1]
    assert Counter(clean.doc_id) == Counter(known.doc_id[p < 0.5])
    groups = {i: c for i, _, c, _ in brute(list(zip(clean.doc_id, clean.text, strict=True)))}
    assert Counter(single.doc_id) == Counter(i for i, c in groups.items() if i == c)
    documents = single  # noqa: F841
    want = duckdb.sql(mixing.ORACLE).df()
    assert Counter(mix.doc_id) == Counter({i: n for i, n in zip(want.doc_id, want.copies, strict=True) if n})
    coder = Tokenizer.from_file(tokenizer_path())
    tokens = {i: np.array([*coder.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in zip(mix.doc_id, mix.text, strict=True)}
    assert pieces.length.sum() == sum(len(tokens[i]) for i in mix.doc_id)
    assert all(zlib.crc32(tokens[i][s : s + n].tobytes()) == c for i, s, n, c in zip(pieces.doc_id, pieces.start, pieces.length, pieces.ids_crc32, strict=True))


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_near_copies_go_by_row(spark):
    words = lambda a, n=60: " ".join(f"w{a}x{k}" for k in range(n))
    rows = [(1, words(1)), (1, words(1)), (2, words(1)), (2, words(2)), (3, words(3)), (3, f"{words(3)} more"), (4, None), (4, "!"), (None, words(1)), (5, words(5)), (6, f"{words(5, 48)} " + words(6, 7)), (1, words(7)), (7, words(7))]
    edited = [f"w8x{k}" if k % 46 != 23 else f"other{k}" for k in range(460)]
    rows += [(8, words(8, 460)), (9, " ".join(edited))]  # 406 of 506 five-word shingles shared, 417 of 497 four-word ones
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    three = [k for k in kept if k[0] == 3]
    assert len(three) == 1 and kept.pop(three[0]) == 1  # of two like texts of one id, one
    # 44 of 56 and 51 five-word shingles are shared by 5 and 6: under four fifths
    assert kept == Counter([(1, words(1)), (2, words(2)), (4, None), (4, "!"), (None, words(1)), (5, words(5)), (6, rows[10][1]), (1, words(7)), (8, words(8, 460))])


def test_the_same_one_of_repeated_rows_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, s) for s in ("d", None, "a", "c", "b", "e")] + [(2, "other words", "x"), (2, "other words", "y")]
    kept = set()
    for n in (1, 2, 5):
        docs = spark.createDataFrame(rows[::-1] if n == 2 else rows, "doc_id long, text string, source string").repartition(n)
        kept.add(tuple(sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()))))
    assert len(kept) == 1 and len(next(iter(kept))) == 2


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, lang_rejected boolean, p_toxic double, p_low_quality double, _key string, row_key long, row string, key string, copies int, copy int, _predicted0 int, position long, id long"


def test_stages_leave_other_columns_alone_and_take_empty_tables(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    extra = {"score": "7.5D", "lang_pred": "'mine'", "lang_rejected": "false", "p_toxic": "0.9D", "p_low_quality": "0.8D", "_key": "'k'", "row_key": "doc_id * 2", "row": "'r'", "key": "'own'", "copies": "3", "copy": "4", "_predicted0": "5", "position": "6L", "id": "doc_id"}
    docs = documents.selectExpr("doc_id", "text", "lang", "source", "cast(n_chars as long) n_chars", *[f"{v} AS {k}" for k, v in extra.items()])
    more = spark.createDataFrame([(None, None, None, None, None, *[None] * 14), (100_007, "", "en", "s", 0, *[None] * 14), (100_008, "word " * 200_000, "en", "s", 0, *[None] * 14)], EXTRA)
    docs = docs.select([c.split()[0] for c in EXTRA.split(", ")]).union(more)
    known = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(tuple(r) == known[r["doc_id"]] for r in rows), name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(known)
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), DATA).count() == 0
