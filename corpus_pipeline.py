"""A training corpus in five stages, each one operator of the subpackage llm.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm import language, mixing, toxicity
from emberfield.llm.common import durable, forget, table
from emberfield.llm.ngram_join import jaccard_join, row_key
from emberfield.llm.packing import pack
from emberfield.llm.queries import tokenizer_path


#: Rows that go to Python at once. Spark's default of 10,000 takes some hundred MB of each worker with texts of usual length.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Limit batches for the session, unless its user has chosen a limit."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language; null texts, those without letters and those far from every centroid go.

    Repeated rows are judged alike. Any further columns stay as they are; an empty table stays empty. A very long text is judged
    whole, as a slice of its own.
    """
    small_batches(spark)
    model = language.fit(language.training_rows(docs))
    return docs.where(~language.predicted(model)["lang_rejected"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier chain does not call toxic, p_toxic below a half.

    A null text is judged as an empty one, a very long one whole. Repeated rows are judged alike. Any further columns stay as they are; an empty table
    stays empty, and without labelled documents every row stays.
    """
    small_batches(spark)
    categories = toxicity.standard_categories()
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), categories)
    return docs.where(toxicity.probabilities(chain, list(categories))["p_toxic"] < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = 500_000) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id.

    Rows are judged one by one, so texts that share a doc_id go or stay on their own; rows without a doc_id stay.
    Of rows that repeat a doc_id and its text, one stays, the same in every run: that whose JSON has the least hash. Texts without
    words stay. Any further columns stay as they are; an empty table stays empty. Texts are read whole, in memory linear in the
    longest. Rows that go are joined by broadcast if they are few, else by shuffle.
    """
    small_batches(spark)
    rows = durable(jaccard_join(docs, width=5, percent=80, keyed=True).where("doc_id IS NOT NULL").select("row_key", "first_key"))
    gone = rows.where("row_key <> first_key").select("row_key").distinct()
    twice = rows.groupBy("row_key").count().where("count > 1").select("row_key")
    docs = docs.select(F.struct("*").alias("row"), row_key().alias("row_key"))  # no column of docs is in the way
    if twice.limit(1).count():  # repeated rows: only these are compared
        again = docs.join(twice, "row_key", "left_semi").withColumn("hash", F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256))
        again = again.groupBy("row_key", F.col("row.doc_id").alias("id"), F.sha2("row.text", 256).alias("text")).agg(F.min_by("row", "hash").alias("row"))
        docs = docs.join(twice, "row_key", "left_anti").unionByName(again.select("row", "row_key"))
    few = gone.limit(most + 1).count() <= most
    return docs.join(F.broadcast(gone) if few else gone, "row_key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them; a document without words may come or go.

    A null source is a source of its own, a null text has no words. Rows that share a doc_id and its text are taken alike. Any further
    columns stay as they are; an empty table stays empty.
    """
    return mixing.mixed(docs, weights=(3, 1, 2), percent=150, most=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, as pack() makes them: nulls, repeated rows, very long texts and
    empty tables too. Further columns are left out."""
    small_batches(spark)
    return pack(docs, tokenizer_path(), window=4096, end_id=2, slice_chars=500_000, shared=False)


STAGES = [
    ("language_id", keep_languages),
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers and tokens are beyond SQL; the tests hold each stage against its own brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
