"""Tables with one row a key, kept in hash buckets of which a batch rewrites only those that it touches.

Under a table's path, data/v=<batch>/bucket=<b> holds the rows of a bucket as that batch left them, and manifest/batch_id=<batch> says
for every bucket which version is current. A manifest has no more rows than there are buckets. A batch reads the manifest before
its own, so a batch that is run again overwrites its own version and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "bucket int, version long"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder if it is there."""
    at, files = _path(spark, path)
    files.delete(at, True)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers in the names of folders <prefix><number>, ascending."""
    at, files = _path(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """bucket to version after the last batch, or the last before a given one."""
    known = [n for n in _numbers(spark, f"{path}/manifest", "batch_id=") if before is None or n < before]
    if not known:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/batch_id={known[-1]}").collect()}


def _rows(spark: SparkSession, path: str, schema: StructType, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())])


def merge_batch(batch: DataFrame, path: str, batch_id: int, key: tuple[str, ...], order: tuple[str, ...], buckets: int = 64) -> list[int]:
    """Merge rows by key into the table at `path`: of the rows of a key the one with the largest `order` columns, then the largest others, stays. Returns the buckets touched.

    Batches in any order, and repeated ones, give the same table. Each touched bucket is one file, written by one task: set
    `buckets` so that a bucket fits one. It is fixed for the life of a table.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in (*key, *order)]
    rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
    touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # no more than there are buckets
    before = _manifest(spark, path, batch_id)
    old = _rows(spark, path, batch.schema, {b: before[b] for b in touched if b in before})
    old = old.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    last = rows.unionByName(old).groupBy("bucket", *key).agg(F.max(F.struct(F.lit(0).alias("bucket"), *order, *rest)).alias("m"))
    merged = last.select("bucket", *[F.col("m")[c].alias(c) if c in (*order, *rest) else F.col(c) for c in batch.columns])
    if touched:
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={batch_id}")
    now = before | dict.fromkeys(touched, batch_id)
    spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch_id={batch_id}")
    rows.unpersist()
    return touched


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table after the last batch."""
    return _rows(spark, path, schema, _manifest(spark, path))


def compact(spark: SparkSession, path: str, log_path: str | None = None) -> None:
    """Delete what neither of the last two manifests needs (the last batch may be run again), and the folders of a log
    (batch_id=<n>) whose batches are in the table for good."""
    batches = _numbers(spark, f"{path}/manifest", "batch_id=")
    kept = batches[-2:]
    used = {v for b in kept for v in _manifest(spark, path, b + 1).values()}
    for v in _numbers(spark, f"{path}/data", "v="):
        if v not in used and v not in kept:
            delete(spark, f"{path}/data/v={v}")
    for b in batches[:-2]:
        delete(spark, f"{path}/manifest/batch_id={b}")
    for n in _numbers(spark, log_path, "batch_id=") if log_path and batches else []:
        if n < batches[-1]:
            delete(spark, f"{log_path}/batch_id={n}")
