"""What the operators share: durable checkpoints, connected components, input sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and U+0009..U+000D.
WORD_CHARS = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Only a local session, which is one process on one
    machine, may leave it unset and then gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return _LOCAL["folder"]


_LOCAL: dict[str, str] = {}


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it: it is computed once, and no later failure goes behind it."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of durable() that no plan will read again."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_small(df: DataFrame, small: DataFrame, key: str, how: str = "inner", most: int = 50_000) -> DataFrame:
    """Join with a table of one short row a key: broadcast only if it has at most `most` rows."""
    return df.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, key, how)


def ascii_lower(text):
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _star(edges: DataFrame, larger: bool) -> tuple[DataFrame, DataFrame]:
    """One star step over edges (a, b), and the table it reads. The minimum of each neighbourhood
    is written first, so that the join has a shuffle on either side and a node with very many
    neighbours can be split over tasks."""
    if larger:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = durable(down.groupBy("u").agg(F.min("v").alias("m")))
        out = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
    return out.where("a <> b").distinct(), low


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table with long columns a and b.

    Alternating large-star and small-star steps: every round is joins and minimums,
    the number of rows never grows past the number of edges, and the end state has one
    row (node, component) for every node but the smallest of each component. Loops and
    repeated edges are allowed; an empty table gives an empty table. The result is a table of durable().
    """
    now = durable(edges.select("a", "b").where("a <> b").distinct())
    for _ in range(max_rounds):
        # stars around their smallest node: every node has one edge, and none leads on
        state = now.agg(F.count("*"), F.count_distinct("a")).first()
        if state[0] == state[1] and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").where("a > b").limit(1).count() == 0 and now.where("a < b").limit(1).count() == 0:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out.written = now.written
            return out
        wide, low = _star(now, True)
        wide = durable(wide)
        small, lower = _star(wide, False)
        new = durable(small)
        forget(now, low, wide, lower)
        now = new
    raise RuntimeError("components did not settle")
