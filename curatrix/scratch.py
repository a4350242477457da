"""Scratch data in the folder that all executors share, and ranks over hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local-mode session (one machine) may go without
    it and gets a temporary folder; a cluster session without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "at" not in _OWN:
        _OWN["at"] = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
    return _OWN["at"]


def scratch_place(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which goes when the driver's JVM ends."""
    place = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: its lineage is cut, and a lost executor
    costs no work that lies before."""
    spark, place = df.sparkSession, scratch_place(df.sparkSession, tag)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def in_blocks(df: DataFrame, key: list[str], order: list[Column], block: str = "__block", pieces: int | None = None) -> DataFrame:
    """``df`` in the order of ``key`` and ``order``, cut into blocks of about equal size whatever the sizes of
    the keys: a block holds neighbouring rows, and a later block later ones. Written once, so
    the numbers hold. ``pieces``: number of blocks, by default that of the shuffle's partitions."""
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(f"`{k}`") for k in key]
    dealt = df.repartitionByRange(n, *by, *order).withColumn(block, F.spark_partition_id())
    return written(dealt, "blocks")


def ranked(df: DataFrame, key: list[str], order: list[Column], name: str = "__rank", pieces: int | None = None) -> DataFrame:
    """``df`` with the rank of each row within its key, from 1, in an order that should be total.

    No task holds all rows of a hot key: blocks of the order count their rows of each key, the
    counts are summed over the blocks before, and rows are numbered inside their block."""
    cut = in_blocks(df, key, order, "__block", pieces)
    counts = cut.groupBy(*key, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block at most
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*key, "__block").orderBy(*order)
    numbered = cut.withColumn("__i", F.row_number().over(inside))
    same = [numbered[k].eqNullSafe(starts[k]) for k in [*key, "__block"]]
    joined = numbered.join(starts, on=same[0] if len(same) == 1 else _all(same)).select(*[numbered[f"`{c}`"] for c in df.columns], (F.col("__start") + F.col("__i")).alias(name))
    return joined


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
