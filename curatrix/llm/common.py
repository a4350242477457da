"""Helpers that the operators share: table readers and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session (one machine) may go without it; then a fresh
    temporary folder is used. A cluster session without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL_DIR:
        _LOCAL_DIR["dir"] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _LOCAL_DIR["dir"]


def scratch_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A new path in the shared folder; unless ``keep``, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not keep:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and a
    lost executor costs no recomputation of what lies before."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer held, as after
    ``materialize``. Spark does so when the driver's JVM collects its garbage, which may be
    long after a large shuffle was last of use. Events of a plan just run still hold it, so this
    helps a step later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def digest128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; together a 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)
