"""Listing snapshots as a stream: each micro-batch scans some roots, folded into the recorded items.

The state lies in buckets by the hash of root and folder. A batch writes the buckets in which
something changed, under its own number, and a manifest that names for every bucket the batch that
wrote it last, and for every root the times of its scans. That a file was seen again is told by its
root's last scan, so unchanged files cost no writing. ``compact`` removes what no manifest names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import parent_path
from curatrix.scratch import written

LISTING = "root_id string, relative_path string, is_directory boolean, size long, modified_at timestamp, content_hash string"
RECORDED = f"{LISTING}, first_seen timestamp, last_seen timestamp, missing_since timestamp"
BUCKETS = 64
_FACTS = ("is_directory", "size", "modified_at", "content_hash")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of listing snapshots, one file per trigger."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _batches(spark: SparkSession, state_path: str) -> list[int]:
    """Numbers of the manifests."""
    fs, at = _fs(spark, f"{state_path}/log")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, state_path: str, batch: int) -> dict:
    """{"buckets": {bucket: batch that wrote it}, "scans": {root: [time of the last scan, and of the one before]}} after ``batch``."""
    if batch < 0:
        return {"buckets": {}, "scans": {}}
    return json.loads(spark.read.text(f"{state_path}/log/{batch}.json", wholetext=True).first()[0])


def _write_manifest(spark: SparkSession, state_path: str, batch: int, content: dict) -> None:
    """Written aside and moved into place, so a manifest is there whole or not at all."""
    fs, at = _fs(spark, f"{state_path}/log/{batch}.json")
    _, aside = _fs(spark, f"{state_path}/log/.{batch}.part")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"could not write the manifest of batch {batch}")


def _stored(spark: SparkSession, state_path: str, buckets: dict[str, int]) -> DataFrame:
    """Items of the named buckets as they lie there: ``last_seen`` is null where the root's last scan tells it."""
    paths = [f"{state_path}/batch={n}/bucket={b}" for b, n in buckets.items()]
    return spark.read.schema(RECORDED).parquet(*paths) if paths else spark.createDataFrame([], RECORDED)


def _time_of(root: Column, scans: dict[str, list], place: int) -> Column:
    """The time of a root's last (0) or last but one (1) scan; roots are few."""
    known = {r: t[place] for r, t in scans.items() if len(t) > place}
    if not known:
        return F.lit(None).cast("timestamp")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), root).cast("timestamp")


def read_state(spark: SparkSession, state_path: str, batch: int | None = None) -> DataFrame:
    """The recorded items after ``batch``, by default the last."""
    done = _batches(spark, state_path)
    at = (done[-1] if done else -1) if batch is None else batch
    now = manifest(spark, state_path, at)
    items = _stored(spark, state_path, now["buckets"])
    return items.withColumn("last_seen", F.coalesce("last_seen", _time_of(F.col("root_id"), now["scans"], 0)))


def fold_listing(state_path: str, clock: Callable[[int], str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function. A batch is a whole scan of every root that it holds: recorded items of these
    roots that it lacks are missing, items of other roots stay. State n is made from the manifest of
    batch n - 1 and batch n alone, so a batch that is run again writes the same state again."""
    bucket = F.pmod(F.xxhash64("root_id", parent_path(F.col("relative_path"))), F.lit(buckets)).cast("int")

    def fold(batch: DataFrame, n: int) -> None:
        spark, now = batch.sparkSession, F.lit(clock(n)).cast("timestamp")
        before = manifest(spark, state_path, n - 1)
        scan = written(batch.where("relative_path <> ''").select(*[c.split()[0] for c in LISTING.split(", ")]).dropDuplicates(["root_id", "relative_path"]), "scan")
        roots = [r.root_id for r in scan.select("root_id").distinct().collect()]  # roots are few
        held = _stored(spark, state_path, before["buckets"])
        r, c = held.where(F.col("root_id").isin(roots)).alias("p"), scan.alias("c")
        both = r.join(c, (F.col("p.root_id") == F.col("c.root_id")) & (F.col("p.relative_path") == F.col("c.relative_path")), "full")
        here, known = F.col("c.root_id").isNotNull(), F.col("p.root_id").isNotNull()
        facts = ~F.struct(*[F.col(f"p.{f}").alias(f) for f in _FACTS]).eqNullSafe(F.struct(*[F.col(f"c.{f}").alias(f) for f in _FACTS]))
        moved = ~known | (known & here & (F.col("p.missing_since").isNotNull() | facts)) | (~here & F.col("p.missing_since").isNull())
        take = lambda f: F.when(here, F.col(f"c.{f}")).otherwise(F.col(f"p.{f}")).alias(f)
        root = F.coalesce("c.root_id", "p.root_id")
        delta = both.where(moved).select(
            *[take(f) for f in ("root_id", "relative_path", *_FACTS)],
            F.coalesce(F.col("p.first_seen"), now).alias("first_seen"),
            F.when(~here, F.coalesce(F.col("p.last_seen"), _time_of(root, before["scans"], 0))).alias("last_seen"),
            F.when(~here, now).alias("missing_since"),
        )
        delta = written(delta, "delta").withColumn("bucket", bucket)
        touched = [x.bucket for x in delta.select("bucket").distinct().collect()]  # as many at most as there are buckets
        old = _stored(spark, state_path, {b: k for b, k in before["buckets"].items() if int(b) in touched}).withColumn("bucket", bucket)
        after = old.join(delta, ["root_id", "relative_path"], "left_anti").unionByName(delta)
        if touched:
            after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/batch={n}")
        scans = before["scans"] | {x: [clock(n), *before["scans"].get(x, [])[:1]] for x in roots}
        _write_manifest(spark, state_path, n, {"buckets": before["buckets"] | {str(b): n for b in touched}, "scans": scans})

    return fold


def compact(spark: SparkSession, state_path: str, keep: int = 2) -> int:
    """Remove buckets that none of the last ``keep`` manifests names, and older manifests; returns how
    many buckets went. Keep at least 2, so that the last batch can be run again."""
    done = _batches(spark, state_path)
    kept = done[-max(keep, 1) :]
    named = {(int(b), n) for k in kept for b, n in manifest(spark, state_path, k)["buckets"].items()}
    gone = 0
    for n in range(done[-1] + 1 if done else 0):
        fs, at = _fs(spark, f"{state_path}/batch={n}")
        if not fs.exists(at):
            continue
        mine = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()]
        for place in mine:
            if (int(place.getName().removeprefix("bucket=")), n) not in named:
                gone += bool(fs.delete(place, True))
        if all((int(p.getName().removeprefix("bucket=")), n) not in named for p in mine):
            fs.delete(at, True)
    for n in done:
        if n not in kept:
            fs, at = _fs(spark, f"{state_path}/log/{n}.json")
            fs.delete(at, False)
    return gone


def run_listing_stream(spark: SparkSession, source: str, state_path: str, checkpoint: str, clock: Callable[[int], str]):
    """Take in all snapshots that are there, then stop."""
    return (
        read_snapshots(spark, source).writeStream.foreachBatch(fold_listing(state_path, clock))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
