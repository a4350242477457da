"""Portable state: snapshots in generations, restoring, merging scan results into them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatrix.functions.text import blank_if_null
from curatrix.operators.digest_tree import DigestTree, bucket_digests, bucket_of
from curatrix.operators.dictionary import record_evidence, upsert_alias
from curatrix.operators.review import content_signatures
from curatrix.scratch import written

SCHEMA_VERSION = 2
#: Buckets that a table's rows fall into; each generation writes those that changed.
BUCKETS = 64
KEY = ["root", "folder", "identity"]
#: By what the rows of a table are told apart. Rows of other tables are told apart by all their columns.
KEYS = {
    "roots": ["identity"], "row_states": KEY, "items": ["root_id", "relative_path"], "entities": ["entity_type", "entity_id"],
    "aliases": ["entity_type", "entity_id", "alias"], "latlons": ["entity_id", "latlon"], "machines": ["machine_id"],
}


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _manifest(spark: SparkSession, base: str, generation: int | None = None) -> dict | None:
    """The manifest of a generation, by default the highest."""
    fs, at = _fs(spark, f"{base}/manifests")
    if not fs.exists(at):
        return None
    names = [s.getPath().toString() for s in fs.listStatus(at)]
    found = [json.loads(r.value) for r in spark.read.text(names, wholetext=True).collect()] if names else []  # one small file per generation
    if generation is not None:
        return next((m for m in found if m["generation"] == generation), None)
    return max(found, key=lambda m: m["generation"], default=None)


def _tree(df: DataFrame, name: str, ignore: tuple[str, ...], buckets: int) -> tuple[DigestTree, list[str]]:
    """A table's digests (columns in ``ignore``, provenance, don't count) and its bucket's key."""
    columns = [c for c in df.columns if c not in ignore]
    key = [c for c in KEYS.get(name, columns) if c in columns] or columns
    return DigestTree(bucket_digests(df, key, columns, buckets), buckets), key


def _held(entry: dict) -> DigestTree:
    return DigestTree({int(b): d for b, d in entry["leaves"].items()}, entry["buckets"])


def publish_snapshot(tables: dict[str, DataFrame], base: str, expected_generation: int, ignore: tuple[str, ...] = ("at", "machine_id", "run_id"), buckets: int = BUCKETS) -> tuple[str, int]:
    """Write ``tables`` as the next generation under ``base``: ("unchanged" | "conflict" | "published",
    generation). Nothing is written if the content is what the last generation holds, or if the
    generation isn't the expected one. Of each table only the buckets whose digests differ are
    written; the manifest names the generation that holds each bucket. It is created last and
    exclusively, so of two writers one fails; storage without exclusive creation makes that best effort."""
    spark = next(iter(tables.values())).sparkSession
    last = _manifest(spark, base)
    generation = last["generation"] if last else 0
    if generation != expected_generation:
        return "conflict", generation
    before = last.get("trees", {}) if last else {}
    entries, writes = {}, []
    for name, df in tables.items():
        old = before.get(name)
        n = old["buckets"] if old else buckets
        tree, key = _tree(df, name, ignore, n)
        same_shape = old is not None and old["schema"] == df.schema.json()
        moved = tree.differing(_held(old))[0] if same_shape else sorted(tree.levels[0])
        gens = {} if not same_shape else {b: g for b, g in old["generations"].items() if int(b) in tree.levels[0]}
        gens |= {str(b): generation + 1 for b in moved if b in tree.levels[0]}
        entries[name] = {"buckets": n, "schema": df.schema.json(), "leaves": {str(b): d for b, d in tree.levels[0].items()}, "generations": gens, "root": tree.root}
        if now := [b for b in moved if b in tree.levels[0]]:
            writes.append((name, df, key, n, now))
    if last and {n: (e["root"], e["schema"]) for n, e in before.items()} == {n: (e["root"], e["schema"]) for n, e in entries.items()}:
        return "unchanged", generation
    for name, df, key, n, now in writes:
        cut = df.withColumn("__bucket", bucket_of(key, n)).where(F.col("__bucket").isin(now))
        cut.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{base}/gen={generation + 1}/{name}")
    manifest = json.dumps({"schema_version": SCHEMA_VERSION, "generation": generation + 1, "trees": entries, "tables": sorted(tables)})
    fs, at = _fs(spark, f"{base}/manifests/{generation + 1}.json")
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "exist" in str(e).lower():
            return "conflict", generation
        raise
    out.write(bytearray(manifest.encode()))
    out.close()
    return "published", generation + 1


def _read(spark: SparkSession, base: str, name: str, entry: dict, only: list[int] | None = None) -> DataFrame:
    """A table of a manifest, or some of its buckets."""
    schema = StructType.fromJson(json.loads(entry["schema"]))
    paths = [f"{base}/gen={g}/{name}/__bucket={b}" for b, g in entry["generations"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load_snapshot(spark: SparkSession, base: str) -> tuple[dict[str, DataFrame], int]:
    """The last generation's tables and its number; nothing there gives no tables and 0. A manifest of
    a newer or no schema version is refused; the first version held whole tables."""
    last = _manifest(spark, base)
    if last is None:
        return {}, 0
    version = last.get("schema_version")
    if not isinstance(version, int) or version > SCHEMA_VERSION:
        raise ValueError(f"snapshot has schema version {version!r}, this code reads up to {SCHEMA_VERSION}")
    if version == 1:
        return {n: spark.read.parquet(f"{base}/gen={last['generation']}/{n}") for n in last["tables"]}, last["generation"]
    return {n: _read(spark, base, n, last["trees"][n]) for n in last["tables"]}, last["generation"]


def diff_generations(spark: SparkSession, base: str, table: str, old: int, new: int) -> DataFrame:
    """The rows of ``table`` that generation ``new`` has and ``old`` lacks (``change`` = 'added') and the other way round
    ('removed'). Only buckets whose digests differ are read."""
    a, b = (_manifest(spark, base, g)["trees"][table] for g in (old, new))
    buckets, _ = _held(a).differing(_held(b))
    before, after = _read(spark, base, table, a, buckets), _read(spark, base, table, b, buckets)
    change = lambda df, word: df.withColumn("change", F.lit(word))
    return change(after.exceptAll(before), "added").unionByName(change(before.exceptAll(after), "removed"))


def insert_or_ignore(have: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    fresh = new.dropDuplicates(key).join(have.select(*key), key, "left_anti")
    return have.unionByName(fresh, allowMissingColumns=True)


def bootstrap(snapshot: dict[str, DataFrame], have: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Restore a snapshot into what is there: roots, row states and entities enter under their own ids
    unless present, so do candidate coordinates (``latlons``) and evidence by its whole key; aliases are
    raised but never lowered. Twice is once. Every field comes back."""
    keys = {"roots": ["identity"], "row_states": KEY, "entities": ["entity_type", "entity_id"], "latlons": ["entity_id", "latlon"]}
    out = {n: insert_or_ignore(have[n], snapshot[n], k) for n, k in keys.items() if n in snapshot and n in have}
    if "aliases" in snapshot and "aliases" in have:
        out["aliases"] = upsert_alias(have["aliases"], snapshot["aliases"]).drop("changed")
    if "evidence" in snapshot and "evidence" in have:
        out["evidence"] = have["evidence"].unionByName(record_evidence(have["evidence"], snapshot["evidence"]), allowMissingColumns=True)
    return out


def bootstrap_counters(snapshot: dict[str, DataFrame]) -> DataFrame:
    items = snapshot["items"]
    return items.groupBy("root").agg(
        F.count("*").alias("items"), F.count_if(blank_if_null(F.col("remote_file_id")) != "").alias("with_file_id"), F.count_if(blank_if_null(F.col("build_fingerprint")) != "").alias("built")
    )


def state_to_listing(items: DataFrame) -> DataFrame:
    """Recorded items in the shape of a scan's listing."""
    return items.where("missing_since IS NULL").select("root_id", "relative_path", F.lit(False).alias("is_directory"), "size", "modified_at", "content_hash")


def load_row_states(states: DataFrame, root: str, folder: str) -> DataFrame:
    return states.where((F.col("root") == root) & (F.col("folder") == folder))


def list_roots(roots: DataFrame) -> DataFrame:
    return roots.orderBy("name", "identity")


def snapshot_merge(prev: DataFrame, states: DataFrame, physical: DataFrame, visited: DataFrame) -> DataFrame:
    """Item state after a scan. ``states``: KEY and what the scan knows; ``physical``: KEY and file facts;
    ``visited``: (root, folder). What a scan can't recreate is kept (source_hash, status, photo_id,
    fingerprint: new, else old), hashes and flags are overwritten, rows of visited folders that the
    scan lacks go, and folders not visited stay as they were. Files are matched by the whole key."""
    keep, refresh = ("source_hash", "status", "photo_id", "image_fingerprint"), ("description_hash", "suggestion_hash", "was_absent", "source_entry_exists")
    some = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    s = states.join(visited, ["root", "folder"], "left_semi").join(physical.select(*KEY, "source_hash", "size", "remote_id"), KEY, "left")
    joined = s.alias("s").join(prev.select(*KEY, *[F.col(c).alias(f"old_{c}") for c in (*keep, "size", "remote_id")]), KEY, "left")
    fresh = joined.select(
        *KEY, *[F.coalesce(some(c), F.col(f"old_{c}")).alias(c) for c in keep], *refresh,
        F.coalesce("size", "old_size").alias("size"), F.coalesce("remote_id", "old_remote_id").alias("remote_id"),
    )
    return fresh.unionByName(prev.join(visited, ["root", "folder"], "left_anti").select(*fresh.columns))


def record_machine(machines: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """By machine_id: first_seen is kept, last_seen moves, a blank label keeps the old one."""
    m, s = machines.alias("m"), seen.alias("s")
    here = F.col("s.machine_id").isNotNull()
    return m.join(s, F.col("m.machine_id") == F.col("s.machine_id"), "full").select(
        F.coalesce("m.machine_id", "s.machine_id").alias("machine_id"),
        F.coalesce(F.nullif(F.col("s.label"), F.lit("")), F.col("m.label"), F.lit("")).alias("label"),
        F.coalesce(F.col("m.first_seen"), now).alias("first_seen"),
        F.when(here, now).otherwise(F.col("m.last_seen")).alias("last_seen"),
    )


def save_baseline(baseline: DataFrame, path: str) -> list[str]:
    """Baselines in long form, one partition per ``artifact``; only the given artifacts are replaced, and of
    these only such whose content differs from what was saved last. Returns what was written. Their
    signatures lie beside the table, so nothing is read to tell."""
    spark, beside = baseline.sparkSession, f"{path}.signatures"
    columns = sorted(c for c in baseline.columns if c != "artifact")
    now = written(content_signatures(baseline, ["artifact"], [], columns).withColumn("columns", F.lit(",".join(columns))), "signatures")
    fs, at = _fs(spark, beside)
    stored = spark.read.schema(now.schema).parquet(beside) if fs.exists(at) else now.limit(0)
    moved = now.join(stored, now.columns, "left_anti").select("artifact")
    names = [r.artifact for r in moved.collect()]  # of the given artifacts
    if names:
        baseline.join(moved, "artifact", "left_semi").write.partitionBy("artifact").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        written(stored.join(now, "artifact", "left_anti").unionByName(now), "signatures").write.mode("overwrite").parquet(beside)
    return sorted(names)


def load_baseline(spark: SparkSession, path: str, artifact: str) -> DataFrame | None:
    """The artifact's baseline, None if there is none."""
    fs, at = _fs(spark, f"{path}/artifact={artifact}")
    return spark.read.option("basePath", path).parquet(f"{path}/artifact={artifact}") if fs.exists(at) else None


def rejected_proposals(proposals: DataFrame, rejected: DataFrame, key: list[str]) -> DataFrame:
    """Proposals that nobody has refused yet."""
    return proposals.join(rejected.select(*key), key, "left_anti")


def republish_decision(exists: Column, requested: Column) -> Column:
    return F.when(requested & exists, "replace").when(requested, "create").when(exists, "leave").otherwise("none")


def compose_description(place: Column, date: Column, people: Column, prose: Column, budget: int = 1000) -> Column:
    """Caption in fixed order; only the prose is shortened, at a word's end."""
    some = lambda c: F.nullif(F.trim(blank_if_null(c)), F.lit(""))
    head = F.concat_ws(". ", some(date), some(place), some(people))
    room = F.greatest(F.lit(0), F.lit(budget) - F.length(head) - F.when(head != "", 2).otherwise(0))
    whole = F.trim(blank_if_null(prose))
    part = F.substring(whole, F.lit(1), room)
    ends = F.substring(whole, room + 1, F.lit(1)).rlike(r"(?U)^\s")
    cut = F.when(ends, F.rtrim(part)).otherwise(F.regexp_replace(part, r"(?U)\s*\S*$", ""))
    return F.concat_ws(". ", F.nullif(head, F.lit("")), F.nullif(F.when(F.length(whole) <= room, whole).otherwise(cut), F.lit("")))
