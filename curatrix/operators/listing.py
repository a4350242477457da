"""File listings: normalising, diffing, keeping state, planning folders, moves and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import base_name, blank_if_null, file_kind, identity_key, join_relative_path, normalize_relative_path, parent_path
from curatrix.scratch import ranked, written

MAX_DEPTH = 64


def normalize_listing(raw: DataFrame) -> DataFrame:
    """Provider records (root_id, parent, name, type, size, md5, sha256, modified, remote_id)
    to listing rows. The path is parent + name, directories have no size, the content hash is
    the first non-empty of md5 and sha256, a bad timestamp is null, and a missing name gives a
    row with ``error``."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    is_dir = F.col("type") == "dir"
    return raw.select(
        "root_id",
        "name",
        F.when(~(blank_if_null(F.col("name")) == ""), join_relative_path(blank_if_null(F.col("parent")), F.col("name"))).alias("relative_path"),
        is_dir.alias("is_directory"),
        "remote_id",
        F.when(~is_dir, F.col("size")).cast("long").alias("size"),
        F.try_to_timestamp(F.col("modified")).alias("modified_at"),
        F.coalesce(some("md5"), some("sha256")).alias("content_hash"),
        "md5",
        "sha256",
        F.when(blank_if_null(F.col("name")) == "", F.lit("record has no name")).alias("error"),
    )


def order_listing(listing: DataFrame) -> DataFrame:
    """Depth-first: in a folder its folders first, then its files, each by name. A path of
    ``MAX_DEPTH`` folders or more is an error."""
    parts = F.split(normalize_relative_path(F.col("relative_path")), "/")
    last = F.size(parts) - 1
    key = F.transform(parts, lambda p, i: F.struct(((i == last) & ~F.col("is_directory")).alias("is_file"), p.alias("name")))
    checked = F.when(F.size(parts) <= MAX_DEPTH, key).otherwise(F.raise_error(F.concat(F.lit("too deep: "), F.col("relative_path"))))
    return listing.withColumn("__key", checked).orderBy("root_id", "__key").drop("__key")


def with_folder(listing: DataFrame) -> DataFrame:
    path = F.col("relative_path")
    return listing.withColumn("folder", parent_path(path)).withColumn("file_name", base_name(path)).withColumn("kind", file_kind(base_name(path)))


def changed(prev: str, curr: str) -> Column:
    """Hashes decide when both sides have one, one hash alone is a change, else size or time."""
    p, c = (lambda n: F.col(f"{prev}.{n}")), (lambda n: F.col(f"{curr}.{n}"))
    both = p("content_hash").isNotNull() & c("content_hash").isNotNull()
    neither = p("content_hash").isNull() & c("content_hash").isNull()
    differs = ~p("size").eqNullSafe(c("size")) | ~p("modified_at").eqNullSafe(c("modified_at"))
    return F.when(both, p("content_hash") != c("content_hash")).when(neither, differs).otherwise(True)


def diff_listing(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """(root_id, relative_path, change): new, changed, unchanged or missing. Empty paths are ignored."""
    p = prev.where("relative_path <> ''").alias("p")
    c = curr.where("relative_path <> ''").alias("c")
    on = (F.col("p.root_id") == F.col("c.root_id")) & (F.col("p.relative_path") == F.col("c.relative_path"))
    change = F.when(F.col("p.relative_path").isNull(), "new").when(F.col("c.relative_path").isNull(), "missing").when(changed("p", "c"), "changed").otherwise("unchanged")
    key = lambda n: F.coalesce(F.col(f"c.{n}"), F.col(f"p.{n}")).alias(n)
    return p.join(c, on, "full").select(key("root_id"), key("relative_path"), change.alias("change"))


def apply_listing(recorded: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """The recorded items after a scan at ``now``: first_seen is kept, last_seen moves,
    missing_since is set once and cleared on return, vanished rows stay."""
    r, c = recorded.alias("r"), listing.where("relative_path <> ''").alias("c")
    on = (F.col("r.root_id") == F.col("c.root_id")) & (F.col("r.relative_path") == F.col("c.relative_path"))
    here = F.col("c.relative_path").isNotNull()
    fresh = lambda n: F.when(here, F.col(f"c.{n}")).otherwise(F.col(f"r.{n}")).alias(n)
    return r.join(c, on, "full").select(
        *[fresh(n) for n in ("root_id", "relative_path", "is_directory", "size", "modified_at", "content_hash")],
        F.coalesce(F.col("r.first_seen"), now).alias("first_seen"),
        F.when(here, now).otherwise(F.col("r.last_seen")).alias("last_seen"),
        F.when(~here, F.coalesce(F.col("r.missing_since"), now)).alias("missing_since"),
    )


def upsert_source_root(roots: DataFrame, scanned: DataFrame, now: Column) -> DataFrame:
    """By identity: name, url, destination and last scan are replaced, first_seen is kept."""
    r, s = roots.alias("r"), scanned.alias("s")
    here = F.col("s.identity").isNotNull()
    take = lambda n: F.when(here, F.col(f"s.{n}")).otherwise(F.col(f"r.{n}")).alias(n)
    return r.join(s, F.col("r.identity") == F.col("s.identity"), "full").select(
        *[take(n) for n in ("identity", "source_url", "name", "destination_name")],
        F.coalesce(F.col("r.first_seen"), now).alias("first_seen"),
        F.when(here, now).otherwise(F.col("r.last_scan")).alias("last_scan"),
    )


def photo_folders(listing: DataFrame) -> DataFrame:
    """(root_id, folder) with at least one photo; directories don't count."""
    files = with_folder(listing.where("NOT is_directory"))
    return files.groupBy("root_id", "folder").agg(F.count_if(F.col("kind") == "photo").alias("n")).where("n > 0").select("root_id", "folder")


def plan_folders(listing: DataFrame) -> DataFrame:
    """Per folder with photos: counts by kind, the description document if there is exactly
    one, and whether there are several. Files stay in long form; no folder becomes one cell."""
    files = with_folder(listing.where("NOT is_directory"))
    n = lambda k: F.count_if(F.col("kind") == k)
    grouped = files.groupBy("root_id", "folder").agg(
        n("photo").alias("photos"),
        n("description").alias("documents"),
        n("other").alias("others"),
        F.min(F.when(F.col("kind") == "description", F.col("file_name"))).alias("first_document"),
    )
    return grouped.where("photos > 0").select(
        "root_id", "folder", "photos", "documents", "others",
        F.when(F.col("documents") == 1, F.col("first_document")).alias("description"),
        (F.col("documents") > 1).alias("ambiguous"),
    )


def folder_description_record(plans: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Adds ``status``: UNKNOWN where reading failed, AMBIGUOUS, FOUND or ABSENT."""
    joined = plans if errors is None else plans.join(errors.select("root_id", "folder").distinct().withColumn("failed", F.lit(True)), ["root_id", "folder"], "left")
    failed = F.lit(False) if errors is None else F.coalesce("failed", F.lit(False))
    status = F.when(failed, "UNKNOWN").when(F.col("documents") > 1, "AMBIGUOUS").when(F.col("documents") == 1, "FOUND").otherwise("ABSENT")
    return joined.withColumn("status", status).drop("failed")


def description_candidates(listing: DataFrame) -> DataFrame:
    """The description documents of each folder with photos, one row each."""
    docs = with_folder(listing.where("NOT is_directory")).where("kind = 'description'")
    return docs.join(photo_folders(listing), ["root_id", "folder"]).select("root_id", "folder", "file_name")


def true_duplicates(listing: DataFrame) -> DataFrame:
    """Files whose content hash occurs more than once: (content_hash, copies, first path)."""
    path = F.concat_ws("/", "root_id", "relative_path")
    return (
        listing.where(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.count("*").alias("copies"), F.min(path).alias("first_path"), F.max(path).alias("last_path"))
        .where("copies > 1")
    )


#: A key of more files is ranked over blocks of the order.
HOT_FILES = 20_000


def _one_to_one(files: DataFrame, key: list[str], hot_files: int = HOT_FILES) -> DataFrame:
    """``files`` (gone, path, folder, file_name, ..) of known ``key`` in pairs: (g, h), structs of such rows, the k-th vanished with
    the k-th new file of a key by name and path, and null beside those that are left over.

    The files of a key meet as two lists; those of a hot key, which many files share, meet by their ranks."""
    row = F.struct("file_name", "path", *[c for c in files.columns if c not in ("gone", "file_name", "path")])
    side = lambda c: F.array_sort(F.collect_list(F.when(c, row)))

    def listed(rows: DataFrame) -> DataFrame:
        both = rows.groupBy(*key).agg(side(F.col("gone")).alias("g"), side(~F.col("gone")).alias("h"))
        return both.select(F.explode(F.arrays_zip("g", "h")).alias("p")).select("p.g", "p.h")

    known = F.xxhash64(*key).alias("k")
    hot = written(files.groupBy(known).agg(F.count("*").alias("n")).where(F.col("n") > hot_files).select("k"), "hot")  # few: each holds hot_files
    if hot.isEmpty():
        return listed(files)
    keyed = files.withColumn("k", known)
    many = keyed.join(F.broadcast(hot), "k", "left_semi").drop("k")
    place = lambda gone, name: ranked(many.where(F.col("gone") == gone), key, [F.col("file_name"), F.col("path")]).select(*key, "__rank", row.alias(name))
    met = place(True, "g").join(place(False, "h"), [*key, "__rank"], "full").select("g", "h")
    return listed(keyed.join(F.broadcast(hot), "k", "left_anti").drop("k")).unionByName(met)


def _all_known(key: list[str]) -> Column:
    known = F.col(key[0]).isNotNull()
    for k in key[1:]:
        known = known & F.col(k).isNotNull()
    return known


def find_moved(missing: DataFrame, fresh: DataFrame, hot_files: int = HOT_FILES) -> DataFrame:
    """(from_path, to_path, signal) for vanished files that turned up elsewhere, one to one: by remote id,
    then by content hash (strong), then by file name (weak, a proposal). Paths are unique on either side.

    Of several files with one key the k-th vanished goes with the k-th new one, so no new file is
    claimed twice and as many are paired as there are on the scarcer side. Among weak names those
    come first that lie where most of their folder's strong moves went. Ranks of a key of very many files (all
    empty ones have one hash) are numbered over blocks of the order, so it is no single task. Each turn
    reads what the turn before left over, once.
    """
    path = F.concat_ws("/", "root_id", "relative_path")
    own = [path.alias("path"), parent_path(path).alias("folder"), "remote_id", "content_hash", F.lower(base_name(F.col("relative_path"))).alias("file_name")]
    left = missing.select(F.lit(True).alias("gone"), *own).unionByName(fresh.select(F.lit(False).alias("gone"), *own))
    left = written(left, "files")
    columns, found = left.columns, None
    for key in ("remote_id", "content_hash", "votes", "file_name"):
        keys = [key]
        if key == "votes":
            count = found.groupBy("folder_from", "folder_to").agg(F.count("*").alias("n"))
            most = count.groupBy("folder_from").agg(F.min(F.struct((-F.col("n")).alias("n"), "folder_to")).alias("v")).select(F.col("folder_from").alias("folder"), F.col("v.folder_to").alias("aim"))
            voted = left.join(most.withColumn("gone", F.lit(True)), ["gone", "folder"], "left").withColumn("aim", F.when(F.col("gone"), F.col("aim")).otherwise(F.col("folder")))
            left, keys = voted.select(*columns, "aim"), ["file_name", "aim"]
        asked = _all_known(keys)
        met = written(_one_to_one(left.where(asked), keys, hot_files), "moves")
        pair = met.where("g IS NOT NULL AND h IS NOT NULL")
        signal = F.lit("file_name" if key == "votes" else key).alias("signal")
        pairs = pair.select(F.col("g.path").alias("from_path"), F.col("h.path").alias("to_path"), F.col("g.folder").alias("folder_from"), F.col("h.folder").alias("folder_to"), signal)
        found = pairs if found is None else found.unionByName(pairs)
        if key != "file_name":
            alone = met.where("g IS NULL OR h IS NULL").select(F.col("g").isNotNull().alias("gone"), F.coalesce("g", "h").alias("f"))
            rest = alone.select("gone", *[F.col(f"f.{c}").alias(c) for c in columns if c != "gone"])
            left = rest.unionByName(left.where(~asked).select(*columns))
    return found.select("from_path", "to_path", "signal")


def moved_folders(moves: DataFrame) -> DataFrame:
    """Moves collapsed by folder."""
    return moves.groupBy(parent_path(F.col("from_path")).alias("folder_from"), parent_path(F.col("to_path")).alias("folder_to")).agg(F.count("*").alias("files"))


def _ancestors(folder: Column) -> Column:
    """A folder, the folders above it, and '' for all."""
    parts = F.split(folder, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def orphan_classes(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(identity, found_folder, found_name): the files of every stem that a described but absent row has, each once."""
    lost = rows.where("status = 'DESCRIBED_ABSENT'").select(identity_key(F.col("reference")).alias("identity")).distinct()
    return files.select(identity_key(F.col("name")).alias("identity"), F.col("folder").alias("found_folder"), F.col("name").alias("found_name")).join(lost, "identity", "left_semi")


def orphan_descriptions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(root, folder, reference, identity, found_folder, found_name): rows described in one folder without a file there,
    with every file of that stem in another folder, a row for each."""
    lost = rows.where("status = 'DESCRIBED_ABSENT'").select("root", "folder", "reference", identity_key(F.col("reference")).alias("identity"))
    there = files.select(F.col("folder").alias("found_folder"), identity_key(F.col("name")).alias("identity"), F.col("name").alias("found_name"))
    met = lost.join(there, "identity").where(F.col("folder") != F.col("found_folder"))
    return met.select("root", "folder", "reference", "identity", "found_folder", "found_name")


def nearest_orphans(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(root, folder, reference, identity, candidates, found_folder, found_name, shared): rows described in one folder without
    a file there, with the number of files of that stem in other folders, and the one nearest by folder: it shares
    ``shared`` leading folders (ties: the least folder and name).

    Files are classed by stem and each folder above them, rows look up their folder's ancestors in the
    classes, and the deepest that answers wins. No row meets all files of its stem; the output is
    linear in the rows. ``orphan_descriptions`` lists all files.
    """
    lost = rows.where("status = 'DESCRIBED_ABSENT'").select("root", "folder", "reference", identity_key(F.col("reference")).alias("identity"))
    there = orphan_classes(rows, files)
    at = there.select("identity", "found_folder", "found_name", F.explode(_ancestors(F.col("found_folder"))).alias("above"))
    least = at.groupBy("identity", "above", "found_folder").agg(F.min("found_name").alias("found_name"))
    place = F.row_number().over(Window.partitionBy("identity", "above").orderBy("found_folder"))
    f = F.struct("found_folder", "found_name")
    two = least.withColumn("n", place).where("n <= 2").groupBy("identity", "above").agg(F.min(f).alias("lo"), F.max(f).alias("hi"))  # one may be the row's own folder
    total = there.groupBy("identity").agg(F.count("*").alias("total"))
    own = there.groupBy("identity", F.col("found_folder").alias("folder")).agg(F.count("*").alias("own"))
    asked = lost.select("*", F.posexplode(_ancestors(F.col("folder"))).alias("shared", "above"))
    file = F.when(F.col("lo.found_folder") != F.col("folder"), F.col("lo")).when(F.col("hi.found_folder") != F.col("folder"), F.col("hi"))
    met = asked.join(two, ["identity", "above"]).withColumn("file", file).where("file IS NOT NULL")
    best = met.groupBy("root", "folder", "reference", "identity").agg(F.max_by("file", "shared").alias("file"), F.max("shared").alias("shared"))
    counted = best.join(total, "identity").join(own, ["identity", "folder"], "left")
    return counted.select(
        "root", "folder", "reference", "identity", (F.col("total") - F.coalesce("own", F.lit(0))).alias("candidates"), "file.found_folder", "file.found_name", "shared"
    )


def snapshot_counters(items: DataFrame) -> DataFrame:
    """Per source: recorded files, present and missing, with a hash."""
    return items.groupBy("root_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("missing_since").isNull()).alias("present"),
        F.count_if(F.col("missing_since").isNotNull()).alias("missing"), F.count("content_hash").alias("with_hash"),
    )


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
