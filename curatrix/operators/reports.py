"""Dashboard filters, coverage and summaries with totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.semantic import TRACKED_FIELDS, card_flags, classify_coverage, needs_review, search_text
from curatrix.functions.text import is_blank

FOLDER_STATUSES = ("FOUND", "ABSENT", "AMBIGUOUS", "UNKNOWN")
NEEDS_DESCRIPTION = (("CONTEXT_ONLY", "context only"), ("ENTRY_EMPTY", "empty entries"), ("NO_ENTRY", "no entry"))


def _row(df: DataFrame) -> dict:
    return {c: F.col(c) for c in df.columns}


def filter_cards(rows: DataFrame, text: str = "", status: str = "", folder: str = "", flags: tuple[str, ...] = ()) -> DataFrame:
    """Rows that contain the text, have the status and folder, and set all the flags."""
    out = rows
    if text:
        out = out.where(F.contains(search_text(_row(rows)), F.lit(text.lower())))
    if status:
        out = out.where(F.col("status") == status)
    if folder:
        out = out.where(F.concat_ws("/", "root", F.nullif("folder", F.lit(""))) == folder)
    for flag in flags:
        out = out.where(card_flags(_row(rows))[flag])
    return out


def coverage_join(rows: DataFrame, folders: DataFrame, states: DataFrame) -> DataFrame:
    """Rows with ``folder_status``, ``entry_exists`` and ``coverage``; an unobserved or unknown folder
    status is UNKNOWN, a row without a state has no entry."""
    joined = rows.join(folders.select("root", "folder", F.col("status").alias("fs")), ["root", "folder"], "left")
    joined = joined.join(states.select("root", "folder", "identity", F.col("source_entry_exists").alias("es")), ["root", "folder", "identity"], "left")
    joined = joined.withColumn("folder_status", F.when(F.col("fs").isin(*FOLDER_STATUSES), F.col("fs")).otherwise("UNKNOWN")).withColumn("entry_exists", F.coalesce("es", F.lit(False))).drop("fs", "es")
    return joined.withColumn("coverage", classify_coverage(F.col("folder_status"), F.col("entry_exists"), F.col("source_description"), F.col("section_context"), F.col("source_notes") if "source_notes" in rows.columns else None))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Per folder: photos, described, in need, and the folder's sentence. Described entries without
    a photo don't count."""
    present = F.col("status") != "DESCRIBED_ABSENT"
    n = lambda v: F.count_if(present & (F.col("coverage") == v))
    counted = covered.groupBy("root", "folder", "folder_status").agg(
        F.count_if(present).alias("photos"), n("DESCRIBED").alias("described"), *[n(v).alias(v.lower()) for v, _ in NEEDS_DESCRIPTION]
    )
    need = sum((F.col(v.lower()) for v, _ in NEEDS_DESCRIPTION[1:]), F.col(NEEDS_DESCRIPTION[0][0].lower()))
    photos = F.concat(F.col("photos").cast("string"), F.lit(" photos · "))
    why = F.concat_ws(" · ", *[F.when(F.col(v.lower()) > 0, F.concat(F.col(v.lower()).cast("string"), F.lit(f" {label}"))) for v, label in NEEDS_DESCRIPTION])
    found = F.concat(photos, F.col("described").cast("string"), F.lit(" described · "), need.cast("string"), F.lit(" need description"), F.when(why != "", F.concat(F.lit(" ("), why, F.lit(")"))).otherwise(""))
    sentence = (
        F.when(F.col("folder_status") == "UNKNOWN", F.concat(photos, F.lit("description coverage: not yet observed")))
        .when(F.col("folder_status") == "ABSENT", F.concat(photos, F.lit("description document: absent · "), F.col("photos").cast("string"), F.lit(" need manual description")))
        .when(F.col("folder_status") == "AMBIGUOUS", F.concat(photos, F.lit("description document: ambiguous · coverage unresolved")))
        .otherwise(found)
    )
    return counted.select("root", "folder", "folder_status", "photos", "described", need.alias("needs_description"), sentence.alias("sentence"))


def dashboard_summary(rows: DataFrame) -> DataFrame:
    """Counts per (root, folder), per root, and in total (null keys), in one rollup."""
    absent = F.col("status") == "DESCRIBED_ABSENT"
    return rows.rollup("root", "folder").agg(
        F.count("*").alias("rows"),
        F.count_if(~absent).alias("present"),
        F.count_if(absent).alias("absent"),
        *[F.count_if(~is_blank(F.col(f))).alias(f"with_{f}") for f in TRACKED_FIELDS],
        F.count_if(needs_review(_row(rows))).alias("needs_review"),
        F.grouping_id().cast("int").alias("level"),
    )


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows per folder and status, and per status in total (null keys)."""
    return rows.groupingSets([[F.col("root"), F.col("folder"), F.col("status")], [F.col("status")]], "root", "folder", "status").agg(F.count("*").alias("n"))


def review_counters(suggestions: DataFrame) -> DataFrame:
    """How many suggestions fill each field, and matches in total."""
    some = lambda c: F.count_if(F.col(c) != "").alias(f"with_{c}")
    return suggestions.agg(
        F.count("*").alias("entries"), *[some(c) for c in ("date", "place", "latlon", "people", "tags")],
        F.sum(F.col("people_matched") + F.col("places_matched") + F.col("tags_matched")).cast("long").alias("matches"), F.sum("candidates").cast("long").alias("candidates"),
    )


def dictionary_summary(evidence: DataFrame) -> DataFrame:
    """Per entity type: entities, evidence rows, and entities created in the latest run, that is
    whose first run is the latest run of all."""
    first = evidence.groupBy("entity_type", "canonical").agg(F.min("run_id").alias("first_run"), F.count("*").alias("n"))
    latest = evidence.agg(F.max("run_id").alias("latest"))
    joined = first.crossJoin(F.broadcast(latest))  # one row
    return joined.groupBy("entity_type").agg(F.count("*").alias("entities"), F.sum("n").cast("long").alias("evidence"), F.count_if(F.col("first_run") == F.col("latest")).alias("created_recently"))


def top_with_rest(df: DataFrame, order: list, n: int) -> tuple[DataFrame, int]:
    """The first ``n`` rows, and how many more there are."""
    return df.orderBy(*order).limit(n), max(0, df.count() - n)


def locate_asset(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """The asset of each row: same (root, stem), else that of the first root with the stem."""
    exact = assets.groupBy("root", "stem").agg(F.min("path").alias("exact_path"))
    other = assets.groupBy("stem").agg(F.min_by("path", F.struct("root", "path")).alias("other_path"))
    joined = rows.join(exact, ["root", "stem"], "left").join(other, "stem", "left")
    return joined.withColumn("asset", F.coalesce("exact_path", "other_path")).drop("exact_path", "other_path")
