"""Review rows: reading, and the rescan merge that never overwrites a person's value.

A rescan meets what was there before on (root, folder, identity). Source columns and
suggestions are the machine's and are refreshed; final columns are the reviewer's and are
filled only while blank, but for a pasted map link, which is an instruction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.geo import format_latlon, parse_map_link
from curatrix.functions.semantic import AUTOFILL_PAIRS, fill_blank_finals, is_stale_source_text
from curatrix.functions.text import blank_if_null, identity_key, is_blank, strip, text_hash

KEY = ["root", "folder", "identity"]
#: Fixed values.
STATUSES = ("NEW", "REVIEW", "APPROVED", "BUILT", "PUBLISHED", "SOURCE_CHANGED", "SOURCE_MISSING", "DESCRIBED_ABSENT", "DUPLICATE", "SKIP", "ERROR")
VERDICTS = ("SKIP", "DUPLICATE")
REVIEWED = ("APPROVED", "BUILT", "PUBLISHED")
FINALS = ("date", "place", "latlon", "people", "tags", "description")
SUGGESTIONS = ("suggested_date", "suggested_place", "suggested_latlon", "suggested_people", "suggested_tags")
SOURCES = ("source_description", "section_context", "source_notes")
HUMAN_ONLY = ("map_link", "event", "albums", "notes")
REASON = {
    "found": "Previously absent photo found",
    "returned": "Photo returned",
    "photo": "Source photo changed",
    "approved": "Description changed after approval",
    "description": "Description changed",
    "missing": "Source missing",
    "stale": "Source text is stale",
    "link": "Map link applied",
    "bad_link": "Map link not understood",
}


def read_review_rows(raw: DataFrame, columns: tuple[str, ...], pos: str = "pos") -> DataFrame:
    """By header name: a missing column is '', values are stripped, rows without a reference go,
    an unknown status is NEW, and of rows with one identity in a folder the last stays."""
    there = {c.lower(): c for c in raw.columns}
    cell = lambda n: strip(blank_if_null(F.col(there[n]).cast("string"))) if n in there else F.lit("")
    rows = raw.select(F.col(pos).alias("__pos"), *[cell(n).alias(n) for n in ("root", "folder", "reference", "status", *columns) if n != "__pos"])
    rows = rows.where("reference <> ''").withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("NEW"))
    rows = rows.withColumn("identity", identity_key(F.col("reference")))
    last = Window.partitionBy(*KEY).orderBy(F.col("__pos").desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__pos")


def upsert_row_states(states: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Last write wins per (root, folder, identity): ``new`` over ``states``, and in ``new`` the
    greatest ``order``. That column is not kept; without it the keys of ``new`` must differ."""
    if order in new.columns:
        new = new.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in new.columns if c != order]), order).alias("__row")).select("__row.*")
    return states.join(new, KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def rescan_merge(scanned: DataFrame, existing: DataFrame, states: DataFrame, places: DataFrame | None = None, descriptions_readable: bool = True, new_id: Column | None = None) -> DataFrame:
    """The rows after a scan, with the next state in ``state_*`` columns and ``outcomes``.

    ``scanned``: KEY, reference, is_entry, filename (null if no photo), photo_hash, fingerprint,
    the SOURCES and SUGGESTIONS; one row per identity. ``existing``: KEY, reference, filename, photo_id, status,
    review_reason, SOURCES, SUGGESTIONS, FINALS, HUMAN_ONLY. ``states``: KEY, photo_hash,
    description_hash, status, was_absent, photo_id, image_fingerprint. ``places``: (place,
    resolution, canonical, latlon) from ``resolve_place``. Three tables meet in two full joins
    on one key, so one shuffle each. ``new_id`` makes the ids of new rows; the default is a hash
    of the key, which a recomputation repeats.
    """
    s = scanned.select(*KEY, *[F.col(c).alias(f"s_{c}") for c in ("reference", "is_entry", "filename", "photo_hash", "fingerprint", *SOURCES, *SUGGESTIONS)], F.lit(True).alias("s_here"))
    e = existing.select(*KEY, *[F.col(c).alias(f"e_{c}") for c in ("reference", "filename", "photo_id", "status", "review_reason", *SOURCES, *SUGGESTIONS, *FINALS, *HUMAN_ONLY)], F.lit(True).alias("e_here"))
    t = states.select(*KEY, *[F.col(c).alias(f"t_{c}") for c in ("photo_hash", "description_hash", "status", "was_absent", "photo_id", "image_fingerprint")], F.lit(True).alias("t_here"))
    rows = s.join(e, KEY, "full").join(t, KEY, "left")
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    here, known, stated, entry = yes("s_here"), yes("e_here"), yes("t_here"), yes("s_is_entry")
    present = F.col("s_filename").isNotNull()
    text = lambda c: blank_if_null(F.col(c))

    # Source columns: an entry refreshes them, a bare photo leaves what was there.
    source = {c: F.when(here & (entry | ~known), text(f"s_{c}")).otherwise(text(f"e_{c}")) for c in SOURCES}
    suggested = {c: F.when(here, text(f"s_{c}")).otherwise(text(f"e_{c}")) for c in SUGGESTIONS}
    if places is not None:
        rows = rows.join(places.select(F.col("place").alias("e_place"), F.col("resolution").alias("p_how"), F.col("canonical").alias("p_name"), F.col("latlon").alias("p_latlon")), "e_place", "left")
        resolved = here & known & ~is_blank(F.col("e_place")) & (F.col("p_how") == "resolved")
        blank = lambda c: suggested[c] == ""
        looked_up = F.coalesce(resolved & blank("suggested_latlon") & (text("p_latlon") != ""), F.lit(False))
        suggested |= {
            "suggested_place": F.when(F.coalesce(resolved & blank("suggested_place"), F.lit(False)), F.col("p_name")).otherwise(suggested["suggested_place"]),
            "suggested_latlon": F.when(looked_up, F.col("p_latlon")).otherwise(suggested["suggested_latlon"]),
        }
        ambiguous = F.coalesce(here & known & ~is_blank(F.col("e_place")) & (F.col("p_how") == "ambiguous"), F.lit(False))
    else:
        looked_up = ambiguous = F.lit(False)
    rows = rows.withColumns({**{f"x_{c}": v for c, v in (source | suggested).items()}, "looked_up": looked_up, "ambiguous": ambiguous})
    finals, filled = fill_blank_finals({**{f: F.col(f"e_{f}") for f in FINALS}, **{g: F.col(f"x_{g}") for _, g in AUTOFILL_PAIRS}})
    kept_finals = {f: F.when(here, v).otherwise(text(f"e_{f}")) for f, v in finals.items()}
    link = format_latlon(parse_map_link(F.col("e_map_link")))
    pasted = here & known & (text("e_map_link") != "")
    applied, refused = pasted & link.isNotNull() & (link != kept_finals["latlon"]), pasted & link.isNull()
    kept_finals["latlon"] = F.when(applied, link).otherwise(kept_finals["latlon"])

    description_hash = F.when(here & entry, text_hash(F.col("x_source_description"), F.col("x_section_context"), F.col("x_source_notes"))).otherwise("")
    suggestion_hash = F.when(here, text_hash(*[F.col(f"s_{c}") for c in SUGGESTIONS])).otherwise("")
    photo_hash = F.when(present, text("s_photo_hash")).otherwise("")
    was_absent = F.when(stated, yes("t_was_absent")).otherwise(text("e_status") == "DESCRIBED_ABSENT")
    returned = present & stated & (text("t_status") == "SOURCE_MISSING")
    photo_moved = stated & (photo_hash != "") & (text("t_photo_hash") != photo_hash)
    text_moved = stated & (text("t_description_hash") != description_hash)
    before = F.when(stated & F.col("t_status").isin(*STATUSES), F.col("t_status")).otherwise(text("e_status"))
    step = (
        F.when(here & ~known, "created")
        .when(~here & F.lit(not descriptions_readable), "kept")
        .when(~here, "went_missing")
        .when(entry & was_absent & present, "became_present")
        .when(returned, "photo_returned")
        .when(photo_moved, "photo_changed")
        .when(entry & text_moved & before.isin(*REVIEWED), "description_changed_after_approval")
        .when(entry & text_moved, "description_changed")
        .when(entry & ~present, "still_absent")
        .otherwise("unchanged")
    )
    rows = rows.withColumns({"step": step, "description_hash": description_hash, "suggestion_hash": suggestion_hash, "photo_hash": photo_hash, "applied": applied, "refused": refused, "link": link, "filled": F.when(here & known, filled).otherwise(F.array().cast("array<string>"))})
    rows = rows.withColumns({f"f_{f}": v for f, v in kept_finals.items()})
    st = F.col("step")
    flagged = {
        "became_present": ("REVIEW", REASON["found"]), "photo_returned": ("REVIEW", REASON["returned"]), "photo_changed": ("REVIEW", REASON["photo"]),
        "description_changed_after_approval": ("REVIEW", REASON["approved"]), "description_changed": ("REVIEW", REASON["description"]), "went_missing": ("SOURCE_MISSING", REASON["missing"]),
    }
    verdict = F.col("e_status").isin(*VERDICTS)
    status = F.when(st == "created", F.when(~entry | present, "NEW").otherwise("DESCRIBED_ABSENT")).when(verdict, F.col("e_status"))
    reason = F.when(st == "created", "")
    for name, (to, why) in flagged.items():
        status, reason = status.when(st == name, to), reason.when(st == name, why)
    status = status.when(st == "still_absent", "DESCRIBED_ABSENT").otherwise(text("e_status"))
    linked = F.when(F.col("refused"), REASON["bad_link"]).when(F.col("applied"), REASON["link"]).otherwise(text("e_review_reason"))
    reason = reason.otherwise(linked)
    stale = here & known & ~entry & is_stale_source_text(F.lit(False), *[F.col(f"x_{c}") for c in SOURCES])
    reason = F.when(stale & (strip(reason) == ""), REASON["stale"]).otherwise(reason)
    made = F.substring(F.sha2(F.concat_ws("|", *KEY), 256), 1, 32) if new_id is None else new_id
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    photo_id = F.coalesce(some("t_photo_id"), some("e_photo_id"), F.when(here, made), F.lit(""))
    fingerprint = F.coalesce(some("s_fingerprint"), some("t_image_fingerprint"), F.lit(""))
    has_finals = F.lit(False)
    for f in FINALS:
        has_finals = has_finals | ~is_blank(F.col(f"e_{f}"))
    tag = lambda when, name: F.when(when, F.lit(name))
    outcomes = F.filter(
        F.array(
            st, tag(here & known & has_finals, "preserved"), tag(F.size("filled") > 0, "autofilled"), tag(F.col("looked_up"), "place_lookup"), tag(F.col("ambiguous"), "ambiguous_place"),
            tag(F.col("applied"), "map_link_applied"), tag(F.col("refused"), "map_link_unparsed"), tag(stale, "stale_source_text"),
        ),
        lambda o: o.isNotNull(),
    )
    gone, left = st == "went_missing", st == "kept"
    return rows.select(
        *KEY,
        F.when(here & (entry | ~known), F.col("s_reference")).otherwise(F.coalesce("e_reference", "s_reference")).alias("reference"),
        F.coalesce("s_filename", "e_filename", F.lit("")).alias("filename"),
        *[F.col(f"x_{c}").alias(c) for c in (*SOURCES, *SUGGESTIONS)],
        *[F.col(f"f_{f}").alias(f) for f in FINALS],
        *[text(f"e_{c}").alias(c) for c in HUMAN_ONLY],
        status.alias("status"), reason.alias("review_reason"), photo_id.alias("photo_id"), F.col("filled"), outcomes.alias("outcomes"),
        F.when(gone | left, F.when(left, text("t_photo_hash")).otherwise("")).otherwise(F.coalesce(F.nullif(F.col("photo_hash"), F.lit("")), "t_photo_hash", F.lit(""))).alias("state_photo_hash"),
        F.when(left, text("t_description_hash")).otherwise(F.col("description_hash")).alias("state_description_hash"),
        F.col("suggestion_hash").alias("state_suggestion_hash"),
        F.when(left, yes("t_was_absent")).otherwise(here & entry & ~present).alias("state_was_absent"),
        fingerprint.alias("state_image_fingerprint"),
        (here & entry).alias("state_source_entry_exists"),
    )


def merge_outcomes(merged: DataFrame) -> DataFrame:
    """Rows per outcome."""
    return merged.select(F.explode("outcomes").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def content_signatures(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(by, signature): digest of each group's rows. Rows are hashed one by one, and the hashes with
    their place are summed and counted, so a huge group is never gathered; order matters through
    the place."""
    place = F.concat_ws("\u001f", *[blank_if_null(F.col(c).cast("string")) for c in (*order, *columns)])
    a, b = F.xxhash64(place).cast("decimal(38,0)"), F.xxhash64(F.lit("second"), place).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(F.concat_ws("-", F.count("*"), F.sum(a), F.sum(b)).alias("signature"))


def changed_groups(rows: DataFrame, stored: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The rows of groups whose signature isn't the stored one."""
    moved = content_signatures(rows, by, order, columns).join(stored, [*by, "signature"], "left_anti").select(*by)
    return rows.join(moved, by, "left_semi")


def vanished_groups(rows: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """The groups of ``stored`` that no row belongs to any more."""
    return stored.select(*by).distinct().join(rows.select(*by).distinct(), by, "left_anti")


def write_if_changed(rows: DataFrame, stored: DataFrame, path: str, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Write only changed groups, each its own partition of the table at ``path``, and remove the partitions of
    groups that vanished; returns the new signatures."""
    gone = vanished_groups(rows, stored, by)
    changed_groups(rows, stored, by, order, columns).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    if not gone.isEmpty():
        spark = rows.sparkSession
        held = spark.read.schema(rows.schema).parquet(path)
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        jvm = spark.sparkContext._jvm
        for r in held.select(*by, folder.alias("at")).join(gone, by, "left_semi").select("at").distinct().toLocalIterator():
            place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["at"]))
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return content_signatures(rows, by, order, columns)
