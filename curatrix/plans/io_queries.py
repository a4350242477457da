"""Registered queries on edited sheets, exports, baselines, stored state and small functions, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import dates, geo, text
from curatrix.operators import catalog_io, merge, portable, review
from curatrix.plans.queries import _DIFF, C, query
from curatrix.plans.state_queries import _FOLDER_OF, _aliases, _entities
from curatrix.scratch import scratch_place
from curatrix.streaming import listing_stream

# --- edited sheets

_IMPORTED = """+ e AS (SELECT DISTINCT entity_type, canonical FROM fx_dictionary),
    j AS (SELECT s.*, e.canonical AS old, CASE WHEN e.canonical IS NOT NULL THEN s.entity_id ELSE substr(sha256(concat(s.entity_type, chr(0), s.canonical)), 1, 16) END AS id
          FROM fx_sheet s LEFT JOIN e ON e.entity_type = s.entity_type AND e.canonical = s.entity_id),
    p AS (SELECT *, CASE WHEN latlon <> 'north' THEN printf('%.6f, %.6f', CAST(split_part(latlon, ',', 1) AS DOUBLE), CAST(split_part(latlon, ',', 2) AS DOUBLE)) END AS point FROM j),
    st AS (SELECT entity_type, id, trim(unnest(string_split(rejected_aliases, ';'))) AS alias, 0 AS rank FROM j UNION ALL SELECT entity_type, id, trim(unnest(string_split(confirmed_aliases, ';'))), 1 FROM j
           UNION ALL SELECT entity_type, id, trim(unnest(string_split(candidate_aliases, ';'))), 2 FROM j),
    d AS (SELECT entity_type, id, alias, min(rank) AS rank, count(*) AS n FROM st WHERE alias <> '' GROUP BY ALL),
    b AS (SELECT DISTINCT entity_type, canonical AS id, phrase AS alias, status FROM fx_dictionary WHERE phrase <> canonical),
    o AS (SELECT d.entity_type, d.id, d.alias, d.rank, d.n, CASE d.rank WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS new, b.status AS was FROM d LEFT JOIN b USING (entity_type, id, alias)),
    a AS (SELECT 'renames' AS outcome, entity_type, id AS entity_id, canonical AS detail FROM j WHERE old IS NOT NULL AND old <> canonical
      UNION ALL SELECT 'added', entity_type, id, canonical FROM j WHERE old IS NULL
      UNION ALL SELECT 'invalid', entity_type, entity_id, canonical FROM j WHERE old IS NULL AND entity_id <> ''
      UNION ALL SELECT 'latlons', entity_type, id, point FROM p WHERE point IS NOT NULL AND point <> CASE WHEN old IS NULL THEN '' ELSE '1.000000, 2.000000' END
      UNION ALL SELECT 'bad_latlons', entity_type, id, latlon FROM p WHERE point IS NULL
      UNION ALL SELECT 'alias_' || CASE WHEN was IS NULL THEN 'added' WHEN was = new THEN 'unchanged' WHEN was = 'CANDIDATE' AND new = 'CONFIRMED' THEN 'promoted' ELSE 'changed' END, entity_type, id, alias || ' ' || new FROM o
      UNION ALL SELECT 'collisions', entity_type, id, alias FROM o WHERE n > 1
      UNION ALL SELECT 'merges', o.entity_type, o.id, e.canonical FROM o JOIN e ON e.entity_type = o.entity_type AND lower(o.alias) = lower(e.canonical) WHERE o.rank = 1 AND o.id <> e.canonical)"""


def _imported(sheet: DataFrame, phrases: DataFrame) -> dict[str, DataFrame]:
    return catalog_io.import_catalog(sheet, _entities(phrases), _aliases(phrases))


@query(["fx_sheet", "fx_dictionary"], _IMPORTED + " SELECT outcome, entity_type, entity_id, detail FROM a")
def import_catalog_outputs(sheet, phrases):
    """All eight outputs of one edited sheet, one below the other."""
    out = _imported(sheet, phrases)
    row = lambda name, by, detail: out[name].select(F.lit(name).alias("outcome"), "entity_type", C(by).alias("entity_id"), C(detail).alias("detail"))
    aliases = out["aliases"].select(F.concat(F.lit("alias_"), "outcome").alias("outcome"), "entity_type", "entity_id", F.concat_ws(" ", "alias", "status").alias("detail"))
    parts = [
        row("renames", "entity_id", "new_name"), row("added", "entity_id", "canonical"), row("invalid", "entity_id", "canonical"), row("latlons", "entity_id", "latlon"),
        row("bad_latlons", "entity_id", "latlon"), row("collisions", "entity_id", "alias"), row("merges", "survivor", "absorbed"),
    ]
    return reduce(DataFrame.unionByName, parts, aliases)


@query(["fx_sheet", "fx_dictionary"], _IMPORTED + " SELECT outcome, count(*) AS n FROM a GROUP BY outcome")
def import_outcomes(sheet, phrases):
    return catalog_io.import_outcomes(_imported(sheet, phrases))


@query(
    ["fx_dictionary"],
    """+ e AS (SELECT DISTINCT entity_type, canonical FROM fx_dictionary), s AS (SELECT entity_type, canonical, list_sort(list(DISTINCT phrase) FILTER (status = 'CONFIRMED')) AS c, list_sort(list(DISTINCT phrase) FILTER (status = 'REJECTED')) AS r
      FROM fx_dictionary WHERE phrase <> canonical GROUP BY ALL)
    SELECT entity_type, canonical AS entity_id, canonical AS name, '1.000000, 2.000000' AS latlon, CASE WHEN s.canonical IS NOT NULL THEN '[' || coalesce(list_aggregate(list_transform(c, lambda x: '"' || x || '"'), 'string_agg', ','), '') || ']' END AS confirmed,
    CASE WHEN s.canonical IS NOT NULL THEN '[' || coalesce(list_aggregate(list_transform(r, lambda x: '"' || x || '"'), 'string_agg', ','), '') || ']' END AS rejected FROM e LEFT JOIN s USING (entity_type, canonical)""",
)
def export_catalog(phrases):
    points = _entities(phrases).where("entity_type = 'place'").select("entity_id", F.lit("7,8").alias("latlon"))
    out = catalog_io.export_catalog(_entities(phrases), _aliases(phrases), points)
    member = lambda path: F.get_json_object("document", path)
    return out.select("entity_type", "entity_id", member("$.canonical").alias("name"), member("$.latlon").alias("latlon"), member("$.confirmed").alias("confirmed"), member("$.rejected").alias("rejected"))


@query(
    ["fx_dictionary"],
    """+ e AS (SELECT DISTINCT entity_type, canonical, length(canonical) AS ord FROM fx_dictionary)
    SELECT 'places:' || canonical AS record_id, ord, canonical AS label, 'places' AS sheet, field, value FROM (SELECT *, unnest(['canonical', 'latlon', 'notes']) AS field, unnest([canonical, '1.000000, 2.000000', '']) AS value FROM e WHERE entity_type = 'place')""",
)
def baseline_from_catalog(phrases):
    places = _entities(phrases).where("entity_type = 'place'").withColumns({"ord": F.length("canonical").cast("long"), "notes": F.lit(None).cast("string")})
    return merge.baseline_from_catalog(places, ["canonical", "latlon", "notes"], "places")


# --- stored state


@query(
    ["fx_listing_prev", "fx_listing_curr"],
    _DIFF + """ SELECT root_id, relative_path, CASE WHEN change = 'missing' THEN p_size ELSE c_size END AS size, CASE WHEN change = 'missing' THEN p_hash ELSE c_hash END AS content_hash,
    CASE WHEN change = 'new' THEN '2024' ELSE '2023' END AS first_seen, CASE WHEN change = 'missing' THEN '2023' ELSE '2024' END AS last_seen, CASE WHEN change = 'missing' THEN '2024' END AS missing_since FROM d""",
)
def stream_state(prev, curr):
    """Two listings folded as two micro-batches into a bucketed state."""
    state = scratch_place(prev.sparkSession, "state")
    fold = listing_stream.fold_listing(state, lambda n: f"202{3 + n}-01-01 00:00:00")
    for n, scan in enumerate((prev.drop("was_missing"), curr)):
        fold(scan, n)
    year = lambda n: F.date_format(n, "yyyy").alias(n)
    return listing_stream.read_state(prev.sparkSession, state).select("root_id", "relative_path", "size", "content_hash", year("first_seen"), year("last_seen"), year("missing_since"))


@query(
    ["fx_listing_prev", "fx_listing_curr"],
    """+ p AS (SELECT root_id, relative_path, size, content_hash FROM fx_listing_prev), c AS (SELECT root_id, relative_path, size, content_hash FROM fx_listing_curr)
    SELECT *, 'added' AS change FROM (FROM c EXCEPT ALL FROM p) UNION ALL SELECT *, 'removed' FROM (FROM p EXCEPT ALL FROM c)""",
)
def snapshot_diff(prev, curr):
    """Two listings published as generations 1 and 2; the difference reads only buckets that differ."""
    spark, base = prev.sparkSession, scratch_place(prev.sparkSession, "generations")
    for n, rows in enumerate((prev, curr)):
        portable.publish_snapshot({"items": rows.select("root_id", "relative_path", "size", "content_hash")}, base, n)
    return portable.diff_generations(spark, base, "items", 1, 2)


@query(["fx_listing_prev", "fx_listing_curr"], f"SELECT DISTINCT root_id, {_FOLDER_OF} AS folder FROM fx_listing_prev WHERE NOT (root_id = 'root1' AND {_FOLDER_OF} LIKE 'f1%') EXCEPT SELECT root_id, {_FOLDER_OF} FROM fx_listing_curr WHERE size % 7 <> 0 AND {_FOLDER_OF} NOT LIKE 'f2%'")
def vanished_groups(prev, curr):
    rows = lambda df: df.select("root_id", text.parent_path(C("relative_path")).alias("folder"), "relative_path", "content_hash", "size")
    stored = review.content_signatures(rows(prev).where("NOT (root_id = 'root1' AND folder LIKE 'f1%')"), ["root_id", "folder"], ["relative_path"], ["content_hash"])
    return review.vanished_groups(rows(curr).where("size % 7 <> 0 AND folder NOT LIKE 'f2%'"), stored, ["root_id", "folder"])


# --- small functions


@query(
    ["fx_review_rows"],
    r"""SELECT root, folder, reference, folder || '|' || lower(reference) AS row_key, root || '/' || folder || '/' || reference AS destination, regexp_replace(people, ', ', '; ') AS people, 'sha256:' || sha256(reference) AS content_hash,
    CASE WHEN latlon <> '' THEN 'https://www.google.com/maps/search/?api=1&query=' || replace(latlon, ', ', ',') END AS map_url,
    CASE length(date) WHEN 4 THEN date || '-07-01 12:00:00' WHEN 7 THEN date || '-15 12:00:00' WHEN 10 THEN date || ' 12:00:00' END AS stamp FROM fx_review_rows""",
)
def row_scalars(rows):
    stamp = dates.compat_timestamp_strict(dates.parse_archive_date(C("date")))
    return rows.select(
        "root", "folder", "reference", text.row_key(C("folder"), C("reference")).alias("row_key"), text.destination_path(C("root"), F.concat_ws("/", "folder", "reference")).alias("destination"),
        text.join_values(F.split("people", ",")).alias("people"), text.content_hash(F.col("reference").cast("binary")).alias("content_hash"), geo.map_url(geo.parse_latlon(C("latlon"))).alias("map_url"),
        F.when(C("date") != "", F.date_format(stamp["value"], "yyyy-MM-dd HH:mm:ss")).alias("stamp"),
    )
