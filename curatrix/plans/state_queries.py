"""Registered queries on recorded state, catalog sheets and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import semantic, text
from curatrix.operators import catalog_io, dictionary, listing, merge, portable, review
from curatrix.plans.queries import _DIFF, _MOVES, C, moves_of, query

_FOLDER_OF = "regexp_replace(relative_path, '/[^/]*$', '')"


@query(
    ["fx_listing_prev", "fx_listing_curr"],
    _DIFF + " SELECT root_id, count(*) AS files, count(*) FILTER (change <> 'missing') AS present, count(*) FILTER (change = 'missing') AS missing, count(CASE WHEN change = 'missing' THEN p_hash ELSE c_hash END) AS with_hash FROM d GROUP BY root_id",
)
def snapshot_counters(prev, curr):
    then, now = F.lit("2023-01-01").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    recorded = prev.withColumns({"first_seen": then, "last_seen": then, "missing_since": F.when(C("was_missing"), then)})
    return listing.snapshot_counters(listing.apply_listing(recorded, curr, now))


@query(
    ["fx_listing_prev", "fx_listing_curr"],
    f"""+ p AS (SELECT root_id, {_FOLDER_OF} AS folder, relative_path, coalesce(content_hash, '') AS h FROM fx_listing_prev), c AS (SELECT root_id, {_FOLDER_OF} AS folder, relative_path, coalesce(content_hash, '') AS h FROM fx_listing_curr),
    g AS (SELECT root_id, folder FROM (SELECT * FROM p EXCEPT SELECT * FROM c) UNION SELECT root_id, folder FROM (SELECT * FROM c EXCEPT SELECT * FROM p)) SELECT root_id, folder, count(*) AS rows FROM c SEMI JOIN g USING (root_id, folder) GROUP BY ALL""",
)
def changed_groups(prev, curr):
    def rows(df: DataFrame) -> DataFrame:
        return df.select("root_id", text.parent_path(C("relative_path")).alias("folder"), "relative_path", "content_hash")

    by = ["root_id", "folder"]
    stored = review.content_signatures(rows(prev), by, ["relative_path"], ["content_hash"])
    return review.changed_groups(rows(curr), stored, by, ["relative_path"], ["content_hash"]).groupBy(*by).agg(F.count("*").alias("rows"))


@query(["fx_listing_prev"], _MOVES + " SELECT ff AS folder_from, tf AS folder_to, count(*) AS files FROM a GROUP BY ALL")
def moved_folders(prev):
    return listing.moved_folders(moves_of(prev))


@query(
    ["fx_existing", "fx_photos"],
    """+ r AS (SELECT root, folder, reference, identity FROM fx_existing WHERE status = 'DESCRIBED_ABSENT'), p AS (SELECT concat('g', substr(folder, 2)) AS found_folder, name AS found_name, lower(regexp_replace(name, '\\.[^.]*$', '')) AS identity FROM fx_photos)
    SELECT root, folder, reference, identity, found_folder, found_name FROM r JOIN p USING (identity)""",
)
def orphan_descriptions(existing, photos):
    return listing.orphan_descriptions(existing, photos.withColumn("folder", F.concat(F.lit("g"), F.substring("folder", 2, 9))))


_ORPHANS = """+ r AS (SELECT root, folder, reference, identity FROM fx_existing WHERE status = 'DESCRIBED_ABSENT'),
    p AS (SELECT concat('g', substr(folder, 2, 1), '/', folder, CASE WHEN length(name) % 2 = 0 THEN '/deep' ELSE '' END) AS found_folder, concat(substr(name, 1, 5), '.jpg') AS found_name, lower(substr(name, 1, 5)) AS identity FROM fx_photos),
    q AS (SELECT root, concat('g', substr(folder, 2, 1), '/', folder) AS folder, substr(reference, 1, 5) AS reference, lower(substr(reference, 1, 5)) AS identity FROM r),
    a AS (SELECT q.*, p.found_folder, p.found_name, len(list_filter(range(1, 9), lambda n: string_split(q.folder, '/')[1:n] = string_split(p.found_folder, '/')[1:n] AND n <= len(string_split(q.folder, '/')) AND n <= len(string_split(p.found_folder, '/')))) AS shared
          FROM (SELECT DISTINCT * FROM q) q JOIN p ON q.identity = p.identity AND q.folder <> p.found_folder)
    SELECT root, folder, reference, identity, count(*) AS candidates, arg_min(found_folder, (-shared, found_folder, found_name)) AS found_folder, arg_min(found_name, (-shared, found_folder, found_name)) AS found_name, CAST(max(shared) AS INTEGER) AS shared
    FROM a GROUP BY ALL"""


@query(["fx_existing", "fx_photos"], _ORPHANS)
def nearest_orphans(existing, photos):
    """Names cut to a few stems, so each stem has many files in many folders."""
    deep = F.when(F.length("name") % 2 == 0, "/deep").otherwise("")
    files = photos.select(F.concat(F.lit("g"), F.substring("folder", 2, 1), F.lit("/"), "folder", deep).alias("folder"), F.concat(F.substring("name", 1, 5), F.lit(".jpg")).alias("name"))
    rows = existing.withColumns({"folder": F.concat(F.lit("g"), F.substring("folder", 2, 1), F.lit("/"), C("folder")), "reference": F.substring("reference", 1, 5)})
    return listing.nearest_orphans(rows, files)


@query(
    ["fx_states"],
    "SELECT root, folder, identity, CASE WHEN photo_id <> '' THEN 'NEW' ELSE status END AS status FROM fx_states UNION ALL SELECT root, folder, identity || 'x', 'NEW' FROM fx_states WHERE photo_id <> ''",
)
def upsert_row_states(states):
    some = states.where("photo_id <> ''").withColumns({"status": F.lit("NEW"), "ord": F.lit(2)})
    new = some.unionByName(some.withColumn("identity", F.concat("identity", F.lit("x")))).unionByName(some.withColumns({"status": F.lit("ERROR"), "ord": F.lit(1)}))
    return review.upsert_row_states(states, new).select("root", "folder", "identity", "status")


@query(
    ["fx_states"],
    """SELECT root, folder, identity, CASE WHEN length(identity) % 2 = 0 THEN 'h' ELSE 'old' END AS source_hash, status, coalesce(nullif(photo_id, ''), 'kept') AS photo_id, 'fp' AS image_fingerprint, description_hash FROM fx_states WHERE folder < 'f3'
    UNION ALL SELECT root, folder, identity, 'old', 'OLD', 'kept', 'fp', 'odd' FROM fx_states WHERE folder >= 'f3'""",
)
def snapshot_merge(states):
    old = {"source_hash": F.lit("old"), "status": F.lit("OLD"), "photo_id": F.lit("kept"), "image_fingerprint": F.lit("fp"), "description_hash": F.lit("odd"), "suggestion_hash": F.lit(""), "source_entry_exists": F.lit(False), "size": F.lit(1).cast("long"), "remote_id": F.lit("r")}
    facts = {"source_hash": F.when(F.length("identity") % 2 == 0, "h"), "size": F.lit(2).cast("long"), "remote_id": F.lit(None).cast("string")}
    now = states.withColumns({"suggestion_hash": F.lit(""), "source_entry_exists": F.lit(True)})
    out = portable.snapshot_merge(states.withColumns(old), now, states.select(*portable.KEY).withColumns(facts), states.where("folder < 'f3'").select("root", "folder").distinct())
    return out.select(*portable.KEY, "source_hash", "status", "photo_id", "image_fingerprint", "description_hash")


@query(
    ["fx_review_rows"],
    """SELECT reference, (trim(review_reason) <> '' OR status IN ('REVIEW', 'SOURCE_CHANGED') OR date = '' OR place = '' OR latlon = '' OR people = '' OR tags = '') AS needsreview, people = '' AS nopeople, place = '' AS noplace, latlon = '' AS nolatlon, tags = '' AS notags, status = 'DESCRIBED_ABSENT' AS absent,
    lower(concat_ws(' ', reference, '', '', '', '', date, place, people, tags, '', '', '', '', '')) AS search FROM fx_review_rows""",
)
def card_flags(rows):
    row = {c: C(c) for c in rows.columns}
    return rows.select("reference", *[v.alias(k) for k, v in semantic.card_flags(row).items()], semantic.search_text(row).alias("search"))


@query(
    ["fx_sync"],
    """SELECT path, CASE WHEN l IS NOT NULL THEN l ELSE c END AS last_common_hash, CASE WHEN l IS NOT NULL THEN 'new' ELSE 'old' END AS remote_file_id, CASE WHEN l IS NOT NULL THEN 'now' ELSE 'then' END AS last_sync FROM fx_sync""",
)
def record_sync(sync):
    state = sync.select("path", C("c").alias("last_common_hash"), F.lit("old").alias("remote_file_id"), F.lit("then").alias("last_sync"))
    return merge.record_sync(state, sync.where("l IS NOT NULL").select("path", C("l").alias("hash"), F.lit("new").alias("remote_file_id")), F.lit("now"))


@query(
    ["fx_merge_base", "fx_merge_local", "fx_merge_remote"],
    """+ s AS (SELECT record_id, 0 AS side FROM fx_merge_base UNION ALL SELECT record_id, 1 FROM fx_merge_local UNION ALL SELECT record_id, 2 FROM fx_merge_remote)
    SELECT record_id, min(side) AS side, CAST(substr(record_id, 2) AS BIGINT) AS ord FROM s GROUP BY record_id""",
)
def merge_order(base, local, remote):
    ordered = lambda df: df.withColumn("ord", F.substring("record_id", 2, 20).cast("long"))
    return merge.merge_order(ordered(base), ordered(local), ordered(remote))


def _entities(phrases: DataFrame) -> DataFrame:
    named = phrases.select("entity_type", "canonical").distinct()
    return named.select("entity_type", C("canonical").alias("entity_id"), "canonical", F.lit("1.000000, 2.000000").alias("latlon"), F.lit("").alias("notes"))


def _aliases(phrases: DataFrame) -> DataFrame:
    return phrases.where("phrase <> canonical").select("entity_type", C("canonical").alias("entity_id"), C("phrase").alias("alias"), "status")


@query(
    ["fx_dictionary"],
    """+ e AS (SELECT DISTINCT entity_type, canonical FROM fx_dictionary), a AS (SELECT * FROM fx_dictionary WHERE phrase <> canonical),
    s AS (SELECT entity_type, canonical, string_agg(DISTINCT phrase, '; ' ORDER BY phrase) FILTER (status = 'CONFIRMED') AS c, string_agg(DISTINCT phrase, '; ' ORDER BY phrase) FILTER (status = 'CANDIDATE') AS d, string_agg(DISTINCT phrase, '; ' ORDER BY phrase) FILTER (status = 'REJECTED') AS r FROM a GROUP BY ALL),
    v AS (SELECT entity_type, canonical, count(*) AS n FROM fx_dictionary WHERE entity_type <> 'tag' GROUP BY ALL)
    SELECT entity_type, canonical AS entity_id, canonical, coalesce(c, '') AS confirmed_aliases, coalesce(d, '') AS candidate_aliases, coalesce(r, '') AS rejected_aliases, CASE WHEN entity_type = 'place' THEN '5.000000, 6.000000; 7,8' ELSE '' END AS candidate_latlon,
    '1.000000, 2.000000' AS latlon, '' AS notes, coalesce(n, 0) AS evidence_count FROM e LEFT JOIN s USING (entity_type, canonical) LEFT JOIN v USING (entity_type, canonical)""",
)
def catalog_sheets(phrases):
    points = _entities(phrases).where("entity_type = 'place'").select("entity_id", F.explode(F.array(F.lit("7,8"), F.lit("5.000000, 6.000000"), F.lit("north"))).alias("latlon"))
    return catalog_io.catalog_sheets(_entities(phrases), _aliases(phrases), points, phrases.where("entity_type <> 'tag'"))


@query(
    ["fx_dictionary"],
    """+ n AS (SELECT DISTINCT entity_type, canonical, lower(phrase) AS key FROM fx_dictionary WHERE status = 'CONFIRMED' AND phrase <> canonical), e AS (SELECT DISTINCT entity_type, canonical FROM fx_dictionary UNION SELECT 'place', upper(phrase) FROM fx_dictionary WHERE entity_type = 'place')
    SELECT n.entity_type, n.canonical AS survivor, e.canonical AS absorbed FROM n JOIN e ON n.entity_type = e.entity_type AND n.key = lower(e.canonical) WHERE n.canonical <> e.canonical""",
)
def duplicate_entity_pairs(phrases):
    more = phrases.where("entity_type = 'place'").select("entity_type", F.upper("phrase").alias("entity_id"), F.upper("phrase").alias("canonical")).distinct()
    return dictionary.duplicate_entity_pairs(_entities(phrases).select("entity_type", "entity_id", "canonical").unionByName(more), _aliases(phrases))


@query(
    ["fx_dictionary"],
    """+ a AS (SELECT entity_type, canonical AS entity_id, phrase AS alias, status FROM fx_dictionary WHERE phrase <> canonical)
    SELECT entity_type, entity_id, alias, CASE WHEN status = 'CONFIRMED' THEN 'REJECTED' WHEN status = 'CANDIDATE' THEN 'CONFIRMED' ELSE status END AS status FROM a UNION ALL SELECT entity_type, entity_id, alias || '!', 'CONFIRMED' FROM a""",
)
def set_alias_status(phrases):
    aliases = _aliases(phrases)
    flipped = aliases.where("status <> 'REJECTED'").withColumn("status", F.when(C("status") == "CONFIRMED", "REJECTED").otherwise("CONFIRMED"))
    return dictionary.set_alias_status(aliases, flipped.unionByName(aliases.withColumns({"alias": F.concat("alias", F.lit("!")), "status": F.lit("CONFIRMED")})))


@query(
    ["fx_dictionary"],
    """SELECT entity_type, entity_id, alias, status, outcome FROM (SELECT DISTINCT entity_type, canonical AS entity_id, phrase AS alias, CASE status WHEN 'REJECTED' THEN 'REJECTED' ELSE 'CONFIRMED' END AS status,
    CASE status WHEN 'CANDIDATE' THEN 'promoted' ELSE 'unchanged' END AS outcome FROM fx_dictionary WHERE phrase <> canonical)""",
)
def import_catalog(phrases):
    grouped = _aliases(phrases).groupBy("entity_type", "entity_id").agg(
        F.array_join(F.collect_set(F.when(C("status") != "REJECTED", C("alias"))), "; ").alias("confirmed_aliases"), F.array_join(F.collect_set(F.when(C("status") == "REJECTED", C("alias"))), ";").alias("rejected_aliases")
    )
    sheet = _entities(phrases).join(grouped, ["entity_type", "entity_id"], "left").withColumn("candidate_aliases", C("confirmed_aliases"))
    return catalog_io.import_catalog(sheet, _entities(phrases), _aliases(phrases))["aliases"]


@query(
    ["fx_paragraphs"],
    r"SELECT folder, pos, sha256(concat(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(0), folder, chr(0))) AS text_hash, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS description_hash FROM fx_paragraphs",
)
def text_hashes(paragraphs):
    return paragraphs.select("folder", "pos", text.text_hash(C("text"), C("folder"), F.lit(None).cast("string")).alias("text_hash"), text.description_hash(C("text")).alias("description_hash"))


@query(
    ["fx_review_rows"],
    """SELECT reference, CASE WHEN people <> '' THEN 3 ELSE 0 END + CASE WHEN place <> '' THEN 1 ELSE 0 END + CASE WHEN tags <> '' THEN 1 ELSE 0 END AS links, CASE WHEN people <> '' THEN 'photos' WHEN place <> '' THEN 'drive' WHEN tags <> '' THEN 'yandex' END AS first_kind FROM fx_review_rows""",
)
def destination_links(rows):
    links = semantic.destination_links(C("people"), C("place"), C("tags"), C("status") == "NEW")
    weight = F.aggregate(links, F.lit(0), lambda n, x: n + F.when(x["kind"] == "photos", 3).otherwise(1))
    return rows.select("reference", weight.alias("links"), semantic.primary_link(links)["kind"].alias("first_kind"))
