"""Registered queries on names, notes, provenance, sources, entities and proposals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import semantic, text
from curatrix.operators import catalog_io, dictionary, listing, merge, portable, reports, review
from curatrix.plans.queries import _TEXTS, ORACLES, C, _text_ids, query
from curatrix.plans.state_queries import _aliases, _entities

_SHARE = "https://share.example/"
_THEN, _NOW = "2023-01-01 00:00:00", "2024-01-01 00:00:00"
_CANDIDATES = f"""{_TEXTS}, d AS (SELECT *, lower(trim(phrase)) AS needle FROM fx_dictionary WHERE status <> 'REJECTED'),
    m AS (SELECT text_id, low, entity_type, canonical, phrase, status, needle, unnest(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, length(needle)) = needle)) AS i FROM t JOIN d ON contains(low, needle)),
    c AS (SELECT DISTINCT text_id, entity_type, canonical, phrase, status, CAST(i - 1 AS INTEGER) AS s, CAST(i - 1 + length(needle) AS INTEGER) AS e FROM m
    WHERE NOT regexp_matches(CASE WHEN i > 1 THEN substr(low, i - 1, 1) ELSE '' END, '[0-9A-Za-zА-Яа-яЁё_]') AND NOT regexp_matches(substr(low, i + length(needle), 1), '[0-9A-Za-zА-Яа-яЁё_]'))"""
#: Greedy claim: candidates in order, each kept if it overlaps none kept before.
_CLAIMED = (
    _CANDIDATES
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY text_id, entity_type ORDER BY length(phrase) DESC, phrase, canonical, s, e, status) AS n FROM c),
    g AS (SELECT text_id, entity_type, n, [{'canonical': canonical, 'phrase': phrase, 'status': status, 's': s, 'e': e}] AS kept FROM r WHERE n = 1
      UNION ALL SELECT r.text_id, r.entity_type, r.n, CASE WHEN len(list_filter(g.kept, lambda x: x.s < r.e AND x.e > r.s)) = 0
        THEN list_append(g.kept, {'canonical': r.canonical, 'phrase': r.phrase, 'status': r.status, 's': r.s, 'e': r.e}) ELSE g.kept END
      FROM g JOIN r ON r.text_id = g.text_id AND r.entity_type = g.entity_type AND r.n = g.n + 1),
    k AS (SELECT text_id, entity_type, unnest(arg_max(kept, n)) AS x FROM g GROUP BY text_id, entity_type)"""
)


@query(
    ["fx_paragraphs", "fx_dictionary"],
    f"""+ {_CLAIMED} SELECT text_id, entity_type, x.canonical AS canonical, x.phrase AS phrase, x.status AS status, x.s AS start, x.e AS "end", substr(p.text, x.s + 1, x.e - x.s) AS matched_text
    FROM k JOIN (SELECT folder || '|' || pos AS text_id, text FROM fx_paragraphs) p USING (text_id)""",
    recursive=True,
)
def find_matches(paragraphs, phrases):
    return dictionary.find_matches(_text_ids(paragraphs), phrases)


@query(
    ["fx_paragraphs", "fx_dictionary"],
    f"""+ {_CLAIMED}, f AS (SELECT text_id, entity_type, x.canonical AS canonical, min(x.s) AS s FROM k WHERE x.status = 'CONFIRMED' GROUP BY ALL)
    SELECT text_id, entity_type, string_agg(canonical, '; ' ORDER BY s, canonical) AS canonicals FROM f GROUP BY ALL""",
    recursive=True,
)
def confirmed_canonicals(paragraphs, phrases):
    found = dictionary.confirmed_canonicals(dictionary.find_matches(_text_ids(paragraphs), phrases))
    return found.select("text_id", "entity_type", F.array_join("canonicals", "; ").alias("canonicals"))


@query(
    ["fx_paragraphs", "fx_dictionary"],
    """+ v AS (SELECT DISTINCT canonical AS value FROM fx_dictionary UNION SELECT DISTINCT '  ' || upper(phrase) || ' ' FROM fx_dictionary UNION SELECT DISTINCT folder FROM fx_paragraphs),
    t AS (SELECT DISTINCT entity_type FROM fx_dictionary), q AS (SELECT entity_type, lower(trim(phrase)) AS key, min(canonical) AS canonical FROM fx_dictionary WHERE status = 'CONFIRMED' GROUP BY ALL)
    SELECT t.entity_type, v.value, q.canonical FROM t CROSS JOIN v LEFT JOIN q ON q.entity_type = t.entity_type AND q.key = lower(trim(v.value))""",
)
def resolve_canonical(paragraphs, phrases):
    values = phrases.select(C("canonical").alias("value")).union(phrases.select(F.concat(F.lit("  "), F.upper("phrase"), F.lit(" ")))).union(paragraphs.select("folder")).distinct()
    kinds = F.array(F.lit("person"), F.lit("place"), F.lit("tag"))
    return dictionary.resolve_canonical(values.select(F.explode(kinds).alias("entity_type"), "value"), phrases)


@query(
    ["fx_listing_prev"],
    f"""+ u AS (SELECT root_id, relative_path, CASE WHEN size % 2 = 0 THEN '{_SHARE}' ELSE 'ftp://share.example/' END || relative_path AS url FROM fx_listing_prev)
    SELECT root_id, relative_path, CASE WHEN url LIKE 'https:%' THEN url END AS public_key, regexp_extract(relative_path, '[^/]*$') AS name FROM u""",
)
def link_names(prev):
    url = F.concat(F.when(C("size") % 2 == 0, _SHARE).otherwise("ftp://share.example/"), C("relative_path"))
    asked = F.concat(F.lit(" "), url, F.when(C("size") % 3 == 0, "/?a=b/c#d").otherwise("//"))
    return prev.select("root_id", "relative_path", text.public_key_from_url(F.concat(url, F.lit(" ")), [_SHARE]).alias("public_key"), text.fallback_root_name(asked).alias("name"))


@query(
    ["fx_state_rows"],
    """SELECT root, folder, identity, concat_ws(chr(10) || chr(10), nullif(source_description, ''), 'Раздел: ' || nullif(section_context, ''), 'Пометки: ' || nullif(source_notes, '')) AS note FROM fx_state_rows""",
)
def source_note_text(rows):
    return rows.select("root", "folder", "identity", semantic.source_note_text(F.concat(C("source_description"), F.lit(" \n")), C("section_context"), C("source_notes")).alias("note"))


@query(
    ["fx_listing_prev"],
    """SELECT root_id, relative_path, strftime(modified_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp, true AS round_trip,
    CASE WHEN was_missing THEN 'unknown time' ELSE strftime(modified_at, '%Y-%m-%dT%H:%M:%SZ') END || ' on ' || root_id || CASE WHEN size % 2 = 0 THEN '' ELSE ' run ' || size END AS provenance FROM fx_listing_prev""",
)
def provenance(prev):
    at = C("modified_at").cast("timestamp")
    told = text.describe_provenance(F.when(~C("was_missing"), at), C("root_id"), F.when(C("size") % 2 == 0, "").otherwise(C("size").cast("string")))
    stamp = text.format_timestamp(at)
    return prev.select("root_id", "relative_path", stamp.alias("stamp"), (text.parse_timestamp(stamp) == at).alias("round_trip"), told.alias("provenance"))


@query(
    ["fx_paragraphs"],
    """+ p AS (SELECT folder, pos, text, regexp_extract(text, '^[A-Za-z0-9_]+') AS token FROM fx_paragraphs),
    s AS (SELECT folder, pos, token, regexp_replace(substr(text, length(token) + 1), '^[ .:-]+|[ .:-]+$', '', 'g') AS after FROM p)
    SELECT folder, pos, after AS note, CASE WHEN after <> '' THEN after ELSE token END AS kept FROM s""",
)
def strip_reference(paragraphs):
    size = F.length(F.regexp_extract("text", "^[A-Za-z0-9_]+", 0))
    behind = F.concat(F.lit("- «"), C("text"), F.lit("»."))  # the reference then stands at 3
    turned = F.concat(F.substring(C("text"), F.lit(1), size), F.lit(" - X1"))
    plain = text.strip_reference(behind, F.lit(0), size + 3)
    rest = text.strip_reference(turned, size + 3, size + 5)
    return paragraphs.select("folder", "pos", F.when(plain == "-", "").otherwise(plain).alias("note"), F.when(plain.isin("", "-"), rest).otherwise(plain).alias("kept"))


@query(
    ["fx_paragraphs"],
    """SELECT folder, pos, pos % 3 <> 2 AS dependent FROM fx_paragraphs""",
)
def context_dependent(paragraphs):
    words = F.when(C("pos") % 3 == 0, "Мама, ").when(C("pos") % 3 == 1, "(дядя) ").otherwise("мамаша ")
    return paragraphs.select("folder", "pos", text.is_context_dependent(F.concat(words, C("text"))).alias("dependent"))


@query(
    ["fx_dictionary"],
    """SELECT DISTINCT entity_type, canonical, canonical AS phrase, 'CONFIRMED' AS status FROM fx_dictionary
    UNION ALL SELECT entity_type, canonical, phrase, status FROM fx_dictionary WHERE phrase <> canonical AND status <> 'REJECTED'""",
)
def active_phrases(phrases):
    return dictionary.active_phrases(_entities(phrases), _aliases(phrases))


@query(
    ["fx_dictionary"],
    """+ e AS (SELECT DISTINCT entity_type, canonical FROM fx_dictionary)
    SELECT entity_type, canonical AS entity_id, CASE WHEN entity_type = 'place' THEN upper(canonical) ELSE canonical END AS canonical FROM e
    UNION ALL SELECT entity_type, substr(sha256(entity_type || chr(0) || canonical || '!'), 1, 16), canonical || '!' FROM e WHERE entity_type <> 'tag'""",
)
def add_and_rename_entities(phrases):
    entities = _entities(phrases).select("entity_type", "entity_id", "canonical")
    named = dictionary.rename_entity(entities, entities.where("entity_type = 'place'").select("entity_id", F.upper("canonical").alias("new_name")))
    fresh = entities.where("entity_type <> 'tag'").select("entity_type", F.concat("canonical", F.lit("!")).alias("canonical"))
    return dictionary.add_entity(named, fresh.union(fresh).union(named.select("entity_type", "canonical")))


@query(
    ["fx_dictionary"],
    """SELECT DISTINCT canonical AS entity_id, '7.000000, 8.000000' AS latlon FROM fx_dictionary WHERE entity_type = 'place' UNION SELECT canonical, '5.000000, 6.000000' FROM fx_dictionary WHERE entity_type = 'place' AND length(canonical) % 2 = 0""",
)
def clear_candidate(phrases):
    points = phrases.where("entity_type = 'place'").select(C("canonical").alias("entity_id")).distinct()
    both = points.withColumn("latlon", F.explode(F.array(F.lit("7.000000, 8.000000"), F.lit("5.000000, 6.000000"))))
    return dictionary.clear_candidate(both, points.where(F.length("entity_id") % 2 == 1).withColumn("latlon", F.lit("5.000000, 6.000000")))


@query(
    ["fx_dictionary"],
    """+ a AS (SELECT DISTINCT entity_type, canonical, phrase FROM fx_dictionary WHERE phrase <> canonical) SELECT entity_type, canonical AS entity_id, phrase AS alias FROM a WHERE length(phrase) % 2 = 0""",
)
def alias_collisions(phrases):
    aliases = _aliases(phrases).withColumn("even", F.length("alias") % 2 == 0)
    sheet = _entities(phrases).join(
        aliases.groupBy("entity_type", "entity_id").agg(
            F.array_join(F.collect_set("alias"), "; ").alias("confirmed_aliases"), F.array_join(F.collect_set(F.when(C("even"), C("alias"))), ";").alias("rejected_aliases")
        ),
        ["entity_type", "entity_id"],
        "left",
    )
    return catalog_io.import_catalog(sheet.withColumn("candidate_aliases", F.lit("")), _entities(phrases), _aliases(phrases))["collisions"]


@query(
    ["fx_listing_prev", "fx_listing_curr"],
    f"""+ r AS (SELECT DISTINCT root_id FROM fx_listing_prev WHERE root_id <> 'root0'), s AS (SELECT DISTINCT root_id FROM fx_listing_curr WHERE root_id <> 'root1')
    SELECT coalesce(r.root_id, s.root_id) AS identity, CASE WHEN s.root_id IS NOT NULL THEN 'new ' ELSE 'old ' END || coalesce(r.root_id, s.root_id) AS name,
    CASE WHEN r.root_id IS NOT NULL THEN '{_THEN}' ELSE '{_NOW}' END AS first_seen, CASE WHEN s.root_id IS NOT NULL THEN '{_NOW}' ELSE '{_THEN}' END AS last_scan
    FROM r FULL JOIN s USING (root_id)""",
)
def upsert_source_root(prev, curr):
    def roots(df, word: str):
        named = F.concat(F.lit(word), C("root_id"))
        return df.select(C("root_id").alias("identity"), named.alias("source_url"), named.alias("name"), named.alias("destination_name")).distinct()

    then, now = (F.lit(x).cast("timestamp") for x in (_THEN, _NOW))
    old = roots(prev.where("root_id <> 'root0'"), "old ").withColumns({"first_seen": then, "last_scan": then})
    out = portable.list_roots(listing.upsert_source_root(old, roots(curr.where("root_id <> 'root1'"), "new "), now))
    return out.select("identity", "name", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_scan")])


@query(
    ["fx_listing_prev", "fx_listing_curr"],
    f"""+ m AS (SELECT DISTINCT regexp_replace(relative_path, '/.*', '') AS id FROM fx_listing_prev WHERE root_id = 'root0'), s AS (SELECT DISTINCT regexp_replace(relative_path, '/.*', '') AS id FROM fx_listing_curr WHERE root_id <> 'root0')
    SELECT id AS machine_id, CASE WHEN s.id IS NULL OR (m.id IS NOT NULL AND length(id) = 2) THEN 'old' WHEN length(id) = 2 THEN '' ELSE 'new' END AS label,
    CASE WHEN m.id IS NOT NULL THEN '{_THEN}' ELSE '{_NOW}' END AS first_seen, CASE WHEN s.id IS NOT NULL THEN '{_NOW}' ELSE '{_THEN}' END AS last_seen FROM m FULL JOIN s USING (id)""",
)
def record_machine(prev, curr):
    top = F.regexp_replace("relative_path", "/.*", "").alias("machine_id")
    then, now = (F.lit(x).cast("timestamp") for x in (_THEN, _NOW))
    old = prev.where("root_id = 'root0'").select(top).distinct().withColumns({"label": F.lit("old"), "first_seen": then, "last_seen": then})
    seen = curr.where("root_id <> 'root0'").select(top).distinct().withColumn("label", F.when(F.length("machine_id") == 2, "").otherwise("new"))
    return portable.record_machine(old, seen, now).select("machine_id", "label", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])


@query(["fx_listing_prev"], "SELECT root_id, relative_path, false AS is_directory, size, modified_at, content_hash FROM fx_listing_prev WHERE NOT was_missing")
def state_to_listing(prev):
    return portable.state_to_listing(prev.withColumn("missing_since", F.when(C("was_missing"), F.lit(_THEN).cast("timestamp"))))


@query(["fx_states"], "SELECT folder, identity, status FROM fx_states WHERE root = 'root' AND folder = 'f7'")
def load_row_states(states):
    return portable.load_row_states(states, "root", "f7").select("folder", "identity", "status")


@query(
    ["fx_review_rows"],
    """SELECT root, folder, reference, CASE WHEN status IN ('REVIEW') AND length(reference) % 2 = 0 THEN 'NEW' ELSE status END AS status, place, '' AS event FROM fx_review_rows""",
)
def read_review_rows(rows):
    sheet = rows.withColumn("pos", C("reference").cast("long"))
    odd = F.when((C("status") == "REVIEW") & (F.length("reference") % 2 == 0), "reviewed").otherwise(C("status"))
    late = sheet.select("root", "folder", F.concat(F.lit(" "), C("reference"), F.lit(" ")).alias("Reference"), odd.alias("STATUS"), F.concat("place", F.lit(" ")).alias("place"), (C("pos") + 1).alias("pos"))
    early = sheet.select("root", "folder", "reference", F.lit("SKIP"), F.lit("other"), "pos")
    blank = sheet.select("root", "folder", F.lit("  "), "status", "place", "pos")
    return review.read_review_rows(late.union(early).union(blank), ("place", "event")).select("root", "folder", "reference", "status", "place", "event")


@query(
    ["fx_review_rows"],
    """+ b AS (SELECT reference AS record_id, place, people FROM fx_review_rows) SELECT record_id, 'place' AS field, place AS value FROM b UNION ALL SELECT record_id, 'people', people FROM b""",
)
def baseline_from_rows(rows):
    out = merge.baseline_from_rows(rows, ["place", "people"], C("reference"), C("reference").cast("long"), C("folder"))
    return out.select("record_id", "field", "value")


@query(
    ["fx_review_rows"],
    """SELECT root, folder, reference, tags FROM fx_review_rows WHERE NOT (tags = 'tag3' OR folder = 'f4' AND tags = 'tag5')""",
)
def rejected_proposals(rows):
    refused = rows.where("tags = 'tag3' OR folder = 'f4' AND tags = 'tag5'").select("folder", "tags").distinct()
    return portable.rejected_proposals(rows.select("root", "folder", "reference", "tags"), refused, ["folder", "tags"])


@query(
    ["fx_review_rows"],
    """+ w AS (SELECT reference, concat_ws('. ', nullif(date, ''), nullif(place, ''), nullif(people, '')) AS head, nullif(tags, '') AS prose FROM fx_review_rows)
    SELECT reference, concat_ws('. ', nullif(head, ''), prose) AS caption, CASE WHEN length(reference) % 2 = 0 THEN CASE WHEN prose IS NULL THEN 'create' ELSE 'replace' END WHEN prose IS NULL THEN 'none' ELSE 'leave' END AS decision FROM w""",
)
def captions(rows):
    told = portable.compose_description(C("place"), C("date"), C("people"), C("tags"))
    decision = portable.republish_decision(C("tags") != "", F.length("reference") % 2 == 0)
    return rows.select("reference", told.alias("caption"), decision.alias("decision"))


_SUGGESTED = (
    _CLAIMED
    + f""", f AS (SELECT text_id, entity_type, x.canonical AS canonical, min(x.s) AS s FROM k WHERE x.status = 'CONFIRMED' GROUP BY ALL),
    l AS (SELECT text_id, {", ".join(f"count(*) FILTER (entity_type = '{e}') AS n_{e}, string_agg(canonical, '; ' ORDER BY s, canonical) FILTER (entity_type = '{e}') AS {e}" for e in ("person", "place", "tag"))} FROM f GROUP BY text_id),
    h AS (SELECT text_id, count(*) AS candidates FROM k WHERE x.status = 'CANDIDATE' GROUP BY text_id),
    sd AS (SELECT folder || '|' || pos AS text_id, suggested FROM ({ORACLES["suggest_date"]})),
    o AS (SELECT text_id AS entry_id, suggested AS date, CASE WHEN n_place = 1 THEN place ELSE '' END AS place, CASE WHEN n_place = 1 THEN '1.000000, 2.000000' ELSE '' END AS latlon, coalesce(person, '') AS people, coalesce(tag, '') AS tags,
      CASE WHEN n_place > 1 THEN place ELSE '' END AS ambiguous_places, coalesce(n_person, 0) AS people_matched, coalesce(n_place, 0) AS places_matched, coalesce(n_tag, 0) AS tags_matched, coalesce(candidates, 0) AS candidates
      FROM sd LEFT JOIN l USING (text_id) LEFT JOIN h USING (text_id))"""
)


@query(["fx_paragraphs", "fx_dictionary"], f"+ {_SUGGESTED} SELECT * FROM o", recursive=True)
def suggest_entities(paragraphs, phrases):
    places = phrases.where("entity_type = 'place'").select("canonical", F.lit("1.000000, 2.000000").alias("latlon")).distinct()
    entries = _text_ids(paragraphs).select(C("text_id").alias("entry_id"), "text", F.lit(None).cast("string").alias("section_context"))
    return dictionary.suggest(entries, phrases, places)


@query(
    ["fx_paragraphs", "fx_dictionary"],
    f"""+ {_SUGGESTED} SELECT count(*) AS entries, {", ".join(f"count(*) FILTER ({c} <> '') AS with_{c}" for c in ("date", "place", "latlon", "people", "tags"))},
    CAST(sum(people_matched + places_matched + tags_matched) AS BIGINT) AS matches, CAST(sum(candidates) AS BIGINT) AS candidates FROM o""",
    recursive=True,
)
def review_counters(paragraphs, phrases):
    return reports.review_counters(suggest_entities(paragraphs, phrases))
