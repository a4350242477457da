"""Registered queries over the test tables, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import dates, geo, semantic, text
from curatrix.operators import dictionary, documents, learning, listing, merge, reports, review, similarity
from curatrix.plans.fixtures import bind, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: list[str], oracle: str | None = None, recursive: bool = False):
    """Register a function of the views; ``oracle`` is SQL over the same views."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if oracle:
            ORACLES[f.__name__] = with_views(views, oracle, recursive)
        return f

    return add


def tables(names: list[str], oracle: str | None = None):
    """Register a function of plain tables."""

    def add(f):
        def run(spark, sf_dir):
            bind(spark, sf_dir)
            return f(*[spark.table(n) for n in names])

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


C = F.col
_FOLDER = "CASE WHEN strpos(relative_path, '/') = 0 THEN '' ELSE regexp_replace(relative_path, '/[^/]*$', '') END"
_KIND = """CASE WHEN lower(regexp_extract({n}, '\\.([^.]*)$', 1)) IN ('jpg','jpeg','png','tif','tiff','heic','heif','webp','bmp','gif') THEN 'photo'
          WHEN lower(regexp_extract({n}, '\\.([^.]*)$', 1)) = 'docx' THEN 'description' ELSE 'other' END"""
_FILES = f"+ f AS (SELECT *, {_FOLDER} AS folder, regexp_extract(relative_path, '[^/]*$') AS file_name, {_KIND.format(n='relative_path')} AS kind FROM fx_listing_curr)"

# --- listings


@query(
    ["fx_listing_curr"],
    _FILES + """ SELECT root_id, folder, count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind = 'description') AS documents, count(*) FILTER (kind = 'other') AS others,
    CASE WHEN count(*) FILTER (kind = 'description') = 1 THEN min(file_name) FILTER (kind = 'description') END AS description, count(*) FILTER (kind = 'description') > 1 AS ambiguous
    FROM f GROUP BY root_id, folder HAVING count(*) FILTER (kind = 'photo') > 0""",
)
def plan_folders(curr):
    return listing.plan_folders(curr)


@query(
    ["fx_listing_curr"],
    _FILES + """, g AS (SELECT root_id, folder, count(*) FILTER (kind = 'photo') AS p, count(*) FILTER (kind = 'description') AS d FROM f GROUP BY ALL)
    SELECT root_id, folder, CASE WHEN d > 1 THEN 'AMBIGUOUS' WHEN d = 1 THEN 'FOUND' ELSE 'ABSENT' END AS status FROM g WHERE p > 0""",
)
def folder_description_status(curr):
    return listing.folder_description_record(listing.plan_folders(curr)).select("root_id", "folder", "status")


@query(
    ["fx_listing_curr"],
    _FILES + """, g AS (SELECT root_id, folder FROM f GROUP BY ALL HAVING count(*) FILTER (kind = 'photo') > 0)
    SELECT f.root_id, f.folder, file_name FROM f JOIN g USING (root_id, folder) WHERE kind = 'description'""",
)
def description_candidates(curr):
    return listing.description_candidates(curr)


_DIFF = """+ d AS (SELECT coalesce(c.root_id, p.root_id) AS root_id, coalesce(c.relative_path, p.relative_path) AS relative_path,
  CASE WHEN p.relative_path IS NULL THEN 'new' WHEN c.relative_path IS NULL THEN 'missing'
       WHEN CASE WHEN p.content_hash IS NOT NULL AND c.content_hash IS NOT NULL THEN p.content_hash <> c.content_hash
                 WHEN p.content_hash IS NULL AND c.content_hash IS NULL THEN p.size IS DISTINCT FROM c.size OR p.modified_at IS DISTINCT FROM c.modified_at ELSE true END
       THEN 'changed' ELSE 'unchanged' END AS change,
  c.size AS c_size, c.content_hash AS c_hash, p.size AS p_size, p.content_hash AS p_hash, p.was_missing
  FROM fx_listing_prev p FULL JOIN fx_listing_curr c ON p.root_id = c.root_id AND p.relative_path = c.relative_path)"""


@query(["fx_listing_prev", "fx_listing_curr"], _DIFF + " SELECT root_id, relative_path, change FROM d")
def diff_listing(prev, curr):
    return listing.diff_listing(prev, curr)


@query(
    ["fx_listing_prev", "fx_listing_curr"],
    _DIFF + """ SELECT root_id, relative_path, CASE WHEN change = 'missing' THEN p_size ELSE c_size END AS size, CASE WHEN change = 'missing' THEN p_hash ELSE c_hash END AS content_hash,
    CASE WHEN change = 'new' THEN '2024' ELSE '2023' END AS first_seen, CASE WHEN change = 'missing' THEN '2023' ELSE '2024' END AS last_seen,
    CASE WHEN change = 'missing' THEN CASE WHEN was_missing THEN '2023' ELSE '2024' END END AS missing_since FROM d""",
)
def apply_listing(prev, curr):
    then, now = F.lit("2023-01-01").cast("timestamp"), F.lit("2024-01-01").cast("timestamp")
    recorded = prev.withColumns({"first_seen": then, "last_seen": then, "missing_since": F.when(C("was_missing"), then)})
    year = lambda n: F.date_format(n, "yyyy").alias(n)
    return listing.apply_listing(recorded, curr, now).select("root_id", "relative_path", "size", "content_hash", year("first_seen"), year("last_seen"), year("missing_since"))


@query(
    ["fx_raw_listing"],
    r"""SELECT root_id, name, CASE WHEN name <> '' THEN concat(replace(regexp_extract(parent, '[^\\/].*[^/]'), '//', '/'), '/', name) END AS relative_path, type = 'dir' AS is_directory,
    CASE WHEN type <> 'dir' THEN size END AS size, modified = 'yesterday' AS bad_time, coalesce(nullif(md5, ''), nullif(sha256, '')) AS content_hash, CASE WHEN name = '' THEN 'record has no name' END AS error FROM fx_raw_listing""",
)
def normalize_listing(raw):
    out = listing.normalize_listing(raw)
    return out.select("root_id", "name", "relative_path", "is_directory", "size", C("modified_at").isNull().alias("bad_time"), "content_hash", "error")


@query(
    ["fx_listing_prev", "fx_listing_curr"],
    """+ u AS (SELECT root_id, relative_path, content_hash FROM fx_listing_prev UNION ALL SELECT root_id, relative_path, content_hash FROM fx_listing_curr)
    SELECT content_hash, count(*) AS copies, min(root_id || '/' || relative_path) AS first_path, max(root_id || '/' || relative_path) AS last_path
    FROM u WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1""",
)
def true_duplicates(prev, curr):
    return listing.true_duplicates(prev.drop("was_missing").unionByName(curr))


_MOVES = """+ m AS (SELECT root_id || '/' || relative_path AS f, content_hash AS h, lower(regexp_extract(relative_path, '[^/]*$')) AS fn, regexp_replace(root_id || '/' || relative_path, '/[^/]*$', '') AS ff FROM fx_listing_prev),
    n AS (SELECT 'new/' || regexp_replace(relative_path, '^f', 'g') AS t, CASE WHEN size % 2 = 0 THEN CASE WHEN size % 3 = 0 THEN 'empty' ELSE content_hash END END AS h, lower(regexp_extract(relative_path, '[^/]*$')) AS fn,
          regexp_replace('new/' || regexp_replace(relative_path, '^f', 'g'), '/[^/]*$', '') AS tf FROM fx_listing_prev WHERE size % 5 <> 0),
    p AS (SELECT f, ff, fn, CASE WHEN size % 7 = 0 THEN 'empty' ELSE h END AS h FROM m JOIN (SELECT root_id || '/' || relative_path AS f, size FROM fx_listing_prev) USING (f)),
    s1 AS (SELECT f, t, ff, tf FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY fn, f) AS k FROM p WHERE h IS NOT NULL) JOIN (SELECT t, tf, h, row_number() OVER (PARTITION BY h ORDER BY fn, t) AS k FROM n WHERE h IS NOT NULL) USING (h, k)),
    v AS (SELECT ff, min_by(tf, (-c, tf)) AS tf FROM (SELECT ff, tf, count(*) AS c FROM s1 GROUP BY ALL) GROUP BY ff),
    s2 AS (SELECT f, t, ff, tf FROM (SELECT f, ff, fn, tf, row_number() OVER (PARTITION BY fn, tf ORDER BY f) AS k FROM p JOIN v USING (ff) WHERE f NOT IN (SELECT f FROM s1))
           JOIN (SELECT t, fn, tf, row_number() OVER (PARTITION BY fn, tf ORDER BY t) AS k FROM n WHERE t NOT IN (SELECT t FROM s1)) USING (fn, tf, k)),
    s3 AS (SELECT f, t, ff, tf FROM (SELECT f, ff, fn, row_number() OVER (PARTITION BY fn ORDER BY f) AS k FROM p WHERE f NOT IN (SELECT f FROM s1 UNION SELECT f FROM s2))
           JOIN (SELECT t, tf, fn, row_number() OVER (PARTITION BY fn ORDER BY t) AS k FROM n WHERE t NOT IN (SELECT t FROM s1 UNION SELECT t FROM s2)) USING (fn, k)),
    a AS (SELECT *, 'content_hash' AS signal FROM s1 UNION ALL SELECT *, 'file_name' FROM s2 UNION ALL SELECT *, 'file_name' FROM s3)"""


def moves_of(prev: DataFrame) -> DataFrame:
    """A listing moved to another root, some files lost on the way, some hashes unknown, some files empty."""
    none, empty = F.lit(None).cast("string"), F.lit("empty")
    gone = prev.withColumns({"remote_id": none, "content_hash": F.when(C("size") % 7 == 0, empty).otherwise(C("content_hash"))})
    known = F.when(C("size") % 2 == 0, F.when(C("size") % 3 == 0, empty).otherwise(C("content_hash")))
    fresh = prev.where("size % 5 <> 0").withColumns({"root_id": F.lit("new"), "relative_path": F.regexp_replace("relative_path", "^f", "g"), "content_hash": known, "remote_id": none})
    return listing.find_moved(gone, fresh)


@query(["fx_listing_prev"], _MOVES + " SELECT f AS from_path, t AS to_path, signal FROM a")
def find_moved(prev):
    return moves_of(prev)


@query(
    ["fx_listing_curr"],
    f"""SELECT relative_path, {_FOLDER} AS folder, regexp_extract(relative_path, '[^/]*$') AS file_name, {_KIND.format(n='relative_path')} AS kind,
    lower(regexp_replace(regexp_extract(relative_path, '[^/]*$'), '\\.[^.]*$', '')) AS identity, root_id || '|' || {_FOLDER} || '|' || lower(regexp_replace(regexp_extract(relative_path, '[^/]*$'), '\\.[^.]*$', '')) AS row_key,
    replace(relative_path, '/', '_') AS safe, replace(relative_path, '/', '-') AS folder_name, substr(sha256('https://host/' || relative_path), 1, 16) AS source FROM fx_listing_curr""",
)
def path_scalars(curr):
    p = C("relative_path")
    return curr.select(
        "relative_path", text.parent_path(p).alias("folder"), text.base_name(p).alias("file_name"), text.file_kind(p).alias("kind"), text.identity_key(text.base_name(p)).alias("identity"),
        text.scoped_row_key(C("root_id"), text.parent_path(p), text.base_name(p)).alias("row_key"), text.safe_name(p).alias("safe"), text.sanitize_folder_name(p).alias("folder_name"),
        text.source_identity(F.concat(F.lit(" https://host/"), p, F.lit("/"))).alias("source"),
    )


# --- texts and entries


@tables(
    ["documents"],
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS fragment FROM l""",
)
def split_fragments(docs):
    return docs.select("doc_id", F.posexplode(text.split_fragments(C("text"))).alias("pos", "fragment"))


_EDGE = """[ \\t\\-–—:;.,)\\]}(\\[{«»"''`]+"""
_ENTRIES = rf"""+ p AS (SELECT folder, pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM fx_paragraphs),
tk AS (SELECT *, CASE WHEN NOT starts_with(lower(text), 'далее') THEN nullif(regexp_replace(regexp_extract(text, '^([A-Za-z0-9][A-Za-z0-9_.\-]*)(\s|$)', 1), '[.,;:]+$', ''), '') END AS token FROM p WHERE text <> ''),
nm AS (SELECT DISTINCT folder, lower(name) AS word FROM fx_photos UNION SELECT DISTINCT folder, regexp_replace(lower(name), '\.[^.]*$', '') FROM fx_photos),
st AS (SELECT folder, regexp_replace(lower(token), '\.[^.]*$', '') AS stem FROM tk WHERE token IS NOT NULL AND ((regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Za-z_]')) OR (folder, lower(token)) IN (SELECT folder, word FROM nm))
       UNION ALL SELECT folder, regexp_replace(lower(name), '\.[^.]*$', '') FROM fx_photos),
sw AS (SELECT DISTINCT folder, CAST(length(stem) AS INTEGER) AS width FROM st WHERE regexp_full_match(stem, '[0-9]+')),
k AS (SELECT tk.folder, pos, text, token, CASE WHEN starts_with(lower(text), 'далее') THEN 'divider'
        WHEN token IS NOT NULL AND ((folder, lower(token)) IN (SELECT folder, word FROM nm) OR (regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Za-z_]'))
             OR (regexp_full_match(token, '[0-9]+') AND (folder, CAST(length(token) AS INTEGER)) IN (SELECT folder, width FROM sw))) THEN 'start' ELSE 'text' END AS kind FROM tk),
c AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER w AS entry_seq, last_value(CASE WHEN kind = 'divider' THEN text END IGNORE NULLS) OVER w AS section,
        last_value(CASE WHEN kind <> 'text' THEN kind END IGNORE NULLS) OVER w AS last_mark FROM k WINDOW w AS (PARTITION BY folder ORDER BY pos ROWS UNBOUNDED PRECEDING)),
r AS (SELECT folder, CAST(entry_seq AS BIGINT) AS entry_seq, pos, kind, token, section, CASE WHEN kind = 'start' THEN regexp_replace(substr(text, length(token) + 1), '^{_EDGE}|{_EDGE}$', '', 'g') ELSE text END AS raw
        FROM c WHERE kind = 'start' OR (kind = 'text' AND last_mark = 'start')),
q AS (SELECT *, regexp_replace(regexp_replace(raw, '(?i)\s*[-–—]?\s*нет фото\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean, len(regexp_extract_all(lower(raw), 'нет фото')) AS n FROM r),
e AS (SELECT folder, entry_seq, max(CASE WHEN kind = 'start' THEN token END) AS reference, coalesce(string_agg(clean, ' ' ORDER BY pos) FILTER (clean <> ''), '') AS text,
        max(CASE WHEN kind = 'start' THEN section END) AS section_context, CAST(sum(n) AS BIGINT) AS notes FROM q GROUP BY folder, entry_seq)"""
_RECONCILE = (
    _ENTRIES
    + r""", pn AS (SELECT folder, lower(name) AS word, min(name) AS name FROM fx_photos GROUP BY ALL), ps AS (SELECT folder, regexp_replace(lower(name), '\.[^.]*$', '') AS word, min(name) AS name FROM fx_photos GROUP BY ALL),
rc AS (SELECT e.*, coalesce(pn.name, ps.name) AS photo FROM e LEFT JOIN pn ON pn.folder = e.folder AND pn.word = lower(reference) LEFT JOIN ps ON ps.folder = e.folder AND ps.word = regexp_replace(lower(reference), '\.[^.]*$', ''))"""
)
_PP = ["fx_paragraphs", "fx_photos"]


@query(["fx_paragraphs", "fx_numbered_photos"], _ENTRIES.replace("fx_photos", "fx_numbered_photos") + " SELECT folder, width FROM sw")
def reference_style(paragraphs, photos):
    return documents.reference_style(paragraphs, photos)


@query(_PP, _ENTRIES + " SELECT folder, entry_seq, reference, text, section_context, notes FROM e")
def group_entries(paragraphs, photos):
    return documents.group_entries(paragraphs, photos).select("folder", "entry_seq", "reference", "text", "section_context", F.size("source_notes").cast("long").alias("notes"))


@query(_PP, _ENTRIES + " SELECT folder, pos, text FROM c WHERE kind = 'text' AND (last_mark IS NULL OR last_mark <> 'start')")
def preamble(paragraphs, photos):
    return documents.preamble(paragraphs, photos)


@query(_PP, _RECONCILE + " SELECT folder, entry_seq, reference, photo, CASE WHEN photo IS NULL THEN 'DESCRIBED_ABSENT' ELSE 'NEW' END AS status FROM rc")
def reconcile_entries(paragraphs, photos):
    return documents.reconcile_entries(documents.group_entries(paragraphs, photos), photos).select("folder", "entry_seq", "reference", "photo", "status")


@query(_PP, _RECONCILE + " SELECT folder, name FROM fx_photos WHERE (folder, name) NOT IN (SELECT folder, photo FROM rc WHERE photo IS NOT NULL)")
def undescribed_photos(paragraphs, photos):
    return documents.undescribed_photos(documents.reconcile_entries(documents.group_entries(paragraphs, photos), photos), photos)


@query(
    _PP,
    _RECONCILE + """, a AS (SELECT folder, count(*) AS entries, count(photo) AS present, count(*) - count(photo) AS absent, CAST(sum(CASE WHEN notes > 0 THEN 1 ELSE 0 END) AS BIGINT) AS notes FROM rc GROUP BY folder),
    b AS (SELECT folder, count(*) AS photos, count(*) FILTER ((folder, name) NOT IN (SELECT folder, photo FROM rc WHERE photo IS NOT NULL)) AS undescribed FROM fx_photos GROUP BY folder),
    d AS (SELECT folder, count(*) AS dividers FROM p WHERE starts_with(lower(text), 'далее') GROUP BY folder),
    j AS (SELECT coalesce(b.folder, a.folder) AS folder, photos, entries, present, absent, notes, undescribed, dividers FROM b FULL JOIN a ON a.folder = b.folder LEFT JOIN d ON d.folder = coalesce(b.folder, a.folder))
    SELECT folder, CAST(coalesce(sum(photos), 0) AS BIGINT) AS photos, CAST(coalesce(sum(entries), 0) AS BIGINT) AS entries, CAST(coalesce(sum(present), 0) AS BIGINT) AS present, CAST(coalesce(sum(absent), 0) AS BIGINT) AS absent,
    CAST(coalesce(sum(notes), 0) AS BIGINT) AS notes, CAST(coalesce(sum(undescribed), 0) AS BIGINT) AS undescribed, CAST(coalesce(sum(dividers), 0) AS BIGINT) AS dividers FROM j GROUP BY ROLLUP (folder)""",
)
def scan_report_rollup(paragraphs, photos):
    entries = documents.group_entries(paragraphs, photos)
    return documents.scan_report(documents.reconcile_entries(entries, photos), photos, paragraphs)


@query(
    ["fx_listing_curr"],
    _FILES.replace("SELECT *,", "SELECT * REPLACE (size % 20 = 7 AS is_directory),") + """, g AS (SELECT root_id, folder, count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind = 'description') AS d FROM f WHERE NOT is_directory GROUP BY ALL HAVING count(*) FILTER (kind = 'photo') > 0),
    u AS (SELECT root_id, folder, 0 AS df, 0 AS di, 1 AS pf, photos, CAST(d = 1 AS INT) AS x, CAST(d > 1 AS INT) AS y, CAST(d = 0 AS INT) AS z FROM g UNION ALL SELECT root_id, NULL, count(*) FILTER (is_directory), count(*) FILTER (NOT is_directory), 0, 0, 0, 0, 0 FROM f GROUP BY root_id),
    r AS (SELECT root_id, folder, grouping(folder) AS a, sum(df) AS discovered_folders, sum(di) AS discovered_files, sum(pf) AS photo_folders, sum(photos) AS photos, sum(x) AS described, sum(y) AS conflicts, sum(z) AS without_description FROM u GROUP BY GROUPING SETS ((root_id, folder), (root_id), ()))
    SELECT root_id, folder, CAST(discovered_folders AS BIGINT) AS discovered_folders, CAST(discovered_files AS BIGINT) AS discovered_files, CAST(photo_folders AS BIGINT) AS photo_folders, CAST(photos AS BIGINT) AS photos,
    CAST(described AS BIGINT) AS described, CAST(conflicts AS BIGINT) AS conflicts, CAST(without_description AS BIGINT) AS without_description FROM r WHERE folder IS NOT NULL OR a = 1""",
)
def root_report(curr):
    return documents.root_report(curr.withColumn("is_directory", C("size") % 20 == 7))


_W = "[0-9A-Za-zА-Яа-яЁё_]"


@query(
    _PP,
    rf"""+ t AS (SELECT folder, pos, lower(text) AS low FROM fx_paragraphs), f AS (SELECT folder, name, lower(name) AS fu, regexp_replace(lower(name), '\.[^.]*$', '') AS st FROM fx_photos),
    m AS (SELECT t.folder, pos, name, CASE WHEN contains(low, fu) THEN 'name' ELSE 'stem' END AS how, CASE WHEN contains(low, fu) THEN length(fu) ELSE length(st) END AS n
          FROM t JOIN f ON t.folder = f.folder AND contains(low, st) WHERE contains(low, fu) OR regexp_matches(low, '(^|[^0-9A-Za-zА-Яа-яЁё_])' || st || '($|[^0-9A-Za-zА-Яа-яЁё_])')),
    b AS (SELECT *, row_number() OVER (PARTITION BY folder, pos ORDER BY how, n DESC, name) AS i FROM m)
    SELECT t.folder, t.pos, b.name, b.how FROM t LEFT JOIN b ON t.folder = b.folder AND t.pos = b.pos AND i = 1""",
)
def match_fragments(paragraphs, photos):
    return documents.match_fragments(paragraphs, photos).select("folder", "pos", "name", "how")


@query(
    ["fx_paragraphs"],
    r"""SELECT folder, pos, array_to_string(regexp_extract_all(lower(text), 'нет фото'), '; ') AS notes, regexp_replace(regexp_replace(text, '(?i)\s*[-–—]?\s*нет фото\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM fx_paragraphs""",
)
def source_notes(paragraphs):
    return paragraphs.select("folder", "pos", F.array_join(text.source_notes(C("text")), "; ").alias("notes"), text.without_source_notes(C("text")).alias("clean"))


@query(
    ["fx_paragraphs"],
    r"""+ c AS (SELECT folder, pos, list_transform(string_split(translate(text, '!?', '..'), '.'), lambda x: regexp_replace(x, '^[ \t,;:\-–—()]+|[ \t,;:\-–—()]+$', '', 'g')) AS p FROM fx_paragraphs),
    u AS (SELECT folder, pos, unnest(p) AS chunk FROM c) SELECT folder, pos, chunk FROM u WHERE length(chunk) >= 3 AND len(string_split_regex(chunk, '\s+')) <= 6 AND NOT regexp_matches(chunk, '^\s*[0-9]')""",
)
def candidate_chunks(paragraphs):
    return paragraphs.select("folder", "pos", F.explode(text.candidate_chunks(C("text"))).alias("chunk"))


@query(
    ["fx_review_rows"],
    r"""+ u AS (SELECT reference, unnest(list_filter(list_transform(string_split_regex(people, '[;,]'), lambda x: trim(x)), lambda x: x <> '')) AS person FROM fx_review_rows)
    SELECT reference, person, lower(regexp_replace(person, '\s+', ' ', 'g')) AS phrase FROM u""",
)
def split_people(rows):
    out = rows.select("reference", F.explode(text.split_list_field(C("people"))).alias("person"))
    return out.withColumn("phrase", text.normalize_phrase(C("person")))


# --- dates and places

_DATE = r"""+ v AS (SELECT reference, date AS d, CASE length(date) WHEN 4 THEN 'YEAR' WHEN 7 THEN 'MONTH' WHEN 10 THEN 'DAY' END AS precision FROM fx_review_rows),
w AS (SELECT *, substr(d, 1, 4) AS y, CASE WHEN length(d) >= 7 THEN substr(d, 6, 2) END AS m, CASE WHEN length(d) = 10 THEN substr(d, 9, 2) END AS dd FROM v WHERE regexp_full_match(d, '[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?') AND try_strptime(d || substr('-01-01', length(d) - 3), '%Y-%m-%d') IS NOT NULL)"""


@query(["fx_review_rows"], _DATE + " SELECT reference, d AS canonical, precision, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(dd AS INTEGER) AS day FROM w")
def parse_archive_date(rows):
    d = rows.select("reference", dates.parse_archive_date(C("date")).alias("d")).where("d IS NOT NULL")
    return d.select("reference", dates.archive_date_text(C("d")).alias("canonical"), "d.precision", "d.year", "d.month", "d.day")


@query(
    ["fx_review_rows"],
    _DATE + " SELECT reference, y || ':' || coalesce(m, '07') || ':' || coalesce(dd, CASE WHEN m IS NULL THEN '01' ELSE '15' END) || ' 12:00:00' AS exif, true AS synthetic FROM w",
)
def compat_timestamp(rows):
    d = rows.select("reference", dates.compat_timestamp(dates.parse_archive_date(C("date"))).alias("t")).where("t IS NOT NULL")
    return d.select("reference", dates.exif_text(C("t")).alias("exif"), "t.synthetic")


@query(
    ["fx_review_rows"],
    _DATE + """ SELECT reference, k, CASE k WHEN 'XMP-archive:ArchiveDate' THEN d WHEN 'XMP-archive:ArchiveDatePrecision' THEN precision ELSE 'True' END AS v
    FROM w, (VALUES ('XMP-archive:ArchiveDate'), ('XMP-archive:ArchiveDatePrecision'), ('XMP-archive:CompatibilityDateSynthetic')) AS x(k)""",
)
def xmp_fields(rows):
    return rows.select("reference", F.explode(dates.xmp_fields(dates.parse_archive_date(C("date")))).alias("k", "v"))


_MONTH_CASE = "CASE lower(mw) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dates.MONTHS.items()) + " END"


@query(
    ["fx_paragraphs"],
    rf"""+ y AS (SELECT folder, pos, text, regexp_extract(text, '^((?s:.)*?(?:^|[^0-9A-Za-zА-Яа-яЁё_]))((?:18|19|20)[0-9][0-9])(?:$|[^0-9A-Za-zА-Яа-яЁё_])', 2) AS yr,
      length(regexp_extract(text, '^((?s:.)*?(?:^|[^0-9A-Za-zА-Яа-яЁё_]))((?:18|19|20)[0-9][0-9])(?:$|[^0-9A-Za-zА-Яа-яЁё_])', 1)) AS before FROM fx_paragraphs),
    t AS (SELECT *, substr(text, before + 5, 24) AS tail FROM y),
    m AS (SELECT *, regexp_extract(tail, '^((?s:.)*?(?:^|[^0-9A-Za-zА-Яа-яЁё_]))([А-Яа-яЁё]+)(?:$|[^0-9A-Za-zА-Яа-яЁё_])', 2) AS mw, length(regexp_extract(tail, '^((?s:.)*?(?:^|[^0-9A-Za-zА-Яа-яЁё_]))([А-Яа-яЁё]+)(?:$|[^0-9A-Za-zА-Яа-яЁё_])', 1)) AS mb FROM t),
    d AS (SELECT *, {_MONTH_CASE} AS mn, TRY_CAST(nullif(regexp_extract(substr(tail, mb + length(mw) + 1, 6), '(?:^|[^0-9A-Za-zА-Яа-яЁё_])([0-3]?[0-9])(?:$|[^0-9A-Za-zА-Яа-яЁё_])', 1), '') AS INTEGER) AS dn FROM m)
    SELECT folder, pos, CASE WHEN yr = '' THEN '' WHEN mn IS NULL THEN yr WHEN dn BETWEEN 1 AND 31 THEN yr || '-' || lpad(CAST(mn AS VARCHAR), 2, '0') || '-' || lpad(CAST(dn AS VARCHAR), 2, '0') ELSE yr || '-' || lpad(CAST(mn AS VARCHAR), 2, '0') END AS suggested FROM d""",
)
def suggest_date(paragraphs):
    return paragraphs.select("folder", "pos", dates.suggest_date(C("text")).alias("suggested"))


@query(
    ["fx_review_rows"],
    r"""+ p AS (SELECT reference, TRY_CAST(regexp_extract(latlon, '^\s*([-+]?[0-9]+(?:\.[0-9]+)?)\s*,', 1) AS DOUBLE) AS la, TRY_CAST(regexp_extract(latlon, ',\s*([-+]?[0-9]+(?:\.[0-9]+)?)\s*$', 1) AS DOUBLE) AS lo FROM fx_review_rows)
    SELECT reference, CASE WHEN la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 THEN printf('%.6f, %.6f', la, lo) END AS canonical FROM p""",
)
def parse_latlon(rows):
    return rows.select("reference", geo.format_latlon(geo.parse_latlon(C("latlon"))).alias("canonical"))


_NUM = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
_SHAPES = [s.replace("'", "''") for s in geo.LINK_SHAPES]


@query(
    ["fx_links"],
    "+ x AS (SELECT id, url, " + ", ".join(f"TRY_CAST(regexp_extract(url, '{s}', 1) AS DOUBLE) AS a{i}, TRY_CAST(regexp_extract(url, '{s}', 2) AS DOUBLE) AS o{i}" for i, s in enumerate(_SHAPES)) + " FROM fx_links) SELECT id, coalesce("
    + ", ".join(f"CASE WHEN a{i} BETWEEN -90 AND 90 AND o{i} BETWEEN -180 AND 180 THEN printf('%.6f, %.6f', a{i}, o{i}) END" for i in range(len(_SHAPES))) + ") AS point FROM x",
)
def map_link(links):
    return links.select("id", geo.format_latlon(geo.parse_map_link(C("url"))).alias("point"))


@query(
    ["fx_links"],
    """+ p AS (SELECT id, CAST(id % 80 AS DOUBLE) + 0.25 AS la, CAST(id % 170 AS DOUBLE) AS lo, CAST(id % 80 AS DOUBLE) + CASE WHEN id % 3 = 0 THEN 0.2501 ELSE 0.26 END AS lb FROM fx_links)
    SELECT id, round(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lb - la) / 2), 2)))), 3) AS metres, 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(lb - la) / 2), 2)))) > 250 AS apart FROM p""",
)
def haversine_pairs(links):
    d = lambda c: c.cast("double")
    a = F.struct((d(C("id") % 80) + 0.25).alias("latitude"), d(C("id") % 170).alias("longitude"))
    b = F.struct((d(C("id") % 80) + F.when(C("id") % 3 == 0, 0.2501).otherwise(0.26)).alias("latitude"), d(C("id") % 170).alias("longitude"))
    return links.select("id", F.round(geo.haversine_m(a, b), 3).alias("metres"), geo.materially_different(a, b).alias("apart"))


# --- dictionary

_TEXTS = "t AS (SELECT folder || '|' || pos AS text_id, lower(text) AS low FROM fx_paragraphs)"


@query(
    ["fx_paragraphs", "fx_dictionary"],
    f"""+ {_TEXTS}, d AS (SELECT *, lower(trim(phrase)) AS needle FROM fx_dictionary WHERE status <> 'REJECTED'),
    m AS (SELECT text_id, low, entity_type, canonical, phrase, status, needle, unnest(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, length(needle)) = needle)) AS i FROM t JOIN d ON contains(low, needle))
    SELECT text_id, entity_type, canonical, phrase, status, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(needle) AS INTEGER) AS "end" FROM m
    WHERE NOT regexp_matches(CASE WHEN i > 1 THEN substr(low, i - 1, 1) ELSE '' END, '[0-9A-Za-zА-Яа-яЁё_]') AND NOT regexp_matches(substr(low, i + length(needle), 1), '[0-9A-Za-zА-Яа-яЁё_]')""",
)
def find_candidates(paragraphs, phrases):
    return dictionary.find_candidates(_text_ids(paragraphs), phrases).drop("matched_text")


def _text_ids(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select(F.concat_ws("|", "folder", "pos").alias("text_id"), "text")


@query(
    ["fx_dictionary", "fx_review_rows"],
    """+ v AS (SELECT DISTINCT upper(phrase) AS value FROM fx_dictionary UNION SELECT DISTINCT place FROM fx_review_rows),
    p AS (SELECT DISTINCT lower(phrase) AS key, canonical FROM fx_dictionary WHERE entity_type = 'place' AND status = 'CONFIRMED'), g AS (SELECT value, list_sort(list(DISTINCT canonical) FILTER (canonical IS NOT NULL)) AS names FROM v LEFT JOIN p ON lower(value) = key GROUP BY value)
    SELECT value, CASE coalesce(len(names), 0) WHEN 0 THEN 'none' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, CASE WHEN len(names) = 1 THEN names[1] END AS canonical, CASE WHEN len(names) > 1 THEN array_to_string(names, '; ') END AS names FROM g""",
)
def resolve_place(phrases, rows):
    values = phrases.select(F.upper("phrase").alias("value")).union(rows.select("place"))
    places = phrases.where("entity_type = 'place'").select("canonical", F.lit("").alias("latlon")).distinct()
    return dictionary.resolve_place(values, phrases, places).select("value", "resolution", "canonical", "names")


@query(["fx_evidence"], "SELECT entity_type, canonical, count(*) AS evidence_count FROM fx_evidence GROUP BY ALL")
def evidence_counts(evidence):
    return dictionary.evidence_counts(evidence)


@query(
    ["fx_evidence"],
    """+ f AS (SELECT entity_type, canonical, min(run_id) AS first_run, count(*) AS n FROM fx_evidence GROUP BY ALL)
    SELECT entity_type, count(*) AS entities, CAST(sum(n) AS BIGINT) AS evidence, count(*) FILTER (first_run = (SELECT max(run_id) FROM fx_evidence)) AS created_recently FROM f GROUP BY entity_type""",
)
def dictionary_summary(evidence):
    return reports.dictionary_summary(evidence)


@query(
    ["fx_merge_pairs"],
    """+ w AS (SELECT absorbed, survivor AS top FROM fx_merge_pairs UNION SELECT w.absorbed, p.survivor FROM w JOIN fx_merge_pairs p ON p.absorbed = w.top),
    c AS (SELECT absorbed AS node FROM w WHERE absorbed = top), e AS (SELECT absorbed, min(top) AS survivor FROM w WHERE top IN (FROM c) OR top NOT IN (SELECT absorbed FROM fx_merge_pairs) GROUP BY absorbed)
    SELECT 'tag' AS entity_type, absorbed, survivor FROM e WHERE absorbed <> survivor""",
    recursive=True,
)
def merge_entities(pairs):
    return dictionary.survivors(pairs)


@query(
    ["fx_merge_chains"],
    """+ w AS (SELECT entity_type, absorbed, survivor AS top FROM fx_merge_chains UNION SELECT w.entity_type, w.absorbed, p.survivor FROM w JOIN fx_merge_chains p ON p.entity_type = w.entity_type AND p.absorbed = w.top),
    c AS (SELECT DISTINCT entity_type, absorbed AS node FROM w WHERE absorbed = top),
    e AS (SELECT w.entity_type, w.absorbed, min(top) AS survivor FROM w WHERE EXISTS (FROM c WHERE c.entity_type = w.entity_type AND c.node = w.top)
          OR NOT EXISTS (FROM fx_merge_chains p WHERE p.entity_type = w.entity_type AND p.absorbed = w.top) GROUP BY ALL)
    SELECT entity_type, absorbed, survivor FROM e WHERE absorbed <> survivor""",
    recursive=True,
)
def merge_long_chains(pairs):
    """Chains of up to 60 merges, cycles of 9, and chains that lead into cycles."""
    return dictionary.survivors(pairs)


@query(
    ["fx_dictionary"],
    """+ a AS (SELECT entity_type, canonical AS entity_id, phrase AS alias, status AS old FROM fx_dictionary), p AS (SELECT entity_type, entity_id, alias, CASE WHEN length(alias) % 2 = 0 THEN 'CONFIRMED' ELSE 'CANDIDATE' END AS asked FROM a UNION ALL SELECT entity_type, entity_id, alias || ' jr', 'CANDIDATE' FROM a)
    SELECT coalesce(a.entity_type, p.entity_type) AS entity_type, coalesce(a.entity_id, p.entity_id) AS entity_id, coalesce(a.alias, p.alias) AS alias, CASE WHEN old IS NULL THEN asked WHEN old = 'CANDIDATE' AND asked = 'CONFIRMED' THEN 'CONFIRMED' ELSE old END AS status,
    coalesce(old IS NULL OR (old = 'CANDIDATE' AND asked = 'CONFIRMED'), false) AS changed FROM a FULL JOIN p ON a.entity_type = p.entity_type AND a.entity_id = p.entity_id AND a.alias = p.alias""",
)
def upsert_alias(phrases):
    aliases = phrases.select("entity_type", C("canonical").alias("entity_id"), C("phrase").alias("alias"), "status")
    asked = aliases.withColumn("status", F.when(F.length("alias") % 2 == 0, "CONFIRMED").otherwise("CANDIDATE"))
    return dictionary.upsert_alias(aliases, asked.unionByName(aliases.withColumns({"alias": F.concat("alias", F.lit(" jr")), "status": F.lit("CANDIDATE")})))


# --- learning

_VALUES = r"""+ tr AS (SELECT * FROM fx_learn_rows WHERE status NOT IN ('ERROR', 'SKIP') AND (people <> '' OR place <> '' OR tags <> '' OR latlon <> '')),
v AS (SELECT ord, 'person' AS entity_type, unnest(list_filter(list_transform(string_split_regex(people, '[;,]'), lambda x: trim(x)), lambda x: x <> '')) AS value FROM tr
      UNION ALL SELECT ord, 'tag', unnest(list_filter(list_transform(string_split_regex(tags, '[;,]'), lambda x: trim(x)), lambda x: x <> '')) FROM tr UNION ALL SELECT ord, 'place', trim(place) FROM tr WHERE trim(place) <> ''),
n AS (SELECT entity_type, lower(regexp_replace(value, '\s+', ' ', 'g')) AS key, min((ord, value)) AS f FROM v GROUP BY ALL)"""


@query(
    ["fx_learn_rows", "fx_learn_start"],
    _VALUES + " SELECT entity_type, f[2] AS canonical, f[1] AS ord FROM n ANTI JOIN (SELECT entity_type, lower(phrase) AS key FROM fx_learn_start WHERE status = 'CONFIRMED') k USING (entity_type, key)",
)
def learn_entities(rows, start):
    return learning.new_entities(learning.taught_values(rows), start)


@query(["fx_learn_rows", "fx_learn_start"])
def learn_aliases(rows, start):
    """Learned in the order of rows; held against a row-by-row run in the tests."""
    none = rows.select(F.lit("").alias("entity_id"), F.lit("").alias("canonical"), F.lit("").alias("latlon")).limit(0)
    return learning.learn_from_rows(rows, start, none)["aliases"]


#: Aliases learned in the order of rows: ``s`` holds, turn by turn, which chunk became an alias of which type since which row,
#: decided from the turn before, until nothing changes. ``h``: places of phrases in texts and chunks; ``g``: greedy claims.
_ALIASES = r""", c0 AS (SELECT entity_type, lower(phrase) AS key, min(canonical) AS canonical FROM fx_learn_start WHERE status = 'CONFIRMED' GROUP BY ALL),
    e0 AS (SELECT entity_type, key, f[2] AS canonical, f[1] AS ord FROM n ANTI JOIN c0 USING (entity_type, key)), w AS (FROM c0 UNION ALL SELECT entity_type, key, canonical FROM e0),
    p AS (SELECT entity_type, canonical, phrase, status, CAST(-1 AS BIGINT) AS since FROM fx_learn_start UNION ALL SELECT entity_type, canonical, canonical, 'CONFIRMED', ord FROM e0),
    x AS (SELECT DISTINCT v.ord, entity_type, canonical, trim(source_description) AS text FROM v JOIN w USING (entity_type) JOIN tr ON tr.ord = v.ord
          WHERE key = lower(regexp_replace(value, '\s+', ' ', 'g')) AND trim(source_description) <> '' AND NOT contains(lower(source_description), lower(regexp_replace(canonical, '\s+', ' ', 'g')))),
    k AS (SELECT DISTINCT text, chunk FROM (SELECT text, unnest(list_transform(string_split_regex(text, '[.!?]'), lambda y: trim(y, ' ,;:-()'))) AS chunk FROM (SELECT DISTINCT text FROM x))
          WHERE length(chunk) >= 3 AND len(string_split_regex(chunk, '\s+')) <= 6 AND NOT regexp_matches(chunk, '^[0-9]')),
    o AS (SELECT x.*, chunk, p.phrase IS NOT NULL AS known FROM (SELECT DISTINCT text, entity_type, canonical FROM x) x JOIN k USING (text)
          LEFT JOIN (SELECT DISTINCT entity_type, canonical, phrase FROM p) p ON p.entity_type = x.entity_type AND p.canonical = x.canonical AND p.phrase = chunk),
    q AS (SELECT DISTINCT entity_type AS kind, phrase, since FROM p WHERE status <> 'REJECTED' UNION ALL SELECT DISTINCT entity_type, chunk, NULL FROM o WHERE NOT known),
    h AS (SELECT text, kind, phrase, since, unnest(list_filter(range(1, length(text) + 1), lambda i: lower(substr(text, i, length(phrase))) = lower(phrase)
            AND NOT regexp_matches(CASE WHEN i > 1 THEN substr(text, i - 1, 1) ELSE '' END || ' ' || substr(text, i + length(phrase), 1), '\w'))) AS i
          FROM (SELECT text FROM k UNION SELECT chunk FROM k) JOIN q ON contains(lower(text), lower(phrase))),
    s AS (SELECT CAST([] AS STRUCT(kind VARCHAR, chunk VARCHAR, since BIGINT)[]) AS born, CAST(0 AS BIGINT) AS aliases, false AS done
      UNION ALL SELECT new, m, new = born FROM s, (
        SELECT coalesce(list({'kind': entity_type, 'chunk': chunk, 'since': since} ORDER BY entity_type, chunk), []) AS new, CAST(coalesce(sum(c), 0) AS BIGINT) AS m FROM (
          SELECT entity_type, chunk, min(ord) AS since, count(DISTINCT canonical) AS c FROM (
            WITH b AS (SELECT unnest(born, recursive := true) FROM s), a AS (SELECT text, kind, phrase, i, since FROM h WHERE since IS NOT NULL UNION ALL SELECT text, h.kind, phrase, i, b.since FROM h JOIN b ON h.since IS NULL AND b.kind = h.kind AND b.chunk = phrase),
            g AS (SELECT ord, entity_type, text, list_reduce(list([{'s': i, 'e': i + length(phrase)}] ORDER BY length(phrase) DESC, phrase, i), lambda t, y: CASE WHEN len(list_filter(t, lambda z: z.s < y[1].e AND z.e > y[1].s)) = 0 THEN list_concat(t, y) ELSE t END) AS kept
                  FROM (SELECT DISTINCT ord, entity_type, x.text, phrase, i FROM x JOIN a ON a.text = x.text AND kind = entity_type AND since < ord) GROUP BY ALL),
            z AS (SELECT DISTINCT ord, entity_type, lower(substr(text, y.s, y.e - y.s)) AS key FROM (SELECT *, unnest(kept) AS y FROM g))
            SELECT x.ord, x.entity_type, x.canonical, chunk FROM x JOIN o ON o.text = x.text AND o.entity_type = x.entity_type AND o.canonical = x.canonical AND NOT known
            LEFT JOIN z ON z.ord = x.ord AND z.entity_type = x.entity_type AND key = lower(chunk)
            LEFT JOIN (SELECT text AS part, kind, min(since) AS since FROM a GROUP BY ALL) u ON part = chunk AND kind <> x.entity_type AND u.since < x.ord WHERE key IS NULL AND part IS NULL
          ) GROUP BY ALL)) WHERE NOT done)"""

_COORDINATES = r""", l AS (SELECT canonical, printf('%.6f, %.6f', CAST(split_part(latlon, ',', 1) AS DOUBLE), CAST(split_part(latlon, ',', 2) AS DOUBLE)) AS latlon, min(ord) AS ord
           FROM tr JOIN w ON w.entity_type = 'place' AND key = lower(place) WHERE place <> '' AND latlon <> '' GROUP BY 1, 2),
    l1 AS (SELECT *, row_number() OVER t AS i, first_value(latlon) OVER t AS f FROM l WINDOW t AS (PARTITION BY canonical ORDER BY ord, latlon)),
    l2 AS (SELECT *, radians(CAST(split_part(latlon, ',', 1) AS DOUBLE) - CAST(split_part(f, ',', 1) AS DOUBLE)) AS dl FROM l1),
    l3 AS (SELECT CASE WHEN i = 1 THEN 'added' WHEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(dl / 2), 2)))) > 250 THEN 'conflict' ELSE 'unchanged' END AS result FROM l2)"""


@query(
    ["fx_learn_rows", "fx_learn_start"],
    _VALUES + _ALIASES + _COORDINATES + """, e AS (SELECT entity_type FROM n ANTI JOIN (SELECT entity_type, lower(phrase) AS key FROM fx_learn_start WHERE status = 'CONFIRMED') k USING (entity_type, key))
    SELECT 'new_' || entity_type AS outcome, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'candidate_aliases', aliases FROM s WHERE done AND aliases > 0 UNION ALL SELECT 'latlon_' || result, count(*) FROM l3 GROUP BY ALL
    UNION ALL SELECT CASE WHEN ord IN (SELECT ord FROM tr) THEN 'contributing_rows' ELSE 'skipped_rows' END, count(*) FROM fx_learn_rows GROUP BY 1""",
    recursive=True,
)
def learn_outcomes(rows, start):
    places = start.where("entity_type = 'place'").select(dictionary.entity_id(F.lit("place"), C("canonical")).alias("entity_id"), "canonical", F.lit("").alias("latlon")).distinct()
    return learning.learn_outcomes(learning.learn_from_rows(rows, start, places))


@query(
    ["fx_learn_rows"],
    _VALUES + r""", c AS (SELECT lower(place) AS entity_id, printf('%.6f, %.6f', CAST(split_part(latlon, ',', 1) AS DOUBLE), CAST(split_part(latlon, ',', 2) AS DOUBLE)) AS latlon, min(ord) AS ord FROM tr WHERE place <> '' AND latlon <> '' GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER o AS i, first_value(latlon) OVER o AS f FROM c WINDOW o AS (PARTITION BY entity_id ORDER BY ord, latlon)),
    d AS (SELECT *, radians(CAST(split_part(latlon, ',', 1) AS DOUBLE) - CAST(split_part(f, ',', 1) AS DOUBLE)) AS dl FROM w)
    SELECT entity_id, latlon, CASE WHEN i = 1 THEN 'added' WHEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(dl / 2), 2)))) > 250 THEN 'conflict' ELSE 'unchanged' END AS result FROM d""",
)
def learn_coordinates(rows):
    places = rows.where("place <> ''").select(F.lower("place").alias("entity_id"), C("place").alias("canonical"), F.lit("").alias("latlon")).distinct()
    return learning.learn_coordinates(rows, places)


@query(
    ["fx_evidence"],
    """+ k AS (SELECT DISTINCT entity_type, canonical, 'R' || substr(run_id, 6, 1) AS reason, substr(run_id, 6, 2) AS candidate_text, CASE WHEN substr(run_id, 4, 1) = '5' THEN '1.0, 2.0' ELSE '' END AS latlon,
    substr(run_id, 1, 3) AS root, substr(run_id, 4, 1) AS folder, substr(run_id, 7, 1) AS reference, run_id < '1995-01' AS old FROM fx_evidence)
    SELECT * EXCLUDE (old) FROM k WHERE NOT old EXCEPT SELECT * EXCLUDE (old) FROM k WHERE old""",
)
def record_evidence(evidence):
    at = lambda i, n: F.substring("run_id", i, n)
    none = F.when(C("run_id") >= "1995-01", F.lit("")).otherwise(F.lit(None))  # null and '' are one key
    key = {"reason": F.concat(F.lit("R"), at(6, 1)), "candidate_text": at(6, 2), "latlon": F.when(at(4, 1) == "5", "1.0, 2.0").otherwise(none), "root": at(1, 3), "folder": at(4, 1), "reference": at(7, 1)}
    keyed = evidence.withColumns(key)
    return dictionary.record_evidence(keyed.where("run_id < '1995-01'"), keyed.where("run_id >= '1995-01'")).select(*dictionary.EVIDENCE_KEY)


@query(
    ["fx_learn_rows"],
    _VALUES + r""", t AS (SELECT *, lower(place) AS entity_id, printf('%.6f, %.6f', CAST(split_part(latlon, ',', 1) AS DOUBLE), CAST(split_part(latlon, ',', 2) AS DOUBLE)) AS ll FROM tr WHERE place <> '' AND latlon <> ''),
    c AS (SELECT entity_id, ll, min(ord) AS first FROM t GROUP BY 1, 2), w AS (SELECT *, first_value(ll) OVER (PARTITION BY entity_id ORDER BY first, ll) AS f FROM c),
    d AS (SELECT *, radians(CAST(split_part(ll, ',', 1) AS DOUBLE) - CAST(split_part(f, ',', 1) AS DOUBLE)) AS dl FROM w)
    SELECT 'place' AS entity_type, place AS canonical, CASE WHEN 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(dl / 2), 2)))) > 250 THEN 'COORDINATE_CONFLICT' ELSE 'APPROVED_COORDINATES' END AS reason, '' AS candidate_text, ll AS latlon, ord FROM t JOIN d USING (entity_id, ll)""",
)
def coordinate_evidence(rows):
    places = rows.where("place <> ''").select(F.lower("place").alias("entity_id"), C("place").alias("canonical"), F.lit("").alias("latlon")).distinct()
    return learning.coordinate_evidence(rows, places, learning.learn_coordinates(rows, places))


# --- merge and sync

_FIELDS = ["place", "status", "people", "latlon"]


def _norm(f: str, v: str) -> str:
    return {
        "place": rf"trim(regexp_replace({v}, '\s+', ' ', 'g'))",
        "status": f"trim({v})",
        "people": f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex({v}, '[;,]'), lambda x: lower(trim(x))), lambda x: x <> ''))), chr(31))",
        "latlon": f"printf('%.6f, %.6f', CAST(split_part({v}, ',', 1) AS DOUBLE), CAST(split_part({v}, ',', 2) AS DOUBLE))",
    }[f]


def _merge_sql(deletions: bool = False, first: bool = False) -> str:
    """Long form: one row per record and field with the merged value and the conflict, if any."""
    base = "SELECT * FROM fx_merge_base" + (" WHERE false" if first else "")
    cells = " UNION ALL ".join(
        f"SELECT record_id, '{f}' AS field, ib, il, ir, b.{f} AS b, l.{f} AS l, r.{f} AS r, {_norm(f, f'b.{f}')} AS nb, {_norm(f, f'l.{f}')} AS nl, {_norm(f, f'r.{f}')} AS nr, {_norm(f, chr(39) * 2) if f != 'latlon' else chr(39) * 2} AS ne FROM j" for f in _FIELDS
    )
    return f"""+ bs AS ({base}), j AS (SELECT coalesce(b.record_id, l.record_id, r.record_id) AS record_id, b.record_id IS NOT NULL AS ib, l.record_id IS NOT NULL AS il, r.record_id IS NOT NULL AS ir, b, l, r
      FROM bs b FULL JOIN fx_merge_local l ON b.record_id = l.record_id FULL JOIN fx_merge_remote r ON coalesce(b.record_id, l.record_id) = r.record_id),
    x AS ({cells}),
    y AS (SELECT *, bool_or(nl IS DISTINCT FROM nr) OVER (PARTITION BY record_id) AS lr, bool_or(CASE WHEN il THEN nl IS DISTINCT FROM nb ELSE nr IS DISTINCT FROM nb END) OVER (PARTITION BY record_id) AS edited FROM x),
    z AS (SELECT *, NOT ib AND il AND ir AND lr AS added, ib AND il <> ir AND edited AND {str(deletions).lower()} AS deleted FROM y),
    m AS (SELECT *, (ib AND il AND ir AND nl <> nb AND nr <> nb AND nl <> nr) OR (added AND nl <> nr) OR (deleted AND coalesce(nl, ne) <> coalesce(nr, ne)) AS clash,
       CASE WHEN ib AND il AND ir THEN CASE WHEN nl <> nb AND nr <> nb AND nl <> nr THEN b WHEN nr <> nb AND nl = nb THEN r ELSE l END WHEN deleted THEN b WHEN il THEN l WHEN ir THEN r ELSE b END AS v FROM z),
    g AS (SELECT record_id, any_value(ib) AS ib, any_value(il) AS il, any_value(ir) AS ir, any_value(deleted) AS deleted, bool_or(clash) AS clash, bool_or(v IS DISTINCT FROM b) AS moved,
       {', '.join(f"max(v) FILTER (field = '{f}') AS {f}" for f in _FIELDS)} FROM m GROUP BY record_id),
    o AS (SELECT record_id, CASE WHEN clash THEN 'conflict' WHEN NOT ib AND il THEN 'added_local' WHEN NOT ib THEN 'added_remote' WHEN NOT (il AND ir) THEN 'removed' WHEN moved THEN 'auto_merged' ELSE 'unchanged' END AS outcome,
       NOT (ib AND NOT (il AND ir) AND {str(deletions).lower()} AND NOT deleted) AS kept, {', '.join(_FIELDS)} FROM g),
    c AS (SELECT record_id, field, coalesce(b, '') AS base, coalesce(l, '') AS local, coalesce(r, '') AS remote, CASE WHEN added THEN '{'FIRST_SYNC' if first else 'ADDED_BOTH'}' WHEN deleted THEN 'DELETE_VS_EDIT' ELSE 'FIELD' END AS kind FROM m WHERE clash)"""


_MV = ["fx_merge_base", "fx_merge_local", "fx_merge_remote"]


def _wide(merged: DataFrame) -> DataFrame:
    return merged.select("record_id", "outcome", "kept", *[C("values")[f].alias(f) for f in _FIELDS])


def _conflicts(merged: DataFrame) -> DataFrame:
    return merged.select("record_id", F.explode("conflicts").alias("c")).select("record_id", "c.*")


@query(_MV, _merge_sql() + " SELECT * FROM o")
def three_way_merge(base, local, remote):
    return _wide(merge.three_way_merge(base, local, remote, _FIELDS))


@query(_MV, _merge_sql() + " SELECT * FROM c")
def three_way_conflicts(base, local, remote):
    return _conflicts(merge.three_way_merge(base, local, remote, _FIELDS))


@query(_MV, _merge_sql(deletions=True) + " SELECT * FROM o")
def three_way_deletions(base, local, remote):
    return _wide(merge.three_way_merge(base, local, remote, _FIELDS, deletions_meaningful=True))


@query(_MV, _merge_sql(deletions=True) + " SELECT * FROM c")
def three_way_deletion_conflicts(base, local, remote):
    return _conflicts(merge.three_way_merge(base, local, remote, _FIELDS, deletions_meaningful=True))


@query(_MV, _merge_sql(first=True) + " SELECT * FROM o")
def first_sync_merge(base, local, remote):
    return _wide(merge.merge_first_sync(local, remote, _FIELDS))


@query(
    _MV,
    _merge_sql() + """, s AS (SELECT record_id, field, CASE WHEN length(record_id) % 2 = 0 THEN local ELSE remote END AS v FROM c)
    SELECT o.record_id, """ + ", ".join(f"coalesce((SELECT v FROM s WHERE s.record_id = o.record_id AND field = '{f}'), {f}) AS {f}" for f in _FIELDS) + ", 'RESOLVED' AS state FROM o WHERE kept",
)
def apply_resolutions(base, local, remote):
    merged = merge.three_way_merge(base, local, remote, _FIELDS)
    chosen = merge.conflict_rows(merged).withColumn("choice", F.when(F.length("record_id") % 2 == 0, "local").otherwise("drive"))
    return merge.apply_resolutions(merged, merge.read_conflicts(chosen), _FIELDS)


@query(
    _MV,
    _merge_sql() + ", s AS (SELECT record_id, field, CASE length(local) % 4 WHEN 0 THEN '' WHEN 1 THEN 'MAYBE' WHEN 2 THEN 'CUSTOM' ELSE 'BASE' END AS choice FROM c) SELECT record_id, field, CASE choice WHEN '' THEN 'missing' WHEN 'MAYBE' THEN 'unknown' ELSE 'no value' END AS reason FROM s WHERE choice <> 'BASE'",
)
def unresolved_conflicts(base, local, remote):
    merged = merge.three_way_merge(base, local, remote, _FIELDS)
    n = F.length("local") % 4
    return merge.unresolved_conflicts(merged, merge.conflict_rows(merged).withColumn("choice", F.when(n == 0, "").when(n == 1, "MAYBE").when(n == 2, "CUSTOM").otherwise("BASE")))


@query(["fx_merge_local"], " UNION ALL ".join(f"SELECT record_id, '{f}' AS field, {_norm(f, f)} AS normal FROM fx_merge_local" for f in _FIELDS))
def semantic_normalize(local):
    return merge.to_long(local, _FIELDS).select("record_id", "field", semantic.normalize_for_comparison(C("field"), C("value")).alias("normal"))


@query(
    ["fx_merge_local", "fx_merge_remote"],
    "+ a AS (SELECT CAST(substr(record_id, 2) AS BIGINT) % 199 AS bucket, record_id, " + " || '|' || ".join(_norm(f, f) for f in _FIELDS) + " AS x FROM fx_merge_local), b AS (SELECT CAST(substr(record_id, 2) AS BIGINT) % 199 AS bucket, record_id, "
    + " || '|' || ".join(_norm(f, f) for f in _FIELDS) + " AS y FROM fx_merge_remote) SELECT coalesce(a.bucket, b.bucket) AS bucket, count(*) FILTER (x IS DISTINCT FROM y) = 0 AS equal FROM a FULL JOIN b ON a.bucket = b.bucket AND a.record_id = b.record_id GROUP BY 1",
)
def baselines_equal(local, remote):
    keyed = lambda df: df.withColumn("bucket", F.substring("record_id", 2, 20).cast("long") % 199)
    return merge.baselines_equal(keyed(local), keyed(remote), _FIELDS, ["bucket"])


@query(
    ["fx_sync"],
    """+ d AS (SELECT *, CASE WHEN l IS NULL AND r IS NULL THEN 'noop' WHEN c IS NULL THEN CASE WHEN r IS NULL THEN 'adopt_local' WHEN l IS NULL THEN 'adopt_remote' WHEN l = r THEN 'adopt_baseline' WHEN equal THEN 'adopt_baseline_with_upload' ELSE 'first_sync_conflict' END
      WHEN l IS NOT DISTINCT FROM c AND r IS NOT DISTINCT FROM c THEN 'noop' WHEN r IS NOT DISTINCT FROM c THEN 'upload' WHEN l IS NOT DISTINCT FROM c THEN 'download' WHEN l IS NOT DISTINCT FROM r THEN 'noop' ELSE 'conflict' END AS action FROM fx_sync)
    SELECT path, action, c IS NULL AS is_first_sync, action IN ('conflict', 'first_sync_conflict') AS is_conflict, action NOT IN ('noop', 'conflict', 'first_sync_conflict', 'adopt_baseline') AS changes_content FROM d""",
)
def decide_sync(sync):
    side = lambda c: sync.select("path", C(c).alias("hash"))
    return merge.decide_sync(side("l"), side("r"), sync.select("path", C("c").alias("last_common_hash")), sync.select("path", "equal")).select("path", "action", "is_first_sync", "is_conflict", "changes_content")


# --- review, coverage, dashboard

_RESCAN = f"""+ a AS (SELECT coalesce(s.root, e.root) AS root, coalesce(s.folder, e.folder) AS folder, coalesce(s.identity, e.identity) AS identity, s.identity IS NOT NULL AS here, e.identity IS NOT NULL AS known, coalesce(s.is_entry, false) AS entry, s.filename IS NOT NULL AS present,
    s, e FROM fx_scanned s FULL JOIN fx_existing e ON s.root = e.root AND s.folder = e.folder AND s.identity = e.identity),
b AS (SELECT a.*, t, t.identity IS NOT NULL AS stated, CASE WHEN present THEN s.photo_hash ELSE '' END AS ph,
    CASE WHEN here AND entry THEN sha256(concat(s.source_description, chr(0), s.section_context, chr(0), s.source_notes)) ELSE '' END AS dh FROM a LEFT JOIN fx_states t ON t.root = a.root AND t.folder = a.folder AND t.identity = a.identity),
c AS (SELECT *, CASE WHEN here AND NOT known THEN 'created' WHEN NOT here THEN 'went_missing' WHEN entry AND present AND CASE WHEN stated THEN t.was_absent ELSE e.status = 'DESCRIBED_ABSENT' END THEN 'became_present'
    WHEN present AND stated AND t.status = 'SOURCE_MISSING' THEN 'photo_returned' WHEN stated AND ph <> '' AND t.photo_hash <> ph THEN 'photo_changed'
    WHEN entry AND stated AND t.description_hash <> dh THEN CASE WHEN t.status IN ('APPROVED', 'BUILT', 'PUBLISHED') THEN 'description_changed_after_approval' ELSE 'description_changed' END
    WHEN entry AND NOT present THEN 'still_absent' ELSE 'unchanged' END AS step FROM b),
d AS (SELECT *, CASE WHEN here AND known AND e.map_link LIKE '%q=%' AND coalesce(nullif(e.latlon, ''), '') <> '5.500000, 6.500000' THEN true ELSE false END AS applied, here AND known AND e.map_link = 'nonsense' AS refused FROM c),
f AS (SELECT *, CASE step WHEN 'became_present' THEN 'Previously absent photo found' WHEN 'photo_returned' THEN 'Photo returned' WHEN 'photo_changed' THEN 'Source photo changed' WHEN 'description_changed_after_approval' THEN 'Description changed after approval'
    WHEN 'description_changed' THEN 'Description changed' WHEN 'went_missing' THEN 'Source missing' WHEN 'created' THEN '' ELSE CASE WHEN refused THEN 'Map link not understood' WHEN applied THEN 'Map link applied' ELSE '' END END AS why FROM d)"""
_SV = ["fx_scanned", "fx_existing", "fx_states"]


@query(
    _SV,
    _RESCAN + """ SELECT root, folder, identity, step, CASE WHEN step = 'created' THEN CASE WHEN NOT entry OR present THEN 'NEW' ELSE 'DESCRIBED_ABSENT' END WHEN e.status IN ('SKIP', 'DUPLICATE') THEN e.status
    WHEN step = 'went_missing' THEN 'SOURCE_MISSING' WHEN step = 'still_absent' THEN 'DESCRIBED_ABSENT' WHEN step = 'unchanged' THEN e.status ELSE 'REVIEW' END AS status,
    CASE WHEN why = '' AND here AND known AND NOT entry AND e.source_description <> '' THEN 'Source text is stale' ELSE why END AS review_reason FROM f""",
)
def rescan_status(scanned, existing, states):
    return review.rescan_merge(scanned, existing, states).select("root", "folder", "identity", F.element_at("outcomes", 1).alias("step"), "status", "review_reason")


@query(
    _SV,
    _RESCAN + """ SELECT root, folder, identity, CASE WHEN known THEN CASE WHEN e.date = '' AND here THEN s.suggested_date ELSE e.date END ELSE s.suggested_date END AS date, CASE WHEN known THEN CASE WHEN e.place = '' AND here THEN s.suggested_place ELSE e.place END ELSE s.suggested_place END AS place,
    CASE WHEN applied THEN '5.500000, 6.500000' WHEN known THEN e.latlon ELSE '' END AS latlon, CASE WHEN known AND NOT here THEN '' ELSE s.suggested_people END AS people,
    CASE WHEN here AND (entry OR NOT known) THEN s.source_description WHEN here THEN e.source_description ELSE '' END AS description,
    coalesce(CASE WHEN stated THEN nullif(t.photo_id, '') END, nullif(e.photo_id, ''), CASE WHEN here THEN substr(sha256(root || '|' || folder || '|' || identity), 1, 32) ELSE '' END) AS photo_id FROM f""",
)
def rescan_autofill(scanned, existing, states):
    return review.rescan_merge(scanned, existing, states).select("root", "folder", "identity", "date", "place", "latlon", "people", "description", "photo_id")


@query(
    _SV,
    _RESCAN + """, o AS (SELECT step AS outcome FROM f
    UNION ALL SELECT 'preserved' FROM f WHERE here AND known AND (e.date <> '' OR e.place <> '' OR e.latlon <> '' OR e.people <> '' OR e.tags <> '' OR e.description <> '')
    UNION ALL SELECT 'autofilled' FROM f WHERE here AND known AND (e.date = '' AND s.suggested_date <> '' OR e.place = '' AND s.suggested_place <> '' OR e.people = '' AND s.suggested_people <> ''
      OR e.description = '' AND CASE WHEN entry THEN s.source_description ELSE e.source_description END <> '')
    UNION ALL SELECT 'map_link_applied' FROM f WHERE applied UNION ALL SELECT 'map_link_unparsed' FROM f WHERE refused
    UNION ALL SELECT 'stale_source_text' FROM f WHERE here AND known AND NOT entry AND e.source_description <> '')
    SELECT outcome, count(*) AS n FROM o GROUP BY outcome""",
)
def rescan_outcomes(scanned, existing, states):
    return review.merge_outcomes(review.rescan_merge(scanned, existing, states))


_NEED = "(trim(review_reason) <> '' OR status IN ('REVIEW', 'SOURCE_CHANGED') OR date = '' OR place = '' OR latlon = '' OR people = '' OR tags = '')"


@query(["fx_review_rows"], f"SELECT root, folder, reference, {_NEED} AS needs_review FROM fx_review_rows")
def needs_review(rows):
    return rows.select("root", "folder", "reference", semantic.needs_review({c: C(c) for c in rows.columns}).alias("needs_review"))


@query(
    ["fx_review_rows"],
    "SELECT root, folder, count(*) AS rows, count(*) FILTER (status <> 'DESCRIBED_ABSENT') AS present, count(*) FILTER (status = 'DESCRIBED_ABSENT') AS absent, "
    + ", ".join(f"count(*) FILTER (trim({f}) <> '') AS with_{f}" for f in semantic.TRACKED_FIELDS)
    + f", count(*) FILTER ({_NEED}) AS needs_review, CAST(grouping(root, folder) AS INTEGER) AS level FROM fx_review_rows GROUP BY ROLLUP (root, folder)",
)
def dashboard_summary(rows):
    return reports.dashboard_summary(rows)


@query(["fx_review_rows"], "SELECT root, folder, status, count(*) AS n FROM fx_review_rows GROUP BY GROUPING SETS ((root, folder, status), (status))")
def status_counts(rows):
    return reports.status_counts(rows)


@query(["fx_review_rows"], "SELECT root, folder, reference FROM fx_review_rows WHERE status = 'NEW' AND place = '' AND contains(lower(people), 'person 3')")
def filter_cards(rows):
    return reports.filter_cards(rows, text="Person 3", status="NEW", flags=("noplace",)).select("root", "folder", "reference")


_COVER = """+ s AS (SELECT *, CASE CAST(substr(folder, 2) AS INTEGER) % 5 WHEN 0 THEN 'ABSENT' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'UNKNOWN' ELSE 'FOUND' END AS folder_status FROM fx_state_rows),
c AS (SELECT s.*, r.status, CASE WHEN folder_status <> 'FOUND' THEN NULL WHEN NOT source_entry_exists THEN 'NO_ENTRY' WHEN source_description <> '' THEN 'DESCRIBED' WHEN section_context <> '' THEN 'CONTEXT_ONLY' ELSE 'ENTRY_EMPTY' END AS coverage
      FROM s JOIN fx_review_rows r ON s.root = r.root AND s.folder = r.folder AND s.identity = r.reference)"""


def _covered(states, rows):
    folders = states.select("root", "folder").distinct()
    n = F.substring("folder", 2, 9).cast("int") % 5
    folders = folders.withColumn("status", F.when(n == 0, "ABSENT").when(n == 1, "AMBIGUOUS").when(n == 2, "odd").otherwise("FOUND"))
    both = rows.select("root", "folder", C("reference").alias("identity"), "status").join(states.drop("source_entry_exists"), ["root", "folder", "identity"])
    return reports.coverage_join(both, folders, states)


@query(["fx_state_rows", "fx_review_rows"], _COVER + " SELECT root, folder, identity, folder_status, coverage FROM c")
def coverage_join(states, rows):
    return _covered(states, rows).select("root", "folder", "identity", "folder_status", "coverage")


@query(
    ["fx_state_rows", "fx_review_rows"],
    _COVER + """, g AS (SELECT root, folder, folder_status, count(*) FILTER (status <> 'DESCRIBED_ABSENT') AS photos, count(*) FILTER (status <> 'DESCRIBED_ABSENT' AND coverage = 'DESCRIBED') AS described, count(*) FILTER (status <> 'DESCRIBED_ABSENT' AND coverage = 'CONTEXT_ONLY') AS a,
      count(*) FILTER (status <> 'DESCRIBED_ABSENT' AND coverage = 'ENTRY_EMPTY') AS b, count(*) FILTER (status <> 'DESCRIBED_ABSENT' AND coverage = 'NO_ENTRY') AS d FROM c GROUP BY ALL),
    h AS (SELECT *, concat_ws(' · ', CASE WHEN a > 0 THEN a || ' context only' END, CASE WHEN b > 0 THEN b || ' empty entries' END, CASE WHEN d > 0 THEN d || ' no entry' END) AS why FROM g)
    SELECT root, folder, folder_status, photos, described, a + b + d AS needs_description, photos || ' photos · ' || CASE folder_status WHEN 'UNKNOWN' THEN 'description coverage: not yet observed' WHEN 'ABSENT' THEN 'description document: absent · ' || photos || ' need manual description'
      WHEN 'AMBIGUOUS' THEN 'description document: ambiguous · coverage unresolved' ELSE described || ' described · ' || (a + b + d) || ' need description' || CASE WHEN why <> '' THEN ' (' || why || ')' ELSE '' END END AS sentence FROM h""",
)
def coverage_summary(states, rows):
    return reports.coverage_summary(_covered(states, rows))


_BUILD = r"""+ b AS (SELECT reference, concat_ws(chr(31), reference, concat_ws(chr(31), 'albums=', 'date=' || date, 'description=', 'event=', 'latlon=' || regexp_replace(latlon, '\s+', ' ', 'g'),
  'people=' || array_to_string(list_sort(list_filter(list_transform(string_split_regex(people, '[;,]'), lambda x: lower(trim(x))), lambda x: x <> '')), ';'), 'place=' || place, 'tags=' || tags), 'build=1', 'dates=1') AS payload FROM fx_review_rows)"""


def _fingerprints(rows):
    row = {c: C(c) for c in rows.columns} | {c: F.lit("") for c in ("description", "event", "albums")}
    return rows.select("reference", semantic.build_fingerprint(row, C("reference")).alias("fingerprint"))


@query(["fx_review_rows"], _BUILD + " SELECT reference, 'sha256:' || sha256(payload) AS fingerprint FROM b")
def build_fingerprint(rows):
    return _fingerprints(rows)


@query(["fx_review_rows"], _BUILD + " SELECT reference, length(reference) % 3 <> 1 AS rebuild FROM b")
def needs_rebuild(rows):
    n = F.length("reference") % 3
    return _fingerprints(rows).select("reference", semantic.needs_rebuild(F.when(n == 0, "").when(n == 1, C("fingerprint")).otherwise("sha256:old"), C("fingerprint")).alias("rebuild"))


@query(
    ["fx_review_rows"],
    """+ a AS (SELECT DISTINCT root, 'p' || (CAST(reference AS BIGINT) % 500) AS stem, root || '/' || (CAST(reference AS BIGINT) % 500) AS path FROM fx_review_rows WHERE CAST(reference AS BIGINT) % 3 = 0)
    SELECT r.reference, coalesce((SELECT min(path) FROM a WHERE a.root = r.root AND stem = 'p' || (CAST(r.reference AS BIGINT) % 1000)), (SELECT min(path) FROM a WHERE stem = 'p' || (CAST(r.reference AS BIGINT) % 1000))) AS asset FROM fx_review_rows r""",
)
def locate_asset(rows):
    n = C("reference").cast("long")
    assets = rows.where(n % 3 == 0).select("root", F.concat(F.lit("p"), n % 500).alias("stem"), F.concat_ws("/", "root", (n % 500).cast("string")).alias("path")).distinct()
    return reports.locate_asset(rows.withColumn("stem", F.concat(F.lit("p"), n % 1000)), assets).select("reference", "asset")


# --- fingerprints


@query(
    ["fx_fingerprints"],
    """+ d AS (SELECT min(photo_id) AS id, ('0x' || image_fingerprint)::UBIGINT AS x FROM fx_fingerprints GROUP BY image_fingerprint)
    SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.x, b.x)) AS INTEGER) AS distance FROM d a JOIN d b ON a.id < b.id WHERE bit_count(xor(a.x, b.x)) <= 7""",
)
def near_pairs(prints):
    return similarity.near_pairs(prints, 7)


@query(
    ["fx_fingerprints"],
    """+ d AS (SELECT min(photo_id) AS id, ('0x' || image_fingerprint)::UBIGINT AS x FROM fx_fingerprints GROUP BY image_fingerprint),
    p AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.x, b.x)) AS INTEGER) AS distance FROM d a JOIN d b ON a.id <> b.id WHERE bit_count(xor(a.x, b.x)) <= 7), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY distance, b) AS INTEGER) AS rank FROM p)
    SELECT * FROM r WHERE rank <= 5""",
)
def rank_similar(prints):
    return similarity.rank_similar(prints)


@tables(
    ["embeddings"],
    """WITH p AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS g FROM embeddings)
    SELECT vec_id, array_to_string(list_transform(range(16), lambda k: printf('%x', list_sum(list_transform(range(4), lambda j: CASE WHEN g[((k * 4 + j) // 8) * 9 + (k * 4 + j) % 8 + 1] > g[((k * 4 + j) // 8) * 9 + (k * 4 + j) % 8 + 2] THEN (8 >> j::INTEGER) ELSE 0 END))::BIGINT)), '') AS fingerprint FROM p""",
)
def dhash(vectors):
    return vectors.select("vec_id", similarity.dhash(F.concat("embedding", F.slice("embedding", 1, 8))).alias("fingerprint"))
