"""Views over the test tables in SQL that Spark and DuckDB both run, but for the digest
function, which is written <sha>...</sha>.

``FX`` holds the views; ``view`` builds one in Spark, ``with_views`` prefixes DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_LISTING_PATH = "concat('f', o_custkey % 40, '/', o_orderkey, CASE WHEN o_orderkey % 113 = 0 THEN '.docx' WHEN o_orderkey % 31 = 0 THEN '.txt' ELSE '.jpg' END)"

FX = {
    "fx_listing_prev": f"""
SELECT concat('root', o_custkey % 3) AS root_id, {_LISTING_PATH} AS relative_path, false AS is_directory,
       CAST(o_orderkey * 7 + 1000 AS BIGINT) AS size, o_orderdate AS modified_at,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE md5(CAST(o_orderkey AS STRING)) END AS content_hash,
       CASE WHEN o_orderkey % 43 = 0 THEN true ELSE false END AS was_missing
FROM orders WHERE o_orderkey % 13 <> 0""",
    "fx_listing_curr": f"""
SELECT concat('root', o_custkey % 3) AS root_id, {_LISTING_PATH} AS relative_path, false AS is_directory,
       CAST(o_orderkey * 7 + 1000 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size, o_orderdate AS modified_at,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN md5(concat('x', o_orderkey)) ELSE md5(CAST(o_orderkey AS STRING)) END AS content_hash
FROM orders WHERE o_orderkey % 17 <> 0""",
    "fx_raw_listing": """
SELECT concat('root', o_custkey % 3) AS root_id, concat('\\\\a//f', o_custkey % 40, '/') AS parent,
       CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat(o_orderkey, '.jpg') END AS name,
       CASE WHEN o_orderkey % 20 = 1 THEN 'dir' ELSE 'file' END AS type, CAST(o_orderkey AS BIGINT) AS size,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE md5(CAST(o_orderkey AS STRING)) END AS md5,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('s', o_orderkey) END AS sha256,
       CASE WHEN o_orderkey % 6 = 0 THEN 'yesterday' ELSE '2020-02-03 04:05:06' END AS modified, concat('id', o_orderkey) AS remote_id
FROM orders""",
    "fx_photos": """
SELECT concat('f', o_custkey % 50) AS folder, concat('IMG_', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '.jpg' ELSE '.JPEG' END) AS name
FROM orders WHERE o_orderkey % 7 IN (1, 4, 5) AND o_orderkey % 5 <> 0""",
    "fx_numbered_photos": """
SELECT concat('f', o_custkey % 50) AS folder, concat(o_orderkey, '.jpg') AS name FROM orders WHERE o_orderkey % 7 IN (1, 4, 5) AND o_orderkey % 5 <> 0""",
    "fx_paragraphs": """
SELECT concat('f', o_custkey % 50) AS folder, o_orderkey AS pos,
  CASE WHEN o_orderkey % 7 = 1 AND o_orderkey % 11 = 0 THEN concat('Далее раздел ', o_orderkey)
       WHEN o_orderkey % 7 IN (1, 4) THEN concat('IMG_', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('   19', 50 + o_orderkey % 50, CASE WHEN o_orderkey % 4 = 0 THEN ' май 19. ' WHEN o_orderkey % 4 = 1 THEN ' июнь. ' ELSE '. ' END, p_name) END)
       WHEN o_orderkey % 7 = 2 AND o_orderkey % 5 = 0 THEN '- нет фото'
       WHEN o_orderkey % 7 = 3 AND o_orderkey % 5 = 0 THEN concat('19', 50 + o_orderkey % 50, '. ', p_brand)
       ELSE concat(p_name, ' ', s_name, CASE WHEN o_orderkey % 9 = 0 THEN ' - Нет Фото' ELSE '' END) END AS text
FROM orders JOIN part ON o_orderkey % 200 = p_partkey JOIN supplier ON o_orderkey % 10 = s_suppkey""",
    "fx_dictionary": """
SELECT DISTINCT 'tag' AS entity_type, p_name AS canonical, p_name AS phrase, 'CONFIRMED' AS status FROM part
UNION ALL SELECT 'person', s_name, s_name, 'CONFIRMED' FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT DISTINCT 'place', concat('Place of ', p_brand), p_brand, CASE WHEN p_brand LIKE '%1' THEN 'CANDIDATE' WHEN p_brand LIKE '%2' THEN 'REJECTED' ELSE 'CONFIRMED' END FROM part""",
    "fx_merge_base": """
SELECT concat('r', c_custkey) AS record_id, c_name AS place, c_mktsegment AS status, 'a; b' AS people,
       concat('  ', c_custkey % 90, '.', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ',  37.5') AS latlon
FROM customer WHERE c_custkey % 17 <> 1""",
    "fx_merge_local": """
SELECT concat('r', c_custkey) AS record_id, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, ' L') ELSE c_name END AS place,
       CASE WHEN c_custkey % 5 = 0 THEN 'LOCAL' ELSE c_mktsegment END AS status, 'B, a' AS people,
       concat('  ', c_custkey % 90, '.', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ',  37.5') AS latlon
FROM customer WHERE c_custkey % 19 <> 2""",
    "fx_merge_remote": """
SELECT concat('r', c_custkey) AS record_id, CASE WHEN c_custkey % 4 = 0 THEN concat(c_name, ' R') WHEN c_custkey % 9 = 0 THEN concat(c_name, '  L ') ELSE c_name END AS place,
       c_mktsegment AS status, 'b;a' AS people,
       concat('  ', c_custkey % 90, '.', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ',  37.5') AS latlon
FROM customer WHERE c_custkey % 23 <> 3""",
    "fx_review_rows": """
SELECT concat('src', o_custkey % 4) AS root, concat('f', o_custkey % 25) AS folder, CAST(o_orderkey AS STRING) AS reference,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE substr(CAST(o_orderdate AS STRING), 1, 4 + 3 * CAST(o_orderkey % 3 AS INT)) END AS date,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('Place ', o_custkey % 37) END AS place,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(o_custkey % 37, '.', lpad(CAST(CASE WHEN o_orderkey % 41 = 0 THEN 9000 WHEN o_orderkey % 43 = 0 THEN 1000 ELSE 5 END AS STRING), 6, '0'), ', 37.500000') END AS latlon,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('Person ', o_custkey % 11, ', ', 'person  ', o_custkey % 13) END AS people,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('tag', o_custkey % 9) END AS tags,
  CASE o_orderkey % 10 WHEN 0 THEN 'DESCRIBED_ABSENT' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'APPROVED' WHEN 3 THEN 'SKIP' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'SOURCE_MISSING' WHEN 6 THEN 'DUPLICATE' ELSE 'NEW' END AS status,
  CASE WHEN o_orderkey % 8 = 0 THEN 'Description changed' ELSE '' END AS review_reason
FROM orders""",
    "fx_state_rows": """
SELECT concat('src', o_custkey % 4) AS root, concat('f', o_custkey % 25) AS folder, CAST(o_orderkey AS STRING) AS identity,
  (o_orderkey % 9 <> 0) AS source_entry_exists, CASE WHEN o_orderkey % 5 < 2 THEN '' ELSE 'text' END AS source_description,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Далее' ELSE '' END AS section_context, CASE WHEN o_orderkey % 11 = 0 THEN 'нет фото' ELSE '' END AS source_notes
FROM orders""",
    "fx_fingerprints": """
SELECT concat('photo-', o_orderkey) AS photo_id,
       concat(substr(md5(CAST(o_orderkey - o_orderkey % 15 AS STRING)), 1, 15), substr('0123456789abcdef', 1 + CAST(o_orderkey % 16 AS INT), 1)) AS image_fingerprint
FROM orders""",
    "fx_links": """
SELECT o_orderkey AS id, CASE o_orderkey % 8
    WHEN 0 THEN concat('https://www.google.com/maps/search/?api=1&query=', o_custkey % 80, '.125%2C37.5')
    WHEN 1 THEN concat('https://www.google.com/maps/search/?api=1&query=', o_custkey % 80, '.25, -37.5')
    WHEN 2 THEN concat('https://maps.google.com/?q=', o_custkey % 100, '.5,37.25')
    WHEN 3 THEN concat('https://maps.google.com/?ll=-', o_custkey % 80, ',37')
    WHEN 4 THEN concat('https://www.google.com/maps/@', o_custkey % 80, '.5,37.25,15z')
    WHEN 5 THEN concat('https://www.google.com/maps/place/x/data=!3d', o_custkey % 80, '.75!4d-12.5')
    WHEN 6 THEN 'https://www.google.com/maps/place/somewhere' ELSE '' END AS url
FROM orders""",
    "fx_sync": """
SELECT concat('p', c_custkey) AS path, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('h', c_custkey % 3) END AS l,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('h', c_custkey % 4) END AS r,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE concat('h', c_custkey % 6) END AS c, c_custkey % 11 = 0 AS equal
FROM customer""",
    "fx_scanned": """
SELECT 'root' AS root, concat('f', o_custkey % 50) AS folder, concat('img_', o_orderkey) AS identity, concat('IMG_', o_orderkey) AS reference,
       o_orderkey % 7 IN (1, 4) AS is_entry, CASE WHEN o_orderkey % 7 = 4 AND o_orderkey % 2 = 0 THEN NULL ELSE concat('IMG_', o_orderkey, '.jpg') END AS filename,
       CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('ph', o_orderkey % 4) END AS photo_hash, CASE WHEN o_orderkey % 8 = 0 THEN concat('fp', o_orderkey) ELSE '' END AS fingerprint,
       CASE WHEN o_orderkey % 7 IN (1, 4) THEN concat('text ', o_orderkey % 100) ELSE '' END AS source_description,
       CASE WHEN o_orderkey % 7 = 1 THEN 'Далее' ELSE '' END AS section_context, '' AS source_notes,
       CASE WHEN o_orderkey % 3 = 0 THEN '1979' ELSE '' END AS suggested_date, CASE WHEN o_orderkey % 5 = 0 THEN 'Place 1' ELSE '' END AS suggested_place,
       '' AS suggested_latlon, CASE WHEN o_orderkey % 4 = 0 THEN 'Person 1' ELSE '' END AS suggested_people, '' AS suggested_tags
FROM orders WHERE o_orderkey % 7 IN (1, 4, 5)""",
    "fx_existing": """
SELECT 'root' AS root, concat('f', o_custkey % 50) AS folder, concat('img_', o_orderkey) AS identity, concat('IMG_', o_orderkey) AS reference,
       concat('IMG_', o_orderkey, '.jpg') AS filename, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('id', o_orderkey) END AS photo_id,
       CASE o_orderkey % 9 WHEN 0 THEN 'DESCRIBED_ABSENT' WHEN 1 THEN 'SOURCE_MISSING' WHEN 2 THEN 'APPROVED' WHEN 3 THEN 'SKIP' WHEN 4 THEN 'DUPLICATE' ELSE 'NEW' END AS status,
       '' AS review_reason, concat('text ', o_orderkey % 100) AS source_description, '' AS section_context, '' AS source_notes,
       '' AS suggested_date, '' AS suggested_place, '' AS suggested_latlon, '' AS suggested_people, '' AS suggested_tags,
       CASE WHEN o_orderkey % 4 = 1 THEN '1980-05' ELSE '' END AS date, CASE WHEN o_orderkey % 2 = 0 THEN concat('Place ', o_orderkey % 5) ELSE '' END AS place,
       CASE WHEN o_orderkey % 10 = 0 THEN '1.000000, 2.000000' ELSE '' END AS latlon, '' AS people, '' AS tags, '' AS description,
       CASE WHEN o_orderkey % 12 = 0 THEN 'https://maps.google.com/?q=5.5,6.5' WHEN o_orderkey % 12 = 1 THEN 'nonsense' ELSE '' END AS map_link, '' AS event, '' AS albums, '' AS notes
FROM orders WHERE o_orderkey % 7 IN (1, 4, 5, 6) AND o_orderkey % 13 <> 0""",
    "fx_states": """
SELECT 'root' AS root, concat('f', o_custkey % 50) AS folder, concat('img_', o_orderkey) AS identity, concat('ph', o_orderkey % 4 - CASE WHEN o_orderkey % 15 = 0 THEN 1 ELSE 0 END) AS photo_hash,
       CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE <sha>concat('text ', o_orderkey % 100, chr(0), CASE WHEN o_orderkey % 7 = 1 THEN 'Далее' ELSE '' END, chr(0))</sha> END AS description_hash,
       CASE o_orderkey % 9 WHEN 0 THEN 'DESCRIBED_ABSENT' WHEN 1 THEN 'SOURCE_MISSING' WHEN 2 THEN 'APPROVED' WHEN 3 THEN 'SKIP' WHEN 4 THEN 'DUPLICATE' ELSE 'NEW' END AS status,
       o_orderkey % 9 = 0 AS was_absent, CASE WHEN o_orderkey % 2 = 0 THEN concat('sid', o_orderkey) ELSE '' END AS photo_id, '' AS image_fingerprint
FROM orders WHERE o_orderkey % 7 IN (1, 4, 5, 6) AND o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0""",
    "fx_evidence": """
SELECT 'person' AS entity_type, concat('Person ', o_custkey % 1100) AS canonical, substr(CAST(o_orderdate AS STRING), 1, 7) AS run_id FROM orders
UNION ALL SELECT 'tag', concat('tag', o_custkey % 90, '-', substr(CAST(o_orderdate AS STRING), 1, 4)), substr(CAST(o_orderdate AS STRING), 1, 7) FROM orders""",
    "fx_merge_pairs": """
SELECT 'tag' AS entity_type, concat('e', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS absorbed, concat('e', lpad(CAST(o_orderkey - 1 AS STRING), 9, '0')) AS survivor
FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT 'tag', concat('e', lpad(CAST(o_orderkey AS STRING), 9, '0')), concat('e', lpad(CAST(o_orderkey + 2 AS STRING), 9, '0'))
FROM orders WHERE o_orderkey % 30 = 0""",
    "fx_merge_chains": """
SELECT 'tag' AS entity_type, concat('n', lpad(CAST(c_custkey AS STRING), 9, '0')) AS absorbed,
       concat('n', lpad(CAST(CASE WHEN c_custkey % 61 = 0 AND c_custkey % 2 = 0 THEN c_custkey + 9 ELSE c_custkey - 1 END AS STRING), 9, '0')) AS survivor
FROM customer WHERE c_custkey % 61 <> 0 OR c_custkey % 2 = 0
UNION ALL SELECT 'place', concat('n', lpad(CAST(c_custkey AS STRING), 9, '0')), concat('n', lpad(CAST(c_custkey + 1 AS STRING), 9, '0')) FROM customer WHERE c_custkey % 17 <> 0""",
    "fx_sheet": """
SELECT entity_type, CASE WHEN length(canonical) % 11 = 0 THEN '' WHEN length(canonical) % 13 = 0 THEN concat('no-', canonical) ELSE canonical END AS entity_id,
       CASE WHEN length(canonical) % 5 = 0 THEN concat(canonical, ' II') ELSE canonical END AS canonical,
       CASE WHEN entity_type = 'person' THEN 'supplier#000000001' ELSE concat(canonical, ' x; ', canonical, ' y') END AS confirmed_aliases, concat(canonical, ' y;; ', canonical, ' z ') AS candidate_aliases,
       CASE WHEN entity_type = 'place' THEN substr(canonical, 10) ELSE '' END AS rejected_aliases,
       CASE length(canonical) % 3 WHEN 0 THEN 'north' WHEN 1 THEN '3.5, 4.25' ELSE '1.000000, 2.000000' END AS latlon
FROM (SELECT DISTINCT entity_type, canonical FROM (
  SELECT 'tag' AS entity_type, p_name AS canonical FROM part UNION ALL SELECT 'person', s_name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'place', concat('Place of ', p_brand) FROM part) AS n) AS m""",
    "fx_learn_start": """
SELECT DISTINCT 'person' AS entity_type, concat('Person ', c_custkey % 4) AS canonical, concat('Person ', c_custkey % 4) AS phrase, 'CONFIRMED' AS status FROM customer
UNION SELECT 'tag', 'tag-old', concat('tag', c_custkey % 3), 'CONFIRMED' FROM customer
UNION SELECT 'place', concat('Place ', c_custkey % 10), concat('Place ', c_custkey % 10), 'CONFIRMED' FROM customer
UNION SELECT 'place', concat('Place ', c_custkey % 37), concat('Garden ', c_custkey % 50), CASE c_custkey % 3 WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'CANDIDATE' ELSE 'CONFIRMED' END
FROM customer WHERE c_custkey % 5 = 0""",
    "fx_learn_rows": """
SELECT o_orderkey AS ord, concat('src', o_custkey % 4) AS root, concat('f', o_custkey % 25) AS folder, CAST(o_orderkey AS STRING) AS reference,
       CASE WHEN o_orderkey % 10 = 3 THEN 'SKIP' WHEN o_orderkey % 10 = 4 THEN 'ERROR' ELSE 'NEW' END AS status,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('Person ', o_custkey % 11, ', ', 'person  ', o_custkey % 13) END AS people,
       CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('Place ', o_custkey % 37) END AS place, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('tag', o_custkey % 9) END AS tags,
       CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(o_custkey % 37, '.', lpad(CAST(CASE WHEN o_orderkey % 41 = 0 THEN 9000 WHEN o_orderkey % 43 = 0 THEN 1000 ELSE 5 END AS STRING), 6, '0'), ', 37.500000') END AS latlon,
       CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN concat('Person ', o_custkey % 11, '. Garden ', o_custkey % 50) WHEN o_orderkey % 6 = 2 THEN concat('Aunt Olga ', o_custkey % 100, '. 1979. In the garden')
            ELSE concat('Somewhere by river ', o_custkey % 30) END AS source_description
FROM orders""",
}


def bind(spark: SparkSession, sf_dir: str) -> None:
    """Register the tables as views; a view that is built is bound to them at once."""
    for t in ("customer", "supplier", "part", "orders", "documents", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bind(spark, sf_dir)
    return spark.sql(FX[name].replace("<sha>", "sha2(").replace("</sha>", ", 256)"))


def with_views(names: list[str], sql: str, recursive: bool = False) -> str:
    """DuckDB SQL over the views; ``sql`` may begin with "+" and go on with views of its own."""
    head = ", ".join(f"{n} AS ({FX[n]})" for n in names).replace("<sha>", "sha256(").replace("</sha>", ")")
    own = sql.lstrip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' + own[1:] if own[0] == '+' else ' ' + own}"
