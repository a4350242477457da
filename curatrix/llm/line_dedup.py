"""Line dedup, native: explode normalised lines, hash, count distinct documents
per hash, drop lines over the threshold, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import digest128

#: The ASCII white space stripped from both ends of a line.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A line of very many documents meets its key in so many places.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Strip ASCII white space, lower-case A-Z only. ``lower`` is used where all
    bytes are ASCII (it has a fast path there), ``translate`` elsewhere."""
    stripped = F.btrim(line, F.lit(ASCII_SPACE))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_keys(docs: DataFrame, min_docs: int, min_key_chars: int) -> DataFrame:
    """(h1, h2) of line keys that at least ``min_docs`` documents hold.

    Keys are made distinct inside the row, so the count needs one shuffle, of
    hashes only, after a map-side partial count (a line in a third of all
    documents costs one row per map task).
    """
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_key_chars))
    h1, h2 = digest128(F.col("k"))
    return (
        docs.select(F.explode(keys).alias("k"))
        .select(h1.alias("h1"), h2.alias("h2"))
        .groupBy("h1", "h2")
        .count()
        .where(F.col("count") >= min_docs)
        .select("h1", "h2")
    )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1) -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents.

    Returns the columns of ``docs`` with ``text`` replaced, plus ``n_lines`` and
    ``n_dropped`` (long); columns of those two names are replaced.

    Defined cases: null or empty text is one empty line, which is never dropped,
    and the kept text is ''. Each row counts as a document, also when doc_id is
    null or repeated. If all lines go, the text becomes ''. An empty table gives
    an empty table. Other columns pass through untouched.
    """
    r1, r2 = digest128(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    salted = frequent_keys(docs, min_docs, min_key_chars).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns], r1.alias("__r1"), r2.alias("__r2"))
    h1, h2 = digest128(F.col("k"))
    lines = (
        src.select("__r1", "__r2", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("__r1", "__r2", "pos", line_key(F.col("line")).alias("k"))
        .where(F.char_length("k") >= min_key_chars)
        .select("__r1", "__r2", "pos", h1.alias("h1"), h2.alias("h2"), F.pmod("__r1", F.lit(SALTS)).cast("int").alias("salt"))
    )
    dropped = (
        lines.join(salted, ["h1", "h2", "salt"])
        .groupBy("__r1", "__r2")
        .agg(F.array_sort(F.collect_set("pos")).alias("__at"))
    )
    # Sorted positions -> one boolean per line up to the last dropped one, in linear time.
    at = F.col("__at")
    before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.size(at) - 1))
    flags = F.flatten(
        F.transform(
            F.zip_with(at, before, lambda a, b: a - b - 1),
            lambda gap: F.concat(F.array_repeat(F.lit(False), gap), F.array(F.lit(True))),
        )
    )
    kept = F.array_join(
        F.zip_with(_lines(F.col("text")), flags, lambda line, gone: F.when(F.coalesce(gone, F.lit(False)), F.lit(None)).otherwise(line)),
        "\n",
    )
    text = F.when(at.isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(kept)
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out["text"] = text
    out["n_lines"] = F.size(_lines(F.col("text"))).cast("long")
    out["n_dropped"] = F.coalesce(F.size(at), F.lit(0)).cast("long")
    return src.join(dropped, ["__r1", "__r2"], "left").select(*[e.alias(c) for c, e in out.items()])


def query(spark, sf_dir):
    from curatrix.llm.common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT rid, doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
