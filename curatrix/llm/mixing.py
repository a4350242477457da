"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target /
source size. The documents are put in a fixed order, the expected copies are
prefix-summed, one random offset is added, and a document is emitted once for
each integer boundary that its interval crosses. The order is by size, so that
every stretch of the order, and with it the sample, has its share of long and
short documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

#: Words are runs of anything but ASCII white space; weights repeat by source rank.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
ROWS_PER_CELL = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit_interval(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sources: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources``: (__src, source, source_size). Adds ``target``: shares of the total by
    weight, none above ``max_copies`` times its size, the excess reshared by weight.

    Sorted by cap / weight, the capped sources are a prefix, so the level of the
    others follows from prefix sums; no iteration is needed. The windows run over
    one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    which = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (which + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_copies
    ranked = sources.withColumn("__w", weight).withColumn("__cap", cap)
    order = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    levelled = ranked.withColumn("__i", F.row_number().over(order)).withColumn("__level", level)
    free = F.when(F.col("__cap") > F.col("__level") * F.col("__w"), F.struct("__i", "__level"))
    first_free = F.min(free).over(everything)
    target = F.when(first_free.isNull() | (F.col("__i") < first_free["__i"]), F.col("__cap")).otherwise(
        F.least(F.col("__cap"), first_free["__level"] * F.col("__w"))
    )
    return levelled.withColumn("target", target).drop("__w", "__cap", "__i", "__level")


def mix(docs: DataFrame, seed: int = 11, weights=WEIGHTS, max_copies: int = MAX_COPIES, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (long).

    A source's order is (size bit length, salt, size, hash of doc_id, hash of the row), so only
    equal rows tie and reruns agree. Each (source, bit
    length, salt) cell holds about ``rows_per_cell`` rows at most, is numbered in
    a task of its own, and gets its offset from a prefix sum over cells; a source
    with a third of all rows is thus spread over many tasks.

    Defined cases: null text has size 0; a null source is a source of its own, the
    last one; a source of size 0 has target 0 and gives no copies; an empty table
    gives an empty table; repeated rows are separate documents; columns named
    like the four results are replaced.
    """
    salts = max(1, -(-docs.count() // rows_per_cell))
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    hexed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    base = (
        docs.select(*[F.col(f"`{c}`") for c in names])
        .withColumn("size", word_count(F.col("text")))
        .withColumn("__src", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
        .withColumn("__hex", hexed)
        .withColumn("__bin", F.char_length(F.bin("size")))
        .withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if c in names and not re.search("map<|variant", kind)]))
        .withColumn("__salt", F.conv(F.substring("__hex", 1, 7), 16, 10).cast("long") % F.lit(salts))
    )
    cells = materialize(base.groupBy("__src", "source", "__bin", "__salt").agg(F.count("*").alias("__rows"), F.sum("size").alias("__words")), "cells")
    sources = source_targets(cells.groupBy("__src", "source").agg(F.sum("__words").alias("source_size")), weights, max_copies)
    along = Window.partitionBy("__src").orderBy("__bin", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        cells.withColumn("__first", F.coalesce(F.sum("__rows").over(along), F.lit(0)))
        .drop("source", "__rows", "__words")
        .join(sources.drop("source"), "__src")
    )
    inside = Window.partitionBy("__src", "__bin", "__salt").orderBy("size", "__hex", "__row")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    offset = _unit_interval(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("offset"), F.col("__src"))))
    numbered = base.withColumn("__n", F.row_number().over(inside)).join(placed, ["__src", "__bin", "__salt"])
    i = (F.col("__first") + F.col("__n")).cast("double")
    copies = (F.floor(i * rate + offset) - F.floor((i - 1) * rate + offset)).cast("long")
    return numbered.select(*[F.col(f"`{c}`") for c in names], "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it has copies, same columns. Null and
    empty texts have no words, so they stand where their order puts them like any other row;
    repeated rows are rows of their own; an empty table gives an empty table."""
    mixed = mix(docs, **options).where("copies > 0")
    back = {c: F.col(f"m.`{c}`") for c in docs.columns if c in mixed.columns and c not in ("size", "source_size", "target", "copies")}
    clash = [c for c in docs.columns if c not in back]
    if clash:  # columns that carry a result's name travel under another
        renamed = docs.select(*[F.col(f"`{c}`").alias(f"__in_{c}" if c in clash else c) for c in docs.columns])
        return emit(renamed, **options).select(*[F.col(f"`__in_{c}`" if c in clash else f"`{c}`").alias(c) for c in docs.columns])
    return mixed.alias("m").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*back.values())


def query(spark, sf_dir):
    from curatrix.llm.common import table

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = """
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 1000000.0) AS BIGINT)) AS salts FROM documents),
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
             coalesce('s' || source, 'n') AS src, md5('11:' || CAST(doc_id AS VARCHAR)) AS hexed FROM documents),
b AS (SELECT *, length(bin(size)) AS bits, CAST('0x' || substr(hexed, 1, 7) AS BIGINT) % (SELECT salts FROM n) AS salt FROM d),
s AS (SELECT src, source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY src, source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS i,
             (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT min(i) AS i0, arg_min(level, i) AS level0 FROM l WHERE cap > level * w),
t AS (SELECT src, source_size, CASE WHEN i0 IS NULL OR i < i0 THEN cap ELSE least(cap, level0 * w) END AS target FROM l, f),
r AS (SELECT b.doc_id, b.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END AS rate,
             CAST(CAST('0x' || substr(md5('11:offset:' || src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u,
             CAST(row_number() OVER (PARTITION BY src ORDER BY bits, salt, size, hexed) AS DOUBLE) AS i
      FROM b JOIN t USING (src))
SELECT doc_id, size, source_size, target, CAST(floor(i * rate + u) - floor((i - 1) * rate + u) AS BIGINT) * size AS taken FROM r
"""
