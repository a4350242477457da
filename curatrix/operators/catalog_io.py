"""The dictionary for people: sheets out, edited sheets in, nested export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.geo import format_latlon, parse_latlon
from curatrix.functions.text import blank_if_null, normalize_phrase, split_values, strip
from curatrix.operators.dictionary import evidence_counts, load_dictionary

ALIAS_COLUMNS = (("confirmed_aliases", "CONFIRMED"), ("candidate_aliases", "CANDIDATE"), ("rejected_aliases", "REJECTED"))


def catalog_sheets(entities: DataFrame, aliases: DataFrame, latlons: DataFrame, evidence: DataFrame) -> DataFrame:
    """One flat row per entity: aliases by status and candidate coordinates ``; ``-joined, evidence count.
    Sheets are the rows of one entity_type."""
    nested = load_dictionary(entities, aliases, latlons).join(evidence_counts(evidence), ["entity_type", "canonical"], "left")
    text = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    return nested.select(
        "entity_type", "entity_id", "canonical", *[text(s.lower()).alias(c) for c, s in ALIAS_COLUMNS],
        text("candidate_latlon").alias("candidate_latlon"), blank_if_null(F.col("latlon")).alias("latlon"), blank_if_null(F.col("notes")).alias("notes"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
    )


def export_catalog(entities: DataFrame, aliases: DataFrame, latlons: DataFrame) -> DataFrame:
    """(entity_type, entity_id, document): each entity as JSON with sorted members, refused aliases too."""
    nested = load_dictionary(entities, aliases, latlons)
    members = [c for c in ("canonical", "latlon", "notes", "confirmed", "candidate", "rejected", "candidate_latlon") if c in nested.columns]
    return nested.select("entity_type", "entity_id", F.to_json(F.struct(*members)).alias("document"))


def _stated(column: str, status: str) -> Column:
    return F.transform(split_values(F.col(column)), lambda a: F.struct(a.alias("alias"), F.lit(status).alias("status")))


def import_catalog(sheet: DataFrame, entities: DataFrame, aliases: DataFrame) -> dict[str, DataFrame]:
    """What an edited sheet changes. ``sheet``: entity_type, entity_id, canonical, the alias columns, latlon.

    An id that is known with another name is a rename; an unknown or empty id adds an entity, and an
    unknown one is reported. An alias named in a column takes its status; named in several, REJECTED wins over
    CONFIRMED over CANDIDATE, and the collision is reported; CANDIDATE to CONFIRMED is a promotion. Aliases not named stay. A confirmed alias
    equal to another entity's name asks for a merge. Bad coordinates are reported and the old ones kept.
    """
    rows = sheet.withColumn("canonical", strip(blank_if_null(F.col("canonical")))).where("canonical <> ''")
    known = entities.select("entity_type", "entity_id", F.col("canonical").alias("old_name"), F.col("latlon").alias("old_latlon"))
    joined = rows.join(known, ["entity_type", "entity_id"], "left")
    given = blank_if_null(F.col("entity_id")) != ""
    new_id = F.substring(F.sha2(F.concat_ws("\u0000", "entity_type", "canonical"), 256), 1, 16)
    joined = joined.withColumn("id", F.when(F.col("old_name").isNotNull(), F.col("entity_id")).otherwise(new_id))
    point, typed = parse_latlon(F.col("latlon")), strip(blank_if_null(F.col("latlon")))
    stated = joined.select(
        "entity_type", "id", "canonical",
        F.explode(F.flatten(F.array(*[_stated(c, s) for c, s in ALIAS_COLUMNS]))).alias("a"),
    ).select("entity_type", F.col("id").alias("entity_id"), "a.alias", "a.status")
    rank = F.when(F.col("status") == "REJECTED", 0).when(F.col("status") == "CONFIRMED", 1).otherwise(2)
    first = Window.partitionBy("entity_type", "entity_id", "alias").orderBy(rank)
    ranked = stated.withColumn("n", F.row_number().over(first))
    decided = ranked.where("n = 1").drop("n")
    before = aliases.select("entity_type", "entity_id", "alias", F.col("status").alias("old"))
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("old") == F.col("status"), "unchanged").when((F.col("old") == "CANDIDATE") & (F.col("status") == "CONFIRMED"), "promoted").otherwise("changed")
    sure = decided.where("status = 'CONFIRMED'").withColumn("key", normalize_phrase(F.col("alias")))
    other = entities.select("entity_type", F.col("entity_id").alias("absorbed"), normalize_phrase(F.col("canonical")).alias("key"))
    return {
        "renames": joined.where(F.col("old_name").isNotNull() & (F.col("old_name") != F.col("canonical"))).select("entity_type", "entity_id", F.col("canonical").alias("new_name")),
        "added": joined.where(F.col("old_name").isNull()).select("entity_type", F.col("id").alias("entity_id"), "canonical"),
        "invalid": joined.where(given & F.col("old_name").isNull()).select("entity_type", "entity_id", "canonical"),
        "aliases": decided.join(before, ["entity_type", "entity_id", "alias"], "left").select("entity_type", "entity_id", "alias", "status", outcome.alias("outcome")),
        "collisions": ranked.where("n > 1").select("entity_type", "entity_id", "alias").distinct(),
        "merges": sure.join(other, ["entity_type", "key"]).where("entity_id <> absorbed").select("entity_type", F.col("entity_id").alias("survivor"), "absorbed"),
        "latlons": joined.where((typed != "") & point.isNotNull() & ~blank_if_null(F.col("old_latlon")).eqNullSafe(format_latlon(point))).select("entity_type", F.col("id").alias("entity_id"), format_latlon(point).alias("latlon")),
        "bad_latlons": joined.where((typed != "") & point.isNull()).select("entity_type", F.col("id").alias("entity_id"), "latlon"),
    }


def import_outcomes(imported: dict[str, DataFrame]) -> DataFrame:
    """Counts per kind."""
    parts = [df.select(F.lit(n).alias("outcome")) for n, df in imported.items() if n != "aliases"]
    out = imported["aliases"].select(F.concat(F.lit("alias_"), "outcome").alias("outcome"))
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("outcome").agg(F.count("*").alias("n"))
