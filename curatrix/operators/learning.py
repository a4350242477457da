"""Learning dictionary knowledge from what people typed into review rows.

The outcome is that of learning row by row in the order of ``ord``, but computed over all rows at
once. New entities are one per normalised value, also within a row (the first spelling wins);
aliases are decided in turns until nothing changes (``learn_aliases``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.geo import format_latlon, parse_latlon
from curatrix.functions.text import blank_if_null, candidate_chunks, is_blank, is_context_dependent, normalize_phrase, split_list_field, strip
from curatrix.operators.dictionary import claim_spans, entity_id, find_candidates, propose_latlon, resolve_canonical
from curatrix.scratch import written

_ALWAYS = -(1 << 62)


def _teaches() -> Column:
    some = ~is_blank(F.col("people")) | ~is_blank(F.col("place")) | ~is_blank(F.col("tags")) | ~is_blank(F.col("latlon"))
    return ~F.col("status").isin("ERROR", "SKIP") & some


def teaching_rows(rows: DataFrame) -> DataFrame:
    """Rows not in ERROR or SKIP with people, place, tags or coordinates."""
    return rows.where(_teaches())


def taught_values(rows: DataFrame) -> DataFrame:
    """(ord, root, folder, reference, entity_type, value): people and tags are lists, a place is whole."""
    cell = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("value")))
    place = F.filter(F.array(strip(blank_if_null(F.col("place")))), lambda v: v != "")
    every = F.concat(cell("person", split_list_field(F.col("people"))), cell("tag", split_list_field(F.col("tags"))), cell("place", place))
    return teaching_rows(rows).select("ord", "root", "folder", "reference", F.explode(every).alias("v")).select("ord", "root", "folder", "reference", "v.entity_type", "v.value")


def new_entities(values: DataFrame, phrases: DataFrame) -> DataFrame:
    """(entity_type, canonical, ord): values that no confirmed phrase explains, one per normalised value."""
    open_ = resolve_canonical(values, phrases).where("canonical IS NULL").withColumn("key", normalize_phrase(F.col("value")))
    first = open_.groupBy("entity_type", "key").agg(F.min(F.struct("ord", "value")).alias("f"))
    return first.select("entity_type", F.col("f.value").alias("canonical"), F.col("f.ord").alias("ord"))


def taught_rows(rows: DataFrame, values: DataFrame, phrases: DataFrame) -> DataFrame:
    """(ord, entity_type, canonical, text): what a row teaches and its source text, where the text doesn't
    contain the canonical name."""
    named = resolve_canonical(values, phrases).where("canonical IS NOT NULL").select("ord", "entity_type", "canonical").distinct()
    texts = rows.where(~is_blank(F.col("source_description"))).select("ord", strip(F.col("source_description")).alias("text"))
    source = normalize_phrase(F.col("text"))
    return named.join(texts, "ord").where(~F.contains(source, normalize_phrase(F.col("canonical"))))


def alias_offers(taught: DataFrame, phrases: DataFrame) -> DataFrame:
    """(text, entity_type, canonical, i, chunk, key, known): parts of a text that may be another spelling of what
    rows with that text teach. ``known``: the entity has that alias already, in whatever status."""
    texts = taught.select("text").distinct().select("text", F.posexplode(candidate_chunks(F.col("text"))).alias("i", "chunk"))
    chunks = texts.withColumn("key", normalize_phrase(F.col("chunk"))).where("key <> ''")
    offers = taught.select("text", "entity_type", "canonical").distinct().join(chunks, "text")
    own = phrases.select("entity_type", "canonical", F.col("phrase").alias("chunk"), F.lit(True).alias("known")).distinct()
    return offers.join(own, ["entity_type", "canonical", "chunk"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def learn_aliases(rows: DataFrame, values: DataFrame, phrases: DataFrame) -> DataFrame:
    """(entity_type, canonical, alias, reason, ord): candidate spellings, as learned row by row in the order of ``ord``.

    A row sees the phrases that were there before it: those of ``phrases`` without ``born`` (ord of the row that brings
    one), those born in earlier rows, and the aliases that earlier rows have taught. A chunk counts unless such a phrase
    of its type claims it in the text, or it holds one of another type; an alias that its entity already has
    (refused ones too) is not taught again.

    All places where anything that may become an alias stands are found once, in the distinct texts. Rows with
    one text that teach one entity see the same phrases unless one of those in their text is born between them, so they
    fall into few classes, and of a class only the first row matters. Classes are decided in turns, each with
    the births that the turn before gave. A row is right as soon as the rows it depends on are, so the
    turns end, and at the one outcome that learning row by row has.
    """
    if "born" not in phrases.columns:
        phrases = phrases.withColumn("born", F.lit(None).cast("long"))
    phrases = written(phrases, "phrases")  # it is read many times
    entity, place = ["text", "entity_type", "canonical"], ["text", "entity_type"]
    taught = written(taught_rows(rows, values, phrases), "taught")
    offers = written(alias_offers(taught, phrases), "offers")
    maybe = offers.where("NOT known").select("entity_type", F.lit("").alias("canonical"), F.col("chunk").alias("phrase"), F.lit("CANDIDATE").alias("status")).distinct()
    every = phrases.select("entity_type", "canonical", "phrase", "status", F.col("born").cast("long").alias("born"), F.lit(False).alias("taught")).unionByName(
        maybe.withColumns({"born": F.lit(None).cast("long"), "taught": F.lit(True)})
    )
    since = F.coalesce("born", F.lit(_ALWAYS)).alias("since")

    found = find_candidates(offers.select(F.col("text").alias("text_id"), "text").distinct(), every).withColumnRenamed("text_id", "text")
    found = written(found.join(offers.select(*place).distinct(), place, "left_semi").withColumn("since", since).drop("born"), "found")
    inside = find_candidates(offers.select(F.col("chunk").alias("text_id"), F.col("chunk").alias("text")).distinct(), every)
    inside = written(inside.select(F.col("text_id").alias("chunk"), F.col("entity_type").alias("other"), "phrase", since, "taught").distinct(), "inside")

    def alive(places: DataFrame, kind: str, born: DataFrame | None) -> DataFrame:
        """``places`` of phrases that some row has brought, with when."""
        fixed = places.where("NOT taught")
        if born is None:
            return fixed
        named = born.select(F.col("entity_type").alias(kind), F.col("chunk").alias("phrase"), F.col("since").alias("__since"))
        return fixed.unionByName(places.where("taught").join(named, [kind, "phrase"]).withColumn("since", F.col("__since")).select(*places.columns))

    def decide(born: DataFrame | None) -> DataFrame:
        """The offers that count, each with the first row of its class."""
        here = alive(found, "entity_type", born)
        blocks = alive(inside, "other", born).groupBy("chunk", "other").agg(F.min("since").alias("since"))
        blocked = offers.select(*place, "chunk").distinct().join(blocks, "chunk").where("entity_type <> other")
        changes = here.select(*place, "since").unionByName(blocked.select(*place, "since")).where(F.col("since") > _ALWAYS)
        changes = changes.groupBy(*place).agg(F.collect_set("since").alias("changes"))  # a few phrases of one text
        epoch = F.coalesce(F.size(F.filter("changes", lambda c: c < F.col("ord"))), F.lit(0))
        classes = taught.join(changes, place, "left").groupBy(*entity, epoch.alias("epoch")).agg(F.min("ord").alias("ord"))
        classes = written(classes, "classes")
        seen = classes.groupBy(*place, "epoch").agg(F.min("ord").alias("ord")).join(here, place).where("since < ord")
        spans = seen.select(F.struct("text", "epoch").alias("text_id"), "entity_type", *("canonical", "phrase", "status", "start", "end", "matched_text"))
        claims = claim_spans(spans).select("text_id.text", "text_id.epoch", "entity_type", normalize_phrase(F.col("matched_text")).alias("key")).distinct()
        o, x = classes.join(offers, entity).join(claims, [*place, "epoch", "key"], "left_anti").alias("o"), blocks.alias("x")
        return o.join(x, (F.col("o.chunk") == F.col("x.chunk")) & (F.col("o.entity_type") != F.col("x.other")) & (F.col("x.since") < F.col("o.ord")), "left_anti")

    born, last = None, None
    while True:
        taken = written(decide(born), "taken")
        born = written(taken.where("NOT known").groupBy("entity_type", "chunk").agg(F.min("ord").alias("since")), "born")
        mark = tuple(born.agg(F.count("*"), F.sum(F.xxhash64("entity_type", "chunk", "since").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last = mark

    counted = taken.withColumn("n", F.count("*").over(Window.partitionBy(*entity, "epoch")))
    reason = F.when((F.col("n") == 1) & ~is_context_dependent(F.col("chunk")), "APPROVED_VS_SOURCE").otherwise("FUZZY_CANDIDATE")
    first = counted.where("NOT known").withColumn("reason", reason).groupBy("entity_type", "canonical", "chunk").agg(F.min(F.struct("ord", "i", "reason")).alias("b"))
    return first.select("entity_type", "canonical", F.col("chunk").alias("alias"), "b.reason", "b.ord")


def taught_coordinates(rows: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """(ord, canonical, key, latlon) of rows that give a place and its coordinates. With ``phrases``
    another spelling of a place stands for its canonical name."""
    point = parse_latlon(F.col("latlon"))
    taught = teaching_rows(rows).where(~is_blank(F.col("place")) & point.isNotNull()).select("ord", strip(F.col("place")).alias("value"), format_latlon(point).alias("latlon"))
    if phrases is not None:
        named = resolve_canonical(taught.select(F.lit("place").alias("entity_type"), "value").distinct(), phrases).select("value", "canonical")
        taught = taught.join(named, "value", "left")
    else:
        taught = taught.withColumn("canonical", F.lit(None).cast("string"))
    canonical = F.coalesce("canonical", "value")
    return taught.select("ord", canonical.alias("canonical"), normalize_phrase(canonical).alias("key"), "latlon")


def learn_coordinates(rows: DataFrame, places: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """(entity_id, latlon, result) per place and distinct coordinates, from rows with both;
    ``places``: (entity_id, canonical, latlon)."""
    named = places.select("entity_id", normalize_phrase(F.col("canonical")).alias("key"))
    return propose_latlon(places, taught_coordinates(rows, phrases).join(named, "key").select("entity_id", "latlon", "ord"))


def coordinate_evidence(rows: DataFrame, places: DataFrame, coordinates: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """(entity_type, canonical, reason, candidate_text, latlon, ord): each row's coordinates, approved
    or in conflict with those that stand."""
    named = places.select("entity_id", "canonical", normalize_phrase(F.col("canonical")).alias("key"))
    judged = taught_coordinates(rows, phrases).drop("canonical").join(named, "key").join(coordinates, ["entity_id", "latlon"])
    reason = F.when(F.col("result") == "conflict", "COORDINATE_CONFLICT").otherwise("APPROVED_COORDINATES")
    return judged.select(F.lit("place").alias("entity_type"), "canonical", reason.alias("reason"), F.lit("").alias("candidate_text"), "latlon", "ord")


def learn_from_rows(rows: DataFrame, phrases: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """New entities, candidate aliases, coordinate results and evidence rows of one pass, and which rows took part. Nothing
    is written; a second pass over the outcome's dictionary finds nothing new. New places take
    part in the coordinates under the id that ``add_entity`` gives them."""
    values = taught_values(rows)
    fresh = written(new_entities(values, phrases), "fresh")
    born = fresh.select("entity_type", "canonical", F.col("canonical").alias("phrase"), F.lit("CONFIRMED").alias("status"), F.col("ord").cast("long").alias("born"))
    grown = phrases.withColumn("born", F.lit(None).cast("long")).unionByName(born)
    aliases = learn_aliases(teaching_rows(rows), values, grown)
    new_places = fresh.where("entity_type = 'place'").join(places.select("canonical"), "canonical", "left_anti")
    known = places.select("entity_id", "canonical", "latlon").unionByName(new_places.select(entity_id(F.lit("place"), F.col("canonical")).alias("entity_id"), "canonical", F.lit("").alias("latlon")))
    coordinates = learn_coordinates(rows, known, grown)
    where = rows.select("ord", "root", "folder", "reference")
    evidence = fresh.select("entity_type", "canonical", F.lit("APPROVED_VS_SOURCE").alias("reason"), F.lit("").alias("candidate_text"), "ord").unionByName(
        aliases.select("entity_type", "canonical", "reason", F.col("alias").alias("candidate_text"), "ord")
    )
    evidence = evidence.withColumn("latlon", F.lit("")).unionByName(coordinate_evidence(rows, known, coordinates, grown))
    return {
        "entities": fresh,
        "aliases": aliases,
        "coordinates": coordinates,
        "evidence": evidence.join(where, "ord"),
        "rows": rows.select("ord", F.when(_teaches(), "contributing").otherwise("skipped").alias("part")),
    }


def learn_outcomes(learned: dict[str, DataFrame]) -> DataFrame:
    """Counts per kind of outcome: new entities by type, candidate aliases, coordinates by result, rows that took part or not."""
    e = learned["entities"].select(F.concat(F.lit("new_"), "entity_type").alias("outcome"))
    a = learned["aliases"].select(F.lit("candidate_aliases").alias("outcome"))
    c = learned["coordinates"].select(F.concat(F.lit("latlon_"), "result").alias("outcome"))
    r = learned["rows"].select(F.concat("part", F.lit("_rows")).alias("outcome"))
    return e.unionByName(a).unionByName(c).unionByName(r).groupBy("outcome").agg(F.count("*").alias("n"))
