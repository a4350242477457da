"""Entity dictionary: phrases, matching in texts, resolution, and idempotent updates.

``phrases``: (entity_type, canonical, phrase, status), the canonical spelling itself
being a CONFIRMED phrase. ``texts``: (text_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.dates import suggest_date
from curatrix.functions.geo import format_latlon, materially_different, parse_latlon
from curatrix.functions.text import blank_if_null, normalize_phrase, strip
from curatrix.scratch import written

_RUN = r"(?U)\w+"
_MARK = "\x01"
#: Words in a row by which a longer phrase is looked up.
ANCHOR = 4


def active_phrases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_type, canonical, phrase, status): canonical names and aliases not REJECTED."""
    names = entities.select("entity_type", "entity_id", "canonical")
    own = names.select("entity_type", "canonical", F.col("canonical").alias("phrase"), F.lit("CONFIRMED").alias("status"))
    other = aliases.where("status <> 'REJECTED'").join(names, ["entity_type", "entity_id"])
    return own.unionByName(other.select("entity_type", "canonical", F.col("alias").alias("phrase"), "status"))


def _with_runs(df: DataFrame) -> DataFrame:
    """``df`` with the words of ``low``, each with what follows it up to the next (``pieces``), and where
    they begin (from 0), by one pass over its characters."""
    # the first letter of each word becomes a mark, and the marks' places are where words begin
    marked = F.regexp_replace(F.translate("low", _MARK, " "), r"(?U)(?<!\w)\w", _MARK)
    begins = F.transform(F.split(marked, ""), lambda c, i: F.when(c == _MARK, i))
    words, pieces = (F.regexp_extract_all("low", F.lit(r), F.lit(0)) for r in (_RUN, _RUN + r"\W*"))
    return df.withColumns({"words": words, "pieces": pieces, "at": F.array_compact(begins)})


def _window_hashes(width: int) -> Column:
    """The hash of every ``width`` words in a row, with what stands between them."""
    last = F.size("words") - width
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(width), F.slice(F.col("pieces"), i + 1, width - 1), F.get("words", i + width - 1)))


def phrase_index(phrases: DataFrame) -> DataFrame:
    """(needle, width, h, offset): each needle is looked up by the hash of up to ``ANCHOR`` words in a row, those that
    the fewest needles hold, which begin ``offset`` characters after it."""
    needles = phrases.select("needle").distinct().withColumn("low", F.col("needle"))
    runs = _with_runs(needles).where(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(ANCHOR)))
    every = F.lit(None).cast("array<bigint>")
    for width in range(1, ANCHOR + 1):
        every = F.when(F.col("width") == width, _window_hashes(width)).otherwise(every)
    windows = runs.select("needle", "width", "at", F.posexplode(every).alias("j", "h")).select("needle", "width", "j", "h", F.get("at", F.col("j")).alias("offset"))
    held = windows.groupBy("width", "h").agg(F.count_distinct("needle").alias("held"))
    best = windows.join(held, ["width", "h"]).groupBy("needle").agg(F.min(F.struct("held", "j", "width", "h", "offset")).alias("b"))
    return best.select("needle", "b.width", "b.h", "b.offset")


def met_phrases(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(text_id, needle, start): where a needle's anchor words stand in a text. ``texts``: (text_id, low)."""
    widths = [r.width for r in index.select("width").distinct().collect()]  # ``ANCHOR`` rows at most
    if not widths:
        return texts.select("text_id", F.lit("").alias("needle"), F.lit(0).alias("start")).limit(0)
    runs = _with_runs(texts.select("text_id", "low"))
    windows = [
        F.when(F.size("words") >= w, F.arrays_zip(_window_hashes(w).alias("h"), F.slice("at", F.lit(1), F.size("words") - w + 1).alias("at"), F.array_repeat(F.lit(w), F.size("words") - w + 1).alias("width")))
        for w in sorted(widths)
    ]
    none = F.array().cast("array<struct<h:bigint,at:int,width:int>>")
    every = F.concat(*[F.coalesce(w, none) for w in windows])
    # explode_outer: from explode Spark infers a filter on the array, and computes it again below
    places = runs.select("text_id", F.explode_outer(every).alias("w")).select("text_id", "w.h", "w.at", "w.width").where("h IS NOT NULL")
    return places.join(index, ["width", "h"]).select("text_id", "needle", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")


def find_candidates(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every place where a phrase stands as whole words, overlaps included: (text_id,
    entity_type, canonical, phrase, status, start, end, matched_text), offsets from 0.

    A phrase's words are whole words of the text it stands in, in the same order, so texts and
    phrases meet by equi-join on the hash of some words in a row (``phrase_index``); what meets
    is nearly sure, and only that fetches its text and is compared. A phrase without a word
    character matches nothing. Further columns of ``phrases`` travel along.
    """
    needle = F.lower(strip(F.col("phrase")))
    keyed = phrases.where("status <> 'REJECTED'").withColumn("needle", needle)
    low = texts.select("text_id", "text", F.lower("text").alias("low")).where(F.col("low").isNotNull())
    met = met_phrases(low, written(phrase_index(keyed), "index")).join(low, "text_id")  # each text is shuffled once
    end = F.col("start") + F.length("needle")
    edge = lambda c: ~c.rlike(r"(?U)^\w")
    before = F.when(F.col("start") > 0, F.substring(F.col("low"), F.col("start"), F.lit(1))).otherwise("")
    after = F.substring(F.col("low"), end + 1, F.lit(1))
    fits = (F.substring(F.col("low"), F.col("start") + 1, F.length("needle")) == F.col("needle")) & edge(before) & edge(after)
    cut = F.substring(F.col("text"), F.col("start") + 1, F.length("needle"))
    found = met.where(fits).select("text_id", "needle", "start", end.alias("end"), cut.alias("matched_text"))
    extra = [c for c in phrases.columns if c not in ("entity_type", "canonical", "phrase", "status")]
    return found.join(keyed, "needle").select("text_id", "entity_type", "canonical", "phrase", "status", "start", "end", "matched_text", *extra)


_CLAIM = ("phrase", "canonical", "start", "end", "status")


def claim_spans(candidates: DataFrame) -> DataFrame:
    """Of overlapping candidates of a text and entity type the longest phrase wins, then the
    phrase text, then canonical, then the first start; a span is claimed once.

    Candidates that no other overlaps stand by themselves: the candidates of a text fall into
    clusters of overlapping spans, and a claim is decided inside its cluster."""
    along = Window.partitionBy("text_id", "entity_type").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    parted = candidates.withColumn("__opens", opens).withColumn("__cluster", F.sum("__opens").over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    extra = [c for c in candidates.columns if c not in ("text_id", "entity_type", *_CLAIM)]
    order = F.struct((-F.length("phrase")).alias("n"), *_CLAIM, *extra)
    ranked = parted.groupBy("text_id", "entity_type", "__cluster").agg(F.array_sort(F.collect_set(order)).alias("c"))
    free = lambda acc, x: ~F.exists(acc, lambda t: (x["start"] < t["end"]) & (x["end"] > t["start"]))
    kept = F.aggregate("c", F.slice("c", 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return ranked.select("text_id", "entity_type", F.explode(kept).alias("m")).select("text_id", "entity_type", *[f"m.{c}" for c in ("canonical", "phrase", "status", "start", "end", *extra)])


def find_matches(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """All non-overlapping dictionary phrases per text and entity type, with the matched text. A phrase that is
    listed several times claims as one, so it is looked up once."""
    return claim_spans(find_candidates(texts, phrases.distinct()))


def confirmed_canonicals(matches: DataFrame) -> DataFrame:
    """(text_id, entity_type, canonicals): confirmed names in order of first occurrence."""
    first = matches.where("status = 'CONFIRMED'").groupBy("text_id", "entity_type", "canonical").agg(F.min("start").alias("start"))
    listed = first.groupBy("text_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("start", "canonical"))).alias("c"))
    return listed.select("text_id", "entity_type", F.transform("c", lambda x: x["canonical"]).alias("canonicals"))


def resolve_place(values: DataFrame, phrases: DataFrame, places: DataFrame) -> DataFrame:
    """``values`` (value) with ``resolution`` (resolved, ambiguous, none), ``canonical``, ``names``
    (sorted, if ambiguous) and ``latlon``, by whole-value equality with a confirmed phrase."""
    keys = phrases.where("entity_type = 'place' AND status = 'CONFIRMED'").select(normalize_phrase(F.col("phrase")).alias("key"), "canonical").distinct()
    asked = values.select("value").distinct().withColumn("key", normalize_phrase(F.col("value")))
    found = asked.join(keys, "key", "left").groupBy("value").agg(F.array_sort(F.collect_set("canonical")).alias("names"))
    n = F.size("names")
    out = found.select(
        "value",
        F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("none").alias("resolution"),
        F.when(n == 1, F.try_element_at("names", F.lit(1))).alias("canonical"),
        F.when(n > 1, F.array_join("names", "; ")).alias("names"),
    )
    return out.join(places.select("canonical", "latlon"), "canonical", "left").select("value", "resolution", "canonical", "names", "latlon")


def resolve_canonical(values: DataFrame, phrases: DataFrame) -> DataFrame:
    """(entity_type, value) with ``canonical``: the first entity by name with that confirmed phrase."""
    keys = phrases.where("status = 'CONFIRMED'").groupBy("entity_type", normalize_phrase(F.col("phrase")).alias("key")).agg(F.min("canonical").alias("canonical"))
    asked = values.withColumn("key", normalize_phrase(F.col("value")))
    return asked.join(keys, ["entity_type", "key"], "left").drop("key")


def suggest(entries: DataFrame, phrases: DataFrame, places: DataFrame) -> DataFrame:
    """Per entry (entry_id, text, section_context): date, the one confirmed place and its
    coordinates, people (also from the section), tags, ambiguous places, and counters."""
    # texts and sections are searched in one pass; a section gives people only, after those of the text
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("text")), F.struct(F.lit(1).alias("part"), F.col("section_context").alias("text")))
    texts = entries.select("entry_id", F.explode(parts).alias("p")).where("p.text IS NOT NULL").select(F.struct("entry_id", "p.part").alias("text_id"), "p.text")
    shift = F.col("text_id.part") * F.lit(1 << 30)
    every = find_matches(texts, phrases).where("text_id.part = 0 OR entity_type = 'person'")
    found = every.withColumns({"start": F.col("start") + shift, "end": F.col("end") + shift, "text_id": F.col("text_id.entry_id")})
    lists = confirmed_canonicals(found).groupBy("text_id").agg(
        *[F.max(F.when(F.col("entity_type") == t, F.col("canonicals"))).alias(t) for t in ("person", "place", "tag")]
    )
    hints = found.where("status = 'CANDIDATE'").groupBy("text_id").agg(F.count("*").alias("candidates"))
    rows = entries.join(lists.withColumnRenamed("text_id", "entry_id"), "entry_id", "left").join(hints.withColumnRenamed("text_id", "entry_id"), "entry_id", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    one = F.when(n("place") == 1, F.try_element_at("place", F.lit(1)))
    joined = rows.withColumn("p", one).join(places.select(F.col("canonical").alias("p"), F.col("latlon").alias("place_latlon")), "p", "left")
    text = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    return joined.select(
        "entry_id", suggest_date(F.col("text")).alias("date"), F.coalesce("p", F.lit("")).alias("place"), F.coalesce("place_latlon", F.lit("")).alias("latlon"),
        text("person").alias("people"), text("tag").alias("tags"), F.when(n("place") > 1, text("place")).otherwise("").alias("ambiguous_places"),
        n("person").alias("people_matched"), n("place").alias("places_matched"), n("tag").alias("tags_matched"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
    )


def load_dictionary(entities: DataFrame, aliases: DataFrame, latlons: DataFrame) -> DataFrame:
    """Entities with their aliases by status and candidate coordinates (unparsable dropped), sorted."""
    by = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("alias")))).alias(s.lower())
    named = aliases.groupBy("entity_type", "entity_id").agg(*[by(s) for s in ("CONFIRMED", "CANDIDATE", "REJECTED")])
    points = latlons.where(parse_latlon(F.col("latlon")).isNotNull()).groupBy("entity_id").agg(F.array_sort(F.collect_set("latlon")).alias("candidate_latlon"))
    return entities.join(named, ["entity_type", "entity_id"], "left").join(points, "entity_id", "left")


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("entity_type", "canonical").agg(F.count("*").alias("evidence_count"))


def upsert_alias(aliases: DataFrame, proposed: DataFrame) -> DataFrame:
    """Aliases after proposals (entity_type, entity_id, alias, status): new ones enter, CANDIDATE
    rises to CONFIRMED, CONFIRMED never falls, REJECTED never returns. ``changed`` tells."""
    key = ["entity_type", "entity_id", "alias"]
    strongest = proposed.groupBy(*key).agg(F.max(F.col("status")).alias("asked"))  # CONFIRMED > CANDIDATE by spelling
    both = aliases.withColumnRenamed("status", "old").join(strongest, key, "full")
    rises = (F.col("old") == "CANDIDATE") & (F.col("asked") == "CONFIRMED")
    status = F.when(F.col("old").isNull(), F.col("asked")).when(rises, "CONFIRMED").otherwise(F.col("old"))
    return both.select(*key, status.alias("status"), F.coalesce(F.col("old").isNull() | rises, F.lit(False)).alias("changed"))


def set_alias_status(aliases: DataFrame, decided: DataFrame) -> DataFrame:
    """A person's decision: overrides in either direction, inserts if absent. Of several on one
    alias the last by ``ord`` holds; without that column the strongest word does (REJECTED over
    CONFIRMED over CANDIDATE)."""
    key = ["entity_type", "entity_id", "alias"]
    late = F.col("ord") if "ord" in decided.columns else F.lit(0)
    last = decided.groupBy(*key).agg(F.max_by("status", F.struct(late.alias("ord"), "status")).alias("status"))
    return aliases.join(last, key, "left_anti").unionByName(last)


def propose_latlon(places: DataFrame, proposals: DataFrame) -> DataFrame:
    """(entity_id, latlon, result): added where the place had none (the first proposal by
    ``ord``), unchanged within 250 m, else conflict; one row per distinct coordinate text."""
    point = parse_latlon(F.col("latlon"))
    asked = proposals.where(point.isNotNull()).groupBy("entity_id", format_latlon(point).alias("latlon")).agg(F.min("ord").alias("ord"))
    first = Window.partitionBy("entity_id").orderBy("ord", "latlon")
    rows = asked.withColumn("n", F.row_number().over(first)).withColumn("first_latlon", F.first("latlon").over(first))
    known = places.select("entity_id", F.nullif(blank_if_null(F.col("latlon")), F.lit("")).alias("own"))
    rows = rows.join(known, "entity_id", "left").withColumn("stands", F.coalesce("own", "first_latlon"))
    apart = materially_different(parse_latlon(F.col("stands")), parse_latlon(F.col("latlon")))
    result = F.when(F.col("own").isNull() & (F.col("n") == 1), "added").when(apart, "conflict").otherwise("unchanged")
    return rows.select("entity_id", "latlon", result.alias("result"))


EVIDENCE_KEY = ("entity_type", "canonical", "reason", "candidate_text", "latlon", "root", "folder", "reference")


def record_evidence(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` not yet recorded, null and '' being equal in the key."""
    keys = [blank_if_null(F.col(c)).alias(f"__{c}") for c in EVIDENCE_KEY]
    known = evidence.select(*keys).distinct()
    fresh = new.select("*", *keys).dropDuplicates([f"__{c}" for c in EVIDENCE_KEY])
    return fresh.join(known, [f"__{c}" for c in EVIDENCE_KEY], "left_anti").select(*new.columns)


def entity_id(entity_type: Column, canonical: Column) -> Column:
    """The id that a new entity gets."""
    return F.substring(F.sha2(F.concat_ws("\u0000", entity_type, canonical), 256), 1, 16)


def add_entity(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities with the names (entity_type, canonical) that no entity has exactly; their id is
    a hash of type and name."""
    fresh = names.select("entity_type", "canonical").distinct().join(entities, ["entity_type", "canonical"], "left_anti")
    made = fresh.withColumn("entity_id", entity_id(F.col("entity_type"), F.col("canonical")))
    return entities.unionByName(made, allowMissingColumns=True)


def rename_entity(entities: DataFrame, renames: DataFrame) -> DataFrame:
    """``renames``: (entity_id, new_name)."""
    joined = entities.join(renames, "entity_id", "left")
    return joined.withColumn("canonical", F.coalesce("new_name", "canonical")).select(*entities.columns)


def clear_candidate(latlons: DataFrame, cleared: DataFrame) -> DataFrame:
    return latlons.join(cleared.select("entity_id", "latlon"), ["entity_id", "latlon"], "left_anti")


def duplicate_entity_pairs(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_type, survivor, absorbed): a confirmed alias of one is another's canonical name."""
    sure = aliases.where("status = 'CONFIRMED'").select("entity_type", F.col("entity_id").alias("survivor"), normalize_phrase(F.col("alias")).alias("key"))
    named = entities.select("entity_type", F.col("entity_id").alias("absorbed"), normalize_phrase(F.col("canonical")).alias("key"))
    return sure.join(named, ["entity_type", "key"]).where("survivor <> absorbed").select("entity_type", "survivor", "absorbed").distinct()


def survivors(pairs: DataFrame) -> DataFrame:
    """(entity_type, absorbed, survivor) at the end of every chain of merges. Of two survivors of
    one entity the least is taken; a cycle ends at its least member, and so does what leads into it.

    Pointer jumping: each turn doubles the length of the paths followed, and each path carries the least of
    the members that it reaches. Who is the least on its own path lies on a cycle and is that cycle's
    end, and so is it for every path that meets it. A row is done when its end is known, and only the
    others go on. Turns: the logarithm of the longest chain or cycle.
    """
    by = ["entity_type", "absorbed"]
    rows = pairs.where("survivor <> absorbed").groupBy(*by).agg(F.min("survivor").alias("to"))
    open_ = written(rows.withColumn("least", F.col("to")), "merges")
    done = None
    while True:
        ahead = open_.select("entity_type", F.col("absorbed").alias("to"), F.col("to").alias("far"), F.col("least").alias("far_least"))
        if done is not None:
            ahead = ahead.unionByName(done.select("entity_type", F.col("absorbed").alias("to"), F.col("to").alias("far"), F.lit(None).cast("string").alias("far_least")))
        step = open_.join(ahead, ["entity_type", "to"], "left")
        goes_on = F.col("far_least").isNotNull()  # neither at an end nor at a row that knows its end
        step = step.select(*by, F.coalesce("far", "to").alias("to"), F.when(goes_on, F.least("least", "far_least")).alias("least"))
        step = written(step, "merges")
        going = step.where("least IS NOT NULL")
        ends = written(going.where("least = absorbed").select("entity_type", "least"), "cycles")
        closed = step.where("least IS NULL").select(*by, "to")
        if not ends.isEmpty():
            going = going.join(ends.withColumn("cycle", F.col("least")), ["entity_type", "least"], "left")
            closed = closed.unionByName(going.where("cycle IS NOT NULL").select(*by, F.col("cycle").alias("to")))
            going = written(going.where("cycle IS NULL").select(*by, "to", "least"), "merges")
        done = closed if done is None else done.unionByName(closed)
        open_ = going
        if open_.isEmpty():
            break
    return done.select(*by, F.col("to").alias("survivor")).where("survivor <> absorbed")


def merge_entities(pairs: DataFrame, entities: DataFrame, aliases: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Entities, aliases, evidence and coordinate proposals after merging: aliases and evidence move
    to the survivor (clashing aliases keep the survivor's), and an absorbed name becomes a
    confirmed alias of it. A pair with an unknown entity does nothing."""
    known = lambda c: entities.select("entity_type", F.col("entity_id").alias(c)).distinct()
    real = pairs.join(known("absorbed"), ["entity_type", "absorbed"], "left_semi").join(known("survivor"), ["entity_type", "survivor"], "left_semi")
    end = survivors(real).withColumnRenamed("absorbed", "entity_id")
    by = ["entity_type", "entity_id"]
    moved = lambda df: df.join(end, by, "left").withColumn("own", F.col("survivor").isNull()).withColumn("entity_id", F.coalesce("survivor", "entity_id"))
    gone = entities.join(end, by)
    names = gone.select("entity_type", F.col("survivor").alias("entity_id"), F.col("canonical").alias("alias"), F.lit("CONFIRMED").alias("status"), F.lit(False).alias("own"))
    every = moved(aliases).select("entity_type", "entity_id", "alias", "status", "own").unionByName(names)
    first = Window.partitionBy("entity_type", "entity_id", "alias").orderBy(F.col("own").desc(), F.col("status").desc())
    return {
        "entities": entities.join(end, by, "left_anti"),
        "aliases": every.withColumn("n", F.row_number().over(first)).where("n = 1").select("entity_type", "entity_id", "alias", "status"),
        "evidence": moved(evidence).select(*evidence.columns),
        "proposals": gone.where("latlon <> ''").select(F.col("survivor").alias("entity_id"), "latlon") if "latlon" in entities.columns else None,
    }
