"""Ordered paragraphs to description entries, and entries to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.text import filename_like_reference, filename_stem, is_section_divider, leading_token, let, source_notes, strip, strip_edges, strip_reference, without_source_notes
from curatrix.operators.listing import first_wins, plan_folders
from curatrix.scratch import in_blocks, written


def folder_names(photos: DataFrame) -> DataFrame:
    """(folder, word): folded names and stems of the photos in a folder."""
    name = F.lower("name")
    return photos.select("folder", F.explode(F.array_distinct(F.array(name, filename_stem(name)))).alias("word"))


def _tokens(paragraphs: DataFrame) -> DataFrame:
    """(folder, pos, text, divider, token) of the paragraphs that aren't blank."""
    token = lambda t, d: F.struct(t.alias("text"), d.alias("divider"), F.when(~d, leading_token(t)).alias("token"))
    cut = let(strip(F.col("text")), lambda t: let(is_section_divider(t), lambda d: token(t, d)))
    # explode_outer: filters on what it makes stay above it, so a paragraph is cut up once
    return paragraphs.select("folder", "pos", F.explode_outer(F.array(cut)).alias("t")).select("folder", "pos", "t.*").where("text <> ''")


def _width(word: Column) -> Column:
    """The number of digits of a word whose stem is digits only."""
    return let(filename_stem(word), lambda s: F.when(s.rlike("^[0-9]+$"), F.length(s)))


def _style(tokens: DataFrame, photos: DataFrame) -> DataFrame:
    """A token counts if it is strong or names a photo of its folder. A photo gives its own width, so of the tokens
    that name one only those matter whose stem the photo's own isn't: it has an extension itself."""
    parts = let(F.lower("token"), lambda w: F.struct(w.alias("word"), _width(w).alias("width"), filename_like_reference(w).alias("strong")))
    some = tokens.where("token IS NOT NULL").select("folder", F.explode_outer(F.array(parts)).alias("t")).select("folder", "t.*").where("width IS NOT NULL")
    stem = filename_stem(F.lower("name"))
    names = photos.select("folder", F.explode_outer(F.array(F.struct(stem.alias("word"), _width(stem).alias("inner"), _width(F.lower("name")).alias("width")))).alias("t"))
    names = names.select("folder", "t.*")
    twice = names.where("inner IS NOT NULL AND width IS NULL").select("folder", "word").distinct().withColumn("known", F.lit(True))
    shown = some.join(twice, ["folder", "word"], "left").where("strong OR known").select("folder", "width")
    return shown.unionByName(names.where("width IS NOT NULL").select("folder", "width")).distinct()


def reference_style(paragraphs: DataFrame, photos: DataFrame) -> DataFrame:
    """(folder, width): digit counts that bare numeric references have in a folder, shown by
    its photos or by strong references in its text."""
    return _style(_tokens(paragraphs), photos)


def classify_paragraphs(paragraphs: DataFrame, photos: DataFrame) -> DataFrame:
    """Non-blank paragraphs with ``kind``: divider, start (and its ``reference``) or text. The paragraphs
    are read and cut up once."""
    tokens = written(_tokens(paragraphs), "tokens")
    named = folder_names(photos).distinct().withColumn("is_known", F.lit(True))
    styled = _style(tokens, photos).withColumn("is_styled", F.lit(True))
    tokens = tokens.withColumn("word", F.lower("token")).withColumn("width", F.when(F.col("token").rlike("^[0-9]+$"), F.length("token")))
    judged = tokens.join(named, ["folder", "word"], "left").join(styled, ["folder", "width"], "left")
    starts = F.coalesce("is_known", F.lit(False)) | F.coalesce(filename_like_reference(F.col("token")), F.lit(False)) | F.coalesce("is_styled", F.lit(False))
    kind = F.when(F.col("divider"), "divider").when(F.col("token").isNotNull() & starts, "start").otherwise("text")
    return judged.select("folder", "pos", "text", kind.alias("kind"), F.when(kind == "start", F.col("token")).alias("reference"))


def _carried(paragraphs: DataFrame, photos: DataFrame, pieces: int | None = None) -> DataFrame:
    """Paragraphs with the entry number, and the section and mark before them, carried forward.

    A segmented scan: paragraphs are cut into blocks in the order of folder and place, whatever the
    folders' sizes. Each block sums up its part of a folder (entries opened, last section, last mark),
    the sums are carried over the folder's blocks, and a second scan inside the blocks starts from
    what was carried. So a giant folder is many tasks."""
    rows = in_blocks(classify_paragraphs(paragraphs, photos), ["folder"], [F.col("pos")], "block", pieces)
    is_ = lambda kind: F.col("kind") == kind
    last = lambda value, where: F.max_by(F.when(where, value), F.when(where, F.col("pos")))
    summed = rows.groupBy("folder", "block").agg(
        F.count_if(is_("start")).alias("n"), last(F.col("text"), is_("divider")).alias("section"), last(F.col("kind"), ~is_("text")).alias("mark")
    )
    before = Window.partitionBy("folder").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    carry = summed.select(
        "folder", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.last("section", ignorenulls=True).over(before).alias("section0"), F.last("mark", ignorenulls=True).over(before).alias("mark0"),
    )
    inside = Window.partitionBy("folder", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rows.withColumns(
        {
            "n": F.sum(F.when(is_("start"), 1).otherwise(0)).over(inside),
            "section": F.last(F.when(is_("divider"), F.col("text")), ignorenulls=True).over(inside),
            "mark": F.last(F.when(~is_("text"), F.col("kind")), ignorenulls=True).over(inside),
        }
    )
    return scanned.join(carry, ["folder", "block"]).select(
        "folder", "pos", "text", "kind", "reference", (F.col("n0") + F.col("n")).alias("entry_seq"),
        F.coalesce("section", "section0").alias("section"), F.coalesce("mark", "mark0").alias("last_mark"),
    )


def group_entries(paragraphs: DataFrame, photos: DataFrame, pieces: int | None = None) -> DataFrame:
    """(folder, entry_seq, reference, text, section_context, source_notes): a reference opens an
    entry, text joins the open one, a divider closes it and names the section. Notes are lifted
    out per paragraph, and paragraphs left empty are dropped."""
    rows = _carried(paragraphs, photos, pieces).where("kind = 'start' OR (kind = 'text' AND last_mark = 'start')")
    raw = F.when(F.col("kind") == "start", strip_edges(F.substring(F.col("text"), F.length("reference") + 1, F.length("text")))).otherwise(F.col("text"))
    part = rows.withColumn("raw", raw)
    grouped = part.groupBy("folder", "entry_seq").agg(
        F.max("reference").alias("reference"),
        F.max(F.when(F.col("kind") == "start", F.col("section"))).alias("section_context"),
        F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("parts"),
    )
    texts = F.filter(F.transform("parts", lambda p: without_source_notes(p["raw"])), lambda t: t != "")
    notes = F.flatten(F.transform("parts", lambda p: source_notes(p["raw"])))
    return grouped.select("folder", "entry_seq", "reference", texts.alias("paragraphs"), strip(F.array_join(texts, " ")).alias("text"), "section_context", notes.alias("source_notes"))


def preamble(paragraphs: DataFrame, photos: DataFrame) -> DataFrame:
    """Text outside any entry: before the first reference, or after a divider."""
    return _carried(paragraphs, photos).where("kind = 'text' AND (last_mark IS NULL OR last_mark <> 'start')").select("folder", "pos", "text")


def section_dividers(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where(is_section_divider(F.col("text"))).select("folder", "pos", strip(F.col("text")).alias("text"))


def reconcile_entries(entries: DataFrame, photos: DataFrame) -> DataFrame:
    """Entries with ``photo`` (null if absent) and ``status``: by folded name, else by folded
    stem; of several photos with one key the first by name is taken."""
    keyed = photos.select("folder", "name", F.lower("name").alias("by_name"), F.lower(filename_stem(F.col("name"))).alias("by_stem"))
    named = first_wins(keyed, ["folder", "by_name"], [F.col("name")]).select("folder", "by_name", F.col("name").alias("photo_by_name"))
    stemmed = first_wins(keyed, ["folder", "by_stem"], [F.col("name")]).select("folder", "by_stem", F.col("name").alias("photo_by_stem"))
    rows = entries.withColumn("by_name", F.lower("reference")).withColumn("by_stem", filename_stem(F.lower("reference")))
    joined = rows.join(named, ["folder", "by_name"], "left").join(stemmed, ["folder", "by_stem"], "left")
    photo = F.coalesce("photo_by_name", "photo_by_stem")
    out = joined.withColumn("photo", photo).withColumn("status", F.when(photo.isNotNull(), "NEW").otherwise("DESCRIBED_ABSENT"))
    return out.drop("by_name", "by_stem", "photo_by_name", "photo_by_stem")


def undescribed_photos(reconciled: DataFrame, photos: DataFrame) -> DataFrame:
    used = reconciled.where("photo IS NOT NULL").select("folder", F.col("photo").alias("name"))
    return photos.select("folder", "name").join(used, ["folder", "name"], "left_anti")


def match_fragments(fragments: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, pos, name, how, note): the file that a text names. The whole file name anywhere
    in the text wins, the longest first; else the stem as a word of its own. ``name`` is null for
    fragments that name none.

    A file is found by equi-join on (folder, word): the last run of word characters of its
    stem. As a stem of its own it stands in the text as a whole run; inside a full name
    something may be stuck to its front, so runs that an extension follows also offer their
    ends, of the lengths that last runs have in that folder. Then the whole name is verified. No fragment meets all files of its folder.
    """
    text = fragments.select("folder", "pos", "text", F.lower("text").alias("low"))
    names = files.select("folder", "name", F.lower("name").alias("full"), F.lower(filename_stem(F.col("name"))).alias("stem"))
    names = names.withColumn("word", F.regexp_extract("stem", r"(?U)(\w+)\W*$", 1)).where("word <> ''")
    lengths = names.groupBy("folder").agg(F.collect_set(F.length("word")).alias("lengths"))  # a few numbers, 255 at most
    runs = F.regexp_extract_all("low", F.lit(r"(?U)\w+"), F.lit(0))
    stuck = F.regexp_extract_all("low", F.lit(r"(?U)(\w+)(?=\W*\.\w)"), F.lit(1))  # runs that an extension follows
    cut = text.join(lengths, "folder").select("folder", "pos", "lengths", runs.alias("runs"), stuck.alias("stuck"))
    some = lambda r: F.filter("lengths", lambda n: n < F.length(r))
    ends = F.flatten(F.transform("stuck", lambda r: F.transform(some(r), lambda n: F.substring(r, F.length(r) - n + 1, n))))
    words = cut.select("folder", "pos", F.explode(F.array_distinct(F.concat("runs", ends))).alias("word"))
    met = words.join(names, ["folder", "word"]).drop("word").join(text, ["folder", "pos"])  # narrow until the texts come in, once each
    full_at, stem_re = F.instr(F.col("low"), F.col("full")), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("stem"), F.lit(r"\E(?!\w)"))
    stem_at = F.regexp_instr("low", stem_re)
    met = met.withColumn("how", F.when(full_at > 0, "name").when(stem_at > 0, "stem")).where("how IS NOT NULL")
    at = F.when(F.col("how") == "name", full_at).otherwise(stem_at) - 1
    size = F.when(F.col("how") == "name", F.length("full")).otherwise(F.length("stem"))
    best = Window.partitionBy("folder", "pos").orderBy(F.col("how").asc(), size.desc(), F.col("name"))
    hit = met.withColumn("n", F.row_number().over(best)).where("n = 1").select("folder", "pos", "name", "how", strip_reference(F.col("text"), at, at + size).alias("note"))
    return fragments.select("folder", "pos").join(hit, ["folder", "pos"], "left")


def root_report(listing: DataFrame) -> DataFrame:
    """Counters per folder with photos, per root (folder null) and in total (both null): folders and
    files discovered, folders with photos, photos, documents (a folder's only one), conflicts
    (several) and folders without any. Discovered ones count at their root."""
    key = ["root_id", "folder"]
    plans = plan_folders(listing).withColumns(
        {
            "discovered_folders": F.lit(0), "discovered_files": F.lit(0), "photo_folders": F.lit(1), "described": (F.col("documents") == 1).cast("int"),
            "conflicts": F.col("ambiguous").cast("int"), "without_description": (F.col("documents") == 0).cast("int"),
        }
    )
    seen = listing.groupBy("root_id").agg(F.count_if(F.col("is_directory")).alias("discovered_folders"), F.count_if(~F.col("is_directory")).alias("discovered_files"))
    counts = {n: F.col(n) for n in ("discovered_folders", "discovered_files", "photo_folders", "photos", "described", "conflicts", "without_description")}
    rows = plans.select(*key, *counts.values()).unionByName(seen.withColumn("folder", F.lit(None).cast("string")), allowMissingColumns=True)
    grouped = rows.groupingSets([[F.col("root_id"), F.col("folder")], [F.col("root_id")], []], "root_id", "folder").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in counts], F.grouping("folder").alias("__all")
    )
    return grouped.where("folder IS NOT NULL OR __all = 1").drop("__all")


def scan_report(reconciled: DataFrame, photos: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Counters of the documents' content per folder, and their total (folder null). The entries are built once."""
    reconciled = written(reconciled.select("folder", "photo", F.size(F.array_distinct("source_notes")).alias("notes")), "reconciled")
    per = reconciled.groupBy("folder").agg(
        F.count("*").alias("entries"),
        F.count("photo").alias("present"),
        F.count_if(F.col("photo").isNull()).alias("absent"),
        F.sum("notes").alias("notes"),
    )
    n_photos = photos.groupBy("folder").agg(F.count("*").alias("photos"))
    left = undescribed_photos(reconciled, photos).groupBy("folder").agg(F.count("*").alias("undescribed"))
    marks = section_dividers(paragraphs).groupBy("folder").agg(F.count("*").alias("dividers"))
    joined = n_photos.join(per, "folder", "full").join(left, "folder", "left").join(marks, "folder", "left")
    names = ("photos", "entries", "present", "absent", "notes", "undescribed", "dividers")
    return joined.rollup("folder").agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
