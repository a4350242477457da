"""Field-aware comparison, build fingerprints, coverage and review predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.geo import format_latlon, parse_latlon
from curatrix.functions.text import blank_if_null, collapse, is_blank, source_note_kind, split_list_field, split_values, strip

#: How each human field is compared; others are text.
KIND_OF_FIELD = {
    "date": "TEXT", "place": "TEXT", "canonical_name": "TEXT", "canonical_place": "TEXT", "canonical_tag": "TEXT", "event": "TEXT", "map_link": "TEXT",
    "latlon": "LATLON", "candidate_latlon": "LATLON_SET", "people": "LIST", "tags": "LIST", "albums": "LIST",
    "confirmed_aliases": "ALIAS_SET", "candidate_aliases": "ALIAS_SET", "rejected_aliases": "ALIAS_SET",
    "description": "PROSE", "notes": "PROSE", "status": "OPAQUE",
}
#: Fields in order.
REVIEW_FIELDS = ("date", "place", "latlon", "people", "tags", "event", "albums", "description", "status", "notes")
BUILD_FIELDS = ("date", "place", "latlon", "people", "tags", "description", "event", "albums")
TRACKED_FIELDS = ("date", "place", "latlon", "people", "tags")
AUTOFILL_PAIRS = (
    ("date", "suggested_date"), ("place", "suggested_place"), ("latlon", "suggested_latlon"),
    ("people", "suggested_people"), ("tags", "suggested_tags"), ("description", "source_description"),
)
SEARCH_FIELDS = (
    "reference", "filename", "source_description", "section_context", "source_notes", "date", "place",
    "people", "tags", "event", "albums", "description", "notes", "suggested_place",
)
_SEP = "\u001f"


def _latlon_text(c: Column) -> Column:
    return F.coalesce(format_latlon(parse_latlon(c)), collapse(blank_if_null(c)))


def _set(a: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(a)), _SEP)


def normalize_for_comparison(field: Column, value: Column) -> Column:
    """One comparable string per value; what kind of comparison follows from the field."""
    kinds = F.create_map(*[x for k, v in KIND_OF_FIELD.items() for x in (F.lit(k), F.lit(v))])
    kind, text = F.coalesce(F.try_element_at(kinds, field), F.lit("TEXT")), blank_if_null(value)
    return (
        F.when(kind == "PROSE", strip(F.regexp_replace(text, r"\r\n?", "\n")))
        .when(kind == "LIST", _set(F.transform(split_list_field(text), F.lower)))
        .when(kind == "ALIAS_SET", _set(split_values(text)))
        .when(kind == "LATLON", _latlon_text(text))
        .when(kind == "LATLON_SET", _set(F.transform(split_values(text), _latlon_text)))
        .when(kind == "OPAQUE", strip(text))
        .otherwise(collapse(text))
    )


def semantic_equal(field: Column, a: Column, b: Column) -> Column:
    return normalize_for_comparison(field, a) == normalize_for_comparison(field, b)


def build_metadata(row: dict[str, Column]) -> Column:
    """The eight build fields, normalised, joined in name order."""
    parts = []
    for name in sorted(BUILD_FIELDS):
        text = blank_if_null(row[name])
        value = F.array_join(F.array_sort(F.transform(split_list_field(text), F.lower)), ";") if KIND_OF_FIELD[name] == "LIST" else collapse(text)
        parts.append(F.concat(F.lit(f"{name}="), value))
    return F.concat_ws(_SEP, *parts)


def build_fingerprint(row: dict[str, Column], source_hash: Column, build_version: int = 1, date_policy: int = 1) -> Column:
    payload = F.concat_ws(_SEP, blank_if_null(source_hash), build_metadata(row), F.lit(f"build={build_version}"), F.lit(f"dates={date_policy}"))
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def needs_rebuild(recorded: Column, fingerprint: Column) -> Column:
    return F.when(blank_if_null(recorded) == "", True).otherwise(recorded != fingerprint)


def needs_review(row: dict[str, Column]) -> Column:
    missing = F.lit(False)
    for name in TRACKED_FIELDS:
        missing = missing | is_blank(row[name])
    return ~is_blank(row["review_reason"]) | row["status"].isin("REVIEW", "SOURCE_CHANGED") | missing


def has_descriptive_content(text: Column, notes: Column | None = None) -> Column:
    """Text counts, and of the source notes those that tell of the photo; none known so far does."""
    if notes is None:
        return ~is_blank(text)
    return ~is_blank(text) | F.exists(split_values(blank_if_null(notes)), lambda n: source_note_kind(n) == "DESCRIPTIVE")


def classify_coverage(folder_status: Column, entry_exists: Column, text: Column, context: Column, notes: Column | None = None) -> Column:
    """Null outside a FOUND folder."""
    value = (
        F.when(~F.coalesce(entry_exists, F.lit(False)), "NO_ENTRY")
        .when(has_descriptive_content(text, notes), "DESCRIBED")
        .when(~is_blank(context), "CONTEXT_ONLY")
        .otherwise("ENTRY_EMPTY")
    )
    return F.when(folder_status == "FOUND", value)


def is_stale_source_text(entry_exists: Column, text: Column, context: Column, notes: Column) -> Column:
    return ~F.coalesce(entry_exists, F.lit(False)) & (~is_blank(text) | ~is_blank(context) | ~is_blank(notes))


def card_flags(row: dict[str, Column]) -> dict[str, Column]:
    return {
        "needsreview": needs_review(row),
        "nopeople": is_blank(row["people"]),
        "noplace": is_blank(row["place"]),
        "nolatlon": is_blank(row["latlon"]),
        "notags": is_blank(row["tags"]),
        "absent": row["status"] == "DESCRIBED_ABSENT",
    }


def search_text(row: dict[str, Column]) -> Column:
    return F.lower(F.concat_ws(" ", *[blank_if_null(row[n]) if n in row else F.lit("") for n in SEARCH_FIELDS]))


def destination_links(photos_url: Column, drive_url: Column, yandex_url: Column, yandex_is_folder: Column) -> Column:
    """Links that exist, best first; the first is primary."""
    label = F.when(yandex_is_folder, "Source folder in Yandex Disk").otherwise("Source photo in Yandex Disk")
    link = lambda kind, text, url: F.struct(F.lit(kind).alias("kind"), text.alias("label"), url.alias("url"))
    every = F.array(
        link("photos", F.lit("Open in Google Photos"), photos_url), link("drive", F.lit("Open in Google Drive"), drive_url), link("yandex", label, yandex_url)
    )
    there = F.filter(every, lambda x: blank_if_null(x["url"]) != "")
    return F.transform(there, lambda x, i: F.struct(x["kind"].alias("kind"), x["label"].alias("label"), x["url"].alias("url"), (i == 0).alias("primary")))


def primary_link(links: Column) -> Column:
    return F.try_element_at(links, F.lit(1))


def source_note_text(description: Column, context: Column, notes: Column) -> Column:
    """Description, section and notes as paragraphs, blank ones left out."""
    some = lambda c: F.nullif(strip(blank_if_null(c)), F.lit(""))
    return F.concat_ws("\n\n", some(description), F.concat(F.lit("Раздел: "), some(context)), F.concat(F.lit("Пометки: "), some(notes)))


def fill_blank_finals(row: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Finals with blanks filled from suggestions, and the names of those filled."""
    finals, names = {}, []
    for final, suggestion in AUTOFILL_PAIRS:
        fill = is_blank(row[final]) & ~is_blank(row[suggestion])
        finals[final] = F.when(fill, strip(row[suggestion])).otherwise(blank_if_null(row[final]))
        names.append(F.when(fill, F.lit(final)))
    return finals, F.filter(F.array(*names), lambda n: n.isNotNull())


def decision_flags(action: Column) -> dict[str, Column]:
    return {
        "is_conflict": action.isin("conflict", "first_sync_conflict"),
        "changes_content": ~action.isin("noop", "conflict", "first_sync_conflict", "adopt_baseline"),
    }
