"""Text, name, path and hash expressions. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "heic", "heif", "webp", "bmp", "gif")
DOCUMENT_EXTENSION = "docx"
SECTION_PREFIX = "далее"
SOURCE_NOTE = "нет фото"
KINSHIP = (
    "мама", "мамы", "маме", "маму", "папа", "папы", "папе", "папу", "бабушка", "бабушки", "бабушке",
    "дедушка", "дедушки", "дедушке", "сестра", "брат", "тетя", "тётя", "дядя", "дочь", "сын", "внук", "внучка",
)
MAX_ALIAS_WORDS = 6


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)``, with ``c`` computed once however often ``f`` names it. A plain Python variable would be
    copied to each place, and copies of copies make expressions that no longer compile."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Unicode white space off both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return strip(blank_if_null(c)) == ""


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def filename_stem(c: Column) -> Column:
    """Before the last dot; the whole if there is none."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def identity_key(c: Column) -> Column:
    return F.lower(filename_stem(strip(c)))


def normalize_relative_path(c: Column) -> Column:
    return F.array_join(F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda s: s != ""), "/")


def join_relative_path(parent: Column, name: Column) -> Column:
    p, n = normalize_relative_path(parent), normalize_relative_path(name)
    return F.concat_ws("/", F.nullif(p, F.lit("")), F.nullif(n, F.lit("")))


def parent_path(c: Column) -> Column:
    return F.regexp_replace(normalize_relative_path(c), r"/?[^/]*$", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(normalize_relative_path(c), "/"), -1)


def sanitize_folder_name(c: Column) -> Column:
    safe = strip(F.translate(blank_if_null(c), "/\\\r\n\t", "--   "))
    safe = F.regexp_replace(safe, r"^\.+|\.+$", "")
    return F.coalesce(F.nullif(collapse(safe), F.lit("")), F.lit("source"))


def safe_name(c: Column) -> Column:
    return F.translate(c, '/\\:*?"<>|', "_________")


def destination_path(root_name: Column, relative_path: Column) -> Column:
    return join_relative_path(sanitize_folder_name(root_name), relative_path)


def folder_names(c: Column) -> Column:
    """The path's folders, outermost first."""
    return F.filter(F.split(parent_path(c), "/"), lambda s: s != "")


def scoped_row_key(root: Column, folder: Column, reference: Column) -> Column:
    return F.concat_ws("|", root, normalize_relative_path(folder), identity_key(reference))


def row_key(folder: Column, reference: Column) -> Column:
    return F.concat_ws("|", normalize_relative_path(folder), identity_key(reference))


def file_kind(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(extension.isin(*PHOTO_EXTENSIONS), "photo").when(extension == DOCUMENT_EXTENSION, "description").otherwise("other")


def source_identity(url: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(strip(url), "/+$", ""), 256), 1, 16)


def public_key_from_url(url: Column, prefixes: list[str]) -> Column:
    """The URL itself if it begins with a known share prefix, else null."""
    u = strip(url)
    known = F.lit(False)
    for p in prefixes:
        known = known | u.startswith(p)
    return F.when(known, u)


def fallback_root_name(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(strip(url), r"[?#].*$", ""), "/+$", "")
    return F.element_at(F.split(path, "/"), -1)


def split_fragments(c: Column) -> Column:
    """The non-empty lines, stripped."""
    return F.filter(F.transform(F.split(c, r"\R"), strip), lambda s: s != "")


def text_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *[strip(blank_if_null(p)) for p in parts]), 256)


def description_hash(c: Column) -> Column:
    return F.sha2(strip(F.regexp_replace(blank_if_null(c), r"\r\n?", "\n")), 256)


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def split_values(c: Column) -> Column:
    """``;``-separated cell to array, blanks dropped."""
    return F.filter(F.transform(F.split(blank_if_null(c), ";"), strip), lambda s: s != "")


def split_list_field(c: Column) -> Column:
    """People and tags are separated by ``;`` or ``,``."""
    return F.filter(F.transform(F.split(blank_if_null(c), "[;,]"), strip), lambda s: s != "")


def join_values(a: Column) -> Column:
    return F.array_join(F.filter(F.transform(a, lambda s: strip(blank_if_null(s))), lambda s: s != ""), "; ")


def normalize_phrase(c: Column) -> Column:
    return F.lower(collapse(c))


def leading_token(paragraph: Column) -> Column:
    token = F.regexp_replace(F.regexp_extract(strip(paragraph), r"(?U)^([A-Za-z0-9][A-Za-z0-9_.\-]*)(?=\s|$)", 1), "[.,;:]+$", "")
    return let(token, lambda t: F.nullif(t, F.lit("")))


def filename_like_reference(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z_]")


def is_section_divider(paragraph: Column) -> Column:
    return F.lower(strip(paragraph)).startswith(SECTION_PREFIX)


_NOTE = rf"(?iuU)\s*[-–—]?\s*({SOURCE_NOTE})\s*"


def source_notes(c: Column) -> Column:
    """Notes in order, repeats kept."""
    return F.transform(F.regexp_extract_all(c, F.lit(_NOTE), F.lit(1)), F.lower)


def without_source_notes(c: Column) -> Column:
    return strip(F.regexp_replace(c, _NOTE, " "))


#: What each known source note tells.
NOTE_KINDS = {SOURCE_NOTE: "SOURCE_STATE"}


def source_note_kind(note: Column) -> Column:
    """What a note tells: the source's condition or the photo (DESCRIPTIVE). Unknown text is
    never descriptive."""
    kinds = F.create_map(*[F.lit(x) for pair in NOTE_KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.lower(strip(note))), F.lit("SOURCE_STATE"))


def strip_edges(c: Column) -> Column:
    """Blanks, dashes, punctuation, brackets and quotes off both ends."""
    edge = r"""[ \t\-–—:;.,)\]}(\[{«»"'`]+"""
    return F.regexp_replace(c, f"^{edge}|{edge}$", "")


def strip_reference(fragment: Column, start: Column, end: Column) -> Column:
    """What follows the reference [start, end) (from 0), else what stands before it."""
    after = strip_edges(F.substring(fragment, end + 1, F.length(fragment)))
    before = strip_edges(F.substring(fragment, F.lit(1), start))
    return F.when(after != "", after).otherwise(before)


def candidate_chunks(c: Column) -> Column:
    """Sentence parts that could be a name: 3 characters or more, up to six words, no leading digit."""
    edge = r"[ \t,;:\-–—()]+"
    parts = F.transform(F.split(F.translate(c, "!?", ".."), r"\."), lambda p: F.regexp_replace(p, f"^{edge}|{edge}$", ""))
    return F.filter(
        parts,
        lambda p: (F.length(p) >= 3) & (strip(p) != "") & (F.size(F.split(collapse(p), " ")) <= MAX_ALIAS_WORDS) & ~strip(p).rlike("^[0-9]"),
    )


def is_context_dependent(phrase: Column) -> Column:
    words = F.transform(F.split(collapse(phrase), " "), lambda w: F.lower(F.regexp_replace(w, r"^[ .,;:()]+|[ .,;:()]+$", "")))
    return F.arrays_overlap(words, F.array(*[F.lit(k) for k in KINSHIP]))


def format_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(strip(c))


def describe_provenance(at: Column, machine: Column, run: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(format_timestamp(at), F.lit("unknown time")), F.concat(F.lit("on "), F.nullif(machine, F.lit(""))), F.concat(F.lit("run "), F.nullif(run, F.lit(""))))
