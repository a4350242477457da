"""Operators on hand-made rows: shapes, rules one by one, idempotency, brute force."""

import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from curatrix.functions import dates, geo, semantic, text
from curatrix.operators import catalog_io, dictionary, documents, learning, listing, merge, portable, reports, review, similarity

C = F.col


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(C("v")).alias("r")).first().r


# --- scalars


@pytest.mark.parametrize("raw", ["1979", "1979-05", "1979-05-17", "1979-05-17 14:30", "1979-05-17 14:30:45", " 1979 "])
def test_dates_accepted(spark, raw):
    want = raw.strip() + (":00" if len(raw) == 16 else "")
    assert one(spark, raw, lambda c: dates.archive_date_text(dates.parse_archive_date(c))) == want


@pytest.mark.parametrize("raw", ["", " ", None, "05/06/79", "1979/05/17", "79-05-17", "1979-5-17", "1979-13", "1979-02-30", "1979-05-17 25:00", "1979-05-17 14:60", "1979-05-17 14:30:60", "0000"])
def test_dates_rejected(spark, raw):
    assert one(spark, raw, dates.parse_archive_date) is None


def test_timestamps_and_properties(spark):
    stamp = lambda c: dates.exif_text(dates.compat_timestamp(dates.parse_archive_date(c)))
    assert [one(spark, d, stamp) for d in ("1979", "1979-02", "1979-02-03", "1979-02-03 04:05")] == ["1979:07:01 12:00:00", "1979:02:15 12:00:00", "1979:02:03 12:00:00", "1979:02:03 04:05:00"]
    fields = one(spark, "1979-02-03 04:05", lambda c: dates.xmp_fields(dates.parse_archive_date(c)))
    assert fields[dates.XMP_SYNTHETIC] == "False" and fields[dates.XMP_DATE] == "1979-02-03 04:05:00"
    season = F.struct(F.lit(1979).alias("year"), *[F.lit(None).cast("int").alias(n) for n in ("month", "day", "hour", "minute", "second")], F.lit("SEASON").alias("precision"))
    got = one(spark, "x", lambda c: F.struct(dates.xmp_fields(season).alias("f"), dates.standard_date_created(season).alias("s"), dates.compat_timestamp(season).alias("t")))
    assert (set(got.f), got.f[dates.XMP_DATE], got.s, got.t) == ({dates.XMP_DATE, dates.XMP_PRECISION}, "1979", None, None)


@pytest.mark.parametrize(
    "raw, want",
    [("1979.", "1979"), ("1980 июнь. Валаам", "1980-06"), ("1979 февраль 19.", "1979-02-19"), ("1979 Мая 31", "1979-05-31"), ("1979 в мае", "1979"), ("в 1979г", ""), ("нет", ""), ("1979 февраль 31", "1979-02-31"), ("1979 май 99", "1979-05"), (None, "")],
)
def test_suggest_date(spark, raw, want):
    assert one(spark, raw, dates.suggest_date) == want


@pytest.mark.parametrize(
    "raw, want",
    [("  -55.5 ,  +37.25 ", "-55.500000, 37.250000"), ("", None), ("55.7", None), ("55.7; 37.6", None), ("1,2,3", None), ("95.0, 37.6", None), ("55.7, 200.0", None), (None, None)],
)
def test_latlon(spark, raw, want):
    assert one(spark, raw, lambda c: geo.format_latlon(geo.parse_latlon(c))) == want


@pytest.mark.parametrize("end", ["?api=1&query=55.712345%2C37.623456", "?query=55.712345, 37.623456", "?q=55.712345,37.623456", "?ll=55.712345,37.623456", "/@55.712345,37.623456,15z", "/data=!3d55.712345!4d37.623456"])
def test_map_links(spark, end):
    assert one(spark, f"https://www.google.com/maps{end}", lambda c: geo.format_latlon(geo.parse_map_link(c))) == "55.712345, 37.623456"
    assert one(spark, "https://www.google.com/maps/place/x", geo.parse_map_link) is None


def test_names_and_paths(spark):
    assert [one(spark, n, text.filename_stem) for n in ("a.b.jpg", "a", ".jpg")] == ["a.b", "a", ""]
    assert one(spark, "  IMG_1.JPG ", text.identity_key) == "img_1"
    assert one(spark, "\\a//b/c/", text.normalize_relative_path) == "a/b/c"
    assert [one(spark, n, text.sanitize_folder_name) for n in (" a/b\\c\n d. ", "...", None)] == ["a-b-c d", "source", "source"]
    assert [one(spark, n, text.file_kind) for n in ("a.JPG", "b.docx", "c.doc", "jpg")] == ["photo", "description", "other", "other"]
    assert one(spark, "x", lambda c: text.join_relative_path(F.lit(""), c)) == "x"
    assert one(spark, "Тоня Мамаева, Настя; ", text.split_list_field) == ["Тоня Мамаева", "Настя"]
    assert one(spark, "Тоня Мамаева. 1979 май. У кого-то в гостях! ab", text.candidate_chunks) == ["Тоня Мамаева", "У кого-то в гостях"]
    assert one(spark, "наша бабушка.", text.is_context_dependent) is True
    assert one(spark, "Тоня - нет фото и Нет Фото", lambda c: F.struct(text.source_notes(c).alias("n"), text.without_source_notes(c).alias("t")))[:] == (["нет фото", "нет фото"], "Тоня и")


def test_semantic_equality(spark):
    eq = lambda f, a, b: one(spark, "x", lambda c: semantic.semantic_equal(F.lit(f), F.lit(a), F.lit(b)))
    assert eq("people", "Аня, тоня", "Тоня; аня") and eq("place", " a  b", "a b\n") and eq("latlon", "1,2", "1.0 ,  2.0") and eq("notes", "a\r\nb", "a\nb ")
    assert eq("date", None, "") and eq("candidate_latlon", "1,2; x", "x;1.0,2.0")
    assert not eq("date", "1979", "1979-05") and not eq("confirmed_aliases", "Аня", "аня") and not eq("latlon", "north", "south") and not eq("status", "new", "NEW")


def test_dhash_and_distance(spark):
    rng = random.Random(1)
    grid = [rng.randrange(256) for _ in range(72)]
    bits = "".join("1" if grid[r * 9 + c] > grid[r * 9 + c + 1] else "0" for r in range(8) for c in range(8))
    assert one(spark, grid, similarity.dhash, "array<int>") == f"{int(bits, 2):016x}"
    assert one(spark, grid[:71], similarity.dhash, "array<int>") is None
    assert one(spark, "ffffffffffffffff", lambda c: similarity.hamming(similarity.bits_of(c), similarity.bits_of(F.lit("0000000000000001")))) == 63


@pytest.mark.parametrize("most", [3, 7, 11])
def test_near_pairs_are_exact(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = [(f"p{i:03d}", f"{rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))):016x}") for i in range(150)]
    least = {}
    for p, h in prints:
        least[h] = min(p, least.get(h, p))
    items = sorted((p, int(h, 16)) for h, p in least.items())
    want = sorted((a, b, (x ^ y).bit_count()) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :] if (x ^ y).bit_count() <= most)
    got = similarity.near_pairs(spark.createDataFrame(prints, "photo_id string, image_fingerprint string"), most)
    assert sorted(map(tuple, got.collect())) == want


def test_near_pairs_and_ranks_of_all_pictures(spark, small):
    from curatrix.plans.fixtures import view
    from curatrix.plans.queries import QUERIES

    least = {}
    prints = view(spark, small, "fx_fingerprints").collect()
    assert len(prints) == spark.read.parquet(f"{small}/orders.parquet").count()
    for r in prints:
        least[r.image_fingerprint] = min(r.photo_id, least.get(r.image_fingerprint, r.photo_id))
    items = sorted((p, int(h, 16)) for h, p in least.items())
    want = {(a, b, n) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :] if (n := (x ^ y).bit_count()) <= 7}
    assert set(map(tuple, QUERIES["near_pairs"](spark, small).collect())) == want
    near = {}
    for a, b, n in want:
        near.setdefault(a, []).append((n, b))
        near.setdefault(b, []).append((n, a))
    ranks = {(a, b, n, k) for a, others in near.items() for k, (n, b) in enumerate(sorted(others)[:5], 1)}
    assert {(r.a, r.b, r.distance, r["rank"]) for r in QUERIES["rank_similar"](spark, small).collect()} == ranks


# --- listings


def items(spark, rows):
    return spark.createDataFrame(rows, "root_id string, relative_path string, is_directory boolean, size long, modified_at timestamp, content_hash string")


def test_diff_and_apply_are_idempotent(spark):
    a = items(spark, [("r", "a.jpg", False, 1, None, "h1"), ("r", "b.jpg", False, 1, None, None), ("r", "c.jpg", False, 1, None, "h"), ("r", "d.jpg", False, 1, None, "h"), ("r", "", True, None, None, None)])
    b = items(spark, [("r", "a.jpg", False, 9, None, "h1"), ("r", "b.jpg", False, 2, None, None), ("r", "c.jpg", False, 1, None, None), ("r", "e.jpg", False, 1, None, "h")])
    got = {r.relative_path: r.change for r in listing.diff_listing(a, b).collect()}
    assert got == {"a.jpg": "unchanged", "b.jpg": "changed", "c.jpg": "changed", "d.jpg": "missing", "e.jpg": "new"}
    t = [F.lit(f"2024-01-0{d}").cast("timestamp") for d in (1, 2, 3)]
    empty = a.limit(0).withColumns({n: F.lit(None).cast("timestamp") for n in ("first_seen", "last_seen", "missing_since")})
    s1 = listing.apply_listing(empty, a, t[0])
    s2 = listing.apply_listing(s1, b, t[1])
    s3 = {r.relative_path: r for r in listing.apply_listing(s2, a, t[2]).collect()}
    assert s3["d.jpg"].missing_since is None and s3["d.jpg"].first_seen.day == 1 and s3["e.jpg"].missing_since.day == 3 and s3["e.jpg"].last_seen.day == 2
    assert listing.diff_listing(s2.where("missing_since IS NULL"), b).where("change <> 'unchanged'").count() == 0
    again = listing.apply_listing(s2, b, t[1])
    assert again.exceptAll(s2).count() == 0


def test_order_listing(spark):
    d = items(spark, [("r", p, k, 1, None, None) for p, k in (("b.jpg", False), ("z", True), ("z/a.jpg", False), ("a", True), ("a/b", True), ("a/b/x.jpg", False), ("a/a.jpg", False))])
    assert [r.relative_path for r in listing.order_listing(d).collect()] == ["a", "a/b", "a/b/x.jpg", "a/a.jpg", "z", "z/a.jpg", "b.jpg"]
    with pytest.raises(Exception, match="too deep"):
        listing.order_listing(items(spark, [("r", "/".join("x" * 70), False, 1, None, None)])).collect()


def test_upsert_root_and_machine(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    old = spark.createDataFrame([("i", "u", "n", "d", None, None)], "identity string, source_url string, name string, destination_name string, first_seen timestamp, last_scan timestamp").withColumn("first_seen", F.lit("2023-01-01").cast("timestamp"))
    new = spark.createDataFrame([("i", "u2", "n2", "d2"), ("j", "u", "n", "d")], "identity string, source_url string, name string, destination_name string")
    got = {r.identity: r for r in listing.upsert_source_root(old, new, now).collect()}
    assert got["i"].name == "n2" and got["i"].first_seen.year == 2023 and got["j"].first_seen.year == 2024
    m = spark.createDataFrame([("m", "label")], "machine_id string, label string").withColumns({"first_seen": F.lit("2023-01-01").cast("timestamp"), "last_seen": F.lit("2023-01-01").cast("timestamp")})
    r = portable.record_machine(m, spark.createDataFrame([("m", "")], "machine_id string, label string"), now).first()
    assert (r.label, r.first_seen.year, r.last_seen.year) == ("label", 2023, 2024)


def test_moved_and_orphans(spark):
    m = spark.createDataFrame([("a", "x/1.jpg", "id1", "h1"), ("a", "x/2.jpg", None, "h2"), ("a", "x/3.jpg", None, None), ("a", "x/4.jpg", "id4", None)], "root_id string, relative_path string, remote_id string, content_hash string")
    n = spark.createDataFrame([("b", "y/9.jpg", "id1", "h9"), ("b", "y/8.jpg", None, "h2"), ("b", "y/3.jpg", None, None), ("b", "y/1.jpg", None, None)], "root_id string, relative_path string, remote_id string, content_hash string")
    got = {r.from_path: (r.to_path, r.signal) for r in listing.find_moved(m, n).collect()}
    assert got == {"a/x/1.jpg": ("b/y/9.jpg", "remote_id"), "a/x/2.jpg": ("b/y/8.jpg", "content_hash"), "a/x/3.jpg": ("b/y/3.jpg", "file_name")}
    assert [tuple(r) for r in listing.moved_folders(listing.find_moved(m, n)).collect()] == [("a/x", "b/y", 3)]
    rows = spark.createDataFrame([("r", "A", "IMG_1", "DESCRIBED_ABSENT"), ("r", "A", "IMG_2", "NEW")], "root string, folder string, reference string, status string")
    files = spark.createDataFrame([("B", "img_1.jpg"), ("B", "img_2.jpg")], "folder string, name string")
    assert [r.found_name for r in listing.orphan_descriptions(rows, files).collect()] == ["img_1.jpg"]


def test_orphans_list_every_file_of_the_stem(spark):
    rows = spark.createDataFrame([("r", "A", "IMG_1", "DESCRIBED_ABSENT"), ("r", "B", "IMG_1", "DESCRIBED_ABSENT"), ("r", "A", "IMG_2", "NEW")], "root string, folder string, reference string, status string")
    files = spark.createDataFrame([("B", "img_1.jpg"), ("B", "IMG_1.png"), ("C/x", "img_1.jpg"), ("A", "img_2.jpg"), ("C", "img_2.jpg")], "folder string, name string")
    got = sorted(tuple(r) for r in listing.orphan_descriptions(rows, files).collect())
    lost = lambda folder, *found: ("r", folder, "IMG_1", "img_1", *found)
    assert got == sorted([lost("A", "B", "img_1.jpg"), lost("A", "B", "IMG_1.png"), lost("A", "C/x", "img_1.jpg"), lost("B", "C/x", "img_1.jpg")])


def test_moves_are_one_to_one_and_whole(spark):
    """Many empty files of one hash, equal names in many folders: every pairable file is paired once."""
    gone = [("a", f"d{i % 9}/{i % 40:03d}.jpg" if i % 2 else f"d{i % 9}/x{i}.jpg", None, "empty" if i % 3 == 0 else f"h{i}") for i in range(300)]
    gone = list({g[:2]: g for g in gone}.values())
    here = [("b", f"e{i % 9}/{i % 40:03d}.jpg" if i % 2 else f"e{i % 9}/x{i}.jpg", None, "empty" if i % 4 == 0 else f"h{i}" if i % 5 else None) for i in range(250)]
    here = list({h[:2]: h for h in here}.values())
    schema = "root_id string, relative_path string, remote_id string, content_hash string"
    got = listing.find_moved(spark.createDataFrame(gone, schema), spark.createDataFrame(here, schema)).collect()
    assert len({r.to_path for r in got}) == len(got) == len({r.from_path for r in got})
    name = lambda p: p.split("/")[-1]
    strong = [r for r in got if r.signal == "content_hash"]
    count = lambda rows, v: sum(r[3] == v for r in rows)
    assert len(strong) == sum(min(count(gone, v), count(here, v)) for v in {r[3] for r in gone} - {None})
    left = [r[0] + "/" + r[1] for r in gone if r[0] + "/" + r[1] not in {s.from_path for s in strong}]
    open_ = [r[0] + "/" + r[1] for r in here if r[0] + "/" + r[1] not in {s.to_path for s in strong}]
    names = {name(p) for p in left}
    assert len(got) - len(strong) == sum(min([name(p) for p in left].count(n), [name(p) for p in open_].count(n)) for n in names)
    assert all(name(r.from_path) == name(r.to_path) for r in got if r.signal == "file_name")


def test_weak_names_follow_their_folder(spark):
    schema = "root_id string, relative_path string, remote_id string, content_hash string"
    gone = [("a", "trip/1.jpg", None, "h1"), ("a", "trip/2.jpg", None, "h2"), ("a", "trip/000.jpg", None, None), ("a", "home/000.jpg", None, None), ("a", "home/9.jpg", None, "h9")]
    here = [("b", "Z/1.jpg", None, "h1"), ("b", "Z/2.jpg", None, "h2"), ("b", "Z/000.jpg", None, None), ("b", "A/000.jpg", None, None), ("b", "A/9.jpg", None, "h9")]
    got = {r.from_path: r.to_path for r in listing.find_moved(spark.createDataFrame(gone, schema), spark.createDataFrame(here, schema)).collect()}
    assert got["a/trip/000.jpg"] == "b/Z/000.jpg" and got["a/home/000.jpg"] == "b/A/000.jpg"
    assert listing.find_moved(spark.createDataFrame([], schema), spark.createDataFrame(here, schema)).count() == 0


def test_hot_keys_move_as_others_do(spark):
    """Lists of a key's files and ranks of a hot key's files give the same pairs."""
    schema = "root_id string, relative_path string, remote_id string, content_hash string"
    gone = spark.createDataFrame([("a", f"d{i % 3}/{i:03d}.jpg", None, "empty" if i % 2 else None) for i in range(60)], schema)
    here = spark.createDataFrame([("b", f"e{i % 4}/{i:03d}.jpg", None, "empty" if i % 3 else f"h{i}") for i in range(50)], schema)
    want, got = ({tuple(r) for r in listing.find_moved(gone, here, hot).collect()} for hot in (1_000, 10))
    assert got == want and len(want) >= 39


# --- documents


def paragraphs(spark, *texts):
    return spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "folder string, pos int, text string")


def photos(spark, *names):
    return spark.createDataFrame([("f", n) for n in names], "folder string, name string")


def entries(spark, ps, names):
    return [(r.reference, r.text, r.section_context, r.source_notes) for r in documents.group_entries(paragraphs(spark, *ps), photos(spark, *names)).orderBy("entry_seq").collect()]


def test_entries_carry_text_forward_and_keep_sections(spark):
    got = entries(spark, ["Вступление", "018 - Первый", "продолжение - нет фото", "Далее Аня", "lost", "019.jpg - Второй", " ", "1979 год", "- нет фото"], ["018.jpg", "019.jpg"])
    assert got == [("018", "Первый продолжение", None, ["нет фото"]), ("019.jpg", "Второй 1979 год", "Далее Аня", ["нет фото"])]


def test_bare_numbers_are_references_by_style(spark):
    assert [e[0] for e in entries(spark, ["020 a", "1979 b", "IMG_0042 c"], ["018.jpg"])] == ["020", "IMG_0042"]
    assert [e[0] for e in entries(spark, ["020.jpg a", "021 b"], [])] == ["020.jpg", "021"]
    assert entries(spark, ["020 a", "1979 b"], []) == []


def test_reconcile_first_photo_wins(spark):
    p, n = paragraphs(spark, "IMG_1.jpg a", "IMG_2 b", "IMG_9 c"), photos(spark, "IMG_1.jpg", "IMG_2.png", "IMG_2.jpg", "IMG_5.jpg")
    rec = documents.reconcile_entries(documents.group_entries(p, n), n)
    assert {r.reference: r.photo for r in rec.collect()} == {"IMG_1.jpg": "IMG_1.jpg", "IMG_2": "IMG_2.jpg", "IMG_9": None}
    assert sorted(r.name for r in documents.undescribed_photos(rec, n).collect()) == ["IMG_2.png", "IMG_5.jpg"]


def test_match_fragments(spark):
    ps = paragraphs(spark, "Tonya and Anya (022.jpg)", "x022.jpg stuck", "see 022 there", "see 0221", "a 22 b", "both a-b.jpg and b.jpg", "nothing")
    got = {r.pos: (r.name, r.how) for r in documents.match_fragments(ps, photos(spark, "022.jpg", "22.jpg", "b.jpg", "a-b.jpg")).collect()}
    assert got == {0: ("022.jpg", "name"), 1: ("022.jpg", "name"), 2: ("022.jpg", "stem"), 3: (None, None), 4: ("22.jpg", "stem"), 5: ("a-b.jpg", "name"), 6: (None, None)}


# --- dictionary


def brute_matches(text_, phrases):
    low, claimed, out = text_.lower(), [], []
    for canonical, phrase, status in sorted(phrases, key=lambda p: (-len(p[1]), p[1], p[0])):
        if status == "REJECTED":
            continue
        needle = phrase.lower().strip()
        at = low.find(needle)
        while at >= 0:
            end = at + len(needle)
            edge = not re.match(r"\w", low[at - 1 : at]) and not re.match(r"\w", low[end : end + 1])
            if edge and not any(at < e and end > s for s, e in claimed):
                claimed.append((at, end))
                out.append((canonical, at, end, text_[at:end]))
            at = low.find(needle, at + 1)
    return sorted(out)


def test_find_matches_against_brute_force(spark):
    rng = random.Random(4)
    words = ["Тоня", "Аня", "ан", "Мамаева", "сад", "(сад", "St.", "a-b", "b", "a"]
    phrases = sorted({(f"E{rng.randrange(6)}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), rng.choice(["CONFIRMED", "CANDIDATE", "REJECTED"])) for _ in range(40)})
    texts = [(f"t{i}", " ".join(rng.choice([*words, "x", ",", "Тоня,"]) for _ in range(12))) for i in range(120)]
    df = spark.createDataFrame([("person", *p) for p in phrases], "entity_type string, canonical string, phrase string, status string")
    found = dictionary.find_matches(spark.createDataFrame(texts, "text_id string, text string"), df).collect()
    for i, t in texts:
        assert sorted((r.canonical, r.start, r.end, r.matched_text) for r in found if r.text_id == i) == brute_matches(t, phrases)


def test_suggest_needs_one_place(spark):
    ph = spark.createDataFrame(
        [("place", "Сад", "сад", "CONFIRMED"), ("place", "Дом", "дом", "CONFIRMED"), ("person", "Аня", "аня", "CONFIRMED"), ("person", "Тоня", "тоня", "CANDIDATE"), ("tag", "лето", "лето", "CONFIRMED")],
        "entity_type string, canonical string, phrase string, status string",
    )
    e = spark.createDataFrame([("1", "1979 май. Аня, лето, сад", None), ("2", "сад и дом, Тоня", "Далее Аня")], "entry_id string, text string, section_context string")
    places = spark.createDataFrame([("Сад", "1.000000, 2.000000")], "canonical string, latlon string")
    got = {r.entry_id: r for r in dictionary.suggest(e, ph, places).collect()}
    assert (got["1"].date, got["1"].place, got["1"].latlon, got["1"].people, got["1"].tags) == ("1979-05", "Сад", "1.000000, 2.000000", "Аня", "лето")
    assert (got["2"].place, got["2"].ambiguous_places, got["2"].people, got["2"].candidates) == ("", "Сад; Дом", "Аня", 1)


def test_alias_lattice(spark):
    al = lambda rows: spark.createDataFrame([("tag", "e", a, s) for a, s in rows], "entity_type string, entity_id string, alias string, status string")
    asked = al([("a", "CANDIDATE"), ("b", "CONFIRMED"), ("c", "CONFIRMED"), ("d", "CONFIRMED"), ("d", "CANDIDATE")])
    got = dictionary.upsert_alias(al([("a", "CONFIRMED"), ("b", "CANDIDATE"), ("c", "REJECTED")]), asked)
    assert {r.alias: (r.status, r.changed) for r in got.collect()} == {"a": ("CONFIRMED", False), "b": ("CONFIRMED", True), "c": ("REJECTED", False), "d": ("CONFIRMED", True)}
    assert dictionary.upsert_alias(got.drop("changed"), asked).where("changed").count() == 0


def test_merge_entities_follows_chains_and_cycles(spark):
    pairs = spark.createDataFrame([("tag", "a", "b"), ("tag", "b", "c"), ("tag", "c", "d"), ("tag", "x", "y"), ("tag", "y", "x")], "entity_type string, survivor string, absorbed string")
    assert {r.absorbed: r.survivor for r in dictionary.survivors(pairs).collect()} == {"b": "a", "c": "a", "d": "a", "y": "x"}
    ents = spark.createDataFrame([("tag", i, f"name {i}", "") for i in "abcdxy"], "entity_type string, entity_id string, canonical string, latlon string")
    als = spark.createDataFrame([("tag", "d", "dd", "CANDIDATE"), ("tag", "a", "name b", "CANDIDATE")], "entity_type string, entity_id string, alias string, status string")
    ev = spark.createDataFrame([("tag", "c", "r")], "entity_type string, entity_id string, reason string")
    out = dictionary.merge_entities(pairs, ents, als, ev)
    assert sorted(r.entity_id for r in out["entities"].collect()) == ["a", "x"]
    assert sorted((r.entity_id, r.alias, r.status) for r in out["aliases"].collect()) == [("a", "dd", "CANDIDATE"), ("a", "name b", "CANDIDATE"), ("a", "name c", "CONFIRMED"), ("a", "name d", "CONFIRMED"), ("x", "name y", "CONFIRMED")]
    assert out["evidence"].first().entity_id == "a"


def test_merge_cycles_types_and_unknown_entities(spark):
    pairs = [("tag", "a", "b"), ("tag", "b", "c"), ("tag", "c", "a"), ("tag", "b", "z"), ("place", "a", "z"), *[("tag", f"n{i:02}", f"n{(i + 1) % 9:02}") for i in range(9)]]
    df = spark.createDataFrame(pairs, "entity_type string, survivor string, absorbed string")
    got = {(r.entity_type, r.absorbed): r.survivor for r in dictionary.survivors(df).collect()}
    want = {("tag", "b"): "a", ("tag", "c"): "a", ("tag", "z"): "a", ("place", "z"): "a"} | {("tag", f"n{i:02}"): "n00" for i in range(1, 9)}
    assert got == want
    assert dictionary.survivors(df.limit(0)).count() == 0
    ents = spark.createDataFrame([("tag", i, i, "") for i in "bcz"] + [("place", "z", "z", "")], "entity_type string, entity_id string, canonical string, latlon string")
    als = spark.createDataFrame([("tag", "z", "zz", "CONFIRMED")], "entity_type string, entity_id string, alias string, status string")
    out = dictionary.merge_entities(df, ents, als, als.select("entity_type", "entity_id"))
    assert sorted(tuple(r)[:2] for r in out["entities"].collect()) == [("place", "z"), ("tag", "b")]


def test_last_write_and_last_decision_win(spark):
    schema = "root string, folder string, identity string, status string"
    states = spark.createDataFrame([("r", "f", "1", "OLD"), ("r", "f", "2", "OLD")], schema)
    new = spark.createDataFrame([("r", "f", "1", "A", 1), ("r", "f", "1", "B", 2), ("r", "f", "3", "C", 1)], schema + ", ord int")
    assert sorted(tuple(r)[2:] for r in review.upsert_row_states(states, new).collect()) == [("1", "B"), ("2", "OLD"), ("3", "C")]
    als = spark.createDataFrame([("tag", "1", "a", "CANDIDATE")], "entity_type string, entity_id string, alias string, status string")
    said = spark.createDataFrame([("tag", "1", "a", "REJECTED", 1), ("tag", "1", "a", "CONFIRMED", 2)], "entity_type string, entity_id string, alias string, status string, ord int")
    assert [r.status for r in dictionary.set_alias_status(als, said).collect()] == ["CONFIRMED"]
    assert [r.status for r in dictionary.set_alias_status(als, said.drop("ord")).collect()] == ["REJECTED"]


def test_restore_keeps_evidence_that_differs_in_one_column(spark):
    key = dictionary.EVIDENCE_KEY
    base = dict.fromkeys(key, "x")
    rows = [base, *[base | {c: "y"} for c in key], base | {"latlon": None}]
    ev = spark.createDataFrame([tuple(r[c] for c in key) for r in rows], ", ".join(f"{c} string" for c in key))
    ll = spark.createDataFrame([("1", "1.0, 2.0"), ("1", "3.0, 4.0")], "entity_id string, latlon string")
    have = {"evidence": ev.limit(1), "latlons": ll.limit(1)}
    first = portable.bootstrap({"evidence": ev, "latlons": ll}, have)
    assert (first["evidence"].count(), first["latlons"].count()) == (len(key) + 2, 2)
    assert portable.bootstrap({"evidence": ev, "latlons": ll}, first)["evidence"].count() == len(key) + 2


def test_source_note_kinds(spark):
    df = spark.createDataFrame([("", " Нет фото "), ("", "other"), ("t", None)], "t string, n string")
    out = df.select(text.source_note_kind(C("n")).alias("k"), semantic.has_descriptive_content(C("t"), C("n")).alias("d")).collect()
    assert [tuple(r) for r in out] == [("SOURCE_STATE", False), ("SOURCE_STATE", False), ("SOURCE_STATE", True)]


def test_learning_twice_finds_nothing_new(spark):
    rows = spark.createDataFrame(
        [
            (1, "r", "f", "1", "NEW", "Аня, аня", "Сад", "", "1.0,2.0", "Сережа играет. Тут"),
            (2, "r", "f", "2", "NEW", "Аня", "Сад", "", "1.0,2.001", ""),
            (3, "r", "f", "3", "NEW", "", "Сад", "", "5,5", "Сад зимой"),
            (4, "r", "f", "4", "SKIP", "Никто", "", "", "", ""),
        ],
        "ord int, root string, folder string, reference string, status string, people string, place string, tags string, latlon string, source_description string",
    )
    none = spark.createDataFrame([], "entity_type string, canonical string, phrase string, status string")
    places = spark.createDataFrame([("s", "Сад", "")], "entity_id string, canonical string, latlon string")
    got = learning.learn_from_rows(rows, none, places)
    assert sorted((r.entity_type, r.canonical) for r in got["entities"].collect()) == [("person", "Аня"), ("place", "Сад")]
    assert sorted((r.canonical, r.alias, r.reason) for r in got["aliases"].collect()) == [("Аня", "Сережа играет", "FUZZY_CANDIDATE"), ("Аня", "Тут", "FUZZY_CANDIDATE"), ("Сад", "Сережа играет", "FUZZY_CANDIDATE"), ("Сад", "Тут", "FUZZY_CANDIDATE")]
    assert sorted((r.latlon, r.result) for r in got["coordinates"].collect()) == [("1.000000, 2.000000", "added"), ("1.000000, 2.001000", "unchanged"), ("5.000000, 5.000000", "conflict")]
    evidence = sorted((r.reason, r.latlon, r.reference) for r in got["evidence"].where("latlon <> ''").collect())
    assert evidence == [("APPROVED_COORDINATES", "1.000000, 2.000000", "1"), ("APPROVED_COORDINATES", "1.000000, 2.001000", "2"), ("COORDINATE_CONFLICT", "5.000000, 5.000000", "3")]
    assert {r.result for r in learning.learn_from_rows(rows, none, places.limit(0))["coordinates"].collect()} == {"added", "unchanged", "conflict"}
    known = got["entities"].select("entity_type", "canonical", C("canonical").alias("phrase"), F.lit("CONFIRMED").alias("status"))
    assert learning.learn_from_rows(rows, known, places)["entities"].count() == 0


def test_catalog_import(spark):
    ents = spark.createDataFrame([("place", "1", "Сад", "1.000000, 2.000000"), ("place", "2", "Огород", "")], "entity_type string, entity_id string, canonical string, latlon string")
    als = spark.createDataFrame([("place", "1", "садик", "CANDIDATE")], "entity_type string, entity_id string, alias string, status string")
    sheet = spark.createDataFrame(
        [("place", "1", "Сад!", "садик; огород; и", "", "и", "1,3"), ("place", "9", "Новое", "", "", "", "north"), ("place", "", "Ещё", "", "", "", "")],
        "entity_type string, entity_id string, canonical string, confirmed_aliases string, candidate_aliases string, rejected_aliases string, latlon string",
    )
    out = {k: sorted(map(tuple, v.collect())) for k, v in catalog_io.import_catalog(sheet, ents, als).items()}
    assert out["renames"] == [("place", "1", "Сад!")] and [x[2] for x in out["added"]] == ["Ещё", "Новое"] and out["invalid"] == [("place", "9", "Новое")]
    assert sorted(x[2:] for x in out["aliases"]) == [("и", "REJECTED", "added"), ("огород", "CONFIRMED", "added"), ("садик", "CONFIRMED", "promoted")]
    assert out["collisions"] == [("place", "1", "и")] and out["merges"] == [("place", "1", "2")] and out["latlons"] == [("place", "1", "1.000000, 3.000000")] and len(out["bad_latlons"]) == 1


# --- merge


def side(spark, rows):
    return spark.createDataFrame([(i, p, n) for i, (p, n) in rows.items()] or [("", "", "")], "record_id string, place string, notes string").where("record_id <> ''")


def merged(spark, base, local, remote, **kw):
    out = merge.three_way_merge(side(spark, base), side(spark, local), side(spark, remote), ["place", "notes"], **kw)
    return {r.record_id: (r.outcome, r.kept, r["values"]["place"], r["values"]["notes"], [(c.field, c.kind) for c in r.conflicts]) for r in out.collect()}


def test_three_way_rules(spark):
    b = {"same": ("a", "n"), "l": ("a", "n"), "r": ("a", "n"), "both": ("a", "n"), "agree": ("a", "n"), "gone": ("a", "n"), "goneedit": ("a", "n"), "none": ("a", "n")}
    lo = {"same": ("a ", "n"), "l": ("b", "n"), "r": ("a", "n"), "both": ("b", "n"), "agree": ("b", "n"), "goneedit": ("b", "n"), "newl": ("x", ""), "newb": ("x", "1"), "news": ("x", "")}
    re_ = {"same": ("a", "n"), "l": ("a", "n"), "r": ("a", "m"), "both": ("c", "n"), "agree": ("b  ", "n"), "gone": ("a", "n"), "newr": ("y", ""), "newb": ("x", "2"), "news": (" x", "")}
    got = merged(spark, b, lo, re_)
    assert got["same"] == ("auto_merged", True, "a ", "n", []) and got["l"][2] == "b" and got["r"][3] == "m" and got["agree"] == ("auto_merged", True, "b", "n", [])
    assert got["both"] == ("conflict", True, "a", "n", [("place", "FIELD")]) and got["newb"] == ("conflict", True, "x", "1", [("notes", "ADDED_BOTH")])
    assert got["newl"][0] == "added_local" and got["newr"][0] == "added_remote" and got["news"] == ("added_local", True, "x", "", [])
    assert got["gone"][:3] == ("removed", True, "a") and got["goneedit"][:3] == ("removed", True, "b") and got["none"][:3] == ("removed", True, "a")
    dele = merged(spark, b, lo, re_, deletions_meaningful=True)
    assert dele["gone"][:2] == ("removed", False) and dele["none"][:2] == ("removed", False)
    assert dele["goneedit"] == ("conflict", True, "a", "n", [("place", "DELETE_VS_EDIT"), ("notes", "DELETE_VS_EDIT")])


def test_merge_with_itself_changes_nothing(spark):
    b = {"x": ("a", "n"), "y": ("b", "")}
    assert {v[0] for v in merged(spark, b, b, b).values()} == {"unchanged"}


def test_resolutions(spark):
    m = merge.merge_first_sync(side(spark, {"x": ("a", "1"), "y": ("q", "q")}), side(spark, {"x": ("b", "1"), "z": ("r", "r")}), ["place", "notes"])
    sheet = merge.conflict_rows(m)
    assert [tuple(r) for r in sheet.select("record_id", "field", "base").collect()] == [("x", "place", merge.NO_BASELINE)]
    pick = lambda c, v="": merge.read_conflicts(sheet.withColumns({"choice": F.lit(c), "custom_value": F.lit(v)}))
    reasons = [merge.unresolved_conflicts(m, pick(c)).first() for c in ("", "maybe", "custom", "base")]
    assert [r.reason for r in reasons] == ["missing", "unknown", "no value", "no base"]
    state = lambda p, *h: {(r.record_id, r.place, r.state) for r in merge.apply_resolutions(m, p, ["place", "notes"], *h).collect()}
    assert ("x", "b", "RESOLVED") in state(pick("drive")) and ("x", "own", "RESOLVED") in state(pick("custom", "own")) and ("x", "a", "REMOTE_CHANGED") in state(pick("local"), "h1", "h2")
    assert ("x", "a", "INCOMPLETE") in state(pick(""))


# --- review


def scan_of(spark, **k):
    row = {"root": "r", "folder": "f", "identity": "i", "reference": "I", "is_entry": True, "filename": "I.jpg", "photo_hash": "p", "fingerprint": ""}
    row |= {c: "" for c in (*review.SOURCES, *review.SUGGESTIONS)} | k
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'boolean' if n == 'is_entry' else 'string'}" for n in row))


def existing_of(spark, **k):
    row = {"root": "r", "folder": "f", "identity": "i"} | {c: "" for c in ("reference", "filename", "photo_id", "status", "review_reason", *review.SOURCES, *review.SUGGESTIONS, *review.FINALS, *review.HUMAN_ONLY)} | {"status": "NEW", "photo_id": "id"} | k
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in row))


def state_of(spark, **k):
    row = {"root": "r", "folder": "f", "identity": "i", "photo_hash": "p", "description_hash": "", "status": "NEW", "was_absent": False, "photo_id": "id", "image_fingerprint": ""} | k
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'boolean' if n == 'was_absent' else 'string'}" for n in row))


def rescanned(spark, s, e, t, **k):
    return review.rescan_merge(s, e, t, **k).first()


def test_rescan_ladder(spark):
    h = spark.range(1).select(text.text_hash(F.lit("t"), F.lit(""), F.lit("")).alias("h")).first().h
    scan = lambda **k: scan_of(spark, source_description="t", **k)
    cases = [
        (scan(), {"status": "NEW"}, {"description_hash": h}, "NEW", ""),
        (scan(), {"status": "DESCRIBED_ABSENT"}, {"description_hash": h, "was_absent": True}, "REVIEW", "found"),
        (scan(), {"status": "SOURCE_MISSING"}, {"description_hash": h, "status": "SOURCE_MISSING"}, "REVIEW", "returned"),
        (scan(photo_hash="q"), {}, {"description_hash": h}, "REVIEW", "photo"),
        (scan(), {"status": "APPROVED"}, {"description_hash": "x", "status": "APPROVED"}, "REVIEW", "approved"),
        (scan(), {}, {"description_hash": "x"}, "REVIEW", "description"),
        (scan(filename=None), {}, {"description_hash": h}, "DESCRIBED_ABSENT", ""),
        (scan(photo_hash="q"), {"status": "SKIP"}, {"description_hash": h}, "SKIP", "photo"),
        (scan_of(spark, is_entry=False), {"source_description": "old"}, {}, "NEW", "stale"),
    ]
    for s, e, t, status, reason in cases:
        got = rescanned(spark, s, existing_of(spark, **e), state_of(spark, **t))
        assert (got.status, got.review_reason) == (status, review.REASON.get(reason, ""))


def test_rescan_never_overwrites_finals(spark):
    s = scan_of(spark, suggested_date="1979", suggested_place="Suggested", source_description="d")
    got = rescanned(spark, s, existing_of(spark, place="Typed", map_link="https://maps.google.com/?q=1,2"), state_of(spark))
    assert (got.date, got.place, got.latlon, got.description, sorted(got.filled)) == ("1979", "Typed", "1.000000, 2.000000", "d", ["date", "description"])
    bad = rescanned(spark, s, existing_of(spark, map_link="x", latlon="9.000000, 9.000000"), state_of(spark, description_hash=got.state_description_hash))
    assert (bad.latlon, bad.review_reason) == ("9.000000, 9.000000", review.REASON["bad_link"])


def test_rescan_leftovers_new_rows_and_places(spark):
    none = existing_of(spark).limit(0)
    new = rescanned(spark, scan_of(spark, filename=None, suggested_people="A"), none, state_of(spark).limit(0))
    assert (new.status, new.people, new.state_was_absent) == ("DESCRIBED_ABSENT", "A", True) and len(new.photo_id) == 32
    gone = lambda **k: rescanned(spark, scan_of(spark).limit(0), existing_of(spark, place="Typed"), state_of(spark), **k)
    assert (gone().status, gone().place, gone().photo_id) == ("SOURCE_MISSING", "Typed", "id") and gone(descriptions_readable=False).status == "NEW"
    places = spark.createDataFrame([("Typed", "resolved", "Canon", "3.000000, 4.000000")], "place string, resolution string, canonical string, latlon string")
    got = rescanned(spark, scan_of(spark), existing_of(spark, place="Typed"), state_of(spark), places=places)
    assert (got.place, got.suggested_place, got.latlon) == ("Typed", "Canon", "3.000000, 4.000000")


def test_second_rescan_is_quiet(spark):
    s, none = scan_of(spark, source_description="d", suggested_date="1979"), state_of(spark).limit(0)
    first = review.rescan_merge(s, existing_of(spark).limit(0), none)
    state = first.select(*review.KEY, C("state_photo_hash").alias("photo_hash"), C("state_description_hash").alias("description_hash"), "status", C("state_was_absent").alias("was_absent"), "photo_id", C("state_image_fingerprint").alias("image_fingerprint"))
    second = review.rescan_merge(s, first, state)
    same = [*review.KEY, "status", "review_reason", "date", "description", "photo_id"]
    assert second.select(same).exceptAll(first.select(same)).count() == 0
    assert second.first().outcomes[0] == "unchanged"


def test_read_rows_and_signatures(spark, tmp_path):
    raw = spark.createDataFrame([(1, "f", " IMG_1.jpg ", "NEW", "a"), (2, "f", "img_1", "odd", "b"), (3, "f", " ", "NEW", "c")], "pos int, folder string, Reference string, status string, place string")
    rows = review.read_review_rows(raw, ("place", "people"))
    assert [(r.identity, r.status, r.place, r.people) for r in rows.collect()] == [("img_1", "NEW", "b", "")]
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x")], "folder string, ord int, v string")
    none = t.limit(0).select("folder", C("v").alias("signature"))
    first = review.write_if_changed(t, none, str(tmp_path / "t"), ["folder"], ["ord"], ["v"])
    stored = spark.createDataFrame(first.collect(), first.schema)
    moved = t.withColumn("ord", F.when(C("folder") == "a", 3 - C("ord")).otherwise(C("ord")))
    assert {r.folder for r in review.changed_groups(moved, stored, ["folder"], ["ord"], ["v"]).collect()} == {"a"}
    assert review.changed_groups(t, stored, ["folder"], ["ord"], ["v"]).count() == 0


def test_coverage_values(spark):
    cases = [("FOUND", True, "t", "c", "DESCRIBED"), ("FOUND", True, " ", "c", "CONTEXT_ONLY"), ("FOUND", True, "", "", "ENTRY_EMPTY"), ("FOUND", False, "t", "c", "NO_ENTRY"), ("ABSENT", True, "t", "c", None)]
    df = spark.createDataFrame(cases, "s string, e boolean, t string, c string, want string")
    assert df.where(~semantic.classify_coverage(C("s"), C("e"), C("t"), C("c")).eqNullSafe(C("want"))).count() == 0


def test_links_and_flags(spark):
    links = one(spark, "u", lambda c: semantic.destination_links(F.lit(None).cast("string"), F.lit("d"), c, F.lit(True)))
    assert [(x.kind, x.primary) for x in links] == [("drive", True), ("yandex", False)]
    assert one(spark, "x", lambda c: portable.compose_description(F.lit("Сад"), F.lit("1979"), F.lit(""), F.lit("one two three"), 18)) == "1979. Сад. one two"
    assert one(spark, "x", lambda c: portable.republish_decision(F.lit(True), F.lit(True))) == "replace"


def test_top_with_rest(spark):
    top, rest = reports.top_with_rest(spark.range(10), [C("id").desc()], 3)
    assert [r.id for r in top.collect()] == [9, 8, 7] and rest == 7


# --- portable state, files, stream


def test_snapshots(spark, tmp_path):
    base, t = str(tmp_path), {"rows": spark.createDataFrame([("a", 1), ("b", None)], "k string, v int").withColumn("run_id", F.lit("1"))}
    assert portable.load_snapshot(spark, base) == ({}, 0)
    assert portable.publish_snapshot(t, base, 0) == ("published", 1)
    again = {"rows": t["rows"].withColumn("run_id", F.lit("2")).orderBy(C("k").desc())}
    assert portable.publish_snapshot(again, base, 1) == ("unchanged", 1)
    assert portable.publish_snapshot({"rows": t["rows"].limit(1)}, base, 0) == ("conflict", 1)
    assert portable.publish_snapshot({"rows": t["rows"].limit(1)}, base, 1) == ("published", 2)
    tables, n = portable.load_snapshot(spark, base)
    assert n == 2 and tables["rows"].count() == 1
    (tmp_path / "manifests" / "3.json").write_text('{"schema_version": 99, "generation": 3, "tables": []}')
    with pytest.raises(ValueError, match="schema version"):
        portable.load_snapshot(spark, base)


def test_bootstrap_twice_is_once(spark):
    ents = spark.createDataFrame([("tag", "1", "x")], "entity_type string, entity_id string, canonical string")
    als = spark.createDataFrame([("tag", "1", "a", "CONFIRMED")], "entity_type string, entity_id string, alias string, status string")
    have = {"entities": ents.limit(0), "aliases": als.withColumn("status", F.lit("CANDIDATE"))}
    first = portable.bootstrap({"entities": ents, "aliases": als}, have)
    second = portable.bootstrap({"entities": ents, "aliases": als}, first)
    assert first["aliases"].first().status == "CONFIRMED"
    for n in first:
        assert sorted(map(tuple, first[n].collect())) == sorted(map(tuple, second[n].collect()))


def test_documents_from_files(spark, tmp_path):
    from curatrix.sources import files

    folder = tmp_path / "1990"
    folder.mkdir()
    xml = f'<w:document xmlns:w="{files._W[1:-1]}"><w:body><w:p><w:r><w:t>018 a</w:t><w:tab/></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (folder / "bad.docx").write_bytes(b"not a zip")
    got = sorted((r.document, r.folder, r.pos, r.text, r.error is None) for r in files.extract_paragraphs(spark, str(tmp_path)).where("text IS NOT NULL").collect())
    assert got == [("d.docx", "1990", 0, "018 a b", True), ("d.docx", "1990", 1, "c", True)]
    assert files.extract_paragraphs(spark, str(tmp_path)).where("error IS NOT NULL").count() == 1
    scanned = {r.relative_path: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert set(scanned) == {"1990/d.docx", "1990/bad.docx"} and scanned["1990/bad.docx"].size == 9


def test_listing_stream(spark, tmp_path):
    from curatrix.streaming.listing_stream import LISTING, run_listing_stream

    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    for rows in ([("r", "a", False, 1, None, "h"), ("r", "b", False, 1, None, "h")], [("r", "a", False, 1, None, "h")]):
        spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("append").parquet(src)
        run_listing_stream(spark, src, state, str(tmp_path / "cp"), lambda n: f"2024-01-0{n + 1}").awaitTermination()
    from curatrix.streaming.listing_stream import read_state

    got = {r.relative_path: r for r in read_state(spark, state).collect()}
    assert got["a"].missing_since is None and got["a"].last_seen.day == 2 and got["a"].first_seen.day == 1
    assert got["b"].missing_since.day == 2 and got["b"].last_seen.day == 1


@pytest.mark.parametrize("parts", [1, 64])
def test_results_do_not_depend_on_partitions(spark, small, parts):
    from curatrix.plans.queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {n: sorted(map(str, QUERIES[n](spark, small).collect())) for n in ("group_entries", "three_way_merge", "find_matches")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for n, w in want.items():
            assert sorted(map(str, QUERIES[n](spark, small).collect())) == w
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_files_and_tables_below_odd_folders(spark, tmp_path):
    from curatrix.sources import files

    base = tmp_path / "a+b (1) x.y"
    (base / "in").mkdir(parents=True)
    (base / "in" / "t.csv").write_text("id,name\n1,one\nbad,two\n")
    (base / "~$t.csv").write_text("id,name\n9,lock\n")
    assert {r.relative_path for r in files.scan_files(spark, str(base), glob="t.csv").collect()} == {"in/t.csv"}
    rows = files.discover_tables(spark, str(tmp_path), "id int, name string").select("id", "name").collect()
    assert sorted((r.id or 0, r.name) for r in rows) == [(0, "two"), (1, "one")]
    sources = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "name string, enabled boolean")
    assert [r.name for r in files.enabled_sources(sources).collect()] == ["a"]


def test_small_text_functions(spark):
    df = spark.createDataFrame([(" https://disk/d/abc/?x=1 ", "2020-01-02 03:04:05", "m1", "")], "u string, t string, m string, r string")
    at = text.parse_timestamp(C("t"))
    got = df.select(
        text.public_key_from_url(C("u"), ["https://disk/"]).alias("key"), text.public_key_from_url(C("u"), ["ftp://"]).alias("none"), text.fallback_root_name(C("u")).alias("root"),
        text.format_timestamp(at).alias("t"), text.describe_provenance(at, C("m"), C("r")).alias("p"), semantic.source_note_text(F.lit("d"), F.lit(" "), F.lit("n")).alias("s"),
    ).first()
    assert tuple(got) == ("https://disk/d/abc/?x=1", None, "abc", "2020-01-02T03:04:05Z", "2020-01-02T03:04:05Z on m1", "d\n\nПометки: n")


def test_baselines_and_refused_proposals(spark, tmp_path):
    base = spark.createDataFrame([("a", "r1", "x"), ("b", "r2", "y")], "artifact string, record_id string, value string")
    path = str(tmp_path / "base")
    assert portable.load_baseline(spark, path, "a") is None
    portable.save_baseline(base, path)
    portable.save_baseline(base.where("artifact = 'a'").withColumn("value", F.lit("z")), path)
    assert [r.value for r in portable.load_baseline(spark, path, "a").collect()] == ["z"]
    assert [r.value for r in portable.load_baseline(spark, path, "b").collect()] == ["y"]
    assert [r.record_id for r in portable.rejected_proposals(base, base.limit(1), ["record_id"]).collect()] == ["r2"]


def ends_by_walking(pairs):
    """Survivors one step at a time: the end of the chain, or the least member of the cycle it runs into."""
    to = {}
    for kind, a, s in pairs:
        if a != s:
            to[kind, a] = min(to.get((kind, a), s), s)
    out = {}
    for kind, a in to:
        seen, at = [], a
        while (kind, at) in to and at not in seen:
            seen.append(at)
            at = to[kind, at]
        end = min(seen[seen.index(at) :]) if at in seen else at
        if end != a:
            out[kind, a] = end
    return out


def test_survivors_of_chains_cycles_and_random_merges(spark):
    import random

    name = lambda group, i: f"{group}-{i:04d}"
    pairs = [("tag", name(f"up{n}", i), name(f"up{n}", i + 1)) for n in range(1, 71) for i in range(n)]
    pairs += [("tag", name(f"down{n}", i), name(f"down{n}", i - 1)) for n in range(1, 71) for i in range(1, n + 1)]
    for n in range(1, 18):
        pairs += [("place", name(f"ring{n}", i), name(f"ring{n}", (i * 1 + 1) % n)) for i in range(n)]
        pairs += [("place", name(f"ring{n}", 1000 + i), name(f"ring{n}", 1000 + i - 1 if i else n - 1)) for i in range(2 * n)]
    rng = random.Random(4)
    pairs += [("person", f"p{rng.randrange(9000)}", f"p{rng.randrange(9000)}") for _ in range(10_000)]
    df = spark.createDataFrame(pairs, "entity_type string, absorbed string, survivor string")
    assert {(r.entity_type, r.absorbed): r.survivor for r in dictionary.survivors(df).collect()} == ends_by_walking(pairs)


def test_merging_long_chains_leaves_nothing_on_deleted_ids(spark):
    ids = [f"n{i:02d}" for i in range(40)]
    pairs = spark.createDataFrame([("tag", a, b) for a, b in zip(ids, ids[1:], strict=False)], "entity_type string, absorbed string, survivor string")
    ents = spark.createDataFrame([("tag", i, i.upper()) for i in ids], "entity_type string, entity_id string, canonical string")
    als = spark.createDataFrame([("tag", i, f"alias {i}", "CANDIDATE") for i in ids], "entity_type string, entity_id string, alias string, status string")
    out = dictionary.merge_entities(pairs, ents, als, als.select("entity_type", "entity_id"))
    assert [r.entity_id for r in out["entities"].collect()] == ["n39"]
    assert {r.entity_id for r in out["aliases"].collect()} == {"n39"} == {r.entity_id for r in out["evidence"].collect()}
    assert out["aliases"].count() == 40 + 39


def test_phrases_are_found_as_by_scanning(spark):
    """Random words, phrases of one to seven words with signs inside and outside, hot words, hot phrases."""
    import random
    import re

    rng = random.Random(8)
    words = ["the", "church", "of", "st", "olga", "garden", "рядом", "дом", "x1", "x"]
    phrases = sorted({rng.choice(["", "(", "- "]) + "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "-"]) for _ in range(rng.randrange(1, 8))).strip() for _ in range(300)})
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", ". ", "-", "_"]) for _ in range(rng.randrange(0, 40)))) for i in range(150)] + [(900, None), (901, ""), (902, "The CHURCH of St Olga " * 200)]
    df = spark.createDataFrame(texts, "text_id long, text string")
    ph = spark.createDataFrame([("tag", p.upper(), p, "CONFIRMED") for p in phrases], "entity_type string, canonical string, phrase string, status string")
    want = []
    for i, text in texts:
        low = (text or "").lower()
        for p in phrases:
            needle, at = p.lower().strip(), -1
            while (at := low.find(needle, at + 1)) >= 0:
                if not re.match(r"\w", low[at - 1 : at] if at else "") and not re.match(r"\w", low[at + len(needle) : at + len(needle) + 1]):
                    want.append((i, p, at, at + len(needle), text[at : at + len(needle)]))
    found = dictionary.find_candidates(df, ph)
    assert sorted(tuple(r) for r in found.select("text_id", "phrase", "start", "end", "matched_text").collect()) == sorted(want)
    low = df.selectExpr("text_id", "lower(text) AS low")
    plain = [p.lower() for p in phrases if p[0].isalnum() and p[-1].isalnum()]  # signs outside the words are compared with the text
    met = dictionary.met_phrases(low, dictionary.phrase_index(spark.createDataFrame([(p,) for p in plain], "needle string")))
    assert met.count() <= 2 * sum(w[1] in plain for w in want)
    kept = {}
    for i, p, a, b, _ in sorted(want, key=lambda x: (x[0], -len(x[1]), x[1], x[2])):
        if all(a >= d or b <= c for c, d in kept.setdefault(i, [])):
            kept[i].append((a, b))
    got = {}
    for r in dictionary.find_matches(df, ph).collect():
        got.setdefault(r.text_id, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in kept.items() if v}


def test_ranks_over_hot_keys(spark):
    from curatrix.scratch import ranked

    rows = [("hot" if i % 3 else f"k{i % 50}" if i % 2 else None, (i * 7919) % 5000) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, v long")
    out = ranked(df, ["k"], [F.col("v")], "n", pieces=13)
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    want = sorted(((k, v, n) for k, vs in groups.items() for n, v in enumerate(sorted(vs), 1)), key=repr)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want


@pytest.mark.parametrize(
    "f, most",
    [
        (lambda c: dates.xmp_fields(dates.parse_archive_date(c)), 4),
        (lambda c: dates.exif_text(dates.compat_timestamp(dates.parse_archive_date(c))), 4),
        (lambda c: dates.compat_timestamp_strict(dates.parse_archive_date(c))["value"], 4),
        (lambda c: dates.archive_date_text(dates.parse_archive_date(c)), 4),
        (lambda c: dates.suggest_date(c), 8),
        (lambda c: geo.format_latlon(geo.parse_map_link(c)), 24),
        (lambda c: geo.map_url(geo.parse_latlon(c)), 4),
    ],
)
def test_expressions_name_their_input_once(spark, f, most):
    """Copies of copies of an expression took minutes and didn't compile."""
    plan = spark.createDataFrame([("1979",)], "c string").select(f(F.col("c")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?i)regexp_\w+\(|rlike\(", plan)) <= most


def test_dates_at_every_precision(spark):
    rows = ["1979", "1979-02", "1979-02-03", "1979-02-03 04:05", "1979-02-03 04:05:06", " 1979-02 ", "1979-13", "1979-02-30", "1979-02-03 24:05", "1979-02-03 04:05:60", "0000", "1979-2", "", None, "x"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").select("i", dates.archive_date_text(dates.parse_archive_date(F.col("c"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["1979", "1979-02", "1979-02-03", "1979-02-03 04:05:00", "1979-02-03 04:05:06", "1979-02", *[None] * 9]


def test_merge_turns_follow_the_longest_chain(spark, monkeypatch):
    """Many short cycles once took as many turns as the logarithm of all rows."""
    pairs = [("tag", f"{c:04d}{m}", f"{c:04d}{(m + 1) % 3}") for c in range(2_000) for m in range(3)] + [("tag", f"x{i}", f"x{i + 1}" if i < 2 else "00070") for i in range(3)]
    turns, plain = [], dictionary.written
    monkeypatch.setattr(dictionary, "written", lambda df, tag: (turns.append(tag), plain(df, tag))[1])
    got = {r.absorbed: r.survivor for r in dictionary.survivors(spark.createDataFrame(pairs, "entity_type string, absorbed string, survivor string")).collect()}
    assert len(turns) <= 11
    assert got == {f"{c:04d}{m}": f"{c:04d}0" for c in range(2_000) for m in (1, 2)} | {f"x{i}": "00070" for i in range(3)}


def test_merges_of_random_maps(spark):
    rng = random.Random(5)
    pairs = [("tag", f"{g}-{i}", f"{g}-{rng.randrange(n)}") for g in range(60) for n in [rng.randint(2, 12)] for i in range(n) if rng.random() < 0.9]
    to = {a: b for _, a, b in pairs if a != b}
    want = {}
    for a in to:
        seen, at = [a], a
        while at in to and to[at] not in seen:
            at = to[at]
            seen.append(at)
        want[a] = min(seen[seen.index(to[at]) :]) if at in to else at
    got = {r.absorbed: r.survivor for r in dictionary.survivors(spark.createDataFrame(pairs, "entity_type string, absorbed string, survivor string")).collect()}
    assert got == {a: b for a, b in want.items() if a != b}


def test_a_paragraph_is_cut_up_once(spark):
    """The regexes of a paragraph stand in the plan once or twice, not in a copy for each use."""
    rows = spark.createDataFrame([("f", 1, "018.jpg text"), ("f", 2, "1.2 x"), ("f", 3, "12345 x")], "folder string, pos int, text string")
    photos = spark.createDataFrame([("f", "1.2.jpg"), ("f", "a.png")], "folder string, name string")
    style = documents.reference_style(rows, photos)
    assert {(r.folder, r.width) for r in style.collect()} == {("f", 3), ("f", 1)}
    assert style._jdf.queryExecution().optimizedPlan().toString().count("A-Za-z0-9_.") <= 2


def test_phrases_listed_often_are_looked_up_once(spark, monkeypatch):
    seen, real = [], dictionary.find_candidates
    monkeypatch.setattr(dictionary, "find_candidates", lambda texts, phrases: seen.append(phrases.count()) or real(texts, phrases))
    texts = spark.createDataFrame([("t", "Aunt Olga, Olga")], "text_id string, text string")
    phrases = spark.createDataFrame([("person", "Olga", "Olga", "CONFIRMED")] * 50, "entity_type string, canonical string, phrase string, status string")
    assert dictionary.find_matches(texts, phrases).count() == 2 and seen == [1]


def test_pairs_wanted_once_need_half_the_probes(spark, monkeypatch):
    """Each pair once, whichever of the two is greater, and about 9 probes of a band in place of 17."""
    rng = random.Random(4)
    some = [rng.getrandbits(63) for _ in range(40)]
    some += [p ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for p in some for _ in range(3)]
    rows = spark.createDataFrame([(p,) for p in sorted(set(some))], "p long")
    met = similarity._met(rows, rows, 7, ordered=True)
    want = sorted((a, b, (a ^ b).bit_count()) for a in set(some) for b in set(some) if a < b and (a ^ b).bit_count() <= 7)
    assert sorted((min(r.p, r.q), max(r.p, r.q), r.distance) for r in met.collect()) == want
    assert ">=" in met._jdf.queryExecution().optimizedPlan().toString()
