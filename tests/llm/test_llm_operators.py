"""The training-data operators against brute force, SQL, round trips and held-out rows, and
on nulls, empty tables, long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("curatrix.llm")

from curatrix.llm import decontaminate, language_id, line_dedup, mixing, mtree, near_dedup, quality, sharding, suffix_dedup, token_store  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def real(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(real):
    return sorted((r.doc_id, r.text) for r in real.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, one line often."""
    long = "lorem ipsum dolor sit amet " * 20_000
    return docs_of(
        spark,
        [
            (None, "no id here at all", "en", "a", 1),
            (1, None, None, None, None),
            (2, "", "en", "a", 0),
            (3, " \n\t\n ", None, "b", 5),
            (4, "same text again and again it goes", "en", "a", 1),
            (4, "same text again and again it goes", "en", "a", 1),
            (5, "same text again and again it goes", "de", None, 1),
            (6, long, "en", "hot", 1),
            (7, "12345 67890 !!!", "fr", "b", 1),
            *[(100 + i, f"Common Line\nown line {i}\n\tcommon line ", "en", "hot", 1) for i in range(12)],
        ],
    )


def held_against(df, sql, **views):
    con = duckdb.connect()
    for name, frame in views.items():
        con.register(name, frame.toArrow())
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    exp = [tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(exp, key=repr)


# --- line dedup


def line_digest(df):
    return line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def brute_lines(rows):
    space = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(space))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= 10)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(odd, real, rows):
    for df, plain in ((real, rows), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        assert sorted((tuple(r) for r in line_digest(df).collect()), key=repr) == brute_lines(plain)


def test_line_dedup_clashes_and_empty(spark, odd):
    out = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("k", F.lit(2)))
    assert out.where("doc_id = 100").select("text", "n_lines", "pos", "k").first()[:] == ("own line 0", 3, 1, 2)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# --- mixing


def test_mixing_meets_targets(real):
    mixed = mixing.mix(real)
    per = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("t"), F.max("size").alias("m"), F.max("copies").alias("c")).collect()
    for r in per:
        assert abs(r.taken - r.t) <= 3 * r.m
        assert r.c <= 3
    total = mixed.agg(F.sum("size")).first()[0]
    assert sum(r.t for r in per) == pytest.approx(total)


def test_mixing_salted_cells_and_reruns(real):
    a = mixing.mix(real, rows_per_cell=20)
    assert sorted(a.select("doc_id", "copies").collect()) == sorted(a.repartition(5).select("doc_id", "copies").collect())
    per = a.groupBy("source").agg(F.sum("copies").alias("n"), F.count("*").alias("docs"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect()
    for r in per:  # one offset for all cells of a source: copies add up to the expected number
        assert abs(r.n - r.docs * r.t / r.s) <= 1


def test_mixing_sql_and_odd_rows(odd):
    d = odd.select("doc_id", "text", "source")
    out = mixing.mix(d).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    held_against(out.where("doc_id IS NOT NULL AND doc_id <> 4"), f"SELECT * FROM ({mixing.ORACLE}) WHERE doc_id IS NOT NULL AND doc_id <> 4", documents=d)
    assert mixing.mix(d.limit(0)).count() == 0
    emitted = mixing.emit(odd.withColumn("size", F.lit("own")).withColumn("copies", F.lit("mine")))
    assert emitted.columns == [*odd.columns, "size", "copies"]
    assert emitted.where("size <> 'own' OR copies <> 'mine'").count() == 0


def test_mixing_one_source_is_taken_whole(spark):
    d = docs_of(spark, [(i, "w " * (i + 1), "en", "only", 1) for i in range(50)])
    assert mixing.mix(d).where("copies <> 1").count() == 0


# --- sharding


@pytest.mark.parametrize("options", [{}, {"sample": 64, "ranges": 32}])
def test_sharding_is_even_gapless_and_keeps_groups(real, options):
    out = sharding.assign_shards(real, **options).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 8
    assert loads.max() - loads.min() <= 0.02 * loads.mean() + 2 * out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (out.groupby("text")["shard"].nunique() == 1).all()
    assert all(zlib.crc32(t.encode()) == c for t, c in zip(out["text"], out["text_crc32"], strict=True))


def test_sharding_divides_a_group_larger_than_a_shard(spark):
    d = docs_of(spark, [(i, "hot text" if i % 2 else f"text {i}", "en", "a", 1) for i in range(2000)])
    out = sharding.assign_shards(d, ranges=128).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert loads.max() < 1.1 * loads.min()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_sharding_against_brute_force(real, rows):
    """Shards, slots and sizes again from the planned boundaries, row by row."""
    out = {r.doc_id: r for r in sharding.assign_shards(real).collect()}
    assert len(out) == len(rows)
    loads, slots, of_text = Counter(), defaultdict(list), {}
    for d, t in rows:
        r, raw = out[d], (t or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        loads[r.shard] += len(raw) + 1
        slots[r.shard].append(r.slot)
        assert of_text.setdefault(t, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= max(len(t or "") for _, t in rows) * 4 + 2 * sum(loads.values()) / 1024


def test_sharding_parts_overfull_ranges_that_the_sample_misses(spark):
    """Without a sample, halving goes on until equal texts are alone or ranges small."""
    d = docs_of(spark, [(i, f"text {i % 500}", "en", "a", 1) for i in range(2000)])
    out = sharding.assign_shards(d, sample=1, ranges=64).toPandas()
    assert (out.groupby("text")["shard"].nunique() == 1).all()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() < 1.1 * loads.min()


def test_sharding_odd_rows(odd):
    out = sharding.assign_shards(odd.withColumn("slot", F.lit("x"))).toPandas()
    assert len(out) == odd.count()
    assert out[out["doc_id"] == 1][["size", "text_crc32"]].values.tolist() == [[1, 0]]
    assert sharding.assign_shards(odd.limit(0)).count() == 0


# --- language ID


def test_language_id_held_out(real):
    out = language_id.identify(real)
    assert out.where("held_out AND lang <> lang_pred").count() == 0
    assert out.where("score < 0 OR score > 1").count() == 0
    # what is predicted doesn't read lang of held-out rows, source or doc_id
    blind = real.withColumn("lang", F.when(language_id.fold(F.col("doc_id"), 3) != 1, F.col("lang"))).withColumn("source", F.lit("x"))
    same = language_id.identify(blind).select("doc_id", "lang_pred", "score")
    assert same.exceptAll(out.select("doc_id", "lang_pred", "score")).count() == 0


def test_language_distance_is_out_of_place():
    profiles = language_id.Profiles(["x", "y"], *_profile({"x": ["a", "b"], "y": ["b", "z"]}), size=4)
    codes, counts = language_id.gram_counts(Counter(["ab"]))
    order = [c for _, c in sorted(zip(-counts, codes, strict=True))][:4]
    ranks = {"x": {97: 0, 98: 1}, "y": {98: 0, 122: 1}}
    want = {k: sum(abs(r[c] - i) if c in r else 4 for i, c in enumerate(order)) for k, r in ranks.items()}
    lang, score = profiles.best("ab")
    assert lang == min(want, key=want.get)
    assert score == pytest.approx(1 - min(want.values()) / (4 * len(order)))


def _profile(by_lang):
    codes = np.unique([ord(c) for v in by_lang.values() for c in v])
    ranks = np.full((len(codes), len(by_lang)), 4)
    for j, v in enumerate(by_lang.values()):
        for i, c in enumerate(v):
            ranks[np.searchsorted(codes, ord(c)), j] = i
    return codes, ranks


def test_language_id_against_brute_force(real, rows):
    """Profiles and predictions again, with plain counters."""

    def grams(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            padded = "\x01" + w + "\x01"
            out.update(w)
            out.update(padded[i : i + 2] for i in range(len(w) + 1))
            out.update(padded[i : i + 3] for i in range(len(w)))
        return out

    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(g))
    ranked = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:300]]
    lang = {r.doc_id: r.lang for r in real.collect()}
    total = defaultdict(Counter)
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 3 != 1 and lang[d] is not None and t is not None:
            total[lang[d]] += grams(t)
    profiles = {k: {g: i for i, g in enumerate(ranked(c))} for k, c in total.items()}
    want = {}
    for d, t in rows:
        own = ranked(grams(t))
        far = {k: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(own)) for k, p in sorted(profiles.items())}
        best = min(far, key=far.get)
        want[d] = (best, pytest.approx(1 - far[best] / (300 * len(own)))) if own else ("und", 0.0)
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(real).collect()} == want


def test_signs_are_no_letters(spark, real):
    docs = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(["½ ² ③ Ⅷ", "x½", "\u0301", "ª"])], "doc_id long, text string, lang string")
    out = {r.doc_id - 10**9: r.lang_pred for r in language_id.identify(real.select("doc_id", "text", "lang").union(docs)).where("doc_id >= 1000000000").collect()}
    assert [out[i] == "und" for i in range(4)] == [True, False, True, False]


def test_language_id_odd_rows(spark, odd):
    out = {r.doc_id: r for r in language_id.identify(odd.withColumn("score", F.lit("x"))).collect()}
    for d in (1, 2, 3, 7):
        assert (out[d].lang_pred, out[d].score) == ("und", 0.0)
    assert language_id.identify(odd.limit(0)).count() == 0
    nothing = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    kept = {r.doc_id for r in language_id.keep_identified(odd).collect()}
    assert not kept & {1, 2, 3, 7}
    assert language_id.keep_identified(odd.limit(0)).count() == 0


# --- quality


def test_quality_held_out(spark, small):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.9
    assert out[out.quality == 1]["score"].mean() > out[out.quality == 0]["score"].mean() + 0.5


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    fm = quality.FactorisationMachine(0.1, rng.normal(size=6), rng.normal(size=(6, 3)))
    at, x = np.arange(6), rng.normal(size=6)
    pairs = sum(float(fm.factors[i] @ fm.factors[j]) * x[i] * x[j] for i in range(6) for j in range(i))
    got = fm.margin(at, x, np.asarray([0]))[0][0]
    assert got == pytest.approx(0.1 + fm.linear @ x + pairs)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 0, 0), (4, 1, 0), (4, 0, 0), (6, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd.withColumn("predicted", F.lit("x")), labels)
    assert out.count() == odd.count()
    assert out.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CASE WHEN score >= 0.3 THEN 1 ELSE 0 END").count() == 0
    labelled = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    scores = lambda docs: sorted((r.doc_id, r.score) for r in quality.classify(docs, labelled).where("doc_id > 0").distinct().collect())
    assert scores(odd) == scores(odd.union(odd).repartition(5))
    none = quality.classify(odd, labels.limit(0))
    assert {round(r.score, 6) for r in none.collect()} == {0.5}
    assert quality.classify(odd.limit(0), labels).count() == 0


# --- token store


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_wavelet_matrix_answers():
    rng = random.Random(3)
    ids = np.asarray([rng.choice([0, 1, 5, 9, 700, 49407]) for _ in range(1500)], np.uint32)
    m, docs, lengths = token_store.from_bytes(token_store.to_bytes(ids, [3, None], [700, 800]))
    assert (m.decode() == ids).all() and docs == [3, None] and lengths.tolist() == [700, 800]
    for i in range(0, 1500, 97):
        assert m.access(i) == ids[i]
    for t in (0, 1, 5, 700, 49407, 2, 65536):
        places = np.flatnonzero(ids == t).tolist()
        assert m.count(t) == len(places)
        assert m.rank(t, 800) == sum(p < 800 for p in places)
        assert m.occurrences(t)[:5] == places[:5] and len(m.occurrences(t)) == len(places)
    assert m.select(2, 0) == -1


def test_token_store_round_trip(spark, real, rows):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(tokenizer_path()), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.encode_corpus(real, tokenizer_path(), shard_tokens=5000).collect()}
    for d, text in rows:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_words_give_the_tokens_of_the_whole():
    """Odd strings, random ones, and every letter, mark and number up to U+3000 with punctuation after it."""
    from tokenizers import Tokenizer

    rng = random.Random(1)
    odd = ["İ", "é", "e\u0301", "ß", "×", "÷", "ÿ", "Ÿ", "\u0301", "ı", "Σ", "ς", "ﬁ", "Ⅷ", "½", "北", "\xa0", "\u2003", "\x85", "<|endoftext|>", "'s", "'LL", "ÃŸ", "\U0001f600", "\u212a", "\x0b", "\x1c"]
    texts = ["a  b c d", "Tab\tand\rreturn\x0b\x0cx", "<|endoftext|> in <|startoftext|>text", "ΣΑΣ ΟΔΟΣ", "it's 12ab 北京", " ", "", "İ.", "TARİHİ.", "EVİ. b", "İ!", "sixteen-bytes-xx sixteen-bytes-xxy", "a" * 17 + " " + "a" * 16 + "b" * 40]
    texts += ["".join(rng.choice([*"abcXYZ .,;:!?'<|>09\t\n%-_", *odd]) for _ in range(rng.randrange(1, 14))) for _ in range(60_000)]
    marks = [chr(i) for i in range(0x80, 0x3000) if unicodedata.category(chr(i))[0] in "LMN"]
    texts += [c + p for c in marks for p in (".", "!b")] + ["ab" + c + "x?" for c in marks]
    want = Tokenizer.from_file(tokenizer_path()).encode_batch_fast(texts, add_special_tokens=False)
    got = token_store.Encoder(tokenizer_path(), cache=5_000)([t.encode() for t in texts])
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g.tolist() != w.ids] == []


def test_stretches_of_a_long_text(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "STRETCH", 40)
    texts = ["plain words, and more of them " * 30, "", "x" * 300 + " y\n" + "z " * 50, " "]
    t = Tokenizer.from_file(tokenizer_path())
    got = token_store.Encoder(tokenizer_path())([x.encode() for x in texts])
    assert [g.tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert token_store.Encoder(tokenizer_path())([]) == []


def test_token_store_odd_rows(odd):
    out = token_store.encode_corpus(odd, tokenizer_path()).orderBy("start").collect()
    assert len(out) == odd.count() and out[0].doc_id is None
    assert [r.start for r in out[1:]] == list(np.cumsum([r.n_tokens for r in out])[:-1])
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert token_store.encode_corpus(odd.limit(0), tokenizer_path()).count() == 0
    clash = odd.withColumns({"start": F.lit("x"), "none": F.lit(1), "tie": F.lit(2), "data": F.lit(3)})
    assert sorted(map(tuple, token_store.encode_corpus(clash, tokenizer_path()).collect()), key=repr) == sorted(map(tuple, out), key=repr)


# --- near-duplicates


def brute_classes(rows):
    """Classes by comparing every pair of rows."""

    def bag(text):
        w = (text or "").lower().split()
        n = min(5, len(w))
        return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()

    bags = [(d, bag(t)) for d, t in rows]
    up = {d: d for d, _ in bags}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for d, b in bags:
        for s in b:
            where[s].append(d)
    by = dict(bags)
    for d, b in bags:
        for e in {e for s in list(b)[:: max(1, len(b) // 40)] for e in where[s] if e > d}:
            c = by[e]
            both = sum((b & c).values())
            if both >= 0.8 * (sum(b.values()) + sum(c.values()) - both):
                x, y = sorted((top(d), top(e)))
                up[y] = x
    return {d: top(d) for d, _ in bags}


def test_near_dedup_against_all_pairs(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_classes(sorted((r.doc_id, r.text) for r in real.select("doc_id", "text").collect()))
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(real).collect()}
    assert got == want


def test_near_dedup_large_family_and_chain(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    family = []
    for i in range(60):
        w = base.copy()
        w[rng.randrange(300)] = f"x{i}"
        family.append((i, " ".join(w)))
    chain, w = [], [f"c{i}" for i in range(300)]
    for i in range(6):  # neighbours are near, the ends are not
        chain.append((1000 + i, " ".join(w)))
        w = w.copy()
        for k in range(i * 40, i * 40 + 25):
            w[k] = f"n{k}"
    far = [(2000 + i, " ".join(f"f{rng.randrange(10**6)}" for _ in range(100))) for i in range(20)]
    rows = family + chain + far
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_families_under_one_passage(spark):
    rng = random.Random(11)
    words = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, rows = words(240), []
    for k in range(1000):  # pairs just above 0.8, strangers near 0.7
        own, tail = words(22), words(56)
        rows += [(2 * k, " ".join(passage + own + tail[:28])), (2 * k + 1, " ".join(passage + own + tail[28:]))]
    bags = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    everywhere, where, both = set.intersection(*bags.values()), defaultdict(list), Counter()
    for d, b in bags.items():
        for s in b - everywhere:
            where[s].append(d)
    for ds in where.values():
        both.update((x, y) for i, x in enumerate(ds) for y in ds[i + 1 :])
    near = lambda x, y, n: n / (len(bags[x]) + len(bags[y]) - n) >= 0.8
    assert not near(0, 2, len(everywhere))  # so only pairs that share more can be near
    want = {d: d for d in bags}
    for (x, y), n in sorted(both.items()):
        if near(x, y, n + len(everywhere)):
            want[y] = x
    assert sum(d != c for d, c in want.items()) == 1000
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == want


def test_near_dedup_odd_rows(odd):
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.near_classes(odd).collect()), key=repr)
    assert got == sorted([(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (7, 7), *[(100 + i, 100 + i) for i in range(12)]], key=repr)
    kept = sorted((r.doc_id for r in near_dedup.keep_one(odd).collect()), key=repr)
    assert kept == sorted([None, 1, 2, 3, 4, 6, 7, *range(100, 112)], key=repr)
    assert near_dedup.near_classes(odd.limit(0)).count() == 0
    assert near_dedup.keep_one(odd.limit(0)).count() == 0
    twice = odd.union(odd.where("doc_id = 4").withColumns({"text": F.lit("another text of the same id"), "source": F.lit("z")})).withColumn("class_id", F.lit("own"))
    one = near_dedup.keep_one(twice).collect()
    assert len(one) == len(kept) and {r.class_id for r in one} == {"own"}
    assert sorted(map(str, one)) == sorted(map(str, near_dedup.keep_one(twice.repartition(7)).collect()))
    clash = odd.withColumns({"n": F.lit("x"), "bands": F.lit(1), "rep": F.lit(2), "k1": F.lit(3)})
    assert sorted(((r.doc_id, r.class_id) for r in near_dedup.near_classes(clash).collect()), key=repr) == got


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    e = rng.integers(1, 2**63, 400).astype(np.uint64)
    for wa, wb in ((np.ones(400), np.concatenate([np.ones(320), np.zeros(80)])), (rng.uniform(0.2, 3, 400), rng.uniform(0.2, 3, 400))):
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        a, b = (near_dedup.dart_signature(e[w > 0], w[w > 0], 2048) for w in (wa, wb))
        assert (a == b).mean() == pytest.approx(want, abs=0.05)


# --- decontamination

ITEM = "If a train leaves Boston at 60 mph and another leaves Chicago at 75 km per hour how long until Alice and Bob meet in the middle of the long journey"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return docs, bench, sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect())


def test_decontaminate_finds_copies_and_new_parameters(spark):
    other = ITEM.replace("60", "90").replace("75", "110").replace("Boston", "Denver").replace("Alice", "Carol")
    clean = "The train of thought that leaves a station at noon is of no use to Alice who meets nobody in the middle of a very short journey"
    _, _, got = found(spark, [f"before it {ITEM} and after", f"something else {other} end", clean, None, ""], [ITEM, "completely different question about rivers and lakes in the north of the country"])
    assert got == [(0, 0), (1, 0)]


def test_decontaminate_needs_consistent_slots(spark):
    item = " ".join(f"take 5 apples from the left box number {i} and put them" for i in "abcdefgh")
    moved = item
    for k in (1, 2, 3, 4, 6, 7, 8, 9):
        moved = moved.replace("5", str(k), 1)
    _, _, got = found(spark, [item, item.replace("5", "8"), moved], [item])
    assert got == [(0, 0), (1, 0)]


def test_decontaminate_shuffle_path_agrees(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    a = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    b = sorted(map(tuple, decontaminate.contaminated(docs, bench, max_sent=1).collect()))
    assert a == b
    # brute force: whole items that stand in a document word for word
    items = {r.item_id: " ".join(r.text.split()) for r in bench.collect()}
    texts = {r.doc_id: " ".join((r.text or "").split()) for r in docs.collect()}
    whole = {(d, i) for d, t in texts.items() for i, s in items.items() if len(s.split()) >= 10 and s in t}
    assert whole <= {(d, i) for d, i, *_ in a}


def test_decontaminate_judges_each_occurrence(spark):
    new = lambda a, b, c, d, e: ITEM.replace("60", a).replace("75", b).replace("Boston", c).replace("Alice", d).replace("Chicago", e)
    one, two = new("90", "110", "Denver", "Carol", "Austin"), new("35", "45", "Dallas", "Erin", "Fargo")
    longer = one.replace("another leaves", "another slow one leaves")
    texts = [f"{ITEM}. {one}.", f"{one}. {two}. {new('1', '2', 'Rome', 'Jim', 'Pisa')}.", f"{longer}. {two}. {ITEM}", "Nothing of all that is in here"]
    _, _, got = found(spark, texts, [ITEM])
    assert got == [(0, 0), (1, 0), (2, 0)]


def test_decontaminate_short_and_wordless_items(spark):
    short, names, eight = "what is the boiling point here", "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan", "Compute the least sum of these whole numbers"
    few = "Oslo 1905"
    texts = [f"then somebody asked {short} and left the room", f"present were {names} and others in the room", f"please now {eight} for me", f"in {few} there was much to do in all places", "present were Zoe Bob Carl Dave Erin Fred Grace Hal Ivan in 1905 Oslo"]
    _, _, got = found(spark, texts, [short, names, eight, few])
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("options", [{}, {"max_sent": 1}])
def test_decontaminate_finds_every_item_word_for_word(spark, options):
    rng = random.Random(3)
    pool = ["Oslo", "Rome", "Alice", "7", "12", "kg", "red", "box", "and", "the", "river", "Take", "old", "it"]
    items = [" ".join(rng.choice(pool) for _ in range(n)) for n in range(1, 15) for _ in range(3)]
    docs = spark.createDataFrame([(i, f"well so {t} is what they all said") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, **options).collect()}
    assert {(i, i) for i in range(len(items))} <= got


def test_decontaminate_names_that_begin_sentences(spark):
    item = "Maria buys 12 pens for 3 dollars each. Maria sells 4 of them."
    texts = [
        "Jonas buys 15 pens for 7 dollars each. Jonas sells 9 of them.",
        "Today Lena buys 2 pens for 5 dollars each. Then she went home.",
        "Today Lena buys 2 pens for 5 dollars each. Lena sells 1 of them.",
        "jonas buys 15 pens for 7 dollars each. jonas sells 9 of them.",
        "Jonas sells 15 hats for 7 dollars each. Nobody buys 9 of them.",
        "The man buys all pens for less. The man sells most of them.",
    ]
    _, _, got = found(spark, texts, [item])
    assert got == [(0, 0), (2, 0)]


def test_decontaminate_new_parameters_against_brute_force(spark):
    """Items of shared templates with other names and numbers, whole or one alone, between words
    of the same vocabulary: exactly the documents that hold a version of a template are found."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    people, form = ["Ann", "Bo", "Cid", "Dee", "Eve", "Flo"], []
    for _ in range(12):
        t = [rng.choice(words) for _ in range(24)]
        for k in rng.sample(range(1, 24), 5):
            t[k] = rng.choice(["NUM", "NAME"])
        form.append(["NAME", *t])

    def version(t):
        at = {"NAME": rng.choice(people), "NUM": str(rng.randrange(1000))}
        return " ".join(at.get(x, x) for x in t) + "."

    items = [version(t) for t in form for _ in range(2)]
    docs, want = [], set()
    for d in range(120):
        noise = lambda: " ".join(rng.choice([*words, *people, "7"]) for _ in range(rng.randrange(30))) + "."
        k = rng.randrange(24)
        docs.append(f"{noise()} {version(form[k])} {noise()}" if k < 12 else noise())
        want |= {(d, 2 * k), (d, 2 * k + 1)} if k < 12 else set()
    _, _, got = found(spark, docs, items)
    assert set(got) == want


def test_decontaminate_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same text again and again it goes"), (2, None), (3, ""), (None, "x y z"), (1, "same text again and again it goes")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()) == [(4, 1), (5, 1)]
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0
    kept = decontaminate.keep_clean(odd.withColumn("share", F.lit(1)), bench)
    assert kept.count() == odd.count() - 3 and kept.columns[-1] == "share"


# --- top-k


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_top_k_matches_sql(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    held_against(mtree.top_k(e), mtree.ORACLE, embeddings=e)


def test_top_k_ties_copies_and_odd_rows(spark):
    rng = random.Random(1)
    hot = [0.5] * 8
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(8)], 0) for i in range(300)]
    rows += [(500, None, 0), (520, [1.0, None], 0), (540, [float("nan")] * 8, 0), (560, [float("inf")] * 8, 0), (580, [1.0, 2.0], 0), (600, [1.0, 3.0], 0), (None, hot, 0)]
    e = vectors(spark, rows)
    held_against(mtree.top_k(e), mtree.ORACLE, embeddings=e)
    assert mtree.top_k(e.limit(0)).count() == 0
    twice = mtree.top_k(e.union(e).withColumn("rank", F.lit("x")))
    assert twice.exceptAll(mtree.top_k(e)).count() == 0


def test_mtree_pages_are_exact_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (20, 16))
    v = (centres[rng.integers(0, 20, 3000)] + rng.integers(-3, 4, (3000, 16))).astype(np.int64)
    top = int((v * v).sum(axis=1).max())
    tree = mtree.MTree.from_bytes(mtree.MTree.build(np.arange(3000), v, top).to_bytes())
    opened = []
    pages = tree.pages

    class Counting(list):
        def __getitem__(self, i):
            opened.append(i)
            return list.__getitem__(self, i)

    tree.pages = Counting(pages)
    for q in range(0, 3000, 250):
        s = v @ v[q]
        want = sorted(((-int(s[i]), i) for i in range(3000) if i != q))[:20]
        row, score, found = tree.search(np.asarray([q]), v[q : q + 1], 20)
        assert list(zip((-score).tolist(), found.tolist(), strict=True)) == want
    assert len(opened) < 0.7 * 12 * len(pages)


@pytest.mark.parametrize("scale", [1, 1 << 24])
def test_mtree_block_gives_what_single_queries_give(scale):
    """Also beyond the numbers that are exact as floating point."""
    rng = np.random.default_rng(5)
    v = rng.integers(-40, 40, (2000, 12)).astype(np.int64) * scale
    v[::7] = v[0]
    tree = mtree.MTree.from_bytes(mtree.MTree.build(np.arange(2000), v, int((v * v).sum(axis=1).max())).to_bytes())
    asked = np.arange(0, 2000, 20)
    scores = v[asked] @ v.T
    want = [sorted((-int(s), i) for i, s in enumerate(line) if i != q)[:9] for q, line in zip(asked, scores, strict=True)]
    floor = np.where(asked % 40 == 0, [-w[8][0] for w in want], np.iinfo(np.int64).min)
    for known in (None, floor):
        row, score, found = tree.search(asked, v[asked], 9, known)
        got = [[(-int(s), int(i)) for s, i in zip(score[row == r], found[row == r], strict=True)] for r in range(len(asked))]
        assert got == want


# --- repeated byte strings


def spans_digest(df):
    out = suffix_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def brute_spans(rows):
    return sorted(((d, *x) for (d, _), x in zip(rows, suffix_dedup.remove_repeats_brute(rows), strict=True)), key=repr)


def test_repeats_on_real_documents(real, rows):
    assert spans_digest(real) == brute_spans(rows)


def test_repeats_overlaps_edges_and_odd_rows(spark, odd):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    p, q = word(50), word(200)
    rows = [(1, p + word(30) + q), (2, word(10) + p + word(5)), (3, q[:49]), (4, q[20:120] + q[60:180]), (5, p * 3), (6, "a" * 400), (7, "a" * 51), (9, q + p), (8, q[:100] + "Z" + q[101:]), (8, q), (None, q), (10, None), (11, "")]
    assert spans_digest(spark.createDataFrame(rows, "doc_id long, text string")) == brute_spans(rows)
    longer = odd.union(odd.where("doc_id = 6").withColumn("doc_id", F.lit(60).cast("long")))
    clash = longer.withColumns({"kept": F.lit(1), "at": F.lit("x"), "th": F.lit(2), "ats": F.lit(3), "key": F.lit(4)})
    assert spans_digest(clash) == brute_spans([(r.doc_id, r.text) for r in longer.collect()])
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_repeats_across_stretches_and_blocks(real, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 90)
    monkeypatch.setattr(suffix_dedup, "FLUSH_RUNS", 500)
    assert spans_digest(real) == brute_spans(rows)


def test_false_matches_are_found_and_undone(real, rows, monkeypatch):
    """With a content hash that takes all runs of one size for equal, the bytes tell, and another seed is right."""
    right = suffix_dedup.content_hash
    monkeypatch.setattr(suffix_dedup, "content_hash", lambda h, at, n, seed: right(h, at, n, seed) if seed == 2 else n.astype(np.uint64))
    assert spans_digest(real) == brute_spans(rows)


def test_hot_keys_are_sorted_in_two_rounds(real, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 1)
    monkeypatch.setattr(suffix_dedup, "SORT_STRINGS", 100)
    assert spans_digest(real) == brute_spans(rows)


def test_one_string_in_very_many_documents(spark, monkeypatch):
    """A passage of just over 50 bytes between other bytes everywhere, copies in one document included."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 20)
    monkeypatch.setattr(suffix_dedup, "SORT_STRINGS", 200)
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    p = word(52)
    rows = [(d, word(40) + p + word(30) + (p if d % 7 == 0 else "")) for d in range(300, 0, -1)]
    assert spans_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == brute_spans(rows)


def test_step_two_makes_rows_for_buckets_not_documents():
    doc = np.arange(300)
    runs = suffix_dedup._pack("<u4", np.repeat([5], 300), doc, doc + 7, doc % 9, np.full(300, 3))
    out = suffix_dedup._settle(4)(pd.DataFrame({"bucket": [2], "runs": [runs]}))
    assert len(out) <= 4 and out["n_runs"].sum() == 300
    back = pd.concat([suffix_dedup._asked(out[out["into"] == b]) for b in out["into"]])
    assert sorted(back["doc_id"]) == doc.tolist()
    assert all(list(r.ats) == [r.doc_id % 9] and list(r.ns) == [3] and list(r.keys) == [(2 << 32) + 5] for r in back.itertuples())


def test_hash_compared_sort_sorts_suffixes():
    rng = random.Random(2)
    block = bytes(rng.choice(b"ab") for _ in range(60))
    data = np.frombuffer(b"".join(block if rng.random() < 0.5 else bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(40)) + bytes(60), np.uint8)
    starts = np.arange(0, 2400)
    group = starts % 3
    order, same = suffix_dedup.hash_compared_sort(data, starts, group)
    raw = data.tobytes()
    keys = [(int(group[i]), raw[i : i + 50]) for i in range(2400)]
    assert [keys[i] for i in order] == sorted(keys)
    assert same.tolist() == [k > 0 and keys[order[k]] == keys[order[k - 1]] for k in range(2400)]


# --- pipeline


def test_pipeline(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, small)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == columns
    assert seen["language_id"].count() == spark.read.parquet(f"{small}/documents.parquet").count()
    classes = near_dedup.near_classes(seen["near_dedup"])
    assert classes.where("class_id <> doc_id").count() == 0
    assert decontaminate.contaminated(seen["decontaminate"], spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0
    assert sorted(map(tuple, pipeline.run(spark, small).select("doc_id", "shard").collect())) == sorted(map(tuple, docs.select("doc_id", "shard").collect()))


def test_pipeline_on_odd_and_empty_rows(spark, odd, small, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    taught = spark.read.parquet(f"{small}/documents.parquet").withColumn("shard", F.lit("own"))
    mixed = taught.unionByName(odd.select("doc_id", "text"), allowMissingColumns=True)
    for name, docs, items in (("odd", mixed, bench), ("no_items", mixed, bench.limit(0)), ("empty", taught.limit(0), bench)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = pipeline.run(spark, f"{tmp_path}/{name}")
        assert set(taught.columns) <= set(out.columns) and dict(out.dtypes)["shard"] == "int"
        got = out.select("doc_id", "text", "shard", "slot").collect()
        assert (len(got) == 0) == (name == "empty")
        assert all(r.text and r.text.strip() for r in got)
        texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        assert {(r.doc_id, r.text) for r in got} <= texts
        for shard in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
