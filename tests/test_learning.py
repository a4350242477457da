"""Learning in the order of rows, against a plain row-by-row run."""

import random
import re
from collections import defaultdict

import pytest

from curatrix.functions import text
from curatrix.operators import learning
from curatrix.plans.fixtures import view
from curatrix.plans.queries import QUERIES


def norm(s):
    return " ".join(s.split()).lower()


def spans(haystack, phrases):
    """Claimed spans, longest phrase first."""
    low, claimed = haystack.lower(), []
    for phrase in sorted(set(phrases), key=lambda p: (-len(p), p)):
        needle, at = phrase.lower().strip(), -1
        while needle and (at := low.find(needle, at + 1)) >= 0:
            end = at + len(needle)
            edges = (low[at - 1 : at] if at else "") + " " + low[end : end + 1]
            if not re.search(r"\w", edges) and all(at >= d or end <= c for c, d in claimed):
                claimed.append((at, end))
    return claimed


def chunks_of(source):
    out = []
    for part in re.split("[.!?]", source):
        part = part.strip(" \t,;:-–—()")
        words = part.split()
        if len(part) >= 3 and words and len(words) <= text.MAX_ALIAS_WORDS and not words[0][0].isdigit():
            out.append(part)
    return out


def row_by_row(rows, start):
    """(entity_type, canonical, alias, reason, ord): one row after the other, each seeing what the rows before have left."""
    active = defaultdict(set)  # entity type -> phrases that match
    resolves, aliases, learned = {}, set(), []
    for kind, canonical, phrase, status in start:
        aliases.add((kind, canonical, phrase))
        if status != "REJECTED":
            active[kind].add(phrase)
        if status == "CONFIRMED":
            key = (kind, norm(phrase))
            resolves[key] = min(resolves.get(key, canonical), canonical)
    for r in sorted(rows, key=lambda r: r["ord"]):
        if r["status"] in ("ERROR", "SKIP") or not any((r[c] or "").strip() for c in ("people", "place", "tags", "latlon")):
            continue
        values = []
        for kind, cell in (("person", r["people"]), ("tag", r["tags"])):
            values += [(kind, v.strip()) for v in re.split("[;,]", cell or "") if v.strip()]
        if (r["place"] or "").strip():
            values.append(("place", r["place"].strip()))
        seen, later = {k: set(v) for k, v in active.items()}, []
        taught = []
        for kind, value in values:
            key = (kind, norm(value))
            if key not in resolves:
                same = min(v for k, v in values if (k, norm(v)) == key)  # of a row's spellings of one new name the least
                resolves[key] = same
                later.append((kind, same))
            if (kind, resolves[key]) not in taught:
                taught.append((kind, resolves[key]))
        source = (r["source_description"] or "").strip()
        for kind, canonical in taught:
            if not source or norm(canonical) in norm(source):
                continue
            claimed = {norm(source[a:b]) for a, b in spans(source, seen.get(kind, ()))}
            free = [c for c in chunks_of(source) if norm(c) and norm(c) not in claimed and not any(spans(c, ps) for other, ps in seen.items() if other != kind)]
            lone = len(free) == 1 and not {w.strip(" .,;:()").lower() for w in free[0].split()} & set(text.KINSHIP)
            for c in free:
                if (kind, canonical, c) not in aliases:
                    aliases.add((kind, canonical, c))
                    active[kind].add(c)
                    learned.append((kind, canonical, c, "APPROVED_VS_SOURCE" if lone else "FUZZY_CANDIDATE", r["ord"]))
        for kind, canonical in later:
            active[kind].add(canonical)
    return sorted(learned)


def learned_by_spark(rows, start):
    none = rows.selectExpr("'' AS entity_id", "'' AS canonical", "'' AS latlon").limit(0)
    out = learning.learn_from_rows(rows, start, none)["aliases"]
    return sorted(tuple(r) for r in out.select("entity_type", "canonical", "alias", "reason", "ord").collect())


def test_learning_in_order_on_the_tables(spark, small):
    rows, start = view(spark, small, "fx_learn_rows").limit(700), view(spark, small, "fx_learn_start")
    plain = [r.asDict() for r in rows.collect()]
    rows = spark.createDataFrame(plain, rows.schema)
    want = row_by_row(plain, [tuple(r) for r in start.select("entity_type", "canonical", "phrase", "status").collect()])
    got = learned_by_spark(rows, start)
    assert len(want) > 20 and got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_learning_in_order_on_overlapping_texts(spark, seed):
    """Few words, so aliases of earlier rows stand in later texts, inside each other and across types, in long chains."""
    rng = random.Random(seed)
    words = ["Olga", "garden", "river", "old", "house", "Mama", "near"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    pick = lambda *values: rng.choice(values)
    rows = [
        (k, "r", "f", str(k), pick("NEW", "NEW", "NEW", "SKIP"), pick("", "Anna", "Anna; boris", "BORIS", some(3)), pick("", "Dacha", "Moscow", some(3)), pick("", "trip", "trip, feast", some(2)), "",
         pick("", *[". ".join(some(5) for _ in range(rng.randrange(1, 4))) for _ in range(9)]))
        for k in range(120)
    ]
    df = spark.createDataFrame(rows, "ord long, root string, folder string, reference string, status string, people string, place string, tags string, latlon string, source_description string")
    start = [("person", "Anna", "Anna", "CONFIRMED"), ("place", "Dacha", "Dacha", "CONFIRMED"), ("place", "Dacha", "old house", "CANDIDATE"), ("place", "Dacha", "river", "REJECTED"), ("tag", "trip", "garden river", "CONFIRMED")]
    dictionary = spark.createDataFrame(start, "entity_type string, canonical string, phrase string, status string")
    want = row_by_row([r.asDict() for r in df.collect()], start)
    assert len(want) > 10
    assert learned_by_spark(df, dictionary) == want
    grown = dictionary.unionByName(spark.createDataFrame([(k, c, a, "CANDIDATE") for k, c, a, _, _ in want], dictionary.schema))
    assert not set(row_by_row([r.asDict() for r in df.collect()], [tuple(r) for r in grown.collect()])) & set(want)


def test_learn_outcomes_counts_every_kind(spark, small):
    """The query once gave new entities only: aliases, coordinates (also those of places known before) and rows were left out."""
    rows = [r.asDict() for r in view(spark, small, "fx_learn_rows").collect()]
    start = [tuple(r) for r in view(spark, small, "fx_learn_start").select("entity_type", "canonical", "phrase", "status").collect()]
    taught = [r for r in sorted(rows, key=lambda r: r["ord"]) if r["status"] not in ("ERROR", "SKIP") and (r["people"] or r["place"] or r["tags"] or r["latlon"])]
    want = {"candidate_aliases": len(row_by_row(rows, start)), "contributing_rows": len(taught), "skipped_rows": len(rows) - len(taught)}
    stands, seen = {}, set()
    for r in taught:
        if r["place"] and r["latlon"] and (r["place"], r["latlon"]) not in seen:
            seen.add((r["place"], r["latlon"]))
            north = float(r["latlon"].split(",")[0])
            far = abs(north - stands.setdefault(r["place"], north)) * 111195 > 250
            kind = "latlon_conflict" if far else "latlon_unchanged" if stands[r["place"]] != north else "latlon_added"
            want[kind] = want.get(kind, 0) + 1
    got = {r.outcome: r.n for r in QUERIES["learn_outcomes"](spark, small).collect()}
    assert {k: n for k, n in got.items() if not k.startswith("new_")} == want and len(want) == 6
    assert {k for k in got if k.startswith("new_")} == {"new_person", "new_place", "new_tag"}


def test_rows_fall_into_classes(spark, monkeypatch):
    """Many rows with one text are decided by their first one: the tables of a turn once grew with the rows."""
    from pyspark.sql import functions as F

    sizes, plain = {}, learning.written

    def counted(df, tag):
        out = plain(df, tag)
        sizes[tag] = max(sizes.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(learning, "written", counted)
    rows = spark.range(600).select(F.col("id").alias("ord"), F.concat(F.lit("Aunt Olga "), F.col("id") % 3, F.lit(". In the garden")).alias("source_description"), F.lit("NEW").alias("status"),
        F.concat(F.lit("Person "), F.col("id") % 2).alias("people"), F.lit("").alias("place"), F.lit("").alias("tags"), F.lit("").alias("latlon"), F.lit("").alias("root"), F.lit("").alias("folder"), F.lit("").alias("reference"))
    start = spark.createDataFrame([("person", f"Person {k}", f"Person {k}", "CONFIRMED") for k in range(2)], "entity_type string, canonical string, phrase string, status string")
    got = learning.learn_aliases(rows, learning.taught_values(rows), start).collect()
    want = row_by_row([r.asDict() for r in rows.collect()], [tuple(r) for r in start.collect()])
    assert sorted((r.entity_type, r.canonical, r.alias, r.reason, r.ord) for r in got) == sorted(want)
    assert max(sizes[t] for t in ("offers", "found", "taken")) <= 40
