"""Dual-tree search, k-means tree search and spelling variants against SQL and brute force, and on
nulls, empty tables, repeated rows, ties, long texts and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("curatrix.llm")

from curatrix.llm import dual_tree, kmeans_tree, spelling  # noqa: E402


def rows_in(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- ranked lexical search


def search_sql(docs, items):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    return sorted(con.sql(dual_tree.ORACLE).fetchall(), key=repr)


@pytest.fixture(scope="module")
def corpus(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{small}/benchmark.parquet")


RANKED = ["item_id", "rank", "doc_id", "score"]


def test_search_matches_sql(corpus):
    docs, items = corpus
    assert rows_in(dual_tree.rank_documents(docs, items), RANKED) == search_sql(docs, items)


def test_search_in_small_trees_and_many_blocks(corpus, monkeypatch):
    docs, items = corpus
    for name, value in {"DOC_TREE": 48, "DOC_LEAF": 4, "FANOUT": 2, "ITEM_LEAF": 2, "ITEM_BLOCK": 16, "TASK_DOCS": 60}.items():
        monkeypatch.setattr(dual_tree, name, value)
    assert rows_in(dual_tree.rank_documents(docs, items), RANKED) == search_sql(docs, items)


def test_search_odd_rows(spark):
    long = "zeta " * 30_000 + "omega"
    docs = spark.createDataFrame(
        [(None, "alpha beta"), (1, None), (2, ""), (3, "!!! ..."), (4, "Alpha BETA gamma"), (4, "alpha beta gamma"), (4, "alpha beta gamma"), (5, "alpha, beta; gamma"), (6, long), (7, "Ölfarbe ÄÖ x×y"), (8, "a\x00b alpha")],
        "doc_id long, text string",
    ).withColumns({"score": F.lit("x"), "terms": F.lit(1), "n": F.lit(2)})
    items = spark.createDataFrame(
        [(1, "alpha beta alpha"), (2, None), (3, ""), (None, "alpha"), (4, "omega zeta"), (5, "Ölfarbe x×y b"), (6, "nothing of this"), (7, "b text"), (7, "alpha"), (7, None)], "item_id long, text string"
    ).withColumn("rank", F.lit("y"))
    got = rows_in(dual_tree.rank_documents(docs, items, 10), RANKED)
    assert got == search_sql(docs, items)
    assert [r[2] for r in got if r[0] == 4] == [6]
    assert not [r for r in got if r[0] in (2, 3, 6)]
    assert dual_tree.rank_documents(docs.limit(0), items).count() == 0
    assert dual_tree.rank_documents(docs, items.limit(0)).count() == 0


def test_search_ties_go_to_the_least_doc_id_and_prune(spark):
    docs = spark.createDataFrame([(i, "same words here" if i % 3 else f"other text number {i}") for i in range(600)], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same words"), (2, "number 33")], "item_id long, text string")
    got = dual_tree.rank_documents(docs, items).orderBy("item_id", "rank").collect()
    assert [r.doc_id for r in got if r.item_id == 1] == [i for i in range(20) if i % 3][:10]
    assert [r.doc_id for r in got if r.item_id == 2][0] == 33
    assert rows_in(dual_tree.rank_documents(docs, items), RANKED) == search_sql(docs, items)


def test_pairs_of_nodes_are_pruned_without_loss():
    """Random sparse vectors in groups: far fewer pairs are scored than exist, and the best are those of brute force."""
    rng = np.random.default_rng(3)
    docs, items = [], []
    for g in range(16):
        own = np.arange(g * 20, g * 20 + 20)
        docs += [dict(zip(rng.choice(own, 6, replace=False).tolist(), rng.integers(1, 10**6, 6).tolist(), strict=True)) for _ in range(64)]
        items += [dict(zip(rng.choice(own, 4, replace=False).tolist(), rng.integers(1, 9000, 4).tolist(), strict=True)) for _ in range(8)]
    held = dual_tree.Items(list(range(len(items))), items, 320)
    search = dual_tree.Search(held, 5)
    start = np.cumsum([0, *[len(d) for d in docs]])
    search.over(np.arange(len(docs)), start, np.asarray([t for d in docs for t in d]), np.asarray([v for d in docs for v in d.values()]))
    assert search.scored < 0.2 * search.seen
    got = search.found()
    for i, item in enumerate(items):
        scores = sorted(((-sum(w * d.get(t, 0) for t, w in item.items()), k) for k, d in enumerate(docs)))[:5]
        mine = got[got["item_id"] == i].sort_values(["score", "doc_id"], ascending=[False, True])
        assert list(zip((-mine["score"]).tolist(), mine["doc_id"].tolist(), strict=True)) == [x for x in scores if x[0] < 0]


def test_scores_beyond_floating_point_stay_exact():
    items = dual_tree.Items([1], [{0: 10**12, 1: 1}], 2)
    assert not items.exact
    search = dual_tree.Search(items, 2)
    search.over(np.asarray([5, 6]), np.asarray([0, 2, 4]), np.asarray([0, 1, 0, 1]), np.asarray([999_983, 1, 999_983, 2]))
    assert search.found()[["doc_id", "score"]].values.tolist() == [[6, 999_983 * 10**12 + 2], [5, 999_983 * 10**12 + 1]]


# --- spelling variants


def brute_variants(rows, min_length=6, min_count=5, ratio=5):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}
    near = defaultdict(set)
    for w in words:
        for v in words:
            if len(w) == len(v):
                close = sum(a != b for a, b in zip(w, v, strict=True)) == 1
            else:
                short, long = sorted((w, v), key=len)
                close = len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))
            if close:
                near[w].add(v)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_matches_brute_force(corpus):
    docs, _ = corpus
    assert rows_in(spelling.spelling_variants(docs), VARIANT) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_spelling_of_random_words_in_divided_blocks(spark, monkeypatch):
    """Few letters and many words: blocks are divided, and every kind of edit and chain occurs."""
    monkeypatch.setattr(spelling, "BLOCK", 16)
    monkeypatch.setattr(spelling, "CHUNK", 24)
    rng = random.Random(5)
    words = ["".join(rng.choice("abàÿ") for _ in range(rng.choice((6, 6, 7, 8)))) for _ in range(700)]
    texts = [(i, " ".join(rng.choice(words) + "-" for _ in range(400))) for i in range(20)]
    texts += [(100 + k, "kettle " * 5 + "kettles " * 30 + "kettlesx " * 160 + "kettlesxy " * 900) for k in range(2)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words = spelling.count_words(df)
    out = spelling.variants(words, block=16)
    got = sorted(((r.w.decode("latin-1"), r.form and r.form.decode("latin-1"), r.root.decode("latin-1"), r.n, r.n_near, r.form_n) for r in out.collect()), key=repr)
    assert got == brute_variants(texts)
    assert any(len(r[2]) > len(r[1] or r[2]) for r in got)  # a chain of more than one step


def test_spelling_odd_rows(spark):
    long = "x" * 5_000
    rows = [(None, "Straße straße STRAßE strasse strasse straße straße")] * 3 + [(1, None), (2, ""), (3, "short wörd 123 ____"), (4, f"{long} " * 5), (5, f"{long}y " * 30), (6, "日本語のテキスト" * 9), (7, "can't" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "word": F.lit(1), "w": F.lit(2)})
    assert rows_in(spelling.spelling_variants(df), VARIANT) == brute_variants(rows)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(df.where("doc_id = 1")).count() == 0


# --- approximate nearest neighbours


def exact_neighbours(rows, k):
    ids, m = np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows], float)
    out = {}
    for q, v in zip(ids.tolist(), m, strict=True):
        if q % 20 == 0:
            scores = np.where(ids == q, -np.inf, (m * v).sum(axis=1))
            order = np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]
            out[q] = [(int(ids[o]), float(scores[o])) for o in order]
    return out


def measured_recall(out, want):
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len({f[0] for f in found}) == len(found) and q not in {f[0] for f in found}
    return sum(len({x[0] for x in got[q]} & {x[0] for x in want[q]}) for q in want) / sum(map(len, want.values()))


def test_neighbours_reach_the_recall(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    want = exact_neighbours([(r.vec_id, r.embedding) for r in df.collect()], 20)
    out = kmeans_tree.nearest(df).collect()
    assert measured_recall(out, want) >= 0.9
    exact = {(q, v): s for q, found in exact_neighbours([(r.vec_id, r.embedding) for r in df.collect()], 500).items() for v, s in found}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in out)


def test_neighbours_in_clusters_need_few_visits(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "SHELF_ROWS", 100)
    monkeypatch.setattr(kmeans_tree, "ASKED_ROWS", 20)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 5
    m = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 8)) * 0.2
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    visited, plain = [], kmeans_tree.calibrate
    monkeypatch.setattr(kmeans_tree, "calibrate", lambda tree, *a: visited.append((plain(tree, *a), tree.leaves)) or visited[-1][0])
    out = kmeans_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert measured_recall(out, exact_neighbours(rows, 20)) >= 0.9
    assert visited[0][0] < 0.5 * visited[0][1]


def test_best_bin_first_visits_every_leaf_once_and_the_nearest_first():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 5))
    tree = kmeans_tree.KMeansTree.fit(points, 10, branches=4)
    leaves = tree.assign(points)
    assert set(leaves.tolist()) <= set(range(tree.leaves))
    for q in rng.normal(size=(20, 5)):
        order = tree.visits(q, tree.leaves)
        assert sorted(order) == list(range(tree.leaves))
    assert np.mean([tree.visits(p, 1)[0] == leaf for p, leaf in zip(points, leaves, strict=True)]) > 0.9  # a bin beside may be nearer


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, []), (7, [1e300, 1e300]), (None, [1.0, 2.0]), (60, [1.0]), (61, [2.0])]
    good = [(20, [1.0, 0.0]), (40, [1.0, 0.0]), *[(100 + i, [1.0, 0.0]) for i in range(60)], (80, [0.5, 0.5]), (80, [0.5, 0.5]), (81, [0.25, 1.0]), (81, [3.0, 1.0])]
    df = spark.createDataFrame(odd + good, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "leaf": F.lit(1), "v": F.lit(2), "norm": F.lit(3)})
    out = kmeans_tree.nearest(df, recall=1.0).collect()
    kept = {i: v for i, v in good if i != 81} | {81: [0.25, 1.0]}
    want = exact_neighbours(sorted(kept.items()), 20)
    assert measured_recall([r for r in out if r.query_id != 60], want) == 1
    assert [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == 140), key=lambda r: r["rank"])] == want[140]
    assert [(r.query_id, r.vec_id, r.score) for r in out if r.query_id == 60] == [(60, 61, 2.0)]
    assert kmeans_tree.nearest(df.limit(0)).count() == 0
    assert kmeans_tree.nearest(df.where("vec_id < 6")).count() == 0
