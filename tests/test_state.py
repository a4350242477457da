"""State in buckets: stream state, snapshots, groups; and the segmented scan over folders."""

import os
import random
from pathlib import Path

from pyspark.sql import functions as F

from curatrix.operators import documents, listing, portable, review
from curatrix.operators.digest_tree import DigestTree
from curatrix.plans.fixtures import view
from curatrix.streaming import listing_stream
from curatrix.streaming.listing_stream import LISTING, RECORDED, compact, fold_listing, manifest, read_state


def clock(n):
    return f"2024-01-{n + 1:02d} 00:00:00"


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*[c.split()[0] for c in RECORDED.split(", ")]).collect()), key=repr)


def scans(seed, batches):
    """Listings of three roots; each batch holds one or two, with files new, changed, gone and back."""
    rng = random.Random(seed)
    state = {r: {f"d{i % 12}/{i}.jpg": [i, None] for i in range(60)} for r in ("r0", "r1", "r2")}
    for n in range(batches):
        roots = rng.sample(sorted(state), rng.choice((1, 2))) if n else sorted(state)
        for r in roots:
            for _ in range(3):
                name = f"d{rng.randrange(12)}/{rng.randrange(70)}.jpg"
                kind = rng.randrange(3)
                if kind == 0:
                    state[r].pop(name, None)
                else:
                    state[r][name] = [rng.randrange(5), rng.choice([None, "h1", "h2"])]
        yield [(r, p, False, s, None, h) for r in roots for p, (s, h) in state[r].items()]


def test_stream_state_is_that_of_whole_scans(spark, tmp_path):
    state, fold, plain = str(tmp_path / "s"), fold_listing(str(tmp_path / "s"), clock, buckets=16), spark.createDataFrame([], RECORDED)
    for n, rows in enumerate(scans(3, 6)):
        batch = spark.createDataFrame(rows, LISTING)
        fold(batch, n)
        roots = sorted({r[0] for r in rows})
        mine = F.col("root_id").isin(roots)
        after = plain.where(~mine).unionByName(listing.apply_listing(plain.where(mine), batch, F.lit(clock(n)).cast("timestamp")))
        plain = spark.createDataFrame(after.collect(), RECORDED)
        assert rows_of(read_state(spark, state)) == rows_of(plain)
        if n == 3:  # run again: the same state
            fold(batch, n)
            assert rows_of(read_state(spark, state)) == rows_of(plain)
    assert compact(spark, state) > 0
    assert rows_of(read_state(spark, state)) == rows_of(plain)
    assert compact(spark, state) == 0
    fold(batch, n)
    assert rows_of(read_state(spark, state)) == rows_of(plain)


def test_a_batch_writes_only_what_it_changes(spark, tmp_path):
    state = str(tmp_path / "s")
    fold = fold_listing(state, clock, buckets=32)
    rows = [("r", f"d{i % 200}/{i}.jpg", False, i, None, None) for i in range(2000)]
    fold(spark.createDataFrame(rows, LISTING), 0)
    fold(spark.createDataFrame(rows, LISTING), 1)
    assert not os.path.exists(f"{state}/batch=1")  # nothing changed, only the scan's time moved
    assert read_state(spark, state).where("last_seen < '2024-01-02'").count() == 0
    fold(spark.createDataFrame([(*rows[0][:3], 9999, None, None), *rows[1:]], LISTING), 2)
    assert [n for n in manifest(spark, state, 2)["buckets"].values()].count(2) == 1
    size = lambda at: sum(f.stat().st_size for f in Path(at).rglob("*.parquet"))
    assert size(f"{state}/batch=2") < 0.15 * size(f"{state}/batch=0")
    assert read_state(spark, state, 1).where("size = 9999").count() == 0 and read_state(spark, state).where("size = 9999").count() == 1
    assert listing_stream.read_state(spark, str(tmp_path / "nothing")).count() == 0


def test_a_changed_row_rewrites_one_bucket(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.createDataFrame([("r", f"f{i}", f"id{i}", "NEW", i) for i in range(500)], "root string, folder string, identity string, status string, n int")
    roots = spark.createDataFrame([("x", "y")], "identity string, name string")
    assert portable.publish_snapshot({"row_states": rows, "roots": roots}, base, 0) == ("published", 1)
    changed = rows.withColumn("status", F.when(F.col("n") == 7, "DONE").otherwise(F.col("status")))
    assert portable.publish_snapshot({"row_states": changed, "roots": roots}, base, 1) == ("published", 2)
    assert len(list(Path(f"{base}/gen=2").rglob("__bucket=*"))) == 1 and not os.path.exists(f"{base}/gen=2/roots")
    tables, n = portable.load_snapshot(spark, base)
    assert n == 2 and tables["row_states"].exceptAll(changed).count() == 0 == changed.exceptAll(tables["row_states"]).count() and tables["roots"].count() == 1
    diff = portable.diff_generations(spark, base, "row_states", 1, 2)
    assert sorted((r.n, r.status, r.change) for r in diff.collect()) == [(7, "DONE", "added"), (7, "NEW", "removed")]
    fewer = changed.where("n <> 9")
    assert portable.publish_snapshot({"row_states": fewer, "roots": roots.limit(0)}, base, 2) == ("published", 3)
    tables, _ = portable.load_snapshot(spark, base)
    assert tables["row_states"].count() == 499 and tables["roots"].count() == 0 and tables["roots"].columns == roots.columns
    assert portable.publish_snapshot({"row_states": fewer.repartition(3), "roots": roots.limit(0)}, base, 3) == ("unchanged", 3)
    wider = fewer.withColumn("more", F.lit("z"))
    assert portable.publish_snapshot({"row_states": wider, "roots": roots}, base, 3) == ("published", 4)
    assert portable.load_snapshot(spark, base)[0]["row_states"].where("more = 'z'").count() == 499


def test_trees_are_compared_only_where_they_differ():
    leaves = {b: f"d{b}" for b in range(4096)}
    tree = DigestTree(leaves, 4096)
    assert tree.differing(DigestTree(dict(leaves), 4096)) == ([], 1)
    other = DigestTree({b: d for b, d in leaves.items() if b != 77} | {1000: "new"}, 4096)
    found, looked = tree.differing(other)
    assert found == [77, 1000] and looked < 100
    assert DigestTree({}, 64).differing(DigestTree({5: "x"}, 64))[0] == [5]
    assert DigestTree({0: "a"}, 1).differing(DigestTree({0: "b"}, 1))[0] == [0]


def test_groups_that_vanish_are_found_and_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"a/{g}=x y", i, str(i)) for g in range(4) for i in range(3)], "folder string, ord int, v string")
    none = rows.limit(0).select("folder", F.col("v").alias("signature"))
    stored = review.write_if_changed(rows, none, path, ["folder"], ["ord"], ["v"])
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    fewer = rows.where("folder <> 'a/2=x y'").withColumn("v", F.when(F.col("folder") == "a/1=x y", "new").otherwise(F.col("v")))
    assert [r.folder for r in review.vanished_groups(fewer, stored, ["folder"]).collect()] == ["a/2=x y"]
    after = review.write_if_changed(fewer, stored, path, ["folder"], ["ord"], ["v"])
    assert {r.folder for r in after.collect()} == {"a/0=x y", "a/1=x y", "a/3=x y"}
    held = spark.read.parquet(path).select(*fewer.columns)
    assert held.exceptAll(fewer).count() == 0 == fewer.exceptAll(held).count()


def test_segmented_scan_of_a_giant_folder(spark, small):
    """One folder of all paragraphs in many blocks, and small folders that share blocks: as one window per folder."""
    paragraphs, photos = (view(spark, small, n) for n in ("fx_paragraphs", "fx_photos"))
    one = paragraphs.withColumn("folder", F.when(F.col("pos") % 5 == 0, F.col("folder")).otherwise("giant"))
    shots = photos.unionByName(photos.withColumn("folder", F.lit("giant")).distinct())
    keep = lambda df: sorted(map(str, df.collect()))
    want = keep(documents.group_entries(one, shots, pieces=1))
    assert len(want) > 100
    for pieces in (3, 40):
        assert keep(documents.group_entries(one, shots, pieces=pieces)) == want
    blocks = documents.in_blocks(documents.classify_paragraphs(one, shots), ["folder"], [F.col("pos")], "block", 40)
    sizes = [r["count"] for r in blocks.where("folder = 'giant'").groupBy("block").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_near_pairs_with_hot_bands(spark):
    """Blank pictures share whole bands; small limits make them hot; all distances up to 11 as by comparing all pairs."""
    from curatrix.operators import similarity

    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(160)]  # nearly blank
    prints += [(0xFFFF << 48) | rng.getrandbits(20) for _ in range(60)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints[:40]]
    rows = [(f"p{i:04d}", f"{p & (1 << 64) - 1:016x}") for i, p in enumerate(prints)] + [("none", None), ("p9999", f"{prints[0]:016x}")]
    df = spark.createDataFrame(rows, "photo_id string, image_fingerprint string")
    least = {}
    for i, h in rows:
        if h:
            least[h] = min(least.get(h, i), i)
    ids = sorted((i, int(h, 16)) for h, i in least.items())
    every = {(a, b): (x ^ y).bit_count() for n, (a, x) in enumerate(ids) for b, y in ids[n + 1 :]}
    for limit, hot in ((3, 10), (7, 10), (7, 10**9), (11, 10)):
        got = [(r.a, r.b, r.distance) for r in similarity.near_pairs(df, limit, hot).collect()]
        assert sorted(got) == sorted((*ab, d) for ab, d in every.items() if d <= limit)
    for limit in (7, 11):
        want = []
        for a, _ in ids:
            near = sorted((d, b if x == a else x) for (x, b), d in every.items() if a in (x, b) and d <= limit)[:5]
            want += [(a, b, d, n) for n, (d, b) in enumerate(near, 1)]
        assert sorted(tuple(r) for r in similarity.rank_similar(df, 5, limit).select("a", "b", "distance", "rank").collect()) == sorted(want)


def test_only_changed_baselines_are_written(spark, tmp_path):
    path = str(tmp_path / "base")
    rows = spark.createDataFrame([(a, f"r{i}", str(i)) for a in ("a", "b", "c") for i in range(3)], "artifact string, record_id string, value string")
    assert portable.save_baseline(rows, path) == ["a", "b", "c"]
    stamp = lambda a: sorted(f.name for f in Path(path).rglob(f"artifact={a}/*.parquet"))
    before = {a: stamp(a) for a in "abc"}
    assert portable.save_baseline(rows.repartition(5), path) == []
    changed = rows.where("artifact <> 'c'").withColumn("value", F.when(F.col("artifact") == "b", F.lit("new")).otherwise(F.col("value")))
    assert portable.save_baseline(changed, path) == ["b"]
    assert stamp("a") == before["a"] and stamp("c") == before["c"] and stamp("b") != before["b"]
    assert {r.value for r in portable.load_baseline(spark, path, "b").collect()} == {"new"}
    assert portable.load_baseline(spark, path, "c").count() == 3
    assert portable.save_baseline(rows.where("artifact = 'b'"), path) == ["b"]
