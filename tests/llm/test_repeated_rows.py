"""Repeated ids, equal rows, zero bytes and huge numbers in the training-data operators."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("curatrix.llm")

from curatrix.llm import mixing, mtree, near_dedup, sharding, token_store  # noqa: E402


def test_zero_bytes_give_the_tokens_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    texts = ["\x00", "a\x00", "a", "\"\x00", "\x00\x00", "abc\x00def", "sixteen-bytes-xx\x00", "a" * 20 + "\x00", "a" * 20, "x" * 16, "x" * 16 + "\x00"]
    texts += ["".join(rng.choice(["\x00", "a", "B", "1", ".", " ", "\n", "é", "\x01", "\x7f"]) for _ in range(rng.randrange(1, 24))) for _ in range(40_000)]
    texts += [chr(i) + tail for i in range(0x80) for tail in ("", "a", "\x00", " \x00b", "\x00" * 17)]
    want = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    encoder = token_store.Encoder(path, cache=5_000)
    for at in range(0, len(texts), 400):
        got = encoder([t.encode() for t in texts[at : at + 400]])
        assert [t for t, g, w in zip(texts[at : at + 400], got, want[at : at + 400], strict=True) if g.tolist() != w.ids] == []


def test_a_document_with_two_texts_links_the_neighbours_of_both(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    t1, t2 = words("alpha", 80), words("beta", 80)
    rows = [(1, t1), (1, t2), (2, t2 + " end"), (3, t1 + " end"), (4, words("gamma", 80)), (5, words("delta", 60)), (6, words("delta", 60)), (6, words("eps", 60)), (7, words("eps", 60) + " x"), (0, words("zeta", 9))]
    for turn in (1, 5):
        got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(turn)).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5}


def test_repeated_ids_in_a_large_bucket(spark):
    """Near families of which members share ids: one class each, whatever the order."""
    base = [f"w{i}" for i in range(120)]
    family = lambda shift, k: " ".join([f"{shift}-{w}" for w in base[:-1]] + [f"last{k}"])
    rows = [(100 + k // 2, family("a", k)) for k in range(24)] + [(200 + k, family("b", k)) for k in range(12)] + [(200, family("c", 0)), (300, family("c", 1))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {v for k, v in got.items() if k < 200} == {100}
    assert {v for k, v in got.items() if k >= 200} == {200}


def test_equal_rows_are_spread_over_the_shards(spark):
    rows = [(7, "the very same row")] * 4000 + [(None, "nameless")] * 3000 + [(1000 + i, f"text {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.assign_shards(df).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(out) == len(rows) and len(loads) == 8
    assert loads.max() - loads.min() <= 0.02 * loads.mean()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (out[out["doc_id"] >= 1000].groupby("text")["shard"].nunique() == 1).all()
    keys = sharding.shard_keys(df.select(sharding._hash().alias("__h"), sharding._tie().alias("__tie"), sharding._size().alias("__size")))
    assert len(sharding._draw(keys, 1, 10**9, 1)) == 402  # however often a row is repeated, it is drawn once


def test_the_mix_is_the_same_under_any_partitioning(spark):
    rows = [(3, f"word{i % 7} and more", "a", f"lang{i}") for i in range(60)] + [(None, f"no id {i % 5}", "b", str(i)) for i in range(60)] + [(9, "same same", "c", "x")] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    one, other = (sorted(map(tuple, mixing.emit(df.repartition(n)).collect()), key=repr) for n in (1, 7))
    assert one == other
    assert mixing.mix(df.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))).count() == len(rows)


def test_vectors_beyond_64_bits_take_no_part(spark):
    rows = [(20, [1.0, 2.0]), (1, [1e300, 0.0]), (2, [-4e9, 1e9]), (3, [1e6, -1e6]), (4, [0.5, 0.5]), (40, [1e18, 1e18]), (60, [1e7, 1e7])]
    got = [tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    kept = {i: [int(64 * x) for x in v] for i, v in rows if max(map(abs, v)) < 1e9 / 64 * 32}
    want = []
    for q in (20, 60):
        scores = sorted((-sum(a * b for a, b in zip(kept[q], kept[v], strict=True)), v) for v in kept if v != q)
        want += [(q, k, v, -s) for k, (s, v) in enumerate(scores, 1)]
    assert got == want
