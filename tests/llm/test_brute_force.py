"""Scores of the quality classifier by plain loops, and the pipeline's rows stage by stage by brute force."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("curatrix.llm")

from curatrix.llm import decontaminate, mixing, quality  # noqa: E402
from tests.llm.test_llm_operators import brute_classes  # noqa: E402


def plain_score(text, model):
    """Bias, single inputs and all pairs of inputs, one by one, over hashed words and binned statistics."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    kind = quality._classes()
    seen = Counter(int(kind[ord(c)]) for c in text)
    chars, n, letters = max(1, len(text)), max(1, len(words)), max(1, seen[1] + seen[2])
    stats = [
        min(1, math.log1p(chars) / 14), min(1, math.log1p(n) / 12), seen[2] / letters, min(1, 4 * seen[6] / chars), min(1, 4 * seen[3] / chars), min(1, 2 * seen[4] / chars), min(1, 10 * (seen[5] + 1) / n),
        len(counts) / n, max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(not w[-1].isalnum() for w in words) / n,
        sum(not any(c.isalnum() for c in w) for w in words) / n, min(1, letters / n / 16), min(1, 4 * seen[0] / chars),
    ]
    inputs = [((1 << quality.WORD_BITS) + k * quality.BINS + min(int(s * quality.BINS), quality.BINS - 1), 0.5) for k, s in enumerate(stats)]
    norm = math.sqrt(sum(math.log1p(v) ** 2 for v in counts.values())) or 1.0
    inputs += [(zlib.crc32(w.encode()) % (1 << quality.WORD_BITS), math.log1p(v) / norm) for w, v in counts.items()]
    total = model.bias + sum(float(model.linear[i]) * x for i, x in inputs)
    for a, (i, x) in enumerate(inputs):
        for j, y in inputs[:a]:
            total += sum(float(p) * float(q) for p, q in zip(model.factors[i], model.factors[j], strict=True)) * x * y
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_quality_scores_against_plain_loops(spark, small, monkeypatch):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    models, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda *a: models.append(train(*a)) or models[-1])
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a a a !!! 12 Ünï\n\n日本"), (-4, "word " * 300)], "doc_id long, text string")
    texts = docs.select("doc_id", "text").where(F.length("text") < 900).unionByName(odd)
    got = {r.doc_id: r for r in quality.classify(texts, labels).collect()}
    some = sorted(texts.collect(), key=lambda r: r.doc_id)[:24]
    for r in some:
        assert got[r.doc_id].score == pytest.approx(plain_score(r.text, models[0]), abs=1e-5)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pipeline_against_brute_force(spark, small, tmp_path):
    """Kept documents, copies, sizes and slots of ``run``: letters, all pairs, item windows, SQL and counting."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = [(10_000 + i, t) for i, t in enumerate(("12 34 !!", "", None, "9" * 50))]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    classes = brute_classes(sorted((r.doc_id, r.text) for r in rows))
    rows = [r for r in rows if classes[r.doc_id] == r.doc_id]
    left = spark.createDataFrame(rows, docs.schema)
    dirty = {r.doc_id for r in decontaminate.contaminated(left, items).collect()}
    words = lambda t: "".join(c if c.isalnum() else " " for c in t).split()
    held = lambda item, text: f" {' '.join(words(item))} " in f" {' '.join(words(text))} "
    assert {r.doc_id for r in rows if any(held(i.text, r.text) for i in items.collect())} <= dirty  # whole items are found at least
    rows = [r for r in rows if r.doc_id not in dirty]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, docs.schema).toArrow())
    taken = {r[0]: round(r[1] / r[2]) if r[2] else 0 for r in con.sql(f"SELECT doc_id, taken, size FROM ({mixing.ORACLE})").fetchall()}
    want = Counter({d: n for d, n in taken.items() if n})
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == want
    texts = {r.doc_id: r.text for r in rows}
    loads, slots = Counter(), {}
    for r in out:
        assert (r.text, r["size"], r.text_crc32) == (texts[r.doc_id], len(r.text.encode()) + 1, zlib.crc32(r.text.encode()))
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) <= max(n * (len(texts[d].encode()) + 1) for d, n in want.items()) + 0.02 * np.mean(list(loads.values()))
