"""Quality classifier: a factorisation machine.

Inputs are hashed words, structure statistics of the whole text, and length
metadata. Pairwise interactions have rank ``FACTORS``, and the sum of all of them
is had in linear time: half of (sum of v x) squared minus the sum of (v x) squared.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.language_id import fold

WORD_BITS = 14
FACTORS = 8
#: Bound on the labelled rows that the model is fitted on.
MAX_LABELLED = 6_000
THRESHOLD = 0.3
#: Gradient steps of so many rows each; a small sample is gone through more often.
STEPS, BATCH = 2_000, 64
#: Statistics are cut into bins, one input each.
BINS = 16
STATS = 14
WIDTH = (1 << WORD_BITS) + STATS * BINS
_CACHE_WORDS = 200_000


def _classes() -> np.ndarray:
    """Code point -> 0 other, 1 lower-case or caseless letter, 2 upper-case letter,
    3 digit, 4 space, 5 line end, 6 ASCII punctuation."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        ch = chr(i)
        out[i] = 2 if ch.isupper() else 1 if ch.isalpha() else 3 if ch.isdigit() else 5 if ch == "\n" else 4 if ch.isspace() else 6 if i < 128 else 0
    out[0x3000:0xD800] = 1
    return out


class Featurizer:
    """Text -> (input numbers, values). Words are hashed by CRC, so every worker agrees."""

    def __init__(self) -> None:
        self.classes = _classes()
        self.cache: dict[str, int] = {}

    def word(self, w: str) -> int:
        at = self.cache.get(w)
        if at is None:
            if len(self.cache) >= _CACHE_WORDS:
                self.cache.clear()
            at = self.cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
        return at

    def stats(self, text: str, words: list[str], counts: Counter) -> list[float]:
        """Values in 0..1, each later cut into bins."""
        c = np.bincount(self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=7)
        chars, n = max(1, len(text)), max(1, len(words))
        letters = max(1, c[1] + c[2])
        lines = c[5] + 1
        top = max(counts.values(), default=0)
        same = sum(a == b for a, b in zip(words, words[1:], strict=False)) if top > 1 else 0
        edged = sum(v for w, v in counts.items() if not w[-1].isalnum())
        bare = sum(v for w, v in counts.items() if not any(map(str.isalnum, w)))
        return [
            min(1.0, np.log1p(chars) / 14),
            min(1.0, np.log1p(n) / 12),
            c[2] / letters,
            min(1.0, 4 * c[6] / chars),
            min(1.0, 4 * c[3] / chars),
            min(1.0, c[4] / chars * 2),
            min(1.0, 10 * lines / n),
            len(counts) / n,
            top / n,
            same / n,
            edged / n,
            bare / n,
            min(1.0, letters / n / 16),
            min(1.0, 4 * c[0] / chars),
        ]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        counts = Counter(words)
        stats = np.asarray(self.stats(text, words, counts))
        binned = (1 << WORD_BITS) + np.arange(STATS) * BINS + np.minimum((stats * BINS).astype(np.int64), BINS - 1)
        hashed = np.fromiter(map(self.word, counts), np.int64, len(counts))
        tf = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        norm = np.sqrt((tf * tf).sum()) or 1.0
        return np.concatenate([binned, hashed]).astype(np.int32), np.concatenate([np.full(STATS, 0.5), tf / norm]).astype(np.float32)


def _rows(features: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *[len(i) for i, _ in features]])[:-1]
    return np.concatenate([i for i, _ in features]), np.concatenate([x for _, x in features]).astype(np.float64), starts


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((sums * sums) - np.add.reduceat(vx * vx, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + pairs, vx, sums

    def score(self, features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not features:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(*_rows(features))[0], -30, 30)))


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, rate: float = 0.05, l2: float = 1e-4, batch: int = BATCH, seed: int = 5) -> FactorisationMachine:
    """Adaptive gradient steps on the log loss. One class only, or no rows: a constant."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)))
    if len(labels) == 0 or labels.min() == labels.max():
        fm.factors[:] = 0
        return fm
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-2), np.full((WIDTH, FACTORS), 1e-2), 1e-2
    for _ in range(-(-steps * batch // len(labels))):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            at, x, starts = _rows([features[r] for r in rows])
            margin, vx, sums = fm.margin(at, x, starts)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(np.arange(len(rows)), np.diff([*starts, len(at)]))
            used, back = np.unique(at, return_inverse=True)
            gw = np.bincount(back, weights=err[each] * x, minlength=len(used)) + l2 * fm.linear[used]
            step = (err[each] * x)[:, None] * (sums[each] - vx)
            gv = np.stack([np.bincount(back, weights=step[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) + l2 * fm.factors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            fm.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            fm.factors[used] -= rate * gv / np.sqrt(seen_v[used])
            gb = err.sum()
            seen_b += gb * gb
            fm.bias -= rate * gb / np.sqrt(seen_b)
    return fm


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> FactorisationMachine:
    """Fit on at most ``max_labelled`` labelled documents, those with the least hash of
    doc_id, whose crc32(doc_id) mod 5 is not 0. Of several labels or texts of a doc_id
    the least is taken; null labels are left out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    drawn = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def features(batches):
        make = Featurizer()
        for b in batches:
            made = [make(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "at": [i for i, _ in made], "x": [x for _, x in made]})

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(drawn), "doc_id")  # at most max_labelled rows
        .groupBy("doc_id", "quality")
        .agg(F.min(F.struct(F.length("text").alias("n"), "text")).alias("t"))  # so repeated ids don't add up in the driver
        .select("doc_id", "quality", "t.text")
        .mapInPandas(features, "doc_id long, quality int, at array<int>, x array<float>")
        .toPandas()
    )
    rows = rows.sort_values("doc_id")
    return fit([(np.asarray(i), np.asarray(x)) for i, x in zip(rows["at"], rows["x"], strict=True)], rows["quality"].to_numpy(np.float64))


def score(text: Column, model: FactorisationMachine) -> Column:
    state: list[Featurizer] = []

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not state:
            state.append(Featurizer())
        out = [model.score([state[0](t) for t in texts.iloc[k : k + 500]]) for k in range(0, len(texts), 500)]
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with ``held_out``, ``score`` and ``predicted``.

    Defined cases: null or empty text is scored as an empty one; without labels, or
    with labels of one class, every score is that class's share (0.5 without any); a
    null doc_id is never trained on; repeated rows are scored each; columns named
    like the results are replaced. The score uses the text only.
    """
    model = train(docs, labels, max_labelled)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.select(*[F.col(f"`{c}`") for c in names], (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def query(spark, sf_dir):
    from curatrix.llm.common import table

    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
