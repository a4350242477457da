"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its shingles of five words, each weighted by how
often it occurs. Every element owns the region (0, weight] x [0, inf) of weight and
rank; hashing throws the same darts into it whatever document it is in. A
document's signature keeps, for each coordinate, the dart of least rank in its
region, so two documents agree on a coordinate with probability equal to their
weighted Jaccard similarity. Bands of the signature find candidates, and every
candidate pair is verified on the full shingle multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

WORDS = 5
SIMILARITY = 0.8
#: 16 bands of 4: a pair at 0.8 shares a band with probability 0.9998.
COORDINATES, BAND_ROWS = 64, 4
#: Buckets of so many different texts at most are compared in full.
FULL_BUCKET = 8
#: A shingle that more texts hold is joined over one more salt for each so many.
SALT_ROWS = 2_000
#: Rank cells: [0, 2^BASE), doublings up to 1, then cells of width 1.
BASE = -10
_CACHE_WORDS = 200_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix constants), vectorised."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _cells(limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the rank cells below ``limit``."""
    ends = [0.0, *(2.0**k for k in range(BASE, 1))]
    while ends[-1] < limit:
        ends.append(ends[-1] + 1.0)
    upper = np.asarray(ends[1:])
    n = int(np.searchsorted(upper, limit)) + 1
    return np.asarray(ends[:-1])[:n], upper[:n]


def throw_darts(elements: np.ndarray, weights: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ranks) of the darts of rank below ``limit`` in the document's region.

    ``elements``: distinct 64-bit hashes; ``weights`` > 0. Each unit of weight and
    each rank cell holds a Poisson number of darts, drawn by hashing the element,
    the unit and the cell; a dart in the last, partial unit counts if its weight
    coordinate is below the element's weight.
    """
    units = np.ceil(weights).astype(np.int64)
    whole = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(whole)) - np.repeat(np.cumsum(units) - units, units)
    with np.errstate(over="ignore"):
        keys = _mix(elements[whole] + unit.astype(np.uint64) * _U(0xD1342543DE82EF95))
    part = np.minimum(1.0, weights[whole] - unit)
    low, high = _cells(limit)
    u = _mix(keys[:, None] ^ _mix(np.arange(1, len(low) + 1, dtype=np.uint64))[None, :])
    draw, area = _uniform(u), high - low
    term = np.exp(-area)[None, :] * np.ones((len(keys), 1))
    below, k, ids, ranks = term.copy(), 0, [], []
    row, cell = np.nonzero(draw >= below)
    term, below, draw, seeds = term[row, cell], below[row, cell], draw[row, cell], u[row, cell]
    while len(row):  # the cell has more than k darts
        dart = _mix(seeds + _U(2 * k + 1))
        rank = low[cell] + area[cell] * _uniform(_mix(dart ^ _U(0xA24BAED4963EE407)))
        inside = (rank < limit) & (_uniform(_mix(dart ^ _U(0x9FB21C651E98DF25))) < part[row])
        ids.append(dart[inside])
        ranks.append(rank[inside])
        k += 1
        term = term * area[cell] / k
        below = below + term
        more = (draw >= below) & (k < 64)
        row, cell, term, below, draw, seeds = row[more], cell[more], term[more], below[more], draw[more], seeds[more]
    return (np.concatenate(ids), np.concatenate(ranks)) if ids else (np.empty(0, np.uint64), np.empty(0))


def dart_signature(elements: np.ndarray, weights: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The id of the earliest dart of each coordinate. So many darts are expected that
    all coordinates are hit; if one is not, the rank limit is doubled."""
    total = float(weights.sum())
    limit = (coordinates * np.log(coordinates) + 2 * coordinates) / total
    while True:
        ids, ranks = throw_darts(elements, weights, limit)
        order = np.argsort(ranks, kind="stable")[::-1]
        out, seen = np.zeros(coordinates, np.uint64), np.zeros(coordinates, bool)
        at = (ids[order] % _U(coordinates)).astype(np.int64)
        out[at], seen[at] = ids[order], True  # of equal places the last, earliest, one stays
        if seen.all():
            return out
        limit *= 2


class Shingler:
    """Text -> sorted 64-bit hashes of its word 5-grams, with repeats. Words are runs
    between white space, lower-cased; a text of 1 to 4 words is one shingle."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        cache = self.cache
        if len(cache) > _CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(WORDS, len(h))
        with np.errstate(over="ignore"):
            acc = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                acc = acc * _U(0x9E3779B97F4A7C15) + _mix(h[k : len(h) - n + 1 + k])
        return np.sort(_mix(acc))


def _runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


def sketch(docs: DataFrame, coordinates: int = COORDINATES, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n, k1, k2, bands): number of shingles, digest of the shingle multiset,
    and one hash per band; bands is null for texts without words."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text)
                if not len(s):
                    rows.append((doc, 0, 0, 0, None))
                    continue
                elements, counts = _runs(s)
                sig = dart_signature(elements, counts.astype(np.float64), coordinates)
                bands = [xxhash.xxh3_64_intdigest(sig[k : k + band_rows].tobytes(), seed=k) for k in range(0, coordinates, band_rows)]
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((doc, len(s), *np.asarray([digest >> 64, digest & (2**64 - 1)], np.uint64).view(np.int64).tolist(), np.asarray(bands, np.uint64).view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "k1", "k2", "bands"])

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(make, "doc_id long, n int, k1 long, k2 long, bands array<long>")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, t, elements): the multiset as distinct numbers, occurrence k of a shingle
    being an element of its own, so that set overlap is multiset overlap. ``t`` names the text."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for batch in batches:
            for k in range(0, len(batch), 500):
                some, out = batch.iloc[k : k + 500], []
                for text in some["text"]:
                    s, counts = _runs(shingles(text))
                    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    with np.errstate(over="ignore"):
                        out.append(_mix(np.repeat(s, counts) + nth.astype(np.uint64) * _U(0xD1342543DE82EF95)).view(np.int64))
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "t": some["t"].to_numpy(), "elements": out})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInPandas(make, "doc_id long, t long, elements array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The elements of all texts of the documents in ``ids`` (doc_id), written once for all rounds. The ids
    grow with the input; they are never broadcast, so every size has the same plan."""
    texts = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return materialize(_shingle_sets(texts).dropDuplicates(["doc_id", "t"]), "shingles")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of which some texts' weighted Jaccard similarity reaches ``similarity``."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    near = both >= similarity * (F.size("ea") + F.size("eb") - both) - 1e-9
    return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): least node of each connected component, for all nodes in ``edges``
    (a, b). Least labels of neighbours, then of labels (pointer jumping), until
    nothing changes; each turn is written to the shared folder."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", F.least("comp", "m").alias("new"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        step = materialize(step.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("comp")), "labels")
        labels = step.select("node", "comp")
        if step.where("comp < old").isEmpty():
            return labels


def rare_prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(rep, t, e, i, n, df): the elements that begin each set when all sets are ordered by rarity.
    A pair at ``similarity`` shares at least ``similarity * n`` elements with either set, so
    the first one they share is among the first n - ceil(similarity * n) + 1 of both.
    Elements that only one set holds join nothing and are left out."""
    flat = sets.select(F.col("doc_id").alias("rep"), "t", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    often = flat.groupBy("e").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("rep", "t").orderBy("df", "e")) - 1
    return flat.join(often.hint("merge"), "e").withColumn("i", rank).where((F.col("i") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-6)) & (F.col("df") > 1))


def _labelled(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """``prefixes`` with each text's component, less the elements that one component holds alone."""
    rows = prefixes.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = rows.groupBy("e").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("held"), F.min(F.struct("rep", "comp", "i", "n")).alias("lead")).where("c0 < c1")
    return rows.join(mixed.select("e", "held", "lead"), "e")


def _may_be_near(ni, i, nj, j, similarity: float):
    """False where a pair whose first shared element is at ``i`` and ``j`` has too little left to share."""
    return F.least(ni - i, nj - j) >= (similarity * (ni + nj) - 1e-6) / (1 + similarity)


def led_by_element(prefixes: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(x, y): each text with the least one that shares a prefix element, if of another component.
    Linear; links big families, so that the full join need not pair them."""
    c = F.col
    rows = _labelled(prefixes, labels).where(c("comp") != c("lead.comp"))
    return rows.where(_may_be_near(c("n"), c("i"), c("lead.n"), c("lead.i"), similarity)).select(c("rep").alias("x"), c("lead.rep").alias("y"))


def across_components(prefixes: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(x, y): all pairs of different components that share a prefix element and may be near.
    Elements that many texts hold are joined over salts."""
    c = F.col
    rows = _labelled(prefixes, labels).withColumn("salts", (1 + F.floor(c("held") / SALT_ROWS)).cast("int"))
    left = rows.select("e", F.pmod(F.xxhash64("rep"), c("salts")).cast("int").alias("salt"), c("rep").alias("x"), c("comp").alias("cx"), c("i").alias("ix"), c("n").alias("nx"))
    right = rows.select("e", F.explode(F.sequence(F.lit(0), c("salts") - 1)).alias("salt"), c("rep").alias("y"), c("comp").alias("cy"), c("i").alias("iy"), c("n").alias("ny"))
    met = (left["e"] == right["e"]) & (left["salt"] == right["salt"]) & (c("x") < c("y")) & (c("cx") != c("cy"))
    return left.join(right.hint("merge"), met & _may_be_near(c("nx"), c("ix"), c("ny"), c("iy"), similarity)).select("x", "y")


def same_document(sketches: DataFrame, copies: DataFrame) -> DataFrame | None:
    """(a, b): representatives of the texts of one doc_id, each with the least of them; None if no doc_id has several texts."""
    texts = sketches.where("n > 0").select("doc_id", "k1", "k2")
    least, most = ([f(k) for k in ("k1", "k2")] for f in (F.min, F.max))
    several = texts.groupBy("doc_id").agg(((least[0] < most[0]) | (least[1] < most[1])).alias("several")).where("several").select("doc_id")
    several = materialize(several, "several")
    if several.isEmpty():
        return None
    named = texts.join(several, "doc_id", "left_semi").join(copies.select("k1", "k2", "rep"), ["k1", "k2"])
    least = named.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return named.join(least, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct()


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, coordinates: int = COORDINATES, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, class_id, n_shingles) of every row: class_id is the least doc_id of its
    near-duplicate class, the connected component of verified pairs.

    Rows with equal shingle multisets collapse to the least doc_id first, so groups of
    copies are never paired. Buckets of up to ``FULL_BUCKET`` different texts are
    compared in full. In larger ones every text is compared with two leaders (least
    and greatest doc_id). The texts of buckets that then still hold several components
    are joined on their rarest shingles (``rare_prefixes``): first each with one leader
    per shingle, then all pairs of different components, so every near pair is met.

    Defined cases: null and empty texts, and texts without words, are alone in their
    class; a text of 1 to 4 words is one shingle; rows with one doc_id are one
    document (any of its texts links it); a null doc_id has a null class; an empty
    table gives an empty table; other columns play no part.
    """
    sketches = materialize(sketch(docs, coordinates, band_rows), "sketches")
    copies = sketches.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    copies = materialize(copies, "copies")
    members = copies.select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    shared = materialize(members.join(sizes, ["band", "key"]), "buckets")
    size_of = copies.groupBy("rep").agg(F.min("n").alias("n0"), F.max("n").alias("n1"))

    def candidates(pairs: DataFrame) -> DataFrame:
        """Distinct pairs in order whose sizes alone do not rule them out."""
        ordered = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        ordered = ordered.join(size_of.select(F.col("rep").alias("a"), F.col("n0").alias("a0"), F.col("n1").alias("a1")), "a")
        ordered = ordered.join(size_of.select(F.col("rep").alias("b"), F.col("n0").alias("b0"), F.col("n1").alias("b1")), "b")
        return ordered.where((F.col("a1") >= similarity * F.col("b0") - 1e-9) & (F.col("b1") >= similarity * F.col("a0") - 1e-9)).select("a", "b")

    small = shared.where(F.col("c") <= FULL_BUCKET)
    full = small.select("band", "key", F.col("rep").alias("x")).join(small.select("band", "key", F.col("rep").alias("y")), ["band", "key"]).where("x < y").select("x", "y")
    large = shared.where(F.col("c") > FULL_BUCKET)
    led = large.select(F.col("rep").alias("x"), F.explode(F.array("lo", "hi")).alias("y"))
    tried = materialize(candidates(full.union(led)), "pairs")
    sets = shingle_sets(docs, shared.select(F.col("rep").alias("doc_id")).distinct())
    own = same_document(sketches, copies)
    near = verified(tried, sets, similarity)
    edges = materialize(near if own is None else near.union(own), "links")
    labels = components(edges)
    # the exact rest: members of large buckets that still hold several components
    big = large.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = big.groupBy("band", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("band", "key")
    open_reps = materialize(big.join(mixed, ["band", "key"], "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "open")
    if not open_reps.isEmpty():
        prefixes = materialize(rare_prefixes(sets.join(open_reps.hint("merge"), "doc_id", "left_semi"), similarity), "prefixes")
        for pairs in (led_by_element, across_components):
            fresh = candidates(pairs(prefixes, labels, similarity)).join(tried, ["a", "b"], "left_anti")
            fresh = materialize(fresh, "pairs")
            found = materialize(verified(fresh, sets, similarity), "links")
            if not found.isEmpty():
                edges = edges.union(found)
                labels = components(edges)
            tried = tried.union(fresh)
    member = copies.select("k1", "k2", "rep").join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("k1", "k2", F.coalesce("comp", "rep").alias("class_id"))
    classed = sketches.join(member, ["k1", "k2"], "left").select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.col("n").alias("n_shingles"))
    return classed.union(docs.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("int")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each class stays, the one
    with the least doc_id. Same columns.

    Defined cases: rows with null doc_id all stay; null and empty texts are alone in
    their class and stay; of rows that share a doc_id the one of least text hash stays,
    then of least other columns; an empty table gives an empty table.
    """
    kept = near_classes(docs, **options).where("doc_id = class_id").select("doc_id").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.xxhash64("text"), F.to_json(F.struct(*others)) if others else F.lit(""))
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("d")).select("d.*")
    return one.union(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir):
    from curatrix.llm.common import table

    out = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "n_shingles", (F.col("doc_id") == F.col("class_id")).alias("kept"))
