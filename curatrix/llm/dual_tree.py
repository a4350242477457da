"""Ranked lexical search for many queries at once, by a dual tree.

A score is a sum over the query's terms of a whole weight times a whole gain of the term
in the document, so it is an inner product of sparse vectors without negative entries.
Queries ("items") and documents each form a hierarchy whose nodes hold the largest entry
of each coordinate below them. The product of two nodes' maxima bounds every score below
the pair. Pairs of nodes wait in a queue, highest bound first; a pair whose bound lies
under the weakest k-th score of the items below it is dropped with all its documents and
items, which loses nothing. All numbers are whole, and sums that may exceed what floating
point holds exactly are done in 64-bit integers.

Spark reads the texts once, keeps the terms that items hold, and counts what the formula
needs over all documents. Documents are dealt by the two terms that may gain most in
them, so that a node's documents are alike; each task builds trees of a bounded number of
documents and searches them one after the other, with the scores found so far. Items go
to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

K = 10
#: Documents in a tree, in a leaf, and children of a node; items in a leaf.
DOC_TREE, DOC_LEAF, FANOUT, ITEM_LEAF = 4_096, 32, 8, 8
#: Items of one block, and distinct terms of its items one by one: both bound what is broadcast and the width of nodes.
ITEM_BLOCK, BLOCK_TERMS = 256, 32_768
#: Documents dealt to one task, about.
TASK_DOCS = 8_192
#: Whole numbers up to this are exact as floating point.
EXACT = float(1 << 53)

#: ASCII letters and digits and all bytes of other letters stay (A-Z lower-cased), the rest are gaps.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Terms of UTF-8 bytes: maximal runs without ASCII signs, only A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def gains(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of weight gains: ``tf`` occurrences in a document of ``n`` terms."""
    m = 25 + (75 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """Nodes over rows ``0..rows-1`` in order; level 0 are the leaves. ``maxima[level][node]`` is
    the largest entry of each coordinate below the node."""

    def __init__(self, start: np.ndarray, coordinate: np.ndarray, value: np.ndarray, width: int, leaf: int) -> None:
        self.rows, self.leaf = len(start) - 1, leaf
        at = np.repeat(np.arange(self.rows) // leaf, np.diff(start)) * width + coordinate
        lowest = np.zeros((-(-self.rows // leaf)) * width)
        np.maximum.at(lowest, at, value)
        self.maxima = [lowest.reshape(-1, width)]
        while len(self.maxima[-1]) > 1:
            below = self.maxima[-1]
            self.maxima.append(np.maximum.reduceat(below, np.arange(0, len(below), FANOUT), axis=0))

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.maxima[level - 1])))

    def below(self, level: int, node: int) -> tuple[int, int]:
        """First row and last row + 1."""
        size = self.leaf * FANOUT**level
        return node * size, min((node + 1) * size, self.rows)


class Items:
    """A block of items as sparse rows (term numbers, whole weights) and their tree."""

    def __init__(self, ids: list[int], held: list[dict[int, int]], width: int) -> None:
        """``held``: of each item its terms' numbers with weight times repeats. Items with like terms stand side by side."""
        order = sorted(range(len(ids)), key=lambda k: (sorted(held[k], key=lambda t: (-held[k][t], t))[:2], ids[k]))
        self.ids = np.asarray([ids[k] for k in order], np.int64)
        self.dense = np.zeros((len(ids), width))
        for row, k in enumerate(order):
            self.dense[row, list(held[k])] = list(held[k].values())
        row, col = np.nonzero(self.dense)
        start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))])
        self.tree = Tree(start, col, self.dense[row, col], width, ITEM_LEAF)
        self.exact = float(self.dense.sum(axis=1).max(initial=0)) * 1e6 < EXACT  # no gain exceeds a million
        if not self.exact:
            self.dense = self.dense.astype(np.int64)


class Search:
    """The best documents found so far for each item, over any number of document trees."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        self.score = np.zeros((len(items.ids), k), np.int64)
        self.doc = np.full((len(items.ids), k), np.iinfo(np.int64).max)
        self.seen, self.scored = 0, 0  # pairs of item and document, and those whose score was computed

    def weakest(self, lo: int, hi: int) -> np.ndarray:
        """The k-th score of items ``lo`` to ``hi``; 1 where fewer were found, as scores lie above 0."""
        return np.maximum(self.score[lo:hi, -1], 1)

    def over(self, ids: np.ndarray, start: np.ndarray, coordinate: np.ndarray, gain: np.ndarray) -> None:
        """Search documents: ``ids``, and each one's terms and gains in ``start[d]:start[d + 1]``."""
        mine, tree = self.items.tree, Tree(start, coordinate, gain, self.items.dense.shape[1], DOC_LEAF)
        self.seen += len(ids) * len(self.items.ids)
        slack = 1.0 if self.items.exact else 1 + 1e-9
        top = (len(mine.maxima) - 1, len(tree.maxima) - 1)
        queue = [(-float(mine.maxima[-1][0] @ tree.maxima[-1][0]) * slack, top[0], 0, top[1], 0)]
        while queue:
            bound, a, node_a, b, node_b = heapq.heappop(queue)
            lo, hi = mine.below(a, node_a)
            if -bound < self.weakest(lo, hi).min():
                continue
            if a == 0 and b == 0:
                self._score(lo, hi, tree, node_b, ids, start, coordinate, gain)
                continue
            down_a = a > 0 and (b == 0 or a >= b)
            next_a = mine.children(a, node_a) if down_a else [node_a]
            next_b = tree.children(b, node_b) if b > 0 and not (down_a and a > b) else [node_b]
            level_a, level_b = a - down_a, b - (b > 0 and not (down_a and a > b))
            bounds = (mine.maxima[level_a][next_a] @ tree.maxima[level_b][next_b].T) * slack
            for x, na in enumerate(next_a):
                floor = self.weakest(*mine.below(level_a, na)).min()
                for y in np.flatnonzero(bounds[x] >= floor).tolist():
                    heapq.heappush(queue, (-float(bounds[x, y]), level_a, na, level_b, next_b[y]))

    def _score(self, lo: int, hi: int, tree: Tree, leaf: int, ids: np.ndarray, start: np.ndarray, coordinate: np.ndarray, gain: np.ndarray) -> None:
        first, last = tree.below(0, leaf)
        dense = self.items.dense
        slack = 1.0 if self.items.exact else 1 + 1e-9
        # items whose own bound in this leaf is too low go, then documents that none of the items' maxima lifts high enough
        rows = lo + np.flatnonzero((dense[lo:hi] @ tree.maxima[0][leaf]) * slack >= self.weakest(lo, hi))
        if not len(rows):
            return
        span = slice(start[first], start[last])
        cols, values = coordinate[span], gain[span]
        cuts, filled = start[first:last] - start[first], np.diff(start[first : last + 1]) > 0
        kind = np.float64 if self.items.exact else np.int64
        values = values.astype(kind)
        each = np.zeros((len(rows), last - first), kind)
        each[:, filled] = np.add.reduceat(dense[np.ix_(rows, cols)] * values, cuts[filled], axis=1) if filled.any() else 0
        self.scored += each.size
        each = each.astype(np.int64)
        good = each >= self.weakest(lo, hi)[rows - lo, None]
        for r in np.flatnonzero(good.any(axis=1)).tolist():
            at = np.flatnonzero(good[r])
            score, doc = np.concatenate([self.score[rows[r]], each[r, at]]), np.concatenate([self.doc[rows[r]], ids[first + at]])
            best = np.lexsort((doc, -score))[: self.k]
            self.score[rows[r]], self.doc[rows[r]] = score[best], doc[best]

    def found(self) -> pd.DataFrame:
        row, col = np.nonzero(self.score > 0)
        return pd.DataFrame({"item_id": self.items.ids[row], "doc_id": self.doc[row, col], "score": self.score[row, col]})


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): every item's terms with their number. Of several texts of one item_id the least is taken."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words, times = [], [], []
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                for term, n in Counter(terms(text)).items():
                    ids.append(item)
                    words.append(term)
                    times.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["item_id", "term", "n"])

    one = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    return one.mapInArrow(read, "item_id long, term binary, n long")


def doc_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): of each row the number of all its terms, and how often it holds those of ``numbers``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own, tfs = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                found = terms(text)
                counts = Counter(found)
                common = counts.keys() & numbers.keys()
                sizes.append(len(found))
                own.append([numbers[t] for t in common])
                tfs.append([counts[t] for t in common])
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<long>")


def _sparse(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.concatenate([[0], np.cumsum(batch["terms"].str.len())]).astype(np.int64)
    flat = [np.concatenate(batch[c].tolist()).astype(np.int64) if len(batch) else np.empty(0, np.int64) for c in ("terms", "tfs")]
    return start, *flat


def _search_block(docs: DataFrame, held: dict[int, dict[bytes, int]], k: int) -> DataFrame:
    """(item_id, doc_id, score): at least the ``k`` best documents of each item of one block."""
    numbers = {t: i for i, t in enumerate(sorted({t for counts in held.values() for t in counts}))}
    known = materialize(doc_terms(docs, numbers), "terms")
    total = known.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count("*").alias("rows")).first()
    n_docs, n_terms = total.docs, total.terms
    seen = known.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row per term of the block
    df = np.zeros(len(numbers), np.int64)
    for r in seen:
        df[r.t] = r["count"]
    weights = np.asarray([weight(n_docs, int(d)) for d in df], np.int64)
    items = Items(list(held), [{numbers[t]: int(weights[numbers[t]]) * n for t, n in counts.items()} for counts in held.values()], len(numbers))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each document's two terms of highest weight times gain."""
        for batch in batches:
            if not len(batch):
                continue
            start, cols, tf = _sparse(batch)
            size = np.diff(start)
            worth = weights[cols] * gains(tf, np.repeat(batch["n"].to_numpy(), size), n_docs, n_terms)
            row = np.repeat(np.arange(len(batch)), size)
            order = np.lexsort((cols, -worth, row))
            best = np.full((len(batch), 2), -1)
            for place in (0, 1):
                has = size > place
                best[has, place] = cols[order[start[:-1][has] + place]]
            yield batch.assign(k1=best[:, 0], k2=best[:, 1])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = Search(items, k)
        held_rows: list[pd.DataFrame] = []

        def run() -> None:
            rows = pd.concat(held_rows)
            start, cols, tf = _sparse(rows)
            now.over(rows["doc_id"].to_numpy(np.int64), start, cols, gains(tf, np.repeat(rows["n"].to_numpy(), np.diff(start)), n_docs, n_terms))
            held_rows.clear()

        for batch in batches:
            for at in range(0, len(batch), DOC_TREE):
                held_rows.append(batch.iloc[at : at + DOC_TREE])
                if sum(map(len, held_rows)) >= DOC_TREE:
                    run()
        if held_rows:
            run()
        yield now.found()

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total.rows // TASK_DOCS)
    # a document without any of the items' terms scores nothing; one without doc_id can't be named
    some = known.where((F.size("terms") > 0) & F.col("doc_id").isNotNull())
    dealt = some.mapInPandas(keyed, "doc_id long, n long, terms array<int>, tfs array<long>, k1 int, k2 int").repartitionByRange(tasks, "k1", "k2", F.xxhash64("doc_id"))
    return dealt.sortWithinPartitions("k1", "k2").select("doc_id", "n", "terms", "tfs").mapInPandas(search, "item_id long, doc_id long, score long")


def item_blocks(items: DataFrame) -> Iterator[dict[int, dict[bytes, int]]]:
    """The items with their terms, in blocks of about ``ITEM_BLOCK`` items and ``BLOCK_TERMS`` terms at most, dealt by hash;
    one block at a time is held."""
    found = materialize(item_terms(items), "items")
    size = found.agg(F.count_distinct("item_id").alias("items"), F.count("*").alias("terms")).first()
    n = max(-(-size["items"] // ITEM_BLOCK), -(-size["terms"] // BLOCK_TERMS))
    for block in range(n):
        held: dict[int, dict[bytes, int]] = {}
        for row in found.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).toLocalIterator():
            held.setdefault(row.item_id, {})[bytes(row.term)] = row.n
        if held:
            yield dict(sorted(held.items()))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): of every item (item_id, text) the ``k`` documents (doc_id, text) of highest score.

    Defined cases: null and empty texts hold no terms; items without terms or without an
    item_id have no rows; of several rows with one item_id the least text is taken; rows
    of documents count each, also those that share a doc_id, and a document without a
    doc_id counts in all statistics but is not returned; ties go to the smaller doc_id; with
    fewer scoring documents than ``k`` all are returned; empty tables give no rows; other
    columns play no part.
    """
    found = None
    for held in item_blocks(items):
        part = _search_block(docs, held, k)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir):
    from curatrix.llm.common import table

    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLE = f"""
WITH i AS (SELECT item_id, unnest({_TERMS.format("t")}) AS term FROM (SELECT item_id, min(text) AS t FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)),
q AS (SELECT item_id, term, count(*) AS qn FROM i GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS terms FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms)) AS total FROM d),
p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY r, doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, r, doc_id, CAST(sum(qn * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                                          * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM s WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
