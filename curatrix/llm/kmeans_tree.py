"""Approximate nearest neighbours by inner product in a hierarchical k-means tree.

Inner product is no distance, so every vector gets one more component that lifts its norm
to the largest norm, and a query gets 0 there: the nearest lifted vectors are those of
highest product. The tree is fit on a bounded sample (k-means of ``BRANCHES`` centres,
again within each cluster, down to leaves), then every vector goes to its leaf. A query
walks the tree best bin first: a priority queue holds the nodes by distance of their
centre, the nearest is opened, its children enter the queue, and leaves are visited in the
order in which they leave it.

How many leaves to visit is calibrated: for a sample of queries the true neighbours are
found by brute force over all vectors, and the number of visits is widened until the
visited leaves hold ``RECALL`` of them.

Leaves stand on shelves of a bounded number of vectors (a large leaf fills several). A
query goes once to each shelf it has leaves on, with the list of them, and leaves the best
of what it found there. Scores are computed from the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import digest128, materialize

K = 20
#: Vectors of the sample that the tree is fit on, and vectors of it in a leaf at most.
SAMPLE, LEAF_SAMPLE = 65_536, 16
#: Vectors in a leaf, about, as long as the sample allows so many leaves.
LEAF_ROWS = 64
BRANCHES, TURNS = 16, 6
#: Queries that calibrate, at most; the share of their true neighbours that visits must reach, and what a turn widens them by.
CALIBRATION, RECALL, WIDEN = 256, 0.95, 1.15
SHELF_ROWS, ASKED_ROWS, QUERY_BLOCK = 8_192, 4_096, 512
_SEED = 7


def _lift(m: np.ndarray, top: float) -> np.ndarray:
    """``m`` with the component that raises squared norms to ``top``."""
    return np.concatenate([m, np.sqrt(np.maximum(0.0, top - (m * m).sum(axis=1)))[:, None]], axis=1)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)


class KMeansTree:
    """Node 0 is the root; ``children[n]`` are the nodes below ``n``, empty for leaves, which ``leaf[n]`` numbers."""

    def __init__(self, centres: np.ndarray, children: list[np.ndarray], leaf: np.ndarray) -> None:
        self.centres, self.children, self.leaf = centres, children, leaf
        self.norms = (centres * centres).sum(axis=1)
        self.leaves = int((leaf >= 0).sum())

    @classmethod
    def fit(cls, points: np.ndarray, leaf_rows: int, branches: int = BRANCHES) -> KMeansTree:
        """K-means within k-means on (lifted) ``points`` until a cluster holds ``leaf_rows`` of them at most."""
        rng = np.random.default_rng(_SEED)
        centres, children, leaf, leaves = [points.mean(axis=0)], [np.empty(0, np.int64)], [-1], 0
        open_ = [(0, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            own = points[rows]
            cut = cls._divide(own, branches, rng) if len(rows) > leaf_rows else None
            if cut is None:
                leaf[node], leaves = leaves, leaves + 1
                continue
            below = []
            for c in range(cut.max() + 1):
                mine = rows[cut == c]
                below.append(len(centres))
                centres.append(points[mine].mean(axis=0))
                children.append(np.empty(0, np.int64))
                leaf.append(-1)
                open_.append((below[-1], mine))
            children[node] = np.asarray(below)
        return cls(np.asarray(centres), children, np.asarray(leaf))

    @staticmethod
    def _divide(own: np.ndarray, branches: int, rng: np.random.Generator) -> np.ndarray | None:
        """Cluster of each point, without empty clusters; None if the points can't be told apart."""
        centres = np.unique(own[rng.choice(len(own), min(branches, len(own)), replace=False)], axis=0)
        for _ in range(TURNS):
            at = _nearest(own, centres)
            sizes = np.bincount(at, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, at, own)
            centres = sums[sizes > 0] / sizes[sizes > 0, None]
        _, cut = np.unique(_nearest(own, centres), return_inverse=True)
        return cut if cut.max() > 0 else None

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each (lifted) point, by the nearest centre on each level."""
        node = np.zeros(len(points), np.int64)
        out = np.full(len(points), -1)
        todo = {0: np.arange(len(points))}
        while todo:
            at, rows = todo.popitem()
            if not len(self.children[at]):
                out[rows] = self.leaf[at]
                continue
            node = self.children[at][_nearest(points[rows], self.centres[self.children[at]])]
            for child in np.unique(node).tolist():
                todo[child] = rows[node == child]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves that a (lifted) query visits, best bin first."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        out: list[int] = []
        while queue and len(out) < most:
            _, at = heapq.heappop(queue)
            below = self.children[at]
            if len(below):
                for key, child in zip((self.norms[below] - 2 * (self.centres[below] @ query)).tolist(), below.tolist(), strict=True):
                    heapq.heappush(queue, (key, child))
            else:
                out.append(int(self.leaf[at]))
        return out


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v, norm): vectors in double precision, without null, zero and non-finite ones; of one vec_id the least vector."""
    x = F.col("embedding")
    v = F.transform(x, lambda e: e.cast("double"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    found = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull())).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = found.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")) & ~F.isnan("norm"))
    return fine.groupBy("vec_id").agg(F.min("v").alias("v"), F.min_by("norm", "v").alias("norm")).select("vec_id", F.size("v").alias("dim"), "v", "norm")


def candidates(clean: DataFrame, k: int) -> DataFrame:
    """The rows that may be in an answer: of equal vectors the k + 1 of least vec_id. They score alike for
    every query, ties go to the least vec_id, and a query passes over one row at most."""
    h1, h2 = digest128("v")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    return clean.withColumns({"h1": h1, "h2": h2}).withColumn("place", place).where(F.col("place") <= k + 1).select(clean.columns)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same whatever rows stand beside."""
    return (q * v).sum(axis=1)


def _top(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, vec_id) of each query's ``k`` best; ``scores`` of -inf aren't candidates."""
    scores = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        edge = np.full(len(scores), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))  # products differ by rounding from block to block
    row, col = np.nonzero((scores >= (edge - slack)[:, None]) & (scores > -np.inf))
    exact = _products(queries[row], vectors[col])
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], exact[keep], ids[col[keep]]


def brute_force(vectors: DataFrame, queries: pd.DataFrame, k: int, extra: str | None = None) -> DataFrame:
    """(query_id, vec_id, score[, extra]): at least the ``k`` best rows of ``vectors`` for some given queries, by all products."""
    ids, q = queries["vec_id"].to_numpy(np.int64), _matrix(queries["v"])
    names = ["query_id", "vec_id", "score"] + ([extra] if extra else [])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for b in batches:
            if len(b):
                own = b["vec_id"].to_numpy(np.int64)
                v = _matrix(b["v"])
                row, score, vec = _top(q @ v.T, own, q, v, ids, k)
                new = pd.DataFrame({"query_id": ids[row], "vec_id": vec, "score": score})
                if extra:
                    new = new.merge(b[["vec_id", extra]], on="vec_id")
                best = new if best is None else pd.concat([best, new])
                best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best[names]

    return vectors.mapInPandas(search, "query_id long, vec_id long, score double" + (f", {extra} int" if extra else ""))


def calibrate(tree: KMeansTree, top: float, placed: DataFrame, queries: pd.DataFrame, k: int, recall: float = RECALL) -> int:
    """Leaves to visit so that the ``queries`` find ``recall`` of their true ``k`` neighbours among all of ``placed``."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    truth = brute_force(placed, queries, k, "leaf").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("query_id", "leaf").toPandas()  # k rows a query
    if not len(truth):
        return tree.leaves
    q = np.concatenate([_matrix(queries["v"]), np.zeros((len(queries), 1))], axis=1)
    turn_of = {}
    for vec, row in zip(queries["vec_id"].tolist(), q, strict=True):
        turn_of[vec] = {leaf: turn for turn, leaf in enumerate(tree.visits(row, tree.leaves))}
    turns = np.asarray([turn_of[a][b] for a, b in zip(truth["query_id"].tolist(), truth["leaf"].tolist(), strict=True)])
    visits = 1
    while visits < tree.leaves and (turns < visits).mean() < recall:
        visits = min(tree.leaves, int(visits * WIDEN) + 1)
    return visits


def _search_dim(points: DataFrame, queries: DataFrame, n: int, top: float, k: int, recall: float) -> DataFrame:
    """(query_id, vec_id, score): at least the ``k`` best found of each query. All vectors have one length."""
    spark = points.sparkSession
    kept = F.pmod(F.xxhash64("vec_id", F.lit(_SEED)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = points.where(kept).orderBy("vec_id").select("v").toArrow()  # about SAMPLE rows
    if not len(sample):
        sample = points.orderBy("vec_id").limit(1).select("v").toArrow()
    lifted = _lift(np.concatenate([np.asarray(c.flatten()).reshape(len(c), -1) for c in sample["v"].chunks if len(c)]), top)
    tree = KMeansTree.fit(lifted, max(LEAF_SAMPLE, -(-LEAF_ROWS * len(lifted) // n)) if n > len(lifted) else LEAF_ROWS)

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(tree.assign(_lift(_matrix(v), top)).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    placed = materialize(points.select("vec_id", "v", leaf_of("v").alias("leaf")), "leaves")
    rows_of = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # a row per leaf of the bounded tree
        rows_of[r.leaf] = r["count"]
    few = queries.orderBy(F.xxhash64("query_id", F.lit(_SEED)), "query_id").limit(CALIBRATION).select(F.col("query_id").alias("vec_id"), "v").toPandas()
    if not len(few):
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    visits = calibrate(tree, top, placed, few, k, recall)

    # shelves of about SHELF_ROWS vectors: small leaves share one, a large leaf has several of its own
    of_leaf, first, shelf, held = np.ones(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64), 0, 0
    for leaf, rows in enumerate(rows_of.tolist()):
        of_leaf[leaf] = max(1, -(-rows // SHELF_ROWS))
        if held and held + rows > SHELF_ROWS:
            shelf, held = shelf + 1, 0
        first[leaf], held = shelf, held + rows
        if of_leaf[leaf] > 1:
            shelf, held = shelf + of_leaf[leaf], 0

    @F.pandas_udf("long")
    def shelf_of(leaf: pd.Series, h: pd.Series) -> pd.Series:
        at = leaf.to_numpy()
        return pd.Series(first[at] + h.to_numpy() % of_leaf[at])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for every shelf that it has leaves on."""
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                q = np.concatenate([_matrix(some["v"]), np.zeros((len(some), 1))], axis=1)
                row, place, names = [], [], []
                for r, one in enumerate(q):
                    leaves = np.sort(np.asarray(tree.visits(one, visits)))
                    wide = np.repeat(leaves, of_leaf[leaves])
                    on = np.repeat(first[leaves], of_leaf[leaves]) + np.arange(len(wide)) - np.repeat(np.cumsum(of_leaf[leaves]) - of_leaf[leaves], of_leaf[leaves])
                    cut = np.flatnonzero(on[1:] != on[:-1]) + 1
                    for part, shelf in zip(np.split(wide, cut), on[[0, *cut]].tolist(), strict=True):
                        row.append(r)
                        place.append(shelf)
                        names.append(part.astype(np.int32))
                yield pd.DataFrame({"shelf": place, "query_id": some["query_id"].to_numpy()[row], "v": some["v"].to_numpy()[row], "leaves": names})

    def look(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(own):
            own = own.sort_values(["leaf", "vec_id"])
            ids, v, leaf = own["vec_id"].to_numpy(np.int64), _matrix(own["v"]), own["leaf"].to_numpy()
            start, end = (np.searchsorted(leaf, np.arange(tree.leaves), side) for side in ("left", "right"))
            for at in range(0, len(asked), QUERY_BLOCK):
                some = asked.iloc[at : at + QUERY_BLOCK]
                q, names = _matrix(some["v"]), some["query_id"].to_numpy(np.int64)
                scores = np.full((len(some), len(ids)), -np.inf)
                size = some["leaves"].str.len().to_numpy()
                every, who = np.concatenate(some["leaves"].tolist()), np.repeat(np.arange(len(some)), size)
                order = np.argsort(every, kind="stable")
                every, who = every[order], who[order]
                for part in np.split(np.arange(len(every)), np.flatnonzero(every[1:] != every[:-1]) + 1):
                    a, b = start[every[part[0]]], end[every[part[0]]]
                    if b > a:
                        scores[who[part], a:b] = q[who[part]] @ v[a:b].T
                row, score, vec = _top(scores, ids, q, v, names, k)
                out.append(pd.DataFrame({"query_id": names[row], "vec_id": vec, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    # a shelf goes once to each block of the queries that ask it, so no task holds more of either
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    stock = placed.select("vec_id", "v", "leaf", shelf_of("leaf", salt).alias("shelf"))
    asked = materialize(queries.mapInPandas(ask, "shelf long, query_id long, v array<double>, leaves array<int>"), "asked")
    blocks = materialize(asked.groupBy("shelf").agg(F.ceil(F.count("*") / ASKED_ROWS).cast("int").alias("blocks")), "blocks")
    groups = blocks.agg(F.sum("blocks")).first()[0] or 1
    tasks = min(groups, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))  # by number: few bytes, much work
    keyed = asked.join(blocks, "shelf").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
    held = stock.join(blocks, "shelf").select("shelf", "vec_id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    both = [x.repartition(tasks, "shelf", "block").groupBy("shelf", "block") for x in (keyed, held)]
    return both[0].cogroup(both[1]).applyInPandas(look, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries_where: str = "vec_id % 20 = 0", k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query vector, a row of ``vectors`` that meets
    ``queries_where``, the ``k`` other rows of highest inner product that were found.

    Defined cases: null and zero vectors and vectors that hold null or non-finite
    components (or whose squared norm is beyond double precision) take no part, neither do
    rows with a null vec_id; of several rows with one vec_id the least vector is taken;
    vectors of different length are never compared; with fewer candidates than ``k`` all
    that were found are returned; ties go to the smaller vec_id; an empty table gives no
    rows; other columns play no part.
    """
    clean = materialize(clean_vectors(vectors), "vectors")
    points = materialize(candidates(clean, k), "candidates")
    found = None
    for dim in sorted(points.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect(), key=lambda r: r.dim):  # a row per length
        own = points.where(F.col("dim") == dim.dim).select("vec_id", "v")
        queries = clean.where(F.col("dim") == dim.dim).where(queries_where).select(F.col("vec_id").alias("query_id"), "v")
        part = _search_dim(own, queries, dim.n, dim.top, k, recall)
        found = part if found is None else found.union(part)
    if found is None:
        return points.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    from curatrix.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
