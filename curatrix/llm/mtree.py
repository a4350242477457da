"""Exact top-k search by inner product in M-trees, best first.

Inner product is no metric, so every vector gets one more component that lifts its
norm to the largest norm M, and a query gets 0 there. Then squared distance is
|q|^2 + M^2 - 2 q.v, and the nearest vectors are those of highest product. Scores
stay whole numbers throughout; distances serve for pruning only.

Spark deals the vectors to the nearest of some sampled pivots. Each group (large
ones are divided) becomes one M-tree of fixed-size pages, written as one row of a
table in the shared folder. A page entry holds its object, the covering radius of
the page below, and the distance to the parent object. A query first searches the
tree with the least bound, and with the k-th distance found there only those trees
whose bound is not beyond it. Queries of one tree descend in blocks: the page of
least bound to any of them comes first, each query leaves a page that its own k-th
distance rules out, and stored parent distances rule out entries before any
distance is computed. A tree is sent once for each block of queries that asks it.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

K = 20
SCALE = 64.0
LEAF, FANOUT = 64, 16
#: Vectors in a tree, about; the number of trees is bounded, so that the directory of
#: centres and radii that every query is held against is bounded too.
TREE_ROWS, MAX_TREES = 8_192, 16_384
MAX_PIVOTS = 1_024
QUERY_BLOCK = 2_048
#: Whole numbers up to this are exact as floating point; no product exceeds the largest squared norm.
EXACT = 1 << 53
#: Vectors below this squared norm have products that 64-bit integers hold.
LARGEST = 2.0**61
_NONE = np.iinfo(np.int64).min


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that holds them."""
    kind = np.promote_types(np.min_scalar_type(v.min()), np.min_scalar_type(v.max())) if v.size else v.dtype
    return v.astype(kind)


class MTree:
    """Pages over ``vectors`` (whole numbers) with lifted component ``lift``.

    ``pages[p]``: (leaf?, objects, parent distances, radii, children).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lift: np.ndarray, pages: list, root: int, top: float) -> None:
        self.ids, self.vectors, self.lift, self.pages, self.root, self.top = ids, vectors, lift, pages, root, top

    @staticmethod
    def distances(vectors: np.ndarray, lift: np.ndarray, rows: np.ndarray, to: int) -> np.ndarray:
        gap = (vectors[rows] - vectors[to]).astype(np.float64)
        return np.sqrt((gap * gap).sum(axis=1) + (lift[rows] - lift[to]) ** 2)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, top: int, leaf: int = LEAF, fanout: int = FANOUT) -> MTree:
        """``top``: the largest squared norm of all vectors. The root page's parent object is row 0."""
        lift = np.sqrt(np.maximum(0, top - (vectors * vectors).sum(axis=1)).astype(np.float64))
        pages: list = []

        def page(rows: np.ndarray, parent: int) -> tuple[int, float]:
            """Page number, and the largest distance from ``parent`` to what lies below."""
            far = cls.distances(vectors, lift, rows, parent)
            if len(rows) <= leaf:
                pages.append((True, rows, far, np.zeros(len(rows)), np.full(len(rows), -1)))
                return len(pages) - 1, float(far.max())
            seeds = rows[np.linspace(0, len(rows) - 1, fanout).astype(np.int64)]
            near = np.stack([cls.distances(vectors, lift, rows, s) for s in seeds]).argmin(axis=0)
            if np.bincount(near, minlength=fanout).max() > 0.9 * len(rows):  # mostly equal vectors: divide by order
                near = np.arange(len(rows)) * fanout // len(rows)
                seeds = np.asarray([rows[near == j][0] for j in range(fanout)])
            objects, radii, children = [], [], []
            for j, s in enumerate(seeds):
                if (mine := rows[near == j]).size:
                    child, radius = page(mine, s)
                    objects.append(s)
                    radii.append(radius)
                    children.append(child)
            objects = np.asarray(objects)
            pages.append((False, objects, cls.distances(vectors, lift, objects, parent), np.asarray(radii), np.asarray(children)))
            return len(pages) - 1, float(far.max())

        root, _ = page(np.arange(len(ids)), 0)
        return cls(ids, vectors, lift, pages, root, float(top))

    def to_bytes(self) -> bytes:
        sizes = np.asarray([len(p[1]) for p in self.pages])
        out = io.BytesIO()
        np.savez(
            out, ids=self.ids, vectors=_narrow(self.vectors), lift=self.lift, sizes=sizes, root=self.root, top=self.top,
            leaf=np.asarray([p[0] for p in self.pages]), objects=np.concatenate([p[1] for p in self.pages]), parent=np.concatenate([p[2] for p in self.pages]),
            radii=np.concatenate([p[3] for p in self.pages]), children=np.concatenate([p[4] for p in self.pages]),
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> MTree:
        z = np.load(io.BytesIO(data))
        cut = np.cumsum(z["sizes"])[:-1]
        pages = list(zip(z["leaf"].tolist(), *(np.split(z[n], cut) for n in ("objects", "parent", "radii", "children")), strict=True))
        return cls(z["ids"], z["vectors"].astype(np.int64), z["lift"], pages, int(z["root"]), float(z["top"]))

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query, a row of ``q``, the ``k`` best (query row, score, vec_id) in order, less those
        known to lie under its ``floor``; a row with the query's id is passed over."""
        exact = self.top < EXACT and (q * q).sum(axis=1).max(initial=0) < EXACT
        own, asked = (self.vectors.astype(np.float64), q.astype(np.float64)) if exact else (self.vectors, q)
        base = (q * q).sum(axis=1).astype(np.float64) + self.top
        slack = 1e-6 * (1 + np.sqrt(base))
        score = np.full((len(q), k), _NONE)
        found = np.full((len(q), k), np.iinfo(np.int64).max)
        worst = np.full(len(q), _NONE) if floor is None else floor.copy()

        def reach(rows: np.ndarray) -> np.ndarray:
            far = np.sqrt(np.maximum(0.0, base[rows] - 2.0 * worst[rows])) + slack[rows]
            return np.where(worst[rows] == _NONE, np.inf, far)

        def products(rows: np.ndarray, objects: np.ndarray) -> np.ndarray:
            return (asked[rows] @ own[objects].T).astype(np.int64)

        def distances(rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, base[rows, None] - 2.0 * scores))

        def take(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
            """Merge entries (those passed over score ``_NONE``) into the best of these queries."""
            every = np.concatenate([score[rows], scores], axis=1)
            names = np.concatenate([found[rows], np.broadcast_to(ids, scores.shape)], axis=1)
            order = np.lexsort((names, -np.maximum(every, _NONE + 1)), axis=-1)[:, :k]
            score[rows], found[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
            worst[rows] = np.maximum(worst[rows], score[rows, k - 1])
            limit[rows] = np.minimum(limit[rows], reach(rows))

        everyone = np.arange(len(q))
        limit = reach(everyone)
        to_root = distances(everyone, products(everyone, np.zeros(1, np.int64)))[:, 0]
        queue = [(0.0, 0, self.root, everyone, np.zeros(len(q)), to_root)]
        pushed = 0
        while queue:
            _, _, at, rows, bound, to_parent = heapq.heappop(queue)
            near = bound <= limit[rows]
            rows, bound, to_parent = rows[near], bound[near], to_parent[near]
            leaf, objects, parent, radii, children = self.pages[at] if len(rows) else (True, *[np.empty(0, np.int64)] * 4)
            open_ = np.abs(to_parent[:, None] - parent) - radii <= limit[rows, None]  # by stored distances alone
            some, cols = open_.any(axis=1), open_.any(axis=0)
            if not some.any():
                continue
            rows, bound, open_ = rows[some], bound[some], open_[np.ix_(some, cols)]
            objects, radii, children = objects[cols], radii[cols], children[cols]
            scores = products(rows, objects)
            if leaf:
                ids = self.ids[objects]
                fine = open_ & (scores >= worst[rows, None]) & (ids != query_ids[rows, None])
                some, cols = fine.any(axis=1), fine.any(axis=0)
                if some.any():
                    take(rows[some], np.where(fine, scores, _NONE)[np.ix_(some, cols)], ids[cols])
                continue
            d = distances(rows, scores)
            bounds = np.maximum(bound[:, None], d - radii)
            open_ &= bounds <= limit[rows, None]
            for j, child in enumerate(children.tolist()):
                if (mine := np.flatnonzero(open_[:, j])).size:
                    pushed += 1
                    heapq.heappush(queue, (float(bounds[mine, j].min()), pushed, child, rows[mine], bounds[mine, j], d[mine, j]))
        row, col = np.nonzero(score != _NONE)
        return row, score[row, col], found[row, col]


def whole_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, dim, v, norm): components floor(scale * x). Vectors that are null or hold
    null or non-finite components are left out, and so are those whose squared norm, scaled, is
    ``LARGEST`` or more; of one vec_id the least vector is taken."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    length = F.aggregate(x, F.lit(0.0), lambda a, e: a + (e.cast("double") * scale) * (e.cast("double") * scale))
    found = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~bad).where(length < LARGEST).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)
    return found.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v", norm.alias("norm"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _search_dim(points: DataFrame, queries: DataFrame, n: int, top: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): at least the k best of each query. All vectors have one length."""
    tree_rows = max(TREE_ROWS, -(-n // MAX_TREES))
    pivots = _matrix(points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(MAX_PIVOTS, n // tree_rows))).toPandas()["v"])
    lifted = np.sqrt(np.maximum(0, top - (pivots * pivots).sum(axis=1)).astype(np.float64))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        m = _matrix(v).astype(np.float64)
        norm = (m * m).sum(axis=1)
        lift = np.sqrt(np.maximum(0, top - norm))
        return pd.Series((2 * top - 2 * (m @ pivots.T.astype(np.float64)) - 2 * lift[:, None] * lifted[None, :]).argmin(axis=1).astype(np.int32))

    dealt = materialize(points.select("vec_id", "v", nearest("v").alias("pivot")), "dealt")
    counts = {r.pivot: r["count"] for r in dealt.groupBy("pivot").count().collect()}  # one row per pivot
    salts = F.element_at(F.array(*[F.lit(max(1, -(-counts.get(p, 0) // tree_rows))) for p in range(len(pivots))]), F.col("pivot") + 1)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        tree = MTree.build(group["vec_id"].to_numpy(np.int64), _matrix(group["v"]), top)
        radius = float(MTree.distances(tree.vectors, tree.lift, np.arange(len(tree.ids)), 0).max())
        return pd.DataFrame({"pivot": [group["pivot"].iloc[0]], "salt": [group["salt"].iloc[0]], "centre": [tree.vectors[0]], "radius": [radius], "data": [tree.to_bytes()]})

    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts).cast("int"))
    trees = salted.groupBy("pivot", "salt").applyInPandas(build, "pivot int, salt int, centre array<long>, radius double, data binary")
    trees = materialize(trees.withColumn("tree", F.col("pivot").cast("long") * (1 << 32) + F.col("salt")).drop("pivot", "salt"), "mtree")
    directory = trees.select("tree", "centre", "radius").orderBy("tree").toPandas()  # bounded by MAX_TREES + MAX_PIVOTS
    numbers, radii = directory["tree"].to_numpy(np.int64), directory["radius"].to_numpy()
    centres = _matrix(directory["centre"])
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bounds(v: pd.Series) -> np.ndarray:
        m = _matrix(v)
        base = (m * m).sum(axis=1).astype(np.float64) + top
        return np.maximum(0.0, np.sqrt(np.maximum(0.0, base[:, None] - 2.0 * (m @ centres.T))) - radii[None, :])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"tree": numbers[bounds(b["v"]).argmin(axis=1)], "query_id": b["query_id"], "v": b["v"], "floor": pd.array([None] * len(b), "Int64")})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            low, m = bounds(b["v"]), _matrix(b["v"])
            base = (m * m).sum(axis=1).astype(np.float64) + top
            floor = b["floor"].astype("Int64")
            reach = np.where(floor.isna(), np.inf, np.sqrt(np.maximum(0.0, base - 2.0 * floor.fillna(0).to_numpy(np.float64))) + 1e-6 * (1 + np.sqrt(base)))
            row, col = np.nonzero((low <= reach[:, None]) & (numbers[None, :] != b["tree"].to_numpy()[:, None]))
            for k0 in range(0, len(row), 4096):
                r, c = row[k0 : k0 + 4096], col[k0 : k0 + 4096]
                yield pd.DataFrame({"tree": numbers[c], "query_id": b["query_id"].to_numpy()[r], "v": b["v"].to_numpy()[r], "floor": floor.to_numpy()[r]})

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")
        ids, floor = asked["query_id"].to_numpy(np.int64), asked["floor"].astype("Int64").fillna(_NONE).to_numpy(np.int64)
        row, score, vec = MTree.from_bytes(held["data"].iloc[0]).search(ids, _matrix(asked["v"]), k, floor)
        return pd.DataFrame({"query_id": ids[row], "vec_id": vec, "score": score})

    def asked_of(rows: DataFrame) -> DataFrame:
        asked = materialize(rows, "asked")
        blocks = asked.groupBy("tree").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        blocks = F.broadcast(materialize(blocks, "blocks"))  # a row per tree at most, as in the directory
        groups = blocks.agg(F.sum("blocks")).first()[0] or 1
        tasks = min(groups, 8 * parts)  # by number: the groups are small in bytes and dear in time
        keyed = asked.join(blocks, "tree").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
        held = trees.join(blocks, "tree").select("tree", "data", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        both = [x.repartition(tasks, "tree", "block").groupBy("tree", "block") for x in (keyed, held)]
        return both[0].cogroup(both[1]).applyInPandas(search, "query_id long, vec_id long, score long")

    schema = "tree long, query_id long, v array<long>, floor long"
    start = queries.mapInPandas(first, schema)
    found = materialize(asked_of(start), "found")
    floors = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    again = start.drop("floor").join(floors, "query_id", "left").select("tree", "query_id", "v", "floor").mapInPandas(others, schema)
    return found.union(asked_of(again))


def top_k(vectors: DataFrame, queries_where: str = "vec_id % 20 = 0", k: int = K, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query vector, a row of ``vectors`` that meets
    ``queries_where``, the ``k`` other rows of highest whole-number inner product.

    Defined cases: null vectors and vectors with null or non-finite components take no
    part, neither do rows with a null vec_id, nor vectors so long that 64-bit integers do not
    hold their products (``LARGEST``); of several rows with one vec_id the least
    vector is taken; vectors of different length are never compared; with fewer
    candidates than ``k`` all are returned; ties go to the smaller vec_id; an empty
    table gives no rows; other columns play no part.
    """
    points = materialize(whole_vectors(vectors, scale), "vectors")
    found = None
    for dim in sorted(points.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect(), key=lambda r: r.dim):
        own = points.where(F.col("dim") == dim.dim)
        queries = own.where(queries_where).select(F.col("vec_id").alias("query_id"), "v")
        part = _search_dim(own, queries, dim.n, dim.top, k)
        found = part if found is None else found.union(part)
    if found is None:
        return points.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    from curatrix.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
