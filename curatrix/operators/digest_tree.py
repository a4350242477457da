"""Digests of tables by bucket, in a tree: equal parts are told from changed ones without reading them.

Rows fall into buckets by the hash of their key. A bucket's digest sums up hashes of its rows, so no
bucket is gathered and order doesn't matter. Each node of the tree digests its children; two trees are
compared from the root, and only below nodes that differ.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 16


def row_text(columns: list[str]) -> Column:
    """A row's columns as one text; null and '' differ."""
    return F.concat_ws("\u001f", *[F.concat(F.lit(f"{c}="), F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("null"))) for c in sorted(columns)])


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(row_text(key)), F.lit(buckets)).cast("int")


def bucket_digests(rows: DataFrame, key: list[str], columns: list[str], buckets: int) -> dict[int, str]:
    """Digest of each bucket that has rows: as many at most as there are buckets."""
    text = row_text(columns)
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), text).cast("decimal(38,0)"))
    found = rows.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.concat_ws("-", F.count("*"), total("a"), total("b")).alias("digest"))
    return {r.bucket: r.digest for r in found.collect()}


class DigestTree:
    """``levels[0]`` holds the buckets' digests, the last level the root alone."""

    def __init__(self, leaves: dict[int, str], buckets: int, fanout: int = FANOUT) -> None:
        self.levels, self.buckets, self.fanout = [dict(leaves)], buckets, fanout
        width = buckets
        while width > 1 or len(self.levels) == 1:
            width = -(-width // fanout)
            above: dict[int, list[str]] = {}
            for node in sorted(self.levels[-1]):
                above.setdefault(node // fanout, []).append(f"{node}:{self.levels[-1][node]}")
            self.levels.append({n: hashlib.sha256("|".join(parts).encode()).hexdigest() for n, parts in above.items()})

    @property
    def root(self) -> str:
        return self.levels[-1].get(0, "")

    def differing(self, other: DigestTree) -> tuple[list[int], int]:
        """Buckets whose digests differ, or that one tree lacks, and how many nodes were compared."""
        if (self.buckets, self.fanout) != (other.buckets, other.fanout):
            return sorted({*self.levels[0], *other.levels[0]}), 0
        open_, looked = [0], 1
        if self.root == other.root:
            return [], looked
        for mine, theirs in zip(self.levels[-2::-1], other.levels[-2::-1], strict=True):
            nodes = [n for top in open_ for n in range(top * self.fanout, (top + 1) * self.fanout) if n in mine or n in theirs]
            looked += len(nodes)
            open_ = [n for n in nodes if mine.get(n) != theirs.get(n)]
        return open_, looked
