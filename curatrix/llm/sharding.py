"""Sharding, native, by sampled splitters.

Size-weighted samples of keys give quantile boundaries; records are
range-partitioned by them, overfull ranges are subdivided, and the ranges, many
times more than shards, are packed so that shards hold nearly equal bytes.
The key is the hash of the text, so equal texts share a range and a shard.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

#: Bounds on what the driver gets: sampled keys (expected number), and ranges.
SAMPLE = 16_384
RANGES = 1_024
RESULTS = ("size", "text_crc32", "shard", "slot")


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(h: Column, bounds: list[int]) -> Column:
    """How many bounds are <= h: a binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    step, steps = 1, []
    while step <= len(bounds):
        steps.append(step)
        step *= 2
    at = _longs(bounds)
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda n, s: F.when((n + s <= len(bounds)) & (F.try_element_at(at, n + s) <= h), n + s).otherwise(n),
    )


def _splitters(sample: list[tuple[int, int]], least: float, ranges: int) -> list[int]:
    """Quantile boundaries of a sorted weighted sample. A key heavier than a whole
    quantile gets a range of its own."""
    keyed = [(h, sum(max(size, least) for _, size in g)) for h, g in groupby(sample, key=lambda x: x[0])]
    width, run, bounds = sum(w for _, w in keyed) / max(1, ranges), 0.0, set()
    for h, w in keyed:
        if w >= width:
            bounds |= {h, h + 1}
            run = 0.0
        elif run + w > width:
            bounds.add(h)
            run = w
        else:
            run += w
    return sorted(b for b in bounds if -(2**63) < b < 2**63)


def _draw(keys: DataFrame, total: int, sample: int, turn: int) -> list[tuple[int, int]]:
    """Each key with probability sample * size / total: ``sample`` keys are expected at most, however often each occurs."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(turn), F.col("h"), F.col("tie")), 11).cast("double") / F.lit(float(2**53))
    drawn = keys.where(u * F.lit(float(total)) < F.col("size") * F.lit(float(sample))).select("h", "size")
    return sorted((r.h, r.size) for r in drawn.collect())


def shard_keys(rows: DataFrame) -> DataFrame:
    """(h, tie, n, size): number and bytes of the rows of each key."""
    return materialize(rows.groupBy(F.col("__h").alias("h"), F.col("__tie").alias("tie")).agg(F.count("*").alias("n"), F.sum("__size").alias("size")), "shard-keys")


def plan_shards(keys: DataFrame, n_shards: int, sample: int, ranges: int) -> dict:
    """Boundaries, parts of each range, and each part's shard and first slot. What
    reaches the driver is the sample and one row per part, both bounded."""
    rows, total = keys.agg(F.sum("n"), F.sum("size")).first()
    if not rows:
        return {"bounds": [], "parts": [1], "base": [0], "shard": [0], "first": [0]}
    bounds = _splitters(_draw(keys, total, sample, 1), total / sample, ranges)
    limit, turn = 2 * total / ranges, 1
    while True:  # subdivide overfull ranges until each that is left holds one key
        found = keys.groupBy(_range_of(F.col("h"), bounds).alias("r")).agg(F.sum("size").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
        full = {x.r: (x.b, x.lo == x.hi) for x in found}
        over = [x for x in found if x.b > limit and x.lo < x.hi]
        if not over:
            break
        turn += 1
        inside = keys.where(F.array_contains(_longs([x.r for x in over]), _range_of(F.col("h"), bounds).cast("long")))
        mass = sum(x.b for x in over)
        more = _splitters(_draw(inside, mass, sample, turn), mass / sample, max(2, int(2 * mass / limit)))
        # where the sample parts nothing, the middle does, so the span of keys halves at least
        middles = [(x.lo + x.hi) // 2 + 1 for x in over if bisect_right(more, x.lo) == bisect_right(more, x.hi)]
        bounds = sorted({*bounds, *more, *middles})
    parts = [max(1, -int(-full.get(r, (0, True))[0] // limit)) for r in range(len(bounds) + 1)]
    base = [0]
    for p in parts[:-1]:
        base.append(base[-1] + p)
    counted = {x.p: (x.b, x.n) for x in keys.groupBy(_part(F.col("h"), F.col("tie"), bounds, parts, base).alias("p")).agg(F.sum("size").alias("b"), F.sum("n").alias("n")).collect()}
    items = []  # what must stay together: all parts of a group of equal texts that fits a shard
    for r, (p, b) in enumerate(zip(parts, base, strict=True)):
        whole = full.get(r, (0, True))[1] and full.get(r, (0, True))[0] <= total / n_shards
        items += [list(range(b, b + p))] if whole else [[x] for x in range(b, b + p)]
    weigh = lambda item: sum(counted.get(x, (0, 0))[0] for x in item)
    loads, shard = [(0, s) for s in range(n_shards)], [0] * sum(parts)
    for item in sorted(items, key=lambda x: (-weigh(x), x)):
        load, s = heapq.heappop(loads)
        heapq.heappush(loads, (load + weigh(item), s))
        for x in item:
            shard[x] = s
    taken, first = [0] * n_shards, []
    for x, s in enumerate(shard):
        first.append(taken[s])
        taken[s] += counted.get(x, (0, 0))[1]
    return {"bounds": bounds, "parts": parts, "base": base, "shard": shard, "first": first}


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _tie() -> Column:
    return F.xxhash64(F.lit("tie"), F.col("doc_id"))


def _size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def _part(h: Column, tie: Column, bounds: list[int], parts: list[int], base: list[int]) -> Column:
    r = _range_of(h, bounds) + 1
    return (F.element_at(_longs(base), r) + F.pmod(tie, F.element_at(_longs(parts), r))).cast("int")


def assign_shards(docs: DataFrame, n_shards: int = 8, sample: int = SAMPLE, ranges: int = RANGES) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``text_crc32``, ``shard`` (int) and ``slot``
    (long, gapless from 0 in each shard). Sizes (bytes + 1 a row) are near equal.

    Equal texts go to one shard unless they alone outweigh a shard's share; then
    they are divided by doc_id, and equal rows of one doc_id that fill a part by their place in the
    input (the rows are written once with it, so a task run again finds it unchanged). Slots are numbered inside parts of about
    total / ``ranges`` bytes, never over a whole shard in one task.

    Defined cases: null text has size 1 and CRC 0, like ''; a null doc_id is allowed;
    repeated rows get slots of their own; an empty table gives an empty table;
    columns named like the results are replaced.
    """
    names = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], _hash().alias("__h"), _tie().alias("__tie"), _size().alias("__size"))
    keys = shard_keys(rows)
    total = keys.agg(F.sum("size")).first()[0] or 0
    heavy = materialize(keys.where((F.col("n") > 1) & (F.col("size") > 2 * total / ranges)).select(F.col("h").alias("__h"), F.col("tie").alias("__tie"), F.lit(True).alias("__heavy")), "heavy")
    if not heavy.isEmpty():  # ranges / 2 keys at most
        own = F.when(F.col("__heavy"), F.monotonically_increasing_id()).otherwise(F.col("__tie"))
        rows = materialize(rows.join(F.broadcast(heavy), ["__h", "__tie"], "left").withColumn("__tie", own).drop("__heavy"), "shard-rows")
        keys = shard_keys(rows)
    plan = plan_shards(keys, n_shards, sample, ranges)
    part = _part(F.col("__h"), F.col("__tie"), plan["bounds"], plan["parts"], plan["base"])
    base = rows.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("__size").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        part.alias("__part"),
        "__h",
    )
    inside = Window.partitionBy("__part").orderBy("__h", "doc_id", "size")
    at = F.col("__part") + 1
    return base.withColumn("__n", F.row_number().over(inside) - 1).select(
        *[F.col(f"`{c}`") for c in names],
        "size",
        "text_crc32",
        F.element_at(_longs(plan["shard"]), at).cast("int").alias("shard"),
        (F.element_at(_longs(plan["first"]), at) + F.col("__n")).cast("long").alias("slot"),
    )


def query(spark, sf_dir):
    from curatrix.llm.common import table

    out = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
