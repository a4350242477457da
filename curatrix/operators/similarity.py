"""Picture fingerprints: difference hash, distance, and exact ranking of near pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.scratch import written

BANDS, BAND_BITS = 4, 16
#: A band's value with more fingerprints than this is cut up by the bits of the other bands.
HOT_ROWS = 2_000


def dhash(pixels: Column) -> Column:
    """64-bit difference hash as 16 hex digits of a 9 x 8 grid of greys in row order: a bit is set
    where the left pixel is brighter. Null for another number of pixels or a null pixel."""
    nibble = lambda n: F.lpad(F.conv(n.cast("string"), 10, 16), 1, "0")
    at = lambda i: (F.floor(i / 8) * 9 + i % 8 + 1).cast("int")
    bit = lambda i: F.when(F.element_at(pixels, at(i)) > F.element_at(pixels, at(i) + 1), 1).otherwise(0)
    four = lambda k: bit(k * 4) * 8 + bit(k * 4 + 1) * 4 + bit(k * 4 + 2) * 2 + bit(k * 4 + 3)
    digits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: nibble(four(k)))
    return F.when((F.size(pixels) == 72) & ~F.exists(pixels, lambda p: p.isNull()), F.lower(F.array_join(digits, "")))


def bits_of(fingerprint: Column) -> Column:
    return F.conv(fingerprint, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def balanced_order(distinct: DataFrame) -> list[int]:
    """Bit positions dealt so that each band gets as many telling bits (set in about half of the pictures) as dull ones."""
    at = lambda i: F.sum(F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1))).alias(f"b{i}")
    row = distinct.agg(F.count("*").alias("n"), *[at(i) for i in range(64)]).first()  # one row
    telling = sorted(range(64), key=lambda i: (abs((row[f"b{i}"] or 0) / max(row.n, 1) - 0.5), i))
    turns = [telling[k : k + BANDS] for k in range(0, 64, BANDS)]
    bands = [[t[j] if n % 2 == 0 else t[BANDS - 1 - j] for n, t in enumerate(turns)] for j in range(BANDS)]
    return [i for band in bands for i in band]


def _reordered(bits: Column, order: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for place, i in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(bits, i).bitwiseAND(F.lit(1).cast("long")), place))
    return out


def _cut(bits: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, start).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _band(bits: Column, k: Column) -> Column:
    """The value of band ``k``."""
    return F.call_function("shiftrightunsigned", bits, k * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")


def _distinct(prints: DataFrame) -> DataFrame:
    """(p, id): distinct fingerprints, their bits in balanced order, with their least picture."""
    whole = prints.where("image_fingerprint IS NOT NULL").groupBy(bits_of(F.col("image_fingerprint")).alias("bits")).agg(F.min("photo_id").alias("id"))
    whole = written(whole, "prints")
    return written(whole.select(_reordered(F.col("bits"), balanced_order(whole)).alias("p"), "id"), "distinct")


def _flips(reach: int) -> list[int]:
    """Masks that change up to ``reach`` bits of a band."""
    out = [0]
    if reach >= 1:
        out += [1 << i for i in range(BAND_BITS)]
    if reach >= 2:
        out += [(1 << i) | (1 << j) for i in range(BAND_BITS) for j in range(i)]
    return out


def _met(asking: DataFrame, held: DataFrame, max_distance: int, hot_rows: int = HOT_ROWS, ordered: bool = False) -> DataFrame:
    """(p, q, distance): each fingerprint p of ``asking`` with every other one q of ``held`` within ``max_distance``, once;
    ``ordered``: each pair once, in either order; ``asking`` is ``held`` then.

    Pigeonhole: of 4 bands one differs in at most distance // 4 bits; ``asking`` probes all keys so far away. A band's
    value that more than ``hot_rows`` fingerprints share (blank pictures) is cut up by the other 48 bits: they fall
    into more pieces than bits may differ, so one piece is equal. A pair that meets several times counts
    where it meets first, so no pair is shuffled to be told from its copies. If each pair is wanted once, only
    greater values of a band are probed, which halves the probes: of two values that differ one is less.
    """
    reach = max_distance // BANDS
    if reach > 2:
        raise ValueError("max_distance is 11 at most")
    pieces = next(n for n in (4, 6, 8, 12) if n > max_distance)
    width = (64 - BAND_BITS) // pieces
    bands = lambda c: F.array(*[F.struct(F.lit(k).alias("k"), _cut(c, k * BAND_BITS, BAND_BITS).alias("v")) for k in range(BANDS)])
    keyed = held.select(F.col("p").alias("q"), F.explode(bands(F.col("p"))).alias("b")).select("q", "b.k", "b.v")
    hot = written(keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("k", "v"), "hot")  # few: each holds hot_rows
    probes = asking.select("p", F.explode(bands(F.col("p"))).alias("b")).select("p", "b.k", F.col("b.v").alias("v0"))
    probes = probes.select("p", "k", F.explode(F.transform(F.array(*[F.lit(f) for f in _flips(reach)]), lambda f: F.col("v0").bitwiseXOR(f))).alias("v"))

    if ordered:
        probes = probes.where(F.col("v") >= _band(F.col("p"), F.col("k")))

    x = F.col("p").bitwiseXOR(F.col("q"))
    near = F.bit_count(x) <= max_distance
    near = near & ((F.col("p") < F.col("q")) | (_band(x, F.col("k")) != 0) if ordered else F.col("p") != F.col("q"))
    for k in range(BANDS - 1):
        near = near & ((F.col("k") <= k) | (F.bit_count(_cut(x, k * BAND_BITS, BAND_BITS)) > reach))
    out = [*(F.col(c) for c in ("p", "q")), F.bit_count(x).cast("int").alias("distance")]
    if hot.isEmpty():
        return probes.join(keyed, ["k", "v"]).where(near).select(*out)

    def rest(c: Column, s: int) -> Column:
        """Piece ``s`` of the 48 bits outside band ``k``."""
        piece = None
        for band in range(BANDS):
            others = [i for i in range(64) if i // BAND_BITS != band][s * width : (s + 1) * width]
            value = F.lit(0)
            for place, i in enumerate(others):
                value = value + F.shiftrightunsigned(c, i).bitwiseAND(F.lit(1).cast("long")).cast("int") * (1 << place)
            piece = F.when(F.col("k") == band, value) if piece is None else piece.when(F.col("k") == band, value)
        return piece

    def parted(rows: DataFrame, c: str) -> DataFrame:
        some = F.array(*[F.struct(F.lit(s).alias("s"), rest(F.col(c), s).alias("u")) for s in range(pieces)])
        return rows.join(hot, ["k", "v"], "left_semi").select(c, "k", "v", F.explode(some).alias("x")).select(c, "k", "v", "x.s", "x.u")

    first = near
    for s in range(pieces - 1):
        first = first & ((F.col("s") <= s) | (rest(x, s) != 0))
    cool = lambda rows: rows.join(hot, ["k", "v"], "left_anti")
    cold = cool(probes).join(cool(keyed), ["k", "v"]).where(near).select(*out)
    return cold.unionByName(parted(probes, "p").join(parted(keyed, "q"), ["k", "v", "s", "u"]).where(first).select(*out))


def _named(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    name = lambda old, new: distinct.select(F.col("p").alias(old), F.col("id").alias(new))
    return pairs.join(name("p", "a"), "p").join(name("q", "b"), "q").select("a", "b", "distance")


def near_pairs(prints: DataFrame, max_distance: int = 7, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b, distance) of all pairs of ``prints`` (photo_id, image_fingerprint) within
    ``max_distance`` (11 at most), exact (``_met``). The bands' bits are chosen from the pictures, so no
    band is duller than the others.

    Equal fingerprints collapse first, so a group of copies costs its members and not its
    pairs: pairs are between distinct fingerprints, ``copies`` being the members' table.
    """
    distinct = _distinct(prints)
    found = _named(_met(distinct, distinct, max_distance, hot_rows, ordered=True), distinct)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def copies(prints: DataFrame) -> DataFrame:
    """(photo_id, representative): members of groups of equal fingerprints."""
    least = prints.where("image_fingerprint IS NOT NULL").groupBy("image_fingerprint").agg(F.min("photo_id").alias("representative"))
    return prints.join(least, "image_fingerprint").select("photo_id", "representative")


def rank_similar(prints: DataFrame, k: int = 5, max_distance: int = 7) -> DataFrame:
    """(a, b, distance, rank): each distinct picture's ``k`` nearest within ``max_distance``; a ranking, not a verdict.

    The radius grows: what lies within 3 bits is found with one probe a band, and only pictures that
    have fewer than ``k`` neighbours so near ask again within 7, then 11. The first time all ask, so each
    pair is found, named and stored once, and read both ways."""
    distinct = _distinct(prints)
    order = Window.partitionBy("a").orderBy("distance", "b")
    asking, found = distinct, None
    for radius in [r for r in (3, 7) if r < max_distance] + [max_distance]:
        met = written(_named(_met(asking, distinct, radius, ordered=found is None), distinct), "near")
        if found is None:
            met = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
        full = met.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("a")
        last = radius == max_distance
        part = met if last else met.join(full, "a", "left_semi")
        found = part if found is None else found.unionByName(part)
        asking = asking.join(full.withColumnRenamed("a", "id"), "id", "left_anti")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
