"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders; what stood there is kept as
slot values. A capitalised word that begins a sentence may be a name or not, so windows
that hold one are made in both readings, by documents and items alike. Windows of template tokens of documents and benchmark items are
hash-joined, and a document counts as holding an item when in one occurrence (or in
all of the document) enough of the item's windows match and the slot values map
consistently: one value of the item always stands for the same value of the document.
So a question with new numbers or names is still found, and chance agreement of a few
windows is not. Items with too few plain words for that are found word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import digest128, materialize

#: Template tokens in a window, and how many of them must be plain words.
WINDOW, MIN_LITERALS = 8, 4
#: Share of an item's windows that a document must hold, and share of slot values that must agree.
MIN_SHARE, MIN_CONSISTENT = 0.5, 0.8
#: Up to so many distinct benchmark windows are sent along to filter document windows early
#: (8 bytes each), and up to so many rows are broadcast in a join; beyond, all go by shuffle.
MAX_SENT = 2_000_000
_CACHE_WORDS = 200_000
_U = np.uint64

#: Unit words, taken as units after a number.
UNITS = frozenset(
    "% ° b kb mb gb tb mm cm m km inch inches ft foot feet yard yards mile miles mg g kg t ton tons oz lb lbs pound pounds "
    "ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
    "week weeks month months year years k c f degree degrees kph mph hz khz mhz ghz w kw kwh v a j kj cal kcal "
    "percent dollar dollars euro euros cent cents usd eur gbp".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_SPLIT_UNIT = re.compile(r"(\d)(?=[^\W\d_]|[%°])")
_EDGE = "\"'`()[]{}<>.,;:!?*_|-–—«»“”¿¡"
_NUM, _UNIT, _NAME = _U(1), _U(2), _U(3)


class Templates:
    """Text -> template codes (one per word), the words' own codes, and the words."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def _entry(self, word: str) -> int:
        """Low bits: 1 number, 2 unit word, 4 capitalised, 8 ends a sentence; above them the hash."""
        core = word.strip(_EDGE)
        flags = (1 if core and _NUMBER.fullmatch(core) else 0) | (2 if core.lower() in UNITS else 0) | (4 if core[:1].isupper() else 0) | (8 if word[-1:] in ".!?:" else 0)
        return (xxhash.xxh3_64_intdigest(core.lower().encode("utf-8", "surrogatepass")) & ~15) | flags

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Codes with sentence starts as plain words, codes with them as names, plain codes, words."""
        words = _SPLIT_UNIT.sub(r"\1 ", text).split() if text else []
        if not words:
            return (none := np.empty(0, np.uint64)), none, none, words
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        for w in set(words).difference(self.cache):
            self.cache[w] = self._entry(w)
        e = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        number = (e & _U(1)) != 0
        unit = ((e & _U(2)) != 0) & np.concatenate([[False], number[:-1]])
        starts = np.concatenate([[True], (e[:-1] & _U(8)) != 0])
        name = ((e & _U(4)) != 0) & ~number & ~unit
        plain = (e >> _U(4)) | _U(16)
        typed = np.where(number, _NUM, np.where(unit, _UNIT, plain))
        return np.where(name & ~starts, _NAME, typed), np.where(name, _NAME, typed), plain, words


def windows(codes: np.ndarray, n: int, min_literals: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``n`` words and where they start; windows with few plain
    words are left out. ``exact`` ones never equal template windows."""
    count = len(codes) - n + 1
    if count < 1 or n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    literal = np.concatenate([[0], np.cumsum(codes >= _U(16))])
    acc = np.full(count, n + (1 << 20) * exact, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = (acc ^ codes[k : k + count]) * _U(0x9E3779B97F4A7C15)
            acc ^= acc >> _U(29)
    at = np.flatnonzero(literal[n:] - literal[:count] >= min_literals)
    return acc[at], at


def _slots(codes: np.ndarray, words: list[str], at: int, window: int) -> str:
    return "\x1f".join(words[i].strip(".,;:!?").lower() for i in range(at, min(at + window, len(words))) if codes[i] < _U(16))


def _readings(codes: np.ndarray, named: np.ndarray, n: int, min_literals: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, starts, codes) of both readings: the windows with enough plain words in the
    first, and those among them that the second, with sentence starts as names, changes."""
    h, at = windows(codes, n, min_literals)
    other, _ = windows(named, n, 0)
    changed = np.concatenate([[0], np.cumsum(codes != named)])
    differs = at[changed[at + n] > changed[at]] if len(at) else at
    return [(h, at, codes), (other[differs] if len(differs) else other[:0], differs, named)]


def item_windows(rows: DataFrame, window: int, min_literals: int) -> DataFrame:
    """(item_id, h, base, item_slots, ipos, words, n, exact): the items' windows. An item shorter
    than ``window`` is one window of its length. An item without template windows has exact
    ones, of its words as they are. Both readings of a window stand for it: ``h`` is the
    reading's hash, ``base`` the window's."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            out = []
            for key, text in zip(batch["item_id"], batch["text"], strict=True):
                codes, named, plain, words = templates(text)
                n = min(window, len(words))
                (h, at, _), second = _readings(codes, named, n, min_literals)
                exact = not len(h)
                if exact:
                    h, at = windows(plain, n, 0, True)
                base = dict(zip(at.tolist(), h.view(np.int64).tolist(), strict=True))
                out += [(key, x, x, "" if exact else _slots(codes, words, p, n), p, len(words), n, exact) for p, x in base.items()]
                if not exact:
                    out += [(key, x, base[p], _slots(named, words, p, n), p, len(words), n, False) for x, p in zip(second[0].view(np.int64).tolist(), second[1].tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["item_id", "h", "base", "item_slots", "ipos", "words", "n", "exact"])

    some = rows.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return some.mapInPandas(make, "item_id long, h long, base long, item_slots string, ipos int, words int, n int, exact boolean").distinct()


def document_windows(rows: DataFrame, shapes: list[tuple[int, bool]], min_literals: int, among: np.ndarray | None = None) -> DataFrame:
    """(doc_id, h, slots, dpos): windows of each row's whole text in all ``shapes`` (length, exact)
    and readings; with ``among`` (sorted hashes) only those. A template window may have one
    plain word less than an item's, whose first word may be inside a sentence here."""
    bits = np.zeros(1 << 20, bool)
    if among is not None:
        bits[(among >> _U(44)).astype(np.int64)] = True

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            out = []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                codes, named, plain, words = templates(text)
                for n, exact in shapes:
                    for h, at, read in [(*windows(plain, n, 0, True), plain)] if exact else _readings(codes, named, n, min_literals - 1):
                        if among is not None and len(h):
                            keep = bits[(h >> _U(44)).astype(np.int64)]
                            h, at = h[keep], at[keep]
                            place = np.minimum(np.searchsorted(among, h), len(among) - 1)
                            keep = among[place] == h
                            h, at = h[keep], at[keep]
                        out += [(key, x, "" if exact else _slots(read, words, p, n), p) for x, p in zip(h.view(np.int64).tolist(), at.tolist(), strict=True)]
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=["doc_id", "h", "slots", "dpos"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "h", "slots", "dpos"])

    return rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(make, "doc_id long, h long, slots string, dpos int")


def _classed(items: DataFrame) -> DataFrame:
    """``items`` with ``cls``: items of the same windows, slot values aside, are one class."""
    row = F.struct("ipos", "h", "base", "words", "n", "exact")
    alike = items.groupBy("item_id").agg(F.array_sort(F.collect_set(row)).alias("all"))
    return items.join(alike.select("item_id", F.concat_ws("-", *[x.cast("string") for x in digest128(F.to_json("all"))]).alias("cls")), "item_id")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_literals: int = MIN_LITERALS,
    min_share: float = MIN_SHARE,
    min_consistent: float = MIN_CONSISTENT,
    max_sent: int = MAX_SENT,
) -> DataFrame:
    """(doc_id, item_id, share, consistent): documents that hold a benchmark item.

    ``share``: distinct windows of the item found; ``consistent``: share of slot value
    pairs that fit the item's most frequent mapping (1 without slots). Both are judged for
    each occurrence by itself and for the whole document, and the best that passes is
    given. An occurrence is what agrees in document position minus item position, exactly
    (a copy) or up to half the item's length (words added or left out); copies one after
    another differ by the whole length at least.

    Defined cases: null and empty texts have no windows; an item shorter than a window is
    one window of its length, found in texts of any length; an item of which no window has
    ``min_literals`` plain words is found word for word, case and punctuation aside, however
    short it is; null ids take no part; rows that share an id are one document or item;
    empty tables give no rows; other columns play no part.
    """
    items = materialize(_classed(item_windows(benchmark, window, min_literals)), "items")
    shapes = sorted((r.n, r.exact) for r in items.select("n", "exact").distinct().collect())  # one row per length
    if not shapes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, share double, consistent double")
    distinct = items.select("h").distinct()
    few = distinct.limit(max_sent + 1).count() <= max_sent
    among = np.sort(distinct.toPandas()["h"].to_numpy(np.int64).view(np.uint64)) if few else None
    kinds = items.select("cls", "h", "base", "ipos", "words").distinct()
    small = kinds.limit(max_sent + 1).count() <= max_sent
    total = kinds.groupBy("cls").agg(F.count_distinct("base").alias("total"))
    sized = lambda df: F.broadcast(df) if small else df  # noqa: E731  at most ``max_sent`` rows
    found = document_windows(docs, shapes, min_literals, among)
    hits = found.join(sized(kinds), "h").select("doc_id", "cls", "h", "base", "slots", "ipos", (F.col("dpos") - F.col("ipos")).alias("d"), "words")
    hits = materialize(hits, "hits")
    # no occurrence holds more of an item than the document does
    held = hits.groupBy("doc_id", "cls").agg(F.count_distinct("base").alias("n"))
    held = held.join(sized(total), "cls").where(F.col("n") / F.col("total") >= min_share).select("doc_id", "cls", "total")
    d, w = F.col("d"), F.col("words")
    occurrence = lambda how, at: F.struct(F.lit(how).alias("how"), at.cast("long").alias("at"))
    ways = F.array(occurrence(0, F.lit(0)), occurrence(1, d), occurrence(2, F.floor(d / w)), occurrence(3, F.floor(d / w + 0.5)))
    seen = hits.join(held, ["doc_id", "cls"]).withColumn("o", F.explode(ways)).select("doc_id", "cls", "o", "total", "h", "base", "slots", "ipos").distinct()
    shares = seen.groupBy("doc_id", "cls", "o").agg((F.count_distinct("base") / F.first("total")).alias("share")).where(F.col("share") >= min_share)
    by = ["doc_id", "item_id", "o"]
    pairs = (
        seen.join(shares.drop("share"), ["doc_id", "cls", "o"], "left_semi")
        .join(items.where("item_slots <> ''").select("item_id", "cls", "h", "ipos", "item_slots"), ["cls", "h", "ipos"])
        .select(*by, F.explode(F.arrays_zip(F.split("item_slots", "\x1f").alias("x"), F.split("slots", "\x1f").alias("y"))).alias("s"))
        .groupBy(*by, F.col("s.x").alias("x"), F.col("s.y").alias("y"))
        .count()
    )
    best = pairs.groupBy(*by, "x").agg(F.max("count").alias("top"), F.sum("count").alias("all"))
    slots = best.groupBy(*by).agg((F.sum("top") / F.sum("all")).alias("c"))
    named = shares.join(items.select("item_id", "cls").distinct(), "cls")
    judged = named.join(slots, by, "left").withColumn("consistent", F.coalesce("c", F.lit(1.0))).where(F.col("consistent") >= min_consistent)
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "consistent")).alias("b"))
    return best.select("doc_id", "item_id", "b.share", "b.consistent")


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; same columns. Rows with null ids and
    null or empty texts stay; rows that share an id go together; an empty table on either
    side drops nothing."""
    return docs.join(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir):
    from curatrix.llm.common import table

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
