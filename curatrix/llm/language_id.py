"""Language ID by rank-order profiles.

A language's profile is the ranking of its most frequent letter 1- to 3-grams
(word edges count as a letter). A document is ranked likewise, over its whole
text, and goes to the language with the smallest out-of-place distance: the sum
of rank differences, with the profile length for each n-gram the profile lacks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
UNKNOWN = "und"
#: A document further than this from every profile is in none of the languages.
MIN_SCORE = 0.15
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = 1


def gram_counts(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of the given words. A code packs three
    code points of 21 bits, so it is the same in every worker."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = chr(_EDGE)
    c = np.frombuffer((edge + edge.join(words) + edge).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = c != _EDGE
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.fromiter(words.values(), np.int64, len(words))
    weight = np.zeros(len(c), np.int64)
    weight[letter] = np.repeat(counts, sizes)
    pairs = letter[:-1] | letter[1:]
    middle = letter[1:-1]
    codes = np.concatenate([c[letter], (c[:-1] | c[1:] << 21)[pairs], (c[:-2] | c[1:-1] << 21 | c[2:] << 42)[middle]])
    weights = np.concatenate([weight[letter], np.maximum(weight[:-1], weight[1:])[pairs], weight[1:-1][middle]])
    found, at = np.unique(codes, return_inverse=True)
    return found, np.bincount(at, weights=weights).astype(np.int64)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters. The pattern also takes signs such as ½ or Ⅷ for letters;
    they part words here."""
    words = _LETTERS.findall(text.lower()) if text else []
    if words and not "".join(words).isalpha():
        words = "".join([c if c.isalpha() else " " for c in " ".join(words)]).split()
    return words


@dataclass
class Profiles:
    """``ranks[i, j]``: rank of n-gram ``codes[i]`` in language j, ``size`` where it has none."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def best(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(Counter(words_of(text)))
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        order = np.lexsort((codes, -counts))[: self.size]
        codes = codes[order]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[at] == codes
        there = np.where(hit[:, None], self.ranks[at], self.size)
        gap = np.where(there < self.size, np.abs(there - np.arange(len(codes))[:, None]), self.size)
        distance = gap.sum(axis=0)
        k = int(distance.argmin())
        return self.langs[k], float(1 - distance[k] / (self.size * len(codes)))


def train_profiles(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from the rows of (text, lang) that are given; null languages are left out.

    Counts are made per batch in the tasks, summed by Spark, and ranked there; only
    ``size`` rows per language reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                words: Counter = Counter()
                for text in texts:
                    words.update(words_of(text))
                    if len(words) > 200_000:
                        codes, counts = gram_counts(words)
                        yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})
                        words = Counter()
                codes, counts = gram_counts(words)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    totals = known.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("code"))
    top = totals.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < size).select("lang", "code", "rank").toPandas()
    langs = sorted(top["lang"].unique())
    codes = np.unique(top["code"].to_numpy(np.int64))
    ranks = np.full((len(codes), len(langs)), size, np.int64)
    ranks[np.searchsorted(codes, top["code"].to_numpy(np.int64)), [langs.index(x) for x in top["lang"]]] = top["rank"]
    return Profiles(langs, codes, ranks, size)


def predict(text: Column, profiles: Profiles) -> Column:
    """struct<lang string, score double> of a text column."""

    @F.pandas_udf("lang string, score double")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.best(t) for t in texts], columns=["lang", "score"])

    return nearest(text)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """All rows of ``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    Profiles are learned from rows whose crc32(doc_id) mod 3 is not 1. Defined cases:
    null text, or text without letters, is ``und`` with score 0, and so is every row
    if there is no language to learn; a null doc_id counts as ''; repeated rows are
    counted and answered each; equal distances go to the first language by name;
    columns named like the results are replaced.
    """
    held = fold(F.col("doc_id"), 3) == 1
    profiles = train_profiles(docs.where(~held), size)
    names = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return docs.select(*[F.col(f"`{c}`") for c in names], held.alias("held_out"), predict(F.col("text"), profiles).alias("__p")).select(
        *[F.col(f"`{c}`") for c in names], "held_out", F.col("__p.lang").alias("lang_pred"), F.col("__p.score").alias("score")
    )


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in one of its languages; same columns. ``und`` and texts far
    from every profile go. Defined cases as in ``identify``: null, empty and letterless
    texts go; repeated rows are judged each; an empty table gives an empty table."""
    p = predict(F.col("text"), train_profiles(docs.where(fold(F.col("doc_id"), 3) != 1)))
    judged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), p.alias("p"))
    return judged.where((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= min_score)).select("d.*")


def query(spark, sf_dir):
    from curatrix.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
