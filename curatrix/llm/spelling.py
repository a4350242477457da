"""Groups spelling variants: words one edit apart, the rare pointing to the frequent.

Words are counted over all texts. A word becomes a vector of letter counts; one edit
moves that vector by a squared distance of 1 (a letter more or less) or 2 (a letter for
another). Blocks of such vectors are multiplied (a Gram matrix in NumPy), squared
distances follow from the products, pairs of at most 2 are kept and verified letter by
letter.

Which blocks meet: the letters fall into ``GROUPS`` groups of about equal use, and words
with the same length and the same number of letters in each group form one block. An edit
takes at most one letter from one group and adds at most one to another, so a block meets
itself, the blocks of its own length with one letter in another group, and the blocks that
are shorter by a letter of one group. Each word is sent to a bounded number of blocks, no
near pair is missed, and each is met once. What leaves a task is a count and the best
partner of each word, never the pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import materialize

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in about so many loses a letter, chosen by the checksum of document and run.
NOISE = 199
GROUPS = 8
#: Words of a block that meet one chunk of partners at once; larger blocks are divided.
BLOCK, CHUNK = 2_048, 4_096
#: Letters of all words compared at once, so that long words take no more memory.
CELLS = 8_000_000
TASK_ROWS = 100_000
#: Words that a task counts before it hands the counts on.
_HELD = 300_000

#: Latin-1 bytes: A-Z lower-cased, a-z and U+00C0 to U+00FF as they are, anything else is a gap.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters, only A-Z lower-cased, in Latin-1 bytes (so that byte order is
    code-point order and a byte is a letter)."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def result_of(doc_id: int, run: bytes, noise: int) -> bytes:
    """The run, less one letter where ``noise`` divides the checksum of document and run."""
    h = zlib.crc32(b"%d:" % doc_id + run.decode("latin-1").encode())
    at = h % len(run)
    return run if h % noise else run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = NOISE) -> DataFrame:
    """(w, n): words of at least ``min_length`` letters, as Latin-1 bytes, that occur ``min_count`` times in all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                for run, n in Counter(runs(text)).items():
                    if len(run) < min_length:
                        continue
                    word = run if noise is None or doc == "" else result_of(int(doc), run, noise)
                    if len(word) >= min_length:
                        seen[word] += n
            if len(seen) > _HELD:
                yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where(F.col("text").isNotNull())
    counted = named.mapInPandas(count, "w binary, n long")
    return counted.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """Group of each byte: letters, the most used first, go to the group least used so far."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["w"]), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"letter": at, "n": total[at]})

    used = words.select("w").mapInPandas(count, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # a row per letter
    of, load = np.zeros(256, np.int64), [0] * groups
    for r in sorted(used, key=lambda r: (-r.n, r.letter)):
        of[r.letter] = load.index(min(load))
        load[of[r.letter]] += r.n
    return of


def _packed(sums: np.ndarray) -> np.ndarray:
    """Letters in each group as one number of a byte a group. Counts of 256 and more wrap around;
    blocks that then share a number differ by far more than one edit."""
    shifts = np.arange(sums.shape[1], dtype=np.uint64) * np.uint64(8)
    return ((sums & 255).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, all letters in a row, and each letter's word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return sizes, np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), sizes)


def blocks(words: DataFrame, of: np.ndarray, groups: int = GROUPS) -> DataFrame:
    """(size, block, own, w, n): each word once for its own block, and once for every block of words it may be one edit from
    and that comes before its own, or is shorter."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 2_000):
                some = batch.iloc[k : k + 2_000]
                sizes, letters, row = _flat(some["w"].tolist())
                sums = np.bincount(row * groups + of[letters], minlength=len(some) * groups).reshape(-1, groups)
                home = _packed(sums)
                out = [(np.arange(len(some)), sizes, home, True)]
                for i in range(groups):
                    less = sums.copy()
                    less[:, i] -= 1
                    has = sums[:, i] > 0
                    out.append((np.flatnonzero(has), sizes[has] - 1, _packed(less[has]), False))
                    for j in range(groups):
                        if i != j:
                            other = less.copy()
                            other[:, j] += 1
                            there = _packed(other)
                            some_rows = np.flatnonzero(has & (there > home))
                            out.append((some_rows, sizes[some_rows], there[some_rows], False))
                at = np.concatenate([x[0] for x in out])
                yield pd.DataFrame(
                    {
                        "size": np.concatenate([x[1] for x in out]), "block": np.concatenate([x[2] for x in out]).view(np.int64),
                        "own": np.concatenate([np.full(len(x[0]), x[3]) for x in out]), "w": some["w"].to_numpy()[at], "n": some["n"].to_numpy()[at],
                    }
                )

    return words.mapInPandas(send, "size long, block long, own boolean, w binary, n long")


#: Letters as columns of the count matrix: a-z, then U+00C0 to U+00FF.
_COLUMN = np.zeros(256, np.int64)
_COLUMN[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = np.arange(90)


class Side:
    """Words of one length with letters, letter counts, and squared norms."""

    def __init__(self, words: np.ndarray, n: np.ndarray, size: int) -> None:
        self.words, self.n = words, n
        self.letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)
        row = np.arange(len(words))[:, None] * 90
        counts = np.bincount((row + _COLUMN[self.letters]).ravel(), minlength=len(words) * 90).reshape(-1, 90)
        self.counts = counts.astype(np.float32 if size < 2_000 else np.float64)
        self.norms = (self.counts * self.counts).sum(axis=1)

    def rank(self) -> np.ndarray:
        """Place of each word in code-point order."""
        out = np.empty(len(self.words), np.int64)
        out[np.argsort(np.ascontiguousarray(self.letters).view(f"S{self.letters.shape[1]}").ravel(), kind="stable")] = np.arange(len(out))
        return out


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one replaced letter (equal widths) or one inserted one (``long`` a letter wider)."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


def near_pairs(left: Side, right: Side, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and ``right`` one edit apart; within one block (``own``) each pair once."""
    far = left.norms[:, None] + right.norms[None, :] - 2 * (left.counts @ right.counts.T)  # the Gram matrix gives squared distances
    i, j = np.nonzero((far > 0) & (far <= 2))
    if own:
        i, j = i[i < j], j[i < j]
    step = max(1, CELLS // right.letters.shape[1])
    good = [one_edit(left.letters[i[k : k + step]], right.letters[j[k : k + step]]) for k in range(0, len(i), step)]
    fine = np.concatenate(good) if good else np.empty(0, bool)
    return i[fine], j[fine]


def _best(of: Side, i: np.ndarray, to: Side, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each word in ``of`` with partners: itself, their number, and the most frequent of them with its count."""
    order = np.lexsort((to.rank()[j], -to.n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    return of.words[i[first]], np.diff(np.append(first, len(i))), to.n[j[first]], to.words[j[first]]


_FOUND = "w binary, n_near long, form_n long, form binary"


class _Meeting:
    """One part of a block: its own words, held against chunks of others."""

    def __init__(self, size: int) -> None:
        self.size, self.own, self.side, self.others, self.held, self.found = size, [], None, [], 0, []
        self.most = max(1, min(CHUNK, 4 * CELLS // (size + 1)))

    def add(self, own: bool, w: np.ndarray, n: np.ndarray) -> None:
        """Own words come before all others."""
        if own:
            self.own.append((w, n))
            return
        if not self.own:  # no word lives here
            return
        for k in range(0, len(w), self.most):
            self.others.append((w[k : k + self.most], n[k : k + self.most]))
            self.held += len(self.others[-1][0])
            if self.held >= self.most:
                self.meet()

    def meet(self) -> None:
        if not self.own:
            return
        if self.side is None:
            self.side = Side(*(np.concatenate(x) for x in zip(*self.own, strict=True)), self.size)
            i, j = near_pairs(self.side, self.side, own=True)
            if len(i):
                self.found.append(_best(self.side, np.concatenate([i, j]), self.side, np.concatenate([j, i])))
        if not self.others:
            return
        w, n = (np.concatenate(x) for x in zip(*self.others, strict=True))
        self.others, self.held = [], 0
        longer = np.fromiter(map(len, w), np.int64, len(w)) > self.size
        for extra in (0, 1):
            if (some := longer == bool(extra)).any():
                other = Side(w[some], n[some], self.size + extra)
                i, j = near_pairs(self.side, other)
                if len(i):
                    self.found += [_best(self.side, i, other, j), _best(other, j, self.side, i)]


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by block, part and kind: of each part its own words first."""
    place, now = None, None
    for batch in batches:
        found: list[tuple[np.ndarray, ...]] = []
        if not len(batch):
            continue
        keys = np.stack([batch[c].to_numpy(np.int64) for c in ("size", "block", "part", "kind")], axis=1)
        w, n = batch["w"].to_numpy(), batch["n"].to_numpy()
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(w)], strict=True):
            here = tuple(keys[a, :3].tolist())
            if here != place:
                if now is not None:
                    now.meet()
                    found += now.found
                place, now = here, _Meeting(here[0])
            now.add(keys[a, 3] == 0, w[a:b], n[a:b])
        found, now.found = found + now.found, []
        if found:
            yield pd.DataFrame(dict(zip(("w", "n_near", "form_n", "form"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
    if now is not None:
        now.meet()
        for w, near, n, form in now.found:
            yield pd.DataFrame({"w": w, "n_near": near, "form_n": n, "form": form})


def near_words(words: DataFrame, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(w, n_near, form_n, form): of each word with near words their number and the most frequent of them (ties: the least)."""
    sent = materialize(blocks(words, letter_groups(words, groups), groups), "blocks")
    # by number of rows: they are small in bytes and dear in time
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), sent.count() // TASK_ROWS)
    # blocks over ``block`` words fall into parts: each holds some of the words, and meets all others of the block once
    homes = sent.where("own").groupBy("size", "block").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rows = sent.join(homes, ["size", "block"])  # blocks where no word lives go
    part = F.pmod(F.xxhash64("w"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    places = F.when(~F.col("own"), F.transform(every, lambda p: F.struct(p.alias("part"), F.lit(1).alias("kind")))).otherwise(
        F.transform(F.filter(every, lambda p: p >= part), lambda p: F.struct(p.alias("part"), F.when(p == part, 0).otherwise(1).alias("kind")))
    )
    placed = rows.withColumn("place", F.explode(places)).select("size", "block", "place.part", "place.kind", "w", "n")
    dealt = placed.repartition(tasks, "size", "block", "part").sortWithinPartitions("size", "block", "part", "kind")
    found = dealt.mapInPandas(_meet, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return found.groupBy("w").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("w", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def variants(words: DataFrame, ratio: int = RATIO, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(w, n, n_near, form, form_n, root) of every word of ``words`` (w, n).

    A form occurs at least ``ratio`` times as often as its word, so chains of forms end after
    at most log(largest n) steps, and jumping twice as far in each turn takes few turns.
    """
    words = materialize(words, "words")
    near = near_words(words, groups, block)
    often = F.col("form_n") >= ratio * F.col("n")
    table = words.join(near, "w", "left").select(
        "w", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n")
    )
    table = materialize(table, "forms")
    chain = table.where("form IS NOT NULL").select("w", F.col("form").alias("to"))
    while True:
        onward = chain.select(F.col("w").alias("to"), F.col("to").alias("far"))
        step = materialize(chain.join(onward, "to", "left").select("w", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "chain")
        chain = step.select("w", "to")
        if step.where("moved").isEmpty():
            break
    return table.join(chain, "w", "left").select("w", "n", "n_near", "form", "form_n", F.coalesce("to", "w").alias("root"))


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int | None = NOISE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs`` (doc_id, text) that is long and frequent enough.

    ``n_near`` counts the words one edit away, ``form`` is the most frequent of them where
    it occurs at least ``ratio`` times as often, ``root`` the end of the chain of forms.
    ``noise``: None takes runs as they are.

    Defined cases: null and empty texts hold no words; runs of a row with a null doc_id
    are taken as they are; repeated rows count each; words of any length are compared;
    ties go to the least word in code-point order; an empty table gives no rows; other
    columns play no part.
    """
    out = variants(count_words(docs, min_length, min_count, noise), ratio)
    text = {c: F.decode(c, "ISO-8859-1").alias(d) for c, d in (("w", "word"), ("form", "form"), ("root", "root"))}
    return out.select(text["w"], "n", "n_near", text["form"], "form_n", text["root"])


def query(spark, sf_dir):
    from curatrix.llm.common import table

    out = spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
