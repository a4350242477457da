"""Token ids in a wavelet matrix per shard.

A shard file is one block of bytes: a header, the documents' ids and lengths, and
one bit-plane per bit of the largest id, highest first, each with its rank
directory. Each plane is the ids' bit in the order left by stably parting the ids
by the bit above; with the running count of ones it answers rank and select, and
through these access, counting and the places where an id occurs, without
unpacking the ids.

Layout (little-endian): magic ``WVM2``; u32 bits; u64 tokens; u64 documents; then
per part a u64 length and that many zstd-compressed bytes: document ids (i64),
nulls (u8), lengths (u64), the planes (packed bits, first bit highest), and the
directories (u32: ones before each block of 512 bits and in all, plane by plane).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import scratch_path

#: The id appended to every document, and the file's first bytes.
END_ID = 1
MAGIC = b"WVM2"
SHARD_TOKENS = 1 << 20
#: A writing task gets so many bytes of text, about.
PART_BYTES = 512 << 20
#: Words that a task remembers, and bytes of text that it works on at once.
CACHE_WORDS, STRETCH = 400_000, 1 << 21
_BLOCK = 512


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block, and in all."""
    if not len(plane):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), _BLOCK // 8)))])


class WaveletMatrix:
    """Rank/select over bit-planes. ``planes``: packed bits, highest bit first; ``ones``: their
    rank directories."""

    def __init__(self, planes: list[np.ndarray], n: int, ones: list[np.ndarray]) -> None:
        self.planes, self.n, self.ones = planes, n, ones
        self.zeros = [n - int(o[-1]) for o in self.ones]

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, a = [], ids.astype(np.uint16) if bits <= 16 else ids
        for k in reversed(range(bits)):
            b = (a >> k & 1).astype(bool)
            planes.append(np.packbits(b))
            a = np.concatenate([a[~b], a[b]])
        return WaveletMatrix(planes, len(ids), [_directory(p) for p in planes])

    def decode(self) -> np.ndarray:
        """All ids: from the lowest plane up, each parting is undone."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level, plane in enumerate(reversed(self.planes)):
            b = np.unpackbits(plane, count=self.n).view(bool)
            back = np.empty_like(out)
            zeros = self.n - int(np.count_nonzero(b))
            back[~b] = out[:zeros]
            back[b] = out[zeros:]
            back |= b.astype(kind) << kind(level)
            out = back
        return out

    def _rank1(self, level: int, i: int) -> int:
        block = i // _BLOCK
        plane, first = self.planes[level], block * (_BLOCK // 8)
        whole = int(np.bitwise_count(plane[first : i >> 3]).sum())
        rest = int(plane[i >> 3]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self.ones[level][block]) + whole + rest.bit_count()

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the ``k``-th (from 0) ones or zeros of a plane: the block by binary search
        in the directory, then the bit inside it."""
        plane, ones = self.planes[level], self.ones[level]
        before = ones if bit else np.minimum(np.arange(len(ones)) * _BLOCK, self.n) - ones
        block = np.searchsorted(before, k, side="right") - 1
        at = block[:, None] * (_BLOCK // 8) + np.arange(_BLOCK // 8)
        held = np.where(at < len(plane), plane[np.minimum(at, len(plane) - 1)], 0).astype(np.uint8)
        bits = np.unpackbits(held if bit else ~held, axis=1)
        return block * _BLOCK + (np.cumsum(bits, axis=1, dtype=np.int64) > (k - before[block])[:, None]).argmax(axis=1)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the first ``i`` ids' occurrences of ``token`` stand below the last plane."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        low, high = 0, max(0, min(i, self.n))
        for level in range(len(self.planes)):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (len(self.planes) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first ``i`` ids."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _places(self, token: int, below: np.ndarray) -> np.ndarray:
        """Places of ``below``, given below the last plane, in the order of the ids."""
        for level in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - level) & 1
            below = self._select(level, bit, below - self.zeros[level] * bit)
        return below

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th occurrence (from 0) of ``token``, -1 if there is none."""
        low, high = self._range(token, self.n)
        return int(self._places(token, np.asarray([low + k]))[0]) if 0 <= k < high - low else -1

    def occurrences(self, token: int) -> list[int]:
        low, high = self._range(token, self.n)
        return [int(p) for k in range(low, high, 1000) for p in self._places(token, np.arange(k, min(k + 1000, high)))]


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    bits = max(1, int(ids.max(initial=0)).bit_length())
    matrix = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [
        np.asarray([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.asarray([d is None for d in doc_ids], np.uint8).tobytes(),
        np.asarray(lengths, "<u8").tobytes(),
        *[p.tobytes() for p in matrix.planes],
        np.concatenate(matrix.ones).astype("<u4").tobytes(),
    ]
    packed = [pack(p) for p in parts]
    return MAGIC + struct.pack("<IQQ", bits, len(ids), len(doc_ids)) + b"".join(struct.pack("<Q", len(p)) + p for p in packed)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the documents' ids, and their lengths in tokens."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    bits, n, docs = struct.unpack_from("<IQQ", data, 4)
    at, parts, unpack = 24, [], zstandard.ZstdDecompressor()
    for _ in range(4 + bits):
        (size,) = struct.unpack_from("<Q", data, at)
        parts.append(unpack.decompress(data[at + 8 : at + 8 + size]) if docs or size else b"")
        at += 8 + size
    ids, nulls = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8)
    doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
    planes, ones = [np.frombuffer(p, np.uint8) for p in parts[3:-1]], np.frombuffer(parts[-1], "<u4").astype(np.int64)
    return WaveletMatrix(planes, n, np.split(ones, bits)), doc_ids, np.frombuffer(parts[2], "<u8").astype(np.int64)


def _byte_kinds() -> np.ndarray:
    """0 blank, 1 letter, 2 digit, 3 punctuation; 4 what is left to the library: control bytes,
    the apostrophe of contractions, "<" that may begin a special token, and other scripts."""
    kinds = np.full(256, 4, np.uint8)
    kinds[33:127] = 3
    kinds[[32, 9, 10, 13]] = 0
    kinds[48:58] = 2
    kinds[65:91] = kinds[97:123] = 1
    kinds[[ord("'"), ord("<")]] = 4
    return kinds


class Encoder:
    """Token ids of whole texts by the ``tokenizers`` library.

    The tokenizer drops white space and no token spans it; runs of letters, digits and
    runs of punctuation are never in one token either. So a text's ids are the ids of
    these words in order, and each distinct word goes to the library once; words met
    before come from a bounded cache of this encoder. Letters are those of ASCII and
    Latin-1, which lower-case to one letter and are already in normal form. A stretch
    between blanks with anything else in it goes to the library as it stands.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends, self.kinds, self.size = _word_ends(self.tokenizer), _byte_kinds(), cache
        self.cache: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes], whole: list[bytes]) -> None:
        """``words`` are one token run each, and its last token says so, so many are encoded as
        one text and told apart by these; ``whole`` stretches are encoded one by one."""
        for k in range(0, len(words), 500):
            some = words[k : k + 500]
            ids = np.asarray(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4") if self.ends is not None else []
            last = np.flatnonzero(self.ends[ids]) + 1 if self.ends is not None else []
            if len(last) == len(some):
                raw, at = ids.tobytes(), (4 * last).tolist()
                self.cache.update(zip(some, map(raw.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))
            else:
                whole = whole + some
        for k in range(0, len(whole), 10_000):
            some = whole[k : k + 10_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                self.cache[w] = np.asarray(e.ids, "<u4").tobytes()

    def _words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, and starts, ends and kinds (4: as it stands) of the words of ``data``."""
        kind = self.kinds[data]
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = 1
        upper = lead[letter & (second <= 0x9E)] + 1
        low[upper] += 32
        solid = kind != 0
        begin = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        end = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
        odd = np.concatenate([[0], np.cumsum(kind == 4)])
        left = np.flatnonzero(odd[end] > odd[begin])
        for b, e in zip(begin[left].tolist(), end[left].tolist(), strict=True):
            kind[b:e] = 4
        low[kind == 4] = data[kind == 4]
        opens = solid & np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
        starts = np.flatnonzero(opens)
        shut = np.flatnonzero(opens | ~solid)  # a word ends where the next one or a blank begins
        ends = np.append(shut, len(data))[np.searchsorted(shut, starts, side="right")]
        return low, starts, ends, kind[starts]

    def _distinct(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first places, numbers): one word of each kind, and each word's number. Words of up to
        16 bytes are compared as two whole numbers, longer ones as bytes."""
        size = ends - starts
        padded = np.concatenate([low, np.zeros(24, np.uint8)])
        eight = np.ndarray((len(low) + 16,), "<u8", padded, 0, (1,))
        mask = np.asarray([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
        short = size <= 16
        a = eight[starts] & mask[np.minimum(size, 8) * short]
        b = eight[starts + 8 * (size > 8)] & mask[np.clip(size - 8, 0, 8) * short]
        # zero bytes in words look like the filling, so there the size is compared too
        keys = (b, a) if low.all() else (b, a, np.minimum(size, 17))
        order = np.lexsort(keys)
        fresh = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
        number = np.empty(len(starts), np.int64)
        number[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        long, more, raw = np.flatnonzero(~short), {}, low.tobytes()
        for i in long.tolist():
            number[i] = len(first) + more.setdefault(raw[starts[i] : ends[i]], (len(more), i))[0]
        return np.concatenate([first, np.asarray([i for _, i in more.values()], np.int64)]), number

    def _stretch(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a stretch of text, and words' starts with the number of ids up to and with each."""
        low, starts, ends, kind = self._words(data)
        if not len(starts):
            return np.empty(0, "<u4"), starts, starts
        first, number = self._distinct(low, starts, ends)
        raw = low.tobytes()
        words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.cache) > self.size:
            self.cache.clear()
        fresh = [k for k, w in enumerate(words) if w not in self.cache]
        left = (kind[first] == 4).tolist()
        self._learn([words[k] for k in fresh if not left[k]], [words[k] for k in fresh if left[k]])
        found = [self.cache[w] for w in words]
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        offset, n = (np.cumsum(sizes) - sizes)[number], sizes[number]
        total = np.cumsum(n)
        return flat[np.repeat(offset - (total - n), n) + np.arange(total[-1])], starts, total

    def __call__(self, texts: Iterable[bytes | None]) -> list[np.ndarray]:
        """Ids of each text (UTF-8; null is empty). The texts are worked on together, in stretches
        that end at blanks."""
        texts = [t or b"" for t in texts]
        joined = b"".join([t + b"\n" for t in texts])
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        held, starts, counts, at, seen = [], [], [], 0, 0
        while at < len(data):
            stop = joined.find(b" ", at + STRETCH)
            line = joined.find(b"\n", at + STRETCH, stop if stop >= 0 else len(data))
            stop = line + 1 if line >= 0 else stop + 1 if stop >= 0 else len(data)
            ids, first, total = self._stretch(data[at:stop])
            held.append(ids)
            starts.append(first + at)
            counts.append(total + seen)
            seen, at = seen + len(ids), stop
        if not held:
            return []
        ids, starts, counts = np.concatenate(held), np.concatenate(starts), np.concatenate([[0], *counts])
        return np.split(ids, counts[np.searchsorted(starts, ends)][:-1])


def _word_ends(tokenizer) -> np.ndarray | None:
    """Which ids end a word, if the vocabulary marks them."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    out = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        if i < len(out):
            out[i] = token.endswith(suffix)
    return out


def write_store(docs: DataFrame, tokenizer_path: str, path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> None:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id``, and write shards in
    ascending doc_id order as rows (part, seq, n_tokens, data) of a table at ``path``.

    Spark range-partitions by doc_id and commits the files, so a lost executor's
    task is simply run again. A shard closes after ``shard_tokens`` ids and holds
    whole documents.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, part, seq = Encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        size = 0

        def shard() -> pd.DataFrame:
            data = to_bytes(np.concatenate(held), ids, [len(x) for x in held])
            return pd.DataFrame({"part": [part], "seq": [seq], "n_tokens": [size], "data": [data]})

        end = np.asarray([end_id], "<u4")
        for batch in batches:
            for k in range(0, len(batch), 1024):
                some = batch.iloc[k : k + 1024]
                for doc, null, found in zip(some["doc_id"], some["none"], encoder(some["text"]), strict=True):
                    held.append(np.concatenate([found, end]))
                    ids.append(None if null else int(doc))
                    size += len(found) + 1
                    if size >= shard_tokens:
                        yield shard()
                        held, ids, size, seq = [], [], 0, seq + 1
        if held:
            yield shard()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("none"), text.cast("binary").alias("text"), F.xxhash64(text).alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    order = [F.col("none").desc(), F.col("doc_id"), F.col("tie")]  # the last one parts rows of one id or none
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    shards = ordered.mapInPandas(encode, "part int, seq int, n_tokens long, data binary")
    shards.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """From the files alone: (doc_id, start, n_tokens, ids_crc32) of every document."""
    shards = spark.read.schema("part int, seq int, n_tokens long, data binary").parquet(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, data in zip(batch["part"], batch["seq"], batch["data"], strict=True):
                matrix, doc_ids, lengths = from_bytes(data)
                ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.array(doc_ids, "Int64"), "inside": ends - lengths, "n_tokens": lengths, "ids_crc32": crcs})

    meta = shards.select("part", "seq", "n_tokens")
    parts = meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per writing task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__part"))
    along = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = meta.withColumn("__seq", F.coalesce(F.sum("n_tokens").over(along), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("__part") + F.col("__seq")).alias("__start"))
    docs = shards.select("part", "seq", "data").mapInPandas(unpack, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("__start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the shards (to ``path``, else to the shared folder) and read them back.

    Defined cases: null or empty text is the end id alone; null doc_ids come first;
    equal doc_ids keep together in any order; an empty table has no shards and gives
    no rows; other columns play no part.
    """
    path = path or scratch_path(docs.sparkSession, "token-store")
    write_store(docs, tokenizer_path, path, **options)
    return read_store(docs.sparkSession, path)


def query(spark, sf_dir):
    import public_tokenizers

    from curatrix.llm.common import table

    return encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
