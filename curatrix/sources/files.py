"""Files as tables: listings with digests, description documents, tables in many folders."""

from __future__ import annotations

import hashlib
import io
import urllib.parse
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.text import base_name, parent_path

#: Fixed value: the namespace of word-processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: Files up to so many bytes come as one value of a row; longer ones are read in a stream.
WHOLE_BYTES, CHUNK_BYTES = 64 << 20, 8 << 20


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` as the reader names it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _below(path: Column, top: str) -> Column:
    return F.regexp_replace(path, r"^\Q" + top + r"\E/+", "")


def _with_empty(listed: DataFrame, found: DataFrame) -> DataFrame:
    """``listed`` (path, length, modificationTime) with the files of no bytes, which Spark's reader passes over. Names come from
    the reader's file index, which the driver holds anyway."""
    spark = found.sparkSession
    same = F.regexp_replace("path", "^([A-Za-z0-9]+):/+", "$1:/").alias("same")  # file:/x and file:///x
    every = spark.createDataFrame([(urllib.parse.unquote(n),) for n in found.inputFiles()], "path string")
    conf, rows = spark.sparkContext._jsc.hadoopConfiguration(), []
    for r in every.select("path", same).join(listed.select(same), "same", "left_anti").toLocalIterator():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(r.path)
        rows.append((at.toString(), 0, at.getFileSystem(conf).getFileStatus(at).getModificationTime()))
    empty = spark.createDataFrame(rows, "path string, length long, ms long").select("path", "length", F.timestamp_millis("ms").alias("modificationTime"))
    return listed.unionByName(empty)


def open_local(path: str) -> BinaryIO:
    """A file of a folder that all executors see (a shared mount, or one machine)."""
    return open(urllib.parse.urlsplit(path).path if path.startswith("file:") else path, "rb")  # noqa: SIM115


def _stream_digests(found: DataFrame, opener: Callable[[str], BinaryIO]) -> DataFrame:
    """(path, sha, error): digests of files read in chunks, one file after the other in a task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                digest, error = hashlib.sha256(), None
                try:
                    with opener(path) as f:
                        while chunk := f.read(CHUNK_BYTES):
                            digest.update(chunk)
                except Exception as e:  # whatever stands in the way, the job goes on
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "sha": [None if error else digest.hexdigest()], "error": [error]})

    return found.select("path").repartition("path").mapInPandas(read, "path string, sha string, error string")


def scan_files(spark: SparkSession, path: str, root_id: str = "", glob: str = "*", opener: Callable[[str], BinaryIO] = open_local, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Recursive listing with the digest of each file's content, and ``error`` where it could not be read.

    Files up to ``whole_bytes`` are read by Spark, whatever the store. Longer ones never become a value of a row:
    a task streams them through ``opener``, by default as files of a shared folder; a store that only
    Spark's readers open needs an opener of its own, else such files get an error and no digest.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true")
    found = reader.load(path)
    listed = found.select("path", "length", "modificationTime")  # opens no file
    small = found.where(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha"), F.lit(None).cast("string").alias("error"))
    large = _stream_digests(listed.where(F.col("length") > whole_bytes), opener)
    nothing = F.when(F.col("length") == 0, F.sha2(F.lit("").cast("binary"), 256))
    judged = _with_empty(listed, found).join(small.unionByName(large), "path", "left").withColumn("sha", F.coalesce("sha", nothing))
    error = F.when(F.col("sha").isNull(), F.coalesce("error", F.lit("could not be read")))
    return judged.select(
        F.lit(root_id).alias("root_id"), base_name(F.col("path")).alias("name"), _below(F.col("path"), _qualified(spark, path)).alias("relative_path"), F.lit(False).alias("is_directory"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.concat(F.lit("sha256:"), F.col("sha")).alias("content_hash"), error.alias("error"),
    )


def document_paragraphs(data: bytes) -> list[str]:
    """Non-empty paragraphs of a word-processing document; runs are joined, tabs and breaks are blanks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{_W}p"):
        text = "".join((t.text or "") if t.tag == f"{_W}t" else " " if t.tag in (f"{_W}tab", f"{_W}br") else "" for t in p.iter())
        if text.strip():
            out.append(text.strip())
    return out


def extract_paragraphs(spark: SparkSession, path: str, largest: int = 1 << 30) -> DataFrame:
    """(folder, document, pos, text, error) of all .docx files below ``path``; ``folder`` is the path from there, so equal
    names in two places stay apart. Any document that can't be read, for whatever reason (or is over ``largest``
    bytes), is a row with ``error``, and the job goes on. A document without text has no row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = [(name, i, t, None) for i, t in enumerate(document_paragraphs(data))]
                    rows += found or [(name, None, None, None)]
                except Exception as e:  # encrypted, truncated, no archive, bad XML, missing parts
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pos", "text", "error"]).astype({"pos": "Int64"})

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").option("ignoreCorruptFiles", "true")
    files = reader.load(path)
    listed = _with_empty(files.select("path", "length", "modificationTime"), files)  # opens no file
    parsed = files.where(F.col("length") <= largest).select("path", "content").mapInPandas(parse, "path string, pos long, text string, error string").withColumn("seen", F.lit(True))
    lost = F.when(F.col("length") > largest, "too large").when(F.col("length") == 0, "empty file").otherwise("could not be read")
    every = listed.join(parsed, "path", "left").withColumn("error", F.when(F.col("seen").isNull(), lost).otherwise(F.col("error")))
    inside = _below(F.col("path"), _qualified(spark, path))
    return every.where("pos IS NOT NULL OR error IS NOT NULL").select(parent_path(inside).alias("folder"), base_name(F.col("path")).alias("document"), "pos", "text", "error")


def discover_tables(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of every CSV table below ``path`` with ``file``; lock files (``~$``) are skipped, and a line that
    doesn't fit the schema comes back in ``_corrupt_record`` rather than failing."""
    found = (
        spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!~]*.csv").option("mode", "PERMISSIVE")
        .schema(f"{schema}, _corrupt_record string").csv(path)
    )
    return found.withColumn("file", F.col("_metadata.file_path"))


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")
