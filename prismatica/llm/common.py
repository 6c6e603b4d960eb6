"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def ship(module) -> None:
    """Send the functions of a module with the job, so that executors need no copy of it."""
    cloudpickle.register_pickle_by_value(module)


ship(sys.modules[__name__])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset: a temporary
    folder if the driver is the only machine, and else one beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="prismatica-llm-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs depend on files only."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(col: str | Column = "text") -> Column:
    """The text, or the empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def shares(df: DataFrame, col: Column, mb: int = 8) -> int:
    """How many shares of about ``mb`` MB of ``col`` the table has; at least one."""
    total = df.agg(F.sum(F.octet_length(col))).first()[0] or 0
    return int(total // (mb << 20)) + 1


def dealt(key: Column, text: Column, n: int) -> Column:
    """The block of a row among ``n``: by key and text, so that rows which share a key are dealt out too."""
    return F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int")


def labelled(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``chosen`` (id, ...) that have a document, with its text. Of documents that share
    a key the text of least digest stands for all, so there are at most as many rows as in ``chosen``."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), whole_text(F.col(text)).alias("text"))
    rows = rows.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    texts = rows.groupBy("id").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("least"))
    return texts.select("id", F.col("least.text").alias("text")).join(F.broadcast(chosen), "id")


#: Leading bits of a hash that a bitmap tells apart: 2 MB, whatever the table's size.
BITMAP_BITS = 24


def bitmap(df: DataFrame, hashed: Column) -> bytes:
    """A bit for each value that the leading bits of ``hashed``, a long, take; of fixed size."""
    top = F.shiftrightunsigned(hashed, 64 - BITMAP_BITS)
    words = (df.select(F.shiftright(top, 5).alias("at"), F.expr("1L").alias("one"), (top % 32).cast("int").alias("by"))
             .groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, by)")).alias("bits")).collect())
    bits = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    for at, value in words:
        bits[at] = value
    return bits.tobytes()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes, as int64, have their bit in a bitmap (as uint32)."""
    top = hashes.astype(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bits[(top >> np.uint64(5)).astype(np.int64)] >> (top & np.uint64(31)).astype(np.uint32)) & 1 == 1


MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of ``x`` reaches every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound (120,000 words take some 16 MB)."""

    def __init__(self, bound: int = 1_000_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a word sequence; a shorter
    sequence is one shingle as a whole, an empty one has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    x = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + hashes[i:n - width + 1 + i])
    return np.unique(x)


def vector_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of vectors: (places of the rows without null or non-finite entries, their lengths, all
    their entries as doubles, one row behind the other)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.cast(column.flatten(), pa.float64())
    values = pc.fill_null(entries, np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length)), np.maximum(length, 0))
    good = length >= 0
    good[row[~np.isfinite(values)]] = False
    return np.flatnonzero(good), length[good], values[good[row]]
