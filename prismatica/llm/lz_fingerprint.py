"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases, each the shortest string that is not in the document's
dictionary yet (LZ78). The set of phrases is hashed and the least hashes are the
fingerprint; the likeness of two is the estimated Jaccard similarity of their phrase sets,
which stands in for how well one text compresses the other.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import mixed, shares, ship, whole_text

ship(sys.modules[__name__])

SIZE = 64
BASE = np.uint64(0x5851F42D4C957F2D)
MOST_PARTS = 4096
LOW = -(1 << 63)  # before all keys and digests


class Powers:
    """Powers of ``BASE`` and of its inverse, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(BASE), -1, 1 << 64))

    def grow(self, n: int) -> None:
        if n > len(self.up):
            self.up = np.append(np.uint64(1), np.cumprod(np.full(2 * n, BASE)))
            self.down = np.append(np.uint64(1), np.cumprod(np.full(2 * n, self.inverse)))


def phrases(text: str, start: int, low: int, end: int, seen: set[str]) -> tuple[list[int], int]:
    """Starts of the phrases of text[start:end] that are not in ``seen``, which they join, and
    the start of the unfinished one. The first phrase ends after ``low``."""
    starts, add = [], seen.add
    for j in range(low + 1, end + 1):
        w = text[start:j]
        if w not in seen:
            add(w)
            starts.append(start)
            start = j
    return starts, start


def _prefix_hashes(text: str, powers: Powers) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    powers.grow(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed(codes + np.uint64(1)) * powers.up[:len(codes)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, starts: list[int], last: int, powers: Powers) -> np.ndarray:
    a = np.array(starts, np.int64)
    z = np.append(a[1:], last) if len(a) else a
    return mixed((prefix[z] - prefix[a]) * powers.down[a] + (z - a).astype(np.uint64)) >> np.uint64(32)


def least(hashes: np.ndarray) -> np.ndarray:
    """The ``SIZE`` least distinct hashes, ascending."""
    if len(hashes) > 4 * SIZE:
        hashes = np.partition(hashes, 2 * SIZE)[:2 * SIZE + 1]
    return np.unique(hashes)[:SIZE].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases; 1 for two empty fingerprints."""
    union = np.union1d(a, b)[:SIZE]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b)).mean())


def fingerprints(text: str, following: str, powers: Powers) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text, and the fingerprints of the text and of the edited text. Both have the
    same beginning, which is parsed once."""
    n = len(text)
    cut = n - n // 4
    edited = text[:cut] + following[:n // 4]
    seen: set[str] = set()
    starts, i = phrases(text, 0, 0, cut, seen)
    prefix = _prefix_hashes(text, powers)
    head = _hashes(prefix, starts, i, powers)
    both = []
    for whole, sums in ((text, prefix), (edited, None)):
        more, last = phrases(whole, i, cut, len(whole), seen)
        sums = _prefix_hashes(whole, powers) if sums is None else sums
        both.append(least(np.concatenate([head, _hashes(sums, more, last, powers)])))
        seen.difference_update(whole[a:z] for a, z in zip(more, [*more[1:], last]))
    return edited, both[0], both[1]


def fingerprint(text: str, powers: Powers) -> np.ndarray:
    starts, last = phrases(text, 0, 0, len(text), set())
    return least(_hashes(_prefix_hashes(text, powers), starts, last, powers))


def _spelt(x: np.ndarray) -> str:
    return x.astype(">u4").tobytes().hex()


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part; in each, its own ones and then the one that follows the last."""
    powers = Powers()
    before = None  # part, id, text, fingerprint
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        out = []
        for part, tail, key, text in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "id", "text"))):
            if before is not None and before[0] == part:
                edited, own, changed = fingerprints(before[2], text, powers)
                after = fingerprint(text, powers) if tail else None
                out.append([before[1], before[2], edited, own, changed, text if after is None else after])
            before = None if tail else (part, key, text)
        rows = []
        for k, (key, text, edited, own, changed, after) in enumerate(out):
            if isinstance(after, str):  # the next row of this batch has it, unless it is the last
                after = out[k + 1][3] if k + 1 < len(out) and out[k + 1][1] is after else fingerprint(after, powers)
            rows.append((key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _spelt(own), _spelt(changed),
                         likeness(own, changed), likeness(own, after)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                (batch.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=names)


def ranged(source: DataFrame, parts: int) -> DataFrame:
    """``source`` (id, text) with part, a range of (id, digest of the text), of about equal sizes: where
    several cuts fall on one id, its rows are cut at even steps of the digest."""
    number = F.coalesce(F.col("id").cast("long"), F.lit(LOW))
    cuts = [i / parts for i in range(1, parts)]
    found = (source.agg(F.percentile_approx(number, cuts, 4 * parts)).first()[0] or []) if cuts else []
    times = Counter(found)
    ids = np.array(sorted(found), np.int64)
    steps = {v: np.array([LOW + (k << 64) // m for k in range(m)], np.int64) for v, m in times.items() if m > 1}

    @F.pandas_udf("int")
    def part_of(keys: pd.Series, digests: pd.Series) -> pd.Series:
        keys, digests = keys.to_numpy(), digests.to_numpy()
        part = np.searchsorted(ids, keys, side="right")
        for v in set(np.unique(keys).tolist()) & steps.keys():
            rows = keys == v
            part[rows] = np.searchsorted(ids, v) + np.searchsorted(steps[v], digests[rows], side="right")
        return pd.Series(part.astype(np.int32))

    return source.withColumn("part", part_of(number, F.xxhash64("text")))


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for
    each row: the text, and the text whose last quarter gave way to the beginning of the next
    document by ascending whole-number key (after the last comes the first).

    Null texts are empty. Null keys come first; rows that share a key follow one another by a
    digest of their texts. A single row follows itself. The rows are dealt out by range of key and digest;
    each range also gets the row that follows its last one, so texts are shuffled once.
    """
    kind = dict(docs.dtypes)[key]
    source = docs.select(F.col(f"`{key}`").alias("id"), whole_text(F.col(text)).alias("text"))
    parts = min(shares(source, F.col("text")), MOST_PARTS)
    placed = ranged(source, parts)
    order = F.struct(F.coalesce(F.col("id").cast("long"), F.lit(LOW)).alias("id"), F.xxhash64("text").alias("digest"))
    firsts = sorted(tuple(r) for r in placed.groupBy("part").agg(F.min(order).alias("f")).select("part", "f.id", "f.digest").collect())
    ahead = [(p, i, d, firsts[k - 1][0]) for k, (p, i, d) in enumerate(firsts)]  # one row a part
    if not ahead:
        return source.limit(0).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in (
            "edited_sha256", "fingerprint", "edited_fingerprint")], F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next"))
    table = F.broadcast(docs.sparkSession.createDataFrame(ahead, "part int, first_id long, first_digest long, previous int"))
    is_first = (F.col("order.id") == F.col("first_id")) & (F.col("order.digest") == F.col("first_digest"))
    here = F.struct("part", F.lit(0).alias("tail"))
    there = F.struct(F.col("previous").alias("part"), F.lit(1).alias("tail"))
    dealt = (placed.withColumn("order", order).join(table, "part")
             .withColumn("to", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))))
             .select("to.part", "to.tail", "id", "order", "text"))
    sorted_rows = dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", "order.id", "order.digest").drop("order")
    result = sorted_rows.mapInArrow(_followed, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                               "edited_fingerprint string, near_edited double, near_next double")
    return result.withColumnRenamed("id", key)
