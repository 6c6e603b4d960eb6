"""Near-duplicates: universal hash minima, banding, signature check, exact check, components.

1. Every document becomes its set of distinct word shingles (64-bit hashes). Documents
   with equal sets form a class at once, so copies cost one row each from there on.
2. A class signature has ``bands * rows`` minima under universal hash functions; equal
   bands bring classes into a bucket.
3. Round one links each bucket's members to its smallest one. Round two looks only at
   buckets that still hold several components and compares members across components inside
   the tasks, block by block; it returns the links that join components, so pairs are never rows.
4. A candidate pair must pass the signature estimate and then the exact set comparison.
5. Components come from alternating large-star and small-star.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import WordHashes, bitmap, in_bitmap, ship, shingle_set, stored, whole_text, words_of
from prismatica.llm.components import components

ship(sys.modules[__name__])

BANDS, ROWS = 25, 5
#: Shingles of the members of a bucket that are compared in one go; larger buckets are cut into blocks.
BLOCK = 1 << 20


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The upper 32 bits of the minimum of ``a * x + b mod 2^64`` per function."""
    a, b = functions
    least = np.full(len(a), np.uint64(2**64 - 1), np.uint64)
    for low in range(0, len(shingles), 1024):  # all functions over a piece that stays in the cache
        values = np.multiply.outer(a, shingles[low:low + 1024])
        values += b[:, None]
        np.minimum(least, values.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signatures(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, functions = WordHashes(120_000), _functions(bands * rows)
        for batch in batches:
            sizes, digests, keys, signatures = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(hashes.all(words_of(text.as_py())), width)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), keys.append(None), signatures.append(None)
                    continue
                m = minima(s, functions)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append([xxhash.xxh3_64_intdigest(m[i * rows:(i + 1) * rows].tobytes(), i) - 2**63 for i in range(bands)])
                signatures.append(m.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["id", "n_shingles", "digest", "keys", "signature"])
    return run


def _sets(width: int, bits: bytes):
    """Sets of the rows whose id is in the bitmap, so that only those are shuffled afterwards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wanted = WordHashes(120_000), np.frombuffer(bits, np.uint32)
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(in_bitmap(wanted, batch.column(2).to_numpy()))))
            sets = [shingle_set(hashes.all(words_of(t.as_py())), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())],
                names=["id", "digest", "shingles"])
    return run


def _estimated(least: float):
    """Pairs whose signatures agree in at least this share of places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool((np.frombuffer(x.as_buffer(), np.uint8) == np.frombuffer(y.as_buffer(), np.uint8)).mean() >= least)
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _across(least: float, percent: int):
    """Links between different components inside each bucket, as many as join its components and
    no more. Rows come sorted by ``bucket``, ``low`` and ``high``: the two blocks of a bucket that
    meet (equal for pairs inside a block). Pairs whose signatures agree in ``least`` of the places
    are compared on their full sets; pairs are never rows."""
    def joins(ids: list, component: list, second: list, signature: list, sets: list) -> list[tuple]:
        _, root = np.unique(np.array(component), return_inverse=True)
        order = np.argsort(second, kind="stable")
        ids, root, sets = [ids[k] for k in order], root[order], [np.frombuffer(sets[k], np.uint64) for k in order]
        sign = np.frombuffer(b"".join(signature[k] for k in order), np.uint8).reshape(len(ids), -1)
        size = np.array([len(s) for s in sets])
        words, place = np.unique(np.concatenate(sets), return_inverse=True)
        place = np.split(place, np.cumsum(size)[:-1])
        held, inner = np.zeros(len(words), bool), int(np.sum(second))
        inner = len(ids) - inner if inner else 0  # where the second block starts
        wanted, found = least * sign.shape[1], []
        for i in range(inner or len(ids)):
            near = max(i + 1, inner)
            near = near + np.flatnonzero(root[near:] != root[i])
            near = near[(sign[near] == sign[i]).sum(1) >= wanted]
            if not len(near):
                continue
            held[place[i]] = True
            starts = np.concatenate(([0], np.cumsum(size[near])[:-1]))
            common = np.add.reduceat(held[np.concatenate([place[j] for j in near])], starts, dtype=np.int64)
            held[place[i]] = False
            for j in near[100 * common >= percent * (size[i] + size[near] - common)]:
                if root[j] != root[i]:
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    root[root == root[j]] = root[i]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, kind = None, [], None

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], kind), pa.array([b for _, b in found], kind)],
                                              names=["a", "b"])

        for batch in batches:
            kind, found = batch.schema.field("id").type, []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[:3] != now:
                    found += joins(*zip(*members)) if len(members) > 1 else []
                    now, members = row[:3], []
                members.append(row[3:])
            yield out(found)
        if len(members) > 1:
            yield out(joins(*zip(*members)))
    return run


def _linked(percent: int):
    """Pairs of sets with ``100 * |x & y| >= percent * |x | y|``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                common = both - len(np.union1d(x, y)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * common >= percent * (both - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _with_both(pairs: DataFrame, payload: DataFrame, name: str) -> DataFrame:
    first = payload.select(F.col("id").alias("a"), F.col(name).alias("x"))
    second = payload.select(F.col("id").alias("b"), F.col(name).alias("y"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Rows whose sets of ``width``-word
    shingles meet ``100 * common >= percent * union`` are linked; a row's component is the
    smallest key reachable from it. Null and empty texts have an empty set and link to nothing.
    Rows with a null key keep a null component; rows that share a key share its component.
    Extra columns are not read.
    """
    source = docs.select(F.col(key).alias("id"), whole_text(F.col(text)).alias("text"))
    signed = stored(source.mapInArrow(_signatures(bands, rows, width),
                                      f"id {dict(docs.dtypes)[key]}, n_shingles long, digest binary, keys array<long>, signature binary"))
    sets = signed.filter("digest is not null and id is not null")
    classes = sets.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = sets.join(classes.withColumnRenamed("rep", "id"), ["digest", "id"]).dropDuplicates(["digest"])
    entries = reps.select("id", F.explode("keys").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("bucket", "a")
    buckets = stored(entries.join(shared, "bucket"))

    least = percent / 100 - 0.18  # five standard deviations of an estimate by 125 minima

    def full_sets(ids: DataFrame) -> DataFrame:
        hashed = F.xxhash64("id")
        found = source.filter("id is not null").select("id", "text", hashed.alias("h")).mapInArrow(
            _sets(width, bitmap(ids, hashed)), f"id {dict(docs.dtypes)[key]}, digest binary, shingles binary")
        return found.join(ids, "id")

    candidates = buckets.filter("id > a").select("a", F.col("id").alias("b"))
    hopeful = stored(_with_both(candidates.distinct(), reps, "signature").mapInArrow(_estimated(least), candidates.schema))
    ends = hopeful.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = stored(_with_both(hopeful, full_sets(ends), "shingles").mapInArrow(_linked(percent), candidates.schema))
    found = components(links)
    named = buckets.select("bucket", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component"))
    # Buckets of several bands often hold the same members; one of them stands for all.
    mixed = (named.groupBy("bucket").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n"),
                                         F.expr("bit_xor(xxhash64(id))").alias("x"), F.expr("bit_xor(xxhash64(id, 1))").alias("y"))
             .filter("c < d").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"))
    entries = stored(named.join(mixed, "bucket").join(reps.select("id", "digest", "n_shingles", "signature"), "id"))
    blocks = entries.groupBy("bucket").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"))
    shingles = full_sets(entries.select("id").distinct()).select("digest", "shingles").dropDuplicates(["digest"])
    own, other = F.expr("cast(pmod(xxhash64(id), blocks) as int)"), F.col("other")
    met = (entries.join(blocks, "bucket").withColumn("own", own)
           .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
           .select("bucket", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), "id", "component",
                   (F.col("own") > other).cast("int").alias("second"), "signature", "digest"))
    met = (met.join(shingles, "digest").drop("digest").repartition("bucket", "low", "high")
           .sortWithinPartitions("bucket", "low", "high"))
    more = stored(met.mapInArrow(_across(least, percent), links.schema))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    members = sets.select("id", "digest").join(classes, "digest").select(F.col("id").alias("member"), "rep")
    # A class is one more link: copies of a set whose keys carry other components through repeated keys.
    joined = members.join(found, members["rep"] == found["node"], "left").select(
        "member", F.coalesce("component", "rep").alias("component")).groupBy("member").agg(F.min("component").alias("component"))
    return (signed.join(joined, signed["id"] == joined["member"], "left")
            .select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id")))
