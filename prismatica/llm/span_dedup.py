"""Exact repeated passages over a whole corpus, by suffix sorting of the places that can repeat.

A byte goes if some ``length``-byte string over it also starts at another place of the
corpus, judged on the input. The work is dealt out so that equal strings meet:

1. Documents are dealt into blocks. Every ``length``-byte string holds an anchor: the
   48-byte gram of least hash in it. Equal strings have equal anchors in equal places.
2. Anchor hashes are dealt into buckets and each block learns which of its anchors also
   stand elsewhere. Copies of a whole text count once; all but one rest from here on.
3. The surroundings of such anchors are dealt into shards by anchor. Each shard sorts its
   suffixes by external induced sorting (``induced.py``); neighbours with a common prefix
   of ``length`` bytes at different places are repeats. Equal surroundings are sorted once.
4. The repeats go back to their blocks and are joined into maximal spans.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from prismatica.llm.common import MIX1, dealt, mixed, shares, ship, whole_text
from prismatica.llm.induced import sorted_suffixes

ship(sys.modules[__name__])

GRAM = 48
CHUNK = 1 << 16
STEP = np.uint64(0x9E3779B97F4A7C15)


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The anchors of all ``length``-byte strings that lie within one of the texts
    [starts[i], ends[i]) of ``data``: positions, hashes, and the first and last start of the
    strings that an anchor serves. Each string is served by one anchor."""
    width = length - GRAM + 1
    found = []
    for low in range(0, max(0, len(data) - length + 1), CHUNK):
        n = min(CHUNK, len(data) - length + 1 - low)
        words = np.ndarray((n + length - 8,), "<u8", data, offset=low, strides=(1,))
        h = words[:-8] * STEP + words[8:]
        h ^= h >> np.uint64(29)
        h = h[:-16] * STEP + h[16:]
        h ^= h >> np.uint64(29)
        h = mixed(h[:n + length - GRAM] * STEP + words[32:32 + n + length - GRAM] * MIX1 + words[40:40 + n + length - GRAM])
        ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(h) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:len(h)] = ranked
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(rows, axis=1).ravel()
        least = np.minimum(ahead[:n], behind[width - 1:width - 1 + n])
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        at = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        found.append((at + low, h[at], first + low, np.append(first[1:] - 1, n - 1) + low))
    if not found:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.uint64, np.int64, np.int64))
    at, key, first, last = (np.concatenate(x) for x in zip(*found))
    same = np.append(False, at[1:] == at[:-1])  # one anchor on both sides of a chunk's end
    group = np.flatnonzero(~same)
    last = last[np.append(group[1:] - 1, len(at) - 1)]
    at, key, first = at[group], key[group], first[group]
    text = np.searchsorted(starts, at, side="right") - 1
    first, last = np.maximum(first, starts[text]), np.minimum(last, ends[text] - length)
    served = first <= last
    return at[served], key[served], first[served], last[served]


class _Block:
    """The distinct texts of a block, in the order of their digests, and their anchors."""

    def __init__(self, texts: pa.ChunkedArray, length: int, buckets: int, anchored: bool = True):
        raw = [t.as_py().encode("utf-8", "surrogatepass") for t in texts]
        self.row_units = [hashlib.sha256(b).digest() for b in raw]
        units = dict(sorted(zip(self.row_units, raw)))
        self.units, self.texts = list(units), list(units.values())
        self.place = {u: i for i, u in enumerate(self.units)}
        if not anchored:
            return
        self.data = b"".join(self.texts)
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in self.texts]))).astype(np.int64)
        self.at, key, self.first, self.last = anchors(self.data, self.starts[:-1], self.starts[1:], length)
        self.unit = np.searchsorted(self.starts, self.at, side="right") - 1
        self.bucket = (key >> np.uint64(20)).astype(np.int64) % buckets
        order = np.lexsort((self.unit, key, self.bucket))
        self.key = key[order]
        self.unit, self.bucket, self.first, self.last = (x[order] for x in (self.unit, self.bucket, self.first, self.last))

    def parts(self):
        """(bucket, slice of the anchors in it)."""
        edges = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1])) if len(self.bucket) else []
        for a, b in zip(edges, [*edges[1:], len(self.bucket)]):
            yield int(self.bucket[a]), slice(a, b)


def _ask(length: int, buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        block = _Block(docs.column("text"), length, buckets)
        ids = np.array([int.from_bytes(u[:8], "little") for u in block.units], np.uint64)
        unit = ids[block.unit] if len(ids) else np.empty(0, np.uint64)
        again = np.zeros(len(unit), bool)  # the same anchor once more in the same text
        again[1:] = (block.key[1:] == block.key[:-1]) & (unit[1:] == unit[:-1])
        unit = unit ^ again.astype(np.uint64)
        rows = [(b, block.key[s].tobytes(), unit[s].tobytes()) for b, s in block.parts()]
        return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
                         "keys": pa.array([r[1] for r in rows], pa.binary()), "units": pa.array([r[2] for r in rows], pa.binary())})
    return run


def _answer(asked: pa.Table) -> pa.Table:
    """For each block's anchors in this bucket, which stand in several places."""
    keys = [np.frombuffer(k.as_buffer(), np.uint64) for k in asked.column("keys")]
    units = np.concatenate([np.frombuffer(u.as_buffer(), np.uint64) for u in asked.column("units")])
    every = np.concatenate(keys)
    order = np.lexsort((units, every))
    every, units = every[order], units[order]
    other = (every[1:] == every[:-1]) & (units[1:] != units[:-1])
    repeated = np.unique(every[1:][other])
    bits = [np.packbits(np.isin(k, repeated)).tobytes() for k in keys]
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "bits": pa.array(bits, pa.binary()),
                     "unit": pa.nulls(len(bits), pa.binary()), "rests": pa.nulls(len(bits), pa.bool_())})


def _surroundings(length: int, buckets: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("unit", pa.binary()), ("start", pa.int64()), ("piece", pa.binary())])

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        block = _Block(docs.column("text"), length, buckets)
        flag = np.zeros(len(block.unit), bool)
        where = dict(block.parts())
        rests = np.zeros(len(block.units), bool)
        for row in told.to_pylist():
            if row["bits"] is not None:
                s = where[row["bucket"]]
                flag[s] = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=s.stop - s.start)
            elif row["rests"] and row["unit"] in block.place:
                rests[block.place[row["unit"]]] = True
        if len(rests):
            flag &= ~rests[block.unit]
        unit = block.unit[flag]
        low, a, z = block.starts[unit], block.first[flag], block.last[flag] + length
        number = docs.column("block")[0].as_py()
        return pa.table([pa.array(block.bucket[flag].astype(np.int32)), pa.array(np.full(len(unit), number, np.int32)),
                         pa.array([block.units[u] for u in unit], pa.binary()), pa.array(a - low),
                         pa.array([block.data[i:j] for i, j in zip(a, z)], pa.binary())], schema=schema)
    return run


def _repeats(length: int, held: int):
    """Spans of a shard that stand at another place too: block, unit, start, end."""
    schema = pa.schema([("block", pa.int32()), ("unit", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])

    def run(shard: pa.Table) -> pa.Table:
        pieces: dict[bytes, int] = {}
        which = np.array([pieces.setdefault(p.as_py(), len(pieces)) for p in shard.column("piece")], np.int64)
        units: dict[bytes, int] = {}
        unit = np.array([units.setdefault(u.as_py(), len(units)) for u in shard.column("unit")], np.int64)
        start = shard.column("start").to_numpy()
        texts = list(pieces)
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        raw = b"\xfe".join(texts)
        place = unit * (1 << 40) + start  # where a piece stands, as a number
        low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), -1)
        np.minimum.at(low, which, place)
        np.maximum.at(high, which, place)
        order, common = sorted_suffixes(raw, length, held)
        piece = np.searchsorted(base, order, side="right") - 1
        offset = order - base[piece]
        first = np.cumsum(common < length) - 1  # runs of suffixes that share their first bytes
        edges = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        lows, highs = np.minimum.reduceat(low[piece] + offset, edges), np.maximum.reduceat(high[piece] + offset, edges)
        hit = (lows != highs)[first] & (offset + length <= sizes[piece])
        marks = np.zeros(len(raw) + 1, bool)
        marks[order[hit]] = True
        turns = np.flatnonzero(np.diff(np.concatenate(([False], marks)).astype(np.int8)))
        begin, end = turns[::2], turns[1::2]  # runs of repeated starts; separators part the pieces
        of = np.searchsorted(base, begin, side="right") - 1
        spans_at = np.searchsorted(of, np.arange(len(texts) + 1))
        count = (spans_at[1:] - spans_at[:-1])[which]
        rows = np.repeat(np.arange(len(which)), count)
        span = np.concatenate([np.arange(spans_at[w], spans_at[w + 1]) for w in which]) if len(rows) else np.empty(0, np.int64)
        shift = start[rows] - base[which[rows]]
        found = shard.select(["block", "unit"]).take(pa.array(rows))
        return pa.table([found.column(0), found.column(1), pa.array(begin[span] + shift), pa.array(end[span] - 1 + length + shift)], schema=schema)
    return run


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(length: int, columns: list[str]):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(docs.column("text"), length, 1, anchored=False)
        spans: dict[bytes, list] = {}
        copied = set()
        for row in told.to_pylist():
            if row["copied"]:
                copied.add(row["unit"])
            else:
                spans.setdefault(row["unit"], []).append((row["start"], row["end"]))
        results = {}
        for unit, text in zip(block.units, block.texts):
            cut = [(0, len(text))] if unit in copied and len(text) >= length else _joined(spans.get(unit, []))
            edges = [0, *(x for span in cut for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            results[unit] = (len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in cut], kept)
        rows = [results[u] for u in block.row_units]
        made = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([r[3].decode("utf-8", "ignore") for r in rows], pa.string())]
        return pa.table([docs.column(c) for c in columns] + made,
                        names=columns + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, share_mb: int = 4,
                   held: int = 4_000_000) -> DataFrame:
    """Each row of ``docs`` with n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in
    bytes) and kept, the rest as text without characters that were cut in two.

    A null text counts as empty; rows that repeat a whole text of ``length`` bytes or more
    lose all of it, shorter ones nothing. Null and repeated keys are allowed: key and
    text deal rows out, so rows equal in both meet in one block. Columns of ``docs`` keep their names; a name that clashes with a new
    column gives way to it. An empty table gives an empty one.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    carried = [c for c in docs.columns if c not in new]
    n = shares(docs, F.col(text), share_mb)
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]
    whole = docs.select(*named, whole_text(F.col(text)).alias("text"), dealt(F.col(key), whole_text(F.col(text)), n).alias("block"))
    blocks = whole.groupBy("block")

    texts = whole.select(F.unhex(F.sha2("text", 256)).alias("unit"), "block")
    copies = texts.groupBy("unit").agg(F.min("block").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    held_in = texts.distinct().join(copies, "unit").select("block", "unit", (F.col("block") != F.col("first")).alias("rests"))

    asked = blocks.applyInArrow(_ask(length, n), "block int, bucket int, keys binary, units binary")
    told = asked.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, bits binary, unit binary, rests boolean")
    told = told.unionByName(held_in.filter("rests"), allowMissingColumns=True)
    pieces = blocks.cogroup(told.groupBy("block")).applyInArrow(
        _surroundings(length, n), "shard int, block int, unit binary, start long, piece binary")
    spans = pieces.groupBy("shard").applyInArrow(_repeats(length, held), "block int, unit binary, start long, end long")
    known = spans.withColumn("copied", F.lit(False)).unionByName(
        held_in.select("block", "unit", F.lit(True).alias("copied")), allowMissingColumns=True)
    columns = [f"c{i}" for i in range(len(carried))]
    kinds = {f.name: f.dataType for f in docs.schema}
    made = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                "spans array<struct<start:long,end:long>>, kept string")
    schema = T.StructType([T.StructField(c, kinds[name]) for c, name in zip(columns, carried)] + made.fields)
    done = blocks.cogroup(known.groupBy("block")).applyInArrow(_removed(length, columns), schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *new)
