"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other figures or
other people has the same template. Windows of template words are joined by hash with those
of the benchmark; matches line up on diagonals (place in the document minus place in the
item). On a diagonal each value of the item must stand for one value of the document, and
names and units for different ones if they differ, or it does not count. A document holds an
item if consistent diagonals cover enough of its windows.

Whether a word is a name hangs on its capital, so windows with names are also compared with
the names as plain words: copies in other letter case are found at any length of the item.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import mixed, ship, whole_text

ship(sys.modules[__name__])

WINDOW, SHARE = 5, 0.8
WHOLE = -1  # the place of an item without windows, which is sought as a whole
FILTER_BITS = 24  # a bit for each possible start of a window hash: 2 MB, whatever the benchmark's size
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|e[+-]?\d+)?")
# Words for numbers, and units that count as such after a number.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours minutes seconds days weeks months years "
                  "percent dollars euros cents meters metres kilometers miles grams kilograms pounds liters litres degrees".split())
LITERAL, NUM, UNIT, EMPTY = 0, 1, 2, 3
HOLES = {NUM: np.uint64(xxhash.xxh3_64_intdigest(b"\x00number")), UNIT: np.uint64(xxhash.xxh3_64_intdigest(b"\x00unit")),
         4: np.uint64(xxhash.xxh3_64_intdigest(b"\x00name"))}


class _Words(dict):
    """Number of each raw word, with its bare form, hash and kind in arrays."""

    def __init__(self):
        super().__init__()
        self.bare: list[str] = []
        self.hashes, self.kinds, self.marks = [], [], []

    def __missing__(self, raw: str) -> int:
        bare = raw.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡")
        low = bare.lower()
        kind = (EMPTY if not bare else NUM if NUMBER.fullmatch(low) or low in NUMBER_WORDS else UNIT if low in UNITS else LITERAL)
        self.bare.append(low)
        self.hashes.append(xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.kinds.append(kind)
        # 1: capitalised; 2: the next word may start a sentence
        self.marks.append(int(bare[:1].isupper() and not bare.isupper()) + 2 * (not raw[-1:].isalnum() and raw[-1:] not in ",'’)"))
        n = self[raw] = len(self.bare) - 1
        return n


def _spans(h: np.ndarray, seed: int):
    """A function of start and length: the hash of so many words from there."""
    n = len(h)
    up, down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, x, np.uint64)))) for x in (STEP, BACK))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)))
    return lambda at, size: mixed((sums[at + size] - sums[at]) * down[at] + mixed(size.astype(np.uint64) * STEP + np.uint64(seed)))


def _windows(width: int, filter_bits: bytes | None, sizes: list[int] | None):
    """Windows of a batch, with their names as holes and, where they have any, as plain words. Of a benchmark
    (no ``sizes``) the first word counts as a name too, as it may in the middle of a sentence; of documents
    also the spans of ``sizes`` words. Values of numbers start with #."""
    item = sizes is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        bits = None if filter_bits is None else np.frombuffer(filter_bits, np.uint8)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                if len(words) > 120_000:  # some 16 MB
                    words = _Words()
                texts = [t.as_py().split() for t in some.column(1)]
                flat = np.fromiter(map(words.__getitem__, chain.from_iterable(texts)), np.int64)
                row = np.repeat(np.arange(len(texts)), [len(ws) for ws in texts])
                kind, mark = np.array(words.kinds, np.int8), np.array(words.marks, np.int8)
                kept = kind[flat] != EMPTY if len(flat) else np.zeros(0, bool)
                flat, row = flat[kept], row[kept]
                n = len(flat)
                if not n:
                    continue
                first = np.append(True, row[1:] != row[:-1])
                place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
                m = mark[flat]
                plain = kind[flat].copy()
                after, number_before = np.zeros(n, bool), np.zeros(n, bool)
                after[1:] = ((m[:-1] & 2) == 0) & ~first[1:]
                number_before[1:] = (plain[:-1] == NUM) & ~first[1:]
                plain[(plain == UNIT) & ~number_before] = LITERAL
                named = (plain == LITERAL) & ((m & 1) == 1)
                exact = np.array(words.hashes, np.uint64)[flat]
                count = max(0, n - width + 1)
                inside = row[:count] == row[width - 1:width - 1 + count]

                def hashed(k: np.ndarray) -> np.ndarray:
                    h = exact.copy()
                    for hole, value in HOLES.items():
                        h[k == hole] = value
                    return h

                def keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
                    x = np.full(len(at), np.uint64(width))
                    for i in range(width):
                        x = mixed(x * STEP + h[at + i])
                    return x

                def told(k: np.ndarray, at: np.ndarray, size) -> np.ndarray:
                    """Which spans have two literal words or more."""
                    literal = np.concatenate(([0], np.cumsum(k == LITERAL)))
                    return literal[at + size] - literal[at] >= 2

                # start, length, hash, place, kinds (None: values do not matter) of windows and of whole items
                found = []
                good = np.zeros(count, bool)
                kinds = []
                for names in (named & after, named & (after | first)) if item else (named & after,):
                    k = np.where(names, np.int8(4), plain)
                    kinds.append(k)
                    at = np.flatnonzero(inside & first[:count] if len(kinds) > 1 else inside)
                    at = at[told(k, at, width)]
                    good[at] = True
                    found.append((at, np.full(len(at), width), keys(hashed(k), at), place[at], k))
                # the same windows with their names as plain words; of an item only where it has a window anyway
                some_name = np.concatenate(([0], np.cumsum(kinds[-1] == 4)))
                at = np.flatnonzero((good if item else inside) & (some_name[width:] > some_name[:count]) if count else good)
                at = at[told(plain, at, width)]
                found.append((at, np.full(len(at), width), keys(hashed(plain), at), place[at], plain))
                if item:
                    begin = np.flatnonzero(first)
                    begin = begin[np.bincount(row[:count][good], minlength=len(texts))[row[begin]] == 0]
                    spans = [(begin, np.bincount(row, minlength=len(texts))[row[begin]])]
                else:
                    spans = [(i := np.flatnonzero(row[:n - size + 1] == row[size - 1:]), np.full(len(i), size)) for size in sizes if size <= n]
                for i, size in spans:
                    where = np.full(len(i), WHOLE) if item else place[i] + WHOLE
                    found.append((i, size, _spans(exact, 1)(i, size), where, None))
                    for k in kinds:
                        good_span = told(k, i, size)
                        found.append((i[good_span], size[good_span], _spans(hashed(k), 2)(i[good_span], size[good_span]), where[good_span], k))
                for at, size, key, where, k in found:
                    if bits is not None:
                        top = (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        hit = (bits[top >> 3] >> (top & 7).astype(np.uint8)) & 1 == 1
                        at, size, key, where = at[hit], size[hit], key[hit], where[hit]
                    if not item and k is None:  # once a text
                        _, once = np.unique(np.column_stack((row[at].astype(np.uint64), key)), axis=0, return_index=True)
                        at, size, key, where = at[once], size[once], key[once], where[once]
                    if not len(at):
                        continue
                    slots = [[("#" if k[j] == NUM else "") + words.bare[flat[j]] for j in range(i, i + c) if k[j] != LITERAL] if k is not None else []
                             for i, c in zip(at.tolist(), size.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(pa.array(row[at])), pa.array(key.view(np.int64)), pa.array(where.astype(np.int32)),
                         pa.array(slots, pa.list_(pa.string())), pa.array(size.astype(np.int32))], names=["id", "window", "place", "slots", "size"])
    return run


def _bitmap(windows: DataFrame) -> bytes:
    """One bit for each leading ``FILTER_BITS`` bits that a window has; fixed size."""
    top = F.shiftrightunsigned("window", 64 - FILTER_BITS)
    rows = windows.select(F.shiftright(top, 5).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (top % 32).cast("int")).alias("bit")
                          ).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for at, value in rows:
        bits[at] = value
    return bits.tobytes()


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", width: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(key, item, share, windows, changed): the items that a document holds. ``share`` is the part
    of the item's template windows found, ``changed`` tells that some value differs.

    Null and empty texts hold nothing, and no document holds a null or empty item. Windows with
    fewer than two literal words say nothing and are left out on both sides. Items without windows
    are sought as a whole: word by word, and as a template if two of their words are literal.
    Two numbers of an item may become one number in a document, two names or units may not.
    Each text counts by itself, of documents and of items: rows that share a key or an item id, null
    ones included, give one row a key and item id, with the share and windows of the text held best, and
    ``changed`` if one of those that are held has other values. Extra columns are not read.
    """
    kinds = dict(docs.dtypes)
    schema = "id {}, window long, place int, slots array<string>, size int"
    digest = lambda text: F.unhex(F.sha2(text, 256))
    sought_text = whole_text(F.col(item_text))
    names = benchmark.select(digest(sought_text).alias("item"), F.col(f"`{item}`").alias("item_id")).distinct()
    items = benchmark.select(digest(sought_text).alias("id"), sought_text.alias("text")).dropDuplicates(["id"])
    items = items.mapInArrow(_windows(width, None, None), schema.format("binary")).distinct()
    sizes = [r[0] for r in items.filter(F.col("place") == WHOLE).select("size").distinct().collect()]  # one row a length
    whole = whole_text(F.col(text))
    sought = docs.select(F.struct(F.col(f"`{key}`").alias("key"), digest(whole).alias("digest")).alias("id"), whole.alias("text"))
    found = sought.mapInArrow(_windows(width, _bitmap(items), sorted(sizes)), schema.format(f"struct<key:{kinds[key]},digest:binary>")).distinct()
    parts = items.select("window", F.col("id").alias("item"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    totals = items.groupBy(F.col("id").alias("item")).agg(F.count_distinct(F.when(F.col("place") != WHOLE, F.col("place"))).alias("windows"))
    hits = found.join(parts, "window").select("id", "item", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_place",
                                              F.arrays_zip("item_slots", "slots").alias("values"))
    lines = hits.groupBy("id", "item", "diagonal").agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"))
    of_item = F.transform("values", lambda v: v["item_slots"])
    told_apart = F.transform(F.filter("values", lambda v: ~F.startswith(v["slots"], F.lit("#"))), lambda v: v["slots"])
    consistent = (F.size("values") == F.size(F.array_distinct(of_item))) & (F.size(told_apart) == F.size(F.array_distinct(told_apart)))
    lines = lines.filter(consistent).withColumn("changed", F.exists("values", lambda v: v["item_slots"] != v["slots"]))
    places = F.array_distinct(F.flatten(F.collect_list("places")))
    held = lines.groupBy("id", "item").agg(F.size(F.array_remove(places, WHOLE)).alias("covered"), F.array_contains(places, WHOLE).alias("whole"),
                                           F.bool_or("changed").alias("changed")).join(totals, "item")
    held = held.filter(F.col("whole") | (F.col("covered") >= share * F.col("windows"))).withColumn(
        "part", F.when(F.col("whole"), 1.0).otherwise(F.col("covered") / F.col("windows")))
    best = held.join(names, "item").groupBy(F.col("id.key").alias("key"), "item_id").agg(
        F.max(F.struct("part", "windows")).alias("best"), F.bool_or("changed").alias("changed"))
    return best.select(F.col("key").alias(key), F.col("item_id").alias(item), F.col("best.part").alias("share"),
                       F.col("best.windows").cast("long").alias("windows"), "changed")
