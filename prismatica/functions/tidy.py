"""Reshaping helpers: one wide aggregate to one row per column, one row per
cell, and per-column frequency tables."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from prismatica.functions.coerce import to_time
from prismatica.functions.columns import dtype_of, value

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Expressions per aggregate; beyond this the generated method grows past what
# the JVM compiles and the aggregate runs interpreted, ten times slower.
EXPRESSIONS_PER_AGG = 30

_LONG_SLOT = (T.IntegralType, T.BooleanType)
_TIME_SLOT = (T.TimestampType, T.TimestampNTZType)
_DIGEST_FROM = 64
# Columns of a table up to which each may be scanned by itself; beyond, a plan of such scans gets too long.
ALONE = 64


def column_rows(df: DataFrame, specs: list[tuple[str, dict[str, Column]]],
                numbers: list[int] | None = None) -> DataFrame:
    """Run every column's aggregates in one scan; return one row per column.

    ``specs`` holds (column name, {result name: aggregate}); all entries share
    the same result names. Wide tables are cut into several aggregates.
    """
    if not specs:
        raise ValueError("no columns to aggregate")
    names = list(specs[0][1])
    numbers = numbers or list(range(len(specs)))
    step = max(1, EXPRESSIONS_PER_AGG // max(len(names), 1))
    parts = []
    for start in range(0, len(specs), step):
        chunk = list(zip(numbers, specs))[start:start + step]
        wide = df.agg(*[
            agg.alias(f"a{no}_{k}")
            for no, (_, aggs) in chunk for k, agg in enumerate(aggs.values())
        ])
        rows = F.array(*[
            F.struct(F.lit(no).alias("col_no"), F.lit(name).alias("column"),
                     *[F.col(f"a{no}_{k}").alias(a) for k, a in enumerate(names)])
            for no, (name, _) in chunk
        ])
        parts.append(wide.select(F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def empty_rows(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def digested(s: Column) -> Column:
    """Text of up to 64 characters as it is, longer text as its SHA-256."""
    return F.when(F.length(s) > _DIGEST_FROM, F.sha2(s, 256)).otherwise(s)


def cells(df: DataFrame, columns: list[str] | None = None, digest: bool = False) -> DataFrame:
    """One row per cell: col_no and the value in a long, double or string slot.

    Each type keeps its own slot, so equality is exact (no casts of numbers to
    text). With ``digest`` long strings are replaced by their SHA-256, which
    keeps distinct counts right and whole documents out of the shuffle; a fourth
    slot then tells of those strings, while they are at hand, whether they are dates.
    """
    columns = columns if columns is not None else df.columns
    packed = []
    for i, name in enumerate(columns):
        dtype, v = dtype_of(df, name), value(df, name)
        slots = {"l": F.lit(None).cast("long"), "d": F.lit(None).cast("double"),
                 "s": F.lit(None).cast("string")}
        if digest:
            slots["t"] = F.lit(None).cast("boolean")
        if isinstance(dtype, _LONG_SLOT):
            slots["l"] = v.cast("long")
        elif isinstance(dtype, _TIME_SLOT):
            slots["l"] = F.unix_micros(v.cast("timestamp"))
        elif isinstance(dtype, T.DateType):
            slots["l"] = F.unix_date(v).cast("long")
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            slots["d"] = v.cast("double")
        else:
            slots["s"] = digested(v.cast("string")) if digest else v.cast("string")
            if digest:
                slots["t"] = F.when(F.length(v.cast("string")) > _DIGEST_FROM, to_time(v).isNotNull())
        packed.append(F.struct(*[c.alias(k) for k, c in slots.items()]).alias(str(i)))
    long = df.select(*packed).unpivot([], [str(i) for i in range(len(columns))], "col_no", "v")
    return long.select(F.col("col_no").cast("int"), "v.l", "v.d", "v.s", *["v.t"] * digest)


def value_counts(df: DataFrame, columns: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Frequency of every distinct value of every column, in one shuffle.

    Repeats collapse before the shuffle, so a value that fills a third of a
    column costs one row per task.
    """
    return cells(df, columns, digest).groupBy("col_no", "l", "d", "s", *["t"] * digest).agg(F.count(F.lit(1)).alias("n"))


def slot_counts(df: DataFrame) -> list[DataFrame]:
    """The rows of ``value_counts(df, digest=True)``, the columns of each slot apart: (col_no, v, t, n).

    A scan per column, or per slot of a wide table, that reads no other columns, with keys of one
    narrow type instead of all three. For tables that are read many times anyway.
    """
    slots: dict[str, dict[str, Column]] = {}
    for i, name in enumerate(df.columns):
        dtype, v = dtype_of(df, name), value(df, name)
        if isinstance(dtype, _LONG_SLOT):
            slot, v = "long", v.cast("long")
        elif isinstance(dtype, _TIME_SLOT):
            slot, v = "long", F.unix_micros(v.cast("timestamp"))
        elif isinstance(dtype, T.DateType):
            slot, v = "long", F.unix_date(v).cast("long")
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            slot, v = "double", v.cast("double")
        else:
            slot, v = "string", v.cast("string")
        slots.setdefault(slot, {})[str(i)] = v
    found = []
    for slot, columns in slots.items():
        v = F.col("v")
        long = (df.select(*[c.alias(i) for i, c in columns.items()]).unpivot([], list(columns), "col_no", "v")
                .withColumn("col_no", F.col("col_no").cast("int")))
        scans = [df.select(F.lit(int(i)).alias("col_no"), c.alias("v")) for i, c in columns.items()] if len(df.columns) <= ALONE else [long]
        dated = F.when(F.length(v) > _DIGEST_FROM, to_time(v).isNotNull())
        n, freqs = F.count(F.lit(1)).alias("n"), None
        for scan in scans:
            if slot == "string":
                freq = scan.select("col_no", digested(v).alias("v"), dated.alias("t")).groupBy("col_no", "v", "t").agg(n)
            else:
                freq = scan.groupBy("col_no", "v").agg(n).select("col_no", "v", F.lit(False).alias("t"), "n")
            freqs = freq if freqs is None else freqs.unionByName(freq)
        found.append(freqs)
    return found


def most_frequent(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_no, unique, total, n, l, d, s): per column with values its distinct and filled
    counts, and the most frequent value with its count; the smallest of a tie.

    Texts over 64 characters are counted by their first 64 and a SHA-256, so no whole text
    is a key of the shuffle. The text itself is fetched by a second scan, only of columns
    whose winner is a long one and only from rows that start like it; where several tied
    texts start alike, the least of them is taken there. The second scan is empty work
    where every winner is short.
    """
    columns = columns if columns is not None else df.columns
    long = cells(df, columns)
    far = F.length("s") > _DIGEST_FROM
    head = F.left("s", F.lit(_DIGEST_FROM))
    digest = F.when(far, F.unhex(F.sha2("s", 256)))
    counts = (long.filter("l is not null or d is not null or s is not null")
              .select("col_no", "l", "d", head.alias("head"), digest.alias("digest"))
              .groupBy("col_no", "l", "d", "head", "digest").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("col_no").agg(
        F.count(F.lit(1)).alias("unique"), F.sum("n").alias("total"),
        F.min(F.struct((-F.col("n")).alias("k"), "l", "d", "head", F.col("digest").isNotNull().alias("far"))).alias("top"))
    best = best.select("col_no", "unique", "total", (-F.col("top.k")).alias("n"), "top.l", "top.d", "top.head", "top.far")
    asked = best.filter("far").select("col_no", "head", "n")
    tied = counts.filter("digest is not null").join(F.broadcast(asked), ["col_no", "head", "n"]).select("col_no", "digest")
    alike = long.filter(far).withColumn("head", head).join(F.broadcast(asked.select("col_no", "head")), ["col_no", "head"], "left_semi")
    texts = (alike.select("col_no", "s", digest.alias("digest")).join(tied, ["col_no", "digest"], "left_semi")
             .groupBy("col_no").agg(F.min("s").alias("whole")))
    return best.join(F.broadcast(texts), "col_no", "left").select(
        "col_no", "unique", "total", "n", "l", "d", F.coalesce("whole", "head").alias("s"))


def null_counts(df: DataFrame) -> DataFrame:
    """(col_no, rows, missing) of every column: one scan, and no value leaves its task."""
    flags = df.select(*[value(df, c).isNull().alias(str(i)) for i, c in enumerate(df.columns)])
    return (flags.unpivot([], flags.columns, "col_no", "gap").select(F.col("col_no").cast("int"), "gap").groupBy("col_no")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if("gap").alias("missing")))


def _few(most: int):
    """The first ``most`` distinct values of a task's only column; it stops reading when it has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            kept = pc.unique(pa.concat_arrays([*([] if kept is None else [kept]), batch.column(0)]))[:most]
            if len(kept) == most:
                break
        if kept is not None:
            yield pa.RecordBatch.from_arrays([kept], names=["v"])
    return run


def few_values(df: DataFrame, v: Column, most: int) -> DataFrame:
    """Up to ``most`` distinct non-null values of ``v`` as text; each task hands on no more than that."""
    text = df.select(v.cast("string").alias("v")).filter("v is not null")
    return text.select(digested(F.col("v")).alias("v")).mapInArrow(_few(most), "v string").distinct().limit(most)


def _least(most: int):
    """The ``most`` least distinct texts of each column of a task, one row for each place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, names = None, []
        for batch in batches:
            names = batch.schema.names
            kept = kept or [pa.array([], c.type) for c in batch.columns]
            both = [pc.unique(pa.concat_arrays([k, c])).drop_null() for k, c in zip(kept, batch.columns)]
            kept = [b.take(pc.array_sort_indices(b)[:most]) for b in both]
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([k, pa.nulls(most - len(k), k.type)]) for k in kept], names=names)
    return run


def least_texts(texts: DataFrame, most: int) -> DataFrame:
    """One row: the ``most`` least distinct values of each text column, in order, as an array.
    One scan; each task hands on no more than that."""
    few = texts.mapInArrow(_least(most), texts.schema)
    return few.agg(*[F.slice(F.array_sort(F.collect_set(c)), 1, most).alias(c) for c in texts.columns])


def _least_by_column(most: int):
    """By col_no the ``most`` least values of a task's frequency rows, and whether any of them is a digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, far = {}, {}
        for batch in batches:
            number, v, t = (batch.column(i) for i in range(3))
            for no in pc.unique(number).to_pylist():
                mine = pc.equal(number, no)
                values = v.filter(mine).drop_null()
                both = pc.unique(pa.concat_arrays([kept.get(no, pa.array([], v.type)), values]))
                kept[no] = both.take(pc.array_sort_indices(both)[:most])
                far[no] = far.get(no, False) or t.filter(mine).null_count < len(t.filter(mine))
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(kept), pa.int32()), pa.array([k.to_pylist() for k in kept.values()], pa.list_(pa.string())), pa.array(list(far.values()))],
                names=["col_no", "few", "far"])
    return run


def least_counted(freq: DataFrame, most: int) -> DataFrame:
    """(col_no, least): the ``most`` least texts of each column of a :func:`slot_counts` result, in order, as
    an array; null where some are digests. Each task hands on no more than that."""
    few = freq.select("col_no", "v", "t", "n").mapInArrow(_least_by_column(most), "col_no int, few array<string>, far boolean")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("few")))), 1, most)
    return few.groupBy("col_no").agg(F.when(~F.bool_or("far"), least).alias("least"))


def column_names(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """col_no, column and dtype of the listed columns (schema only)."""
    columns = columns if columns is not None else df.columns
    rows = [(i, c, dtype_of(df, c).simpleString()) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "col_no int, column string, dtype string")
