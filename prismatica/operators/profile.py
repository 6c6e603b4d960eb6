"""Profiling: per-column facts, roles, schema report and dataset metadata."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from prismatica.functions import vocabulary as V
from prismatica.functions.coerce import col, percent, to_time
from prismatica.functions.columns import dtype_of, kind_of, moment, value
from prismatica.functions.tidy import (
    column_rows, digested, empty_rows, few_values, least_counted, least_texts, null_counts, slot_counts, value_counts)
from prismatica.plans.settle import settled

FACTS = ("col_no int, column string, dtype string, kind string, rows long, "
         "missing long, distinct long, dated long")


# Suspected copies up to which they are broadcast, and values of a column that make its sample.
SUSPECTS, SAMPLE = 1 << 20, 3


def column_facts(df: DataFrame, apart: bool = False, least: int = 0) -> DataFrame:
    """One row per column: dtype, kind, rows, missing, distinct non-null
    values, and how many text values parse as a date.

    One scan and one shuffle over all columns: the counts are read off the
    frequency table of (column, value). ``apart`` takes a scan for each type
    of slot instead, of the columns that have it, and a third of the time; for
    tables that are cheap to read again. Then ``least`` adds that many least
    distinct values, as an array, of each column of texts of up to 64 characters.
    """
    if not df.columns:
        return empty_rows(df, FACTS + ", least array<string>" * (least > 0))

    def counts(freq: DataFrame, filled: Column, s: Column) -> DataFrame:
        dated = filled & F.coalesce("t", to_time(s).isNotNull())
        return freq.groupBy("col_no").agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(~filled, F.col("n")).otherwise(0)).alias("missing"),
            F.count_if(filled).alias("distinct"),
            F.sum(F.when(dated, F.col("n")).otherwise(0)).alias("dated"))

    if apart:
        slots, none = slot_counts(df), F.lit(None).cast("array<string>")
        parts = [counts(freq, F.col("v").isNotNull(), F.col("v")) for freq in slots]
        if least:
            # Null-safe, so that no filter tells the two uses of the frequencies apart and they are shuffled once.
            parts = [part.join(F.broadcast(least_counted(freq, least).withColumnRenamed("col_no", "no")), F.col("col_no").eqNullSafe(F.col("no")), "left").drop("no")
                     if dtype_of(freq, "v") == T.StringType() else part.withColumn("least", none) for part, freq in zip(parts, slots)]
        counted = parts[0]
        for part in parts[1:]:
            counted = counted.unionByName(part)
    else:
        filled = F.coalesce(F.col("l").isNotNull(), F.lit(False)) | F.col("d").isNotNull() | F.col("s").isNotNull()
        counted = counts(value_counts(df, digest=True), filled, F.col("s"))
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "col_no int, column string, dtype string, kind string")
    zero = F.lit(0).cast("long")
    return F.broadcast(names).join(counted, "col_no", "left").select(
        "col_no", "column", "dtype", "kind",
        *[F.coalesce(c, zero).alias(c) for c in ("rows", "missing", "distinct", "dated")], *["least"] * (least > 0 and apart))


def duplicates(df: DataFrame, apart: bool = False) -> DataFrame:
    """One row: rows and duplicate rows (all rows but the first of each).

    Copies collapse in the partial aggregate, so a row copied a billion times
    costs one record per task. Long texts are compared by their SHA-256, so
    whole documents stay out of the shuffle. ``apart`` counts a hash of each
    row first, at once, and compares only the rows that share theirs, or all
    where most do; for tables that are cheap to read again.
    """
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("duplicate_rows"))
    text = [kind_of(f.dataType) in ("categorical", "complex") for f in df.schema.fields]
    keys = [(digested(value(df, c)) if t else value(df, c)).alias(f"k{i}") for i, (c, t) in enumerate(zip(df.columns, text))]
    rows, names = df.select(*keys), [f"k{i}" for i in range(len(keys))]
    if apart:
        return _copies_of_suspects(rows, names)
    return _copies(rows, names)


def _copies(rows: DataFrame, names: list[str]) -> DataFrame:
    groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def _copies_of_suspects(rows: DataFrame, names: list[str]) -> DataFrame:
    """Equal rows have equal hashes (both zeros are equal, so they are made one); rows alone with theirs have no copy."""
    floating = {f.name for f in rows.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    hashed = F.xxhash64(*[F.col(c) + F.lit(0.0) if c in floating else F.col(c) for c in names]).alias("h")
    twice = settled(rows.select(hashed).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    found = twice.agg(F.count(F.lit(1)).alias("hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    total = rows.count()
    if 2 * found["rows"] > total:
        return _copies(rows, names)
    asked = twice.select("h")
    alike = rows.withColumn("h", hashed).join(F.broadcast(asked) if found["hashes"] <= SUSPECTS else asked, "h", "left_semi")
    return _copies(alike if found["rows"] else rows.limit(0), names).withColumn("rows", F.lit(total).cast("long"))


def column_counts(df: DataFrame) -> DataFrame:
    """The facts that need no distinct values: dtype, kind, rows and missing of
    every column, by counters that are summed up in the tasks."""
    if not df.columns:
        return empty_rows(df, "col_no int, column string, dtype string, kind string, rows long, missing long")
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "col_no int, column string, dtype string, kind string")
    zero = F.lit(0).cast("long")
    return F.broadcast(names).join(null_counts(df), "col_no", "left").select(
        "col_no", "column", "dtype", "kind", *[F.coalesce(c, zero).alias(c) for c in ("rows", "missing")])


class BaseProfile:
    """Counts, facts and duplicate count of one table, each computed when it is first
    asked for, and shared: gaps need no distinct values, and neither needs the copies.

    All are small (a row per column, one row), so with ``persist`` they are
    persisted rather than the table itself.
    """

    def __init__(self, df: DataFrame, persist: bool = False):
        self.df, self.persist = df, persist

    @classmethod
    def of(cls, df: DataFrame, persist: bool = False) -> "BaseProfile":
        return cls(df, persist)

    def _kept(self, result: DataFrame) -> DataFrame:
        # A row per column: one partition, not one of each partition of the last shuffle.
        return result.coalesce(1).persist(StorageLevel.MEMORY_AND_DISK) if self.persist else result

    @cached_property
    def facts(self) -> DataFrame:
        return self._kept(column_facts(self.df, apart=self.persist, least=SAMPLE if self.persist else 0))

    @cached_property
    def counts(self) -> DataFrame:
        known = self.persist and "facts" in self.__dict__
        return self.facts.select("col_no", "column", "dtype", "kind", "rows", "missing") if known else self._kept(column_counts(self.df))

    @cached_property
    def dups(self) -> DataFrame:
        return self._kept(duplicates(self.df, apart=self.persist))

    def release(self) -> None:
        for name in ("facts", "counts", "dups"):
            if name in self.__dict__:
                getattr(self, name).unpersist()

    def unpersist(self) -> None:
        self.release()

    def gaps(self) -> DataFrame:
        """One row: rows, columns, cells, missing cells and their shares."""
        per_table = self.counts.agg(
            F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("columns"),
            F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"),
            F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
            F.avg(percent(F.col("missing"), F.col("rows"))).alias("mean_missing_pct"),
            *[F.count_if(F.col("kind") == k).alias(f"{k}_columns")
              for k in ("numeric", "categorical", "datetime", "boolean")])
        return (per_table.withColumn("total_cells", F.col("rows") * F.col("columns"))
                .withColumn("missing_pct", percent(F.col("missing_cells"), F.col("total_cells"))))

    def totals(self) -> DataFrame:
        """:meth:`gaps` with the duplicates and their share."""
        both = (self.gaps().drop("rows", "total_cells", "missing_pct").withColumn("one", F.lit(1))
                .join(self.dups.withColumn("one", F.lit(1)), "one").drop("one"))
        return (both.withColumn("total_cells", F.col("rows") * F.col("columns"))
                .withColumn("missing_pct", percent(F.col("missing_cells"), F.col("total_cells")))
                .withColumn("duplicate_pct", percent(F.col("duplicate_rows"), F.col("rows"))))


def base(df: DataFrame, given: BaseProfile | None = None) -> BaseProfile:
    return given or BaseProfile.of(df)


def profile(df: DataFrame, shared: BaseProfile | None = None, approx: bool = False) -> DataFrame:
    """Per column: dtype, semantic type, distinct, missing and missing share.

    ``approx`` counts distinct values with HyperLogLog++ in one scan without
    a shuffle of the values.
    """
    if approx:
        facts = column_rows(df, [(c, {
            "rows": F.count(F.lit(1)), "missing": F.count_if(value(df, c).isNull()),
            "distinct": F.approx_count_distinct(value(df, c))}) for c in df.columns])
        kinds = {f.name: (f.dataType.simpleString(), kind_of(f.dataType)) for f in df.schema.fields}
        pick = lambda k: F.create_map(*[x for n, t in kinds.items() for x in (F.lit(n), F.lit(t[k]))])[F.col("column")]
        facts = facts.withColumn("dtype", pick(0)).withColumn("kind", pick(1))
    else:
        facts = base(df, shared).facts
    semantic = F.when(F.col("kind").isin("numeric", "datetime"), F.col("kind")).otherwise("categorical")
    return facts.select("col_no", "column", "dtype", semantic.alias("semantic_type"),
                        F.col("distinct").alias("unique_values"), "missing",
                        percent(F.col("missing"), F.col("rows")).alias("missing_percentage"))


def dataset_profile(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """One row: rows, columns, missing values, duplicate rows."""
    return base(df, shared).totals().select(
        "rows", "columns", F.col("missing_cells").alias("missing_values"), "duplicate_rows")


def with_roles(facts: DataFrame) -> DataFrame:
    """Facts plus the analytical role of every column."""
    name = F.lower(F.trim("column"))
    has = F.col("rows") - F.col("missing")
    rate = F.coalesce(F.try_divide(F.col("dated"), has), F.lit(0.0))
    date_name, identifier = F.lit(False), name.isin(V.IDENTIFIER_NAMES)
    for word in V.DATE_NAME_WORDS:
        date_name = date_name | name.contains(word)
    for suffix in V.IDENTIFIER_SUFFIXES:
        identifier = identifier | name.endswith(suffix)
    few = F.col("distinct") <= F.greatest(F.lit(20), F.floor(F.col("rows") * 0.05))
    role = (F.when(has == 0, "empty")
            .when(F.col("kind") == "datetime", "date")
            .when(F.col("kind") == "boolean", "boolean")
            .when(identifier, "identifier")
            .when(F.col("kind") == "numeric", "numeric")
            .when((has >= 3) & (rate >= 0.90) & date_name, "date")
            .when((has >= 10) & (rate >= 0.98), "date")
            .when((F.col("kind") != "complex") & few, "categorical")
            .otherwise("text"))
    return facts.withColumn("role", role)


def infer_roles(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Role of every column: empty, date, boolean, identifier, numeric,
    categorical or text."""
    return with_roles(base(df, shared).facts).select("col_no", "column", "dtype", "role")


def schema_report(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Per column: dtype, role, missing, distinct, constant flag and the three
    smallest distinct values as a sample.

    The sample takes three single-row aggregates (the smallest value, then the
    smallest above it), so no values are shuffled or sorted for it; that of a
    persisted profile is read off its facts where they know it.
    """
    b = base(df, shared)
    facts = with_roles(b.facts)
    sample = smallest_values(df, SAMPLE, apart=b.persist, facts=b.facts if b.persist else None)
    total = F.greatest(F.col("rows"), F.lit(1))
    return facts.join(F.broadcast(sample), "col_no", "left").select(
        "col_no", "column", "dtype", "role", "missing", percent(F.col("missing"), total).alias("missing_pct"),
        F.col("distinct").alias("unique"), percent(F.col("distinct"), total).alias("unique_pct"),
        (F.col("distinct") + F.when(F.col("missing") > 0, 1).otherwise(0) <= 1).alias("constant"),
        F.coalesce("sample", F.lit("")).alias("sample"))


def smallest_values(df: DataFrame, count: int, apart: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """col_no and the ``count`` smallest distinct values as text. ``apart`` scans texts and
    other columns separately: next to a text, the minima of numbers run interpreted, and
    each row copies the least texts; so each task keeps the least of its texts in one scan.
    Texts whose ``least`` values the ``facts`` hold are not scanned at all."""
    wide = df.select(*[value(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    places = range(len(df.columns))
    texts = [i for i in places if dtype_of(wide, f"c{i}") == T.StringType()]
    if not apart or not texts:
        return _smallest(wide, places, count)
    known, parts = [], []
    if facts is not None:
        told = facts.filter(F.col("least").isNotNull() & F.col("col_no").isin(texts)).select("col_no", F.concat_ws(", ", "least").alias("sample"))
        known = [r["col_no"] for r in told.collect()]
        parts = [told] if known else []
    far, others = [i for i in texts if i not in known], [i for i in places if i not in texts]
    if far:
        least = least_texts(wide.select(*[f"c{i}" for i in far]), count)
        parts.append(least.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("col_no"), F.concat_ws(", ", F.col(f"c{i}")).alias("sample")) for i in far]))))
    if others:
        parts.append(_smallest(wide, others, count))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _smallest(wide: DataFrame, places: Iterable[int], count: int) -> DataFrame:
    found = wide.agg(*[F.min(f"c{i}").alias(f"m0_{i}") for i in places]).withColumn("one", F.lit(1))
    for k in range(1, count):
        step = (wide.withColumn("one", F.lit(1))
                .join(F.broadcast(found.select("one", *[F.col(f"m{k - 1}_{i}").alias(f"p{i}") for i in places])), "one")
                .agg(*[F.min(F.when(F.col(f"c{i}") > F.col(f"p{i}"), F.col(f"c{i}"))).alias(f"m{k}_{i}")
                       for i in places]).withColumn("one", F.lit(1)))
        found = found.join(F.broadcast(step), "one")
    rows = F.array(*[F.struct(F.lit(i).alias("col_no"), F.concat_ws(
        ", ", *[F.col(f"m{k}_{i}").cast("string") for k in range(count)]).alias("sample")) for i in places])
    return found.select(F.inline(rows))


def datetime_columns(df: DataFrame, min_rate: float = 0.80, shared: BaseProfile | None = None) -> DataFrame:
    """Columns that hold dates: date types, and text whose values parse. The rates are
    read off the ``shared`` facts where given."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    asked = [c for c, k in kinds.items() if k in ("datetime", "categorical")]
    if not asked:
        return empty_rows(df, "col_no int, column string, parse_rate double")
    if shared is not None:
        rate = F.when(F.col("kind") == "datetime", 1.0).otherwise(F.try_divide("dated", F.col("rows") - F.col("missing")))
        return (shared.facts.filter(F.col("kind").isin("datetime", "categorical"))
                .select("col_no", "column", rate.alias("parse_rate")).filter(F.col("parse_rate") >= min_rate))
    rates = column_rows(df, [(c, {
        "parse_rate": F.lit(1.0) if kinds[c] == "datetime" else
        F.avg(F.when(col(c).isNotNull(), moment(df, c).isNotNull().cast("double")))}) for c in asked],
        [df.columns.index(c) for c in asked])
    return rates.filter(F.col("parse_rate") >= min_rate)


def datetime_candidates(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Columns whose inferred role is date."""
    return infer_roles(df, shared).filter("role = 'date'")


def dataset_metadata(df: DataFrame, target: str | None = None, shared: BaseProfile | None = None) -> DataFrame:
    """One row: engine, rows, columns, cells, duplicates, target, time."""
    return base(df, shared).totals().select(
        F.lit("prismatica").alias("engine"), "rows", "columns", "total_cells", "duplicate_rows",
        F.lit(target).cast("string").alias("target"), "numeric_columns", "categorical_columns",
        "datetime_columns", F.current_timestamp().alias("generated_at"))


def problem_type(df: DataFrame, target: str, any_non_numeric: bool = False) -> DataFrame:
    """One row: classification for text, boolean or at most 10 distinct
    values, else regression. ``any_non_numeric`` also sends dates to
    classification. Only whether there are 11 distinct values matters to the
    rule, so no task hands on more than 11."""
    dtype = dtype_of(df, target)
    numeric = isinstance(dtype, T.NumericType)
    labelled = not numeric if any_non_numeric else kind_of(dtype) in ("categorical", "boolean", "complex")
    few = few_values(df, value(df, target), 11)
    return few.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(target).alias("target"), F.least("n", F.lit(11)).alias("distinct_up_to_11"),
        F.when(F.col("n") == 0, "unusable").when(F.lit(labelled) | (F.col("n") <= 10), "classification")
        .otherwise("regression").alias("problem_type"))
