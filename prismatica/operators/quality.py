"""Data quality, validation, health and readiness scores, risk register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prismatica.functions.coerce import band, clip, percent
from prismatica.functions.columns import (
    dtype_of, kind_of, non_numeric_columns, numeric_columns, temporal_columns, text_columns, value)
from prismatica.functions.tidy import empty_rows
from prismatica.operators.profile import BaseProfile, base
from prismatica.operators.stats import outliers


def missing_by_column(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Columns with missing values, most missing first."""
    return (base(df, shared).counts.filter("missing > 0")
            .select("column", "missing", percent(F.col("missing"), F.col("rows")).alias("missing_pct"))
            .orderBy(F.desc("missing"), "column"))


def missing_total(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """One row: missing cells, their share, columns with missing values."""
    return base(df, shared).gaps().select("missing_cells", "missing_pct", "columns_with_missing")


def duplicate_rows(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """One row: rows, duplicate rows and their share."""
    return base(df, shared).dups.select(
        "rows", "duplicate_rows", percent(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"))


def constant_columns(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Columns with at most one value, a missing value counting as one."""
    return base(df, shared).facts.filter(
        F.col("distinct") + F.when(F.col("missing") > 0, 1).otherwise(0) <= 1).select("col_no", "column", "distinct")


def high_cardinality_columns(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Columns with more distinct values than 100 and than half the rows."""
    return base(df, shared).facts.filter(
        F.col("distinct") > F.greatest(F.lit(100), F.floor(F.col("rows") * 0.5))).select("col_no", "column", "distinct")


def quality_issues(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Duplicate rows and missing values as issues with a severity."""
    b = base(df, shared)
    pct = percent(F.col("missing"), F.col("rows"))
    severity = band(pct, [(30, "Critical"), (10, "High"), (5, "Medium")], "Low")
    gaps = b.counts.filter("missing > 0").select(
        F.lit("Missing Values").alias("issue"), "column", F.col("missing").alias("count"),
        pct.alias("percentage"), severity.alias("severity"),
        F.lit("Apply appropriate imputation.").alias("recommendation"))
    copies = b.dups.filter("duplicate_rows > 0").select(
        F.lit("Duplicate Rows").alias("issue"), F.lit(None).cast("string").alias("column"),
        F.col("duplicate_rows").alias("count"), F.lit(None).cast("double").alias("percentage"),
        F.lit("Medium").alias("severity"), F.lit("Remove duplicate records.").alias("recommendation"))
    return copies.unionByName(gaps)


def quality_report(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """One row: quality score, its inputs and warnings."""
    b = base(df, shared)
    constant = F.col("distinct") + F.when(F.col("missing") > 0, 1).otherwise(0) <= 1
    crowded = F.col("distinct") > F.greatest(F.lit(100), F.floor(F.col("rows") * 0.5))

    def names(cond: Column) -> Column:
        kept = F.array_sort(F.collect_list(F.when(cond, F.struct("col_no", "column"))))
        return F.transform(kept, lambda s: s.getField("column"))

    lists = b.facts.agg(names(constant).alias("constant_columns"), names(crowded).alias("high_cardinality_columns"))
    row = b.totals().withColumn("one", F.lit(1)).join(lists.withColumn("one", F.lit(1)), "one").drop("one")
    m, d, n = F.col("missing_pct"), F.col("duplicate_pct"), F.col("rows")
    score = (F.lit(100.0) - F.least(F.lit(35.0), m * 0.75) - F.least(F.lit(20.0), d * 0.5)
             - F.least(F.lit(10.0), F.size("constant_columns") * 2.0)
             - F.least(F.lit(10.0), F.size("high_cardinality_columns") * 2.0)
             - F.when(n < 30, 5.0).otherwise(0.0))
    notes = F.array(
        F.when(m > 30, "Critical missing-value exposure.").when(m > 20, "High missing-value exposure.")
        .when(m > 10, "Moderate missing-value exposure."),
        F.when(F.col("duplicate_rows") > 0, F.format_string("%,d duplicate rows detected.", F.col("duplicate_rows"))),
        F.when(F.size("constant_columns") > 0,
               F.format_string("%d constant column(s) detected.", F.size("constant_columns"))),
        F.when(F.size("high_cardinality_columns") > 0, F.concat(
            F.lit("High-cardinality columns detected: "),
            F.concat_ws(", ", F.slice("high_cardinality_columns", 1, 5)))),
        F.when(n < 30, "Small dataset: conclusions may have low confidence."),
        F.when(F.col("columns") > 100, "High-dimensional dataset detected."))
    return row.select(
        F.greatest(score, F.lit(0.0)).alias("score"), "rows", "columns", "missing_cells",
        m.alias("missing_percentage"), "duplicate_rows", d.alias("duplicate_percentage"),
        "constant_columns", "high_cardinality_columns", "numeric_columns", "categorical_columns",
        "datetime_columns", F.array_compact(notes).alias("warnings"))


def health_score_a(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Quality score with a status band."""
    return quality_report(df, shared).select(
        "score", band(F.round("score", 1), [(90, "EXCELLENT"), (75, "GOOD"), (60, "FAIR"), (40, "POOR")],
                      "CRITICAL").alias("status"),
        "rows", "columns", "missing_percentage", "duplicate_percentage", "warnings")


def health_score_b(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """One row: 100 less capped penalties for missing cells and duplicates."""
    row = base(df, shared).totals()
    m, d = F.col("missing_pct"), F.col("duplicate_pct")
    none = F.col("total_cells") == 0
    score = F.when(none, 0.0).otherwise(
        clip(F.lit(100.0) - F.least(m * 0.7, F.lit(50.0)) - F.least(d * 0.3, F.lit(20.0)), 0, 100))
    return row.select(
        score.alias("score"),
        band(score, [(90, "Excellent"), (75, "Healthy"), (60, "Needs Attention"), (40, "Poor")],
             "Critical").alias("status"),
        F.when(none, 100.0).otherwise(m).alias("missing_pct"), F.when(none, 0.0).otherwise(d).alias("duplicate_pct"))


def ml_readiness(df: DataFrame, target: str | None = None, shared: BaseProfile | None = None) -> DataFrame:
    """One row: readiness of the table for model training."""
    m = F.coalesce(F.col("mean_missing_pct"), F.lit(100.0))
    score = (F.lit(100.0) - F.least(m, F.lit(40.0)) - F.least(F.col("duplicate_pct") * 0.5, F.lit(15.0))
             - F.when(F.col("rows") < 100, 20.0).when(F.col("rows") < 500, 10.0).otherwise(0.0)
             - F.lit(0.0 if target else 15.0))
    score = clip(score, 0, 100)
    return base(df, shared).totals().select(
        score.alias("score"),
        band(score, [(80, "Ready"), (60, "Mostly Ready"), (40, "Needs Preparation")], "Not Ready").alias("status"),
        "rows", F.greatest(F.col("columns") - 1, F.lit(0)).alias("features"),
        F.lit(target).cast("string").alias("target"), m.alias("missing_pct"), "duplicate_pct")


def risk_register(df: DataFrame, limit: int | None = 50, shared: BaseProfile | None = None,
                  bounds: DataFrame | None = None) -> DataFrame:
    """Missing, duplicate, outlier and cardinality risks, worst first.

    ``limit`` is the length of the report, None for the whole register, which is what
    counts of risks must be taken from; the findings are at most a few per column.
    """
    b = base(df, shared)
    miss = percent(F.col("missing"), F.col("rows"))
    empty = F.lit(None).cast("string")
    found = b.facts.filter(miss >= 10).select(
        F.lit(1).alias("rule_no"), "col_no", F.lit("Data Quality").alias("type"),
        band(miss, [(30, "High")], "Medium").alias("severity"), "column",
        F.format_string("%.1f%% of values are missing.", miss).alias("message"))
    found = found.unionByName(b.dups.filter("duplicate_rows > 0").select(
        F.lit(2).alias("rule_no"), F.lit(-1).alias("col_no"), F.lit("Data Quality").alias("type"),
        F.lit("Medium").alias("severity"), empty.alias("column"),
        F.format_string("%,d duplicate rows detected.", F.col("duplicate_rows")).alias("message")))
    if numeric_columns(df):
        share = F.col("percentage")
        found = found.unionByName((bounds if bounds is not None else outliers(df)).filter(share >= 5).select(
            F.lit(3).alias("rule_no"), "col_no", F.lit("Outlier").alias("type"),
            band(share, [(10, "High")], "Medium").alias("severity"), "column",
            F.format_string("%.1f%% of observations are statistical outliers.", share).alias("message")))
    found = found.unionByName(b.facts.filter("kind <> 'numeric' and rows > 0 and distinct / rows > 0.9").select(
        F.lit(4).alias("rule_no"), "col_no", F.lit("Cardinality").alias("type"), F.lit("Low").alias("severity"),
        "column", F.lit("Very high cardinality categorical field.").alias("message")))
    order = F.when(F.col("severity") == "High", 1).when(F.col("severity") == "Medium", 2).otherwise(3)
    ranked = found.withColumn("priority", order).orderBy("priority", "rule_no", "col_no")
    return ranked if limit is None else ranked.limit(limit)


# --- validation ---------------------------------------------------------------

class InvalidData(ValueError):
    """The table or target cannot be analysed; ``code`` says why."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code, self.details = code, details


def check_names(df: DataFrame) -> None:
    """Schema-only checks: columns exist, named, and told apart by Spark."""
    if not df.columns:
        raise InvalidData("NO_COLUMNS", "dataset contains no columns")
    blank = [i for i, c in enumerate(df.columns) if not c.strip()]
    if blank:
        raise InvalidData("BLANK_NAMES", "dataset contains empty column names", positions=blank)
    seen: dict[str, int] = {}
    for c in df.columns:
        seen[c.lower()] = seen.get(c.lower(), 0) + 1
    twice = [c for c in df.columns if seen[c.lower()] > 1]
    if twice:
        raise InvalidData("DUPLICATE_NAMES", "dataset contains duplicate column names", columns=twice)


def validate(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """One row: counts, column lists and the missing map. Raises
    :class:`InvalidData` on a table without rows or usable names."""
    check_names(df)
    if df.isEmpty():
        raise InvalidData("EMPTY", "dataset is empty", rows=0, columns=len(df.columns))
    entries = F.array_sort(F.collect_list(F.when(F.col("missing") > 0, F.struct("col_no", "column", "missing"))))
    facts = base(df, shared).counts.agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("missing").alias("missing_total"),
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["column"], e["missing"]))).alias("missing_by_column"))
    lists = {"numeric_columns": numeric_columns(df), "categorical_columns": text_columns(df),
             "datetime_columns": temporal_columns(df)}
    return facts.select(
        F.lit(True).alias("valid"), F.when(F.col("missing_total") > 0, "warning").otherwise("healthy").alias("status"),
        "rows", "columns", *[F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in lists.items()],
        "missing_total", "missing_by_column")


def validate_target(df: DataFrame, target: str, require_numeric: bool = False) -> DataFrame:
    """One row: dtype, rows, missing and distinct values of the target."""
    check_names(df)
    name = (target or "").strip()
    if not name:
        raise InvalidData("NO_TARGET", "target column cannot be empty")
    if name not in df.columns:
        raise InvalidData("UNKNOWN_TARGET", f"target column '{name}' does not exist", available=df.columns)
    dtype = dtype_of(df, name)
    numeric = isinstance(dtype, T.NumericType)
    if require_numeric and not numeric:
        raise InvalidData("NOT_NUMERIC", f"target column '{name}' must be numeric", dtype=dtype.simpleString())
    if df.filter(value(df, name).isNotNull()).isEmpty():
        raise InvalidData("EMPTY_TARGET", f"target column '{name}' contains no usable values")
    v = value(df, name)
    counts = df.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing_values"),
                      F.count("v").alias("unique_values")).select(
        F.lit(True).alias("valid"), F.lit(name).alias("target"), F.lit(dtype.simpleString()).alias("dtype"),
        "rows", "missing_values", "unique_values", F.lit(numeric).alias("numeric"))


def validate_for_analysis(df: DataFrame, target: str | None = None) -> DataFrame:
    """:func:`validate` plus, if asked, the target's figures in one row."""
    table = validate(df)
    if target is None:
        return table.withColumn("target", F.lit(None).cast("string"))
    checked = validate_target(df, target).select(
        F.lit(1).alias("one"), "target", F.col("dtype").alias("target_dtype"),
        F.col("missing_values").alias("target_missing"), F.col("unique_values").alias("target_unique"))
    return table.withColumn("one", F.lit(1)).join(checked, "one").drop("one")


def safe_validate(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row that reports the outcome instead of raising."""
    spark, schema = df.sparkSession, "valid boolean, status string, error string, message string"
    try:
        return validate_for_analysis(df, target).select(
            "valid", "status", F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("message"))
    except InvalidData as bad:
        return spark.createDataFrame([(False, "invalid", bad.code, str(bad))], schema)
    except Exception as bad:  # reported, not hidden: the row carries the text
        return spark.createDataFrame([(False, "invalid", "VALIDATION_INTERNAL_ERROR", str(bad))], schema)


def request_summary(df: DataFrame, target: str | None = None, shared: BaseProfile | None = None) -> DataFrame:
    """One row: counts, shares, type counts, names and dtypes of the table,
    and the target's missing values."""
    if target and target not in df.columns:
        raise InvalidData("UNKNOWN_TARGET", f"target column '{target}' does not exist")
    b = base(df, shared)
    names = F.array(*map(F.lit, df.columns))
    dtypes = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields])
    gap = b.counts.agg(F.coalesce(F.max(F.when(F.col("column") == F.lit(target), F.col("missing"))), F.lit(0))
                      .alias("target_missing_values"), F.lit(1).alias("one"))
    return b.totals().withColumn("one", F.lit(1)).join(gap, "one").select(
        "rows", "columns", F.lit(target).cast("string").alias("target"), "target_missing_values", "duplicate_rows",
        "missing_cells", F.col("missing_pct").alias("missing_percentage"), "numeric_columns", "categorical_columns",
        "datetime_columns", names.alias("column_names"), F.map_from_arrays(names, dtypes).alias("dtypes"))
