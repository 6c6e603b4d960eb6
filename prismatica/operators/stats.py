"""Descriptive statistics: summaries, distributions, outliers, correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prismatica.functions.coerce import band, col, percent, ratio_eps, shown
from prismatica.functions.columns import (
    boolean_columns, dtype_of, number, numeric_columns, text_columns, value)
from prismatica.functions.quantiles import quantiles
from prismatica.functions.tidy import column_names, column_rows, empty_rows, most_frequent
from prismatica.operators.comoments import correlations


def _numbers(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, Column]]:
    return [(c, number(df, c)) for c in (columns if columns is not None else numeric_columns(df))]


def numeric_summary(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per numeric column: count, mean, std, min, quartiles, max."""
    values = _numbers(df, columns)
    if not values:
        return empty_rows(df, "col_no int, column string, count long, mean double, std double, "
                              "min double, q25 double, q50 double, q75 double, max double")
    found = quantiles(df, values, [0.25, 0.5, 0.75], approx=approx,
                      extras=lambda v: {"mean": F.avg(v), "std": F.stddev_samp(v)})
    return found.select("col_no", "column", F.col("n").alias("count"), "mean", "std", F.col("low").alias("min"),
                        F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"),
                        F.col("high").alias("max"))


def _corrected_moments(v: Column) -> dict[str, Column]:
    """Bias-corrected skewness and excess kurtosis from population moments."""
    n, g1, g2 = F.count(v).cast("double"), F.skewness(v), F.kurtosis(v)
    flat = F.max(v) == F.min(v)
    skew = F.when(n >= 3, F.when(flat, 0.0).otherwise(F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)))
    kurt = F.when(n >= 4, F.when(flat, 0.0).otherwise(
        F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))
    return {"skewness": skew, "kurtosis": kurt}


def numeric_profile(df: DataFrame, columns: list[str] | None = None, apart: bool = False) -> DataFrame:
    """Every per-column figure the numeric operators are read from, in the
    scans the quartiles need anyway: n, low, high, mean, std, sum, skewness,
    kurtosis, sign counts and q0..q2. Analyses persist it (a row per column)
    and pass it on as ``profiled``; ``apart`` as in ``quantiles``."""
    values = _numbers(df, columns)
    if not values:
        return empty_rows(df, "col_no int, column string, n long, low double, high double, mean double, std double, "
                              "sum double, skewness double, kurtosis double, zeros long, negative_values long, "
                              "positive_values long, q0 double, q1 double, q2 double")
    return quantiles(df, values, [0.25, 0.5, 0.75], apart=apart, extras=lambda v: {
        "mean": F.avg(v), "std": F.stddev_samp(v), "sum": F.sum(v), **_corrected_moments(v),
        "zeros": F.count_if(v == 0), "negative_values": F.count_if(v < 0), "positive_values": F.count_if(v > 0)})


def distributions(df: DataFrame, columns: list[str] | None = None, profiled: DataFrame | None = None) -> DataFrame:
    """Per numeric column with values: location, spread, quartiles, shape and
    the counts of zeros, negatives and positives."""
    found = profiled if profiled is not None else numeric_profile(df, columns)
    return found.filter("n > 0").select(
        "col_no", "column", F.col("n").alias("count"), "mean", F.col("q1").alias("median"), "std",
        F.col("low").alias("min"), F.col("high").alias("max"), F.col("q0").alias("q25"), F.col("q2").alias("q75"),
        (F.col("q2") - F.col("q0")).alias("iqr"), "skewness", "kurtosis",
        "zeros", "negative_values", "positive_values")


def distribution_shape(df: DataFrame, columns: list[str] | None = None, profiled: DataFrame | None = None) -> DataFrame:
    """Distribution figures with a skewness label."""
    s = F.col("skewness")
    label = (F.when(s > 1, "Highly Right-Skewed").when(s > 0.5, "Right-Skewed")
             .when(s < -1, "Highly Left-Skewed").when(s < -0.5, "Left-Skewed")
             .otherwise("Approximately Symmetric"))
    return distributions(df, columns, profiled).select(
        "col_no", "column", "mean", "median", "std", "min", "max", "skewness", label.alias("distribution"))


def coefficient_of_variation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The numeric summary plus std / mean (missing where the mean is 0)."""
    return numeric_summary(df, columns).withColumn(
        "coefficient_of_variation", F.try_divide(F.col("std"), F.col("mean")))


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text or boolean column: distinct values, the most frequent (the
    smallest of a tie), its count and its share of the non-missing."""
    asked = columns if columns is not None else [c for c in df.columns if c in text_columns(df) + boolean_columns(df)]
    if not asked:
        return empty_rows(df, "col_no int, column string, count long, unique long, top string, "
                              "top_count long, top_percentage double")
    text = df.select(*[value(df, c).cast("string").alias(c) for c in asked])
    best = most_frequent(text)
    return best.join(F.broadcast(column_names(df, asked)), "col_no").select(
        "col_no", "column", F.col("total").alias("count"), "unique", F.col("s").alias("top"),
        F.col("n").alias("top_count"), percent(F.col("n"), F.col("total")).alias("top_percentage"))


def describe_all(df: DataFrame) -> DataFrame:
    """Numeric summary and categorical summary of all columns in one table."""
    names = column_names(df).select(F.col("col_no").alias("position"), "column")
    figures = numeric_summary(df).drop("col_no").select(
        "column", "count", F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
        F.lit(None).cast("long").alias("freq"), "mean", "std", "min", "q25", "q50", "q75", "max")
    texts = [c for c in df.columns if c in text_columns(df) + boolean_columns(df)]
    if texts:
        none = F.lit(None).cast("double")
        words = categorical_summary(df, texts).select(
            "column", "count", "unique", "top", F.col("top_count").alias("freq"),
            *[none.alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])
        figures = figures.unionByName(words)
    return figures.join(F.broadcast(names), "column").orderBy("position")


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """One row: the target's location, spread, range and missing share."""
    y = number(df, target)
    found = quantiles(df, [(target, y)], [0.5], extras=lambda v: {
        "mean": F.avg(v), "std": F.stddev_samp(v), "sum": F.sum(v), "variance": F.var_samp(v),
        "missing": F.count_if(v.isNull()), "rows": F.count(F.lit(1))}).fillna(0, ["missing", "rows"])
    return found.select(
        F.col("column").alias("target"), (F.col("n") > 0).alias("available"), F.col("n").alias("count"), "mean",
        F.col("q0").alias("median"), F.col("low").alias("min"), F.col("high").alias("max"), "std", "sum",
        (F.col("high") - F.col("low")).alias("range"), "variance",
        ratio_eps(F.col("std"), F.col("mean")).alias("coefficient_of_variation"),
        "missing", percent(F.col("missing"), F.col("rows")).alias("missing_percentage"))


def target_analysis(df: DataFrame, target: str | None, top: int = 10, profiled: DataFrame | None = None,
                    facts: DataFrame | None = None) -> DataFrame:
    """Figures of the target as (statistic, label, value) rows: missing and
    distinct counts (read off the column ``facts`` where given), then
    mean/median/min/max/std of a numeric target or the ``top`` most frequent
    values of any other."""
    if target is None or target not in df.columns:
        return empty_rows(df, "statistic string, label string, value double")
    v = value(df, target)
    freq = df.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if facts is not None:
        counts = facts.filter(F.col("column") == F.lit(target)).select(
            F.when(F.col("rows") > 0, F.col("missing")).alias("missing"), F.col("distinct").alias("unique"))
    else:
        counts = freq.agg(F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"),
                          F.count("v").alias("unique"))
    out = counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("statistic"), F.lit(None).cast("string").alias("label"),
                 F.col(k).cast("double").alias("value")) for k in ("missing", "unique")])))
    if isinstance(dtype_of(df, target), T.NumericType):
        s = target_stats(df, target) if profiled is None else profiled.filter(F.col("column") == F.lit(target)).select(
            "mean", F.col("q1").alias("median"), F.col("low").alias("min"), F.col("high").alias("max"), "std")
        more = s.select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("statistic"), F.lit(None).cast("string").alias("label"), F.col(k).alias("value"))
            for k in ("mean", "median", "min", "max", "std")])))
    else:
        more = (freq.filter("v is not null").select(F.col("v").cast("string").alias("label"), "n")
                .orderBy(F.desc("n"), "label").limit(top)
                .select(F.lit("top_value").alias("statistic"), "label", F.col("n").cast("double").alias("value")))
    return out.unionByName(more)


# --- outliers ---------------------------------------------------------------------

def tukey_bounds(df: DataFrame, columns: list[str] | None = None, profiled: DataFrame | None = None) -> DataFrame:
    """Per numeric column: n, quartiles and the 1.5 IQR fences."""
    if profiled is not None:
        found = profiled.select("col_no", "column", "n", F.col("q0").alias("q1"), F.col("q2").alias("q3"))
    else:
        found = quantiles(df, _numbers(df, columns), [0.25, 0.75]).select(
            "col_no", "column", "n", F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return found.select("*", (F.col("q1") - iqr * 1.5).alias("lower"), (F.col("q3") + iqr * 1.5).alias("upper"))


def _outside(df: DataFrame, columns: list[str] | None, profiled: DataFrame | None = None) -> DataFrame:
    values = _numbers(df, columns)
    numbers = [str(i) for i in range(len(values))]
    fences = tukey_bounds(df, columns, profiled)
    cells = (df.select(*[v.alias(i) for i, (_, v) in zip(numbers, values)])
             .unpivot([], numbers, "col_no", "v").filter("v is not null")
             .withColumn("col_no", F.col("col_no").cast("int")))
    # One row per column is broadcast; the partial counts are one per task.
    hits = (cells.join(F.broadcast(fences.select("col_no", "lower", "upper")), "col_no")
            .groupBy("col_no").agg(F.count_if((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))).alias("count")))
    return fences.join(F.broadcast(hits), "col_no", "left")


def iqr_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values outside the Tukey fences per numeric column of 4 or more values;
    a column whose quartiles coincide counts every other value."""
    if not _numbers(df, columns):
        return empty_rows(df, "col_no int, column string, outlier_count long, outlier_percentage double, "
                              "lower_bound double, upper_bound double")
    return _outside(df, columns).filter("n >= 4").select(
        "col_no", "column", F.col("count").alias("outlier_count"),
        percent(F.col("count"), F.col("n")).alias("outlier_percentage"),
        F.col("lower").alias("lower_bound"), F.col("upper").alias("upper_bound"))


def outliers(df: DataFrame, columns: list[str] | None = None, profiled: DataFrame | None = None) -> DataFrame:
    """As :func:`iqr_outliers` for every numeric column: fewer than 4 values
    give no bounds, and coinciding quartiles count nothing."""
    if not _numbers(df, columns):
        return empty_rows(df, "col_no int, column string, count long, percentage double, "
                              "lower_bound double, upper_bound double")
    flat = F.col("q1") == F.col("q3")
    few = F.coalesce(F.col("n"), F.lit(0)) < 4
    count = F.when(few | flat, F.lit(0)).otherwise(F.col("count")).cast("long")
    return _outside(df, columns, profiled).select(
        "col_no", "column", count.alias("count"), percent(count, F.col("n")).alias("percentage"),
        F.when(~few, F.col("lower")).alias("lower_bound"), F.when(~few, F.col("upper")).alias("upper_bound"))


def outlier_total(found: DataFrame) -> DataFrame:
    """One row: outliers over all columns of an :func:`outliers` result."""
    return found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_outliers"))


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value of ``column`` lies outside its fences. The two
    fences reach the driver, so the filter holds literals the scan can use."""
    fence = tukey_bounds(df, [column]).first()
    if fence["n"] < 4 or fence["q1"] == fence["q3"]:
        return df.limit(0)
    v = number(df, column)
    return df.filter((v < F.lit(fence["lower"])) | (v > F.lit(fence["upper"])))


# --- correlation -----------------------------------------------------------------

def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every pair of numeric columns once, with its pairwise-complete Pearson
    correlation; NULL where either side is constant. One scan, in which no row
    is expanded into its pairs (see ``comoments``)."""
    values = _numbers(df, columns)
    if len(values) < 2:
        return empty_rows(df, "pair_no int, feature_a string, feature_b string, correlation double")
    pairs = list(combinations(range(len(values)), 2))
    names = df.sparkSession.createDataFrame(
        [(k, a, b, values[a][0], values[b][0]) for k, (a, b) in enumerate(pairs)],
        "pair_no int, a int, b int, feature_a string, feature_b string")
    found = correlations(df, [v for _, v in values]).select("a", "b", "correlation")
    return names.join(F.broadcast(found), ["a", "b"], "left").drop("a", "b")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column and one column per numeric column."""
    names = columns if columns is not None else numeric_columns(df)
    pairs = correlation_pairs(df, names).select("feature_a", "feature_b", "correlation")
    both = pairs.unionByName(pairs.select(
        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation"))
    own = column_rows(df, [(c, {"correlation": F.when(F.max(number(df, c)) > F.min(number(df, c)), 1.0)}) for c in names])
    both = both.unionByName(own.select(F.col("column").alias("feature_a"), F.col("column").alias("feature_b"), "correlation"))
    return both.groupBy(F.col("feature_a").alias("feature")).agg(*[
        F.max(F.when(F.col("feature_b") == F.lit(c), F.col("correlation"))).alias(c) for c in names])


def top_correlations(df: DataFrame, n: int = 30, columns: list[str] | None = None) -> DataFrame:
    """The strongest pairs by absolute correlation at 4 decimals."""
    r = shown(F.col("correlation"), 4)
    return (correlation_pairs(df, columns).filter("correlation is not null")
            .select("feature_a", "feature_b", r.alias("correlation"), F.abs(r).alias("abs_correlation"))
            .orderBy(F.desc("abs_correlation"), "feature_a", "feature_b").limit(n))


# --- single metrics ----------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width frequencies, empty bins included; the top edge belongs to
    the last bin. The range of the column reaches the driver first."""
    v = number(df, column)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return empty_rows(df, "bin int, lower double, upper double, frequency long")
    width = (hi - lo) / bins
    place = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)) if hi > lo else F.lit(0)
    counts = df.filter(v.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(lo) + F.lit(width) * F.col("bin")).alias("lower"),
        (F.lit(lo) + F.lit(width) * (F.col("bin") + 1)).alias("upper"), F.coalesce("frequency", F.lit(0)).alias("frequency"))


def high_variability_features(df: DataFrame, n: int = 5) -> DataFrame:
    """The numeric columns with the largest standard deviation."""
    values = _numbers(df)
    if not values:
        return empty_rows(df, "col_no int, column string, std double")
    return column_rows(df, [(c, {"std": F.stddev_samp(v)}) for c, v in values]).orderBy(
        F.desc_nulls_last("std"), "col_no").limit(n)


def feature_metric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, median, std and distinct values of one metric."""
    v = number(df, column)
    found = quantiles(df, [(column, v)], [0.5], extras=lambda x: {"mean": F.avg(x), "std": F.stddev_samp(x)})
    distinct = df.select(v.alias("v")).filter("v is not null").distinct().agg(F.count(F.lit(1)).alias("unique"))
    return found.withColumn("one", F.lit(1)).join(distinct.withColumn("one", F.lit(1)), "one").select(
        "column", "mean", F.col("q0").alias("median"), "std", "unique")
