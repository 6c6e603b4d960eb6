"""Grouping, totals, KPIs, rankings and the segments that drive a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismatica.functions import vocabulary as V
from prismatica.functions.coerce import col, pct_change, percent, ratio_eps, text_key
from prismatica.functions.columns import (
    dtype_of, find_column, kind_of, moment, non_numeric_columns, number, numeric_columns, value)
from prismatica.functions.quantiles import quantiles
from prismatica.functions.tidy import ALONE, column_rows, empty_rows


def _sum(c: Column) -> Column:
    """Sum in which a group without values counts as 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def group_analysis(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Sum, mean and count of a metric per dimension value, largest first;
    rows without a dimension value are left out."""
    y = number(df, metric)
    return (df.filter(value(df, dimension).isNotNull()).groupBy(value(df, dimension).alias("segment"))
            .agg(_sum(y).alias("sum"), F.avg(y).alias("mean"), F.count(y).alias("count"))
            .orderBy(F.desc("sum"), "segment"))


def top_entities(df: DataFrame, dimension: str, metric: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of :func:`group_analysis`."""
    return group_analysis(df, dimension, metric).limit(n)


def metric_by_dimension(df: DataFrame, dimension: str, metric: str, keep_null: bool = True) -> DataFrame:
    """Sum of a coerced metric per dimension value, largest first."""
    rows = df if keep_null else df.filter(value(df, dimension).isNotNull())
    return (rows.groupBy(value(df, dimension).alias("segment")).agg(_sum(number(df, metric)).alias("total"))
            .orderBy(F.desc("total"), "segment"))


def time_rollup(df: DataFrame, date: str, metric: str, grain: str | None = None) -> DataFrame:
    """Sum of a metric per timestamp, or per ``grain`` (day, month, ...)."""
    t = moment(df, date)
    return (df.select((F.date_trunc(grain, t) if grain else t).alias("period"), number(df, metric).alias("y"))
            .filter("period is not null").groupBy("period").agg(_sum(F.col("y")).alias("total")).orderBy("period"))


def numeric_totals(df: DataFrame) -> DataFrame:
    """Sum of every numeric column."""
    names = numeric_columns(df)
    if not names:
        return empty_rows(df, "col_no int, column string, total double")
    return column_rows(df, [(c, {"total": _sum(number(df, c))}) for c in names])


# --- KPIs --------------------------------------------------------------------------

def kpi_table_a(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """Per numeric column: total, average, median, minimum, maximum."""
    names = numeric_columns(df)
    if not names:
        return empty_rows(df, "col_no int, column string, total double, average double, median double, "
                              "minimum double, maximum double")
    return _numeric_kpis(df, names, profiled).select(
        "col_no", "column", F.coalesce("sum", F.lit(0.0)).alias("total"), "average", "median",
        F.col("low").alias("minimum"), F.col("high").alias("maximum"))


def _numeric_kpis(df: DataFrame, names: list[str], profiled: DataFrame | None) -> DataFrame:
    if profiled is not None:
        return profiled.withColumnsRenamed({"mean": "average", "q1": "median"})
    return quantiles(df, [(c, number(df, c)) for c in names], [0.5], extras=lambda v: {
        "sum": F.sum(v), "average": F.avg(v)}).withColumnRenamed("q0", "median")


def business_kpis(df: DataFrame) -> DataFrame:
    """Total revenue, total profit and margin as (kpi, value) rows, for the
    columns the table names so."""
    revenue = find_column(df, V.KPI_REVENUE_WORDS)
    profit = find_column(df, V.KPI_PROFIT_WORDS)
    named = {k: c for k, c in (("TOTAL_REVENUE", revenue), ("TOTAL_PROFIT", profit)) if c}
    if not named:
        return empty_rows(df, "kpi string, value double")
    totals = df.agg(*[_sum(number(df, c)).alias(k) for k, c in named.items()])
    rows = [F.struct(F.lit(k).alias("kpi"), F.col(k).alias("value")) for k in named]
    if len(named) == 2:
        margin = F.try_divide(F.col("TOTAL_PROFIT"), F.col("TOTAL_REVENUE")) * 100
        rows.append(F.struct(F.lit("PROFIT_MARGIN").alias("kpi"), margin.alias("value")))
    return totals.select(F.inline(F.array(*rows))).filter("value is not null")


def _ends(df: DataFrame, y: Column, order_by: list[str]) -> tuple[Column, Column]:
    """First and last non-missing value in the given order; rows that tie on
    the whole order are told apart by the value itself."""
    place = F.when(y.isNotNull(), F.struct(*[value(df, c) for c in order_by], y))
    return F.min_by(y, place), F.max_by(y, place)


def growth_proxy(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """One row: (last / first - 1) * 100 of the non-missing values in order;
    0 with fewer than two values or a first value of 0."""
    y = number(df, column)
    first, last = _ends(df, y, order_by)
    return df.agg(F.count(y).alias("count"), first.alias("first"), last.alias("last")).select(
        F.lit(column).alias("column"), "first", "last", _growth().alias("growth_proxy_pct"))


def _growth() -> Column:
    ratio = F.try_divide(F.col("last"), F.col("first"))
    return F.when((F.col("count") < 2) | (F.col("first") == 0), 0.0).otherwise((ratio - 1) * 100)


def _edge_rows(df: DataFrame, names: list[str], order_by: list[str]) -> DataFrame:
    """The rows that hold the least or greatest first key of the order, a missing one being the
    least, among the values of any column of ``names``; the ends of each are among them."""
    k = value(df, order_by[0])
    held = [number(df, c).isNotNull() for c in names]
    edges = column_rows(df, [(c, {"low": F.min(F.when(h, k)), "high": F.max(F.when(h, k)), "gaps": F.count_if(h & k.isNull())})
                             for c, h in zip(names, held)])
    keys = edges.select(F.inline(F.array(F.struct(F.when(F.col("gaps") == 0, F.col("low")).alias("key")), F.struct(F.col("high").alias("key")))))
    return df.join(F.broadcast(keys.distinct()), k.eqNullSafe(F.col("key")), "left_semi")


def kpi_table_b(df: DataFrame, order_by: list[str], profiled: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """Per numeric column with values: sum, average, median, min, max and the
    growth from the first to the last row in order. ``apart`` looks for the ends
    only where the first key of the order has its own, found by a scan before;
    for tables that are cheap to read again."""
    names = numeric_columns(df)
    if not names:
        return empty_rows(df, "col_no int, column string, sum double, average double, median double, min double, "
                              "max double, growth_proxy_pct double")
    rows = _edge_rows(df, names, order_by) if apart else df
    ends = column_rows(rows, [(c, {"first": _ends(df, number(df, c), order_by)[0],
                                   "last": _ends(df, number(df, c), order_by)[1],
                                   "count": F.count(number(df, c))}) for c in names])
    growth = ends.select("col_no", _growth().alias("growth_proxy_pct"))
    return _numeric_kpis(df, names, profiled).join(F.broadcast(growth), "col_no").filter("n > 0").select(
        "col_no", "column", "sum", "average", "median", F.col("low").alias("min"), F.col("high").alias("max"),
        "growth_proxy_pct")


def business_metrics(df: DataFrame) -> DataFrame:
    """One row: totals and averages of revenue, profit and quantity with
    missing values as 0 (so averages are over all rows), and the margin."""
    found = {"revenue": find_column(df, V.METRICS_REVENUE_NAMES, "exact_first"),
             "profit": find_column(df, V.METRICS_PROFIT_NAMES, "exact_first"),
             "quantity": find_column(df, V.METRICS_QUANTITY_NAMES, "exact_first")}
    aggs = []
    for k, c in found.items():
        v = F.coalesce(number(df, c), F.lit(0.0)) if c else F.lit(0.0)
        aggs += [_sum(v).alias(f"total_{k}"), F.coalesce(F.avg(v), F.lit(0.0)).alias(f"average_{k}")]
    margin = F.when(F.abs("total_revenue") > 1e-12, F.try_divide(F.col("total_profit"), F.col("total_revenue")) * 100)
    return df.agg(*aggs).select(
        *[F.lit(c).cast("string").alias(f"{k}_column") for k, c in found.items()],
        "total_revenue", "total_profit", F.coalesce(margin, F.lit(0.0)).alias("profit_margin"),
        "total_quantity", "average_revenue", "average_profit")


# --- segments ----------------------------------------------------------------------

def _segments(df: DataFrame, target: Column, dims: list[str], apart: bool = False) -> DataFrame:
    """Sum, mean and count of the target per value of each dimension and over
    the whole table (dimension NULL): one scan, one shuffle.

    Grouping sets tell a missing segment from a dimension that is not grouped.
    Dates and flags are grouped as they are: the label is made once a segment, not
    once a row, and segments of the same label are then put together. ``apart`` takes
    a scan for each dimension instead, of that column and the target, and no row is
    copied; for tables that are cheap to read again.
    """
    keys = [f"d{i}" for i in range(len(dims))]
    late = [kind_of(dtype_of(df, d)) in ("datetime", "boolean") for d in dims]
    if apart and len(dims) <= ALONE:
        figures = [F.sum("y").alias("sum"), F.avg("y").alias("mean"), F.count("y").alias("count")]
        none = F.lit(None).cast("string")
        found = df.select(target.alias("y")).agg(*figures).select(
            F.lit(None).cast("int").alias("dim_no"), none.alias("dimension"), none.alias("segment"), "sum", "mean", "count")
        for i, (d, l) in enumerate(zip(dims, late)):
            one = df.select((value(df, d) if l else text_key(value(df, d))).alias("segment"), target.alias("y")).groupBy("segment").agg(*figures)
            if l:
                one = one.groupBy(text_key(F.col("segment")).alias("segment")).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count")).select(
                    "segment", "sum", F.try_divide("sum", "count").alias("mean"), "count")
            found = found.unionByName(one.select(F.lit(i).alias("dim_no"), F.lit(d).alias("dimension"), "segment", "sum", "mean", "count"))
        return found
    rows = df.select(*[(value(df, d) if l else text_key(value(df, d))).alias(k) for d, k, l in zip(dims, keys, late)], target.alias("y"))
    grouped = rows.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.sum("y").alias("sum"), F.avg("y").alias("mean"), F.count("y").alias("count"),
        F.array(*[F.grouping(k) for k in keys]).alias("rolled"))
    which = F.array_position("rolled", F.lit(0).cast("byte"))
    names, values = F.array(*map(F.lit, dims)), F.array(*[text_key(F.col(k)) if l else F.col(k) for k, l in zip(keys, late)])
    at = F.when(which > 0, which.cast("int"))
    found = grouped.select((at - 1).alias("dim_no"), F.get(names, at - 1).alias("dimension"),
                           F.get(values, at - 1).alias("segment"), "sum", "mean", "count")
    if not any(late):
        return found
    return found.groupBy("dim_no", "dimension", "segment").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count")).select(
        "dim_no", "dimension", "segment", "sum", F.try_divide("sum", "count").alias("mean"), "count")


def segment_drivers(df: DataFrame, target: str, dims: list[str] | None = None, top_n: int = 10, apart: bool = False) -> DataFrame:
    """The segments that weigh most on the target.

    share = segment sum / total; vs_overall_pct = gap of the segment mean to
    the overall mean; impact = |share| * |vs_overall_pct|. A missing segment
    value is a segment of its own. ``apart`` as in :func:`_segments`.
    """
    if target not in df.columns:
        raise ValueError(f"target '{target}' not found")
    dims = [d for d in (dims or non_numeric_columns(df)) if d != target and d in df.columns]
    if not dims:
        return empty_rows(df, "dimension string, segment string, sum double, mean double, count long, "
                              "share_of_total double, vs_overall_pct double, impact_score double")
    y = number(df, target)
    seg = _segments(df.filter(y.isNotNull()), y, dims, apart).withColumn("one", F.lit(1))
    overall = seg.filter("dim_no is null").select("one", F.col("sum").alias("total"), F.col("mean").alias("overall"))
    share = F.coalesce(F.try_divide(F.col("sum"), F.col("total")), F.lit(0.0))
    gap = ratio_eps(F.col("mean") - F.col("overall"), F.col("overall")) * 100
    return (seg.filter("dim_no is not null").join(F.broadcast(overall), "one")
            .select("dimension", "segment", "sum", "mean", "count", share.alias("share_of_total"),
                    gap.alias("vs_overall_pct"), (F.abs(share) * F.abs(gap)).alias("impact_score"))
            .orderBy(F.desc("impact_score"), "dimension", "segment").limit(top_n))


def driver_answer(df: DataFrame, target: str, dims: list[str] | None = None) -> DataFrame:
    """The five strongest drivers of the target."""
    return segment_drivers(df, target, dims, top_n=5)


def segment_concentration(df: DataFrame, metric: str, dims: list[str] | None = None, max_dims: int | None = None) -> DataFrame:
    """Per dimension with at least two segments: the leading segment and its
    share of the metric; 50 % or more is a concentration."""
    dims = dims if dims is not None else non_numeric_columns(df)[:max_dims]
    if not dims:
        return empty_rows(df, "dim_no int, dimension string, segments long, top_segment string, top_value double, "
                              "total double, share_pct double, finding string")
    # The leader comes from an aggregate, so no task sorts a dimension's segments.
    y = F.coalesce(F.col("sum"), F.lit(0.0))
    lead = F.min(F.struct((-y).alias("k"), F.col("segment")))
    per_dim = (_segments(df, number(df, metric), dims).filter("dim_no is not null")
               .groupBy("dim_no", "dimension").agg(F.count(F.lit(1)).alias("segments"), lead.alias("lead"),
                                                   F.sum(y).alias("total")))
    share = F.try_divide(-F.col("lead.k"), F.col("total")) * 100
    return per_dim.filter("segments >= 2 and total <> 0").select(
        "dim_no", "dimension", "segments", F.col("lead.segment").alias("top_segment"),
        (-F.col("lead.k")).alias("top_value"), "total", share.alias("share_pct"),
        F.when(share >= 50, "concentration").otherwise("leader").alias("finding"))


def _ranked(df: DataFrame, best: bool) -> DataFrame:
    metric = find_column(df, V.ANSWER_RANKING_WORDS, "word_order")
    dims = non_numeric_columns(df)
    if metric is None or not dims:
        return empty_rows(df, "dimension string, segment string, metric string, total double")
    total = F.desc("total") if best else F.asc("total")
    return (df.groupBy(text_key(value(df, dims[0])).alias("segment")).agg(_sum(number(df, metric)).alias("total"))
            .orderBy(total, "segment").limit(1)
            .select(F.lit(dims[0]).alias("dimension"), "segment", F.lit(metric).alias("metric"), "total"))


def best_segment(df: DataFrame) -> DataFrame:
    """Segment of the first category column with the largest metric total."""
    return _ranked(df, True)


def worst_segment(df: DataFrame) -> DataFrame:
    """Segment of the first category column with the smallest metric total."""
    return _ranked(df, False)


# --- single answers -------------------------------------------------------------------

def max_row(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """The whole row with the largest value; first in order on ties."""
    y = number(df, column)
    return df.filter(y.isNotNull()).orderBy(y.desc(), *[col(c) for c in order_by]).limit(1)


def min_row(df: DataFrame, column: str, order_by: list[str]) -> DataFrame:
    """The whole row with the smallest value; first in order on ties."""
    y = number(df, column)
    return df.filter(y.isNotNull()).orderBy(y.asc(), *[col(c) for c in order_by]).limit(1)


def average(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(number(df, column)).alias("average"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def metric_answer(df: DataFrame) -> DataFrame:
    """One row: total, average, maximum and minimum of the revenue column and
    total and margin of the profit column, as far as the table has them."""
    revenue = find_column(df, V.ANSWER_REVENUE_WORDS, "word_order")
    profit = find_column(df, V.ANSWER_PROFIT_WORDS, "word_order")
    base = find_column(df, V.ANSWER_MARGIN_REVENUE_WORDS, "word_order")
    none = F.lit(None).cast("double")
    r, p, b = (number(df, c) if c else none for c in (revenue, profit, base))
    return df.agg(
        F.sum(r).alias("revenue_total"), F.avg(r).alias("revenue_average"), F.max(r).alias("revenue_max"),
        F.min(r).alias("revenue_min"), F.sum(p).alias("profit_total"), F.sum(b).alias("base")).select(
        F.lit(revenue).cast("string").alias("revenue_column"), F.lit(profit).cast("string").alias("profit_column"),
        "revenue_total", "revenue_average", "revenue_max", "revenue_min", "profit_total",
        (F.try_divide(F.col("profit_total"), F.col("base")) * 100).alias("margin_pct"))


def range_spread(df: DataFrame, column: str) -> DataFrame:
    """One row: (max - min) / |min| * 100, 0 if the minimum is 0, flagged
    above 100 when there are at least 3 values."""
    y = number(df, column)
    spread = F.coalesce(pct_change(F.col("high"), F.col("low")), F.lit(0.0))
    return df.agg(F.count(y).alias("n"), F.min(y).alias("low"), F.max(y).alias("high")).select(
        F.lit(column).alias("column"), "n", "low", "high", spread.alias("spread_pct"),
        ((F.col("n") >= 3) & (spread > 100)).alias("variable"))


def union_results(frames: list[DataFrame]) -> DataFrame:
    """Rows of several results with the same columns, by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "scenario", name: str = "value") -> DataFrame:
    """Wide to long: one row per id and value column."""
    return df.unpivot([col(c) for c in ids], [col(c) for c in values], variable, name)


def headline_ratios(df: DataFrame, outlier_total: DataFrame, sales: str, profit: str) -> DataFrame:
    """One row: net margin of the profit on the sales total and outliers per
    100 rows."""
    totals = df.agg(F.sum(number(df, sales)).alias("s"), F.sum(number(df, profit)).alias("p"),
                    F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    return totals.join(outlier_total.withColumn("one", F.lit(1)), "one").select(
        percent(F.col("p"), F.col("s")).alias("net_margin_pct"),
        percent(F.col("total_outliers"), F.col("n")).alias("outlier_pct"))
