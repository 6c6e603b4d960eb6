"""Half-over-half trend without ordering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismatica.functions import vocabulary as V
from prismatica.functions.columns import find_column, moment, number, numeric_columns
from prismatica.functions.quantiles import Rank, order_statistics
from prismatica.functions.tidy import empty_rows
from prismatica.plans.settle import settled


def trend_date_column(df: DataFrame) -> str | None:
    """First column named like a date, time, month or year that holds at
    least two dates. One count per candidate reaches the driver."""
    named = [c for c in df.columns if any(w in c.lower() for w in V.TREND_DATE_WORDS)]
    if not named:
        return None
    counts = df.agg(*[F.count(moment(df, c)).alias(f"n{i}") for i, c in enumerate(named)]).first()
    return next((c for c, n in zip(named, counts) if n >= 2), None)


def trend_metric_column(df: DataFrame) -> str | None:
    return find_column(df, V.FINDING_TREND_WORDS) or next(iter(numeric_columns(df)), None)


def half_over_half_trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """One row: change of the metric's mean from the earlier half of the rows
    to the later half, in percent; no row with fewer than 3 rows or an earlier
    mean of 0.

    The halves are cut by two order statistics instead of a sort: the date of
    the last row of the earlier half, and among the rows of that date (which
    may be a third of the table) the metric value at the cut. Rows that tie on
    both are equal, so any of them may stand on either side. The two figures
    reach the driver; the sums are one pass.
    """
    # Two numbers a row are kept, so the table, which may be a join, is computed once and not for each pass.
    rows = settled(df.select(F.unix_micros(moment(df, date)).cast("double").alias("t"), number(df, metric).alias("y")).dropna())
    cut = order_statistics(rows, [(date, F.col("t"))], [Rank("n div 2 - 1", 0.5)]).first()
    schema = ("date_column string, metric_column string, rows long, first_mean double, second_mean double, "
              "change_pct double, severity string")
    if cut["n"] < 3:
        return empty_rows(df, schema)
    half = cut["n"] // 2
    need, ties = half - cut["below0"], cut["same0"]
    tied = rows.filter(F.col("t") == F.lit(cut["v0"]))
    edge = order_statistics(
        tied, [(metric, F.col("y"))], [Rank(str(need - 1), (need - 1) / max(ties - 1, 1))]).first()

    y, at = F.col("y"), F.col("t") == F.lit(cut["v0"])
    early = F.when((F.col("t") < F.lit(cut["v0"])) | (at & (y < F.lit(edge["v0"]))), y)
    first = F.coalesce(F.sum(early), F.lit(0.0)) + F.lit((need - edge["below0"]) * edge["v0"])
    sums = rows.agg(F.count(F.lit(1)).alias("rows"), (first / half).alias("first_mean"),
                    ((F.sum(y) - first) / (cut["n"] - half)).alias("second_mean"))
    change = (F.col("second_mean") - F.col("first_mean")) / F.abs("first_mean") * 100
    return sums.filter("first_mean <> 0").select(
        F.lit(date).alias("date_column"), F.lit(metric).alias("metric_column"), "rows", "first_mean", "second_mean",
        change.alias("change_pct"),
        F.when(change > 10, "positive").when(change < -10, "critical").otherwise("info").alias("severity"))
