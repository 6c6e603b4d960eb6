"""Forecasting: series, lag features, chronological split, backtest and a
recursive forecast for every series at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from prismatica.functions.coerce import text_key
from prismatica.functions.columns import moment, number, value
from prismatica.operators.models import TREE_MEMORY_MB, dealt, evaluate_regression

ROLLING = 7
ONE_SERIES = "all"
SLICE = 100_000  # points of a series that one window task holds


def daily_series(df: DataFrame, date: str, target: str, series: str | None = None, grain: str | None = None,
                 min_points: int | None = None) -> DataFrame:
    """(series, date, y): the target summed per date (or per ``grain``) of each
    series; bad dates and values are left out, and so are series with fewer
    than ``min_points`` dates."""
    t = moment(df, date)
    name = text_key(value(df, series)) if series else F.lit(ONE_SERIES)
    out = (df.select(name.alias("series"), (F.date_trunc(grain, t) if grain else t).alias("date"), number(df, target).alias("y"))
           .filter("date is not null and y is not null").groupBy("series", "date").agg(F.sum("y").alias("y")))
    if min_points:
        long_enough = out.groupBy("series").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") >= min_points)
        a, b = out.alias("a"), long_enough.alias("b")
        out = a.join(b, F.col("a.series").eqNullSafe(F.col("b.series")), "left_semi")
    return out


def positions(points: DataFrame) -> DataFrame:
    """``points`` with ``position``, the number of earlier points of the series.

    A series is not sorted in one task: its points are numbered within each day, and the
    counts of the days before are added. What one task holds is a day of points, or a
    row for each day of a series."""
    days = points.withColumn("day__", F.to_date("date"))
    earlier = Window.partitionBy("series").orderBy("day__").rowsBetween(Window.unboundedPreceding, -1)
    starts = (days.groupBy("series", "day__").agg(F.count(F.lit(1)).alias("n"))
              .select("series", "day__", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start__")))
    a, b = days.alias("a"), starts.alias("b")
    placed = a.join(b, F.col("a.series").eqNullSafe(F.col("b.series")) & F.col("a.day__").eqNullSafe(F.col("b.day__")))
    within = F.row_number().over(Window.partitionBy("a.series", "a.day__").orderBy("a.date"))
    return placed.select("a.*", (F.col("start__") + within - 1).alias("position")).drop("day__")


def lag_features(points: DataFrame, lags: int = 7, slice_points: int = SLICE) -> DataFrame:
    """lag_1..lag_n and the mean and population deviation of the previous
    seven points; the first ``lags`` points of a series have no row.

    Windows run over slices of ``slice_points`` points of a series, one row per date. The last
    points of a slice are also context of the next one, so a slice's edge changes no figure
    and a series may be of any length."""
    reach = max(lags, ROLLING)
    size = max(slice_points, reach)
    own = F.floor(F.col("position") / size)
    edge = F.col("position") % size >= size - reach
    sliced = positions(points).withColumn("slice__", F.explode(F.when(edge, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("series", "slice__").orderBy("position")
    before = w.rowsBetween(-ROLLING, -1)
    return (sliced.withColumns({f"lag_{j}": F.lag("y", j).over(w) for j in range(1, lags + 1)})
            .withColumns({"rolling_mean_7": F.avg("y").over(before), "rolling_std_7": F.stddev_pop("y").over(before)})
            .filter((own == F.col("slice__")) & (F.col("position") >= lags))
            .withColumn("position", F.col("position") - lags).drop("slice__"))


def chronological_split(features: DataFrame) -> DataFrame:
    """Mark each series' rows as train or test: the cut is the larger of 80 %
    and all but 14, held between 10 and all but one. The counts come from an aggregate,
    one row a series."""
    counts = features.groupBy("series").agg(F.count(F.lit(1)).alias("n__"))
    n = F.col("n__")
    cut = F.least(F.greatest(F.greatest(F.floor(n * 0.8), n - 14), F.lit(10)), n - 1)
    a, b = features.alias("a"), counts.alias("b")
    return (a.join(b, F.col("a.series").eqNullSafe(F.col("b.series")))
            .select("a.*", (F.col("a.position") < cut).alias("is_train")))


def feature_names(lags: int) -> list[str]:
    return [*[f"lag_{j}" for j in range(1, lags + 1)], "rolling_mean_7", "rolling_std_7"]


@dataclass
class Forecast:
    """Backtest metrics (a row per series) and future values; ``message`` says
    if there was too little history."""

    metrics: DataFrame | None
    forecast: DataFrame | None
    message: str


def _assembled(df: DataFrame, lags: int) -> DataFrame:
    names = feature_names(lags)
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled)


def _recent_features(history: Column, lags: int) -> dict[str, Column]:
    """The feature row that follows a history array."""
    last = F.slice(history, -ROLLING, ROLLING) if lags >= ROLLING else history
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    mean = total(last) / F.size(last)
    variance = total(F.transform(last, lambda x: (x - mean) * (x - mean))) / F.size(last)
    return {**{f"lag_{j}": F.element_at(history, -j) for j in range(1, lags + 1)},
            "rolling_mean_7": mean, "rolling_std_7": F.sqrt(variance)}


def recursive_forecast(points: DataFrame, model: RandomForestRegressionModel, periods: int, lags: int,
                       grain: str | None = None) -> DataFrame:
    """(series, date, forecast): each step is predicted for all series at once
    from the values before it, own predictions included, never below 0.

    The state is one row per series with its last values; the plan grows by
    one projection per period."""
    keep = max(lags, ROLLING)
    a, b = positions(points).alias("a"), points.groupBy("series").agg(F.count(F.lit(1)).alias("n__")).alias("b")
    recent = a.join(b, F.col("a.series").eqNullSafe(F.col("b.series"))).filter("a.position >= n__ - %d" % keep).select("a.*")
    state = (recent.groupBy("series").agg(F.max("date").alias("last"), F.array_sort(F.collect_list(F.struct("date", "y"))).alias("p"))
             .select("series", "last", F.transform("p", lambda s: s["y"]).alias("history")))
    for step in range(periods):
        rows = _assembled(state.withColumns(_recent_features(F.col("history"), lags)), lags)
        state = model.transform(rows).select(
            "series", "last", F.concat("history", F.array(F.greatest(F.col("prediction"), F.lit(0.0)))).alias("history"))
    future = F.slice(F.col("history"), -periods, periods)
    return state.select("series", "last", F.posexplode(future).alias("k", "forecast")).select(
        "series", F.timestamp_add((grain or "day").upper(), F.col("k") + 1, F.col("last")).cast(points.schema["date"].dataType).alias("date"), "forecast")


def forecast_backtest(df: DataFrame, date: str, target: str, periods: int = 14, lags: int = 7,
                      series: str | None = None, grain: str | None = None, trees: int = 300, max_depth: int = 12,
                      seed: int = 42) -> Forecast:
    """Fit a random forest on the earlier part of every series, measure it on
    the later part, then forecast ``periods`` steps of the grain, days by default."""
    points = daily_series(df, date, target, series, grain, min_points=max(30, lags + 10)).persist()
    # The slices of a long series would train in as few tasks.
    rows = dealt(_assembled(chronological_split(lag_features(points, lags)), lags), points.count()).persist()
    if rows.isEmpty():
        return Forecast(None, None, "Need more historical observations for forecasting.")
    model = RandomForestRegressor(
        featuresCol="features", labelCol="y", numTrees=trees, minInstancesPerNode=2, maxDepth=max_depth,
        featureSubsetStrategy="all", seed=seed, maxMemoryInMB=TREE_MEMORY_MB).fit(rows.filter("is_train"))
    tested = model.transform(rows.filter("not is_train")).select("series", "y", "prediction")
    metrics = evaluate_regression(tested, "y", "prediction", by=["series"])
    return Forecast(metrics, recursive_forecast(points, model, periods, lags, grain), "Forecast with chronological backtest.")
