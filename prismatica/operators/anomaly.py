"""Anomaly detection on one numeric column: robust z-score, isolation forest
and their ensemble.

Like Spark's own models, the detectors are fitted first (a few numbers, or a
step table bounded by trees x sample size, reach the driver) and then applied
in one pass over the whole table.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from prismatica.functions.columns import number, value
from prismatica.functions.coerce import col
from prismatica.functions.quantiles import quantiles

# The tree helpers travel to the executors with the job, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAD_SCALE, EPSILON, ROBUST_CUT = 1.4826, 1e-9, 3.5
SAMPLE = 256
AUTO_CUT = 0.5
ROBUST_WEIGHT, ISOLATION_WEIGHT = 0.60, 0.40


# --- robust z-score -------------------------------------------------------------------

@dataclass(frozen=True)
class RobustModel:
    column: str
    median: float | None
    mad: float | None

    def score(self, y: Column) -> Column:
        if self.median is None:
            return F.lit(None).cast("double")
        return F.abs((y - F.lit(self.median)) / F.lit(MAD_SCALE * self.mad + EPSILON))


def fit_robust(df: DataFrame, column: str) -> RobustModel:
    """Exact median, and exact median of the distances to it."""
    y = number(df, column)
    middle = quantiles(df, [(column, y)], [0.5]).first()["q0"]
    if middle is None:
        return RobustModel(column, None, None)
    spread = quantiles(df, [(column, F.abs(y - F.lit(middle)))], [0.5]).first()["q0"]
    return RobustModel(column, middle, spread)


def robust_z(df: DataFrame, column: str) -> DataFrame:
    """Every row with its robust z-score and whether it reaches 3.5."""
    z = fit_robust(df, column).score(number(df, column))
    return df.withColumns({"robust_z": z, "robust_anomaly": F.coalesce(z >= ROBUST_CUT, F.lit(False))})


# --- isolation forest -----------------------------------------------------------------

def _path_mean(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    full = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def _tree_steps(values: np.ndarray, depth_limit: int, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """Random splits of one sorted sample: cut points in order, and the path
    length of each interval between them."""
    cuts, paths = [], []
    pending = [(0, len(values), 0, None)]
    while pending:
        lo, hi, depth, cut = pending.pop()
        if cut is not None:
            cuts.append(cut)
        low, high = (values[lo], values[hi - 1]) if hi > lo else (0.0, 0.0)
        if hi - lo <= 1 or depth >= depth_limit or low == high:
            paths.append(depth + float(_path_mean(hi - lo)))
            continue
        at = rng.uniform(low, high)
        split = lo + int(np.searchsorted(values[lo:hi], at, side="right"))
        pending.append((split, hi, depth + 1, at))
        pending.append((lo, split, depth + 1, None))
    return cuts, paths


def _grow(depth_limit: int, seed: int):
    def grow(tree: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(tree["v"].to_numpy(dtype=float))
        cuts, paths = _tree_steps(values, depth_limit, np.random.default_rng([seed, int(tree["tree"].iloc[0])]))
        return pd.DataFrame({"edge": [-np.inf, *cuts], "delta": np.diff(paths, prepend=0.0)})
    return grow


@dataclass(frozen=True)
class IsolationModel:
    """Summed path length of the forest as a step function of the value."""

    column: str
    edges: np.ndarray
    paths: np.ndarray
    trees: int
    sample: int

    def score(self, df: DataFrame, name: str = "isolation_score") -> DataFrame:
        """Every row with its score, 2^(-mean path / c(sample)); higher is
        more isolated. One Arrow pass with a broadcast step table."""
        steps = df.sparkSession.sparkContext.broadcast(
            (self.edges, np.exp2(-self.paths / (self.trees * float(_path_mean(self.sample))))))

        @F.pandas_udf("double")
        def look_up(y: pd.Series) -> pd.Series:
            edges, scores = steps.value
            x = y.to_numpy(dtype=float, na_value=np.nan)
            found = scores[np.searchsorted(edges, x, side="left")]
            return pd.Series(np.where(np.isnan(x), np.nan, found)).astype("Float64").mask(np.isnan(x))

        return df.withColumn(name, look_up(number(df, self.column)))


def fit_isolation(df: DataFrame, column: str, trees: int = 300, seed: int = 42, key: list[str] | None = None,
                  rows: int | None = None) -> IsolationModel:
    """Grow the forest from about ``trees * 256`` sampled rows.

    A value that occurs c times enters c * trees * 256 / n sample slots, the
    fraction rounded by a hash of the value. So the sample does not depend on
    partitioning, a value that fills a third of the table takes a third of the
    slots instead of all or none, and the shuffle into trees is bounded. With a
    unique ``key`` rows are drawn one by one and no values are grouped first.
    """
    y = number(df, column)
    n = rows if rows is not None else df.agg(F.count(y)).first()[0]
    sample = min(SAMPLE, n)
    if key:
        units = df.select(y.alias("v"), F.xxhash64(*[col(k) for k in key]).alias("id"), F.lit(1).alias("c")).filter("v is not null")
    else:
        units = (df.select(y.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
                 .withColumn("id", F.xxhash64("v")))
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2 ** 30)) / F.lit(float(2 ** 30))
    start = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(trees))
    slots = (units.withColumn("copies", F.floor(F.col("c") * F.lit(trees * sample / n) + chance)).filter("copies > 0")
             .select("v", start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("i"))
             .select(F.pmod(F.col("start") + F.col("i"), F.lit(trees)).cast("int").alias("tree"), "v"))
    limit = math.ceil(math.log2(max(sample, 2)))
    steps = (slots.groupBy("tree").applyInPandas(_grow(limit, seed), "edge double, delta double")
             .groupBy("edge").agg(F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("trees"))
             .orderBy("edge").toPandas())
    grown = int(steps["trees"].iloc[0])  # every tree starts at -inf once
    total = np.cumsum(steps["delta"].to_numpy())
    return IsolationModel(column, steps["edge"].to_numpy()[1:], total, grown, sample)


def isolation_forest(df: DataFrame, column: str, contamination: float | None = None, trees: int = 100,
                     seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Rows with a value, whether the forest isolates them and the decision
    score (negative for anomalies). The cut is a score of 0.5, or the score
    quantile that leaves the ``contamination`` share above it. Fewer than five
    values give no score columns."""
    y = number(df, column)
    kept = df.filter(y.isNotNull())
    n = kept.count()
    if n < 5:
        return kept
    scored = fit_isolation(kept, column, trees, seed, key, rows=n).score(kept, "__raw")
    cut = AUTO_CUT
    if contamination is not None:
        cut = quantiles(scored, [("raw", F.col("__raw"))], [1 - contamination]).first()["q0"]
    return scored.withColumns({"anomaly": F.col("__raw") > F.lit(cut), "anomaly_score": F.lit(cut) - F.col("__raw")}).drop("__raw")


# --- ensemble -------------------------------------------------------------------------

def _scaled(c: Column, low: float, high: float) -> Column:
    if bool(np.isclose(low, high)):
        return F.when(c.isNotNull(), F.lit(0.0))
    share = (c - F.lit(low)) / F.lit(high - low)
    return F.when(c.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def anomaly_ensemble(df: DataFrame, column: str, contamination: float = 0.03, trees: int = 300, seed: int = 42,
                     key: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """Every row with anomaly_score, anomaly and anomaly_reason, highest
    score first. Fewer than 12 values or no spread: all rows are normal."""
    if column not in df.columns:
        raise ValueError(f"column '{column}' not found")
    y = number(df, column)
    n, spread = df.agg(F.count(y), F.stddev_pop(y)).first()
    if n < 12 or not spread:
        return df.withColumns({"anomaly_score": F.lit(None).cast("double"), "anomaly": F.lit(False),
                               "anomaly_reason": F.lit("Normal")})
    share = min(max(float(contamination), 0.001), 0.20)
    robust = fit_robust(df, column)
    scored = fit_isolation(df, column, trees, seed, key, rows=n).score(df, "__iso").withColumn("__rob", robust.score(y))
    r, i = quantiles(scored, [("robust", F.col("__rob")), ("isolation", F.col("__iso"))],
                     [0.05, 0.95, 1 - share]).orderBy("col_no").collect()
    by_z = F.coalesce(F.col("__rob") >= ROBUST_CUT, F.lit(False))
    by_forest = F.coalesce(F.col("__iso") > F.lit(i["q2"]), F.lit(False))
    score = (_scaled(F.col("__rob"), r["q0"], r["q1"]) * ROBUST_WEIGHT
             + _scaled(F.col("__iso"), i["q0"], i["q1"]) * ISOLATION_WEIGHT)
    reason = (F.when(by_z & by_forest, "Robust Z-score + Isolation Forest").when(by_z, "Robust Z-score")
              .when(by_forest, "Isolation Forest").otherwise("Normal"))
    out = scored.withColumns({"anomaly_score": F.round(score, 4), "anomaly": by_z | by_forest,
                              "anomaly_reason": reason}).drop("__iso", "__rob")
    # Scores repeat (most rows may share one), so a hash of the row splits the
    # ties between the sort's partitions.
    tie = F.xxhash64(*[value(df, c) for c in (key or df.columns)])
    return out.orderBy(F.desc_nulls_last("anomaly_score"), tie) if ordered else out


def anomaly_rows(scored: DataFrame) -> DataFrame:
    """The flagged rows of a scored table."""
    return scored.filter("anomaly")


def anomaly_count(scored: DataFrame) -> DataFrame:
    """One row: scored rows, flagged rows and their share."""
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anomaly").alias("anomalies")).withColumn(
        "anomaly_pct", F.coalesce(F.try_divide(F.col("anomalies") * 100.0, F.col("rows")), F.lit(0.0)))
