"""Anomalies, forecasting and models (N*, M*)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Window, functions as F

from prismatica.catalog.registry import GAPPY_SQL, Tables, query, r, rounded
from prismatica.catalog.statistics import drivers_sql, DIMS
from prismatica.operators import anomaly as A, forecast as C, groups as G, models as M


@query("n1_robust_z", """WITH m AS (SELECT median(value) AS c, mad(value) AS s FROM events)
SELECT event_id, round(abs(value - c) / (1.4826 * s + 1e-9), 4) AS robust_z, (abs(value - c) / (1.4826 * s + 1e-9) >= 3.5)::INT AS flagged FROM events, m""")
def n1(t):
    return A.robust_z(t("events"), "value").select("event_id", r("robust_z").alias("robust_z"), F.col("robust_anomaly").cast("int").alias("flagged"))


@query("n2_isolation_forest")
def n2(t):
    """Every event with its isolation decision."""
    return A.isolation_forest(t("events"), "value", key=["event_id"]).select("event_id", "value", "anomaly", "anomaly_score")


@query("n3_anomaly_ensemble")
def n3(t):
    return A.anomaly_ensemble(t("events"), "value", key=["event_id"]).select(
        "event_id", "value", "anomaly_score", "anomaly", "anomaly_reason")


@query("n4_anomaly_count")
def n4(t):
    return A.anomaly_count(A.anomaly_ensemble(t("customer"), "c_acctbal", ordered=False))


# Planted answers: data derived from the tables by a rule that the operator has to find, so
# that SQL, which fits no model, can state the result.
SPIKES_SQL = "spikes AS (SELECT event_id, CASE WHEN event_id % 40 = 0 THEN 10000.0 ELSE (event_id // 40) % 10 END::DOUBLE AS v FROM events)"


def _spikes(t):
    """Every fortieth event far above the rest, which take ten values."""
    i = F.col("event_id")
    return t("events").select("event_id", F.when(i % 40 == 0, 10000.0).otherwise(F.floor(i / 40) % 10).cast("double").alias("v"))


@query("n2_isolation_spikes", f"WITH {SPIKES_SQL} SELECT event_id, v, (v = 10000)::INT AS anomaly FROM spikes")
def n2_spikes(t):
    found = A.isolation_forest(_spikes(t), "v", contamination=0.03, key=["event_id"])
    return found.select("event_id", "v", F.col("anomaly").cast("int").alias("anomaly"))


@query("n3_ensemble_spikes", f"""WITH {SPIKES_SQL} SELECT event_id, (v = 10000)::INT AS anomaly,
CASE WHEN v = 10000 THEN 'Robust Z-score + Isolation Forest' ELSE 'Normal' END AS anomaly_reason FROM spikes""")
def n3_spikes(t):
    found = A.anomaly_ensemble(_spikes(t), "v", key=["event_id"], ordered=False)
    return found.select("event_id", F.col("anomaly").cast("int").alias("anomaly"), "anomaly_reason")


@query("n4_spike_count", f"""WITH {SPIKES_SQL} SELECT count(*) AS "rows", count(*) FILTER (WHERE v = 10000) AS anomalies,
round(count(*) FILTER (WHERE v = 10000) * 100.0::DOUBLE / count(*), 4) AS anomaly_pct FROM spikes""")
def n4_spikes(t):
    return rounded(A.anomaly_count(A.anomaly_ensemble(_spikes(t), "v", key=["event_id"], ordered=False)))


DAILY = """s AS (SELECT event_type AS series, date_trunc('day', ts) AS d, sum(value) AS y FROM events GROUP BY 1, 2)"""


@query("m1_daily_series", f"""WITH {DAILY} SELECT series, strftime(d, '%Y-%m-%d') AS "day", round(y, 2) AS y FROM s
WHERE series IN (SELECT series FROM s GROUP BY 1 HAVING count(*) >= 30)""")
def m1(t):
    d = C.daily_series(t("events"), "ts", "value", "event_type", "day", min_points=30)
    return d.select("series", F.date_format("date", "yyyy-MM-dd").alias("day"), r("y", 2).alias("y"))


LAGS = DAILY + """, l AS (SELECT series, d, y, row_number() OVER w - 1 AS k, """ + ", ".join(
    f"lag(y, {j}) OVER w AS lag_{j}" for j in range(1, 8)) + """,
 avg(y) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_mean_7,
 stddev_pop(y) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_std_7 FROM s WINDOW w AS (PARTITION BY series ORDER BY d)),
x AS (SELECT *, k - 7 AS place, count(*) OVER (PARTITION BY series) AS n FROM l WHERE k >= 7)"""


@query("m2_lag_features", f"""WITH {LAGS} SELECT series, strftime(d, '%Y-%m-%d') AS "day", {", ".join(f'round(lag_{j}, 2) AS lag_{j}' for j in range(1, 8))},
round(rolling_mean_7, 2) AS rolling_mean_7, round(rolling_std_7, 2) AS rolling_std_7 FROM x""")
def m2(t):
    f = C.lag_features(C.daily_series(t("events"), "ts", "value", "event_type", "day"))
    return f.select("series", F.date_format("date", "yyyy-MM-dd").alias("day"), *[r(c, 2).alias(c) for c in C.feature_names(7)])


@query("m3_chronological_split", f"""WITH {LAGS} SELECT series, strftime(d, '%Y-%m-%d') AS "day",
(place < least(greatest(greatest(floor(n * 0.8), n - 14), 10), n - 1))::INT AS is_train FROM x""")
def m3(t):
    f = C.chronological_split(C.lag_features(C.daily_series(t("events"), "ts", "value", "event_type", "day")))
    return f.select("series", F.date_format("date", "yyyy-MM-dd").alias("day"), F.col("is_train").cast("int").alias("is_train"))


@query("m4_forecast_metrics")
def m4_metrics(t):
    """Backtest of the daily event value per type."""
    return C.forecast_backtest(t("events"), "ts", "value", series="event_type", grain="day").metrics


@query("m4_forecast")
def m4(t):
    """Fourteen days ahead of the daily order value."""
    return C.forecast_backtest(t("orders"), "o_orderdate", "o_totalprice").forecast


SEASON_SQL = """season AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT o_orderdate AS d FROM orders)),
size AS (SELECT count(*) AS n, count(*) - 7 AS k, max(d) AS last FROM season)"""


def _season(t):
    """The order dates, with a value that repeats every seven of them."""
    dates = t("orders").select(F.col("o_orderdate").alias("d")).distinct()
    return dates.withColumn("y", (F.row_number().over(Window.orderBy("d")) - 1) % 7 * 10.0 + 5)


@lru_cache(maxsize=8)
def _season_forecast(spark, folder: str) -> C.Forecast:
    return C.forecast_backtest(_season(Tables(spark, folder)), "d", "y", trees=100)


@query("m4_season_metrics", f"""WITH {SEASON_SQL} SELECT 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 1.0::DOUBLE AS r2,
(k - least(greatest(greatest(floor(k * 0.8), k - 14), 10), k - 1))::BIGINT AS test_points FROM size""")
def m4_season_metrics(t):
    return rounded(_season_forecast(t.spark, t.folder).metrics.select("mae", "rmse", "r2", "test_points"))


@query("m4_season_forecast", f"""WITH {SEASON_SQL} SELECT strftime(last + to_days(j::INT), '%Y-%m-%d') AS "day",
((n - 1 + j) % 7 * 10 + 5)::DOUBLE AS forecast FROM size, generate_series(1, 14) AS g(j)""")
def m4_season(t):
    found = _season_forecast(t.spark, t.folder).forecast
    return found.select(F.date_format("date", "yyyy-MM-dd").alias("day"), r("forecast").alias("forecast"))


@query("m5_prepare_features", """
WITH r AS (SELECT * FROM customer WHERE c_acctbal IS NOT NULL),
     f AS (SELECT quantile_cont(c_custkey, 0.5) AS k, quantile_cont(c_nationkey, 0.5) AS n FROM r),
     m AS (SELECT c_mktsegment AS s FROM r WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, CAST(coalesce(c_custkey, k) AS DOUBLE) AS f_c_custkey,
       CAST(coalesce(c_nationkey, n) AS DOUBLE) AS f_c_nationkey, coalesce(c_mktsegment, s) AS f_c_mktsegment
FROM r, f, m""")
def m5(t):
    """Filled feature columns of the customers that predict their balance."""
    rows, prep = M.prepare_features(t("customer"), "c_acctbal")
    return prep.fill(rows).select("c_custkey", *prep.named("f_"))


# Models are fitted once per folder and session and read by several queries.
@lru_cache(maxsize=8)
def _regression(spark, folder: str) -> M.Trained:
    t = Tables(spark, folder)
    return M.train_compare(t("part"), "p_retailprice", key=["p_partkey"])


@lru_cache(maxsize=8)
def _classification(spark, folder: str) -> M.Trained:
    t = Tables(spark, folder)
    rows = t("labels").join(t("documents"), "doc_id").select("doc_id", "n_chars", "lang", "source", "toxic", "quality")
    return M.train_compare(rows, "quality", key=["doc_id"], variant="b")


@query("m6_train_compare")
def m6(t):
    return _regression(t.spark, t.folder).comparison


@query("m7_train_compare_b")
def m7(t):
    return _classification(t.spark, t.folder).comparison


@query("m7_holdout_predictions")
def m7_predictions(t):
    return _classification(t.spark, t.folder).predictions


@lru_cache(maxsize=8)
def _line(spark, folder: str) -> M.Trained:
    """A price that is a straight line of the part's size; the key says nothing."""
    return M.train_compare(_lined(Tables(spark, folder)), "price", key=["p_partkey"])


def _lined(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (3.0 * F.col("p_size") + 2).alias("price"))


@lru_cache(maxsize=8)
def _rule(spark, folder: str) -> M.Trained:
    """A label that a threshold of the size decides."""
    size = F.col("p_size") % 10
    rows = Tables(spark, folder)("part").select("p_partkey", size.cast("double").alias("size"), F.when(size >= 5, "large").otherwise("small").alias("label"))
    return M.train_compare(rows, "label", key=["p_partkey"], variant="b")


@query("m6_line_winner", "SELECT 'Linear Regression' AS model, 0.0::DOUBLE AS mae, 1.0::DOUBLE AS r2")
def m6_line(t):
    found = _line(t.spark, t.folder)
    return rounded(found.comparison.filter(F.col("model") == found.best_model).select("model", "mae", "r2"), 6)


@query("m7_rule_predictions", """WITH p AS (SELECT CASE WHEN p_size % 10 >= 5 THEN 'large' ELSE 'small' END AS label FROM part)
SELECT label AS actual, label AS prediction, round(count(*) * 0.2)::BIGINT AS n FROM p GROUP BY label""")
def m7_rule(t):
    """Held-out rows by class and prediction: a fifth of each class, all told right."""
    return _rule(t.spark, t.folder).predictions.groupBy("actual", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m9_line_predictions", "SELECT p_partkey, (3.0 * p_size + 2)::DOUBLE AS price, (3.0 * p_size + 2)::DOUBLE AS prediction FROM part")
def m9_line(t):
    return rounded(M.predict(_line(t.spark, t.folder), _lined(t)).select("p_partkey", "price", "prediction"))


@query("m10_line_importance", """SELECT 'numeric:size' AS feature, 3.0::DOUBLE AS importance, 100.0::DOUBLE AS importance_pct
UNION ALL SELECT 'numeric:p_partkey', 0, 0""")
def m10_line(t):
    return rounded(M.feature_importance(_line(t.spark, t.folder)), 6)


@query("m11_line_permutation", "SELECT 'size' AS feature")
def m11_line(t):
    """The feature that matters most for the line."""
    return M.permutation_importance(_lined(t), "price", key=["p_partkey"], trees=40, repeats=2, top_n=1).select("feature")


@query("m13_rule_summary", """SELECT 'label' AS target, 'classification' AS problem_type, 3::BIGINT AS models_trained, 'Gradient Boosting' AS best_model,
'f1' AS best_score_name, 1.0::DOUBLE AS best_score, 'numeric:size' AS top_feature""")
def m13_rule(t):
    """All three models tell the classes; of equal scores the first name wins."""
    found = M.model_summary(_rule(t.spark, t.folder))
    return rounded(found.select("*", F.element_at("top_features", 1).alias("top_feature")).drop("top_features"), 6)


@query("m8_evaluate_regression", """WITH p AS (SELECT l_extendedprice AS a, l_quantity * 2000 AS p FROM lineitem)
SELECT round(avg(abs(a - p)), 4) AS mae, round(sqrt(avg((a - p) ** 2)), 4) AS rmse,
round(1 - sum((a - p) ** 2) / sum((a - (SELECT avg(a) FROM p)) ** 2), 6) AS r2, count(*) AS test_points FROM p""")
def m8(t):
    pred = t("lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 2000).alias("p"))
    return rounded(M.evaluate_regression(pred, "a", "p"), 4, r2=6)


@query("m8_evaluate_classification", """WITH p AS (SELECT l_returnflag AS a, CASE WHEN l_discount > 0.07 THEN 'A' WHEN l_tax > 0.04 THEN 'N' ELSE 'R' END AS p FROM lineitem),
lb AS (SELECT l, count(*) FILTER (WHERE a = l) AS s, count(*) FILTER (WHERE p = l) AS q, count(*) FILTER (WHERE a = l AND p = l) AS h
       FROM p, (SELECT DISTINCT a AS l FROM p) GROUP BY l)
SELECT round(sum(h) / sum(s), 6) AS accuracy, round(sum(s * coalesce(h / nullif(q, 0), 0)) / sum(s), 6) AS "precision",
round(sum(s * coalesce(h / nullif(s, 0), 0)) / sum(s), 6) AS recall, round(sum(s * coalesce(2.0 * h / nullif(q + s, 0), 0)) / sum(s), 6) AS f1, sum(s)::BIGINT AS test_points FROM lb""")
def m8c(t):
    guess = F.when(F.col("l_discount") > 0.07, "A").when(F.col("l_tax") > 0.04, "N").otherwise("R")
    pred = t("lineitem").select(F.col("l_returnflag").alias("a"), guess.alias("p"))
    return rounded(M.evaluate_classification(pred, "a", "p"), 6)


@query("m9_predict")
def m9(t):
    return M.predict(_regression(t.spark, t.folder), t("part")).select("p_partkey", "p_retailprice", "prediction")


@query("m10_feature_importance")
def m10(t):
    return M.feature_importance(_regression(t.spark, t.folder))


@query("m11_permutation_importance")
def m11(t):
    return M.permutation_importance(t("part"), "p_retailprice", key=["p_partkey"])


@query("m12_driver_answer", f"WITH {GAPPY_SQL}, {drivers_sql('gappy', DIMS, 5)}")
def m12(t):
    return rounded(G.driver_answer(t("gappy"), "revenue", DIMS).withColumnRenamed("count", "n"), 6, sum=2, mean=4, share_of_total=8)


@query("m13_model_summary")
def m13(t):
    return M.model_summary(_classification(t.spark, t.folder))
