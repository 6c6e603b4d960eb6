"""Planted answers for anomalies, forecasts and models."""

import re
import threading

import pytest
from pyspark.sql import Window, functions as F

from prismatica.operators import anomaly as A, forecast as C, models as M
from conftest import rows_of


def test_robust_z_finds_spikes(spikes):
    hit = A.robust_z(spikes, "v").filter("robust_anomaly and v = 500")
    assert hit.count() == 10


def test_ensemble_finds_spikes(spikes):
    scored = A.anomaly_ensemble(spikes, "v", trees=60)
    top = scored.filter("v = 500").collect()
    assert len(top) == 10 and all(r["anomaly"] and r["anomaly_score"] == 1.0 for r in top)
    assert {r["anomaly_reason"] for r in top} == {"Robust Z-score + Isolation Forest"}
    assert scored.count() == 2010


def test_ensemble_of_flat_or_short_data_is_normal(spark):
    flat = spark.range(50).selectExpr("1.0D AS v")
    assert A.anomaly_ensemble(flat, "v").filter("anomaly").count() == 0
    assert {r["anomaly_reason"] for r in A.anomaly_ensemble(spark.range(5).selectExpr("cast(id as double) v"), "v").collect()} == {"Normal"}


def test_isolation_is_independent_of_partitioning(spikes):
    a = A.fit_isolation(spikes.repartition(1), "v", trees=40)
    b = A.fit_isolation(spikes.repartition(13), "v", trees=40)
    assert a.edges.tolist() == b.edges.tolist() and a.paths == pytest.approx(b.paths)


def test_isolation_sample_holds_a_hot_value_in_proportion(spark):
    hot = spark.range(90_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7.0D ELSE cast(id as double) END AS v")
    model = A.fit_isolation(hot, "v", trees=20)
    scored = model.score(hot.limit(3000)).groupBy((F.col("v") == 7.0).alias("hot")).agg(F.max("isolation_score").alias("s"))
    assert {r["hot"]: r["s"] for r in scored.collect()}[True] < 0.65 and model.trees == 20


def test_isolation_keeps_missing_rows(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(None,), (1000.0,)], "v double")
    out = A.anomaly_ensemble(df, "v", trees=30)
    assert out.count() == 102 and out.filter("v is null").first()["anomaly_score"] is None
    assert out.filter("v = 1000").first()["anomaly"]


def test_lags_and_split(spark):
    days = spark.range(40).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS d", "cast(id as double) AS y")
    rows = C.chronological_split(C.lag_features(C.daily_series(days, "d", "y"))).orderBy("date").collect()
    assert len(rows) == 33 and rows[0]["lag_1"] == 6 and rows[0]["rolling_mean_7"] == 3 and rows[0]["rolling_std_7"] == 2
    assert sum(r["is_train"] for r in rows) == max(int(33 * 0.8), 33 - 14)


@pytest.mark.parametrize("lags, size", [(7, 50), (3, 7), (12, 1), (7, 100_000)])
def test_lags_over_slices_equal_one_window(spark, lags, size):
    """Uneven days, days without points and several series; size 1 is raised to the reach of a row."""
    points = spark.range(3000).selectExpr("concat('s', id % 3 % 2) AS series", "pmod(xxhash64(id), 1000) / 8.0D AS y",
                                          "timestamp_seconds(1700000000 + id * id * 40) AS date").repartition(5)
    w = Window.partitionBy("series").orderBy("date")
    before = w.rowsBetween(-7, -1)
    want = (points.withColumns({f"lag_{j}": F.lag("y", j).over(w) for j in range(1, lags + 1)})
            .withColumns({"rolling_mean_7": F.avg("y").over(before), "rolling_std_7": F.stddev_pop("y").over(before),
                          "position": F.row_number().over(w) - 1}).filter(F.col("position") >= lags)
            .withColumn("position", (F.col("position") - lags).cast("long")))
    got = C.lag_features(points, lags, size).select(want.columns)
    rounded = [F.round(c, 9).alias(c) if c.startswith("rolling") else F.col(c) for c in want.columns]
    assert rows_of(got.select(rounded)) == rows_of(want.select(rounded)) and got.count() == 3000 - 2 * lags


def test_no_window_holds_a_whole_series(spark):
    """Besides the numbering of days, windows are partitioned by day or slice."""
    points = C.daily_series(spark.range(50).selectExpr("timestamp_seconds(id * 1000) AS t", "1.0D AS y"), "t", "y")
    plan = C.chronological_split(C.lag_features(points))._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?), (?:specifiedwindowframe)", plan)
    assert specs and all("day__" in s or "slice__" in s for s in specs), specs


def test_forecast_of_a_weekly_season_beats_the_last_value(spark):
    days = spark.range(140).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS d",
                                       "100 + 50 * (id % 7) + (id * 7919 % 5) AS y")
    got = C.forecast_backtest(days, "d", "y", periods=7, trees=40)
    mae = got.metrics.first()["mae"]
    naive = days.selectExpr("abs(y - lag(y) OVER (ORDER BY d)) AS e").agg(F.avg("e")).first()[0]
    assert mae < naive / 2
    future = got.forecast.orderBy("date").collect()
    assert len(future) == 7 and str(future[0]["date"])[:10] == "2024-05-20"
    assert max(r["forecast"] for r in future) > 300 and min(r["forecast"] for r in future) >= 0


def test_short_history_is_reported(spark):
    days = spark.range(10).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS d", "1.0D AS y")
    assert C.forecast_backtest(days, "d", "y").forecast is None


def line(spark):
    return spark.range(300).selectExpr("id", "id / 10.0D AS x", "concat('g', id % 3) AS g", "3 * (id / 10.0D) + 2 AS y")


def test_line_is_learned(spark):
    got = M.train_compare(line(spark), "y", key=["id"], trees=20)
    best = got.comparison.filter(F.col("model") == got.best_model).first()
    assert got.problem_type == "regression" and best["r2"] > 0.999
    out = M.predict(got, line(spark))
    assert out.count() == 300 and out.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 5
    assert M.model_summary(got).first()["models_trained"] == 3
    assert M.feature_importance(got).count() >= 2


def test_classes_are_learned(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 10 as double) AS x", "CASE WHEN id % 10 >= 5 THEN 'yes' ELSE 'no' END AS label")
    got = M.train_compare(df, "label", key=["id"], trees=10)
    assert got.labels == ["no", "yes"] and got.comparison.agg(F.max("accuracy")).first()[0] == 1.0
    table = got.predictions
    assert table.filter("actual <> prediction").count() == 0
    assert table.filter("prediction_probability between 0 and 1").count() == table.count()


def test_encoding_is_a_choice_and_not_a_matter_of_size(spark, monkeypatch):
    """The same features on both sides of any number of levels."""
    for levels in (9_999, 10_001):
        df = spark.range(3 * levels).selectExpr("id", f"concat('w', id % {levels}) AS word", f"cast(id % {levels} as double) AS y")
        assert M.prepare_features(df, "y")[1].categorical == ["word"]
        assert M.prepare_features(df, "y", encoding="hash")[1].hashed == ["word"]
    monkeypatch.setattr(M, "SLOTS", 64)
    df = spark.range(200).selectExpr("id", "concat('w', id % 20) AS word", "cast(id % 20 as double) AS y")
    got = M.train_compare(df, "y", key=["id"], trees=10, max_depth=8, encoding="hash")
    assert got.preparation.hashed == ["word"] and got.comparison.filter("status = 'Success'").count() == 3
    with pytest.raises(ValueError):
        M.prepare_features(df, "y", encoding="other")


def shares(df, label="label"):
    return {r[label]: (r["n"], r["test"]) for r in df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(~F.col("is_train")).alias("test")).collect()}


def test_split_gives_every_class_its_share(spark):
    """Rare classes are on both sides, the others within a row of a fifth, however the rows lie."""
    sizes = {"two": 2, "three": 3, "ten": 10, "odd": 57, "third": 4000, "rest": 5000}
    df = spark.createDataFrame([(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)], "key string, label string")
    one, two = (M.stratified_split(d, "label", key=["key"]) for d in (df.repartition(1), df.repartition(11)))
    got = shares(one)
    assert {c: n for c, (n, _) in got.items()} == sizes and got["two"][1] == 1 and got["three"][1] == 1
    assert all(abs(test - 0.2 * n) <= 1 for n, test in got.values())
    assert one.columns == ["key", "label", "is_train"]
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


def test_split_of_single_rows_nulls_and_repeated_keys(spark):
    alone = spark.createDataFrame([(i, "a" if i else "b") for i in range(300)], "key long, label string")
    assert {tuple(r) for r in M.stratified_split(alone, "label", key=["key"]).collect()} == {tuple(r) for r in M.hash_split(alone, key=["key"]).collect()}
    some = spark.createDataFrame([(i // 3, None if i % 5 == 0 else f"c{i % 2}", 1.0) for i in range(300)], "key long, label string, m double")
    marked = M.stratified_split(some, "label", key=["key"])
    assert marked.count() == 300 and marked.filter("is_train is null").count() == 0
    assert marked.groupBy("key", "label").agg(F.count_distinct("is_train").alias("sides")).filter("sides > 1").count() == 0
    assert M.stratified_split(some.limit(0), "label").count() == 0
    numbers = spark.createDataFrame([(i, float(i % 2)) for i in range(100)], "key long, label double")
    assert shares(M.stratified_split(numbers, "label", key=["key"])) == {0.0: (50, 10), 1.0: (50, 10)}


def test_training_meets_rare_classes_on_both_sides(spark):
    df = spark.range(200).selectExpr("id", "cast(if(id < 4, 9, id % 2) as double) AS x", "if(id < 4, 'rare', concat('c', id % 2)) AS label")
    got = M.train_compare(df, "label", key=["id"], trees=6, max_depth=4)
    assert got.predictions.filter("actual = 'rare'").count() == 1 and got.predictions.count() == 41  # 1 of 4 and 20 of 98 twice
    assert spark._jsc.getPersistentRDDs().size() > 0
    got.release()
    assert not got.kept[0].storageLevel.useMemory


def test_a_permuted_row_carries_no_block_along(spark, monkeypatch):
    plans = []
    plain = M.evaluate_regression
    monkeypatch.setattr(M, "evaluate_regression", lambda pred, *a, **k: (plans.append((pred.count(), pred.columns, pred.dtypes)), plain(pred, *a, **k))[1])
    df = spark.range(2000).selectExpr("id AS key", "cast(pmod(xxhash64(id), 100) as double) AS x", "concat('w', id % 50) AS w").selectExpr("*", "5 * x AS y")
    got = M.permutation_importance(df, "y", key=["key"], trees=5, repeats=3).collect()
    held_out = df.filter(F.pmod(F.xxhash64("key", F.lit(42)), F.lit(10_000)) < 2_000).count()
    (rows, columns, dtypes), = plans
    assert rows == held_out * (3 * 3 + 1) and not [t for _, t in dtypes if t.startswith("array")] and "m" not in columns
    assert got[0]["feature"] == "x" and {r["feature"] for r in got} == {"key", "x", "w"}


def test_permutation_importance_ranks_the_cause_first(spark):
    df = spark.range(400).selectExpr("id AS key", "cast(pmod(xxhash64(id), 100) as double) AS x",
                                     "cast(pmod(xxhash64(id, 7), 100) as double) AS noise").selectExpr("*", "5 * x AS y")
    got = M.permutation_importance(df, "y", key=["key"], trees=20, repeats=4).collect()
    assert got[0]["feature"] == "x" and got[0]["importance"] > 0.5


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    row = M.evaluate_classification(df, "y", "p").first()
    assert row["accuracy"] == 0.5 and row["recall"] == 0.5
    assert row["precision"] == pytest.approx((2 * 1 + 1 * (1 / 3)) / 4)


def test_three_classes_and_a_target_named_like_an_internal_column(spark):
    df = spark.range(240).selectExpr("id", "cast(id % 12 as double) AS features", "concat('c', (id % 12) div 4) AS prediction")
    got = M.train_compare(df, "prediction", key=["id"], trees=8, max_depth=4)
    assert got.labels == ["c0", "c1", "c2"]
    assert got.comparison.filter("status = 'Success'").count() == 3
    assert set(got.predictions.columns) == {"id", "features", "actual", "prediction"}


def test_fills_come_from_the_training_rows_and_names_may_hold_dots(spark):
    df = spark.range(300).selectExpr("id", "if(id % 4 = 0, null, cast(id % 7 as double)) AS `unit.price`", "id % 3 AS x",
                                     "cast(id % 3 as double) AS f_x", "concat('k', id % 2) AS `a.b`", "concat('c', id % 3) AS y")
    far = df.withColumn("unit.price", F.when(M.in_training(df, ["id"]), F.col("`unit.price`")).otherwise(1e9))
    assert far.filter("`unit.price` = 1e9").count() > 10
    fills = [M.prepare_features(d, "y", training=M.in_training(d, ["id"]))[1].fills for d in (df, far)]
    assert fills[0] == fills[1] and "unit.price" in fills[0]
    got = M.train_compare(df, "y", key=["id"], trees=4, max_depth=4)
    assert [r["error"] for r in got.comparison.collect()] == [None] * 3
    assert M.predict(got, df).filter("prediction = y").count() == 300


def test_a_table_of_one_task_is_trained_on_by_several(spark):
    n = 3 * M.TASK_ROWS - 1
    i = F.col("id")
    one = spark.range(n).select("id", (i % 100).cast("double").alias("x"), (3.0 * (i % 100) + 2).alias("y")).coalesce(1)
    got = M.train_compare(one, "y", key=["id"], trees=2, max_depth=2)
    data = got.kept[0]
    sizes = [r["n"] for r in data.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 3 and max(sizes) <= M.TASK_ROWS
    assert data.select("id").distinct().count() == n
    assert got.best_model == "Linear Regression"
    got.release()


def test_dealt_rows_keep_their_place_and_few_rows_stay(spark):
    some = spark.range(2 * M.TASK_ROWS).withColumn("v", F.col("id") % 7)
    task = F.spark_partition_id().alias("task")
    first, again = ([tuple(r) for r in M.dealt(some, some.count()).select("*", task).collect()] for _ in range(2))
    assert first == again
    few = spark.range(10).coalesce(1)
    assert M.dealt(few, 10) is few


def test_forests_keep_the_node_of_each_row_and_stay_the_same(spark):
    for kind in ("regression", "classification"):
        assert M._candidates(kind, 2, 3, 4, "a", 1)["Random Forest"].getCacheNodeIds()
    rows = spark.range(600).selectExpr("cast(id % 50 as double) AS a", "cast(pmod(xxhash64(id), 90) as double) AS b").selectExpr("*", "a * b AS y")
    data = M.VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(rows).persist()
    forest = M.RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=12, maxDepth=8, seed=3, maxMemoryInMB=1)
    kept, followed = (forest.copy().setCacheNodeIds(c).fit(data) for c in (True, False))
    assert [re.sub("uid=.*", "", t.toDebugString) for t in kept.trees] == [re.sub("uid=.*", "", t.toDebugString) for t in followed.trees]
    data.unpersist()


def test_models_are_fitted_side_by_side_and_a_failure_costs_only_itself(spark, monkeypatch):
    """Each waits for the others to begin, so one after another none would be fitted."""
    begun, plain = threading.Barrier(3, timeout=60), M._candidates

    class Waiting:
        def __init__(self, estimator, fails):
            self.estimator, self.fails = estimator, fails

        def fit(self, data):
            begun.wait()
            if self.fails:
                raise ValueError("no fit")
            return self.estimator.fit(data)

    monkeypatch.setattr(M, "_candidates", lambda *a: {n: Waiting(e, n == "Random Forest") for n, e in plain(*a).items()})
    got = M.train_compare(line(spark), "y", key=["id"], trees=2, max_depth=2)
    assert [(r["model"], r["status"], r["error"]) for r in got.comparison.collect()] == [
        ("Linear Regression", "Success", None), ("Random Forest", "Failed", "no fit"), ("Gradient Boosting", "Success", None)]
    got.release()


def test_the_copies_of_a_permuted_row_follow_each_other(spark, monkeypatch):
    seen, plain = [], M.evaluate_regression
    monkeypatch.setattr(M, "evaluate_regression", lambda pred, *a, **k: (seen.extend(pred.select("feature", "repeat", "label").collect()), plain(pred, *a, **k))[1])
    df = spark.range(500).selectExpr("id AS key", "cast(pmod(xxhash64(id), 100) as double) AS x", "id + 0.5D AS y")
    M.permutation_importance(df, "y", key=["key"], trees=3, repeats=2).collect()
    copies = [(-1, 0), (0, 0), (0, 1), (1, 0), (1, 1)]
    assert seen and len(seen) % 5 == 0
    for at in range(0, len(seen), 5):
        row = seen[at:at + 5]
        assert [(r["feature"], r["repeat"]) for r in row] == copies and len({r["label"] for r in row}) == 1


def test_the_statistics_of_a_forest_leave_room_for_the_rows(spark, monkeypatch):
    """Two tasks side by side in a heap of 1800 MB, of which cached rows may take 900."""
    assert M.executor_heap(spark)[1:] == (8, 1)
    few, many = spark.range(10).coalesce(1), spark.range(80).repartition(8)
    monkeypatch.setattr(M, "executor_heap", lambda spark: (1800.0, 2, 3))
    assert M.tree_memory(many, 7_200_000, 300, 5) == M.tree_memory(many, 7_200_000, 250, 100) == 150
    assert 150 < M.tree_memory(many, 240_000, 250, 100) < 375 < M.tree_memory(few, 10, 250, 100) <= M.TREE_MEMORY_MB
    monkeypatch.setattr(M, "executor_heap", lambda spark: (64_000.0, 2, 3))
    assert M.tree_memory(many, 7_200_000, 250, 100) == M.TREE_MEMORY_MB


def test_permutation_importance_grows_what_the_heap_holds(spark, monkeypatch):
    plain, seen = M.RandomForestRegressor, []
    monkeypatch.setattr(M, "executor_heap", lambda spark: (600.0, 2, 3))
    monkeypatch.setattr(M, "RandomForestRegressor", lambda **k: (seen.append(k["maxMemoryInMB"]), plain(**k))[1])
    rows = spark.range(2 * M.TASK_ROWS).selectExpr("id AS key", "cast(pmod(xxhash64(id), 100) as double) AS x").selectExpr("*", "5 * x + key % 7 AS y")
    M.permutation_importance(rows, "y", key=["key"], trees=2, repeats=1, max_depth=3).collect()
    assert len(seen) == 1 and seen[0] <= 75


def test_compared_forests_grow_what_the_heap_holds_and_stay_the_same(spark, monkeypatch):
    plain, seen = M._candidates, []

    def forest_only(*args):
        forest = plain(*args)["Random Forest"]
        seen.append(forest.getMaxMemoryInMB())
        return {"Random Forest": forest}

    monkeypatch.setattr(M, "_candidates", forest_only)
    rows = spark.range(2 * M.TASK_ROWS).selectExpr("id AS key", "cast(pmod(xxhash64(id), 100) as double) AS x", "concat('w', id % 5) AS w")
    rows = rows.selectExpr("*", "if(w = 'w1', 5, 2) * x AS y")
    found = []
    for heap in (600.0, 64_000.0):
        monkeypatch.setattr(M, "executor_heap", lambda spark: (heap, 2, 3))
        got = M.train_compare(rows, "y", key=["key"], trees=3, max_depth=4)
        found.append([rows_of(got.comparison), rows_of(M.predict(got, rows.limit(50)).select("key", "prediction"))])
        got.release()
    assert seen[0] <= 75 and seen[1] == M.TREE_MEMORY_MB
    for old, new in zip(*found):
        assert [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in old] == [
            tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in new]
