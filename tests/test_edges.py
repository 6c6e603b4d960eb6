"""ANSI and missing-value edges, sources and sinks."""

import math
import os

import pytest
from pyspark.sql import functions as F

from prismatica.functions import coerce as C, columns as N
from prismatica.operators import clean as K, groups as G, profile as P, quality as Q, stats as S
from prismatica.sources import readers, runlog, sinks


def test_nan_and_infinity_count_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    row = P.profile(df).first()
    assert row["missing"] == 3 and row["unique_values"] == 2
    assert S.numeric_summary(df).first()["count"] == 2


def test_constant_column(spark):
    df = spark.range(10).selectExpr("cast(id as double) AS x", "1.0D AS c")
    assert S.correlation_pairs(df).first()["correlation"] is None
    assert S.top_correlations(df).count() == 0
    flat = {r["column"]: r for r in S.distributions(df).collect()}["c"]
    assert flat["skewness"] == 0 and flat["kurtosis"] == 0
    assert [r["column"] for r in Q.constant_columns(df).collect()] == ["c"]


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k long, x double")
    assert {r["column"]: r["role"] for r in P.infer_roles(df).collect()}["x"] == "empty"
    assert [r["x"] for r in K.impute_median(df).collect()] == [None, None]
    assert S.distributions(df).filter("column = 'x'").count() == 0
    text = spark.createDataFrame([(1, None)], "k long, s string")
    assert K.impute_mode(text).first()["s"] == "Unknown"


def test_zero_rows_with_a_schema(spark):
    df = spark.createDataFrame([], "Sales double, Region string")
    assert P.dataset_profile(df).first()["rows"] == 0
    assert Q.health_score_b(df).first()["status"] == "Critical"
    assert S.outliers(df).first()["count"] == 0
    with pytest.raises(readers.LoadError):
        readers.assert_loadable(df)
    assert Q.safe_validate(df).first()["error"] == "EMPTY"


def test_one_row(spark):
    df = spark.createDataFrame([(5.0, "a")], "Sales double, Region string")
    assert S.numeric_summary(df).first()["std"] is None
    assert G.growth_proxy(df, "Sales", ["Sales"]).first()["growth_proxy_pct"] == 0


def test_names_are_checked(spark):
    with pytest.raises(Q.InvalidData):
        Q.check_names(spark.createDataFrame([(1, 2)], "Sales int, sales int"))
    with pytest.raises(Q.InvalidData):
        Q.validate_target(spark.createDataFrame([(1, "a")], "k int, s string"), "s", require_numeric=True)
    odd = spark.createDataFrame([(1.0, 2.0)], ["a.b", "c`d"])
    assert S.numeric_summary(odd).count() == 2


def test_dates(spark):
    texts = ["2024-01-05", "05/01/2024", "Jan 5 2024", "2024-01-05 10:11:12", "n/a", "", None, "12", "99/99/2024"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(F.date_format(C.to_time(F.col("s")), "yyyy-MM-dd")).collect()]
    assert got == ["2024-01-05", "2024-05-01", "2024-01-05", "2024-01-05", None, None, None, None, None]


def test_finders(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["net_profit", "profit", "sales_amount"])
    assert N.find_column(df, ["sales", "profit"]) == "net_profit"
    assert N.find_column(df, ["profit"], "exact_first") == "profit"
    assert N.find_column(df, ["sales", "profit"], "word_order") == "sales_amount"
    assert N.resolve_target(df, "PROFIT") == "profit" and N.resolve_target(df) == "profit"


def test_csv_round_trip_and_encodings(spark, tmp_path):
    plain, latin, empty = (str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv"))
    open(plain, "wb").write("﻿ Sales ,Region\n1,Süd\n".encode("utf-8"))
    open(latin, "wb").write("Sales,Region\n1,Süd\n".encode("latin-1"))
    open(empty, "w").write("Sales,Region\n")
    for path in (plain, latin):
        df = readers.load(spark, path)
        assert df.columns == ["Sales", "Region"] and df.first()["Region"] == "Süd"
    with pytest.raises(readers.LoadError):
        readers.load(spark, empty)
    with pytest.raises(readers.LoadError):
        readers.load(spark, str(tmp_path / "a.xyz"))


def test_json_array_and_parquet(spark, tmp_path):
    path = str(tmp_path / "a.json")
    open(path, "w").write('[{"a": 1}, {"a": 2}]')
    assert readers.load(spark, path).count() == 2
    sinks.write_table(readers.load(spark, path), str(tmp_path / "t.parquet"))
    assert readers.load(spark, str(tmp_path / "t.parquet")).count() == 2


def test_report_has_nulls_for_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "x double, k long")
    assert sinks.report_rows({"s": df}).first()["payload"] == '{"x":null,"k":1}'


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert runlog.recent_events(spark, path).count() == 0
    for i in range(3):
        runlog.append_event(spark, path, f"step{i}", details={"rows": i})
    os.makedirs(path, exist_ok=True)
    open(os.path.join(path, "broken.json"), "w").write("not json\n\n")
    got = runlog.recent_events(spark, path, 2).collect()
    assert [r["event"] for r in got] == ["step2", "step1"] and got[0]["details"]["rows"] == "2"


def test_clean(spark):
    df = spark.createDataFrame([(1, 1.0, "a", "2024-01-05"), (1, 1.0, "a", "2024-01-05"), (2, None, None, "n/a"),
                                (3, 3.0, "a", "01/07/2024"), (4, 5.0, "b", "2024-01-09")], "id long, x double, g string, order_date string")
    rows = {r["id"]: r for r in K.clean(df.toDF(" id", "x", "g ", "order_date")).collect()}
    assert len(rows) == 4 and rows[2]["x"] == 3.0 and rows[2]["g"] == "a"
    assert rows[2]["order_date"].isoformat().startswith("2024-01-05")


def test_impute_keeps_types(spark):
    df = spark.sql("SELECT * FROM VALUES (true, date'2024-01-01'), (true, date'2024-01-01'), (null, null) AS t(b, d)")
    last = K.impute_mode(df).collect()
    assert all(r["b"] is True for r in last) and {str(r["d"]) for r in last} == {"2024-01-01"}


def test_histogram_keeps_empty_bins_and_top_edge(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,)], "x double")
    got = S.histogram(df, "x", 10).orderBy("bin").collect()
    assert [r["frequency"] for r in got] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1]


def test_robust_of_nothing(spark):
    from prismatica.operators.anomaly import robust_z
    row = robust_z(spark.createDataFrame([(None,)], "v double"), "v").first()
    assert row["robust_z"] is None and row["robust_anomaly"] is False


def test_expression_guards(spark):
    row = spark.range(1).select(
        C.pct_change(F.lit(2.0), F.lit(0.0)).alias("p"), C.safe_float(F.lit("x"), 7.0).alias("s"),
        C.clip(F.lit(None).cast("double"), 0, 1).alias("c"), C.shown(F.lit(-0.001), 2).alias("z")).first()
    assert row["p"] is None and row["s"] == 7.0 and row["c"] is None and math.copysign(1, row["z"]) == 1
