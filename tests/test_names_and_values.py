"""Odd names, quotes, nulls and types come through the operators unchanged."""


from prismatica.operators import clean, findings, forecast, groups, quality, scenario
from prismatica.operators.profile import schema_report
from prismatica.sources import readers, sinks
from tests.conftest import rows_of


def test_percent_sign_in_names(spark):
    df = spark.createDataFrame([(i, 100.0 + i, 10.0, f"r{i % 3}", f"2024-01-{i + 1:02d}") for i in range(20)],
                               "id int, `Sales %` double, `Profit %` double, Region string, `Order Date` string")
    out = findings.all_findings(df).collect()
    assert any("Sales %" in r["message"] for r in out)


def test_six_dimensions_give_six_findings(spark):
    df = spark.createDataFrame([(1.0 + i, *["ab"[i % 2]] * 6) for i in range(8)],
                               "sales double, " + ", ".join(f"d{k} string" for k in range(6)))
    assert findings.segment_findings(df).count() == 6
    assert groups.segment_concentration(df, "sales", max_dims=2).count() == 2


def test_decision_report_keeps_null_and_repeated_segments(spark):
    df = spark.createDataFrame([("x", 100.0, 20.0), (None, 50.0, 5.0), ("y", 10.0, 1.0), ("y", 900.0, 90.0)],
                               "segment string, revenue double, profit double")
    out = scenario.decision_report(df).collect()
    assert sorted((r["segment"] or "", r["scenario_count"]) for r in out) == [("", 9), ("x", 9), ("y", 9), ("y", 9)]
    even = rows_of(scenario.break_even_price(df).select("break_even_price_change_pct"))
    assert sorted((r["break_even_price_change_pct"],) for r in out) == sorted(even)


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'He said "hi, you" ok'), (2, "two\nlines"), (3, "back\\slash")], "id int, note string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "t.csv"))
    assert rows_of(readers.read_csv(spark, str(tmp_path / "t.csv"), df.schema, multi_line=True)) == rows_of(df)


def test_json_lines_or_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": 2}\n')
    for name in ("a", "b"):
        assert readers.load(spark, str(tmp_path / f"{name}.json")).count() == 2
    assert readers.load(spark, str(tmp_path / "b.json"), lines=True).count() == 2


def test_cleaning_keeps_types_and_values(spark):
    df = spark.createDataFrame([([1.0], float("inf")), ([1.0], float("inf")), ([2.0], 1.0), (None, 1.0)], "a array<double>, x double")
    out = clean.drop_duplicates(df)
    assert out.dtypes == df.dtypes and out.filter("x = double('Infinity')").count() == 1 and out.count() == 3
    kept = clean.drop_missing(df, subset=["a"])
    assert kept.dtypes == df.dtypes and kept.count() == 3


def test_padded_dates_are_dates(spark):
    df = spark.createDataFrame([(" " * 35 + f"2024-01-{i + 1:02d}",) for i in range(20)], "when_text string")
    roles = {r["column"]: r for r in schema_report(df).collect()}
    assert "date" in str(roles["when_text"]).lower()


def test_forecast_steps_by_the_grain(spark):
    df = spark.sql("select add_months(date'2010-01-01', cast(id as int)) d, 10.0 + id % 12 y from range(60)")
    out = forecast.forecast_backtest(df, "d", "y", periods=2, grain="month", trees=5, max_depth=4).forecast
    assert [str(r["date"])[:10] for r in out.orderBy("date").collect()] == ["2015-01-01", "2015-02-01"]


def test_risk_counts_use_the_whole_register(spark):
    df = spark.createDataFrame([(*[None] * 60, 1.0)], ", ".join([*(f"c{i} string" for i in range(60)), "y double"]))
    assert quality.risk_register(df).count() == 50
    assert quality.risk_register(df, limit=None).count() >= 60
