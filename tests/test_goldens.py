"""Hand-computed values on the five-row table."""

import pytest
from pyspark.sql import functions as F

from prismatica.operators import findings as N, groups as G, quality as Q, scenario as D, stats as S
from prismatica.operators.profile import BaseProfile, infer_roles, profile
from prismatica.plans import analyze as analyses
from prismatica.plans.analyze import analyze, analyze_computed, analyze_simple, insight_report, unreadable_columns
from conftest import rows_of


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_totals_and_margin(sales):
    assert by(G.numeric_totals(sales), "column", "total") == {"Sales": 1630, "Profit": 425, "Quantity": 33}
    kpis = by(G.business_kpis(sales), "kpi", "value")
    assert kpis["PROFIT_MARGIN"] == pytest.approx(425 / 1630 * 100)


def test_quartiles_and_outliers(sales):
    row = {r["column"]: r for r in S.numeric_summary(sales).collect()}["Sales"]
    assert (row["q25"], row["q50"], row["q75"]) == (150, 180, 200)
    out = {r["column"]: r for r in S.outliers(sales).collect()}["Sales"]
    assert (out["lower_bound"], out["upper_bound"], out["count"], out["percentage"]) == (75, 275, 1, 20)
    assert [r["Sales"] for r in S.outlier_rows(sales, "Sales").collect()] == [1000]


def test_segments(sales):
    assert by(G.metric_by_dimension(sales, "Region", "Sales"), "segment", "total") == {"East": 1000, "North": 380, "South": 250}
    lead = G.segment_concentration(sales, "Sales").first()
    assert lead["top_segment"] == "East" and lead["finding"] == "concentration"
    assert lead["share_pct"] == pytest.approx(1000 / 1630 * 100)
    east = G.segment_drivers(sales, "Sales").first()
    assert east["segment"] == "East" and east["share_of_total"] == pytest.approx(0.613497, abs=1e-6)
    assert east["vs_overall_pct"] == pytest.approx(206.748, abs=1e-3)
    assert east["impact_score"] == pytest.approx(126.84, abs=1e-2)
    assert G.best_segment(sales).first()["segment"] == "East" and G.worst_segment(sales).first()["segment"] == "South"


def test_driver_segment_that_is_missing(sales):
    gap = sales.withColumn("Region", F.when(F.col("Region") != "East", F.col("Region")))
    assert G.segment_drivers(gap, "Sales").first()["segment"] == "<missing>"


def test_growth_and_spread(five):
    assert G.growth_proxy(five, "Sales", ["row_no"]).first()["growth_proxy_pct"] == pytest.approx(80)
    spread = G.range_spread(five, "Sales").first()
    assert spread["spread_pct"] == 900 and spread["variable"]


def test_scores(sales):
    assert Q.quality_report(sales).first()["score"] == 95
    assert Q.health_score_b(sales).first()["score"] == 100
    ready = Q.ml_readiness(sales, "Sales").first()
    assert (ready["score"], ready["status"]) == (80, "Ready")


def test_scenario(spark):
    base = spark.createDataFrame([(1630.0, 425.0)], "revenue double, profit double")
    row = D.project_a(D.with_scenarios(base, [D.Scenario("x", price=5, marketing=10)])).first()
    assert row["revenue"] == pytest.approx(1727.97, abs=0.01) and row["profit"] == pytest.approx(511.38, abs=0.01)
    assert row["revenue_change_pct"] == pytest.approx(6.01, abs=0.01)
    assert row["profit_change_pct"] == pytest.approx(20.32, abs=0.01)


def test_zero_revenue_is_an_error_row(spark):
    base = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 2.0)], "segment string, revenue double, profit double")
    bad = [r for r in D.rank_a(base).collect() if r["segment"] == "a"]
    assert {r["decision"] for r in bad} == {"ERROR"} and {r["decision_score"] for r in bad} == {-999999.0}
    assert by(D.break_even_price(base), "segment", "break_even_price_change_pct")["a"] == 0


def test_break_even_of_a_loss(spark):
    base = spark.createDataFrame([(100.0, -20.0)], "revenue double, profit double")
    assert D.break_even_price(base).first()[0] == -50.0


def test_findings(sales):
    report = insight_report(sales)
    rows = {r["title"]: r for r in report["findings"].collect()}
    assert rows["Region concentration detected"]["severity"] == "warning"
    assert rows["Revenue variability is high"]["value"] == 900
    assert rows["Profit margin analyzed"]["severity"] == "positive"
    top = report["rollup"].first()
    assert top["overall_status"] == "warning" and top["total_insights"] == len(rows)
    report.release()


def test_analyze_runs_every_section(five):
    a = analyze(five, "Sales", order_by=["row_no"])
    assert a.target == "Sales"
    for name, df in a.sections.items():
        assert df.count() >= (0 if name in ("datetime_columns", "risks") else 1), name
    assert by(a["kpis"], "column", "growth_proxy_pct")["Sales"] == pytest.approx(80)
    a.release()


def poisoned(df):
    """``df`` and a column whose values cannot be computed on one row."""
    return df.withColumn("Extra", F.when(F.col("Region") == "East", F.raise_error(F.lit("bad cell"))).otherwise(F.col("Profit")).cast("double"))


def test_a_column_that_fails_leaves_the_sections_whole(five):
    assert unreadable_columns(five) == {}
    bad = poisoned(five)
    assert list(unreadable_columns(bad)) == ["Extra"]
    at_once = lambda sections: {n: rows_of(d.drop("generated_at", "analysis_timestamp")) for n, d in sections.items() if n != "status"}
    want = at_once(analyze(five, "Sales", order_by=["row_no"]).sections)
    a = analyze_computed(bad, "Sales", order_by=["row_no"])
    assert at_once(a.sections) == want
    status = {(r["part"], r["name"]): r for r in a["status"].collect()}
    assert len(status) == len(want) + 1 and "bad cell" in status["column", "Extra"]["error"]
    assert all(r["status"] == "ok" and r["rows"] == len(want[name]) for (part, name), r in status.items() if part == "section")
    a.release()


def test_a_target_that_fails_costs_its_sections_only(five):
    a = analyze_computed(poisoned(five), "Extra", order_by=["row_no"])
    status = {r["name"]: r["status"] for r in a["status"].collect()}
    assert {n for n, s in status.items() if s != "ok"} == {"drivers", "target_analysis", "Extra"}
    a.release()


def test_a_section_that_fails_while_it_runs_costs_itself_only(five, monkeypatch):
    def drivers(df, *args, **kwargs):
        return df.select(F.raise_error(F.lit("late failure")).alias("segment"))

    def distributions(*args, **kwargs):
        raise ValueError("early failure")
    monkeypatch.setattr(analyses.groups, "segment_drivers", drivers)
    monkeypatch.setattr(analyses.stats, "distribution_shape", distributions)
    a = analyze_computed(five, "Sales", order_by=["row_no"])
    errors = {r["name"]: r["error"] for r in a["status"].collect() if r["status"] != "ok"}
    assert set(errors) == {"drivers", "distributions"} and "late failure" in errors["drivers"] and "early failure" in errors["distributions"]
    assert a["drivers"].first()["status"] == "unavailable" and a["kpis"].count() > 0
    a.release()


def test_analyze_simple(sales):
    a = analyze_simple(sales)
    texts = [r["statement"] for r in a["statements"].orderBy("seq").collect()]
    assert texts[0] == "The dataset contains 5 records across 4 columns." and "1,630.00" in texts[2]
    assert a["cleaned"].count() == 5
    a.release()


def test_profile_and_roles(sales):
    got = {r["column"]: r for r in profile(sales).collect()}
    assert got["Region"]["unique_values"] == 3 and got["Region"]["semantic_type"] == "categorical"
    assert by(infer_roles(sales), "column", "role") == {
        "Sales": "numeric", "Profit": "numeric", "Quantity": "numeric", "Region": "categorical"}


def test_shared_profile_gives_the_same(sales):
    shared = BaseProfile.of(sales, persist=True)
    assert Q.quality_report(sales, shared).collect() == Q.quality_report(sales).collect()
    shared.release()


def test_trend_halves(spark):
    days = spark.range(10).selectExpr("date_add(date'2024-01-01', cast(id as int)) AS order_date",
                                      "CASE WHEN id < 5 THEN 10.0D ELSE 20.0D END AS revenue")
    from prismatica.operators.trend import half_over_half_trend
    row = half_over_half_trend(days, "order_date", "revenue").first()
    assert row["change_pct"] == 100 and row["severity"] == "positive"
    finding = N.trend_findings(days).first()
    assert finding["title"] == "Positive trend detected"
