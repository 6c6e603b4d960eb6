"""Findings and whole analyses (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatica.catalog.quality import TOTALS
from prismatica.catalog.registry import COPIES_SQL, GAPPY_SQL, SALES_SQL, query, r, rounded
from prismatica.catalog.statistics import DIMS, concentration_sql, drivers_sql, fences, trend_sql
from prismatica.functions.columns import numeric_columns
from prismatica.operators import clean as K, findings as N, groups as G, quality as Q, stats as S
from prismatica.plans import analyze as A
from prismatica.plans.settle import columnar, settled


def _short(df):
    """The comparable part of a finding: everything but its wording."""
    return df.select("seq", "category", "title", "severity", "metric", r("value", 2).alias("value"))


@query("f1_quality_findings", TOTALS + """
SELECT 1 AS seq, 'Data Quality' AS category, CASE WHEN m = 0 THEN 'Data completeness is strong' WHEN m < 5 THEN 'Minor missing-data issue'
       ELSE 'Significant missing data detected' END AS title, CASE WHEN m = 0 THEN 'positive' WHEN m < 5 THEN 'warning' ELSE 'critical' END AS severity,
       'Missing Data' AS metric, round(m, 2) AS "value" FROM shares
UNION ALL SELECT 2, 'Data Quality', 'Duplicate records detected', 'warning', 'Duplicates', dups FROM shares WHERE dups > 0""")
def f1(t):
    return _short(N.quality_findings(t("copies")))


BUSINESS = """bz AS (SELECT sum(revenue) AS rv, sum(profit) AS pf, sum(quantity) AS qt, (max(revenue) - min(revenue)) / abs(min(revenue)) * 100 AS sp,
 sum(profit) / sum(revenue) * 100 AS mg FROM {view})"""
BUSINESS_ROWS = """
SELECT 11 AS seq, 'Business Performance' AS category, 'Revenue baseline established' AS title, 'positive' AS severity, 'revenue' AS metric, round(rv, 2) AS "value" FROM bz
UNION ALL SELECT 12, 'Business Performance', 'Revenue variability is high', 'warning', 'revenue', round(sp, 2) FROM bz WHERE sp > 100
UNION ALL SELECT 13, 'Profitability', CASE WHEN pf > 0 THEN 'Positive aggregate profitability' WHEN pf < 0 THEN 'Aggregate loss detected' ELSE 'Profit is approximately neutral' END,
  CASE WHEN pf > 0 THEN 'positive' WHEN pf < 0 THEN 'critical' ELSE 'warning' END, 'profit', round(pf, 2) FROM bz
UNION ALL SELECT 14, 'Profitability', 'Profit margin analyzed', CASE WHEN mg >= 20 THEN 'positive' WHEN mg >= 10 THEN 'info' WHEN mg >= 0 THEN 'warning' ELSE 'critical' END,
  'Profit Margin', round(mg, 2) FROM bz
UNION ALL SELECT 15, 'Operations', 'Volume baseline established', 'info', 'quantity', round(qt, 2) FROM bz"""


@query("f2_business_findings", f"WITH {SALES_SQL}, {BUSINESS.replace('{view}', 'sales')} {BUSINESS_ROWS}")
def f2(t):
    return _short(N.business_findings(t("sales")))


SEGMENT_ROWS = """SELECT 21 + list_position(['region', 'nation', 'segment', 'priority', 'return_flag'], dimension) - 1 AS seq, 'Segmentation' AS category,
dimension || CASE WHEN top_value / total >= 0.5 THEN ' concentration detected' ELSE ' leader identified' END AS title,
CASE WHEN top_value / total >= 0.5 THEN 'warning' ELSE 'info' END AS severity, 'revenue' AS metric, round(top_value / total * 100, 2) AS "value" FROM con"""


@query("f3_segment_findings", f"WITH {SALES_SQL}, {concentration_sql('sales', DIMS)} {SEGMENT_ROWS}")
def f3(t):
    return _short(N.segment_findings(t("sales"), max_dims=5))


TREND_ROWS = """SELECT 31 AS seq, 'Trend Analysis' AS category, CASE WHEN g > 10 THEN 'Positive trend detected' WHEN g < -10 THEN 'Negative trend detected'
ELSE 'Trend is relatively stable' END AS title, CASE WHEN g > 10 THEN 'positive' WHEN g < -10 THEN 'critical' ELSE 'info' END AS severity,
'revenue' AS metric, round(g, 2) + 0.0 AS "value" FROM (SELECT (b - a) / abs(a) * 100 AS g FROM tr)"""


@query("f4_trend_findings", f"WITH {SALES_SQL}, {trend_sql('sales', 'order_date', 'revenue')} {TREND_ROWS}")
def f4(t):
    return _short(N.trend_findings(t("sales")))


@query("f5_findings_rollup", f"""WITH {SALES_SQL}, {BUSINESS.replace('{view}', 'sales')}, {concentration_sql('sales', DIMS)}, {trend_sql('sales', 'order_date', 'revenue')},
q AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM sales)) AS u FROM sales),
al AS (SELECT severity FROM ({BUSINESS_ROWS}) UNION ALL SELECT severity FROM ({SEGMENT_ROWS}) UNION ALL SELECT severity FROM ({TREND_ROWS})
  UNION ALL SELECT 'positive' UNION ALL SELECT 'warning' FROM q WHERE n > u)
SELECT CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'warning'
  WHEN count(*) FILTER (WHERE severity = 'positive') > 0 THEN 'positive' ELSE 'info' END AS overall_status, count(*) AS total_insights,
  count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count,
  count(*) FILTER (WHERE severity = 'positive') AS positive_count, count(*) FILTER (WHERE severity = 'info') AS info_count FROM al""")
def f5(t):
    return A.insight_report(settled(t("sales")), max_dims=5)["rollup"].drop("executive_summary", "recommendations")


@query("f6_dataset_statements", f"""WITH {COPIES_SQL}, c AS (SELECT count(*) AS n, sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT) AS m,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS d FROM copies)
SELECT 0 AS seq, format('The dataset contains {{:,}} records across 6 columns.', n) AS statement FROM c
UNION ALL SELECT 1, format('{{:,}} missing values were detected.', m::BIGINT) FROM c
UNION ALL SELECT 2, format('{{:,}} duplicate records were detected.', d) FROM c""")
def f6(t):
    return N.dataset_statements(t("copies"))


OVERVIEW = TOTALS + f""", {fences('copies', ['o_orderkey', 'o_custkey', 'o_totalprice'])},
tot AS (SELECT sum(CASE WHEN q1 = q3 THEN 0 ELSE hits END)::BIGINT AS outliers, sum(((hits * 100.0 / n) >= 10 AND q3 > q1)::INT) AS high_out FROM o),
ov AS (SELECT s.*, 100 - least(m * 0.7, 50) - least(d * 0.3, 20) AS health, outliers,
  high_out + (SELECT count(*) FROM facts WHERE missing * 100.0 / n_rows >= 30) AS high_risks FROM shares s, tot)
"""


def _overview(t):
    c = t("copies")
    fences_ = S.outliers(c)
    return N.overview(c, "o_totalprice", Q.health_score_b(c), Q.risk_register(c, limit=None, bounds=fences_), fences_,
                      S.top_correlations(c), Q.ml_readiness(c, "o_totalprice"))


@query("f7_executive_summary", OVERVIEW + """SELECT high_risks::BIGINT AS high_priority_risks, 'o_totalprice' AS target, round(health, 4) AS health_score,
CASE WHEN 100 - least((SELECT avg(missing * 100.0::DOUBLE / n_rows) FROM facts), 40) - least(d * 0.5, 15) >= 80 THEN 'Ready' ELSE 'Mostly Ready' END AS ml_readiness FROM ov""")
def f7(t):
    return rounded(N.executive_summary(_overview(t)).drop("summary"))


@query("f8_recommendations", OVERVIEW + """SELECT 1 AS seq, 'High' AS priority, 'Data Quality' AS category FROM ov WHERE m > 10
UNION ALL SELECT 2, 'Medium', 'Data Quality' FROM ov WHERE d > 2 UNION ALL SELECT 3, 'Medium', 'Anomaly Detection' FROM ov WHERE outliers > 0
UNION ALL SELECT 7, 'Low', 'Optimization' FROM ov WHERE m <= 10 AND d <= 2 AND outliers = 0""")
def f8(t):
    return N.recommendations(_overview(t)).drop("action")


def _package(sections):
    from prismatica.sources.sinks import report_rows
    return report_rows(sections).groupBy("section").agg(F.count(F.lit(1)).alias("n_rows"))


@query("f9_analyze")
def f9(t):
    """The whole package over the sales view, as (section, payload) rows. The
    view is a join that every section reads, so it is settled first."""
    from prismatica.sources.sinks import report_rows
    return report_rows(A.analyze(columnar(t("sales")), "revenue", order_by=["order_date", "order_key"]).sections)


SALES_NUMBERS = ["order_key", "quantity", "revenue", "cost", "profit"]


@query("f9_analyze_sections", f"""WITH {SALES_SQL}, {fences('sales', SALES_NUMBERS)},
dups AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales)) AS d FROM sales),
segs AS (SELECT {" + ".join(f"count(DISTINCT {c})" for c in ["region", "nation", "segment", "priority", "return_flag", "order_date"])} AS k FROM sales),
texts AS (SELECT unnest([{", ".join(f"count(DISTINCT {c})" for c in ["region", "nation", "segment", "priority", "return_flag", "order_date"])}]) AS k, count(*) AS n_all FROM sales),
counts AS (SELECT unnest(['metadata', 'health', 'quality', 'ml_readiness', 'executive_summary', 'recommendations', 'datetime_columns']) AS name, 1 AS n_rows
UNION ALL SELECT unnest(['schema', 'columns']), 11
UNION ALL SELECT unnest(['outliers', 'distributions', 'kpis']), (SELECT count(*) FROM o)
UNION ALL SELECT 'correlations', least(10, (SELECT count(*) * (count(*) - 1) // 2 FROM o))
UNION ALL SELECT 'risks', (SELECT count(*) FROM o WHERE hits * 100.0::DOUBLE / n >= 5) + (SELECT (d > 0)::INT FROM dups) + (SELECT count(*) FROM texts WHERE k > 0.9 * n_all)
UNION ALL SELECT 'drivers', least(10, (SELECT k FROM segs)) UNION ALL SELECT 'target_analysis', 7)
SELECT name AS section, 'ok' AS status, n_rows::BIGINT AS n_rows FROM counts""")
def f9_sections(t):
    """Every section of the guarded analysis: whether it is whole, and its length."""
    status = A.analyze_computed(columnar(t("sales")), "revenue", order_by=["order_date", "order_key"])["status"]
    return status.select(F.col("name").alias("section"), "status", F.col("rows").alias("n_rows"))


@query("f9_analyze_drivers", f"WITH {SALES_SQL}, {drivers_sql('sales', ['region', 'nation', 'segment', 'priority', 'return_flag', 'order_date'], 10)}")
def f9_drivers(t):
    d = A.analyze(columnar(t("sales")), order_by=["order_date", "order_key"])["drivers"]
    return rounded(d.withColumnRenamed("count", "n"), 6, sum=2, mean=4, share_of_total=8)


@query("f10_analyze_simple", TOTALS + """SELECT 'profile' AS section, k AS n_rows FROM shares UNION ALL SELECT 'dataset', 1
UNION ALL SELECT 'issues', gaps + (dups > 0)::INT FROM shares UNION ALL SELECT 'cleaned', n - dups FROM shares UNION ALL SELECT 'kpis', 3
UNION ALL SELECT 'statements', 2 + (dups > 0)::INT FROM shares""")
def f10(t):
    return _package(A.analyze_simple(t("copies")).sections)


@query("f11_headline_ratios", f"""WITH {SALES_SQL}, {fences('sales', ['order_key', 'quantity', 'revenue', 'cost', 'profit'])}
SELECT (SELECT round(sum(profit) / sum(revenue) * 100, 4) FROM sales) AS net_margin_pct,
round(sum(CASE WHEN q1 = q3 THEN 0 ELSE hits END) * 100.0::DOUBLE / (SELECT count(*) FROM sales), 4) AS outlier_pct FROM o""")
def f11(t):
    """Only numbers are asked for. The view is a join that several passes read, so they are settled first."""
    s = t("sales")
    s = settled(s.select(*numeric_columns(s)))
    return rounded(G.headline_ratios(s, S.outlier_total(S.outliers(s)), "revenue", "profit"))
