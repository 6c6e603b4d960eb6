"""Statistics and groupings (T*, A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatica.catalog.registry import BASELINE_SQL, COPIES_SQL, GAPPY_SQL, SALES_SQL, query, r, rounded
from prismatica.operators import groups as G, stats as S, trend as R
from prismatica.operators.scenario import Scenario, compare_current_projected

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def per_column(view: str, columns: list[str], body: str) -> str:
    """``body`` once per column, with {c} for the column name."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + body.replace("{c}", c) + f" FROM {view}" for c in columns)


SUMMARY = ("count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS low, "
           "round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, "
           "round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4)::DOUBLE AS high")


def _summary(df):
    return rounded(df.select("column", F.col("count").alias("n"), "mean", "std", F.col("min").alias("low"),
                             "q25", "q50", "q75", F.col("max").alias("high")))


@query("t1_numeric_summary", per_column("lineitem", LINE, SUMMARY))
def t1(t):
    return _summary(S.numeric_summary(t("lineitem"), LINE))


@query("t2_describe_all", per_column("customer", ["c_custkey", "c_nationkey", "c_acctbal"], SUMMARY + ", NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq") + """
UNION ALL (SELECT 'c_name', (SELECT count(*) FROM customer), NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT count(DISTINCT c_name) FROM customer), c_name, count(*) FROM customer GROUP BY c_name ORDER BY count(*) DESC, c_name LIMIT 1)
UNION ALL (SELECT 'c_mktsegment', (SELECT count(*) FROM customer), NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT count(DISTINCT c_mktsegment) FROM customer), c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)""")
def t2(t):
    return rounded(S.describe_all(t("customer")).select(
        "column", F.col("count").alias("n"), "mean", "std", F.col("min").alias("low"), "q25", "q50", "q75",
        F.col("max").alias("high"), "unique", "top", "freq"))


SHAPE = ("count({c}) AS n, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, "
         "round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr, round(skewness({c}), 4) + 0.0 AS skewness, "
         "round(kurtosis({c}), 4) + 0.0 AS kurtosis, count(*) FILTER (WHERE {c} = 0) AS zeros, "
         "count(*) FILTER (WHERE {c} < 0) AS negative_values, count(*) FILTER (WHERE {c} > 0) AS positive_values")


@query("t3_distributions", per_column("customer", ["c_custkey", "c_nationkey", "c_acctbal"], SHAPE))
def t3(t):
    return rounded(S.distributions(t("customer")).select(
        "column", F.col("count").alias("n"), "mean", "median", "std", "iqr", "skewness", "kurtosis", "zeros",
        "negative_values", "positive_values"))


@query("t4_distribution_shape", f"""WITH {SALES_SQL}, k AS ({per_column('sales', ['quantity', 'revenue', 'cost', 'profit'], 'avg({c}) AS mean, skewness({c}) AS s')})
SELECT "column", round(mean, 4) AS mean, round(s, 4) + 0.0 AS skewness, CASE WHEN s > 1 THEN 'Highly Right-Skewed' WHEN s > 0.5 THEN 'Right-Skewed'
WHEN s < -1 THEN 'Highly Left-Skewed' WHEN s < -0.5 THEN 'Left-Skewed' ELSE 'Approximately Symmetric' END AS distribution FROM k""")
def t4(t):
    return rounded(S.distribution_shape(t("sales"), ["quantity", "revenue", "cost", "profit"]).select(
        "column", "mean", "skewness", "distribution"))


@query("t5_coefficient_of_variation", per_column("lineitem", LINE, "round(stddev_samp({c}) / avg({c}), 6) AS cv"))
def t5(t):
    return S.coefficient_of_variation(t("lineitem"), LINE).select("column", r("coefficient_of_variation", 6).alias("cv"))


def _top(c: str) -> str:
    return (f"(SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM documents) AS \"unique\", {c} AS top, count(*) AS top_count, "
            f"round(count(*) * 100.0::DOUBLE / (SELECT count({c}) FROM documents), 4) AS top_percentage FROM documents WHERE {c} IS NOT NULL "
            f"GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


@query("t6_categorical_summary", " UNION ALL ".join(_top(c) for c in ("text", "lang", "source")))
def t6(t):
    return rounded(S.categorical_summary(t("documents")).drop("col_no", "count"))


@query("t7_target_stats", f"""WITH {GAPPY_SQL} SELECT 'revenue' AS target, count(revenue) AS n, round(avg(revenue), 4) AS mean, round(median(revenue), 4) AS median,
round(stddev_samp(revenue), 4) AS std, round(sum(revenue), 2) AS total, round(max(revenue) - min(revenue), 4) AS spread,
round(stddev_samp(revenue) / (abs(avg(revenue)) + 1e-9), 6) AS cv, count(*) - count(revenue) AS missing,
round((count(*) - count(revenue)) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM gappy""")
def t7(t):
    s = S.target_stats(t("gappy"), "revenue")
    return s.select("target", F.col("count").alias("n"), r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"),
                    r("sum", 2).alias("total"), r("range").alias("spread"), r("coefficient_of_variation", 6).alias("cv"), "missing",
                    r("missing_percentage", 2).alias("missing_pct"))


@query("t8_target_analysis", f"""WITH {COPIES_SQL}
SELECT 'missing' AS statistic, NULL AS label, (count(*) - count(o_orderpriority))::DOUBLE AS "value" FROM copies
UNION ALL SELECT 'unique', NULL, count(DISTINCT o_orderpriority) FROM copies
UNION ALL SELECT * FROM (SELECT 'top_value', o_orderpriority, count(*) FROM copies WHERE o_orderpriority IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def t8(t):
    return S.target_analysis(t("copies"), "o_orderpriority")


@query("t8_target_analysis_numeric", """SELECT 'missing' AS statistic, (count(*) - count(value))::DOUBLE AS "value" FROM events
UNION ALL SELECT 'unique', count(DISTINCT value) FROM events UNION ALL SELECT 'mean', round(avg(value), 4) FROM events
UNION ALL SELECT 'median', round(median(value), 4) FROM events UNION ALL SELECT 'min', round(min(value), 4) FROM events
UNION ALL SELECT 'max', round(max(value), 4) FROM events UNION ALL SELECT 'std', round(stddev_samp(value), 4) FROM events""")
def t8n(t):
    return rounded(S.target_analysis(t("events"), "value").drop("label"))


FENCES = """b AS ({bounds}), v AS ({values}),
o AS (SELECT "column", count(*) AS n, sum((x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::INT)::BIGINT AS hits,
      any_value(q1) AS q1, any_value(q3) AS q3 FROM v JOIN b USING ("column") WHERE x IS NOT NULL GROUP BY "column")"""


def fences(view: str, columns: list[str]) -> str:
    return FENCES.replace("{bounds}", per_column(view, columns, "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3")).replace(
        "{values}", per_column(view, columns, "{c}::DOUBLE AS x"))


@query("t9_iqr_outliers", f"""WITH flat AS (SELECT value, CASE WHEN event_id % 10 = 0 THEN value ELSE 1.0::DOUBLE END AS mostly_one FROM events),
{fences('flat', ['value', 'mostly_one'])}
SELECT "column", hits AS outlier_count, round(hits * 100.0::DOUBLE / n, 4) AS outlier_percentage, round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound,
round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound FROM o""")
def t9(t):
    flat = t("events").select("value", F.when(F.col("event_id") % 10 == 0, F.col("value")).otherwise(1.0).alias("mostly_one"))
    return rounded(S.iqr_outliers(flat).drop("col_no"))


@query("t10_outliers", f"""WITH flat AS (SELECT value, CASE WHEN event_id % 10 = 0 THEN value ELSE 1.0::DOUBLE END AS mostly_one FROM events),
{fences('flat', ['value', 'mostly_one'])}
SELECT "column", CASE WHEN q1 = q3 THEN 0 ELSE hits END AS n, round(CASE WHEN q1 = q3 THEN 0 ELSE hits END * 100.0::DOUBLE / n, 4) AS percentage,
round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound FROM o""")
def t10(t):
    flat = t("events").select("value", F.when(F.col("event_id") % 10 == 0, F.col("value")).otherwise(1.0).alias("mostly_one"))
    return rounded(S.outliers(flat).drop("col_no").withColumnRenamed("count", "n"))


@query("t11_outlier_rows", """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(value, 4) AS "value" FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def t11(t):
    return rounded(S.outlier_rows(t("events"), "value").select("event_id", "value"))


@query("t12_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join(f"round(corr({a}, {b}), 6) + 0.0 AS {b}" for b in LINE) + " FROM lineitem" for a in LINE))
def t12(t):
    return rounded(S.correlation_matrix(t("lineitem"), LINE), 6)


NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE]


@query("t13_top_correlations", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) + 0.0 AS correlation, round(abs(corr({a}, {b})), 4) AS abs_correlation FROM lineitem"
    for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]) + ") ORDER BY abs_correlation DESC, feature_a, feature_b LIMIT 30")
def t13(t):
    return S.top_correlations(t("lineitem"))


@query("t14_histogram", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT least(floor((value - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT g.bin::INT AS bin, round(lo + (hi - lo) / 30 * g.bin, 6) AS lower, coalesce(n, 0) AS frequency
FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN e LEFT JOIN c ON c.bin = g.bin""")
def t14(t):
    return S.histogram(t("events"), "value").select("bin", r("lower", 6).alias("lower"), "frequency")


@query("t15_high_variability_features", "SELECT * FROM (" + per_column("lineitem", NUMERIC, "round(stddev_samp({c}), 4) AS std") + ") ORDER BY std DESC LIMIT 5")
def t15(t):
    return rounded(S.high_variability_features(t("lineitem")).drop("col_no"))


@query("t16_feature_metric_summary", """SELECT 'l_extendedprice' AS "column", round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median,
round(stddev_samp(l_extendedprice), 4) AS std, count(DISTINCT l_extendedprice) AS "unique" FROM lineitem""")
def t16(t):
    return rounded(S.feature_metric_summary(t("lineitem"), "l_extendedprice"))


# --- groupings -------------------------------------------------------------------------------

@query("a1_group_analysis", f"""WITH {GAPPY_SQL} SELECT priority AS segment, round(sum(revenue), 2) AS "sum", round(avg(revenue), 4) AS mean, count(revenue) AS n
FROM gappy WHERE priority IS NOT NULL GROUP BY priority""")
def a1(t):
    return rounded(G.group_analysis(t("gappy"), "priority", "revenue").withColumnRenamed("count", "n"), 4, sum=2)


@query("a2_top_entities", f"""WITH {SALES_SQL} SELECT nation AS segment, round(sum(revenue), 2) AS "sum", round(avg(revenue), 4) AS mean, count(revenue) AS n
FROM sales GROUP BY nation ORDER BY sum(revenue) DESC LIMIT 10""")
def a2(t):
    return rounded(G.top_entities(t("sales"), "nation", "revenue").withColumnRenamed("count", "n"), 4, sum=2)


@query("a3_metric_by_dimension", f"WITH {GAPPY_SQL} SELECT priority AS segment, round(sum(revenue), 2) AS total FROM gappy GROUP BY priority")
def a3(t):
    return rounded(G.metric_by_dimension(t("gappy"), "priority", "revenue", keep_null=True), 2)


@query("a4_time_rollup", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a4(t):
    return G.time_rollup(t("orders"), "o_orderdate", "o_totalprice").select(
        F.date_format("period", "yyyy-MM-dd").alias("period"), r("total", 2).alias("total"))


@query("a4_time_rollup_month", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def a4_month(t):
    return G.time_rollup(t("orders"), "o_orderdate", "o_totalprice", "month").select(
        F.date_format("period", "yyyy-MM").alias("period"), r("total", 2).alias("total"))


@query("a5_kpi_table_a", f"WITH {SALES_SQL} " + per_column("sales", ["order_key", "quantity", "revenue", "cost", "profit"],
       "round(sum({c}), 2)::DOUBLE AS total, round(avg({c}), 4) AS average, round(median({c}), 4) AS median, round(min({c}), 4)::DOUBLE AS minimum, round(max({c}), 4)::DOUBLE AS maximum"))
def a5(t):
    return rounded(G.kpi_table_a(t("sales")).drop("col_no"), 4, total=2)


@query("a6_business_kpis", f"""WITH {SALES_SQL} SELECT 'TOTAL_REVENUE' AS kpi, round(sum(revenue), 2) AS "value" FROM sales
UNION ALL SELECT 'TOTAL_PROFIT', round(sum(profit), 2) FROM sales UNION ALL SELECT 'PROFIT_MARGIN', round(sum(profit) / sum(revenue) * 100, 2) FROM sales""")
def a6(t):
    return rounded(G.business_kpis(t("sales")), 2)


@query("a7_kpi_table_b", per_column("orders", ["o_orderkey", "o_custkey", "o_totalprice"],
       "round(sum({c}), 2)::DOUBLE AS total, round(avg({c}), 2) AS average, round(median({c}), 2) AS median, round(min({c}), 2)::DOUBLE AS low, "
       "round(max({c}), 2)::DOUBLE AS high, round(CASE WHEN arg_min({c}, (o_orderdate, o_orderkey)) = 0 THEN 0 ELSE "
       "(arg_max({c}, (o_orderdate, o_orderkey)) / arg_min({c}, (o_orderdate, o_orderkey)) - 1) * 100 END, 2)::DOUBLE AS growth"))
def a7(t):
    k = G.kpi_table_b(t("orders"), ["o_orderdate", "o_orderkey"])
    return rounded(k.select("column", F.col("sum").alias("total"), "average", "median", F.col("min").alias("low"),
                            F.col("max").alias("high"), F.col("growth_proxy_pct").alias("growth")), 2)


@query("a8_growth_proxy", """SELECT 'o_totalprice' AS "column", round(arg_min(o_totalprice, (o_orderdate, o_orderkey)), 2) AS "first",
round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 2) AS "last",
round((arg_max(o_totalprice, (o_orderdate, o_orderkey)) / arg_min(o_totalprice, (o_orderdate, o_orderkey)) - 1) * 100, 2) AS growth_proxy_pct FROM orders""")
def a8(t):
    return rounded(G.growth_proxy(t("orders"), "o_totalprice", ["o_orderdate", "o_orderkey"]), 2)


@query("a9_business_metrics", f"""WITH {GAPPY_SQL} SELECT 'revenue' AS revenue_column, 'profit' AS profit_column, 'quantity' AS quantity_column,
round(sum(coalesce(revenue, 0)), 2) AS total_revenue, round(sum(profit), 2) AS total_profit, round(sum(profit) / sum(revenue) * 100, 2) AS profit_margin,
round(sum(quantity), 2) AS total_quantity, round(avg(coalesce(revenue, 0)), 2) AS average_revenue, round(avg(profit), 2) AS average_profit FROM gappy""")
def a9(t):
    return rounded(G.business_metrics(t("gappy")), 2)


@query("a10_numeric_totals", f"WITH {SALES_SQL} " + per_column("sales", ["order_key", "quantity", "revenue", "cost", "profit"], "round(sum({c}), 2)::DOUBLE AS total"))
def a10(t):
    return rounded(G.numeric_totals(t("sales")).drop("col_no"), 2)


def drivers_sql(view: str, dims: list[str], limit: int) -> str:
    seg = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), '<missing>') AS segment, sum(revenue) AS s, avg(revenue) AS m, count(*) AS n FROM u GROUP BY 2"
        for d in dims)
    return f"""u AS (SELECT * FROM {view} WHERE revenue IS NOT NULL), tot AS (SELECT sum(revenue) AS t, avg(revenue) AS o FROM u), seg AS ({seg})
SELECT dimension, segment, round(s, 2) AS "sum", round(m, 4) AS mean, n, round(s / t, 8) AS share_of_total,
round((m - o) / (abs(o) + 1e-9) * 100, 6) + 0.0 AS vs_overall_pct, round(abs(s / t) * abs((m - o) / (abs(o) + 1e-9) * 100), 6) AS impact_score
FROM seg, tot ORDER BY abs(s / t) * abs((m - o) / (abs(o) + 1e-9) * 100) DESC, dimension, segment LIMIT {limit}"""


def _drivers(df):
    return rounded(df.withColumnRenamed("count", "n"), 6, sum=2, mean=4, share_of_total=8)


DIMS = ["region", "nation", "segment", "priority", "return_flag"]


@query("a11_segment_drivers", f"WITH {GAPPY_SQL}, {drivers_sql('gappy', DIMS, 10)}")
def a11(t):
    return _drivers(G.segment_drivers(t("gappy"), "revenue", DIMS, 10))


@query("a11_segment_drivers_all", f"WITH {SALES_SQL}, {drivers_sql('sales', ['region', 'segment', 'priority', 'return_flag'], 1000)}")
def a11_all(t):
    return _drivers(G.segment_drivers(t("sales"), "revenue", ["region", "segment", "priority", "return_flag"], 1000))


def concentration_sql(view: str, dims: list[str]) -> str:
    return "seg AS (" + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), '<missing>') AS segment, coalesce(sum(revenue), 0) AS s FROM {view} GROUP BY 2" for d in dims) + """),
con AS (SELECT dimension, count(*) AS segments, arg_max(segment, s) AS top_segment, max(s) AS top_value, sum(s) AS total FROM seg GROUP BY dimension HAVING count(*) >= 2 AND sum(s) <> 0)"""


@query("a12_segment_concentration", f"""WITH {GAPPY_SQL}, {concentration_sql('gappy', DIMS)}
SELECT dimension, segments, top_segment, round(top_value, 2) AS top_value, round(total, 2) AS total, round(top_value / total * 100, 4) AS share_pct,
CASE WHEN top_value / total >= 0.5 THEN 'concentration' ELSE 'leader' END AS finding FROM con""")
def a12(t):
    return rounded(G.segment_concentration(t("gappy"), "revenue", DIMS).drop("dim_no"), 4, top_value=2, total=2)


@query("a13_best_worst_segment", f"""WITH {SALES_SQL}, s AS (SELECT region AS segment, sum(revenue) AS total FROM sales GROUP BY region)
SELECT * FROM (SELECT 'best' AS kind, segment, round(total, 2) AS total FROM s ORDER BY s.total DESC LIMIT 1) UNION ALL
SELECT * FROM (SELECT 'worst', segment, round(total, 2) FROM s ORDER BY s.total LIMIT 1)""")
def a13(t):
    pick = lambda kind, d: d.select(F.lit(kind).alias("kind"), "segment", r("total", 2).alias("total"))
    return pick("best", G.best_segment(t("sales"))).unionByName(pick("worst", G.worst_segment(t("sales"))))


@query("a14_max_min_row", """SELECT * FROM (SELECT 'max' AS kind, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'min', o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1)""")
def a14(t):
    keep = lambda kind, d: d.select(F.lit(kind).alias("kind"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    o = t("orders")
    return keep("max", G.max_row(o, "o_totalprice", ["o_orderkey"])).unionByName(keep("min", G.min_row(o, "o_totalprice", ["o_orderkey"])))


@query("a15_average_row_count", """SELECT round(avg(l_extendedprice), 4) AS average, count(*) AS n_rows FROM lineitem""")
def a15(t):
    li = t("lineitem")
    one = F.lit(1).alias("one")
    return G.average(li, "l_extendedprice").select(one, r("average").alias("average")).join(
        G.row_count(li).select(one, F.col("rows").alias("n_rows")), "one").drop("one")


@query("a16_metric_answer", f"""WITH {SALES_SQL} SELECT round(sum(revenue), 2) AS revenue_total, round(avg(revenue), 4) AS revenue_average, round(max(revenue), 4) AS revenue_max,
round(min(revenue), 4) AS revenue_min, round(sum(profit), 2) AS profit_total, round(sum(profit) / sum(revenue) * 100, 4) AS margin_pct FROM sales""")
def a16(t):
    return rounded(G.metric_answer(t("sales")).drop("revenue_column", "profit_column"), 4, revenue_total=2, profit_total=2)


TREND_SQL = """h AS (SELECT y, row_number() OVER (ORDER BY d, y) AS i, count(*) OVER () AS n FROM (SELECT {date} AS d, {metric} AS y FROM {view}) WHERE d IS NOT NULL AND y IS NOT NULL),
tr AS (SELECT avg(y) FILTER (WHERE i <= n // 2) AS a, avg(y) FILTER (WHERE i > n // 2) AS b, max(n) AS n FROM h)"""


def trend_sql(view: str, date: str, metric: str) -> str:
    return TREND_SQL.replace("{date}", date).replace("{metric}", metric).replace("{view}", view)


@query("a17_half_over_half_trend", f"""WITH {trend_sql('orders', 'o_orderdate', 'o_totalprice')}
SELECT n AS n_rows, round(a, 4) AS first_mean, round(b, 4) AS second_mean, round((b - a) / abs(a) * 100, 4) + 0.0 AS change_pct,
CASE WHEN (b - a) / abs(a) * 100 > 10 THEN 'positive' WHEN (b - a) / abs(a) * 100 < -10 THEN 'critical' ELSE 'info' END AS severity FROM tr""")
def a17(t):
    return rounded(R.half_over_half_trend(t("orders"), "o_orderdate", "o_totalprice").select(
        F.col("rows").alias("n_rows"), "first_mean", "second_mean", "change_pct", "severity"))


@query("a18_range_spread", """SELECT 'o_totalprice' AS "column", count(o_totalprice) AS n, round((max(o_totalprice) - min(o_totalprice)) / abs(min(o_totalprice)) * 100, 4) AS spread_pct,
((max(o_totalprice) - min(o_totalprice)) / abs(min(o_totalprice)) * 100 > 100)::INT AS variable FROM orders""")
def a18(t):
    return G.range_spread(t("orders"), "o_totalprice").select("column", "n", r("spread_pct").alias("spread_pct"), F.col("variable").cast("int").alias("variable"))


@query("a19_union_of_results", f"""WITH {SALES_SQL} SELECT 'region' AS dimension, region AS segment, round(sum(revenue), 2) AS total FROM sales GROUP BY region
UNION ALL SELECT 'return_flag', return_flag, round(sum(revenue), 2) FROM sales GROUP BY return_flag""")
def a19(t):
    s = t("sales")
    return G.union_results([G.metric_by_dimension(s, d, "revenue").select(F.lit(d).alias("dimension"), "segment", r("total", 2).alias("total"))
                            for d in ("region", "return_flag")])


@query("a20_melt", f"""WITH {BASELINE_SQL} SELECT segment, 'revenue' AS scenario, round(revenue, 2) AS "value" FROM baseline
UNION ALL SELECT segment, 'profit', round(profit, 2) FROM baseline""")
def a20(t):
    return rounded(G.melt(t("baseline"), ["segment"], ["revenue", "profit"]), 2)
