"""Quality, validation and cleaning (Q*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatica.catalog.expressions import CUSTOMER, ORDERS
from prismatica.catalog.registry import COPIES_SQL, DIRTY_SQL, facts_sql, query, r, rounded
from prismatica.operators import clean as K, quality as Q

FACTS = f"WITH {COPIES_SQL}, {facts_sql('copies', ORDERS)}"
# Row, missing and duplicate figures of the planted table, as one SQL row.
TOTALS = FACTS + """, totals AS (
  SELECT max(n_rows) AS n, count(*) AS k, sum(missing)::BIGINT AS missing, sum((missing > 0)::INT)::BIGINT AS gaps,
         max(n_rows) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS dups FROM facts),
shares AS (SELECT *, missing * 100.0::DOUBLE / (n * k) AS m, dups * 100.0::DOUBLE / n AS d FROM totals)
"""
DATE_SQL = ("coalesce(try_strptime(order_date_text, '%Y-%m-%d'), try_strptime(order_date_text, '%m/%d/%Y'), "
            "try_strptime(order_date_text, '%b %-d %Y'), try_strptime(order_date_text, '%Y-%m-%d %H:%M:%S'))")


@query("q1_missing_by_column", FACTS + """SELECT "column", missing, round(missing * 100.0::DOUBLE / n_rows, 4) AS missing_pct FROM facts WHERE missing > 0""")
def q1(t):
    return rounded(Q.missing_by_column(t("copies")))


@query("q2_missing_total", TOTALS + "SELECT missing AS missing_cells, round(m, 4) AS missing_pct, gaps AS columns_with_missing FROM shares")
def q2(t):
    return rounded(Q.missing_total(t("copies")))


@query("q3_duplicate_rows", TOTALS + "SELECT n AS n_rows, dups AS duplicate_rows, round(d, 4) AS duplicate_pct FROM shares")
def q3(t):
    return rounded(Q.duplicate_rows(t("copies")).withColumnRenamed("rows", "n_rows"))


@query("q3_duplicate_rows_lineitem", """SELECT count(*) AS n_rows,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows FROM lineitem""")
def q3_lineitem(t):
    return Q.duplicate_rows(t("lineitem")).select(F.col("rows").alias("n_rows"), "duplicate_rows")


@query("q4_drop_duplicates", f"WITH {COPIES_SQL} SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderpriority FROM (SELECT DISTINCT * FROM copies)")
def q4(t):
    return K.drop_duplicates(t("copies")).select("o_orderkey", r("o_totalprice", 2).alias("price"), "o_orderpriority")


@query("q5_constant_columns", f"""WITH flat AS (SELECT *, 'EUR' AS currency, NULL::VARCHAR AS note FROM customer),
{facts_sql('flat', CUSTOMER + ['currency', 'note'])}
SELECT "column", distinct_values FROM facts WHERE distinct_values + (missing > 0)::INT <= 1""")
def q5(t):
    flat = t("customer").withColumns({"currency": F.lit("EUR"), "note": F.lit(None).cast("string")})
    return Q.constant_columns(flat).select("column", F.col("distinct").alias("distinct_values"))


@query("q6_high_cardinality_columns", f"""WITH {facts_sql('customer', CUSTOMER)}
SELECT "column", distinct_values FROM facts WHERE distinct_values > greatest(100, floor(n_rows * 0.5))""")
def q6(t):
    return Q.high_cardinality_columns(t("customer")).select("column", F.col("distinct").alias("distinct_values"))


@query("q7_quality_issues", TOTALS + """
SELECT 'Missing Values' AS issue, "column", missing AS n, round(missing * 100.0::DOUBLE / n_rows, 2) AS percentage,
       CASE WHEN missing * 100.0 / n_rows >= 30 THEN 'Critical' WHEN missing * 100.0 / n_rows >= 10 THEN 'High'
            WHEN missing * 100.0 / n_rows >= 5 THEN 'Medium' ELSE 'Low' END AS severity FROM facts WHERE missing > 0
UNION ALL SELECT 'Duplicate Rows', NULL, dups, NULL, 'Medium' FROM shares WHERE dups > 0""")
def q7(t):
    return rounded(Q.quality_issues(t("copies")).drop("recommendation").withColumnRenamed("count", "n"), 2)


@query("q8_quality_report", TOTALS + """, lists AS (
  SELECT coalesce(sum((distinct_values + (missing > 0)::INT <= 1)::INT), 0) AS flat,
         coalesce(sum((distinct_values > greatest(100, floor(n_rows * 0.5)))::INT), 0) AS crowded,
         coalesce(string_agg("column", ',' ORDER BY col_no) FILTER (WHERE distinct_values > greatest(100, floor(n_rows * 0.5))), '') AS crowded_names
  FROM facts)
SELECT round(greatest(100 - least(35, m * 0.75) - least(20, d * 0.5) - least(10, flat * 2) - least(10, crowded * 2)
             - CASE WHEN n < 30 THEN 5 ELSE 0 END, 0)::DOUBLE, 1) AS score,
       n AS n_rows, missing AS missing_cells, round(m, 2) AS missing_percentage, dups AS duplicate_rows,
       round(d, 2) AS duplicate_percentage, crowded_names AS high_cardinality_columns, flat::BIGINT AS constants FROM shares, lists""")
def q8(t):
    q = Q.quality_report(t("copies"))
    return q.select(r("score", 1).alias("score"), F.col("rows").alias("n_rows"), "missing_cells",
                    r("missing_percentage", 2).alias("missing_percentage"), "duplicate_rows",
                    r("duplicate_percentage", 2).alias("duplicate_percentage"),
                    F.concat_ws(",", "high_cardinality_columns").alias("high_cardinality_columns"),
                    F.size("constant_columns").cast("long").alias("constants"))


@query("q9_health_score_a", f"""WITH {facts_sql('customer', CUSTOMER)}, s AS (
  SELECT 100 - least(10, sum((distinct_values > greatest(100, floor(n_rows * 0.5)))::INT) * 2)
             - least(10, sum((distinct_values + (missing > 0)::INT <= 1)::INT) * 2) - CASE WHEN max(n_rows) < 30 THEN 5 ELSE 0 END AS score,
         max(n_rows) AS n FROM facts)
SELECT score::DOUBLE AS score, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'FAIR'
       WHEN score >= 40 THEN 'POOR' ELSE 'CRITICAL' END AS status, n AS n_rows FROM s""")
def q9(t):
    return rounded(Q.health_score_a(t("customer")).select("score", "status", F.col("rows").alias("n_rows")), 1)


@query("q10_health_score_b", TOTALS + """SELECT round(100 - least(m * 0.7, 50) - least(d * 0.3, 20), 4) AS score,
CASE WHEN 100 - least(m * 0.7, 50) - least(d * 0.3, 20) >= 90 THEN 'Excellent' WHEN 100 - least(m * 0.7, 50) - least(d * 0.3, 20) >= 75 THEN 'Healthy'
     WHEN 100 - least(m * 0.7, 50) - least(d * 0.3, 20) >= 60 THEN 'Needs Attention' ELSE 'Poor' END AS status,
round(m, 4) AS missing_pct, round(d, 4) AS duplicate_pct FROM shares""")
def q10(t):
    return rounded(Q.health_score_b(t("copies")))


@query("q11_ml_readiness", TOTALS + """, x AS (SELECT n, k, d, (SELECT avg(missing * 100.0::DOUBLE / n_rows) FROM facts) AS mm FROM shares),
y AS (SELECT *, 100 - least(mm, 40) - least(d * 0.5, 15) - CASE WHEN n < 100 THEN 20 WHEN n < 500 THEN 10 ELSE 0 END AS score FROM x)
SELECT round(score, 4) AS score, CASE WHEN score >= 80 THEN 'Ready' WHEN score >= 60 THEN 'Mostly Ready' WHEN score >= 40
  THEN 'Needs Preparation' ELSE 'Not Ready' END AS status, n AS n_rows, k - 1 AS features, 'o_totalprice' AS target,
  round(mm, 4) AS missing_pct, round(d, 4) AS duplicate_pct FROM y""")
def q11(t):
    return rounded(Q.ml_readiness(t("copies"), "o_totalprice").withColumnRenamed("rows", "n_rows"))


@query("q12_risk_register", TOTALS + """, b AS (
  SELECT 'o_orderkey' AS c, quantile_cont(o_orderkey, 0.25) AS q1, quantile_cont(o_orderkey, 0.75) AS q3 FROM copies
  UNION ALL SELECT 'o_custkey', quantile_cont(o_custkey, 0.25), quantile_cont(o_custkey, 0.75) FROM copies
  UNION ALL SELECT 'o_totalprice', quantile_cont(o_totalprice, 0.25), quantile_cont(o_totalprice, 0.75) FROM copies),
v AS (SELECT 'o_orderkey' AS c, o_orderkey::DOUBLE AS x FROM copies UNION ALL SELECT 'o_custkey', o_custkey FROM copies
      UNION ALL SELECT 'o_totalprice', o_totalprice FROM copies),
o AS (SELECT c, avg((x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::INT) * 100 AS pct FROM v JOIN b USING (c) WHERE x IS NOT NULL AND q3 > q1 GROUP BY c)
SELECT 'Data Quality' AS type, CASE WHEN missing * 100.0 / n_rows >= 30 THEN 'High' ELSE 'Medium' END AS severity, "column",
       printf('%.1f%% of values are missing.', missing * 100.0::DOUBLE / n_rows) AS message FROM facts WHERE missing * 100.0 / n_rows >= 10
UNION ALL SELECT 'Data Quality', 'Medium', NULL, format('{:,} duplicate rows detected.', dups) FROM shares WHERE dups > 0
UNION ALL SELECT 'Outlier', CASE WHEN pct >= 10 THEN 'High' ELSE 'Medium' END, c, printf('%.1f%% of observations are statistical outliers.', pct) FROM o WHERE pct >= 5
UNION ALL SELECT 'Cardinality', 'Low', "column", 'Very high cardinality categorical field.' FROM facts
  WHERE "column" IN ('o_orderstatus', 'o_orderdate', 'o_orderpriority') AND distinct_values * 1.0 / n_rows > 0.9""")
def q12(t):
    return Q.risk_register(t("copies")).select("type", "severity", "column", "message")


@query("q13_validate", TOTALS + """SELECT CASE WHEN missing > 0 THEN 'warning' ELSE 'healthy' END AS status, n AS n_rows, k AS n_columns,
'o_orderkey,o_custkey,o_totalprice' AS numeric_columns, 'o_orderstatus,o_orderpriority' AS categorical_columns, 'o_orderdate' AS datetime_columns,
missing AS missing_total, (SELECT missing FROM facts WHERE "column" = 'o_totalprice') AS price_missing FROM shares""")
def q13(t):
    v = Q.validate(t("copies"))
    return v.select("status", F.col("rows").alias("n_rows"), F.col("columns").alias("n_columns"),
                    *[F.concat_ws(",", f"{k}_columns").alias(f"{k}_columns") for k in ("numeric", "categorical", "datetime")],
                    "missing_total", F.col("missing_by_column")["o_totalprice"].alias("price_missing"))


@query("q14_validate_target", FACTS + """SELECT 'o_totalprice' AS target, n_rows, missing AS missing_values, distinct_values AS unique_values, 1 AS is_numeric
FROM facts WHERE "column" = 'o_totalprice'""")
def q14(t):
    v = Q.validate_target(t("copies"), "o_totalprice", require_numeric=True)
    return v.select("target", F.col("rows").alias("n_rows"), "missing_values", "unique_values", F.col("numeric").cast("int").alias("is_numeric"))


@query("q15_safe_validate", FACTS + """SELECT 'o_totalprice' AS target, 'warning' AS status, NULL AS error FROM facts WHERE "column" = 'o_totalprice' AND missing > 0
UNION ALL SELECT 'absent', 'invalid', 'UNKNOWN_TARGET'""")
def q15(t):
    c = t("copies")
    one = lambda name: Q.safe_validate(c, name).select(F.lit(name).alias("target"), "status", "error")
    return one("o_totalprice").unionByName(one("absent"))


@query("q16_request_summary", TOTALS + """SELECT n AS n_rows, k AS n_columns, 'o_totalprice' AS target,
(SELECT missing FROM facts WHERE "column" = 'o_totalprice') AS target_missing_values, dups AS duplicate_rows, missing AS missing_cells,
round(m, 2) AS missing_percentage, 3::BIGINT AS numeric_columns, 2::BIGINT AS categorical_columns, 1::BIGINT AS datetime_columns FROM shares""")
def q16(t):
    return rounded(Q.request_summary(t("copies"), "o_totalprice").drop("column_names", "dtypes")
                   .withColumnsRenamed({"rows": "n_rows", "columns": "n_columns"}), 2)


@query("q17_promote_dates", f"""WITH {DIRTY_SQL} SELECT o_orderkey, strftime({DATE_SQL}, '%Y-%m-%d') AS order_day FROM dirty""")
def q17(t):
    return K.promote_dates(t("dirty")).select("o_orderkey", F.date_format("order_date_text", "yyyy-MM-dd").alias("order_day"))


@query("q18_impute_median", f"""WITH {COPIES_SQL}, m AS (SELECT median(o_totalprice) AS p FROM copies)
SELECT o_orderkey, round(coalesce(o_totalprice, p), 2) AS price FROM copies, m""")
def q18(t):
    return K.impute_median(t("copies")).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), r("o_totalprice", 2).alias("price"))


@query("q19_impute_mode", f"""WITH {COPIES_SQL}, m AS (SELECT o_orderpriority AS p FROM copies WHERE o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT o_orderkey, coalesce(o_orderpriority, p) AS priority FROM copies, m""")
def q19(t):
    return K.impute_mode(t("copies")).select("o_orderkey", F.col("o_orderpriority").alias("priority"))


@query("q20_clean", f"""WITH {DIRTY_SQL}, twice AS (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE o_orderkey % 50 = 0),
u AS (SELECT DISTINCT o_orderkey, priority, {DATE_SQL} AS d FROM twice),
p AS (SELECT priority AS fill FROM u WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
q AS (SELECT d AS day FROM u WHERE d IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(priority, fill) AS priority, strftime(coalesce(d, day), '%Y-%m-%d') AS order_day FROM u, p, q""")
def q20(t):
    d = t("dirty")
    cleaned = K.clean(d.unionByName(d.filter(F.col("o_orderkey") % 50 == 0)))
    return cleaned.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "priority",
                          F.date_format("order_date_text", "yyyy-MM-dd").alias("order_day"))


@query("q21_drop_missing", f"""WITH {COPIES_SQL} SELECT o_orderkey, round(o_totalprice, 2) AS price FROM copies WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""")
def q21(t):
    c = t("copies").withColumn("note", F.lit(None).cast("string"))
    return K.drop_missing(c, empty_columns=True).select("o_orderkey", r("o_totalprice", 2).alias("price"))
