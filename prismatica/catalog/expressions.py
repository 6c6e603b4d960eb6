"""Sources, sinks, scalar expressions and column discovery (S*, E*, P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatica.catalog.registry import (
    COPIES_SQL, DIRTY_SQL, GAPPY_SQL, SALES_SQL, facts_sql, query, r, rounded)
from prismatica.functions import coerce as C, columns as N
from prismatica.operators import profile as P
from prismatica.plans.settle import scratch_folder
from prismatica.sources import readers, runlog, sinks

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


# --- sources and sinks -------------------------------------------------------------------

@query("s1_load", "SELECT count(*) AS n_rows, round(sum(o_totalprice), 2) AS total, "
                  "count(DISTINCT o_orderpriority) AS priorities FROM orders")
def s1(t):
    """Orders written as JSON records and loaded by extension."""
    path = scratch_folder(t.spark) + "/orders.json"
    sinks.write_table(t("orders"), path, "json")
    return readers.load(t.spark, path).agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.sum("o_totalprice"), 2).alias("total"),
        F.count_distinct("o_orderpriority").alias("priorities"))


@query("s2_load_csv", "SELECT c_mktsegment AS segment, count(*) AS n_rows, round(sum(c_acctbal), 2) AS balance "
                      "FROM customer GROUP BY c_mktsegment")
def s2(t):
    """Customers exported as CSV and read back with inferred types."""
    path = scratch_folder(t.spark) + "/customer.csv"
    sinks.write_csv(t("customer"), path)
    return readers.read_csv(t.spark, path).groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.sum("c_acctbal"), 2).alias("balance"))


@query("s3_normalize_columns", 'SELECT c_custkey AS "key", c_name AS name, c_acctbal AS balance FROM customer')
def s3(t):
    c = t("customer").select(F.col("c_custkey").alias(" key "), F.col("c_name").alias("name "), F.col("c_acctbal").alias(" balance"))
    return readers.normalize_columns(c)


@query("s4_assert_loadable", "SELECT n_regionkey AS region, count(*) AS nations FROM nation GROUP BY n_regionkey")
def s4(t):
    return readers.assert_loadable(t("nation")).groupBy(F.col("n_regionkey").alias("region")).agg(
        F.count(F.lit(1)).alias("nations"))


@query("s5_preview", "SELECT c_custkey, c_name, c_nationkey FROM customer ORDER BY c_custkey LIMIT 100")
def s5(t):
    return readers.preview(t("customer"), 100, 3, order_by=["c_custkey"])


@query("s6_write_csv", "SELECT o_orderstatus AS status, count(*) AS n_rows, round(avg(o_totalprice), 2) AS mean_price "
                       "FROM orders GROUP BY o_orderstatus")
def s6(t):
    path = scratch_folder(t.spark) + "/export"
    sinks.write_csv(t("orders"), path)
    back = t.spark.read.schema(t("orders").schema).option("header", True).csv(path)
    return back.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n_rows"), r(F.avg("o_totalprice"), 2).alias("mean_price"))


@query("s7_write_report_json", """
SELECT section, count(*) AS n_rows, sum(CASE WHEN filled THEN 1 ELSE 0 END)::BIGINT AS filled FROM (
  SELECT 'customers' AS section, c_acctbal >= 0 AS filled FROM customer
  UNION ALL SELECT 'suppliers', s_acctbal >= 0 FROM supplier) GROUP BY section""")
def s7(t):
    """Sections with NaN planted for negative balances, written as JSON."""
    plant = lambda d, c: d.select(F.when(F.col(c) >= 0, F.col(c)).otherwise(F.lit(float("nan"))).alias("balance"))
    path = scratch_folder(t.spark) + "/report"
    sinks.write_report_json({"customers": plant(t("customer"), "c_acctbal"), "suppliers": plant(t("supplier"), "s_acctbal")}, path)
    rows = t.spark.read.schema("payload string, section string").json(path)
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(
        F.get_json_object("payload", "$.balance").isNotNull()).alias("filled"))


@query("s8_append_event", "SELECT event_type AS event, count(*) AS n FROM events GROUP BY event_type")
def s8(t):
    """Every event of the table appended to a run log in two batches."""
    path = scratch_folder(t.spark) + "/log"
    e = t("events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event"),
                           F.lit("success").alias("status"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("details"),
                           "event_id")
    for half in (0, 1):
        runlog.append_events(e.filter(F.col("event_id") % 2 == half), path)
    return t.spark.read.schema(runlog.SCHEMA).json(path).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("s9_recent_events", "SELECT event_type AS event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(user_id AS VARCHAR) AS who "
                           "FROM events ORDER BY ts DESC, event_type LIMIT 100")
def s9(t):
    path = scratch_folder(t.spark) + "/log"
    runlog.append_events(t("events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event"), F.lit("success").alias("status"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("details")), path)
    return runlog.recent_events(t.spark, path, 100).select(
        "event", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("details")["user"].alias("who"))


# --- scalar expressions ------------------------------------------------------------------

@query("e1_to_number", f"""WITH {DIRTY_SQL}
SELECT o_orderkey, CASE WHEN amount IN ('inf', 'NaN') THEN NULL ELSE round(try_cast(amount AS DOUBLE), 2) END AS amount,
       (amount = 'inf')::INT AS infinite FROM dirty""")
def e1(t):
    x = C.to_number(F.col("amount"))
    return t("dirty").select("o_orderkey", r(C.finite(x), 2).alias("amount"),
                             F.coalesce(x == float("inf"), F.lit(False)).cast("int").alias("infinite"))


@query("e2_to_time", f"""WITH {DIRTY_SQL}
SELECT o_orderkey, strftime(coalesce(try_strptime(order_date_text, '%Y-%m-%d'), try_strptime(order_date_text, '%m/%d/%Y'),
       try_strptime(order_date_text, '%b %-d %Y'), try_strptime(order_date_text, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%d %H:%M:%S') AS at
FROM dirty""")
def e2(t):
    return t("dirty").select("o_orderkey", F.date_format(C.to_time(F.col("order_date_text")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("e3_finite", f"""WITH {DIRTY_SQL}
SELECT count(*) AS n_rows, count(x) AS finite_values, round(sum(x), 2) AS total, round(max(x), 2) AS largest
FROM (SELECT CASE WHEN amount NOT IN ('inf', 'NaN') THEN try_cast(amount AS DOUBLE) END AS x FROM dirty)""")
def e3(t):
    x = C.finite(C.to_number(F.col("amount")))
    return t("dirty").agg(F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("finite_values"),
                          r(F.sum(x), 2).alias("total"), r(F.max(x), 2).alias("largest"))


@query("e4_safe_float", f"""WITH {DIRTY_SQL}
SELECT o_orderkey, CASE WHEN amount IN ('inf', 'NaN', 'n/a') THEN -1.0::DOUBLE ELSE round(CAST(amount AS DOUBLE), 2) END AS amount FROM dirty""")
def e4(t):
    return t("dirty").select("o_orderkey", r(C.safe_float(F.col("amount"), -1.0), 2).alias("amount"))


@query("e5_date_parts", """SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate__year, month(o_orderdate)::INT AS o_orderdate__month,
day(o_orderdate)::INT AS o_orderdate__day, (isodow(o_orderdate) - 1)::INT AS o_orderdate__dayofweek FROM orders""")
def e5(t):
    parts = C.date_parts(F.col("o_orderdate"), "o_orderdate")
    return t("orders").select("o_orderkey", *[v.alias(k) for k, v in parts.items()])


@query("e6_is_missing", f"""WITH {COPIES_SQL}
SELECT o_orderstatus AS status, sum((o_totalprice IS NULL)::INT)::BIGINT AS price_missing,
       sum((o_orderpriority IS NULL)::INT)::BIGINT AS priority_missing FROM copies GROUP BY o_orderstatus""")
def e6(t):
    c = t("copies").withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(float("nan"))))
    return c.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count_if(N.value(c, "o_totalprice").isNull()).alias("price_missing"),
        F.count_if(N.value(c, "o_orderpriority").isNull()).alias("priority_missing"))


@query("e7_pct_change", """SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice,
round(CASE WHEN l_tax <> 0 THEN (l_discount - l_tax) / abs(l_tax) * 100 END, 4) + 0.0 AS change_pct FROM lineitem""")
def e7(t):
    return t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice",
                                r(C.pct_change(F.col("l_discount"), F.col("l_tax"))).alias("change_pct"))


@query("e8_ratio_eps", """SELECT c_custkey, round(c_nationkey / (abs(c_acctbal) + 1e-9), 6) AS ratio FROM customer""")
def e8(t):
    return t("customer").select("c_custkey", r(C.ratio_eps(F.col("c_nationkey"), F.col("c_acctbal")), 6).alias("ratio"))


@query("e9_clip", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0)::DOUBLE AS balance FROM customer")
def e9(t):
    return t("customer").select("c_custkey", C.clip(F.col("c_acctbal"), 0, 5000).alias("balance"))


@query("e10_band", """SELECT CASE WHEN c_acctbal >= 7500 THEN 'high' WHEN c_acctbal >= 2500 THEN 'middle' WHEN c_acctbal >= 0 THEN 'low'
ELSE 'negative' END AS band, count(*) AS n FROM customer GROUP BY 1""")
def e10(t):
    label = C.band(F.col("c_acctbal"), [(7500, "high"), (2500, "middle"), (0, "low")], "negative")
    return t("customer").groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("e11_text_key", f"""WITH {COPIES_SQL}
SELECT coalesce(o_orderpriority, '<missing>') AS segment, count(*) AS n FROM copies GROUP BY 1""")
def e11(t):
    return t("copies").groupBy(C.text_key(F.col("o_orderpriority")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("e12_round", "SELECT o_orderkey, round(o_totalprice * 0.1, 1) AS tenth, round(o_totalprice, -3) AS thousands FROM orders")
def e12(t):
    p = F.col("o_totalprice")
    return t("orders").select("o_orderkey", C.shown(p * 0.1, 1).alias("tenth"), C.shown(p, -3).alias("thousands"))


# --- discovery -----------------------------------------------------------------------------

_KIND = {"o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderstatus": "categorical", "o_orderpriority": "categorical"}


@query("p1_profile", f"""WITH {COPIES_SQL}, {facts_sql('copies', ORDERS)}
SELECT "column", CASE WHEN "column" = 'o_orderdate' THEN 'datetime' WHEN "column" IN ('o_orderstatus', 'o_orderpriority')
       THEN 'categorical' ELSE 'numeric' END AS semantic_type, distinct_values AS unique_values, missing,
       round(missing * 100.0::DOUBLE / n_rows, 2) AS missing_percentage FROM facts""")
def p1(t):
    return rounded(P.profile(t("copies")).drop("col_no", "dtype"), 2)


@query("p1_dataset_profile", f"""WITH {COPIES_SQL}
SELECT count(*) AS n_rows, 6::BIGINT AS n_columns, sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT)::BIGINT AS missing_values,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS duplicate_rows FROM copies""")
def p1_dataset(t):
    return P.dataset_profile(t("copies")).withColumnsRenamed({"rows": "n_rows", "columns": "n_columns"})


@query("p2_schema", f"""WITH {facts_sql('customer', CUSTOMER)}, samples AS (
  SELECT 'c_custkey' AS "column", array_to_string(list_sort(list_distinct(list(c_custkey)))[1:3], ', ') AS sample FROM customer
  UNION ALL SELECT 'c_name', array_to_string(list_sort(list_distinct(list(c_name)))[1:3], ', ') FROM customer
  UNION ALL SELECT 'c_nationkey', array_to_string(list_sort(list_distinct(list(c_nationkey)))[1:3], ', ') FROM customer
  UNION ALL SELECT 'c_acctbal', array_to_string(list_sort(list_distinct(list(c_acctbal)))[1:3], ', ') FROM customer
  UNION ALL SELECT 'c_mktsegment', array_to_string(list_sort(list_distinct(list(c_mktsegment)))[1:3], ', ') FROM customer)
SELECT "column", CASE WHEN "column" = 'c_name' THEN 'text' WHEN "column" = 'c_mktsegment' THEN 'categorical' ELSE 'numeric' END AS role,
       missing, round(missing * 100.0::DOUBLE / n_rows, 2) AS missing_pct, distinct_values AS "unique",
       round(distinct_values * 100.0::DOUBLE / n_rows, 2) AS unique_pct, (distinct_values <= 1)::INT AS constant, sample
FROM facts JOIN samples USING ("column")""")
def p2(t):
    return rounded(P.schema_report(t("customer")).drop("col_no", "dtype").withColumn("constant", F.col("constant").cast("int")), 2)


@query("p3_infer_role", f"""WITH {DIRTY_SQL}, d AS (SELECT count(*) AS n, count(DISTINCT amount) AS amounts,
  avg((coalesce(try_strptime(order_date_text, '%Y-%m-%d'), try_strptime(order_date_text, '%m/%d/%Y'), try_strptime(order_date_text, '%b %-d %Y'),
  try_strptime(order_date_text, '%Y-%m-%d %H:%M:%S')) IS NOT NULL)::INT) AS parsed FROM dirty)
SELECT 'o_orderkey' AS "column", 'numeric' AS role
UNION ALL SELECT 'amount', CASE WHEN amounts <= greatest(20, floor(n * 0.05)) THEN 'categorical' ELSE 'text' END FROM d
UNION ALL SELECT 'order_date_text', CASE WHEN parsed >= 0.9 THEN 'date' ELSE 'text' END FROM d
UNION ALL SELECT 'priority', 'categorical'""")
def p3(t):
    return P.infer_roles(t("dirty")).select("column", "role")


@query("p4_datetime_columns", f"""WITH {DIRTY_SQL}
SELECT 'order_date_text' AS "column", round(avg((coalesce(try_strptime(order_date_text, '%Y-%m-%d'), try_strptime(order_date_text, '%m/%d/%Y'),
 try_strptime(order_date_text, '%b %-d %Y'), try_strptime(order_date_text, '%Y-%m-%d %H:%M:%S')) IS NOT NULL)::INT), 4) AS parse_rate
FROM dirty HAVING parse_rate >= 0.8""")
def p4(t):
    return rounded(P.datetime_columns(t("dirty")).drop("col_no"))


@query("p5_datetime_candidates", "SELECT column_name AS \"column\" FROM (DESCRIBE events) WHERE column_type LIKE 'TIMESTAMP%'")
def p5(t):
    return P.datetime_candidates(t("events")).select("column")


@query("p6_type_partition", """SELECT column_name AS "column", CASE WHEN column_type = 'VARCHAR' THEN 'categorical'
WHEN column_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'numeric' END AS kind FROM (DESCRIBE orders)""")
def p6(t):
    return N.type_partition(t("orders")).drop("col_no")


@query("p7_dataset_metadata", f"""WITH {COPIES_SQL}
SELECT count(*) AS n_rows, 6::BIGINT AS n_columns, count(*) * 6 AS total_cells, 'o_totalprice' AS target,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM copies)) AS duplicate_rows FROM copies""")
def p7(t):
    return P.dataset_metadata(t("copies"), "o_totalprice").select(
        F.col("rows").alias("n_rows"), F.col("columns").alias("n_columns"), "total_cells", "target", "duplicate_rows")


@query("p8_resolve_target", f"WITH {SALES_SQL} SELECT 'revenue' AS target, round(sum(revenue), 2) AS total, count(*) AS n_rows FROM sales")
def p8(t):
    name = N.resolve_target(t("sales"))
    return t("sales").agg(F.lit(name).alias("target"), r(F.sum(name), 2).alias("total"), F.count(F.lit(1)).alias("n_rows"))


@query("p9_target_candidates", f"""WITH {SALES_SQL}
SELECT 'quantity' AS "column", 1 AS hits, round(sum(quantity), 2) AS total FROM sales
UNION ALL SELECT 'revenue', 1, round(sum(revenue), 2) FROM sales UNION ALL SELECT 'profit', 1, round(sum(profit), 2) FROM sales""")
def p9(t):
    from prismatica.operators.groups import numeric_totals
    s = t("sales")
    return N.target_candidates(s).join(numeric_totals(s).select("column", "total"), "column").select(
        "column", "hits", r("total", 2).alias("total"))


@query("p10_find_column", f"""WITH {SALES_SQL}
SELECT 'column_order' AS strategy, 'quantity' AS "column", round(sum(quantity), 2) AS total FROM sales
UNION ALL SELECT 'exact_first', 'revenue', round(sum(revenue), 2) FROM sales
UNION ALL SELECT 'word_order', 'profit', round(sum(profit), 2) FROM sales""")
def p10(t):
    s = t("sales")
    words = {"column_order": ["profit", "quant", "revenue"], "exact_first": ["quant", "revenue"], "word_order": ["profit", "quantity"]}
    found = {k: N.find_column(s, w, k) for k, w in words.items()}
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(c).alias("column"), F.col(c).alias("total")) for k, c in found.items()])
    return s.agg(*[r(F.sum(c), 2).alias(c) for c in dict.fromkeys(found.values())]).select(F.inline(rows))


@query("p11_problem_type", """SELECT 'quality' AS target, count(DISTINCT quality) AS classes,
CASE WHEN count(DISTINCT quality) <= 10 THEN 'classification' ELSE 'regression' END AS problem_type FROM labels
UNION ALL SELECT 'c_acctbal', least(count(DISTINCT c_acctbal), 11), CASE WHEN count(DISTINCT c_acctbal) <= 10 THEN 'classification' ELSE 'regression' END FROM customer
UNION ALL SELECT 'c_mktsegment', least(count(DISTINCT c_mktsegment), 11), 'classification' FROM customer""")
def p11(t):
    a = P.problem_type(t("labels"), "quality")
    out = a.unionByName(P.problem_type(t("customer"), "c_acctbal")).unionByName(P.problem_type(t("customer"), "c_mktsegment"))
    return out.withColumnRenamed("distinct_up_to_11", "classes")


@query("p12_prediction_target_default", "SELECT 'o_totalprice' AS target, round(avg(o_totalprice), 4) AS mean FROM orders")
def p12(t):
    name = N.prediction_target_default(t("orders"))
    return t("orders").agg(F.lit(name).alias("target"), r(F.avg(name)).alias("mean"))
