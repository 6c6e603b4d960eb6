"""The registry and the views the queries share.

Each query is a Spark callable (spark, folder) and, where SQL can say the same,
an oracle statement over the same tables. Floats are rounded on both sides for
comparison only; the operators return full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``, where ``t(view)`` gives a table or shared view."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))
        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


class Tables:
    """Tables of a folder by name, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        view = VIEWS.get(name)
        return view(self) if view else self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def r(c: Column | str, digits: int = 4) -> Column:
    """Round for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 4, **per_column: int) -> DataFrame:
    """All double columns rounded for comparison."""
    return df.select(*[
        r(f"`{n}`", per_column.get(n, digits)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


# --- shared views: Spark and SQL --------------------------------------------------------

def _sales(t: Tables) -> DataFrame:
    li, o = t("lineitem"), t("orders")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    cost = F.lit(0.7) * F.col("l_extendedprice") * (1 + F.col("l_tax"))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("o_orderkey").alias("order_key"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"),
                    F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
                    F.col("l_returnflag").alias("return_flag"), F.col("o_orderdate").alias("order_date"),
                    F.col("l_quantity").alias("quantity"), revenue.alias("revenue"), cost.alias("cost"),
                    (revenue - cost).alias("profit")))


SALES_SQL = """
sales AS (
  SELECT o_orderkey AS order_key, r_name AS region, n_name AS nation, c_mktsegment AS segment,
         o_orderpriority AS priority, l_returnflag AS return_flag, o_orderdate AS order_date,
         l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS revenue,
         CAST(0.7 AS DOUBLE) * l_extendedprice * (1 + l_tax) AS cost,
         l_extendedprice * (1 - l_discount) - CAST(0.7 AS DOUBLE) * l_extendedprice * (1 + l_tax) AS profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def _gappy(t: Tables) -> DataFrame:
    """Sales with planted gaps in revenue and priority."""
    key = F.col("order_key")
    return t("sales").withColumns({"revenue": F.when(key % 7 != 0, F.col("revenue")),
                                   "priority": F.when(key % 11 != 0, F.col("priority"))})


GAPPY_SQL = SALES_SQL + """,
gappy AS (SELECT * REPLACE (CASE WHEN order_key % 7 <> 0 THEN revenue END AS revenue,
                            CASE WHEN order_key % 11 <> 0 THEN priority END AS priority) FROM sales)
"""


def _copies(t: Tables) -> DataFrame:
    """Orders with some rows planted twice and gaps in price and priority."""
    o = t("orders")
    key = F.col("o_orderkey")
    gaps = o.withColumns({"o_totalprice": F.when(key % 9 != 0, F.col("o_totalprice")),
                          "o_orderpriority": F.when(key % 5 != 0, F.col("o_orderpriority"))})
    return gaps.unionByName(gaps.filter(key % 50 == 0))


COPIES_SQL = """
gaps AS (SELECT * REPLACE (CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS o_totalprice,
                           CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority) FROM orders),
copies AS (SELECT * FROM gaps UNION ALL SELECT * FROM gaps WHERE o_orderkey % 50 = 0)
"""


def _dirty(t: Tables) -> DataFrame:
    """Orders as text: amounts and dates in several spellings, some unusable."""
    key, d = F.col("o_orderkey"), F.col("o_orderdate")
    spelled = (F.when(key % 13 == 0, "n/a").when(key % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
               .when(key % 4 == 1, F.date_format(d, "MM/dd/yyyy")).when(key % 4 == 2, F.date_format(d, "MMM d yyyy"))
               .otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss")))
    amount = F.when(key % 13 == 0, "n/a").when(key % 17 == 0, "inf").when(key % 19 == 0, "NaN").otherwise(
        F.col("o_totalprice").cast("string"))
    return t("orders").select("o_orderkey", amount.alias("amount"), spelled.alias("order_date_text"),
                              F.when(key % 3 != 0, F.col("o_orderpriority")).alias("priority"))


DIRTY_SQL = """
dirty AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN 'inf' WHEN o_orderkey % 19 = 0 THEN 'NaN'
       ELSE CAST(o_totalprice AS VARCHAR) END AS amount,
  CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
       WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%m/%d/%Y')
       WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%b %-d %Y')
       ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS order_date_text,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority FROM orders)
"""


def _baseline(t: Tables) -> DataFrame:
    return t("sales").groupBy(F.col("region").alias("segment")).agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))


BASELINE_SQL = SALES_SQL + """,
baseline AS (SELECT region AS segment, sum(revenue) AS revenue, sum(profit) AS profit FROM sales GROUP BY region)
"""

VIEWS = {"sales": _sales, "gappy": _gappy, "copies": _copies, "dirty": _dirty, "baseline": _baseline}


def facts_sql(view: str, columns: list[str]) -> str:
    """Rows, missing and distinct values per column of a view, as SQL."""
    return "facts AS (" + " UNION ALL ".join(
        f"SELECT {i} AS col_no, '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS missing, "
        f"count(DISTINCT {c}) AS distinct_values FROM {view}" for i, c in enumerate(columns)) + ")"
