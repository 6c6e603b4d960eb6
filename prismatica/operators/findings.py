"""Rule-based findings: metrics of a table turned into rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from prismatica.functions import vocabulary as V
from prismatica.functions.coerce import percent
from prismatica.functions.columns import find_column, non_numeric_columns, number, numeric_columns
from prismatica.functions.tidy import empty_rows
from prismatica.operators import quality, stats
from prismatica.operators.groups import business_kpis, segment_concentration
from prismatica.operators.profile import BaseProfile, base
from prismatica.operators.trend import half_over_half_trend, trend_date_column, trend_metric_column

FINDING = ("seq int, category string, title string, message string, severity string, metric string, "
           "value double, recommendation string")
SEVERITIES = ["critical", "warning", "positive", "info"]


def _finding(seq: int, category: str, title, message: Column, severity, metric, value: Column,
             recommendation=None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(seq).alias("seq"), text(category).alias("category"), text(title).alias("title"),
                    message.alias("message"), text(severity).alias("severity"), text(metric).alias("metric"),
                    value.cast("double").alias("value"), text(recommendation).alias("recommendation"))


def _rows(one_row: DataFrame, findings: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array_compact(F.array(*findings))))


def quality_findings(df: DataFrame, shared: BaseProfile | None = None) -> DataFrame:
    """Completeness and duplicates of the table."""
    t = base(df, shared).totals()
    empty, gap = (F.col("rows") == 0) | (F.col("columns") == 0), F.col("missing_pct")
    cat = "Data Quality"
    share = F.format_string("%.2f%% of the cells are missing.", gap)
    return _rows(t, [
        F.when(empty, _finding(0, cat, "Dataset is empty", F.lit("The dataset holds no usable rows."), "critical",
                               None, F.lit(None), "Provide a dataset with valid records.")),
        F.when(~empty & (gap == 0), _finding(
            1, cat, "Data completeness is strong", F.format_string("%,d rows and %,d columns without missing values.", "rows", "columns"),
            "positive", "Missing Data", F.lit(0.0))),
        F.when(~empty & (gap > 0) & (gap < 5), _finding(
            1, cat, "Minor missing-data issue", share, "warning", "Missing Data", F.round(gap, 2),
            "Review missing values before high-impact decisions.")),
        F.when(~empty & (gap >= 5), _finding(
            1, cat, "Significant missing data detected", share, "critical", "Missing Data", F.round(gap, 2),
            "Find the source of the missing records and impute or clean them.")),
        F.when(F.col("duplicate_rows") > 0, _finding(
            2, cat, "Duplicate records detected",
            F.format_string("%,d duplicate rows (%.2f%% of the dataset).", "duplicate_rows", "duplicate_pct"),
            "warning", "Duplicates", F.col("duplicate_rows"),
            "Check whether the duplicates are legitimate repeats before removing them."))])


def business_findings(df: DataFrame) -> DataFrame:
    """Revenue, profit, margin and volume of the columns named so."""
    names = {"r": find_column(df, V.FINDING_REVENUE_WORDS), "p": find_column(df, V.FINDING_PROFIT_WORDS),
             "q": find_column(df, V.FINDING_QUANTITY_WORDS)}
    if not any(names.values()):
        return empty_rows(df, FINDING)
    aggs = []
    for k, c in names.items():
        v = number(df, c) if c else F.lit(None).cast("double")
        aggs += [F.sum(v).alias(k), F.count(v).alias(f"{k}_n"), F.avg(v).alias(f"{k}_mean"),
                 F.min(v).alias(f"{k}_low"), F.max(v).alias(f"{k}_high")]
    r, p, q = F.col("r"), F.col("p"), F.col("q")
    spread = F.coalesce(F.try_divide(F.col("r_high") - F.col("r_low"), F.abs("r_low")) * 100, F.lit(0.0))
    margin = F.try_divide(F.coalesce(p, F.lit(0.0)), r) * 100 if names["r"] and names["p"] else F.lit(None).cast("double")
    grade = (F.when(margin >= 20, "positive").when(margin >= 10, "info").when(margin >= 0, "warning").otherwise("critical"))
    money = lambda label, c: F.format_string("Total %s is %,.2f.", F.lit(label), c)
    perf, prof = "Business Performance", "Profitability"
    return _rows(df.agg(*aggs), [
        F.when(F.col("r_n") > 0, _finding(
            11, perf, "Revenue baseline established",
            F.format_string("Total %s is %,.2f, %,.2f per record on average.", F.lit(names["r"] or ""), r, F.col("r_mean")),
            "positive", names["r"], F.round(r, 2))),
        F.when((F.col("r_n") >= 3) & (spread > 100), _finding(
            12, perf, "Revenue variability is high",
            F.format_string("Highest and lowest %s differ by %.1f%%.", F.lit(names["r"] or ""), spread),
            "warning", names["r"], F.round(spread, 2), "Investigate the records behind the largest variation.")),
        F.when((F.col("p_n") > 0) & (p > 0), _finding(
            13, prof, "Positive aggregate profitability", money(names["p"] or "", p), "positive", names["p"], F.round(p, 2))),
        F.when((F.col("p_n") > 0) & (p < 0), _finding(
            13, prof, "Aggregate loss detected", money(names["p"] or "", p), "critical", names["p"], F.round(p, 2),
            "Investigate cost, pricing and the segments behind the losses.")),
        F.when((F.col("p_n") > 0) & (p == 0), _finding(
            13, prof, "Profit is approximately neutral", F.lit("Aggregate profit is about zero."), "warning", names["p"],
            F.lit(0.0))),
        F.when(margin.isNotNull(), _finding(
            14, prof, "Profit margin analyzed", F.format_string("Aggregate profit margin is %.2f%%.", margin), grade,
            "Profit Margin", F.round(margin, 2),
            F.when(margin < 20, "Protect high-margin revenue and examine low-margin segments.")
            .otherwise("Maintain pricing discipline and the current margin."))),
        F.when(F.col("q_n") > 0, _finding(
            15, "Operations", "Volume baseline established", money(names["q"] or "", q), "info", names["q"], F.round(q, 2)))])


def segment_findings(df: DataFrame, max_dims: int | None = None) -> DataFrame:
    """Leading or dominating segment of the category columns, all or the first ``max_dims``."""
    metric = find_column(df, V.FINDING_SEGMENT_WORDS) or next(iter(numeric_columns(df)), None)
    if metric is None or not non_numeric_columns(df):
        return empty_rows(df, FINDING)
    s = segment_concentration(df, metric, max_dims=max_dims)
    heavy = F.col("finding") == "concentration"
    return s.select(
        (F.col("dim_no") + 21).cast("int").alias("seq"), F.lit("Segmentation").alias("category"),
        F.concat("dimension", F.when(heavy, " concentration detected").otherwise(" leader identified")).alias("title"),
        F.format_string("'%s' contributes about %.1f%% of total %s.", "top_segment", "share_pct", F.lit(metric)).alias("message"),
        F.when(heavy, "warning").otherwise("info").alias("severity"), F.lit(metric).alias("metric"),
        F.round("share_pct", 2).alias("value"),
        F.when(heavy, F.format_string("Review the dependency on '%s' (%s) and ways to diversify.", "top_segment", "dimension"))
        .alias("recommendation"))


def trend_findings(df: DataFrame) -> DataFrame:
    """Growth, decline or stability of the main metric over time."""
    date, metric = trend_date_column(df), trend_metric_column(df)
    if date is None or metric is None:
        return empty_rows(df, FINDING)
    t = half_over_half_trend(df, date, metric)
    s = F.col("severity")
    pick = lambda up, down, flat: F.when(s == "positive", up).when(s == "critical", down).otherwise(flat)
    return t.select(
        F.lit(31).alias("seq"), F.lit("Trend Analysis").alias("category"),
        pick("Positive trend detected", "Negative trend detected", "Trend is relatively stable").alias("title"),
        F.format_string("%s changed by %+.2f%% from the earlier to the later half.", F.lit(metric), "change_pct").alias("message"),
        s.alias("severity"), F.lit(metric).alias("metric"), F.round("change_pct", 2).alias("value"),
        pick("Find the drivers of the growth and whether it lasts.",
             "Find the products, regions or channels behind the decline.",
             "Keep watching the metric.").alias("recommendation"))


def all_findings(df: DataFrame, shared: BaseProfile | None = None, max_dims: int | None = None) -> DataFrame:
    """Quality, business, segment and trend findings in report order."""
    return (quality_findings(df, shared).unionByName(business_findings(df))
            .unionByName(segment_findings(df, max_dims)).unionByName(trend_findings(df)))


def findings_rollup(findings: DataFrame) -> DataFrame:
    """One row: overall status (the worst severity present), counts per
    severity and the distinct recommendations in first-seen order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(4))
    counts = findings.agg(
        F.min(rank).alias("worst"), F.count(F.lit(1)).alias("total_insights"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES]).withColumn("one", F.lit(1))
    # Findings are a few per column, so their texts fit one row.
    advice = (findings.filter("recommendation is not null").groupBy("recommendation").agg(F.min("seq").alias("seq"))
              .agg(F.array_sort(F.collect_list(F.struct("seq", "recommendation"))).alias("r")).select(
                  F.lit(1).alias("one"), F.transform("r", lambda x: x["recommendation"]).alias("recommendations")))
    status = F.coalesce(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("worst").cast("int")), F.lit("info"))
    text = (F.when(status == "critical", "Critical business or data-quality issues need immediate attention.")
            .when(status == "warning", "Important areas need attention; overall performance remains actionable.")
            .when(status == "positive", "Positive business signals, no major issues.")
            .otherwise("Not enough evidence for strong conclusions."))
    return counts.join(advice, "one").select(
        status.alias("overall_status"), text.alias("executive_summary"), "total_insights",
        *[f"{s}_count" for s in SEVERITIES], "recommendations")


def dataset_statements(df: DataFrame, cleaned: DataFrame | None = None, shared: BaseProfile | None = None) -> DataFrame:
    """Sentences on size, gaps, copies, revenue, profit and margin; the KPIs
    may come from the cleaned table."""
    t = base(df, shared).totals()
    head = _statements(t, [
        F.format_string("The dataset contains %,d records across %d columns.", "rows", "columns"),
        F.when(F.col("missing_cells") == 0, "No missing values were detected.").otherwise(
            F.format_string("%,d missing values were detected.", "missing_cells")),
        F.when(F.col("duplicate_rows") > 0, F.format_string("%,d duplicate records were detected.", "duplicate_rows"))], 0)
    order = {"TOTAL_REVENUE": (10, "Total detected revenue is %,.2f."), "TOTAL_PROFIT": (11, "Total detected profit is %,.2f."),
             "PROFIT_MARGIN": (12, "Detected profit margin is %.2f%%.")}
    seq = sentence = F
    for k, (n, fmt) in order.items():
        seq, sentence = seq.when(F.col("kpi") == k, n), sentence.when(F.col("kpi") == k, F.format_string(fmt, "value"))
    kpis = business_kpis(cleaned if cleaned is not None else df)
    return head.unionByName(kpis.select(seq.alias("seq"), sentence.alias("statement")))


def _statements(one_row: DataFrame, texts: list[Column], start: int) -> DataFrame:
    rows = [F.when(t.isNotNull(), F.struct(F.lit(start + i).alias("seq"), t.alias("statement"))) for i, t in enumerate(texts)]
    return one_row.select(F.inline(F.array_compact(F.array(*rows))))


def overview(df: DataFrame, target: str | None, health: DataFrame, risks: DataFrame, outliers: DataFrame,
             correlations: DataFrame, readiness: DataFrame) -> DataFrame:
    """The one-row results that summary and recommendations are read from."""
    one = F.lit(1).alias("one")
    strongest = correlations.agg(F.min(F.struct((-F.col("abs_correlation")).alias("k"), "feature_a", "feature_b",
                                                "correlation")).alias("top"))
    return (health.select(one, F.col("score").alias("health_score"), F.col("status").alias("health_status"),
                          "missing_pct", "duplicate_pct")
            .join(readiness.select(one, "rows", (F.col("features") + 1).alias("columns"),
                                   F.col("score").alias("ready_score"), F.col("status").alias("ml_readiness")), "one")
            .join(risks.agg(F.count_if(F.col("severity").isin("Critical", "High")).alias("high_priority_risks")).select(one, "*"), "one")
            .join(stats.outlier_total(outliers).select(one, "*"), "one")
            .join(strongest.select(one, "*"), "one")
            .withColumn("target", F.lit(target).cast("string")))


def executive_summary(facts: DataFrame) -> DataFrame:
    """One row of headline fields and a summary sentence list."""
    texts = F.array(
        F.format_string("Dataset contains %,d rows and %,d columns.", "rows", "columns"),
        F.format_string("Data health score is %.1f/100 (%s).", "health_score", "health_status"),
        F.when(F.col("target").isNotNull(), F.format_string("Primary analytical target: %s.", "target")),
        F.when(F.col("high_priority_risks") > 0,
               F.format_string("%d high-priority risk(s) require attention.", "high_priority_risks"))
        .otherwise("No critical data risks were detected."),
        F.when(F.col("total_outliers") > 0,
               F.format_string("%,d potential outlier observations were detected.", "total_outliers")),
        F.when(F.col("top").isNotNull(), F.format_string(
            "Strongest numeric relationship: %s - %s (%.2f).", "top.feature_a", "top.feature_b", "top.correlation")))
    return facts.select(F.concat_ws(" ", F.array_compact(texts)).alias("summary"), "high_priority_risks", "target",
                        "health_score", "ml_readiness")


def recommendations(facts: DataFrame) -> DataFrame:
    """Actions by priority that the results call for."""
    def action(seq: int, priority: str, category: str, text) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(priority).alias("priority"), F.lit(category).alias("category"),
                        (text if isinstance(text, Column) else F.lit(text)).alias("action"))

    strong = F.abs("top.correlation") >= 0.80
    rules = F.array_compact(F.array(
        F.when(F.col("missing_pct") > 10, action(1, "High", "Data Quality", "Treat missing values before modeling.")),
        F.when(F.col("duplicate_pct") > 2, action(2, "Medium", "Data Quality", "Review duplicates and set a deduplication rule.")),
        F.when(F.col("total_outliers") > 0, action(3, "Medium", "Anomaly Detection", "Investigate outliers before sensitive models.")),
        F.when(strong, action(4, "Medium", "Feature Engineering", F.format_string(
            "Review %s and %s for multicollinearity.", "top.feature_a", "top.feature_b"))),
        F.when(F.col("target").isNull(), action(5, "Medium", "Machine Learning", "Select a target for prediction and driver analysis.")),
        F.when(F.col("ready_score") < 60, action(6, "High", "ML Readiness", "Improve data quality, sample size and target definition."))))
    none = F.array(action(7, "Low", "Optimization", "Ready for predictive analytics and decision projection."))
    return facts.select(F.inline(F.when(F.size(rules) > 0, rules).otherwise(none)))
