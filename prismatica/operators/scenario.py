"""What-if projection of every baseline row under every scenario.

A baseline has one row per segment with ``revenue`` and ``profit``. Scenarios
are few and given by the caller, so they enter the plan as one array literal
that is exploded: no join, no shuffle, and each projection is plain column
arithmetic. Two families share the shape:

``a``  cost factors are floored, price does not move unit cost;
``b``  costs scale with the revenue ratio, price included.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window, functions as F

from prismatica.functions.coerce import band, clip, safe_float
from prismatica.functions.columns import number
from prismatica.operators.groups import business_metrics


@dataclass(frozen=True)
class Scenario:
    """Percentage changes and the assumptions they are projected with."""

    name: str
    price: float = 0.0
    demand: float = 0.0
    marketing: float = 0.0
    variable_cost: float = 0.0
    fixed_cost: float = 0.0
    elasticity: float = -0.30
    roi: float = 0.25
    uncertainty: float = 5.0


# --- fixed values: the scenario tables -----------------------------------------
STANDARD_A = [
    Scenario("Baseline"),
    Scenario("Price Increase", price=10),
    Scenario("Demand Growth", demand=15),
    Scenario("Marketing Expansion", marketing=50),
    Scenario("Cost Reduction", variable_cost=-10, fixed_cost=-5),
    Scenario("Aggressive Growth", price=5, demand=20, marketing=50),
    Scenario("Cost Pressure", variable_cost=15, fixed_cost=10),
    Scenario("Economic Downturn", demand=-20, marketing=-20),
]
GENERATED_B = [
    Scenario("Baseline"),
    Scenario("Aggressive Growth", price=5, demand=15, marketing=20, variable_cost=-5),
    Scenario("Price Optimization", price=10, demand=5, variable_cost=-2),
    Scenario("Demand Expansion", demand=20, marketing=15),
    Scenario("Marketing Expansion", marketing=30),
    Scenario("Cost Reduction", variable_cost=-15, fixed_cost=-5),
    Scenario("Conservative Growth", price=2, demand=3, marketing=5, variable_cost=-2),
    Scenario("Downside", price=-5, demand=-10, marketing=-10, variable_cost=10, fixed_cost=5),
    Scenario("Recession", price=-8, demand=-20, marketing=-15, variable_cost=12, fixed_cost=8),
]
GRID_STEPS = [-20, -15, -10, -5, 0, 5, 10, 15, 20]
SENSITIVITY_VARIABLES = ["price", "demand", "marketing", "variable_cost", "fixed_cost"]
BREAK_EVEN_STEPS, BREAK_EVEN_LOW, BREAK_EVEN_HIGH = 2001, -50.0, 50.0
ERROR_SCORE = -999999.0

ADVICE = [
    ("STRONGLY_RECOMMENDED", "Strongly recommended: the projected outcome improves materially."),
    ("RECOMMENDED", "Recommended: revenue, profit and margin are projected to improve."),
    ("NEUTRAL", "Financially neutral: weigh other business factors."),
    ("CAUTION", "Caution: the projected improvement is weak or negative."),
]
ADVICE_OTHERWISE = "Not recommended under the current assumptions."

CHANGES = ["price", "demand", "marketing", "variable_cost", "fixed_cost"]
KNOBS = [f.name for f in fields(Scenario)]


def with_scenarios(baseline: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Every baseline row once per scenario."""
    if not scenarios:
        raise ValueError("no scenarios given")
    table = F.array(*[F.struct(*[
        (F.lit(s.name) if k == "name" else F.lit(float(getattr(s, k)))).alias(k) for k in KNOBS]) for s in scenarios])
    return baseline.select("*", F.inline(table))


def baseline_of(df: DataFrame, segment: str, revenue: str, profit: str) -> DataFrame:
    """Baseline rows (segment, revenue, profit) of a detail table."""
    return df.groupBy(F.col(segment).alias("segment")).agg(
        F.sum(number(df, revenue)).alias("revenue"), F.sum(number(df, profit)).alias("profit"))


def _factor(change: Column) -> Column:
    return F.lit(1.0) + change / 100


def _floored(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def _pct_or_zero(new: Column, old: Column) -> Column:
    return F.coalesce((F.try_divide(new, old) - 1) * 100, F.lit(0.0))


# --- family a ------------------------------------------------------------------------

def project_a(rows: DataFrame) -> DataFrame:
    """Projection of baseline x scenario rows; a baseline without positive
    revenue yields an error row with the lowest score."""
    c = F.col
    ok = c("base_revenue") > 0
    out = (rows.withColumn("base_revenue", safe_float(c("revenue"))).withColumn("base_profit", safe_float(c("profit")))
           .withColumn("base_margin_pct", clip(F.try_divide(c("base_profit"), c("base_revenue")), -1, 1) * 100)
           .withColumn("base_variable", _floored(c("base_revenue") - c("base_profit")))
           .withColumn("base_fixed", _floored(c("base_revenue") - c("base_variable") - c("base_profit")))
           .withColumn("demand_factor", _floored(F.lit(1.0) + c("demand") / 100 + c("elasticity") * c("price") / 100))
           .withColumn("marketing_factor", _floored(F.lit(1.0) + c("marketing") / 100 * c("roi")))
           .withColumn("new_revenue", c("base_revenue") * _floored(_factor(c("price"))) * c("demand_factor")
                       * c("marketing_factor"))
           .withColumn("new_variable_cost", c("base_variable") * _floored(_factor(c("variable_cost")))
                       * c("demand_factor") * c("marketing_factor"))
           .withColumn("new_fixed_cost", c("base_fixed") * _floored(_factor(c("fixed_cost"))))
           .withColumn("new_profit", c("new_revenue") - c("new_variable_cost") - c("new_fixed_cost"))
           .withColumn("revenue_change_pct", _pct_or_zero(c("new_revenue"), c("base_revenue")))
           .withColumn("profit_change_pct", _pct_or_zero(c("new_profit"), c("base_profit")))
           .withColumn("projected_margin_pct",
                       F.coalesce(F.try_divide(c("new_profit"), c("new_revenue")) * 100, F.lit(0.0)))
           .withColumn("margin_change_pct", c("projected_margin_pct") - c("base_margin_pct")))
    kept = [k for k in rows.columns if k not in ("revenue", "profit")]
    score = c("profit_change_pct") * 0.7 + c("revenue_change_pct") * 0.2 + c("margin_change_pct") * 0.1
    spread = c("uncertainty") / 100
    figures = {
        "base_margin_pct": c("base_margin_pct"), "revenue": c("new_revenue"), "profit": c("new_profit"),
        "projected_margin_pct": c("projected_margin_pct"), "revenue_delta": c("new_revenue") - c("base_revenue"),
        "profit_delta": c("new_profit") - c("base_profit"), "revenue_change_pct": c("revenue_change_pct"),
        "profit_change_pct": c("profit_change_pct"), "margin_change_pct": c("margin_change_pct"),
        "new_variable_cost": c("new_variable_cost"), "new_fixed_cost": c("new_fixed_cost"),
        "downside_revenue": c("new_revenue") * (1 - spread), "upside_revenue": c("new_revenue") * (1 + spread),
        "downside_profit": c("new_profit") * (1 - spread), "upside_profit": c("new_profit") * (1 + spread)}
    return out.select(*kept, "base_revenue", "base_profit", *[F.when(ok, v).alias(k) for k, v in figures.items()],
                      F.when(ok, score).otherwise(ERROR_SCORE).alias("decision_score"))


def decide_a(projected: DataFrame) -> DataFrame:
    """Decision band and advice of a family-a projection."""
    score = F.col("decision_score")
    label = F.when(score <= ERROR_SCORE, "ERROR").otherwise(band(
        score, [(10, "STRONGLY_RECOMMENDED"), (3, "RECOMMENDED"), (-3, "NEUTRAL"), (-10, "CAUTION")], "NOT_RECOMMENDED"))
    advice = F.when(F.col("decision") == "ERROR", "Revenue must be greater than zero.")
    for decision, text in ADVICE:
        advice = advice.when(F.col("decision") == decision, text)
    return projected.withColumn("decision", label).withColumn("advice", advice.otherwise(ADVICE_OTHERWISE))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("decision_score"), "name")
    return rows.withColumn("rank", F.row_number().over(order))


def _keys(baseline: DataFrame) -> list[str]:
    return [k for k in baseline.columns if k not in ("revenue", "profit")]


def rank_a(baseline: DataFrame, scenarios: list[Scenario] | None = None) -> DataFrame:
    """Scenarios of every baseline row by descending score. A window group is
    one segment's scenarios, so its size is the number of scenarios."""
    rows = decide_a(project_a(with_scenarios(baseline, scenarios or STANDARD_A)))
    return _ranked(rows, _keys(baseline))


def sensitivity_grid(baseline: DataFrame, price: list[float] | None = None, demand: list[float] | None = None) -> DataFrame:
    """Price x demand grid of every baseline row."""
    cells = [Scenario("Sensitivity", price=p, demand=d) for p in price or GRID_STEPS for d in demand or GRID_STEPS]
    return project_a(with_scenarios(baseline, cells)).select(
        *_keys(baseline), F.col("price").alias("price_change_pct"), F.col("demand").alias("demand_change_pct"),
        "revenue", "profit", "profit_change_pct", "decision_score")


def compare_current_projected(baseline: DataFrame, scenario: Scenario) -> DataFrame:
    """Metric, current, projected and change, a row each for revenue, profit
    and margin of every baseline row."""
    p = project_a(with_scenarios(baseline, [scenario]))
    names = ["Revenue", "Profit", "Margin %"]
    pairs = [("base_revenue", "revenue"), ("base_profit", "profit"), ("base_margin_pct", "projected_margin_pct")]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(a).alias("current"), F.col(b).alias("projected"),
                              (F.col(b) - F.col(a)).alias("change")) for n, (a, b) in zip(names, pairs)])
    return p.select(*_keys(baseline), F.inline(rows))


# --- family b ------------------------------------------------------------------------

def risk_score(revenue_change: Column, profit_change: Column, margin_change: Column) -> Column:
    """0..100 from projected losses and the size of the largest change."""
    largest = F.greatest(*[F.abs(F.col(k)) for k in CHANGES])
    zero = F.lit(0.0)
    parts = (F.when(profit_change < 0, F.least(F.abs(profit_change) * 0.5, F.lit(40.0))).otherwise(zero)
             + F.when(revenue_change < 0, F.least(F.abs(revenue_change) * 0.2, F.lit(20.0))).otherwise(zero)
             + F.when(margin_change < -5, F.least(F.abs(margin_change), F.lit(20.0))).otherwise(zero)
             + F.when(largest > 30, 10.0).otherwise(zero) + F.when(largest > 50, 15.0).otherwise(zero))
    return clip(parts, 0, 100)


def confidence_score() -> Column:
    """0..100, lower the larger the assumed changes."""
    size = sum((F.abs(F.col(k)) for k in CHANGES), F.lit(0.0)) / len(CHANGES)
    return clip(F.lit(100.0) - F.least(size * 0.5, F.lit(35.0))
                - F.when(F.abs("elasticity") > 1, 10.0).otherwise(0.0)
                - F.when(F.abs("roi") > 1, 10.0).otherwise(0.0), 0, 100)


def _revenue_ratio(price: Column, demand: Column, marketing: Column, elasticity: Column, roi: Column) -> Column:
    return (_factor(price) * _floored(F.lit(1.0) + demand / 100 + elasticity * price / 100)
            * _floored(F.lit(1.0) + marketing / 100 * roi))


def project_b(rows: DataFrame) -> DataFrame:
    """Projection with costs scaled by the revenue ratio, plus risk,
    confidence, score and decision."""
    c = F.col
    ratio = _revenue_ratio(*[c(k) for k in ("price", "demand", "marketing", "elasticity", "roi")])
    out = (rows.withColumn("base_revenue", _floored(safe_float(c("revenue"))))
           .withColumn("base_profit", safe_float(c("profit")))
           .withColumn("base_margin", F.coalesce(F.try_divide(c("base_profit"), c("base_revenue")), F.lit(0.0)))
           .withColumn("base_variable", c("base_revenue") * (1 - c("base_margin")))
           .withColumn("base_fixed", _floored(c("base_revenue") - c("base_variable") - c("base_profit")))
           .withColumn("new_revenue", c("base_revenue") * ratio)
           .withColumn("ratio", F.coalesce(F.try_divide(c("new_revenue"), c("base_revenue")), F.lit(1.0)))
           .withColumn("new_profit", c("new_revenue") - c("base_variable") * _factor(c("variable_cost")) * c("ratio")
                       - c("base_fixed") * _factor(c("fixed_cost")))
           .withColumn("margin_pct", F.coalesce(F.try_divide(c("new_profit"), c("new_revenue")) * 100, F.lit(0.0)))
           .withColumn("revenue_change_pct", _pct_or_zero(c("new_revenue"), c("base_revenue")))
           .withColumn("profit_change_pct", F.when(F.abs("base_profit") > 1e-12, _pct_or_zero(
               c("new_profit"), c("base_profit"))).otherwise(0.0))
           .withColumn("margin_change_pct", c("margin_pct") - c("base_margin") * 100)
           .withColumn("risk_score", risk_score(c("revenue_change_pct"), c("profit_change_pct"), c("margin_change_pct")))
           .withColumn("confidence_score", confidence_score())
           .withColumn("decision_score", c("profit_change_pct") * 0.55 + c("revenue_change_pct") * 0.25
                       + c("margin_change_pct") * 0.20 - c("risk_score") * 0.15))
    kept = [k for k in rows.columns if k not in ("revenue", "profit")]
    return decide_b(out.select(
        *kept, "base_revenue", "base_profit", c("new_revenue").alias("revenue"), c("new_profit").alias("profit"),
        "margin_pct", "revenue_change_pct", "profit_change_pct", "margin_change_pct", "risk_score",
        "confidence_score", "decision_score"))


def decide_b(projected: DataFrame) -> DataFrame:
    """Decision band of a family-b projection."""
    return projected.withColumn("decision", band(
        F.col("decision_score"), [(15, "STRONGLY RECOMMENDED"), (5, "RECOMMENDED"), (0, "NEUTRAL"), (-10, "CAUTION")],
        "NOT RECOMMENDED"))


def rank_b(baseline: DataFrame, scenarios: list[Scenario] | None = None) -> DataFrame:
    """Scenarios of every baseline row with their rank, best first."""
    return _ranked(project_b(with_scenarios(baseline, scenarios or GENERATED_B)), _keys(baseline))


def sensitivity_1d(baseline: DataFrame, variable: str = "price", values: list[float] | None = None) -> DataFrame:
    """One variable changed in steps, everything else held."""
    if variable not in SENSITIVITY_VARIABLES:
        raise ValueError(f"unsupported sensitivity variable: {variable}")
    steps = [Scenario(f"{variable}_{v}", **{variable: v}) for v in (GRID_STEPS if values is None else values)]
    return project_b(with_scenarios(baseline, steps)).select(
        *_keys(baseline), F.lit(variable).alias("variable"), F.col(variable).alias("change_pct"),
        "revenue", "profit", "margin_pct", "profit_change_pct", "risk_score")


def break_even_price(baseline: DataFrame) -> DataFrame:
    """The keys of the baseline and :func:`_break_even` of each row."""
    return baseline.select(*_keys(baseline), _break_even().alias("break_even_price_change_pct"))


def _break_even() -> Column:
    """First of the 2001 price steps from -50 % to +50 % whose profit, at two
    decimals, reaches the baseline profit; 0 if none does or revenue is not
    positive. The steps are an array inside the row, so nothing is shuffled."""
    revenue, profit = _floored(safe_float(F.col("revenue"))), safe_float(F.col("profit"))
    margin = F.coalesce(F.try_divide(profit, revenue), F.lit(0.0))
    base = Scenario("break-even")
    zero = F.lit(0.0)
    width = (BREAK_EVEN_HIGH - BREAK_EVEN_LOW) / (BREAK_EVEN_STEPS - 1)

    def step(i: Column) -> Column:
        return F.lit(BREAK_EVEN_LOW) + i * F.lit(width)

    def projected(i: Column) -> Column:
        new = revenue * _revenue_ratio(step(i), zero, zero, F.lit(base.elasticity), F.lit(base.roi))
        ratio = F.coalesce(F.try_divide(new, revenue), F.lit(1.0))
        return F.round(new - revenue * (1 - margin) * ratio, 2)

    hits = F.filter(F.sequence(F.lit(0), F.lit(BREAK_EVEN_STEPS - 1)), lambda i: projected(i) >= profit)
    at = F.when(safe_float(F.col("revenue")) > 0, F.round(step(F.get(hits, F.lit(0))), 2))
    return F.coalesce(at, zero)


def decision_report(baseline: DataFrame, scenarios: list[Scenario] | None = None) -> DataFrame:
    """Per baseline row: best and worst scenario, mean profit change, mean
    risk, break-even price change and the recommendation."""
    keys = _keys(baseline)
    # Break-even depends on the row alone, so it is carried along instead of joined.
    rows = baseline.withColumns({"break_even_price_change_pct": _break_even(), "row__": F.monotonically_increasing_id()})
    ranked = rank_b(rows, scenarios)
    best = F.struct(*[F.col(k) for k in ("name", "decision_score", "profit_change_pct", "risk_score")])
    summary = ranked.groupBy(*_keys(rows)).agg(
        F.count(F.lit(1)).alias("scenario_count"), F.min_by(best, "rank").alias("best"),
        F.max_by(best, "rank").alias("worst"), F.avg("profit_change_pct").alias("average_profit_change_pct"),
        F.avg("risk_score").alias("average_risk_score"), F.max("base_revenue").alias("base_revenue"),
        F.max("base_profit").alias("base_profit"))
    score = F.col("best.decision_score")
    text = (F.when(score >= 10, F.format_string("Prioritize '%s': expected profit impact %.2f%%, risk %.1f/100.",
                                                F.col("best.name"), F.col("best.profit_change_pct"), F.col("best.risk_score")))
            .when(score >= 0, F.format_string("'%s' is the strongest scenario, with limited benefit.", F.col("best.name")))
            .otherwise("No tested scenario improves the outcome enough for its risk."))
    return summary.select(
        *keys, "base_revenue", "base_profit", "scenario_count", F.col("best.name").alias("best_scenario"),
        score.alias("best_score"), F.col("worst.name").alias("worst_scenario"),
        F.col("worst.decision_score").alias("worst_score"), "average_profit_change_pct", "average_risk_score",
        "break_even_price_change_pct", text.alias("recommendation"))


def decision_package(df: DataFrame, health: DataFrame, risks: DataFrame) -> DataFrame:
    """One row: the table's business metrics, its decision report, and the
    confidence left after health and risks (5 points each, at most 25)."""
    one = F.lit(1).alias("one")
    metrics = business_metrics(df)
    usable = metrics.filter("total_revenue > 0").select(
        F.col("total_revenue").alias("revenue"), F.col("total_profit").alias("profit"))
    report = decision_report(usable).select(one, "*")
    score = health.select(one, F.col("score").alias("data_health_score"))
    count = risks.agg(F.count(F.lit(1)).alias("risk_count")).select(one, "risk_count")
    share = F.when(F.col("data_health_score") != 0, F.col("data_health_score") / 100).otherwise(1.0)
    confidence = clip(F.lit(100.0) * share - F.least(F.col("risk_count") * 5.0, F.lit(25.0)), 0, 100)
    joined = metrics.select(one, "*").join(report, "one", "left").join(score, "one").join(count, "one")
    return joined.select(
        F.when(F.col("best_scenario").isNull(), "insufficient_business_metrics").otherwise("success").alias("status"),
        "total_revenue", "total_profit", "profit_margin", F.coalesce("scenario_count", F.lit(0)).alias("scenario_count"),
        "best_scenario", "best_score", "worst_scenario", "average_profit_change_pct", "average_risk_score",
        F.coalesce("break_even_price_change_pct", F.lit(0.0)).alias("break_even_price_change_pct"),
        confidence.alias("confidence_score"), "data_health_score", "risk_count",
        F.coalesce("recommendation", F.lit("No revenue metric was found for a decision projection.")).alias("recommendation"))
