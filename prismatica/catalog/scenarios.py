"""Scenario projection (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismatica.catalog.registry import BASELINE_SQL, COPIES_SQL, SALES_SQL, query, r, rounded
from prismatica.operators import quality as Q, scenario as S
from prismatica.operators.profile import BaseProfile
from prismatica.operators.scenario import GENERATED_B, GRID_STEPS, STANDARD_A, Scenario
from prismatica.plans.settle import settled

ONE = Scenario("Plan", price=5, marketing=10)


def scenario_table(scenarios: list[Scenario]) -> str:
    rows = ", ".join("('" + s.name + "', " + ", ".join(
        f"CAST({getattr(s, k)} AS DOUBLE)" for k in S.KNOBS[1:]) + ")" for s in scenarios)
    return f"sc(name, {', '.join(S.KNOBS[1:])}) AS (VALUES {rows})"


# Baselines include one segment without revenue, to show the error row.
BASE = BASELINE_SQL + ", base AS (SELECT * FROM baseline UNION ALL SELECT 'EMPTY', 0.0, 0.0)"


def base(t):
    b = t("baseline")
    empty = t("region").agg(F.lit("EMPTY").alias("segment"), F.lit(0.0).alias("revenue"), F.lit(0.0).alias("profit"))
    return b.unionByName(empty)


PROJECT_A = """
f AS (SELECT segment, revenue AS r0, profit AS p0, sc.*, greatest(revenue - profit, 0) AS vc,
        greatest(revenue - greatest(revenue - profit, 0) - profit, 0) AS fc,
        greatest(1 + price / 100, 0) AS pf, greatest(1 + demand / 100 + elasticity * price / 100, 0) AS df,
        greatest(1 + marketing / 100 * roi, 0) AS mf FROM base CROSS JOIN sc),
g AS (SELECT *, r0 * pf * df * mf AS r1, r0 * pf * df * mf - vc * greatest(1 + variable_cost / 100, 0) * df * mf
        - fc * greatest(1 + fixed_cost / 100, 0) AS p1 FROM f),
h AS (SELECT *, (r1 / r0 - 1) * 100 AS dr, CASE WHEN p0 <> 0 THEN (p1 / p0 - 1) * 100 ELSE 0 END AS dp,
        CASE WHEN r1 <> 0 THEN p1 / r1 * 100 ELSE 0 END - least(greatest(p0 / r0, -1), 1) * 100 AS dm FROM g),
a AS (SELECT *, CASE WHEN r0 > 0 THEN dp * 0.7 + dr * 0.2 + dm * 0.1 ELSE -999999 END AS score FROM h)
"""
PROJECT_B = """
f AS (SELECT segment, greatest(revenue, 0) AS r0, profit AS p0, sc.*, CASE WHEN revenue <> 0 THEN profit / revenue ELSE 0 END AS mg,
        (1 + price / 100) * greatest(1 + demand / 100 + elasticity * price / 100, 0) * greatest(1 + marketing / 100 * roi, 0) AS q FROM base CROSS JOIN sc),
g AS (SELECT *, r0 * q AS r1, r0 * q - r0 * (1 - mg) * (1 + variable_cost / 100) * (CASE WHEN r0 <> 0 THEN q ELSE 1 END)
        - greatest(r0 - r0 * (1 - mg) - p0, 0) * (1 + fixed_cost / 100) AS p1 FROM f),
h AS (SELECT *, CASE WHEN r1 <> 0 THEN p1 / r1 * 100 ELSE 0 END AS m1, CASE WHEN r0 <> 0 THEN (r1 / r0 - 1) * 100 ELSE 0 END AS dr,
        CASE WHEN abs(p0) > 1e-12 THEN (p1 / p0 - 1) * 100 ELSE 0 END AS dp,
        CASE WHEN r1 <> 0 THEN p1 / r1 * 100 ELSE 0 END - mg * 100 AS dm,
        greatest(abs(price), abs(demand), abs(marketing), abs(variable_cost), abs(fixed_cost)) AS big FROM g),
i AS (SELECT *, least(greatest(CASE WHEN dp < 0 THEN least(abs(dp) * 0.5, 40) ELSE 0 END + CASE WHEN dr < 0 THEN least(abs(dr) * 0.2, 20) ELSE 0 END
        + CASE WHEN dm < -5 THEN least(abs(dm), 20) ELSE 0 END + CASE WHEN big > 30 THEN 10 ELSE 0 END + CASE WHEN big > 50 THEN 15 ELSE 0 END, 0), 100) AS risk,
        100 - least((abs(price) + abs(demand) + abs(marketing) + abs(variable_cost) + abs(fixed_cost)) / 5 * 0.5, 35) AS conf FROM h),
b AS (SELECT *, dp * 0.55 + dr * 0.25 + dm * 0.2 - risk * 0.15 AS score FROM i)
"""


def sql_a(scenarios: list[Scenario], body: str, view: str = BASE) -> str:
    return f"WITH {view}, {scenario_table(scenarios)}, {PROJECT_A} {body}"


def sql_b(scenarios: list[Scenario], body: str, view: str = BASE) -> str:
    return f"WITH {view}, {scenario_table(scenarios)}, {PROJECT_B} {body}"


@query("d1_project_a", sql_a(STANDARD_A, """SELECT segment, name, round(r1, 2) AS revenue, round(p1, 2) AS profit, round(dr, 4) + 0.0 AS revenue_change_pct,
round(dp, 4) + 0.0 AS profit_change_pct, round(dm, 4) + 0.0 AS margin_change_pct, round(r1 * (1 - uncertainty / 100), 2) AS downside_revenue,
round(p1 * (1 + uncertainty / 100), 2) AS upside_profit FROM a WHERE r0 > 0 UNION ALL SELECT segment, name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM a WHERE r0 <= 0"""))
def d1(t):
    p = S.project_a(S.with_scenarios(base(t), STANDARD_A))
    return rounded(p.select("segment", "name", "revenue", "profit", "revenue_change_pct", "profit_change_pct", "margin_change_pct",
                            "downside_revenue", "upside_profit"), 4, revenue=2, profit=2, downside_revenue=2, upside_profit=2)


DECISION_A = ("CASE WHEN r0 <= 0 THEN 'ERROR' WHEN score >= 10 THEN 'STRONGLY_RECOMMENDED' WHEN score >= 3 THEN 'RECOMMENDED' "
              "WHEN score >= -3 THEN 'NEUTRAL' WHEN score >= -10 THEN 'CAUTION' ELSE 'NOT_RECOMMENDED' END")


@query("d2_decide_a", sql_a(STANDARD_A, f"SELECT segment, name, round(score, 4) + 0.0 AS decision_score, {DECISION_A} AS decision FROM a"))
def d2(t):
    p = S.decide_a(S.project_a(S.with_scenarios(base(t), STANDARD_A)))
    return rounded(p.select("segment", "name", "decision_score", "decision"))


@query("d3_rank_a", sql_a(STANDARD_A, """SELECT segment, name, round(score, 4) + 0.0 AS decision_score,
row_number() OVER (PARTITION BY segment ORDER BY score DESC, name)::INT AS "rank" FROM a"""))
def d3(t):
    return rounded(S.rank_a(base(t)).select("segment", "name", "decision_score", "rank"))


GRID = [Scenario("Sensitivity", price=p, demand=d) for p in GRID_STEPS for d in GRID_STEPS]


@query("d4_sensitivity_grid", sql_a(GRID, """SELECT segment, price AS price_change_pct, demand AS demand_change_pct, round(r1, 2) AS revenue, round(p1, 2) AS profit,
round(dp, 4) + 0.0 AS profit_change_pct, round(score, 4) + 0.0 AS decision_score FROM a""", BASELINE_SQL.replace("baseline AS", "base AS")))
def d4(t):
    return rounded(S.sensitivity_grid(t("baseline")), 4, revenue=2, profit=2)


@query("d5_project_b", sql_b(GENERATED_B, """SELECT segment, name, round(r1, 2) AS revenue, round(p1, 2) AS profit, round(m1, 4) AS margin_pct,
round(dr, 4) + 0.0 AS revenue_change_pct, round(dp, 4) + 0.0 AS profit_change_pct, round(dm, 4) + 0.0 AS margin_change_pct FROM b"""))
def d5(t):
    p = S.project_b(S.with_scenarios(base(t), GENERATED_B))
    return rounded(p.select("segment", "name", "revenue", "profit", "margin_pct", "revenue_change_pct", "profit_change_pct", "margin_change_pct"),
                   4, revenue=2, profit=2)


@query("d6_risk_score", sql_b(GENERATED_B, "SELECT segment, name, round(risk, 4) + 0.0 AS risk_score FROM b"))
def d6(t):
    return rounded(S.project_b(S.with_scenarios(base(t), GENERATED_B)).select("segment", "name", "risk_score"))


@query("d7_confidence_score", sql_b(GENERATED_B, "SELECT segment, name, round(conf, 4) AS confidence_score FROM b"))
def d7(t):
    return rounded(S.project_b(S.with_scenarios(base(t), GENERATED_B)).select("segment", "name", "confidence_score"))


@query("d8_decide_b", sql_b(GENERATED_B, """SELECT segment, name, round(score, 4) + 0.0 AS decision_score, CASE WHEN score >= 15 THEN 'STRONGLY RECOMMENDED'
WHEN score >= 5 THEN 'RECOMMENDED' WHEN score >= 0 THEN 'NEUTRAL' WHEN score >= -10 THEN 'CAUTION' ELSE 'NOT RECOMMENDED' END AS decision FROM b""",
    BASELINE_SQL.replace("baseline AS", "base AS")))
def d8(t):
    return rounded(S.project_b(S.with_scenarios(t("baseline"), GENERATED_B)).select("segment", "name", "decision_score", "decision"))


@query("d9_rank_b", sql_b(GENERATED_B, """SELECT segment, name, round(score, 4) + 0.0 AS decision_score,
row_number() OVER (PARTITION BY segment ORDER BY score DESC, name)::INT AS "rank" FROM b""", BASELINE_SQL.replace("baseline AS", "base AS")))
def d9(t):
    return rounded(S.rank_b(t("baseline")).select("segment", "name", "decision_score", "rank"))


STEPS = [Scenario(f"{v}_{x}", **{v: x}) for v in S.SENSITIVITY_VARIABLES for x in GRID_STEPS]


@query("d10_sensitivity_1d", sql_b(STEPS, """SELECT segment, regexp_replace(name, '_-?[0-9]+$', '') AS variable,
price + demand + marketing + variable_cost + fixed_cost AS change_pct, round(r1, 2) AS revenue, round(p1, 2) AS profit, round(m1, 4) AS margin_pct,
round(dp, 4) + 0.0 AS profit_change_pct, round(risk, 4) + 0.0 AS risk_score FROM b""", BASELINE_SQL.replace("baseline AS", "base AS")))
def d10(t):
    from prismatica.operators.groups import union_results
    return rounded(union_results([S.sensitivity_1d(t("baseline"), v) for v in S.SENSITIVITY_VARIABLES]), 4, revenue=2, profit=2)


# The profit whose last digits decide the step is rounded to whole cents first,
# so that both engines compare the same baseline.
CENTS = BASELINE_SQL + ", base AS (SELECT segment, round(revenue, 2) AS revenue, round(profit, 2) AS profit FROM baseline)"


@query("d11_break_even_price", f"""WITH {CENTS}, st AS (SELECT -50.0::DOUBLE + i * 0.05::DOUBLE AS c FROM range(2001) t(i)),
x AS (SELECT segment, c, profit, revenue * (1 + c / 100) * greatest(1 - 0.3::DOUBLE * c / 100, 0) AS r1, revenue, profit / revenue AS mg FROM base CROSS JOIN st WHERE revenue > 0)
SELECT segment, round(coalesce(min(c) FILTER (WHERE round(r1 - revenue * (1 - mg) * (r1 / revenue), 2) >= profit), 0), 2) + 0.0 AS break_even_price_change_pct
FROM x GROUP BY segment""")
def d11(t):
    cents = t("baseline").select("segment", F.round("revenue", 2).alias("revenue"), F.round("profit", 2).alias("profit"))
    return rounded(S.break_even_price(cents), 2)


@query("d12_decision_report", f"WITH {BASELINE_SQL.replace('baseline AS', 'base AS')}, {scenario_table(GENERATED_B)}, {PROJECT_B}" + """
SELECT segment, count(*) AS scenario_count, arg_max(name, score) AS best_scenario, round(max(score), 4) AS best_score, arg_min(name, score) AS worst_scenario,
round(min(score), 4) AS worst_score, round(avg(dp), 4) AS average_profit_change_pct, round(avg(risk), 4) AS average_risk_score FROM b GROUP BY segment""")
def d12(t):
    d = S.decision_report(t("baseline"))
    return rounded(d.select("segment", "scenario_count", "best_scenario", "best_score", "worst_scenario", "worst_score",
                            "average_profit_change_pct", "average_risk_score"))


ONE_BASE = SALES_SQL + ", base AS (SELECT 'all' AS segment, sum(revenue) AS revenue, sum(profit) AS profit FROM sales)"


@query("d13_decision_package", f"WITH {ONE_BASE}, {scenario_table(GENERATED_B)}, {PROJECT_B}" + """
SELECT 'success' AS status, round(max(r0), 2) AS total_revenue, round(max(p0), 2) AS total_profit, count(*) AS scenario_count, arg_max(name, score) AS best_scenario,
round(avg(dp), 4) AS average_profit_change_pct, round(avg(risk), 4) AS average_risk_score, 100.0::DOUBLE AS data_health_score,
100.0::DOUBLE - least(5.0 * (SELECT count(*) FROM (SELECT sum((profit < q1 - 1.5 * (q3 - q1) OR profit > q3 + 1.5 * (q3 - q1))::INT) AS h, count(*) AS n
  FROM sales, (SELECT quantile_cont(profit, 0.25) AS q1, quantile_cont(profit, 0.75) AS q3 FROM sales)) WHERE h * 100.0 / n >= 5), 25.0) AS confidence_score FROM b""")
def d13(t):
    s = settled(t("sales"))  # a join that the health, the risks and the package read
    base = BaseProfile.of(s, persist=True)
    p = S.decision_package(s, Q.health_score_b(s, base), Q.risk_register(s, limit=None, shared=base))
    return rounded(p.select("status", "total_revenue", "total_profit", "scenario_count", "best_scenario", "average_profit_change_pct",
                            "average_risk_score", "data_health_score", "confidence_score"), 4, total_revenue=2, total_profit=2)


@query("d14_compare_current_projected", sql_a([ONE], """SELECT segment, 'Revenue' AS metric, round(r0, 2) AS current, round(r1, 2) AS projected, round(r1 - r0, 2) AS change FROM a
UNION ALL SELECT segment, 'Profit', round(p0, 2), round(p1, 2), round(p1 - p0, 2) FROM a
UNION ALL SELECT segment, 'Margin %', round(p0 / r0 * 100, 2), round(p1 / r1 * 100, 2), round(dm, 2) FROM a""", BASELINE_SQL.replace("baseline AS", "base AS")))
def d14(t):
    return rounded(S.compare_current_projected(t("baseline"), ONE), 2)
