"""Results that must not move with partitioning or skew, and plan shapes."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from prismatica.functions import quantiles as Z
from prismatica.operators import clean as K, groups as G, profile as P, stats as S, trend as R
from conftest import rows_of

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def shapes(spark):
    n = spark.range(40_000)
    return n.select(
        F.col("id").cast("double").alias("even"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")).alias("hot"),
        F.exp(F.pmod(F.xxhash64("id"), F.lit(600)).cast("double")).alias("heavy"),
        F.when(F.col("id") % 2 == 0, F.pmod(F.xxhash64("id"), F.lit(5)).cast("double")).alias("few"),
        F.lit(3.0).alias("flat"), F.lit(None).cast("double").alias("none"))


@pytest.mark.parametrize("rows, cells, k", [(1 << 20, 8192, 800), (50, 16, 800), (0, 64, 8)])
def test_quantiles_equal_percentile(spark, monkeypatch, rows, cells, k):
    """Whatever the bound on what a round counts by value, the number of rounds or the quality of the sketch."""
    monkeypatch.setattr(Z, "ROWS", rows)
    monkeypatch.setattr(Z, "CELLS", cells)
    monkeypatch.setattr(Z, "K", k)
    df = shapes(spark).repartition(7)
    got = {r["column"]: r for r in Z.quantiles(df, [(c, F.col(c)) for c in df.columns], PROBS).collect()}
    want = df.agg(*[F.percentile(c, F.lit(PROBS)).alias(c) for c in df.columns]).first()
    for c in df.columns:
        values = [got[c][f"q{i}"] for i in range(len(PROBS))]
        assert values == pytest.approx(want[c]) if want[c] else values == [None] * len(PROBS), c


def test_a_rank_outside_its_bracket_is_still_found(spark, monkeypatch):
    """Sketches that bracket the wrong place cost time, not correctness."""
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    got = Z.order_statistics(df, [("v", F.col("v"))], [Z.Rank("n - 10", 0.1)]).first()
    assert got["v0"] == 4990 and got["below0"] == 4990 and got["same0"] == 1


def test_sketches_merge_in_two_levels(spark, monkeypatch):
    """No task merges the sketches of all tasks: each merges those of FAN neighbours, one the results."""
    df = spark.range(0, 64_000, 1, 64).select(F.col("id").cast("double").alias("v"))
    seen = {}
    for fan in (8, 10**9):
        monkeypatch.setattr(Z, "FAN", fan)
        found = Z.sketches(df.select(F.lit(0).alias("col_no"), "v"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "kll_merge_agg_double" in plan and "kll_sketch_agg_double" in plan and "hashpartitioning" in plan and "AS part" in plan
        parts = (df.select(F.spark_partition_id().alias("task")).distinct().groupBy(F.expr(f"task div {fan}")).count().collect())
        seen[fan] = (len(parts), max(r[1] for r in parts))
        at = found.select(F.expr("kll_sketch_get_n_double(sketch)"), F.expr("kll_sketch_get_quantile_double(sketch, 0.5D)")).first()
        assert at[0] == 64_000 and abs(at[1] - 32_000) < 64_000 * Z.PAD
    assert seen[8] == (8, 8) and seen[10**9] == (1, 64)


def test_a_hot_value_costs_one_row(spark):
    """A value that fills its bracket is one group, however many rows hold it."""
    df = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, 5.5).otherwise(F.col("id") / 7).alias("v"))
    got = Z.order_statistics(df, [("v", F.col("v"))], [Z.Rank("n div 2", 0.5)]).first()
    assert got["v0"] == 5.5 or got["same0"] == 1
    assert got["n"] == 300_000 and got["below0"] <= 150_000 < got["below0"] + got["same0"]


def test_extreme_and_close_values_end(spark):
    values = [-1.7e308, 1.7e308, 5e-324, 0.0, -0.0, 1.0, 1.0 + 2**-52, 1e-300] * 3
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = Z.quantiles(df, [("v", F.col("v"))], [0.0, 0.3, 0.5, 1.0]).first()
    assert (got["q0"], got["q3"], got["n"]) == (-1.7e308, 1.7e308, 24) and got["q1"] == 0.0


def test_repartitioning_changes_nothing(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = o.repartition(1), o.repartition(13, "o_custkey")
    for op in (lambda d: P.profile(d), lambda d: S.outliers(d), lambda d: S.categorical_summary(d),
               lambda d: G.max_row(d, "o_totalprice", ["o_orderkey"]), lambda d: P.schema_report(d)):
        assert rows_of(op(a)) == rows_of(op(b))
    x, y = (R.half_over_half_trend(d, "o_orderdate", "o_totalprice").first()["change_pct"] for d in (a, b))
    assert x == pytest.approx(y)


def test_trend_with_a_third_of_the_rows_on_one_date(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-06-01")).otherwise(
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int")), "yyyy-MM-dd")).alias("order_date"),
        F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("y"))
    pdf = df.toPandas().sort_values(["order_date", "y"])
    half = len(pdf) // 2
    first, second = pdf["y"][:half].mean(), pdf["y"][half:].mean()
    got = R.half_over_half_trend(df, "order_date", "y").first()
    assert got["first_mean"] == pytest.approx(first) and got["second_mean"] == pytest.approx(second)


def test_shares_and_scores_stay_in_range(spark, sf_dir):
    sales = entry_module.QUERIES["a11_segment_drivers_all"](spark, sf_dir)
    for r in sales.groupBy("dimension").agg(F.sum("share_of_total").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0, abs=1e-6)
    risk = entry_module.QUERIES["d6_risk_score"](spark, sf_dir)
    assert risk.filter("risk_score < 0 or risk_score > 100").count() == 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = plan_of(G.metric_by_dimension(li, "l_returnflag", "l_quantity"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
    assert plan.count("FileScan") == 1 and "Python" not in plan


def test_drivers_use_one_scan_per_pass_and_no_cross_join(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = plan_of(G.segment_drivers(o, "o_totalprice", ["o_orderstatus", "o_orderpriority"]))
    assert "Expand" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["t1_numeric_summary", "t10_outliers", "p1_profile", "a12_segment_concentration", "d9_rank_b"])
def test_no_python_and_no_cartesian_product_in_hot_paths(spark, sf_dir, name):
    plan = plan_of(entry_module.QUERIES[name](spark, sf_dir))
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["q1_missing_by_column", "q2_missing_total", "q13_validate"])
def test_gaps_are_counted_without_a_shuffle_of_values(spark, sf_dir, name):
    found = [n for n in entry_module.QUERIES if n.startswith(name.split("_")[0] + "_")]
    for one in found:
        plan = plan_of(entry_module.QUERIES[one](spark, sf_dir))
        keys = [line.split("Exchange hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert set(keys) <= {"col_no"} and "sha2" not in plan, one


def test_long_padded_dates_are_dates(spark):
    """The date test sees the whole text, whatever its length."""
    rows = [(f"2024-01-{d:02d}" + " " * pad,) for d in range(1, 29) for pad in (0, 35, 70, 200)]
    df = spark.createDataFrame(rows, "seen string")
    assert P.infer_roles(df).first()["role"] == "date"
    assert P.datetime_columns(df).first()["parse_rate"] == 1.0
    assert P.column_facts(df).first()["dated"] == len(rows) and P.column_facts(df).first()["distinct"] == len(rows)


def test_problem_type_hands_on_a_few_values_per_task(spark):
    df = spark.range(0, 100_000, 1, 16).select(F.col("id").alias("many"), (F.col("id") % 10).alias("ten"), (F.col("id") % 11).alias("eleven"),
                                               F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 7, float("nan")).otherwise(1.5).alias("one"))
    got = {c: P.problem_type(df, c).first() for c in df.columns}
    assert {c: (r["distinct_up_to_11"], r["problem_type"]) for c, r in got.items()} == {
        "many": (11, "regression"), "ten": (10, "classification"), "eleven": (11, "regression"), "none": (0, "unusable"), "one": (1, "classification")}
    assert P.few_values(df, F.col("many"), 11).count() == 11
    plan = plan_of(P.problem_type(df, "many"))
    assert plan.index("MapInArrow") > plan.index("Exchange")  # the tasks cut before anything is shuffled


def test_most_frequent_texts_without_a_text_as_key(spark):
    """Long texts that tie and start alike, a short winner that is a long one's start, and all kinds of gaps."""
    start = "x" * 64
    rows = ([(start + "b", start, "p" * 100 + str(i), None, i % 2 == 0) for i in range(6)] + [(start + "a", start, "q", None, None)] * 6
            + [("y" * 70, start + "z", "q", None, True)] * 5 + [(None, start + "z", None, None, True)] * 7)
    df = spark.createDataFrame(rows, "far string, near string, most string, none string, flag boolean").repartition(5)
    got = {r["column"]: (r["count"], r["unique"], r["top"], r["top_count"]) for r in S.categorical_summary(df).collect()}
    assert got == {"far": (17, 3, start + "a", 6), "near": (24, 2, start, 12), "most": (17, 7, "q", 11), "flag": (18, 2, "true", 15)}
    assert {r["col_no"]: r["s"] for r in K.modes(df, ["far", "near", "most"]).collect()} == {0: start + "a", 1: start, 2: "q"}
    assert S.categorical_summary(spark.createDataFrame([("u" * 99 + c,) for c in "dacb"], "s string")).first()["top"] == "u" * 99 + "a"
    assert S.categorical_summary(df.limit(0)).count() == 0


def test_no_whole_text_is_counted_by(spark, sf_dir):
    """The first 64 characters and a digest are keys; the text is one only of an aggregate's value."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    plan = plan_of(S.categorical_summary(docs))
    keys = " ".join(line for line in plan.splitlines() if "hashpartitioning(" in line)
    assert "digest#" in keys and " s#" not in keys and "(s#" not in keys
    want = docs.groupBy("text").count().orderBy(F.desc("count"), "text").filter("text is not null").first()
    got = S.categorical_summary(docs).first()
    assert (got["top"], got["top_count"]) == (want["text"], want["count"])


@pytest.mark.parametrize("name", ["f4_trend_findings", "f11_headline_ratios", "f9_analyze_drivers", "d13_decision_package"])
def test_the_joined_view_is_computed_once(spark, sf_dir, name):
    """What the query returns reads the settled view, not the join behind it."""
    from __spark_entry__ import queries
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "lineitem.parquet" not in plan and "l_extendedprice" not in plan


@pytest.mark.parametrize("name", ["f9_analyze", "f9_analyze_drivers"])
def test_an_analysis_reads_single_columns_of_the_settled_view(spark, sf_dir, name):
    """A checkpoint is read whole by each of some twenty passes; these scans name the columns they read."""
    from __spark_entry__ import queries
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in "\n".join(line for line in plan.splitlines() if "order_key" in line)
    assert "parquet" in plan and "lineitem.parquet" not in plan


def test_facts_and_samples_taken_apart_by_type(spark):
    """The same rows as from one scan: gaps, zeros of both signs, NaN, long texts and dates, nested and empty columns."""
    long = "2024-01-05" + " " * 70
    rows = [(i % 5, float("nan") if i % 4 == 0 else -0.0 if i % 4 == 1 else i / 4, None if i % 3 == 0 else "é" * (i % 2 * 70 + 1) + str(i % 7),
             long + " " * (i % 2), i % 6 == 0 if i % 5 else None, [i % 3], None, f"2024-02-0{i % 8 + 1}") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, d double, s string, t string, b boolean, a array<int>, n string, w string").withColumns({
        "day": F.to_date("w"), "at": F.to_timestamp("w"), "dec": F.col("k").cast("decimal(9,2)")}).repartition(5)
    for some in (df, df.limit(0), df.select("k"), df.select("s", "n")):
        assert sorted(P.column_facts(some, apart=True).collect()) == sorted(P.column_facts(some).collect())
        assert sorted(P.smallest_values(some, 3, apart=True).collect()) == sorted(P.smallest_values(some, 3).collect())
        shared = P.BaseProfile.of(some, persist=True)
        assert sorted(P.datetime_columns(some, shared=shared).collect()) == sorted(P.datetime_columns(some).collect())
        for c in some.columns:
            same = [sorted(map(repr, S.target_analysis(some, c, facts=f).collect())) for f in (None, shared.facts)]
            assert same[0] == same[1], c
        shared.release()


def test_dates_become_labels_once_a_segment(spark):
    """Rows are grouped by the date itself; a missing one and equal labels are one segment."""
    df = spark.createDataFrame([("(a)", 1.0, 0), ("b", None, 1), (None, 3.0, 1), ("b", 5.0, None)], "s string, y double, i int").withColumns({
        "at": F.timestamp_seconds(F.col("i") * 86400), "flag": F.col("i") == 1}).drop("i")
    plan = plan_of(G.segment_concentration(df, "y"))
    assert "Expand" in plan and "cast(at#" not in plan.split("Expand")[-1]
    rows = G._segments(df, F.col("y"), ["s", "at", "flag"]).collect()
    got = {(r["dimension"], r["segment"]): (r["sum"], r["mean"], r["count"]) for r in rows}
    label = next(s for d, s in got if d == "flag" and s not in ("true", "false"))
    assert got == {(None, None): (9.0, 3.0, 3), ("s", "(a)"): (1.0, 1.0, 1), ("s", "b"): (5.0, 5.0, 1), ("s", label): (3.0, 3.0, 1),
                   ("at", "1970-01-01 00:00:00"): (1.0, 1.0, 1), ("at", "1970-01-02 00:00:00"): (3.0, 3.0, 1), ("at", label): (5.0, 5.0, 1),
                   ("flag", "false"): (1.0, 1.0, 1), ("flag", "true"): (3.0, 3.0, 1), ("flag", label): (5.0, 5.0, 1)} and len(rows) == len(got)


def test_the_guarded_analysis_reads_single_columns_of_the_settled_view(spark, sf_dir, monkeypatch):
    from prismatica.plans import analyze as A
    seen, whole = [], A.analyze_computed
    monkeypatch.setattr(A, "analyze_computed", lambda df, *a, **k: (seen.append(df), whole(df.limit(5), *a, **k))[1])
    assert entry_module.QUERIES["f9_analyze_sections"](spark, sf_dir).count() == 16
    plan = plan_of(seen[0].select("revenue"))
    assert "ReadSchema: struct<revenue:double>" in plan and "ExistingRDD" not in plan


def test_passes_taken_apart_give_the_same_rows(spark):
    """Hashes before rows, samples off the facts, ends where the first key has its own, a scan for each column: the same
    rows as without, with gaps, zeros of both signs, NaN, long texts, copies, rows that share a hash only and no rows."""
    rows = [(i % 4 if i % 9 else None, float("nan") if i % 4 == 0 else -0.0 if i % 8 == 1 else 0.0 if i % 4 == 1 else i / 4,
             None if i % 3 == 0 else "é" * (i % 2 * 70 + 1) + str(i % 7), "abc"[i % 3], i % 6 == 0 if i % 5 else None, None)
            for i in range(60)] + [(1, 0.0, "x", "c", True, None), (1, -0.0, "x", "c", True, None), (None, None, "7", None, None, None), (None, None, None, "7", None, None)]
    df = spark.createDataFrame(rows, "k int, d double, s string, t string, b boolean, n double").withColumn("at", F.timestamp_seconds("k")).repartition(5)

    def flat(found):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in map(lambda r: tuple(map(lambda x: "" if x is None else x, r)), found.collect()))

    for some in (df.localCheckpoint(), df.limit(0).localCheckpoint(), df.unionByName(df).select("d", "t", "at").localCheckpoint()):
        assert P.duplicates(some, apart=True).collect() == P.duplicates(some).collect()
        shared = P.BaseProfile.of(some, persist=True)
        assert flat(P.schema_report(some, shared)) == flat(P.schema_report(some))
        known = {r["column"]: r["least"] for r in shared.facts.collect()}
        assert known.get("t") in (None, ["a", "b", "c"], ["7", "a", "b"]) and known.get("s") is known.get("d") is None
        shared.release()
        assert flat(S.numeric_profile(some, apart=True)) == flat(S.numeric_profile(some))
        for order in (["at", "k"], ["d", "t"]):
            order = [c for c in order if c in some.columns] or some.columns
            assert flat(G.kpi_table_b(some, order, apart=True)) == flat(G.kpi_table_b(some, order)), order
        assert flat(G.segment_drivers(some, some.columns[0], top_n=99, apart=True)) == flat(G.segment_drivers(some, some.columns[0], top_n=99))


def test_an_analysis_compares_no_whole_rows_without_need(spark):
    """Rows whose hashes differ are not shuffled whole, and texts whose counts are known are not scanned for samples."""
    from prismatica.plans import analyze as A
    df = spark.range(500).selectExpr("id", "id / 7 AS x", "cast(id % 9 AS string) AS s")
    shared = A._Shared(df, "x")
    assert shared.base.dups.first() == (500, 0)
    assert "Range" not in "\n".join(line for line in plan_of(P.duplicates(df, apart=True)).splitlines() if "hashpartitioning" in line)
    assert "xxhash64" not in plan_of(P.duplicates(df, apart=True))
    assert {r["column"]: r["least"] for r in shared.base.facts.collect()} == {"id": None, "x": None, "s": ["0", "1", "2"]}
    assert "MapInArrow" not in plan_of(P.smallest_values(df.select("s"), 3, apart=True, facts=P.column_facts(df.select("s"), apart=True, least=3).localCheckpoint()))
    shared.base.release()
