"""The full analysis of a table, and the short one."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismatica.functions.coerce import col
from prismatica.functions.columns import dtype_of, kind_of, resolve_target, type_partition
from prismatica.operators import clean, findings, groups, profile, quality, stats
from prismatica.operators.profile import BaseProfile
from prismatica.plans.settle import settled
from prismatica.sources.readers import assert_loadable, normalize_columns


@dataclass
class Analysis:
    """Named sections, each a lazy tidy DataFrame; small shared results stay
    persisted until :meth:`release`."""

    sections: dict[str, DataFrame]
    target: str | None
    kept: list = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.sections[name]

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


def _unavailable(spark: SparkSession, failure: Exception) -> DataFrame:
    return spark.createDataFrame([("unavailable", _reason(failure))], "status string, error string")


def _reason(failure: Exception) -> str:
    """The first line of what went wrong."""
    return (str(failure).strip() or type(failure).__name__).splitlines()[0]


def _guarded(spark: SparkSession, build) -> DataFrame:
    """A section that cannot be planned is reported as a row instead of
    stopping the analysis."""
    try:
        return build()
    except Exception as failure:
        return _unavailable(spark, failure)


def unreadable_columns(df: DataFrame) -> dict[str, str]:
    """The columns whose values cannot be computed (a failing cast or function behind
    them), with the reason. One job where all can be; else halves are tried, so a bad
    column among k costs some 2 log k jobs."""
    def tried(names: list[str]) -> dict[str, str]:
        try:
            hashes = [F.xxhash64(col(c).cast("string") if kind_of(dtype_of(df, c)) == "complex" else col(c)) for c in names]
            df.agg(*[F.bit_xor(h) for h in hashes]).collect()
            return {}
        except Exception as failure:
            if len(names) == 1:
                return {names[0]: _reason(failure)}
        half = len(names) // 2
        return {**tried(names[:half]), **tried(names[half:])}
    return tried(df.columns) if df.columns else {}


class _Shared:
    """What several sections read. Each part is planned when first asked for, so one
    that cannot be planned takes only the sections that need it along; it has a row per
    column, pair or risk and is persisted, so it costs its scans once."""

    def __init__(self, data: DataFrame, goal: str | None):
        self.data, self.goal, self.kept = data, goal, []

    def _keep(self, df):
        self.kept.append(df)
        return df

    @cached_property
    def base(self) -> BaseProfile:
        found = self._keep(BaseProfile.of(self.data, persist=True))
        found.facts  # asked for by several sections, and the counts are read off them
        return found

    @cached_property
    def figures(self) -> DataFrame:
        return self._keep(stats.numeric_profile(self.data, apart=True).persist())

    @cached_property
    def fences(self) -> DataFrame:
        return self._keep(stats.outliers(self.data, profiled=self.figures).persist())

    @cached_property
    def pairs(self) -> DataFrame:
        return self._keep(stats.top_correlations(self.data).persist())

    @cached_property
    def health(self) -> DataFrame:
        return quality.health_score_b(self.data, self.base)

    @cached_property
    def ready(self) -> DataFrame:
        return quality.ml_readiness(self.data, self.goal, self.base)

    @cached_property
    def risks(self) -> DataFrame:
        return self._keep(quality.risk_register(self.data, limit=None, shared=self.base, bounds=self.fences).persist())

    @cached_property
    def facts(self) -> DataFrame:
        return findings.overview(self.data, self.goal, self.health, self.risks, self.fences, self.pairs, self.ready)


def analyze(df: DataFrame, target: str | None = None, order_by: list[str] | None = None, top_n: int = 10) -> Analysis:
    """Every section of the analysis of ``df``, lazily; see :func:`analyze_computed`
    for one whose sections cannot fail later.

    ``order_by`` is the row order the growth figures refer to (all columns, in schema
    order, if not given).
    """
    data = assert_loadable(normalize_columns(df))
    quality.check_names(data)
    return _sections(data, resolve_target(data, target), order_by or data.columns, top_n)


def _sections(data: DataFrame, goal: str | None, order: list[str], top_n: int) -> Analysis:
    s = _Shared(data, goal)
    builds = {
        "metadata": lambda: profile.dataset_metadata(data, goal, s.base),
        "health": lambda: s.health,
        "quality": lambda: quality.quality_report(data, s.base),
        "schema": lambda: profile.schema_report(data, s.base),
        "correlations": lambda: s.pairs,
        "outliers": lambda: s.fences,
        "distributions": lambda: stats.distribution_shape(data, profiled=s.figures),
        "risks": lambda: s.risks.limit(50),  # what is shown; counts use all
        "kpis": lambda: groups.kpi_table_b(data, order, s.figures, apart=True),
        "ml_readiness": lambda: s.ready,
        "executive_summary": lambda: findings.executive_summary(s.facts),
        "recommendations": lambda: findings.recommendations(s.facts),
        "columns": lambda: type_partition(data),
        "datetime_columns": lambda: profile.datetime_columns(data, shared=s.base),
    }
    if goal is not None:
        builds["drivers"] = lambda: groups.segment_drivers(data, goal, top_n=top_n, apart=True)
        builds["target_analysis"] = lambda: stats.target_analysis(data, goal, profiled=s.figures, facts=s.base.facts)
    return Analysis({name: _guarded(data.sparkSession, build) for name, build in builds.items()}, goal, s.kept)


def analyze_computed(df: DataFrame, target: str | None = None, order_by: list[str] | None = None, top_n: int = 10) -> Analysis:
    """Like :func:`analyze`, with each section computed here and by itself, and one section
    more: ``status`` (part, name, status, rows, error), a row for each section and for each
    column left out.

    A column whose values cannot be computed is left out of the analysis and named there, so
    the sections on the others stay whole; if it is the target, the sections on the target are
    unavailable. A section that fails, while it is planned or while it runs, has the row
    (unavailable, error) instead of its own. The sections are small tables and are settled;
    shared parts are released when they are done.
    """
    data = assert_loadable(normalize_columns(df))
    quality.check_names(data)
    spark = data.sparkSession
    lost = unreadable_columns(data)
    if len(lost) == len(data.columns):
        raise ValueError(f"no column of the table can be read: {next(iter(lost.values()))}")
    goal, whole = resolve_target(data, target), data.drop(*lost)
    found = _sections(whole, None if goal in lost else goal, [c for c in order_by or data.columns if c not in lost], top_n)
    if goal in lost:
        gone = _unavailable(spark, ValueError(f"target {goal}: {lost[goal]}"))
        found.sections |= {"drivers": gone, "target_analysis": gone}
    computed, states = {}, []
    for name, section in found.sections.items():
        error = None
        try:
            kept = settled(section)
            rows = kept.count()
            if kept.columns == ["status", "error"]:
                error, rows = kept.first()["error"], 0
        except Exception as failure:
            error, rows = _reason(failure), 0
            kept = _unavailable(spark, failure)
        computed[name] = kept
        states.append(("section", name, "unavailable" if error else "ok", rows, error))
    found.release()
    states += [("column", name, "left out", None, reason) for name, reason in lost.items()]
    computed["status"] = spark.createDataFrame(states, "part string, name string, status string, rows long, error string")
    return Analysis(computed, goal, list(computed.values()))


def analyze_simple(df: DataFrame) -> Analysis:
    """Profile, issues, the cleaned table, its KPIs and statements."""
    data = assert_loadable(df)
    base = BaseProfile.of(data, persist=True)
    cleaned = settled(clean.clean(data))
    return Analysis({
        "profile": profile.profile(data, base),
        "dataset": profile.dataset_profile(data, base),
        "issues": quality.quality_issues(data, base),
        "cleaned": cleaned,
        "kpis": groups.kpi_table_a(cleaned),
        "business_kpis": groups.business_kpis(cleaned),
        "statements": findings.dataset_statements(data, cleaned, base),
    }, None, [base])


def insight_report(df: DataFrame, max_dims: int | None = None) -> Analysis:
    """All findings and their roll-up; the findings are few and persisted."""
    found = findings.all_findings(df, max_dims=max_dims).persist()
    return Analysis({"findings": found.orderBy("seq"), "rollup": findings.findings_rollup(found)}, None, [found])
