"""Exact quantiles of many columns with bounded memory.

Spark's ``percentile`` keeps every distinct value of a column in one task. Here
a first scan builds a KLL sketch per column, a few KB whatever the column holds;
sketches are merged in two levels, first those of up to 512 neighbouring tasks,
then the results. The sketch brackets each wanted rank between two values.

Each further scan counts, exactly, what lies below and inside the brackets. A
bracket of up to a million rows is counted by value, which settles the rank. A
larger one is cut into cells, the cell that holds the rank is the bracket of
the next scan, and so on; a wrong guess costs one more scan and no wrong result.
Cells have equal widths, or equal ratios where a bracket spans many orders of
magnitude, so seven rounds reach single values whatever the distribution. The
last round holds at most a million values per rank; nothing grows with the table
but the number of rounds.

Sketches and rounds run at once, like fitting a model: what reaches the driver
is one row per column or per rank. The other aggregates of a column are lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from prismatica.functions.tidy import ALONE

# Size of a sketch, and twice the error of the ranks it gives: 2.296 / K ** 0.9723.
K, PAD = 800, 0.007
# Tasks whose sketches are merged in the first of two levels.
FAN = 512
# Cells of a bracket, and rows from which on it is cut into them.
CELLS, ROWS = 8192, 1 << 20
# The cell of equal ratio: 746 is beyond -ln of the least double.
RATIO_CELL = "cast(floor(CASE WHEN v = 0 THEN 0.0D ELSE 2 * signum(v) * (ln(abs(v)) + 746) END) AS double)"


@dataclass(frozen=True)
class Rank:
    """A wanted 0-based rank, an SQL expression over the number of values
    ``n``, and the share of the values at which it lies."""

    sql: str
    near: float


@dataclass(frozen=True)
class Bracket:
    """Values between which a rank is sought; ``exact`` counts each value."""

    low: float
    high: float
    exact: bool

    @property
    def ratios(self) -> bool:
        """Whether cells of equal ratios cut it better than such of equal widths."""
        return self.low < 0 < self.high or not 1e-6 < abs(self.low or 0.0) / max(abs(self.high), 5e-324) < 1e6


def _long(df: DataFrame, values: list[tuple[str, Column]]) -> DataFrame:
    """(col_no, v): one row per value."""
    numbers = [str(i) for i in range(len(values))]
    return (df.select(*[v.alias(i) for i, (_, v) in zip(numbers, values)]).unpivot([], numbers, "col_no", "v")
            .selectExpr("cast(col_no as int) AS col_no", "v"))


def sketches(cells: DataFrame) -> DataFrame:
    """(col_no, sketch) of the columns that hold values."""
    parts = (cells.filter("v is not null").selectExpr("col_no", f"spark_partition_id() div {FAN} AS part", "v")
             .groupBy("col_no", "part").agg(F.expr(f"kll_sketch_agg_double(v, {K})").alias("sketch")))
    return parts.groupBy("col_no").agg(F.expr(f"kll_merge_agg_double(sketch, {K})").alias("sketch"))


def _side_by_side(df: DataFrame, values: list[tuple[str, Column]]) -> DataFrame:
    """The rows of :func:`sketches`, those of all columns filled from each row at once, which copies no row."""
    parts = (df.select(F.expr(f"spark_partition_id() div {FAN} AS part"), *[v.alias(f"v{i}") for i, (_, v) in enumerate(values)])
             .groupBy("part").agg(*[F.expr(f"kll_sketch_agg_double(v{i}, {K})").alias(f"s{i}") for i in range(len(values))]))
    filled = parts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("col_no"), F.col(f"s{i}").alias("sketch")) for i in range(len(values))])))
    return (filled.filter("kll_sketch_get_n_double(sketch) > 0")
            .groupBy("col_no").agg(F.expr(f"kll_merge_agg_double(sketch, {K})").alias("sketch")))


def _sketched(found: DataFrame, points: list[float]) -> dict[int, tuple[int, list[float]]]:
    """By column of ``sketches``: how many values it has, and those near ``points``."""
    asked = F.array(*[F.lit(float(p)) for p in points])
    found = found.select("col_no", F.expr("kll_sketch_get_n_double(sketch)").alias("n"),
                                   F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), asked).alias("at"))
    return {r["col_no"]: (r["n"], list(r["at"])) for r in found.collect()}


def _counted(cells: DataFrame, brackets: dict[int, list[Bracket]], ranks: list[tuple[int, int, int]]) -> list:
    """One scan: per (col_no, rank_no, rank) the group of equal values, or the
    cell or gap, that holds the rank, with the number of values before it."""
    spark, most = cells.sparkSession, max(map(len, brackets.values()))
    fields = ", ".join(f"lo{t} double, hi{t} double, exact{t} boolean, ratios{t} boolean" for t in range(most))
    bounds = spark.createDataFrame(
        [(no, *[x for b in bs for x in (b.low, b.high, b.exact, b.ratios)], *[None] * 4 * (most - len(bs))) for no, bs in brackets.items()],
        f"col_no int, {fields}")
    # Slot 2t + 1 is bracket t, even slots are the gaps around them.
    slot = key = "CASE"
    for t in range(most):
        share = f"coalesce(try_divide(v / 2 - lo{t} / 2, hi{t} / 2 - lo{t} / 2), 0.0D)"
        slot += f" WHEN v < lo{t} THEN {2 * t} WHEN v <= hi{t} THEN {2 * t + 1}"
        key += (f" WHEN v < lo{t} THEN 0.0D WHEN v <= hi{t} THEN CASE WHEN exact{t} THEN v WHEN ratios{t} THEN {RATIO_CELL} "
                f"ELSE cast(floor({share} * {CELLS - 1}) AS double) END")
    tally = (cells.join(F.broadcast(bounds), "col_no")
             .selectExpr("col_no", f"{slot} ELSE {2 * most} END AS slot", f"{key} ELSE 0.0D END AS key", "v")
             .groupBy("col_no", "slot", "key").agg(F.expr("count(1) AS size"), F.expr("min(v) AS first"), F.expr("max(v) AS last")))
    wanted = spark.createDataFrame(ranks, "col_no int, rank_no int, rank long")
    # The window holds the cells of a column's brackets, or their values: at most ROWS per bracket.
    before = tally.selectExpr("*", "coalesce(sum(size) OVER (PARTITION BY col_no ORDER BY slot, key "
                                   "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    return (before.join(F.broadcast(wanted), "col_no").filter("rank >= before AND rank < before + size")
            .select("col_no", "rank_no", "rank", "before", "size", "first", "last").collect())


def _settled(cells: DataFrame, ranks: list[tuple[int, int, int]], guess: dict[tuple[int, int], Bracket]) -> dict[tuple[int, int], tuple]:
    """(value, smaller values, equal values) by (col_no, rank_no)."""
    done = {}
    while ranks:
        brackets = {no: sorted({guess[c, i] for c, i, _ in ranks if c == no}, key=lambda b: (b.low, b.high))
                    for no in {c for c, _, _ in ranks}}
        left = []
        for r in _counted(cells, brackets, ranks):
            at = (r["col_no"], r["rank_no"])
            if r["first"] == r["last"]:
                done[at] = (r["first"], r["before"], r["size"])
            else:
                stuck = (guess[at].low, guess[at].high) == (r["first"], r["last"])
                guess[at] = Bracket(r["first"], r["last"], r["size"] <= ROWS or stuck)
                left.append((*at, r["rank"]))
        ranks = left
    return done


def ranked(cells: DataFrame, ranks: list[Rank], sketched: DataFrame | None = None) -> tuple[dict[int, tuple[int, float, float]], dict[tuple[int, int], tuple[float, int, int]]]:
    """Of (col_no, v) rows, whatever a col_no stands for: (n, least, greatest) by col_no, and (value, smaller
    values, equal values) by col_no and number of the rank. NULLs are left out. The sketches may be given."""
    spark = cells.sparkSession
    shares = sorted({p for r in ranks for p in (r.near - PAD, r.near + PAD)})
    known = _sketched(sketches(cells) if sketched is None else sketched, [0.0, 1.0, *[min(max(p, 0.0), 1.0) for p in shares]])
    places = {p: i + 2 for i, p in enumerate(shares)}
    sizes = spark.createDataFrame([(no, n) for no, (n, _) in known.items()], "col_no int, n long")
    wanted = [(r["col_no"], i, r[f"r{i}"]) for r in sizes.select(
        "col_no", *[F.expr(f"cast({r.sql} AS bigint)").alias(f"r{i}") for i, r in enumerate(ranks)]).collect() for i in range(len(ranks))]
    guess = {(no, i): Bracket(at[places[r.near - PAD]], at[places[r.near + PAD]], 4 * PAD * n <= ROWS)
             for no, (n, at) in known.items() for i, r in enumerate(ranks)}
    found = _settled(cells.filter("v is not null"), [w for w in wanted if w[2] is not None], guess)
    return {no: (n, at[0], at[1]) for no, (n, at) in known.items()}, found


def order_statistics(df: DataFrame, values: list[tuple[str, Column]], ranks: list[Rank],
                     extras: Callable[[Column], dict[str, Column]] | None = None, apart: bool = False) -> DataFrame:
    """One row per entry of ``values``: col_no, column, n, low, high, the
    ``extras`` aggregates, and per rank i the value ``v{i}`` at that rank, the
    count ``below{i}`` of smaller and ``same{i}`` of equal values. NULLs are
    left out."""
    apart = apart and len(values) <= ALONE
    known, found = ranked(_long(df, values), ranks, _side_by_side(df, values) if apart else None)
    rows = [(no, name, *known.get(no, (0, None, None)), *[x for i in range(len(ranks)) for x in found.get((no, i), (None,) * 3)])
            for no, (name, _) in enumerate(values)]
    return _with_extras(df, values, extras, df.sparkSession.createDataFrame(
        rows, "col_no int, column string, n long, low double, high double" + "".join(
            f", v{i} double, below{i} long, same{i} long" for i in range(len(ranks)))), apart)


def _with_extras(df: DataFrame, values: list[tuple[str, Column]], extras: Callable[[Column], dict[str, Column]] | None, out: DataFrame,
                 apart: bool = False) -> DataFrame:
    """Their aggregates have a pass of their own: next to a sketch they would run interpreted. ``apart``
    takes one of each column, which copies no row; for tables that are cheap to read again."""
    if not extras:
        return out
    if apart:
        parts = [df.select(v.alias("v")).agg(F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in extras(F.col("v")).items()])
                 .filter("rows > 0").drop("rows").withColumn("col_no", F.lit(no)) for no, (_, v) in enumerate(values)]
        more = parts[0]
        for part in parts[1:]:
            more = more.unionByName(part)
        return out.join(F.broadcast(more), "col_no", "left").select(*out.columns, *[c for c in more.columns if c != "col_no"])
    more = _long(df, values).groupBy("col_no").agg(*[c.alias(k) for k, c in extras(F.col("v")).items()])
    return out.join(F.broadcast(more), "col_no", "left")


def quantiles(df: DataFrame, values: list[tuple[str, Column]], probs: list[float],
              extras: Callable[[Column], dict[str, Column]] | None = None,
              approx: bool = False, apart: bool = False) -> DataFrame:
    """Per entry of ``values``: col_no, column, n, low, high, the ``extras``
    and ``q{i}``, the linearly interpolated quantile of ``probs[i]``.

    ``approx`` stops after the first scan and returns sketch values. ``apart``
    fills the sketches side by side and takes the extras of each column by a scan of its own.
    """
    if approx:
        known, none = _sketched(sketches(_long(df, values)), [0.0, 1.0, *probs]), (0, [None] * (len(probs) + 2))
        rows = [(no, name, known.get(no, none)[0], *known.get(no, none)[1]) for no, (name, _) in enumerate(values)]
        return _with_extras(df, values, extras, df.sparkSession.createDataFrame(
            rows, "col_no int, column string, n long, low double, high double" + "".join(f", q{i} double" for i in range(len(probs)))))
    ranks = [Rank(f"{way}((n - 1) * {p!r}D)", p) for p in probs for way in ("floor", "ceil")]
    found = order_statistics(df, values, ranks, extras, apart)
    names = [c for c in found.columns if c.rstrip("0123456789") not in ("v", "below", "same")]
    return found.select(*names, *[
        F.expr(f"v{2 * i} + (v{2 * i + 1} - v{2 * i}) * ((n - 1) * {p!r}D - floor((n - 1) * {p!r}D)) AS q{i}")
        for i, p in enumerate(probs)])
