"""Cleaning: duplicate removal, date promotion, imputation, drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from prismatica.functions import vocabulary as V
from prismatica.functions.coerce import col
from prismatica.functions.columns import (
    canonical, dtype_of, kind_of, moment, non_numeric_columns, number, numeric_columns, value)
from prismatica.functions.quantiles import quantiles
from prismatica.functions.tidy import column_rows, most_frequent
from prismatica.plans.settle import settled
from prismatica.sources.readers import normalize_columns


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One copy of every row as it is; NaN and missing count as the same value."""
    names = [f"k__{i}" for i in range(len(df.columns))]
    keyed = df.select(*[col(c) for c in df.columns], *[value(df, c).alias(k) for c, k in zip(df.columns, names)])
    return keyed.dropDuplicates(names).select(*[col(c) for c in df.columns])


def date_parse_rates(df: DataFrame) -> DataFrame:
    """Share of all rows that parse as a date, per text column whose name
    speaks of a date or time."""
    asked = [c for c in df.columns if any(w in c.lower() for w in V.DATE_PROMOTION_WORDS)
             and kind_of(dtype_of(df, c)) == "categorical"]
    if not asked:
        return df.sparkSession.createDataFrame([], "col_no int, column string, parse_rate double")
    return column_rows(df, [(c, {"parse_rate": F.avg(moment(df, c).isNotNull().cast("double"))}) for c in asked],
                       [df.columns.index(c) for c in asked])


def promote_dates(df: DataFrame, min_rate: float = 0.7) -> DataFrame:
    """Text columns named like dates become timestamps if enough rows parse.

    The output schema depends on the data, so one aggregate runs here; what it
    returns is one number per candidate column.
    """
    good = [r["column"] for r in date_parse_rates(df).filter(F.col("parse_rate") >= min_rate).collect()]
    return df.withColumns({c: moment(df, c) for c in good}) if good else df


def medians(df: DataFrame) -> DataFrame:
    """Median of every numeric column."""
    return quantiles(df, [(c, number(df, c)) for c in numeric_columns(df)], [0.5]).select(
        "col_no", "column", F.col("q0").alias("fill"))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value of every listed column, the smallest of a tie."""
    return most_frequent(df, columns).select("col_no", "l", "s")


def impute_median(df: DataFrame) -> DataFrame:
    """Missing numbers become their column's median; integers turn double.

    Like a fitted imputer: one number per column reaches the driver and is
    filled in as a literal, so the pass over the rows stays a projection."""
    names = numeric_columns(df)
    if not names:
        return df
    fills = {r["column"]: r["fill"] for r in medians(df).collect()}
    return df.withColumns({c: number(df, c) if fills[c] is None else F.coalesce(number(df, c), F.lit(fills[c]))
                           for c in names})


def impute_mode(df: DataFrame, default: str = "Unknown") -> DataFrame:
    """Missing non-numbers become their column's mode; text without any value
    becomes ``default``. One value per column reaches the driver."""
    names = [c for c in non_numeric_columns(df) if kind_of(dtype_of(df, c)) != "complex"]
    if not names:
        return df
    found = {names[r["col_no"]]: r for r in modes(df, names).collect()}
    new = {}
    for c in names:
        dtype, top = dtype_of(df, c), found.get(c)
        if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
            fill = F.lit(top["s"] if top else default)
        elif top is None:
            continue
        elif isinstance(dtype, T.BooleanType):
            fill = F.lit(bool(top["l"]))
        elif isinstance(dtype, T.DateType):
            fill = F.date_from_unix_date(F.lit(top["l"]).cast("int"))
        else:
            fill = F.timestamp_micros(F.lit(top["l"])).cast(dtype)
        new[c] = F.coalesce(value(df, c), fill)
    return df.withColumns(new) if new else df


def clean(df: DataFrame) -> DataFrame:
    """Trim names, drop duplicate rows, promote dates, fill medians and modes;
    the statistics are those of the de-duplicated rows, which later passes
    read several times and which are therefore settled once."""
    return impute_mode(impute_median(promote_dates(settled(drop_duplicates(normalize_columns(df))))))


def drop_missing(df: DataFrame, subset: list[str] | None = None, how: str = "any",
                 empty_columns: bool = False) -> DataFrame:
    """Drop rows with missing values (``any`` or ``all`` of ``subset``), and
    with ``empty_columns`` the columns that hold no value at all."""
    if how not in ("any", "all", "columns"):
        raise ValueError(f"how must be any, all or columns, not {how}")
    out = df
    if empty_columns:
        some = column_rows(df, [(c, {"n": F.count(value(df, c))}) for c in df.columns])
        gone = {r["column"] for r in some.filter("n = 0").collect()}
        out = df.select(*[col(c) for c in df.columns if c not in gone])
        if subset is None and how == "columns":
            return out
    asked = [c for c in (out.columns if subset is None else subset)]
    if not asked:
        return out
    there = [value(out, c).isNotNull() for c in asked]
    keep = there[0]
    for one in there[1:]:
        keep = keep & one if how == "any" else keep | one
    return out.filter(keep)
