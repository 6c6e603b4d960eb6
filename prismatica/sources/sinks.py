"""Sinks: tables, CSV exports and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from prismatica.functions.coerce import col
from prismatica.functions.columns import canonical


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Write in parallel, one file per partition; nothing is coalesced."""
    df.write.mode(mode).format(format).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, quotes doubled inside quoted values."""
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def report_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, payload): every result row as one JSON object; NaN and
    infinities are written as nulls."""
    parts = [
        canonical(df).select(F.lit(name).alias("section"), F.to_json(
            F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("payload"))
        for name, df in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_report_json(sections: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """The sections of a report as JSON lines, one folder per section."""
    report_rows(sections).write.mode(mode).partitionBy("section").json(path)
