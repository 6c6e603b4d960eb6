"""Sources: tables by extension, CSV with its guards, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from prismatica.functions.coerce import col

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


class LoadError(ValueError):
    """The path has no supported format, or the table has no content."""


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip blanks and a byte-order mark from the column names."""
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header, quotes doubled inside quoted values. ``multi_line`` reads line
    breaks inside quotes too; files are then not split among tasks. Without a given encoding UTF-8 is tried first and
    Latin-1 where the text holds bytes UTF-8 cannot decode. An explicit
    ``schema`` saves the scan that infers types."""
    def read(enc: str) -> DataFrame:
        r = spark.read.option("header", True).option("encoding", enc).option("mode", "PERMISSIVE").options(
            quote='"', escape='"', multiLine=multi_line)
        return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)

    df = read(encoding or "UTF-8")
    if encoding is None and _undecodable(spark, path):
        df = read("ISO-8859-1")
    return assert_loadable(normalize_columns(df))


def _undecodable(spark: SparkSession, path: str) -> bool:
    """Whether any line is not UTF-8. This reads the text up to the first such
    line, all of it if there is none; a given ``encoding`` saves the scan."""
    return not spark.read.text(path).filter("not is_valid_utf8(value)").isEmpty()


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool | None = None,
         multi_line: bool = False) -> DataFrame:
    """A table by the extension of its path: csv, json or parquet. ``lines`` tells whether
    JSON has one record per line or an array per file; where it is not given, any file that
    begins with a bracket means arrays. ``multi_line`` is that of :func:`read_csv`."""
    suffix = next((s for s in FORMATS if path.lower().rstrip("/").endswith(s)), None)
    if suffix is None:
        raise LoadError(f"unsupported file format: {path}")
    if suffix == ".csv":
        return read_csv(spark, path, schema, multi_line=multi_line)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == ".json":
        if lines is None:
            starts = spark.read.text(path, wholetext=False).filter(F.ltrim(F.substring("value", 1, 64)).startswith("["))
            lines = starts.isEmpty()
        df = reader.json(path, multiLine=not lines)
    else:
        df = reader.parquet(path)
    return assert_loadable(normalize_columns(df))


def assert_loadable(df: DataFrame | None) -> DataFrame:
    """The table itself, or an error if it has no columns or no rows."""
    if df is None:
        raise LoadError("no dataset was loaded")
    if not df.columns:
        raise LoadError("dataset contains no columns")
    if df.isEmpty():
        raise LoadError("dataset contains no rows")
    return df


def preview(df: DataFrame, rows: int = 100, columns: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The first rows (and columns); in a fixed order if ``order_by`` is given."""
    out = df.select(*[col(c) for c in df.columns[:columns]]) if columns else df
    return (df.orderBy(*[col(c) for c in order_by]).select(*[col(c) for c in out.columns]) if order_by else out).limit(rows)
