"""Column discovery on the schema alone (no job runs here), and the typed
expressions the operators read columns through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prismatica.functions import vocabulary as V
from prismatica.functions.coerce import col, finite, to_number, to_time

_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
_TEXTUAL = (T.StringType, T.CharType, T.VarcharType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def _named(df: DataFrame, kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; booleans are not numbers."""
    return _named(df, T.NumericType)


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return _named(df, _TEXTUAL)


def boolean_columns(df: DataFrame) -> list[str]:
    return _named(df, T.BooleanType)


def temporal_columns(df: DataFrame) -> list[str]:
    return _named(df, _TEMPORAL)


def type_partition(df: DataFrame) -> DataFrame:
    """One row per column: its position, name and numeric / datetime /
    boolean / categorical class."""
    rows = [(i, f.name, kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "col_no int, column string, kind string")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, _TEMPORAL):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _TEXTUAL):
        return "categorical"
    return "complex"


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN and infinities as NULL and nested types as JSON."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, _FLOATING):
        return finite(col(name))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(col(name))
    return col(name)


def number(df: DataFrame, name: str) -> Column:
    """The column as a finite double, whatever its type."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, T.IntegralType):
        return col(name).cast("double")
    if isinstance(dtype, (*_FLOATING, T.DecimalType)):
        return finite(col(name).cast("double"))
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("double")
    if isinstance(dtype, _TEXTUAL):
        return finite(to_number(col(name)))
    return F.lit(None).cast("double")


def moment(df: DataFrame, name: str) -> Column:
    """The column as a timestamp, whatever its type."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, _TEMPORAL):
        return col(name).cast("timestamp")
    if isinstance(dtype, _TEXTUAL):
        return to_time(col(name))
    return F.lit(None).cast("timestamp")


def canonical(df: DataFrame) -> DataFrame:
    """Every column through :func:`value`, names unchanged."""
    return df.select(*[value(df, c).alias(c) for c in df.columns])


# --- finders -----------------------------------------------------------------

def resolve_target(df: DataFrame, target: str | None = None) -> str | None:
    """The asked column (exact, then any case), else the first conventional
    target name present, else None."""
    by_lower: dict[str, str] = {}
    for name in df.columns:
        by_lower.setdefault(name.lower(), name)
    if target:
        if target in df.columns:
            return target
        if target.lower() in by_lower:
            return by_lower[target.lower()]
    return next((by_lower[n] for n in V.PREFERRED_TARGETS if n in by_lower), None)


def find_column(df: DataFrame, words: list[str], strategy: str = "column_order") -> str | None:
    """First column whose name matches one of ``words``.

    ``column_order``  first column, left to right, that contains any word;
    ``exact_first``   a whole-name match in word order, else column_order;
    ``word_order``    first word, in list order, contained in any column.
    """
    names = [(c, c.strip().lower()) for c in df.columns]
    words = [w.lower() for w in words]
    if strategy == "word_order":
        pairs = ((c, w, low) for w in words for c, low in names)
        return next((c for c, w, low in pairs if w in low), None)
    if strategy == "exact_first":
        whole = dict((low, c) for c, low in reversed(names))
        for w in words:
            if w in whole:
                return whole[w]
    elif strategy != "column_order":
        raise ValueError(f"unknown strategy: {strategy}")
    return next((c for c, low in names if any(w in low for w in words)), None)


def target_candidates(df: DataFrame) -> DataFrame:
    """Numeric columns ranked by how many target words their name holds."""
    scored = [
        (sum(w in c.lower() for w in V.TARGET_WORDS), i, c)
        for i, c in enumerate(numeric_columns(df))
    ]
    ranked = sorted((s for s in scored if s[0] > 0), key=lambda s: (-s[0], s[1]))
    rows = [(r + 1, c, hits) for r, (hits, _, c) in enumerate(ranked)]
    return df.sparkSession.createDataFrame(rows, "rank int, column string, hits int")


def prediction_target_default(df: DataFrame) -> str:
    """First column named like a prediction target, else the last column."""
    return find_column(df, V.PREDICTION_TARGET_WORDS) or df.columns[-1]
