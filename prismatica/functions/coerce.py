"""Scalar expressions: coercion, guards, bands and date parts.

Spark runs in ANSI mode, where a bad cast or a zero divisor stops the job, so
everything that touches data here uses the ``try_`` forms.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from prismatica.functions.vocabulary import DATE_FORMATS, ISO_SHAPE, MISSING_SEGMENT

INFINITY = float("inf")


def col(name: str) -> Column:
    """Reference a column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_number(c: Column) -> Column:
    """Double value of ``c``; NULL where it does not parse."""
    return c.try_cast("double")


def to_time(c: Column, formats: list[tuple[str, str]] | None = None) -> Column:
    """Timestamp value of ``c``; NULL where no listed form fits.

    The shape of the text picks the one format to try, so text that is not a
    date costs a few pattern tests and never a failed parse per format.
    """
    text = F.trim(c.cast("string"))
    chain = F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp"))
    for shape, fmt in formats or DATE_FORMATS:
        chain = chain.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
    return chain


def finite(c: Column) -> Column:
    """``c`` with NaN and both infinities turned into NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INFINITY)), c)


def safe_float(c: Column, default: float = 0.0) -> Column:
    """Finite double value of ``c``, or ``default``."""
    return F.coalesce(finite(to_number(c)), F.lit(float(default)))


def date_parts(c: Column, prefix: str) -> dict[str, Column]:
    """Year, month, day and weekday (Monday = 0) of a timestamp."""
    return {
        f"{prefix}__year": F.year(c),
        f"{prefix}__month": F.month(c),
        f"{prefix}__day": F.dayofmonth(c),
        f"{prefix}__dayofweek": F.weekday(c),
    }


def pct_change(new: Column, old: Column) -> Column:
    """(new - old) / |old| * 100; NULL where old is 0."""
    return F.try_divide(new - old, F.abs(old)) * 100


def ratio_eps(a: Column, b: Column) -> Column:
    """a / (|b| + 1e-9)."""
    return a / (F.abs(b) + F.lit(1e-9))


def clip(c: Column, low: float, high: float) -> Column:
    """``c`` held inside [low, high]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def band(c: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first threshold that ``c`` reaches, highest first."""
    (first, label), *rest = steps
    chain = F.when(c >= F.lit(float(first)), F.lit(label))
    for bound, text in rest:
        chain = chain.when(c >= F.lit(float(bound)), F.lit(text))
    return chain.otherwise(F.lit(otherwise))


def text_key(c: Column) -> Column:
    """Segment label of ``c``; missing values share one explicit label."""
    return F.coalesce(c.cast("string"), F.lit(MISSING_SEGMENT))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100; 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100, F.lit(0.0))


def shown(c: Column, digits: int) -> Column:
    """``c`` rounded for presentation, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
