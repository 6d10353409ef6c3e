"""Scalar column builders: coercion, text rules, time, guarded arithmetic, pressure identities.

Missing is NULL everywhere; NaN and infinities become NULL on the way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column | str) -> Column:
    """Double; what is no finite number becomes null."""
    d = F.expr(f"try_cast(`{x}` as double)") if isinstance(x, str) else x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def integer(x: Column) -> Column:
    """Long of a number or its text; bad text and non-finite numbers become null."""
    return number(x).cast("long")


def finite(*xs: Column) -> Column:
    """Whether all are finite numbers; never null."""
    return reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in xs])


def tidy(x: Column) -> Column:
    """Lower-cased, full-width blanks as blanks, trimmed; null as empty."""
    return F.lower(F.trim(F.translate(F.coalesce(x.cast("string"), F.lit("")), "　", " ")))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def clamp(x: Column, low: float, high: float) -> Column:
    """x held within the limits; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def epoch_ms_from_ns(x: Column) -> Column:
    return x.cast("double") / 1e6


def epoch_ms_from_iso(x: Column) -> Column:
    """Milliseconds of an ISO-8601 text with or without offset; bad text becomes null."""
    return F.unix_millis(F.try_to_timestamp(x))


def iso_from_epoch_ms(x: Column) -> Column:
    """ISO-8601 text with milliseconds and offset in the session's time zone."""
    return F.date_format(F.timestamp_millis(x.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def fixed(x: Column, digits: int, signed: bool = False) -> Column:
    """Text with a fixed number of decimals; null as empty text."""
    return F.when(x.isNull(), "").otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f", x))


def mean_pressure(systolic: Column, diastolic: Column) -> Column:
    return (systolic + 2 * diastolic) / 3


def pulse_pressure(systolic: Column, diastolic: Column) -> Column:
    return systolic - diastolic


def diastolic(mean: Column, pulse: Column) -> Column:
    return mean - pulse / 3


def systolic(mean: Column, pulse: Column) -> Column:
    return mean - pulse / 3 + pulse


def systolic_terms(mean: Column, pulse: Column) -> Column:
    """Per-term systolic coefficients of arrays of mean and pulse coefficients: mean + 2/3 pulse."""
    return F.zip_with(mean, pulse, lambda m, p: m + 2 * p / 3)


def diastolic_terms(mean: Column, pulse: Column) -> Column:
    """Per-term diastolic coefficients: mean - 1/3 pulse."""
    return F.zip_with(mean, pulse, lambda m, p: m - p / 3)


def plausible(systolic_: Column, diastolic_: Column, gap: float | None = 20.0) -> tuple[Column, Column]:
    """Both held in range: systolic at least gap above diastolic (if gap is given), then 60..200 and 40..150."""
    both = systolic_.isNotNull() & diastolic_.isNotNull()
    s = systolic_ if gap is None else F.greatest(systolic_, diastolic_ + gap)
    return F.when(both, clamp(s, 60.0, 200.0)), F.when(both, clamp(diastolic_, 40.0, 150.0))


def anchored(value: Column, population: Column, low: float, high: float) -> tuple[Column, Column]:
    """value, or the population's if it is missing or out of range, and whether it was replaced."""
    good = F.coalesce(value.between(low, high), F.lit(False))
    return F.when(good, value).otherwise(population), ~good
