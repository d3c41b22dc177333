"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_null(x: Column) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def to_number(x: Column) -> Column:
    """Text to double; text that is not a number, and NaN, become NULL."""
    number = x.try_cast("double")
    return F.when(~F.isnan(number), number)


def safe_ln(x: Column) -> Column:
    """Natural log, NULL for zero and negative input."""
    return F.when(x > 0, F.ln(x))


def ratio(x: Column, y: Column) -> Column:
    """x / y with NULL for a zero divisor."""
    return x / F.nullif(y, F.lit(0.0))


def clip(x: Column, low: Column, high: Column) -> Column:
    """Clamp to [low, high]; NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def same_sign(actual: Column, forecast: Column) -> Column:
    """1 when both have the same sign (zero only matches zero), NULL when either is missing."""
    return (F.signum(actual) == F.signum(forecast)).cast("double")


def unbiased_skewness(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def unbiased_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, scale * ((n + 1) * F.kurtosis(x) + 6))


def normal_density(x: Column, mean: Column, std: Column) -> Column:
    z = (x - mean) / std
    return F.exp(z * z * F.lit(-0.5)) / (std * F.sqrt(F.lit(2.0) * F.pi()))


def capitalize(x: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def _moment(bound: str) -> Column:
    """A bound with a clock time is a moment, one without it a day."""
    return F.lit(bound).cast("timestamp_ntz" if ":" in bound else "date")


def from_start(ts: Column, start: str) -> Column:
    return ts >= _moment(start)


def to_end(ts: Column, end: str) -> Column:
    """Up to and with the whole day ``end``, or the moment it names."""
    return ts <= _moment(end) if ":" in end else ts < F.date_add(_moment(end), 1)


def within(ts: Column, start: str, end: str) -> Column:
    """Both ends inclusive; days count as a whole at any grain, so that neighbouring ranges leave no gap."""
    return from_start(ts, start) & to_end(ts, end)


def regime_names(ts: Column, regimes: Mapping[str, tuple[str, str]]) -> Column:
    """Array of the names of all regimes that hold ``ts``: a range lookup without any join."""
    return F.array_compact(F.array(*[F.when(within(ts, a, b), F.lit(name)) for name, (a, b) in regimes.items()]))


def require_columns(df, names: Iterable[str], what: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")


def quoted(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
