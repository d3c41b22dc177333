"""Column selection of a wide table: fixed lists, and a filter on missingness, variance and correlation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagmill.functions.columns import finite_or_null, quoted, require_columns
from lagmill.plans.defaults import DATE_COLUMN, DOMAIN_GROUPS, NON_STATIONARY_COLUMNS, SPARSE_COLUMNS, TARGET


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in table order, from the schema."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns that must exist."""
    require_columns(df, names)
    return df.drop(*names)


def target_first(df: DataFrame, date: str = DATE_COLUMN, target: str = TARGET) -> DataFrame:
    """Date, target, then the other columns in their order."""
    require_columns(df, [date, target])
    rest = [c for c in df.columns if c not in (date, target)]
    return df.select(*[quoted(c) for c in (date, target, *rest)])


def select_univariate(df: DataFrame, date: str = DATE_COLUMN, target: str = TARGET) -> DataFrame:
    require_columns(df, [date, target])
    return df.select(quoted(date), quoted(target))


def select_domain(df: DataFrame, date: str = DATE_COLUMN, target: str = TARGET,
                  groups: Mapping[str, Sequence[str]] = DOMAIN_GROUPS) -> DataFrame:
    """Date, target and the listed predictors, in list order."""
    names = [date, target, *[c for members in groups.values() for c in members]]
    require_columns(df, names)
    return df.select(*[quoted(c) for c in names])


def column_stats(df: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """(pos, variable, na_frac, variance, mean) per column: one aggregation of the wide table, whose single result row
    is then turned into one row per column."""
    aggs, rows = [F.count(F.lit(1)).cast("double").alias("n")], []
    for i, c in enumerate(predictors):
        x = finite_or_null(quoted(c).cast("double"))
        aggs += [F.count(x).alias(f"c{i}"), F.var_samp(x).alias(f"v{i}"), F.avg(x).alias(f"m{i}")]
        missing = (F.col("n") - F.col(f"c{i}")) / F.nullif(F.col("n"), F.lit(0.0))
        rows.append(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("variable"), missing.alias("na_frac"),
                             F.col(f"v{i}").alias("variance"), F.col(f"m{i}").alias("mean")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def too_sparse(stats: DataFrame, max_na: float = 0.2) -> DataFrame:
    return stats.where(F.col("na_frac") > max_na)


def too_flat(stats: DataFrame, var_thresh: float = 1e-6) -> DataFrame:
    """Variance at or below the threshold; a NULL variance stays."""
    return stats.where(F.col("variance") <= var_thresh)


PAIR_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def correlations(df: DataFrame, predictors: Sequence[str], centers: Sequence[float] | None = None) -> DataFrame:
    """(i, j, corr) for every column pair i < j over the rows where both are present; NULL if undefined.

    A task turns its rows into masked moment matrices batch by batch and emits one row per column pair, so the wide
    table is never shuffled and no row is paired with another. ``centers`` shift the columns for accuracy."""
    p = len(predictors)
    shift = np.array([0.0 if c is None else float(c) for c in (centers or [0.0] * p)])
    upper = np.triu_indices(p, 1)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            seen = np.isfinite(x)
            x = np.where(seen, x, 0.0)
            m = seen.astype(float)
            s, q = x.T @ m, (x * x).T @ m
            sums = np.stack([m.T @ m, s, s.T, q, q.T, x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            yield pd.DataFrame({"i": upper[0], "j": upper[1], **{c: t[upper] for c, t in zip(PAIR_SUMS, total)}})

    schema = "i int, j int, " + ", ".join(f"{c} double" for c in PAIR_SUMS)
    renamed = df.select(*[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)])
    sums = renamed.mapInPandas(moments, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])
    n, (sx, sy, sxx, syy, sxy) = F.nullif(F.col("n"), F.lit(0.0)), map(F.col, PAIR_SUMS[1:])
    vx, vy, cov = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    flat = (vx <= F.lit(1e-14) * sxx) | (vy <= F.lit(1e-14) * syy)
    return sums.select("i", "j", F.when(~flat, cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0))).alias("corr"))


def correlated_with_earlier(pairs: DataFrame, corr_thresh: float = 0.95) -> DataFrame:
    """Positions of columns whose absolute correlation with any earlier column is above the threshold, whether or not
    that earlier column itself stays."""
    return pairs.where(F.abs("corr") > corr_thresh).select(F.col("j").alias("pos")).distinct()


def screen(df: DataFrame, date: str = DATE_COLUMN, target: str = TARGET, max_na: float = 0.2,
           var_thresh: float = 1e-6, corr_thresh: float = 0.95) -> list[str]:
    """Names of the predictors that pass all three filters, in table order; the target is exempt.

    The driver holds column names and one statistic row per column, never data rows."""
    predictors = numeric_columns(df, exclude=(date, target))
    if not predictors:
        return []
    stats = column_stats(df, predictors).orderBy("pos").collect()
    left = [r for r in stats if not r.na_frac > max_na and not (r.variance is not None and r.variance <= var_thresh)]
    if len(left) < 2:
        return [r.variable for r in left]
    pairs = correlations(df, [r.variable for r in left], [r["mean"] for r in left])
    dropped = {r.pos for r in correlated_with_earlier(pairs, corr_thresh).collect()}
    return [r.variable for i, r in enumerate(left) if i not in dropped]


def select_screened(df: DataFrame, date: str = DATE_COLUMN, target: str = TARGET, max_na: float = 0.2,
                    var_thresh: float = 1e-6, corr_thresh: float = 0.95, drop_first: Sequence[str] = SPARSE_COLUMNS,
                    drop_last: Sequence[str] = NON_STATIONARY_COLUMNS) -> DataFrame:
    """Filter-based selection: drop the known sparse columns, screen, put the target first, drop the known
    non-stationary columns."""
    require_columns(df, [date, target])
    df = drop_columns(df, drop_first)
    kept = screen(df, date, target, max_na, var_thresh, corr_thresh)
    text = [c for c in df.columns if c not in (date, target) and c not in numeric_columns(df)]
    ordered = [c for c in df.columns if c in {date, target, *kept, *text}]
    return drop_columns(target_first(df.select(*[quoted(c) for c in ordered]), date, target), drop_last)


def select_series(df: DataFrame, mode: str, date: str = DATE_COLUMN, target: str = TARGET, **thresholds) -> DataFrame:
    """Selection by model type: univariate, multivariate or multivariate_domain."""
    if mode == "univariate":
        return select_univariate(df, date, target)
    if mode == "multivariate":
        return select_screened(df, date, target, **thresholds)
    if mode == "multivariate_domain":
        return select_domain(df, date, target)
    raise ValueError(f"unknown selection {mode!r}")
