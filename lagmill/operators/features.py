"""Direct-forecast feature rows: lags, rolling volatility, lead target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions.columns import quoted, require_columns
from lagmill.operators.panel import SERIES, over_series, with_positions

VOLATILITY = "volatility_3m"
VOLATILITY_ROWS = 3


def feature_names(target: str, nlags: int = 12, predictor_lags: Mapping[str, int] | None = None,
                  volatility: bool = True, univariate: bool = False) -> list[str]:
    """Names in matrix order: target lags, volatility, then the lags of each predictor in the given order."""
    names = [f"lag_{k}" if univariate else f"{target}_lag{k}" for k in range(nlags)]
    if volatility:
        names.append(VOLATILITY)
    for col, lags in (predictor_lags or {}).items():
        if col != target:
            names += [f"{col}_lag{k}" for k in range(lags)]
    return names


def lag_features(df: DataFrame, target: str, grain: str, nlags: int = 12,
                 predictor_lags: Mapping[str, int] | None = None, horizon: int = 1, volatility: bool = True,
                 univariate: bool = False, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Add ``idx``, ``n``, one column per feature, ``target`` (value ``horizon`` rows on) and ``target_ts``.

    Lags go by row position, not by calendar. Rows are kept even where a feature is NULL: see ``complete_rows``."""
    predictor_lags = {c: k for c, k in (predictor_lags or {}).items() if c != target}
    require_columns(df, [target, ts, *keys, *predictor_lags], "feature input")
    y = quoted(target)
    names = feature_names(target, nlags, predictor_lags, volatility, univariate)

    def build(w) -> dict[str, Column]:
        lagged = [F.lag(y, k).over(w) if k else y for k in range(nlags)]
        if volatility:
            frame = w.rowsBetween(1 - VOLATILITY_ROWS, 0)
            enough = F.count(y).over(frame) == VOLATILITY_ROWS
            lagged.append(F.when(enough, F.stddev_samp(y).over(frame)))
        for col, lags in predictor_lags.items():
            lagged += [F.lag(quoted(col), k).over(w) if k else quoted(col) for k in range(lags)]
        ahead = {"target": F.lead(y, horizon).over(w), "target_ts": F.lead(ts, horizon).over(w)}
        return {**dict(zip(names, lagged)), **ahead}

    df = df if {"idx", "n"} <= set(df.columns) else with_positions(df, grain, keys, ts)
    back = max([nlags - 1, VOLATILITY_ROWS - 1 if volatility else 0, *[k - 1 for k in predictor_lags.values()]])
    return over_series(df, build, grain, back, horizon, keys, ts)


def complete_rows(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows without a NULL feature."""
    return features.na.drop(subset=["`" + n.replace("`", "``") + "`" if "." in n else n for n in names])


def training_rows(features: DataFrame, names: Sequence[str]) -> DataFrame:
    """Complete rows with a known target."""
    return complete_rows(features, names).where(F.col("target").isNotNull())


def assemble(features: DataFrame, names: Sequence[str], keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Compact form (keys, ts, idx, n, features, complete, target, target_ts): features as one array in matrix order."""
    complete = F.lit(True)
    for n in names:
        complete = complete & quoted(n).isNotNull()
    return features.select(
        *keys, ts, "idx", "n", F.array(*[quoted(n).cast("double") for n in names]).alias("features"),
        complete.alias("complete"), F.col("target").cast("double").alias("target"), "target_ts")
