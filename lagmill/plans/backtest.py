"""Expanding-window backtest: tune, fit, forecast and explain at every origin of every series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagmill.functions.fits import fit_elastic_net, fit_huber, fit_network, fit_sgd
from lagmill.operators.features import assemble, feature_names, lag_features
from lagmill.operators.origins import (
    BACKGROUND_ROWS, Expanding, History, Scaling, carry_forward, clip_target, fold_slices, origin_blocks,
)
from lagmill.plans.defaults import model_grid


@dataclass(frozen=True)
class Model:
    """A fit over all grid points, its grid, and which sides are winsorized (True, 'features' or False)."""

    name: str
    fit: Callable
    grid: Sequence[dict]
    winsorize: bool | str = True

    def with_grid(self, points: Sequence[dict]) -> Model:
        return replace(self, grid=list(points))


def model_of(name: str, model_type: str = "univariate") -> Model:
    fits = {"elasticnet": fit_elastic_net, "huber": fit_huber, "sgd": fit_sgd, "mlp": fit_network}
    if name not in fits:
        raise ValueError(f"{name!r} is not fitted per origin; boosted trees are in lagmill.plans.boosted")
    return Model(name, fits[name], model_grid(name, model_type), "features" if name in ("huber", "sgd") else True)


@dataclass(frozen=True)
class BacktestConfig:
    target: str = "value"
    grain: str = "month"
    nlags: int = 12
    predictor_lags: Mapping[str, int] = field(default_factory=dict)
    volatility: bool = True
    univariate: bool = True
    origins: Expanding = Expanding()
    n_splits: int = 1
    h: int = 1
    v: int = 24

    @property
    def names(self) -> list[str]:
        return feature_names(self.target, self.nlags, self.predictor_lags, self.volatility, self.univariate)


def _fits_schema(ts_type: T.DataType) -> T.StructType:
    def f(name, kind):
        return T.StructField(name, kind)

    numbers = T.ArrayType(T.DoubleType())
    return T.StructType([
        f("series_id", T.StringType()), f("origin_idx", T.IntegerType()), f("origin_date", ts_type),
        f("forecast_date", ts_type), f("forecast_logdiff", T.DoubleType()), f("actual_logdiff", T.DoubleType()),
        f("base_value", T.DoubleType()), f("feature_values", numbers), f("shap_values", numbers),
        f("grid_pos", T.IntegerType()), f("tuned", T.BooleanType())])


@dataclass(frozen=True)
class Backtest:
    """``fits`` has one row per (series, origin); the three result tables are projections of it."""

    fits: DataFrame
    model: Model
    names: Sequence[str]

    def stored(self, path: str) -> Backtest:
        """Write the fits and go on from the files, so that several results need only one run."""
        self.fits.write.mode("overwrite").parquet(path)
        return replace(self, fits=self.fits.sparkSession.read.parquet(path))

    def forecasts(self) -> DataFrame:
        return self.fits.select(
            "series_id", F.lit(self.model.name).alias("model_class"), "origin_idx", "origin_date", "forecast_date",
            "forecast_logdiff", "actual_logdiff")

    def explanations(self) -> DataFrame:
        pairs = F.arrays_zip(F.array(*[F.lit(n) for n in self.names]).alias("feature"),
                             F.col("feature_values").alias("feature_value"), F.col("shap_values").alias("shap_value"))
        return explanation_rows(self.fits.withColumn("_pairs", pairs), self.model.name)

    def tuned_params(self) -> DataFrame:
        """Choices made at the first origin of each cycle, parameters as columns."""
        points = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in self.model.grid])
        return self.fits.where("tuned").select(
            "series_id", F.lit(self.model.name).alias("model_class"), "origin_idx", "origin_date", "grid_pos",
            F.element_at(points, F.col("grid_pos") + 1).alias("_p")).select("*", "_p.*").drop("_p")


def explanation_rows(fits: DataFrame, model_class: str) -> DataFrame:
    """One record per explained feature from rows with ``_pairs``."""
    return fits.select(
        "series_id", F.lit(model_class).alias("model_class"), "origin_date", "forecast_date",
        F.inline("_pairs"), F.col("forecast_logdiff").alias("prediction"), "base_value")


def tune(model: Model, x: np.ndarray, y: np.ndarray, n_splits: int, h: int, v: int, scalings: Callable | None = None) -> int | None:
    """Grid position with the lowest mean validation error; limits and scale come from the fold's training rows and are
    fitted once per fold, by ``scalings`` (of the ends of the folds' training rows) if given. The first position wins ties;
    None without a valid fold or a finite error."""
    folds, errors = fold_slices(len(y), n_splits, h, v), []
    if not folds:
        return None
    ends = [train.stop for train, _ in folds]
    fitted = scalings(ends) if scalings else [Scaling.fit(x[:end], bool(model.winsorize)) for end in ends]
    for (train, valid), scaling in zip(folds, fitted):
        target = clip_target(y[train]) if model.winsorize is True else y[train]
        fit = model.fit(scaling.scale(scaling.clip(x[train])), target, model.grid)
        predicted = fit.predict(scaling.scale(scaling.clip(x[valid])))
        errors.append(np.abs(predicted - y[valid][:, None]).mean(axis=0))
    mean = np.mean(errors, axis=0)
    mean[~np.isfinite(mean)] = np.inf
    best = int(np.argmin(mean))
    return best if np.isfinite(mean[best]) else None


def _tune_at(model: Model, history: History, origin: int, config: BacktestConfig) -> int | None:
    """The choice at an origin of a history, with the limits of its order-statistic indexes."""
    (start,), (end,) = history.spans([origin])

    def scalings(ends: Sequence[int]) -> list[Scaling]:
        return history.scalings(np.full(len(ends), start), start + np.array(ends, np.int64), bool(model.winsorize))

    return tune(model, *history.rows(start, end), config.n_splits, config.h, config.v, scalings)


_CHOICES = "series_id string, block int, cycle int, choice int"


def tuned_choices(blocks: DataFrame, model: Model, config: BacktestConfig) -> DataFrame:
    """(series_id, block, cycle, choice, tuned): the choice made at the first origin of each cycle. A cycle without a valid
    one keeps the last valid choice of an earlier cycle, in whichever block that lies, and the first grid point before any."""
    plan = config.origins

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        history, out = History(pdf, plan), []
        for cycle in history.cycles(int(key[1])):
            origin = history.origins(cycle)[0]
            known = history.live(origin) is not None
            out.append((key[0], int(key[1]), cycle, _tune_at(model, history, origin, config) if known else None))
        return pd.DataFrame(out, columns=["series_id", "block", "cycle", "choice"]).astype({"choice": "Int32"})

    made = blocks.groupBy("series_id", "block").applyInPandas(choose, _CHOICES).withColumn("tuned", F.col("choice").isNotNull())
    return carry_forward(made).withColumn("choice", F.coalesce("choice", F.lit(0)))


def run_backtest(df: DataFrame, model: Model, config: BacktestConfig) -> Backtest:
    """Backtest of every series of ``df`` (series_id, ts, target and predictor columns).

    Features are built once by windows, since a row's features never depend on later rows. Rows then go to
    (series, block of cycles) groups, in two stages that read one shuffle: the first tunes at the first origin of each
    cycle, a window carries choices over cycles and blocks, and the second fits every origin with the choice of its cycle."""
    plan = config.origins
    features = lag_features(
        df, config.target, config.grain, config.nlags, config.predictor_lags, plan.horizon, config.volatility,
        config.univariate)
    rows = assemble(features, config.names)
    schema = _fits_schema(rows.schema["ts"].dataType)

    def fit_block(key: tuple, pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=schema.names)
        history, out = History(pdf, plan), []
        choices = {c: (int(k), bool(t)) for c, k, t in zip(chosen["cycle"], chosen["choice"], chosen["tuned"])}
        origins = [(c, o) for c in history.cycles(int(key[1])) for o in history.origins(c) if history.live(o) is not None]
        start, end = history.spans([o for _, o in origins])
        known = np.flatnonzero(end > start)
        start, end = start[known], end[known]
        scalings = history.scalings(start, end, bool(model.winsorize)) if len(known) else []
        limits = zip(*history.target_limits(start, end)) if len(known) else []
        for k, scaling, (y_low, y_high), first, last in zip(known, scalings, limits, start, end):
            cycle, origin = origins[k]
            choice, tuned = choices[cycle]
            x, y = history.rows(first, last)
            live, newest = history.live(origin), history.newest(origin)
            clipped = scaling.clip(history.x[live])
            x_scaled, x_live = scaling.scale(scaling.clip(x)), scaling.scale(clipped)
            fit = model.fit(x_scaled, np.clip(y, y_low, y_high) if model.winsorize is True else y, [model.grid[choice]])
            contributions, base = fit.explain(x_live, x_scaled[-BACKGROUND_ROWS:])
            out.append((
                key[0], origin, history.ts[live], history.target_ts[newest],
                float(fit.predict(x_live[None, :])[0, 0]), history.y[newest], base, clipped, contributions,
                choice, tuned and origin == history.origins(cycle)[0]))
        return pd.DataFrame(out, columns=schema.names)

    blocks = origin_blocks(rows, plan, config.grain)
    chosen = tuned_choices(blocks, model, config).select(
        F.col("series_id").alias("_series"), F.col("block").alias("_block"), "cycle", "choice", "tuned")
    fits = blocks.groupBy("series_id", "block").cogroup(chosen.groupBy("_series", "_block")).applyInPandas(fit_block, schema)
    return Backtest(fits, model, config.names)
