"""Whole study of one model type: select, make stationary, test, backtest, score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.functions.columns import quoted
from lagmill.operators.panel import date_slice, impute_middle, melt, widen
from lagmill.operators.scoring import METRICS, evaluate
from lagmill.operators.screening import select_series
from lagmill.operators.transforms import make_stationary
from lagmill.operators.unitroot import adf
from lagmill.operators.views import stack_models
from lagmill.plans.backtest import Backtest, BacktestConfig, Model, model_of, run_backtest
from lagmill.plans.boosted import run_boosted
from lagmill.plans.defaults import DATE_COLUMN, MODEL_CLASSES, REGIMES, SAMPLE_END, SAMPLE_START, TARGET
from lagmill.sources.results import read_results
from lagmill.sources.wide_csv import split_code_row, typed_table


@dataclass(frozen=True)
class Prepared:
    """Tables every model of a type shares; build once, persist or write, then run any number of models on them."""

    variables: Sequence[str]
    codes: DataFrame
    levels: DataFrame
    stationary: DataFrame
    frame: DataFrame


def prepare(text: DataFrame, model_type: str, target: str = TARGET, date: str = DATE_COLUMN, span: int = 1,
            start: str | None = SAMPLE_START, end: str | None = SAMPLE_END, grain: str = "month",
            entity: str = "all", **selection) -> Prepared:
    """Text table with code row -> selected levels -> stationary panel -> modeling frame inside [start, end].

    The multivariate frames get their middle rows filled before the date cut; the univariate frame does not."""
    data, codes = split_code_row(text, date)
    typed = typed_table(data, date).withColumnRenamed("ts", date)
    chosen = select_series(typed, model_type, date, target, **selection)
    variables = [c for c in chosen.columns if c != date]
    levels = melt(chosen.withColumnRenamed(date, "ts"), ["ts"], variables)
    stationary = make_stationary(levels, codes, grain, span)
    wide = widen(stationary, variables).withColumn("series_id", F.lit(entity))
    if model_type != "univariate":
        wide = impute_middle(wide, variables, grain).drop("idx", "n")
    frame = date_slice(wide, start, end).select("series_id", "ts", *[quoted(c) for c in variables])
    return Prepared(variables, codes, levels, stationary, frame)


def stationarity(prepared: Prepared, grain: str = "month") -> DataFrame:
    """Unit-root test of every selected variable."""
    return adf(prepared.stationary, grain).withColumnRenamed("series_id", "variable")


def _setting(prepared: Prepared, model_type: str, target: str, predictor_lags: int, config: dict) -> BacktestConfig:
    lags = {c: predictor_lags for c in prepared.variables if c != target}
    return BacktestConfig(target=target, predictor_lags=lags, univariate=model_type == "univariate", **config)


def run_models(prepared: Prepared, model_type: str, classes: Sequence[str | Model], target: str = TARGET,
               predictor_lags: int = 1, **config) -> dict[str, Backtest]:
    """Backtests of the given model classes on the shared frame."""
    setting = _setting(prepared, model_type, target, predictor_lags, config)
    models = [c if isinstance(c, Model) else model_of(c, model_type) for c in classes]
    return {m.name: run_backtest(prepared.frame, m, setting) for m in models}


def run_all(prepared: Prepared, model_type: str, folder: str, classes: Sequence[str] = MODEL_CLASSES,
            target: str = TARGET, predictor_lags: int = 1, grids: Mapping[str, Sequence[dict]] | None = None,
            **config) -> tuple[DataFrame, DataFrame]:
    """Forecasts and explanations of all model classes of a type, written under ``folder`` by type and class.

    A class is complete once its two tables are written; its fits run once."""
    spark, setting = prepared.frame.sparkSession, _setting(prepared, model_type, target, predictor_lags, config)
    grids, part = grids or {}, f"model_type={model_type}/model_class="
    for name in classes:
        if name == "lightgbm":
            forecasts, records, _ = run_boosted(prepared.frame, setting, grids.get(name), path=f"{folder}/boosted/{part}{name}")
        else:
            model = model_of(name, model_type)
            model = model.with_grid(grids[name]) if name in grids else model
            run = run_backtest(prepared.frame, model, setting).stored(f"{folder}/fits/{part}{name}")
            forecasts, records = run.forecasts(), run.explanations()
        for table, rows in (("forecasts", forecasts), ("explanations", records)):
            rows.drop("model_class").write.mode("overwrite").parquet(f"{folder}/{table}/{part}{name}")
    return tuple(read_results(spark, f"{folder}/{table}", model_type) for table in ("forecasts", "explanations"))


def forecast_table(backtests: Mapping[str, Backtest], model_type: str) -> DataFrame:
    """All forecasts of a model type in one labelled table."""
    return stack_models({name: b.forecasts().drop("model_class") for name, b in backtests.items()}, model_type)


def score_table(forecasts: DataFrame, regimes: Mapping[str, tuple[str, str]] = REGIMES) -> DataFrame:
    """Scores of every model beside those of the zero forecast on the same rows."""
    keys = ["series_id", "model_type", "model_class"]
    sides = F.array(F.struct(F.lit("").alias("_side"), F.col("forecast_logdiff").alias("_f")),
                    F.struct(F.lit("naive_").alias("_side"), F.lit(0.0).alias("_f")))
    both = forecasts.select(*keys, "forecast_date", "actual_logdiff", F.inline(sides))
    scored = evaluate(both, regimes, [*keys, "_side"], "forecast_date", "actual_logdiff", "_f")
    values = [F.max(F.when(F.col("_side") == side, F.col(m))).alias(side + m)
              for side in ("", "naive_") for m in METRICS]
    return scored.groupBy(*keys, "pos", "scope").agg(F.max("n").alias("n"), *values)
