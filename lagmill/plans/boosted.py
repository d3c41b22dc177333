"""Gradient-boosted trees: one distributed fit per tuning cycle, over the rows of all series."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagmill.functions.columns import clip
from lagmill.operators.explain import ensemble_leaves, tree_contributions
from lagmill.operators.features import assemble, lag_features
from lagmill.operators.origins import BACKGROUND_ROWS, TAILS, hv_folds
from lagmill.operators.panel import SERIES
from lagmill.plans.backtest import BacktestConfig
from lagmill.plans.defaults import model_grid
from lagmill.session import shared_folder

DEEPEST = 30
CUTS = (*TAILS, 0.25, 0.5, 0.75)


@dataclass(frozen=True)
class Trees:
    """Step size, feature share and seed of every fit; the grid varies depth (-1: unlimited) and number of trees."""

    step: float = 0.1
    feature_share: float = 0.8
    seed: int = 42

    def fit(self, rows: DataFrame, point: dict) -> GBTRegressionModel:
        depth = DEEPEST if point["max_depth"] < 0 else point["max_depth"]
        learner = GBTRegressor(
            featuresCol="vector", labelCol="label", maxIter=point["n_estimators"], maxDepth=depth,
            stepSize=self.step, featureSubsetStrategy=str(self.feature_share), seed=self.seed)
        return learner.fit(rows)


def _scaled(rows: DataFrame, fitted_on: Column, k: int) -> DataFrame:
    """Add ``scaled``, ``clipped`` and ``label``: every series winsorized and scaled by its own rows where
    ``fitted_on`` holds. Quantiles are exact; a series is bounded by its grain."""
    cuts = F.array(*[F.lit(c) for c in CUTS])
    x = [F.when(fitted_on, F.col("features")[i]) for i in range(k)]
    limits = rows.groupBy("series_id").agg(
        *[F.percentile(c, cuts).alias(f"_q{i}") for i, c in enumerate(x)],
        F.percentile(F.when(fitted_on, F.col("target")), cuts).alias("_qy"))
    joined = rows.join(limits.where(F.col("_qy").isNotNull()), "series_id")
    clipped = [clip(F.col("features")[i], F.col(f"_q{i}")[0], F.col(f"_q{i}")[1]) for i in range(k)]
    scaled = []
    for i, c in enumerate(clipped):
        iqr = F.col(f"_q{i}")[4] - F.col(f"_q{i}")[2]
        scaled.append((c - F.col(f"_q{i}")[3]) / F.when(iqr > 0, iqr).otherwise(1.0))
    return joined.withColumns({
        "clipped": F.array(*clipped), "scaled": F.array(*scaled),
        "label": clip(F.col("target"), F.col("_qy")[0], F.col("_qy")[1]),
    }).drop(*[f"_q{i}" for i in range(k)], "_qy")


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """Write the rows a fit passes over many times and read them back: the file scan gives as many partitions as the
    bytes need, and a lost executor costs a re-read, not a recomputation."""
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path).withColumn("vector", array_to_vector("scaled"))


def run_boosted(df: DataFrame, config: BacktestConfig, grid: list[dict] | None = None, trees: Trees = Trees(),
                explain: bool = True, path: str | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(forecasts, explanations, tuned); explanations, exact ones, only with ``explain``. The driver loops over tuning cycles, whose number follows the length of a
    series, not the amount of data; each fit is distributed and covers the whole cycle's origins (no refit inside a
    cycle). Each cycle's results are written under ``path`` (by default in the shared folder), so plans do not grow from
    cycle to cycle and a lost executor costs at most the work of the running cycle."""
    spark, grid = df.sparkSession, grid or model_grid("lightgbm")
    path = path or f"{shared_folder(spark)}/boosted-{uuid4().hex}"
    plan, k = config.origins, len(config.names)
    rows = assemble(lag_features(df, config.target, config.grain, config.nlags, config.predictor_lags, plan.horizon,
                                 config.volatility, config.univariate), config.names)
    # An origin whose newest row misses a feature uses the newest complete row before it.
    so_far = W.partitionBy("series_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    live = F.last(F.when(F.col("complete"), F.struct("ts", "features")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("live", live).where("live is not null")
    rows.write.parquet(f"{path}/features")
    rows = spark.read.parquet(f"{path}/features")
    longest = rows.agg(F.max("n")).first()[0] or 0
    names, tuned = F.array(*[F.lit(n) for n in config.names]), []
    for cycle in range(plan.cycles(longest)):
        first = plan.initial + cycle * plan.interval
        known = F.col("target").isNotNull() & (F.col("idx") < first - plan.horizon)
        seen = rows.where(F.col("complete") & known).drop("live").withColumn("_known", F.lit(True))
        order = W.partitionBy("series_id", "_known")
        placed = seen.withColumns({"_row": F.row_number().over(order.orderBy("idx")) - 1,
                                   "_rows": F.count(F.lit(1)).over(order)})
        choice = _tune(placed, grid, trees, config, k, f"{path}/folds/cycle={cycle}")
        origins = rows.where((F.col("idx") >= first - 1) & (F.col("idx") < first + plan.interval - 1)
                             & (F.col("idx") <= F.col("n") - plan.horizon - 1))
        origins = origins.withColumns({"ts": F.col("live.ts"), "features": F.col("live.features"), "_known": F.lit(False)}).drop("live")
        ready = _stored(_scaled(placed.unionByName(origins, allowMissingColumns=True), F.col("_known"), k), f"{path}/rows/cycle={cycle}")
        model = trees.fit(ready.where("_known"), grid[choice])
        out = model.transform(ready.where(~F.col("_known")).withColumnRenamed("target", "actual_logdiff")).select(
            "series_id", F.lit("lightgbm").alias("model_class"), (F.col("idx") + 1).cast("int").alias("origin_idx"),
            F.col("ts").alias("origin_date"), F.col("target_ts").alias("forecast_date"),
            F.col("prediction").alias("forecast_logdiff"), "actual_logdiff", "clipped", "scaled")
        out.drop("clipped", "scaled").write.parquet(f"{path}/forecasts/cycle={cycle}")
        background = ready.where(F.col("_known") & (F.col("_row") >= F.col("_rows") - BACKGROUND_ROWS)).select(
            "series_id", F.col("scaled").alias("features"))

        tuned.append((first, choice, int(grid[choice]["max_depth"]), int(grid[choice]["n_estimators"])))
        if not explain:
            continue
        keys = [*SERIES, "origin_idx"]
        leaves = ensemble_leaves(model.toDebugString, k)
        values = tree_contributions(out.select(*keys, F.col("scaled").alias("features")), background, leaves, keys, "series_id")
        values.join(out.drop("scaled"), keys).select(
            "series_id", "model_class", "origin_date", "forecast_date", F.get(names, F.col("feature_pos")).alias("feature"),
            F.get("clipped", F.col("feature_pos")).alias("feature_value"), "shap_value",
            F.col("forecast_logdiff").alias("prediction"), "base_value",
        ).write.parquet(f"{path}/explanations/cycle={cycle}")
    if not tuned:
        raise ValueError("no series is long enough for a first origin")
    choices = spark.createDataFrame(tuned, "origin_idx int, grid_pos int, max_depth int, n_estimators int")
    forecasts = spark.read.parquet(f"{path}/forecasts").drop("cycle")
    explanations = spark.read.parquet(f"{path}/explanations").drop("cycle") if explain else None
    return forecasts, explanations, choices


def _tune(known: DataFrame, grid: list[dict], trees: Trees, config: BacktestConfig, k: int, path: str) -> int:
    """Grid position with the lowest mean validation error over all series; 0 when no fold exists."""
    if len(grid) == 1:
        return 0
    folds = known.withColumn("_f", F.explode(hv_folds(F.col("_rows"), config.n_splits, config.h, config.v)))
    parts = []
    for fold in range(max(1, config.n_splits)):
        rows = folds.where(F.col("_f.fold") == fold)
        train = F.col("_row") < F.col("_f.train_end")
        valid = (F.col("_row") >= F.col("_f.val_start")) & (F.col("_row") < F.col("_f.val_end"))
        ready = _stored(_scaled(rows.where(train | valid).withColumn("_train", train), F.col("_train"), k), f"{path}/fold={fold}")
        if ready.where("_train").isEmpty():
            continue
        for pos, point in enumerate(grid):
            scored = trees.fit(ready.where("_train"), point).transform(ready.where(~F.col("_train")))
            mae = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("target")))).first()[0]
            if mae is not None:
                parts.append((pos, mae))
    if not parts:
        return 0
    totals: dict[int, list[float]] = {}
    for pos, mae in parts:
        totals.setdefault(pos, []).append(mae)
    return min(totals, key=lambda p: (sum(totals[p]) / len(totals[p]), p))
