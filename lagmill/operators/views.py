"""Result views: importance, matrices, dependence curves, forecast overlays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lagmill.functions.columns import is_finite, require_columns
from lagmill.plans.defaults import MODEL_NAMES

CURVE_POINTS = 400
DEGREE = 3


def importance(explanations: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Mean absolute contribution per feature."""
    return explanations.groupBy(*keys, "feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))


def duplicate_records(explanations: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Keys (.., origin_date, feature) that occur more than once."""
    return explanations.groupBy(*keys, "origin_date", "feature").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


def distinct_features(explanations: DataFrame) -> DataFrame:
    return explanations.select("feature").distinct()


def explanation_matrix(explanations: DataFrame, features: Sequence[str], value: str = "shap_value",
                       keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Origin dates by features. Of records that share a key, the one with the latest forecast date is kept."""
    latest = F.max_by(F.col(value), F.col("forecast_date"))
    return explanations.groupBy(*keys, "origin_date").pivot("feature", list(features)).agg(latest)


def deviation(forecasts: DataFrame, actual: str = "actual_logdiff", forecast: str = "forecast_logdiff") -> DataFrame:
    return forecasts.withColumn("deviation", F.col(actual) - F.col(forecast))


def in_overlay(model_type: Column, model_class: Column) -> Column:
    """Known model classes, except stochastic gradient descent for the domain type."""
    known = model_class.isin(*MODEL_NAMES)
    return known & ~((model_type == "multivariate_domain") & (model_class == "sgd"))


def stack_models(models: Mapping[str, DataFrame], model_type: str) -> DataFrame:
    """Label and stack the forecast tables of the models of one type."""
    labelled = [df.withColumns({"model_type": F.lit(model_type), "model_class": F.lit(name)})
                for name, df in models.items()]
    return reduce(lambda a, b: a.unionByName(b), labelled)


def overlay(forecasts: DataFrame) -> DataFrame:
    """Actual, forecast and deviation of all models of a type, with display names."""
    names = F.create_map(*[F.lit(x) for pair in MODEL_NAMES.items() for x in pair])
    shown = forecasts.where(in_overlay(F.col("model_type"), F.col("model_class")))
    return deviation(shown).withColumn("display_name", names[F.col("model_class")])


@pandas_udf(T.ArrayType(T.DoubleType()))
def _polynomial(sums: pd.Series, cross: pd.Series) -> pd.Series:
    """Least-squares coefficients from power sums of the standardized argument."""
    out = []
    for s, c in zip(sums, cross):
        normal = np.array([[s[i + j] for j in range(DEGREE + 1)] for i in range(DEGREE + 1)])
        out.append(np.linalg.lstsq(normal, np.asarray(c, dtype=float), rcond=None)[0])
    return pd.Series(out)


def dependence_points(explanations: DataFrame) -> DataFrame:
    """Records with finite feature value and contribution, given as number or text."""
    require_columns(explanations, ["feature", "feature_value", "shap_value"], "explanations")
    typed = explanations.withColumns({c: F.col(c).try_cast("double") for c in ("feature_value", "shap_value")})
    return typed.where(is_finite(F.col("feature_value")) & is_finite(F.col("shap_value")))


def dependence_curve(explanations: DataFrame, points: int = CURVE_POINTS,
                     keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, feature, label, point, x, y): cubic fit of contribution on feature value over the observed range, for
    features with at least four records. Power sums aggregate in Spark; only a 4 x 4 solve per feature is Python."""
    groups = [*keys, "feature"]
    records = dependence_points(explanations)
    x, y = F.col("feature_value"), F.col("shap_value")
    stats = records.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std"), F.min(x).alias("_lo"),
        F.max(x).alias("_hi")).where((F.col("_n") > DEGREE) & (F.col("_std") > 0))
    z = (x - F.col("_mean")) / F.col("_std")
    z1, z2, z3 = F.col("_z"), F.col("_z2"), F.col("_z") * F.col("_z2")
    z_powers = [F.lit(1.0), z1, z2, z3, z2 * z2, z2 * z3, z3 * z3]
    powers = [F.sum(p).alias(f"_s{i}") for i, p in enumerate(z_powers)]
    crosses = [F.sum(p * y).alias(f"_c{i}") for i, p in enumerate(z_powers[:DEGREE + 1])]
    scale = [F.max(c).alias(c) for c in ("_mean", "_std", "_lo", "_hi")]
    placed = records.join(stats, groups).withColumn("_z", z).withColumn("_z2", F.col("_z") * F.col("_z"))
    sums = placed.groupBy(*groups).agg(*powers, *crosses, *scale)
    fitted = sums.withColumn("_b", _polynomial(F.array(*[f"_s{i}" for i in range(2 * DEGREE + 1)]),
                                               F.array(*[f"_c{i}" for i in range(DEGREE + 1)])))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    grid = fitted.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("_lo") + F.col("point") * step)
    at = (F.col("x") - F.col("_mean")) / F.col("_std")
    b = [F.col("_b")[i] for i in range(DEGREE + 1)]
    curve = b[0] + at * (b[1] + at * (b[2] + at * b[3]))
    return grid.select(*groups, F.split("feature", "_")[0].alias("label"), "point", "x", curve.alias("y"))
