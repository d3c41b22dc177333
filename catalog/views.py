"""Views of explanations and forecasts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.panels import G1, growth, table
from catalog.registry import query
from lagmill.functions.columns import capitalize
from lagmill.operators.scoring import NAIVE_NAMES, naive_forecasts
from lagmill.operators.views import (
    dependence_curve, dependence_points, deviation, distinct_features, duplicate_records, explanation_matrix, importance,
    in_overlay, overlay, stack_models,
)

FEATURES = ("A_F", "A_O", "N_F", "N_O", "R_F", "R_O")


def _records(spark, sf):
    """Records in the form of explanations, one per order line."""
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("series_id"),
        F.date_trunc("month", "l_shipdate").cast("date").alias("origin_date"), F.col("l_shipdate").cast("date").alias("forecast_date"),
        F.concat_ws("_", "l_returnflag", "l_linestatus").alias("feature"), F.col("l_quantity").alias("feature_value"),
        (F.col("l_discount") - F.col("l_tax")).alias("shap_value"))


_R = """r AS (SELECT CAST(l_linenumber AS VARCHAR) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS origin_date,
  CAST(l_shipdate AS DATE) AS forecast_date, concat(l_returnflag, '_', l_linestatus) AS feature, l_quantity AS feature_value,
  l_discount - l_tax AS shap_value FROM lineitem)"""


@query("a6_r4_importance", "series_id, feature, mean_abs_shap:8, rank:i", f"""
 WITH {_R}, m AS (SELECT series_id, feature, avg(abs(shap_value)) AS mean_abs_shap FROM r GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean_abs_shap, feature) AS rank FROM m""")
def ranked_importance(spark, sf):
    w = W.partitionBy("series_id").orderBy("mean_abs_shap", "feature")
    return importance(_records(spark, sf)).withColumn("rank", F.row_number().over(w))


@query("a7_duplicate_records", "series_id, origin_date:t, feature, size:i",
       f"WITH {_R} SELECT series_id, origin_date, feature, count(*) AS size FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicates(spark, sf):
    return duplicate_records(_records(spark, sf))


@query("a8_distinct_features", "feature", f"WITH {_R} SELECT DISTINCT feature FROM r")
def features(spark, sf):
    return distinct_features(_records(spark, sf))


@query("r2_explanation_matrix", "series_id, origin_date:t, " + ", ".join(f"{f}:6" for f in FEATURES), f"""
 WITH {_R}, d AS (SELECT series_id, origin_date, forecast_date, feature, sum(shap_value) AS v FROM r GROUP BY 1, 2, 3, 4)
 SELECT series_id, origin_date, {', '.join(f"max_by(v, forecast_date) FILTER (feature = '{f}') AS {f}" for f in FEATURES)} FROM d GROUP BY 1, 2""")
def matrix(spark, sf):
    per_day = _records(spark, sf).groupBy("series_id", "origin_date", "forecast_date", "feature").agg(
        F.sum("shap_value").alias("shap_value"))
    return explanation_matrix(per_day, FEATURES)


_CUBIC = f"""{_R}, a AS (SELECT series_id, feature, avg(feature_value) AS m, stddev_pop(feature_value) AS s, min(feature_value) AS lo,
  max(feature_value) AS hi, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 4 AND stddev_pop(feature_value) > 0),
 z AS (SELECT series_id, feature, (feature_value - m) / s AS z, shap_value AS y FROM r JOIN a USING (series_id, feature)),
 b AS (SELECT series_id, feature, avg(z * z) AS q2, avg(z * z * z) AS q3, sum(z ** 3) / sum(z * z) AS k21, sum(z ** 4) / sum(z * z) AS k31 FROM z GROUP BY 1, 2),
 o AS (SELECT series_id, feature, z, y, z * z - q2 - k21 * z AS p2 FROM z JOIN b USING (series_id, feature)),
 c AS (SELECT series_id, feature, sum(z ** 3 * p2) / sum(p2 * p2) AS k32, avg(y) AS c0, sum(y * z) / sum(z * z) AS c1, sum(y * p2) / sum(p2 * p2) AS c2 FROM o GROUP BY 1, 2),
 p AS (SELECT series_id, feature, y, z * z * z - q3 - k31 * z - k32 * p2 AS p3 FROM o JOIN b USING (series_id, feature) JOIN c USING (series_id, feature)),
 d AS (SELECT series_id, feature, sum(y * p3) / sum(p3 * p3) AS c3 FROM p GROUP BY 1, 2),
 x AS (SELECT *, lo + point * ((hi - lo) / 399) AS x FROM a, range(0, 400) AS g(point)),
 e AS (SELECT *, (x - m) / s AS t FROM x JOIN b USING (series_id, feature) JOIN c USING (series_id, feature) JOIN d USING (series_id, feature)),
 g AS (SELECT *, t * t - q2 - k21 * t AS g2 FROM e)"""


@query("a17_dependence_curve", "series_id, feature, label, point:i, x:6, y:7",
       f"WITH {_CUBIC} SELECT *, split_part(feature, '_', 1) AS label, c0 + c1 * t + c2 * g2 + c3 * (t ** 3 - q3 - k31 * t - k32 * g2) AS y FROM g")
def dependence(spark, sf):
    return dependence_curve(_records(spark, sf))


@query("f12_dependence_points", "feature, points:i, total:4", f"""
 WITH {_R} SELECT feature, count(*) AS points, sum(shap_value) AS total FROM r WHERE feature_value > 10 GROUP BY 1""")
def points(spark, sf):
    text = F.when(F.col("feature_value") > 10, F.col("feature_value").cast("string")).otherwise("missing")
    finite = dependence_points(_records(spark, sf).withColumn("feature_value", text))
    return finite.groupBy("feature").agg(F.count(F.lit(1)).alias("points"), F.sum("shap_value").alias("total"))


def _stacked(spark, sf):
    """Naive forecasts under model names, as two model types."""
    rows = naive_forecasts(growth(spark, sf), "month").withColumnsRenamed(
        {"actual": "actual_logdiff", "forecast": "forecast_logdiff", "ts": "forecast_date"})
    names = dict(zip(("huber", "sgd", "other"), NAIVE_NAMES.values()))
    models = {k: rows.where(F.col("model") == v).drop("model") for k, v in names.items()}
    return stack_models(models, "univariate").unionByName(stack_models(models, "multivariate_domain"))


_STACKED = f"""{G1}, n AS (SELECT 'huber' AS model_class, series_id, ts AS forecast_date, value AS actual_logdiff, 0.0 AS forecast_logdiff FROM g1
 UNION ALL SELECT 'sgd', series_id, ts, value, lag(value) OVER (PARTITION BY series_id ORDER BY ts) FROM g1
 UNION ALL SELECT 'other', series_id, ts, value, avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) FROM g1),
 st AS (SELECT * FROM n CROSS JOIN (VALUES ('univariate'), ('multivariate_domain')) AS t(model_type) WHERE forecast_logdiff IS NOT NULL)"""


@query("j7_j8_stacked_models", "series_id, model_type, model_class, forecast_date:t, forecast_logdiff:9, actual_logdiff:9",
       f"WITH {_STACKED} SELECT * FROM st")
def stacked(spark, sf):
    return _stacked(spark, sf)


@query("f16_deviation", "series_id, model_type, model_class, forecast_date:t, deviation:9",
       f"WITH {_STACKED} SELECT *, actual_logdiff - forecast_logdiff AS deviation FROM st")
def deviations(spark, sf):
    return deviation(_stacked(spark, sf))


@query("f17_excluded_models", "model_type, model_class, rows:i",
       f"WITH {_STACKED} SELECT model_type, model_class, count(*) AS rows FROM st WHERE model_class <> 'other' AND NOT (model_type = 'multivariate_domain' AND model_class = 'sgd') GROUP BY 1, 2")
def excluded(spark, sf):
    shown = _stacked(spark, sf).where(in_overlay(F.col("model_type"), F.col("model_class")))
    return shown.groupBy("model_type", "model_class").agg(F.count(F.lit(1)).alias("rows"))


@query("forecast_overlay", "series_id, title, display_name, forecast_date:t, actual_logdiff:9, forecast_logdiff:9, deviation:9", f"""
 WITH {_STACKED} SELECT *, concat(upper(substr(model_type, 1, 1)), lower(substr(model_type, 2))) AS title,
 CASE model_class WHEN 'huber' THEN 'Huber Regression' ELSE 'SGD Regression' END AS display_name, actual_logdiff - forecast_logdiff AS deviation
 FROM st WHERE model_class <> 'other' AND NOT (model_type = 'multivariate_domain' AND model_class = 'sgd')""")
def overlaid(spark, sf):
    return overlay(_stacked(spark, sf)).withColumn("title", capitalize(F.col("model_type")))
