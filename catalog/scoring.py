"""Naive forecasts and forecast scores."""

from pyspark.sql import functions as F

from catalog.panels import EVENT_REGIME_SQL, EVENT_REGIMES, G1, P2, P3, REGIME_SQL, REGIMES, S3, by_second, daily, growth, hourly
from catalog.registry import query
from lagmill.functions.columns import regime_names
from lagmill.operators.scoring import align, evaluate, naive_forecasts, rolled_persistence, shifted_naive_scores
from lagmill.plans.naive import autoregression, naive_benchmark

_NAIVE = """f AS (SELECT series_id, ts, value AS actual, 'Naive_Zero' AS model, 0.0 AS forecast FROM {0}
 UNION ALL SELECT series_id, ts, value, 'Naive_Persistence', lag(value) OVER (PARTITION BY series_id ORDER BY ts) FROM {0}
 UNION ALL SELECT series_id, ts, value, 'Naive_RollingMean_12',
  avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) FROM {0})"""
_AR = """ar AS (SELECT series_id, ts, value AS actual, 'AR_1' AS model, CASE WHEN rn > 24 THEN
  regr_intercept(value, x) OVER e + regr_slope(value, x) OVER e * x END AS forecast
  FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS x, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM g1)
  WINDOW e AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_SCORES = """sqrt(avg((actual - forecast) ** 2)) AS rmse, avg(abs(actual - forecast)) AS mae,
  avg(CASE WHEN actual IS NULL OR forecast IS NULL THEN NULL WHEN sign(actual) = sign(forecast) THEN 1.0 ELSE 0.0 END) AS hit_rate"""
_TIDY = f"""scopes AS (SELECT 0 AS pos, 'full' AS scope, DATE '1000-01-01' AS starts, DATE '3000-01-01' AS ends
  UNION ALL SELECT pos, regime, starts, ends FROM regimes),
 keys AS (SELECT DISTINCT series_id, model FROM ff),
 scored AS (SELECT keys.series_id, keys.model, pos, scope, count(actual) AS n, {_SCORES} FROM keys CROSS JOIN scopes
  LEFT JOIN ff ON ff.series_id = keys.series_id AND ff.model = keys.model AND ts BETWEEN starts AND ends GROUP BY 1, 2, 3, 4)"""
FLAGSHIP_COLUMNS = "series_id, model, pos:i, scope, n:i, rmse:9, mae:9, hit_rate:9"
FLAGSHIP_SQL = f"""WITH {G1}, {_NAIVE.format('g1')}, {_AR}, {REGIME_SQL},
 ff AS (SELECT * FROM f WHERE forecast IS NOT NULL UNION ALL SELECT * FROM ar WHERE forecast IS NOT NULL), {_TIDY} SELECT * FROM scored"""


@query("flagship_benchmark_scores", FLAGSHIP_COLUMNS, FLAGSHIP_SQL)
def flagship(spark, sf):
    """Three naive forecasts and a one-lag autoregression, scored overall and per regime."""
    panel = growth(spark, sf)
    own = autoregression(panel, "month", warmup=24).withColumn("model", F.lit("AR_1"))
    return evaluate(naive_forecasts(panel, "month").unionByName(own), REGIMES)


@query("naive_benchmark_of_a_date_range", FLAGSHIP_COLUMNS, f"""WITH {G1},
 c AS (SELECT * FROM g1 WHERE ts BETWEEN DATE '1996-07-01' AND DATE '2000-09-01'), {_NAIVE.format('c')}, {REGIME_SQL},
 ff AS (SELECT * FROM f WHERE forecast IS NOT NULL), {_TIDY} SELECT * FROM scored""")
def benchmark(spark, sf):
    return naive_benchmark(growth(spark, sf), "month", "1996-07-01", "2000-09-01", REGIMES)


@query("w12_zero_forecast", "series_id, ts:t, actual:9, forecast:9", f"WITH {G1} SELECT series_id, ts, value AS actual, 0.0 AS forecast FROM g1")
def zero(spark, sf):
    return naive_forecasts(growth(spark, sf), "month").where(F.col("model") == "Naive_Zero")


@query("w5_persistence", "series_id, ts:t, actual:6, forecast:6",
       f"WITH {P2}, {_NAIVE.format('p2')} SELECT * FROM f WHERE model = 'Naive_Persistence' AND forecast IS NOT NULL")
def persistence(spark, sf):
    return naive_forecasts(daily(spark, sf), "day").where(F.col("model") == "Naive_Persistence")


@query("w6_mean_of_earlier_rows", "series_id, ts:t, actual:6, forecast:6",
       f"WITH {P3}, {_NAIVE.format('p3')} SELECT * FROM f WHERE model = 'Naive_RollingMean_12' AND forecast IS NOT NULL")
def running_mean(spark, sf):
    return naive_forecasts(hourly(spark, sf), "hour").where(F.col("model") == "Naive_RollingMean_12")


@query("w5_w6_second_grain", "series_id, ts:t, model, actual:6, forecast:6",
       f"WITH {S3}, {_NAIVE.format('s3')} SELECT * FROM f WHERE forecast IS NOT NULL")
def second_grain(spark, sf):
    """Series of unbounded length: positions, chunks and prefix totals instead of one window task per series."""
    return naive_forecasts(by_second(spark, sf), "second")


@query("a3_scores", "series_id, model, n:i, rmse:6, mae:6, hit_rate:6", f"""
 WITH {P3}, {_NAIVE.format('p3')}, ff AS (SELECT * FROM f WHERE forecast IS NOT NULL)
 SELECT series_id, model, count(*) AS n, {_SCORES} FROM ff GROUP BY 1, 2""")
def scores(spark, sf):
    return evaluate(naive_forecasts(hourly(spark, sf), "hour"), {})


_WIDE = [f"{m}_{s}" for s in ("full", *REGIMES) for m in ("RMSE", "MAE", "HitRate")]
_WIDE_SQL = ", ".join(
    f"max({m.lower().replace('hitrate', 'hit_rate')}) FILTER (scope = '{s}') AS \"{m}_{s}\"" for m, s in (w.split("_") for w in _WIDE))


@query("a4_a5_score_table", "series_id, model, " + ", ".join(f"{c}:9" for c in _WIDE), f"""
 WITH {G1}, {_NAIVE.format('g1')}, {REGIME_SQL}, ff AS (SELECT * FROM f WHERE forecast IS NOT NULL), {_TIDY}
 SELECT series_id, model, {_WIDE_SQL} FROM scored GROUP BY 1, 2""")
def score_table(spark, sf):
    return evaluate(naive_forecasts(growth(spark, sf), "month"), REGIMES, layout="wide")


@query("j1_align_actual_and_forecast", "series_id, ts:t, actual:9, forecast:9", f"""
 WITH {G1}, b AS (SELECT series_id, CAST(ts + INTERVAL 12 MONTH AS DATE) AS ts, value AS forecast FROM g1 WHERE month(ts) <> 2)
 SELECT series_id, ts, value AS actual, forecast FROM g1 JOIN b USING (series_id, ts)""")
def aligned(spark, sf):
    """Forecast: the growth of the same month a year ago, missing for Februaries."""
    panel = growth(spark, sf)
    year_ago = panel.select("series_id", F.add_months("ts", 12).alias("ts"),
                            F.when(F.month("ts") != 2, F.col("value")).alias("forecast"))
    return align(panel.withColumnRenamed("value", "actual"), year_ago)


@query("j2_regime_lookup", "series_id, ts:t, regime", f"WITH {G1}, {REGIME_SQL} SELECT series_id, ts, regime FROM g1 JOIN regimes ON ts BETWEEN starts AND ends")
def regime_of(spark, sf):
    return growth(spark, sf).select("series_id", "ts", F.explode(regime_names(F.col("ts"), REGIMES)).alias("regime"))


@query("j2_regime_lookup_of_seconds", "series_id, ts:t, regime",
       f"WITH {S3}, {EVENT_REGIME_SQL} SELECT series_id, ts, regime FROM s3 JOIN regimes ON ts BETWEEN starts AND ends")
def regime_of_second(spark, sf):
    return by_second(spark, sf).select("series_id", "ts", F.explode(regime_names(F.col("ts"), EVENT_REGIMES)).alias("regime"))


@query("a4_scores_per_regime_of_hours", FLAGSHIP_COLUMNS, f"""WITH {P3}, {_NAIVE.format('p3')}, {EVENT_REGIME_SQL},
 ff AS (SELECT * FROM f WHERE forecast IS NOT NULL), {_TIDY} SELECT * FROM scored""")
def hourly_scores(spark, sf):
    return evaluate(naive_forecasts(hourly(spark, sf), "hour"), EVENT_REGIMES)


@query("w10_rolled_persistence", "series_id, ts:t, forecast:9", f"""
 WITH {G1} SELECT series_id, ts, coalesce(lag(value) OVER w, last_value(value) OVER (PARTITION BY series_id ORDER BY ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS forecast FROM g1 WINDOW w AS (PARTITION BY series_id ORDER BY ts)""")
def rolled(spark, sf):
    return rolled_persistence(growth(spark, sf), "month")


_SHIFTED = """
 WITH {0}, {1}, r AS (SELECT series_id, ts, value AS actual, coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY ts),
  last_value(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS forecast FROM {2}),
 scopes AS (SELECT 'full' AS scope, DATE '1000-01-01' AS starts, DATE '3000-01-01' AS ends UNION ALL SELECT regime, starts, ends FROM regimes),
 k AS (SELECT DISTINCT series_id FROM r),
 x AS (SELECT k.series_id, scope, actual, forecast, row_number() OVER (PARTITION BY k.series_id, scope ORDER BY ts) AS rn
  FROM k CROSS JOIN scopes LEFT JOIN r ON r.series_id = k.series_id AND ts BETWEEN starts AND ends),
 y AS (SELECT *, scope <> 'full' OR rn > 1 AS used FROM x)
 SELECT series_id, scope, sqrt(avg((actual - forecast) ** 2) FILTER (used)) AS rmse,
  sum(abs(actual - forecast)) FILTER (rn > 1) / nullif(count(actual) - 1, 0) AS mae,
  avg(CASE WHEN actual IS NULL THEN NULL WHEN sign(actual) = sign(forecast) THEN 1.0 ELSE 0.0 END) FILTER (used) AS hit_rate
 FROM y GROUP BY 1, 2"""


@query("w11_rolled_persistence_scores", "series_id, scope, rmse:9, mae:9, hit_rate:9", _SHIFTED.format(G1, REGIME_SQL, "g1"))
def rolled_scores(spark, sf):
    return shifted_naive_scores(growth(spark, sf), "month", REGIMES)


@query("w11_rolled_persistence_scores_of_hours", "series_id, scope, rmse:9, mae:9, hit_rate:9", _SHIFTED.format(P3, EVENT_REGIME_SQL, "p3"))
def rolled_hourly_scores(spark, sf):
    return shifted_naive_scores(hourly(spark, sf), "hour", EVENT_REGIMES)
