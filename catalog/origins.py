"""Lag features, forecast origins, folds and limits."""

from pyspark.sql import functions as F

from catalog.panels import E1, G1, P3, entities, growth, hourly
from catalog.registry import query
from lagmill.operators.features import assemble, complete_rows, feature_names, lag_features
from lagmill.operators.origins import (
    Expanding, background_rows, best_point, carry_forward, hv_folds, live_rows, origin_limits, origin_table, with_grid,
)

_W = "OVER (PARTITION BY series_id ORDER BY ts)"
_R3 = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_UNI = feature_names("value", univariate=True)
_UNI_SQL = ", ".join(f"lag(value, {k}) {_W} AS lag_{k}" for k in range(12))
_LAGS = {"orders": 2, "ticket": 1}
_MULTI = feature_names("sales", 3, _LAGS)


@query("w1_w3_w4_lag_features", "series_id, ts:t, " + ", ".join(f"{c}:6" for c in (*_UNI, "target")), f"""
 WITH {P3}, f AS (SELECT series_id, ts, {_UNI_SQL}, stddev_samp(value) {_R3} AS volatility_3m, lead(value) {_W} AS target FROM p3)
 SELECT * FROM f WHERE lag_11 IS NOT NULL""")
def lagged(spark, sf):
    return complete_rows(lag_features(hourly(spark, sf), "value", "hour", univariate=True), _UNI)


@query("w2_multivariate_lag_features", "series_id, ts:t, " + ", ".join(f"{c}:6" for c in (*_MULTI, "target")), f"""
 WITH {E1}, f AS (SELECT series_id, ts, sales AS sales_lag0, lag(sales, 1) {_W} AS sales_lag1, lag(sales, 2) {_W} AS sales_lag2,
 stddev_samp(sales) {_R3} AS volatility_3m, orders AS orders_lag0, lag(orders, 1) {_W} AS orders_lag1, ticket AS ticket_lag0,
 lead(sales, 3) {_W} AS target FROM e1) SELECT * FROM f WHERE sales_lag2 IS NOT NULL""")
def multivariate(spark, sf):
    return complete_rows(lag_features(entities(spark, sf), "sales", "month", 3, _LAGS, horizon=3), _MULTI)


def _features(spark, sf):
    """Features of monthly growth with some values missing."""
    gappy = growth(spark, sf).withColumn("value", F.when(F.month("ts") + F.year("ts") != 2001, F.col("value")))
    names = feature_names("value", 3, univariate=True)
    return assemble(lag_features(gappy, "value", "month", 3, univariate=True), names)


_FEATURES = f"""{G1}, gg AS (SELECT series_id, ts, CASE WHEN month(ts) + year(ts) <> 2001 THEN value END AS value FROM g1),
 fx AS (SELECT series_id, ts, row_number() {_W} - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n, value AS x0,
  lag(value, 1) {_W} AS x1, lag(value, 2) {_W} AS x2, CASE WHEN count(value) {_R3} = 3 THEN stddev_samp(value) {_R3} END AS x3,
  lead(value) {_W} AS target, lead(ts) {_W} AS target_ts FROM gg),
 ft AS (SELECT *, x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AS complete FROM fx)"""
_ORIGINS = """og AS (SELECT series_id, idx + 1 AS origin_idx, target_ts AS forecast_date, target AS actual FROM ft
  WHERE idx + 1 BETWEEN 30 AND n - 1),
 tr AS (SELECT og.series_id, origin_idx, ft.idx, x0, x1, x2, x3, target FROM og JOIN ft ON ft.series_id = og.series_id
  AND ft.idx <= origin_idx - 2 AND complete AND target IS NOT NULL),
 lv AS (SELECT og.series_id, origin_idx, max_by(ft.ts, ft.idx) AS origin_date, max(ft.idx) AS live_idx FROM og JOIN ft
  ON ft.series_id = og.series_id AND ft.idx < origin_idx AND complete GROUP BY 1, 2)"""
_PLAN = Expanding(initial=30, interval=12)


@query("w7_w8_forecast_origins", "series_id, origin_idx:i, origin_date:t, live_idx:i, forecast_date:t, actual:9, train_rows:i, cycle:i, tunes", f"""
 WITH {_FEATURES}, {_ORIGINS}, c AS (SELECT series_id, origin_idx, count(*) AS train_rows FROM tr GROUP BY 1, 2)
 SELECT og.*, origin_date, live_idx, coalesce(train_rows, 0) AS train_rows, (og.origin_idx - 30) // 12 AS cycle, (og.origin_idx - 30) % 12 = 0 AS tunes
 FROM og LEFT JOIN lv USING (series_id, origin_idx) LEFT JOIN c USING (series_id, origin_idx)""")
def origins(spark, sf):
    return origin_table(_features(spark, sf), _PLAN)


@query("w13_background_rows", "series_id, idx:i, target:9", f"""
 WITH {_FEATURES}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS k FROM ft WHERE complete AND target IS NOT NULL)
 SELECT * FROM r WHERE k <= 20""")
def background(spark, sf):
    return background_rows(_features(spark, sf), 20)


@query("w14_live_rows", "series_id, idx:i, origin_date:t, volatility:9", f"""
 WITH {_FEATURES} SELECT series_id, max(idx) AS idx, max_by(ts, idx) AS origin_date, max_by(x3, idx) AS volatility FROM ft WHERE complete GROUP BY 1""")
def live(spark, sf):
    return live_rows(_features(spark, sf)).withColumn("volatility", F.get("features", F.lit(3)))


_POS = "CASE feature_pos WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END"
_LIMITS = f"""WITH {_FEATURES}, {_ORIGINS}, l AS (SELECT series_id, origin_idx, feature_pos, {_POS} AS x, target FROM tr, range(0, 4) AS p(feature_pos)),
 q AS (SELECT series_id, origin_idx, feature_pos, count(*) AS train_rows, quantile_cont(x, 0.01) AS low, quantile_cont(x, 0.99) AS high,
  quantile_cont(target, 0.01) AS target_low, quantile_cont(target, 0.99) AS target_high FROM l GROUP BY 1, 2, 3),
 c AS (SELECT l.series_id, l.origin_idx, l.feature_pos, least(greatest(x, low), high) AS x FROM l JOIN q USING (series_id, origin_idx, feature_pos)),
 s AS (SELECT series_id, origin_idx, feature_pos, median(x) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS d FROM c GROUP BY 1, 2, 3),
 z AS (SELECT q.*, median, CASE WHEN d > 0 THEN d ELSE 1 END AS iqr, least(greatest({_POS}, low), high) AS live_clipped FROM q
  JOIN s USING (series_id, origin_idx, feature_pos) JOIN lv USING (series_id, origin_idx)
  JOIN ft ON ft.series_id = q.series_id AND ft.idx = live_idx)
 SELECT *, (live_clipped - median) / iqr AS live_scaled FROM z"""


@query("a9_a10_f18_limits_and_scales", "series_id, origin_idx:i, feature_pos:i, train_rows:i, low:8, high:8, median:8, iqr:8, live_clipped:8, live_scaled:6, target_low:8, target_high:8",
       _LIMITS)
def limits(spark, sf):
    return origin_limits(_features(spark, sf), _PLAN, "month")


def _fold_sql(n_splits: int, source: str) -> str:
    """Folds over ``source``(series_id, n) with h = 1 and v = 24."""
    single = f"""SELECT series_id, 0 AS fold, greatest(n - 24, 0) - 1 AS train_end, greatest(n - 24, 0) AS val_start, n AS val_end
 FROM {source} WHERE greatest(n - 24, 0) - 1 > 0"""
    if n_splits < 2:
        return single
    enough = f"n >= {n_splits} * 24 + 2"
    return f"""{single} AND NOT {enough} UNION ALL SELECT series_id, fold, n - ({n_splits} - fold) * 24 - 1, n - ({n_splits} - fold) * 24,
 n - ({n_splits} - fold - 1) * 24 FROM {source}, range(0, {n_splits}) AS r(fold) WHERE {enough}"""


@query("m1_single_block_folds", "series_id, fold:i, train_end:i, val_start:i, val_end:i",
       f"WITH {P3}, c AS (SELECT concat(series_id, CAST(floor(sqrt(day(ts))) AS INT)) AS series_id, count(*) AS n FROM p3 GROUP BY 1) {_fold_sql(1, 'c')}")
def single_block(spark, sf):
    """Series of 3 to 9 days; the shortest have too few rows to train on."""
    key = F.concat("series_id", F.floor(F.sqrt(F.dayofmonth("ts").cast("double"))).cast("int").cast("string"))
    parts = hourly(spark, sf).groupBy(key.alias("series_id")).agg(F.count(F.lit(1)).alias("n"))
    return parts.select("series_id", F.inline(hv_folds(F.col("n"))))


@query("m1_two_block_folds", "series_id, fold:i, train_end:i, val_start:i, val_end:i",
       f"WITH {G1}, c AS (SELECT concat(series_id, year(ts) < 2000) AS series_id, count(*) AS n FROM g1 GROUP BY 1) {_fold_sql(2, 'c')}")
def two_block(spark, sf):
    key = F.concat("series_id", (F.year("ts") < 2000).cast("string"))
    parts = growth(spark, sf).groupBy(key.alias("series_id")).agg(F.count(F.lit(1)).alias("n"))
    return parts.select("series_id", F.inline(hv_folds(F.col("n"), 2)))


_SHRINK = [{"weight": w, "use_sign": s} for w in (-0.5, -0.25, 0.0, 0.25) for s in (0, 1)]
_GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {p['weight']}::DOUBLE, {p['use_sign']})" for i, p in enumerate(_SHRINK)) + ") AS g(grid_pos, weight, use_sign))"


@query("j5_series_by_grid", "series_id, grid_pos:i, weight:2, use_sign:i",
       f"WITH {G1}, {_GRID_SQL} SELECT * FROM (SELECT DISTINCT series_id FROM g1) CROSS JOIN grid")
def jobs(spark, sf):
    return with_grid(growth(spark, sf).select("series_id").distinct(), _SHRINK)


def _fold_scores(spark, sf):
    """Validation error of forecasting next month's growth as a multiple of this month's, per fold and grid point."""
    rows = lag_features(growth(spark, sf), "value", "month", 1, volatility=False, univariate=True).where("target IS NOT NULL")
    folds = rows.withColumn("f", F.explode(hv_folds(F.col("n") - 1, 2)))
    inside = folds.where((F.col("idx") >= F.col("f.val_start")) & (F.col("idx") < F.col("f.val_end")))
    forecast = F.col("weight") * F.when(F.col("use_sign") == 1, F.signum("value")).otherwise(F.col("value"))
    return with_grid(inside, _SHRINK).groupBy("series_id", F.col("f.fold").alias("fold"), "grid_pos").agg(
        F.avg(F.abs(F.col("target") - forecast)).alias("mae"))


_FOLD_SCORES = f"""{G1}, {_GRID_SQL}, r AS (SELECT series_id, row_number() {_W} - 1 AS idx, value, lead(value) {_W} AS target FROM g1),
 t AS (SELECT * FROM r WHERE target IS NOT NULL), c AS (SELECT series_id, count(*) AS n FROM t GROUP BY 1), folds AS ({_fold_sql(2, 'c')}),
 fs AS (SELECT t.series_id, fold, grid_pos, avg(abs(target - weight * CASE use_sign WHEN 1 THEN sign(value) ELSE value END)) AS mae
  FROM t JOIN folds ON folds.series_id = t.series_id AND idx >= val_start AND idx < val_end CROSS JOIN grid GROUP BY 1, 2, 3)"""


@query("j6_fold_scores", "series_id, fold:i, grid_pos:i, mae:9", f"WITH {_FOLD_SCORES} SELECT * FROM fs")
def fold_scores(spark, sf):
    return _fold_scores(spark, sf)


@query("a12_a13_best_grid_point", "series_id, grid_pos:i, mae:9", f"""WITH {_FOLD_SCORES},
 m AS (SELECT series_id, grid_pos, avg(mae) AS mae FROM fs GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, grid_pos) AS k FROM m) SELECT * FROM k WHERE k = 1""")
def best(spark, sf):
    return best_point(_fold_scores(spark, sf), ["series_id"])


@query("w9_carry_choice_forward", "series_id, cycle:i, choice:i", f"""
 WITH {G1}, c AS (SELECT series_id, year(ts) AS cycle, max(CASE WHEN abs(value) > 0.25 AND month(ts) BETWEEN 3 AND 6 THEN month(ts) END) AS choice FROM g1 GROUP BY 1, 2)
 SELECT series_id, cycle, last_value(choice IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS choice FROM c""")
def carried(spark, sf):
    picked = F.when((F.abs("value") > 0.25) & F.month("ts").between(3, 6), F.month("ts"))
    cycles = growth(spark, sf).groupBy("series_id", F.year("ts").alias("cycle")).agg(F.max(picked).alias("choice"))
    return carry_forward(cycles)
