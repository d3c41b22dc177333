"""Backtests: tuned, fitted and explained at every origin."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from catalog.panels import G1, P1, P2, PRIORITIES, REGIME_SQL, REGIMES, daily, entities, growth, text_table
from catalog.registry import query
from catalog.scoring import _SCORES
from lagmill.functions.fits import fit_elastic_net
from lagmill.operators.explain import linear_contributions
from lagmill.operators.features import assemble, lag_features
from lagmill.operators.origins import Expanding, background_rows, live_rows
from lagmill.operators.scoring import evaluate
from lagmill.plans.backtest import BacktestConfig, Model, model_of, run_backtest
from lagmill.plans.boosted import run_boosted
from lagmill.plans.study import forecast_table, prepare, run_models, score_table, stationarity

_W = "OVER (PARTITION BY series_id ORDER BY ts)"
ONE_LAG = BacktestConfig(nlags=1, volatility=False, origins=Expanding(initial=40, interval=12), v=12)
GRID = [{"alpha": a, "l1_ratio": r} for a in (0.001, 0.01, 0.1) for r in (0.0, 0.5, 1.0)]
GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {p['alpha']}::DOUBLE, {p['l1_ratio']}::DOUBLE)" for i, p in enumerate(GRID)) + ") AS g(grid_pos, alpha, l1))"


def _fit_sql(p: str, rows: str, clip_x: bool = True, clip_y: bool = True) -> str:
    """Winsorized, scaled moments of the sets in ``rows``(series_id, s, idx, x, y): <p>m(series_id, s, low, high, med,
    iqr, mz, my, cov, var) and <p>z with the scaled rows."""
    (x0, x1), (y0, y1) = ((0.01, 0.99) if c else (0, 1) for c in (clip_x, clip_y))
    return f"""{p}q AS (SELECT series_id, s, quantile_cont(x, {x0}) AS low, quantile_cont(x, {x1}) AS high, quantile_cont(y, {y0}) AS ylow,
  quantile_cont(y, {y1}) AS yhigh, max(idx) AS last FROM {rows} GROUP BY 1, 2),
 {p}c AS (SELECT r.series_id, r.s, idx, last, low, high, least(greatest(x, low), high) AS x, least(greatest(y, ylow), yhigh) AS y
  FROM {rows} r JOIN {p}q USING (series_id, s)),
 {p}s AS (SELECT series_id, s, median(x) AS med, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM {p}c GROUP BY 1, 2),
 {p}z AS (SELECT series_id, s, idx, last, low, high, med, iqr, (x - med) / iqr AS z, y FROM {p}c JOIN {p}s USING (series_id, s)),
 {p}m AS (SELECT series_id, s, any_value(low) AS low, any_value(high) AS high, any_value(med) AS med, any_value(iqr) AS iqr, avg(z) AS mz,
  avg(y) AS my, covar_pop(y, z) AS cov, var_pop(z) AS var FROM {p}z GROUP BY 1, 2)"""


_WEIGHT = "sign(cov) * greatest(abs(cov) - alpha * l1, 0) / (var + alpha * (1 - l1))"


def _backtest_sql(clip_x: bool = True, clip_y: bool = True, valid: str = "TRUE") -> str:
    """Whole backtest of one lag: with a single feature the elastic net has a closed form. Cycles that are not ``valid`` keep
    the last choice before them."""
    live = "least(greatest(x_live, low), high)" if clip_x else "x_live"
    x = "least(greatest(x, low), high)" if clip_x else "x"
    return f"""{G1}, {GRID_SQL}, f AS (SELECT series_id, ts, row_number() {_W} - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n, value AS x,
  lead(value) {_W} AS y, lead(ts) {_W} AS target_ts FROM g1),
 cy AS (SELECT series_id, idx + 1 AS s FROM f WHERE idx + 1 BETWEEN 40 AND n - 1 AND (idx + 1 - 40) % 12 = 0),
 tt AS (SELECT cy.series_id, s, idx, x, y FROM cy JOIN f ON f.series_id = cy.series_id AND idx <= s - 2 - 12 - 1), {_fit_sql('t', 'tt', clip_x, clip_y)},
 tv AS (SELECT cy.series_id, cy.s, grid_pos, avg(abs(y - (my - w * mz + w * ({x} - med) / iqr))) AS mae
  FROM cy JOIN f ON f.series_id = cy.series_id AND idx BETWEEN cy.s - 1 - 12 AND cy.s - 2
  JOIN (SELECT *, {_WEIGHT} AS w FROM tm CROSS JOIN grid) m ON m.series_id = cy.series_id AND m.s = cy.s GROUP BY 1, 2, 3),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, s ORDER BY mae, grid_pos) AS k FROM tv WHERE {valid}) WHERE k = 1),
 ch AS (SELECT cy.series_id, cy.s, coalesce(last_value(grid_pos IGNORE NULLS) OVER (PARTITION BY cy.series_id ORDER BY cy.s), 0) AS grid_pos,
  grid_pos IS NOT NULL AS chosen FROM cy LEFT JOIN best USING (series_id, s)),
 og AS (SELECT series_id, idx + 1 AS s, 40 + (idx + 1 - 40) // 12 * 12 AS cycle_start, x AS x_live, ts AS origin_date, target_ts AS forecast_date, y AS actual
  FROM f WHERE idx + 1 BETWEEN 40 AND n - 1),
 fr AS (SELECT og.series_id, s, idx, f.x, f.y FROM og JOIN f ON f.series_id = og.series_id AND idx <= s - 2), {_fit_sql('u', 'fr', clip_x, clip_y)},
 bg AS (SELECT series_id, s, avg(z) AS mbg FROM uz WHERE idx > last - 100 GROUP BY 1, 2),
 bt AS (SELECT og.series_id, og.s AS origin_idx, origin_date, forecast_date, actual, b.grid_pos, og.s = cycle_start AND chosen AS tuned, w,
   {live} AS feature_value, ({live} - med) / iqr AS z_live, mbg, my - w * mz AS c
  FROM og JOIN ch b ON b.series_id = og.series_id AND b.s = cycle_start
  JOIN (SELECT *, {_WEIGHT} AS w FROM um CROSS JOIN grid) m ON m.series_id = og.series_id AND m.s = og.s AND m.grid_pos = b.grid_pos
  JOIN bg ON bg.series_id = og.series_id AND bg.s = og.s)"""


_BACKTEST = _backtest_sql()


def _one_lag(spark, sf):
    return run_backtest(growth(spark, sf), model_of("elasticnet").with_grid(GRID), ONE_LAG)


@query("m10_m3_m9_backtest_forecasts", "series_id, origin_idx:i, origin_date:t, forecast_date:t, forecast_logdiff:8, actual_logdiff:8",
       f"WITH {_BACKTEST} SELECT *, c + w * z_live AS forecast_logdiff, actual AS actual_logdiff FROM bt")
def backtest_forecasts(spark, sf):
    return _one_lag(spark, sf).forecasts()


@query("x1_x4_r3_backtest_explanations", "series_id, origin_date:t, forecast_date:t, feature, feature_value:8, shap_value:8, prediction:8, base_value:8",
       f"WITH {_BACKTEST} SELECT *, 'lag_0' AS feature, w * (z_live - mbg) AS shap_value, c + w * z_live AS prediction, c + w * mbg AS base_value FROM bt")
def backtest_explanations(spark, sf):
    return _one_lag(spark, sf).explanations()


@query("m4_a13_backtest_tuned_points", "series_id, origin_idx:i, origin_date:t, alpha:4, l1_ratio:2",
       f"WITH {_BACKTEST} SELECT bt.*, alpha, l1 AS l1_ratio FROM bt JOIN grid USING (grid_pos) WHERE tuned")
def backtest_choices(spark, sf):
    return _one_lag(spark, sf).tuned_params()


@query("w9_m10_choices_carried_over_cycles", "series_id, origin_idx:i, grid_pos:i, tuned, forecast_logdiff:8",
       f"WITH {_backtest_sql(valid='(s - 14) // 12 % 2 = 1')} SELECT *, c + w * z_live AS forecast_logdiff FROM bt")
def backtest_with_failed_cycles(spark, sf):
    """A fit whose errors are all NaN in every other tuning cycle: such a cycle keeps the choice before it."""
    def fit(x, y, points):
        found = fit_elastic_net(x, y, points)
        return replace(found, weights=found.weights * np.nan) if len(points) > 1 and len(y) // 12 % 2 == 0 else found

    return run_backtest(growth(spark, sf), Model("elasticnet", fit, GRID), ONE_LAG).fits


for _mode, _name in (("features", "features_only"), (False, "off")):
    @query(f"m2_backtest_winsorizing_{_name}", "series_id, origin_idx:i, forecast_logdiff:8, alpha:4, l1_ratio:2",
           f"WITH {_backtest_sql(bool(_mode), False)} SELECT bt.*, c + w * z_live AS forecast_logdiff, alpha, l1 AS l1_ratio FROM bt JOIN grid USING (grid_pos)")
    def backtest_winsorizing(spark, sf, mode=_mode):
        """Forecasts with the point in force; unclipped values beyond the training range keep their size."""
        run = run_backtest(growth(spark, sf), replace(model_of("elasticnet").with_grid(GRID), winsorize=mode), ONE_LAG)
        alphas, ratios = (F.array(*[F.lit(p[k]) for p in GRID]) for k in ("alpha", "l1_ratio"))
        return run.fits.withColumns({"alpha": F.get(alphas, F.col("grid_pos")), "l1_ratio": F.get(ratios, F.col("grid_pos"))})


@query("m10_a4_backtest_scores", "series_id, scope, n:i, rmse:8, mae:8, hit_rate:8", f"""
 WITH {_BACKTEST}, {REGIME_SQL}, scopes AS (SELECT 'full' AS scope, DATE '1000-01-01' AS starts, DATE '3000-01-01' AS ends
  UNION ALL SELECT regime, starts, ends FROM regimes), p AS (SELECT series_id, forecast_date, actual, c + w * z_live AS forecast FROM bt)
 SELECT k.series_id, scope, count(actual) AS n, {_SCORES} FROM (SELECT DISTINCT series_id FROM p) k CROSS JOIN scopes
 LEFT JOIN p ON p.series_id = k.series_id AND forecast_date BETWEEN starts AND ends GROUP BY 1, 2""")
def backtest_scores(spark, sf):
    return evaluate(_one_lag(spark, sf).forecasts(), REGIMES, ["series_id"], "forecast_date", "actual_logdiff", "forecast_logdiff")


@query("x1_linear_contributions", "series_id, feature_pos:i, feature_value:4, shap_value:6, base_value:6", f"""
 WITH {P2}, f AS (SELECT series_id, ts, row_number() {_W} - 1 AS idx, value / 1e6 AS x0, lag(value) {_W} / 1e6 AS x1, lead(value) {_W} AS t FROM p2),
 b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx DESC) AS k FROM f WHERE x1 IS NOT NULL AND t IS NOT NULL),
 m AS (SELECT series_id, avg(x0) AS m0, avg(x1) AS m1 FROM b WHERE k <= 100 GROUP BY 1),
 l AS (SELECT series_id, max_by(x0, idx) AS x0, max_by(x1, idx) AS x1 FROM f GROUP BY 1)
 SELECT series_id, feature_pos, CASE feature_pos WHEN 0 THEN x0 ELSE x1 END AS feature_value,
  CASE feature_pos WHEN 0 THEN 0.75 * (x0 - m0) ELSE -0.5 * (x1 - m1) END AS shap_value, 0.25 + 0.75 * m0 - 0.5 * m1 AS base_value
 FROM m JOIN l USING (series_id), range(0, 2) AS r(feature_pos)""")
def linear_parts(spark, sf):
    """Explanation of one fixed linear forecast, without any Python worker."""
    rows = daily(spark, sf).withColumn("value", F.col("value") / 1e6)
    features = assemble(lag_features(rows, "value", "day", 2, volatility=False, univariate=True), ["lag_0", "lag_1"])
    weights = features.select("series_id").distinct().withColumns({
        "weights": F.array(F.lit(0.75), F.lit(-0.5)), "intercept": F.lit(0.25)})
    return linear_contributions(live_rows(features), background_rows(features), weights)


_FORECAST = "series_id, origin_idx:i, origin_date:t, forecast_date:t, forecast_logdiff:6, actual_logdiff:6"
TWO_LAGS = BacktestConfig(nlags=3, origins=Expanding(initial=40, interval=12), v=12)


@query("m5_huber_backtest", _FORECAST)
def huber(spark, sf):
    return run_backtest(growth(spark, sf), model_of("huber"), TWO_LAGS).forecasts()


@query("m6_gradient_descent_backtest", _FORECAST)
def gradient_descent(spark, sf):
    model = model_of("sgd")
    return run_backtest(growth(spark, sf), model.with_grid(model.grid[::12]), TWO_LAGS).forecasts()


@query("m8_x3_network_explanations", "series_id, origin_date:t, forecast_date:t, feature, feature_value:6, shap_value:6, prediction:6, base_value:6")
def network(spark, sf):
    model = model_of("mlp")
    return run_backtest(growth(spark, sf), model.with_grid(model.grid[:20:4]), TWO_LAGS).explanations()


@query("m4_multivariate_elastic_net_backtest", _FORECAST)
def multivariate_elastic_net(spark, sf):
    config = BacktestConfig(target="sales", nlags=3, predictor_lags={"orders": 1, "ticket": 1}, univariate=False,
                            origins=Expanding(initial=40, interval=12), v=12)
    return run_backtest(entities(spark, sf), model_of("elasticnet", "multivariate"), config).forecasts()


def _boosted(spark, sf, explain):
    config = BacktestConfig(nlags=3, origins=Expanding(initial=56, interval=12), v=12)
    return run_boosted(growth(spark, sf), config, [{"max_depth": 2, "n_estimators": 3}, {"max_depth": 3, "n_estimators": 3}], explain=explain)


@query("m7_boosted_trees_backtest", _FORECAST)
def boosted(spark, sf):
    return _boosted(spark, sf, False)[0]


@query("x2_boosted_trees_explanations", "series_id, origin_date:t, forecast_date:t, feature, feature_value:6, shap_value:6, prediction:6, base_value:6")
def boosted_explanations(spark, sf):
    return _boosted(spark, sf, True)[1]


_STUDY_FRAME = f"""{P1}, gx AS (SELECT series_id, ts, ln(value) - lag(ln(value)) OVER (PARTITION BY series_id ORDER BY ts) AS value FROM ps),
 pw AS (SELECT ts, {{pivot}} FROM gx GROUP BY ts),
 ff AS (SELECT min(ts) AS first FROM pw WHERE {{full}}), pt AS (SELECT pw.* FROM pw, ff WHERE first IS NULL OR ts >= first),
 pn AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM pt)"""
_STUDY_SQL = _STUDY_FRAME.format(
    pivot=", ".join(f"max(value) FILTER (series_id = '{p}') AS \"{p}\"" for p in PRIORITIES),
    full=" AND ".join(f'"{p}" IS NOT NULL' for p in PRIORITIES),
).replace("gx AS", """pd AS (SELECT DISTINCT ts FROM p1), pk AS (SELECT DISTINCT series_id FROM p1),
 ps AS (SELECT pk.series_id, pd.ts, value FROM pd CROSS JOIN pk LEFT JOIN p1 ON p1.series_id = pk.series_id AND p1.ts = pd.ts), gx AS""", 1)


def _prepared(spark, sf):
    return prepare(text_table(spark, sf), "multivariate", "1-URGENT", start="1995-06-01", end="2001-06-01",
                   drop_first=(), drop_last=())


@query("study_modeling_frame", "ts:t, " + ", ".join(f"{p}:9" for p in PRIORITIES), f"""WITH {_STUDY_SQL} SELECT * FROM (
 SELECT ts, {', '.join(f'CASE WHEN rn BETWEEN 21 AND n - 20 THEN coalesce("{p}", avg("{p}") OVER ()) ELSE "{p}" END AS "{p}"' for p in PRIORITIES)} FROM pn)
 WHERE ts BETWEEN DATE '1995-06-01' AND DATE '2001-06-01'""")
def study_frame(spark, sf):
    """Text table to modeling frame: select, transform by code, trim, fill, cut. A column that is not selected is NULL."""
    prepared = _prepared(spark, sf)
    return prepared.frame.withColumns({c: F.lit(None).cast("double") for c in PRIORITIES if c not in prepared.variables})


@query("study_stationarity", "variable, adf_stat:6, p_value:6, lags:i, n_obs:i, stationary")
def study_stationarity(spark, sf):
    return stationarity(_prepared(spark, sf))


@query("study_scores_with_naive_reference", "model_type, model_class, scope, n:i, rmse:6, mae:6, hit_rate:6, naive_rmse:6, naive_mae:6, naive_hit_rate:6")
def study_scores(spark, sf):
    """Two model classes on one shared frame, scored beside the zero forecast."""
    runs = run_models(_prepared(spark, sf), "multivariate", ["elasticnet", "huber"], "1-URGENT", nlags=3,
                      origins=Expanding(initial=40, interval=12), v=12)
    return score_table(forecast_table(runs, "multivariate"), REGIMES)


def _structure_sql(models: list[str], initial: int, features: int, source: str = "g1") -> str:
    """What any backtest must return whatever its numbers: one forecast per origin, its actual, full additivity."""
    names = ", ".join(f"('{m}')" for m in models)
    return f"""f AS (SELECT series_id, ts, row_number() {_W} - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n, lead(value) {_W} AS y, lead(ts) {_W} AS target_ts FROM {source})
 SELECT model_class, series_id, count(*) AS origins, min(ts) AS first_origin, max(target_ts) AS last_forecast, sum(y) AS actual_total,
  count(*) * {features} AS records, 0.0 AS gap FROM f CROSS JOIN (VALUES {names}) AS m(model_class) WHERE idx + 1 BETWEEN {initial} AND n - 1 GROUP BY 1, 2"""


_STRUCTURE = "model_class, series_id, origins:i, first_origin:t, last_forecast:t, actual_total:8, records:i, gap:6"


def _structure(fits):
    parts = F.expr("aggregate(shap_values, base_value, (s, x) -> s + x)")
    return fits.groupBy("model_class", "series_id").agg(
        F.count(F.lit(1)).alias("origins"), F.min("origin_date").alias("first_origin"),
        F.max("forecast_date").alias("last_forecast"), F.sum("actual_logdiff").alias("actual_total"),
        F.sum(F.size("shap_values")).alias("records"), F.max(F.abs(parts - F.col("forecast_logdiff"))).alias("gap"))


@query("m5_m6_m8_x1_x3_backtest_structure", _STRUCTURE, f"WITH {G1}, {_structure_sql(['huber', 'sgd', 'mlp'], 52, 4)}")
def backtest_structure(spark, sf):
    config = BacktestConfig(nlags=3, origins=Expanding(initial=52, interval=12), v=12)
    runs = []
    for name, step in (("huber", 12), ("sgd", 63), ("mlp", 15)):
        model = model_of(name)
        fits = run_backtest(growth(spark, sf), model.with_grid(model.grid[:2 * step:step]), config).fits
        runs.append(fits.withColumn("model_class", F.lit(name)))
    return _structure(runs[0].unionByName(runs[1]).unionByName(runs[2]))


@query("m7_x2_boosted_structure", _STRUCTURE, f"WITH {G1}, {_structure_sql(['lightgbm'], 64, 2)}")
def boosted_structure(spark, sf):
    config = BacktestConfig(nlags=2, volatility=False, origins=Expanding(initial=64, interval=12), v=12)
    forecasts, records, _ = run_boosted(growth(spark, sf), config, [{"max_depth": 2, "n_estimators": 2}], explain=True)
    keys = ["series_id", "origin_date", "forecast_date"]
    values = records.groupBy(*keys, "base_value").agg(F.collect_list("shap_value").alias("shap_values"))
    return _structure(forecasts.join(values, keys))
