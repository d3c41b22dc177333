import time

import numpy as np
import pandas as pd
import pytest
from helpers import panel
from pyspark.sql import functions as F

from catalog import QUERIES
from lagmill.functions.fits import LinearFit, fit_elastic_net, fit_huber, fit_network, fit_sgd, permutation_shapley
from lagmill.operators.origins import Expanding, carry_forward, fold_slices, hv_folds, origin_blocks
from lagmill.operators.ranks import RankIndex
from lagmill.plans.backtest import BacktestConfig, Model, model_of, run_backtest, tune
from lagmill.plans.boosted import run_boosted
from lagmill.plans.defaults import DOMAIN_GROUPS, model_grid
from lagmill.plans.study import prepare, run_all, score_table, stationarity

RNG = np.random.default_rng(5)
X = RNG.normal(size=(120, 6)) @ RNG.normal(size=(6, 6))
Y = 0.01 * (X @ np.array([1.0, -1.0, 0.0, 0.5, 0.0, 0.0]) + RNG.standard_t(2, size=120))


def test_grid_sizes_and_order():
    sizes = {"elasticnet": 84, "huber": 72, "sgd": 252, "mlp": 60, "lightgbm": 6}
    assert {m: len(model_grid(m)) for m in sizes} == sizes
    assert len(model_grid("sgd", "multivariate")) == 216 and len(model_grid("mlp", "multivariate")) == 50
    assert model_grid("lightgbm")[:3] == [{"max_depth": 3, "n_estimators": 100}, {"max_depth": 3, "n_estimators": 500},
                                          {"max_depth": 5, "n_estimators": 100}]
    assert sum(map(len, DOMAIN_GROUPS.values())) == 15


def test_elastic_net_meets_the_optimality_conditions():
    points = [{"alpha": a, "l1_ratio": r} for a in (1e-4, 1e-3, 1e-2) for r in (0.0, 0.3, 1.0)]
    fit = fit_elastic_net(X, Y, points)
    for p, w, c in zip(points, fit.weights.T, fit.intercepts):
        pull = X.T @ (Y - X @ w - c) / len(Y) - p["alpha"] * (1 - p["l1_ratio"]) * w
        limit = p["alpha"] * p["l1_ratio"]
        assert np.all(np.abs(pull) <= limit + 1e-10)
        np.testing.assert_allclose(pull[w != 0], limit * np.sign(w[w != 0]), atol=1e-10)
        assert abs((Y - X @ w - c).mean()) < 1e-12


def huber_value(w, c, s, eps, alpha):
    z = np.abs(X @ w + c - Y) / s
    return (s + np.where(z > eps, 2 * eps * z - eps * eps, z * z) * s).sum() + alpha * w @ w


@pytest.mark.parametrize("eps", [1.0, 1.35, 2.0])
@pytest.mark.parametrize("alpha", [0.001, 1.0])
def test_huber_is_a_minimum(eps, alpha):
    fit = fit_huber(X, Y, [{"alpha": alpha, "epsilon": eps}])
    w, c = fit.weights[:, 0], fit.intercepts[0]
    scales = np.exp(np.linspace(-12, 0, 4001))
    values = [huber_value(w, c, s, eps, alpha) for s in scales]
    best, scale = min(values), scales[int(np.argmin(values))]
    for _ in range(200):
        d = RNG.normal(size=7) * 1e-4
        assert huber_value(w + d[:6], c + d[6], scale, eps, alpha) >= best - 1e-9


def test_grid_fits_equal_single_fits():
    for fit, points in ((fit_huber, model_grid("huber")[::20]), (fit_sgd, model_grid("sgd")[::60]),
                        (fit_elastic_net, model_grid("elasticnet")[::20])):
        together = fit(X, Y, points)
        for i, p in enumerate(points):
            alone = fit(X, Y, [p])
            np.testing.assert_allclose(together.weights[:, i], alone.weights[:, 0], atol=1e-7)


@pytest.mark.parametrize("act", ["relu", "tanh"])
def test_network_gradient_and_seed(act):
    point = {"hidden": 4, "activation": act, "alpha": 1e-3}
    one, two = fit_network(X, 100 * Y, [point]), fit_network(X, 100 * Y, [point])
    np.testing.assert_array_equal(one.predict(X), two.predict(X))
    assert np.mean((one.predict(X)[:, 0] - 100 * Y) ** 2) < np.var(100 * Y)


def test_sampled_shapley_is_additive_and_exact_for_linear_models():
    w = RNG.normal(size=6)
    values, base = permutation_shapley(lambda rows: rows @ w + 1.0, X[0], X[20:])
    np.testing.assert_allclose(values, w * (X[0] - X[20:].mean(0)), atol=1e-10)
    assert base + values.sum() == pytest.approx(X[0] @ w + 1.0)


@pytest.mark.parametrize("n", [10, 25, 26, 49, 50, 73, 74, 300])
@pytest.mark.parametrize("splits", [1, 2, 3])
def test_folds_in_plan_and_in_task_agree(spark, n, splits):
    rows = spark.range(1).select(F.inline(hv_folds(F.lit(n), splits))).orderBy("fold").collect()
    assert [(r.train_end, r.val_start, r.val_end) for r in rows] == [
        (t.stop, v.start, v.stop) for t, v in fold_slices(n, splits, 1, 24)]


def test_fold_geometry():
    assert fold_slices(25, 1, 1, 24) == []
    assert fold_slices(26, 1, 1, 24) == [(slice(0, 1), slice(2, 26))]
    assert fold_slices(100, 2, 1, 24) == [(slice(0, 51), slice(52, 76)), (slice(0, 75), slice(76, 100))]


def test_first_grid_point_wins_ties():
    model = model_of("elasticnet").with_grid([{"alpha": 1e9, "l1_ratio": 1.0}] * 3)
    assert tune(model, X, Y, 1, 1, 24) == 0
    assert tune(model, X[:20], Y[:20], 1, 1, 24) is None


def test_carry_forward(spark):
    rows = spark.createDataFrame([("s", 0, None), ("s", 1, 3), ("s", 2, None)], "series_id string, cycle int, choice int")
    assert [r.choice for r in carry_forward(rows).orderBy("cycle").collect()] == [None, 3, 3]


CONFIG = BacktestConfig(nlags=2, origins=Expanding(initial=40, interval=12, tasks_per_series=2))


def series(n=70, seed=8):
    x = np.random.default_rng(seed).normal(size=n) * 0.01
    return (x + 0.5 * np.concatenate([[0.0], x[:-1]])).tolist()


def fits(spark, values, model, config=CONFIG):
    return run_backtest(panel(spark, values), model, config).fits.orderBy("origin_idx").toPandas()


SMALL = {"elasticnet": model_of("elasticnet").with_grid(model_grid("elasticnet")[:9:4]),
         "huber": model_of("huber").with_grid(model_grid("huber")[:2]),
         "sgd": model_of("sgd").with_grid(model_grid("sgd")[:2]),
         "mlp": model_of("mlp").with_grid(model_grid("mlp")[:2])}


@pytest.mark.parametrize("name", list(SMALL))
def test_backtest_properties(spark, name):
    got = fits(spark, series(), SMALL[name])
    assert got.origin_idx.tolist() == list(range(40, 70))
    assert got.origin_idx[got.tuned].tolist() == [40, 52, 64]
    total = got.base_value + got.shap_values.map(sum)
    np.testing.assert_allclose(total, got.forecast_logdiff, atol=1e-12)
    changed = series()
    changed[60:] = [9.0] * 10
    again = fits(spark, changed, SMALL[name])
    early = got.origin_idx <= 60
    np.testing.assert_array_equal(got.forecast_logdiff[early], again.forecast_logdiff[early])
    np.testing.assert_allclose(got.actual_logdiff, series()[40:])


def test_blocks_do_not_change_forecasts(spark):
    many = BacktestConfig(nlags=2, origins=Expanding(initial=40, interval=12, tasks_per_series=32))
    one, two = fits(spark, series(), SMALL["elasticnet"]), fits(spark, series(), SMALL["elasticnet"], many)
    pd.testing.assert_series_equal(one.forecast_logdiff, two.forecast_logdiff)


def test_panel_run_equals_runs_of_its_series(spark):
    a, b = panel(spark, series(seed=1), "a"), panel(spark, series(60, seed=2), "b")
    both = run_backtest(a.union(b), SMALL["elasticnet"], CONFIG).forecasts().toPandas()
    for name, df in (("a", a), ("b", b)):
        alone = run_backtest(df, SMALL["elasticnet"], CONFIG).forecasts().toPandas().sort_values("origin_idx")
        part = both[both.series_id == name].sort_values("origin_idx")
        np.testing.assert_array_equal(part.forecast_logdiff, alone.forecast_logdiff)


def test_stale_live_row_repeats_its_origin_date(spark):
    values = series()
    values[50] = None
    got = fits(spark, values, SMALL["elasticnet"])
    dates = got.set_index("origin_idx").origin_date
    assert dates[50] == dates[51] == dates[52] and dates[54] > dates[50]


def test_short_series_gives_no_rows(spark):
    assert fits(spark, series(40), SMALL["elasticnet"]).empty


def test_three_steps_ahead(spark):
    config = BacktestConfig(nlags=2, origins=Expanding(initial=40, interval=12, horizon=3))
    got = fits(spark, series(), SMALL["elasticnet"], config)
    assert got.origin_idx.tolist() == list(range(40, 68))
    np.testing.assert_allclose(got.actual_logdiff, series()[42:])


def test_all_models_of_a_type(spark, tmp_path):
    rng = np.random.default_rng(3)
    levels = np.exp(rng.normal(size=(75, 3)).cumsum(0) / 50)
    rows = [(f"{1 + i % 12}/1/{2000 + i // 12}", *map(str, map(float, v))) for i, v in enumerate(levels)]
    text = spark.createDataFrame([("Transform:", "5.0", "5.0", "2.0"), *rows], "sasdate string, INDPRO string, a string, b string")
    prepared = prepare(text, "multivariate", start=None, end=None, drop_first=(), drop_last=())
    assert prepared.frame.count() == 74 and list(prepared.variables) == ["INDPRO", "a", "b"]
    assert stationarity(prepared).where("stationary").count() == 3
    grids = {"elasticnet": [{"alpha": 0.01, "l1_ratio": 0.5}], "huber": [{"alpha": 0.01, "epsilon": 1.35}],
             "sgd": [{"alpha": 0.01, "epsilon": 1.0, "l1_ratio": 0.15}], "mlp": [{"hidden": 2, "activation": "tanh", "alpha": 0.1}],
             "lightgbm": [{"max_depth": 2, "n_estimators": 2}]}
    forecasts, records = run_all(prepared, "multivariate", str(tmp_path), grids=grids, nlags=2,
                                 origins=Expanding(initial=60, interval=12))
    assert {r.model_class: r["count"] for r in forecasts.groupBy("model_class").count().collect()} == dict.fromkeys(grids, 14)
    assert records.count() == 5 * 14 * 5
    scores = score_table(forecasts).where("scope = 'full'").collect()
    assert len(scores) == 5 and len({r.naive_rmse for r in scores}) == 1 and all(r.n == 14 for r in scores)


def test_study_frame_when_columns_are_screened_out(spark, sf_dir, tmp_path):
    """On many orders the monthly values of priorities go together: one is made the copy of another here."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority <> '3-MEDIUM'")
    copy = orders.where("o_orderpriority = '2-HIGH'").withColumn("o_orderpriority", F.lit("3-MEDIUM"))
    orders.unionByName(copy).write.parquet(f"{tmp_path}/orders.parquet")
    frame = QUERIES["study_modeling_frame"](spark, str(tmp_path))
    assert frame.columns == ["ts", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = frame.collect()
    assert len(rows) == 73 and all(r["3-MEDIUM"] is None for r in rows)
    assert all(r[c] is not None for r in rows for c in ("1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"))



def test_boosted_explanations_are_additive(spark):
    config = BacktestConfig(nlags=2, volatility=False, origins=Expanding(initial=60, interval=12), v=12)
    forecasts, records, tuned = run_boosted(panel(spark, series()), config, [{"max_depth": 2, "n_estimators": 3}], explain=True)
    assert forecasts.count() == 10 and tuned.count() == 1
    sums = records.groupBy("origin_date", "prediction", "base_value").agg(F.sum("shap_value").alias("s"), F.count("*").alias("c")).toPandas()
    np.testing.assert_allclose(sums.base_value + sums.s, sums.prediction, atol=1e-10)
    assert set(sums.c) == {2}


def test_boosted_trees_forecast_every_origin(spark):
    """A missing feature does not cost an origin: the newest complete row before it stands in, as in the other backtests."""
    values = np.random.default_rng(4).normal(size=70).tolist()
    values[60] = None
    df = panel(spark, values)
    config = BacktestConfig(nlags=2, origins=Expanding(initial=50, interval=12), v=12)
    forecasts, _, _ = run_boosted(df, config, [{"max_depth": 2, "n_estimators": 2}], explain=False)
    others = run_backtest(df, model_of("elasticnet").with_grid([{"alpha": 0.1, "l1_ratio": 0.5}]), config).forecasts()
    places = lambda rows: sorted((r.origin_idx, str(r.origin_date), str(r.forecast_date)) for r in rows.collect())
    assert places(forecasts) == places(others)


def test_tree_values_equal_all_subsets():
    """Against the definition: every subset of features, every background row."""
    import itertools
    from math import factorial

    from lagmill.operators.explain import ensemble_leaves, exact_tree_values

    text = """GBTRegressionModel: uid=x, numTrees=2, numFeatures=4
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.1)
     If (feature 2 <= -0.5)
      Predict: 1.5
     Else (feature 2 > -0.5)
      If (feature 0 <= -1.0)
       Predict: 4.0
      Else (feature 0 > -1.0)
       Predict: -2.0
    Else (feature 0 > 0.1)
     Predict: 0.25
  Tree 1 (weight 0.1):
    If (feature 1 <= 0.0)
     Predict: -3.0
    Else (feature 1 > 0.0)
     If (feature 3 <= 1.0E-2)
      Predict: 7.0
     Else (feature 3 > 1.0E-2)
      Predict: 1.0
"""
    leaves = ensemble_leaves(text, 4)
    assert len(leaves.value) == 7
    predict = lambda rows: ((rows[:, None] > leaves.low) & (rows[:, None] <= leaves.high)).all(axis=2) @ leaves.value
    rng = np.random.default_rng(6)
    back = rng.normal(size=(9, 4))
    for x in rng.normal(size=(20, 4)):
        worth = {s: predict(np.where(np.isin(np.arange(4), s), x, back)).mean() for n in range(5) for s in itertools.combinations(range(4), n)}
        wanted = [sum(factorial(len(s)) * factorial(3 - len(s)) / 24 * (worth[tuple(sorted((*s, f)))] - worth[s])
                      for s in worth if f not in s) for f in range(4)]
        values, base = exact_tree_values(x, back, leaves)
        np.testing.assert_allclose(values, wanted, atol=1e-12)
        assert base == pytest.approx(worth[()]) and base + values.sum() == pytest.approx(predict(x[None])[0])


@pytest.mark.parametrize("n", [1, 2, 7, 300])
@pytest.mark.parametrize("ties", [False, True])
def test_rank_index_equals_sorting(n, ties):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 5, n).astype(float) if ties else rng.normal(size=n)
    index = RankIndex(x)
    start = rng.integers(0, n, 50)
    end = np.array([rng.integers(s + 1, n + 1) for s in start])
    for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0):
        assert index.quantile(start, end, p).tolist() == [np.quantile(x[s:e], p) for s, e in zip(start, end)]
        low, high = np.quantile(x, (0.2, 0.7))
        assert index.quantile(start, end, p, low, high).tolist() == [np.quantile(np.clip(x[s:e], low, high), p) for s, e in zip(start, end)]


def test_limits_of_a_long_series_cost_n_log_n():
    """10,000 origins of a series of 10,000 rows; twice the rows take far less than four times the time."""
    def seconds(n):
        x = np.random.default_rng(1).normal(size=n)
        begun = time.process_time()
        index, end = RankIndex(x), np.arange(1, n + 1)
        found = [index.quantile(np.zeros(n, np.int64), end, p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)]
        taken = time.process_time() - begun
        assert [f[-1] for f in found] == np.quantile(x, (0.01, 0.25, 0.5, 0.75, 0.99)).tolist()
        return taken

    seconds(1000)
    assert min(seconds(10_000) for _ in range(3)) < 1
    assert min(seconds(40_000) for _ in range(3)) < 10 * min(seconds(10_000) for _ in range(3))


@pytest.mark.parametrize("plan", [Expanding(), Expanding(40, 12, 3, tasks_per_series=5), Expanding(30, 1, max_train_rows=50)])
@pytest.mark.parametrize("n", [10, 41, 100, 101, 113, 691, 20_000])
def test_blocks_part_cycles_by_work(plan, n):
    blocks = [plan.block_of(c, n) for c in range(plan.cycles(n))]
    assert blocks == sorted(blocks) and set(blocks) == set(range(plan.blocks(n) if blocks else 0))
    if n == 20_000:
        work = [sum(plan.work(c + 1) - plan.work(c) for c in range(len(blocks)) if blocks[c] == b) for b in set(blocks)]
        assert max(work) < 1.5 * np.median(work)


def test_blocks_in_plan_and_in_task_agree(spark):
    plan = Expanding(30, 5, tasks_per_series=7)
    n = 163
    rows = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("idx"), F.lit(n).alias("n"))
    seen = origin_blocks(rows, plan, "month").groupBy("idx").agg(F.min("block").alias("first"), F.max("block").alias("last")).collect()
    for r in seen:
        cycle = max((r.idx - plan.initial + 1) // plan.interval, 0)
        assert (r.first, r.last) == (plan.block_of(cycle, n), plan.blocks(n) - 1)


def test_a_cycle_without_a_finite_error_keeps_the_choice_before_it(spark):
    """Choices cross blocks: with two cycles a block, each other block has none of its own."""
    def fit(x, y, points):
        weights = np.array([[p["w"]] for p in points]).T * np.ones((x.shape[1], 1))
        return LinearFit(weights * (np.nan if len(points) > 1 and len(y) > 60 else 1), np.zeros(len(points)))

    model = Model("own", fit, [{"w": 1e6}, {"w": 0.0}])
    values = np.cumsum(np.random.default_rng(2).normal(size=200)).tolist()
    config = BacktestConfig(nlags=1, volatility=False, origins=Expanding(initial=40, interval=12), v=12)
    fits = run_backtest(panel(spark, values), model, config).fits.orderBy("origin_idx").collect()
    last = [r.grid_pos for r in fits if r.tuned][-1]
    assert {r.tuned for r in fits if r.origin_idx > 90} == {False}
    assert {r.grid_pos for r in fits if r.origin_idx > 90} == {last} == {1}
