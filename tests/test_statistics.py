import os

import numpy as np
import pytest
from helpers import panel
from pyspark.sql import functions as F

from lagmill.operators.correlogram import pacf
from lagmill.operators.describe import describe, regime_stats
from lagmill.operators.scoring import evaluate
from lagmill.operators.screening import (
    column_stats, correlated_with_earlier, correlations, drop_columns, screen, select_series, too_flat, too_sparse,
)
from lagmill.operators.unitroot import adf, p_value
from lagmill.operators.views import duplicate_records, explanation_matrix
from lagmill.plans.defaults import REGIMES
from lagmill.plans.naive import naive_benchmark
from lagmill.sources.wide_csv import load_univariate, read_text_table, split_code_row
from lagmill.operators.transforms import make_stationary, transform


def adf_by_least_squares(x, maxlag):
    """Plain statement of the test for one series."""
    dx = np.diff(x)

    def fit(lags, skip):
        y = dx[skip:]
        cols = [np.ones(len(y)), x[skip:-1], *[dx[skip - k:-k] for k in range(1, lags + 1)]]
        z = np.column_stack(cols)
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        ssr = ((y - z @ beta) ** 2).sum()
        cov = np.linalg.inv(z.T @ z) * ssr / (len(y) - z.shape[1])
        return len(y) * np.log(ssr / len(y)) + 2 * z.shape[1], beta[1] / np.sqrt(cov[1, 1]), len(y)

    best = min(range(maxlag + 1), key=lambda k: fit(k, maxlag)[0])
    return fit(best, best)[1], best, fit(best, best)[2]


@pytest.mark.parametrize("chunk", [40, 1000])
def test_adf_against_plain_least_squares(spark, chunk):
    rng = np.random.default_rng(4)
    x = np.convolve(rng.normal(size=160), [1, 0.8, 0.5, -0.4, 0.3], "valid").cumsum()
    row = adf(panel(spark, x.tolist()), "month", chunk_rows=chunk).first()
    stat, lags, n = adf_by_least_squares(x, int(np.ceil(12 * (len(x) / 100) ** 0.25)))
    assert (row.lags, row.n_obs) == (lags, n) and row.adf_stat == pytest.approx(stat, abs=1e-9)


def test_adf_undefined(spark):
    both = panel(spark, [1.0] * 30, "flat").union(panel(spark, [1.0, 2.0], "short"))
    rows = adf(both, "month").collect()
    assert len(rows) == 2 and all(r.adf_stat is None and r.p_value is None and r.stationary is False for r in rows)


@pytest.mark.parametrize("stat, p", [
    (-7.297028888112367, 1.3694252284733488e-10), (-2.8229736265422183, 0.05506634309463705),
    (-3.2017302611457077, 0.019884743110904563), (-20.341644686941017, 0.0), (-15.219667714321737, 5.507721957196452e-28),
])
def test_p_values(stat, p):
    assert p_value(stat) == pytest.approx(p, rel=1e-9, abs=1e-300)


def test_pacf_of_an_autoregression_cuts_off(spark):
    rng, x = np.random.default_rng(6), [0.0]
    for e in rng.normal(size=4000):
        x.append(float(0.6 * x[-1] + e))
    rows = {r.lag: r.pacf for r in pacf(panel(spark, x, grain="second"), "second", 5).collect()}
    assert rows[1] == pytest.approx(0.6, abs=0.05) and all(abs(rows[k]) < 0.05 for k in (2, 3, 4, 5))


def test_describe_short_and_empty_regimes(spark):
    row = describe(panel(spark, [1.0, 2.0]), "month").first()
    assert row["skewness"] is None and row["kurtosis"] is None and row["std"] == pytest.approx(0.5 ** 0.5)
    rows = {r.regime: r for r in regime_stats(panel(spark, [1.0, 2.0]), REGIMES).collect()}
    assert rows["pre-GFC"]["count"] == 2 and rows["COVID"]["count"] == 0 and rows["COVID"]["mean"] is None


def test_zero_forecast_of_zero_is_a_hit(spark):
    df = panel(spark, [0.0, 1.0]).select("series_id", "ts", F.lit("m").alias("model"), F.col("value").alias("actual"),
                                         F.lit(0.0).alias("forecast"))
    full = evaluate(df, {}).first()
    assert (full.hit_rate, full.n) == (0.5, 2)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=200), rng.normal(size=200)
    near, far = a + 0.2 * rng.normal(size=200), a + 0.4 * rng.normal(size=200)
    rows = []
    for i in range(200):
        rows.append((float(b[i]), float(a[i]), float(near[i]), float(near[i] + far[i] - a[i]), 1.0,
                     None if i < 40 else float(rng.normal()), None if i < 41 else float(rng.normal()), "text"))
    return spark.createDataFrame(rows, "y double, a double, b double, c double, flat double, fifth double, more double, t string").repartition(4)


def test_screening_limits(spark, table):
    stats = column_stats(table, ["fifth", "more", "flat"])
    assert [r.variable for r in too_sparse(stats).collect()] == ["more"]
    assert [r.variable for r in too_flat(stats).collect()] == ["flat"]
    edge = column_stats(spark.createDataFrame([(0.0,), (2.0,)], "v double"), ["v"])
    assert too_flat(edge, 2.0).count() == 1 and too_flat(edge, 1.99).count() == 0


def test_correlation_rule_is_not_greedy(spark, table):
    pairs = {(r.i, r.j): r.corr for r in correlations(table, ["a", "b", "c", "flat", "fifth"]).collect()}
    assert pairs[(0, 1)] > 0.95 and pairs[(1, 2)] > 0.9 and pairs[(0, 3)] is None
    dropped = {r.pos for r in correlated_with_earlier(correlations(table, ["a", "b", "c"]), min(pairs[0, 1], pairs[1, 2]) - 1e-9).collect()}
    assert dropped == {1, 2}
    frame = table.toPandas()
    assert pairs[(0, 4)] == pytest.approx(frame["a"].corr(frame["fifth"]), abs=1e-12)


def test_screen_and_selection(table):
    assert screen(table, "t", "y") == ["a", "c", "fifth"]
    assert screen(table, "t", "a") == ["y", "b", "c", "fifth"]
    with pytest.raises(ValueError, match="lacks columns: nope"):
        drop_columns(table, ["nope"])
    with pytest.raises(ValueError, match="unknown selection"):
        select_series(table, "other")


def test_duplicates_and_matrix(spark):
    rows = [("s", "d1", 1, "f", 1.0), ("s", "d1", 2, "f", 2.0), ("s", "d1", 1, "g", 3.0)]
    df = spark.createDataFrame(rows, "series_id string, origin_date string, forecast_date int, feature string, shap_value double")
    assert [(r.feature, r["size"]) for r in duplicate_records(df).collect()] == [("f", 2)]
    assert explanation_matrix(df, ["f", "g"]).select("f", "g").first() == (2.0, 3.0)


# Published statistics of the monthly industrial production index (raw level, log difference) and of the
# naive forecasts of its growth. The index file is not part of the repository; name one to run these tests.
INDEX_CSV = os.environ.get("MONTHLY_INDEX_CSV")
RAW = {"count": 803, "mean": 68.12147621419676, "std": 26.836031184886565, "varcof": 0.393943770397827, "min": 21.9998,
       "q25": 45.200050000000005, "median": 63.1363, "q75": 96.4514, "max": 104.1004, "variance": 720.1725697562042,
       "skewness": -0.10960486268938852, "kurtosis": -1.468669103847302}
CHANGE = {"count": 802, "mean": 0.0019101158216737457, "std": 0.009896737463680885, "varcof": 5.181223751661736,
          "min": -0.1414224790154561, "q25": -0.001952331374836725, "median": 0.00230692753337175,
          "q75": 0.006416725799718275, "max": 0.0634724915918267, "variance": 9.794541242502475e-05,
          "skewness": -3.7169529876074794, "kurtosis": 59.18656063988031}
SCORES = {
    "Naive_Zero": [(0.009758604539207596, 0.005670520962698502, 0.0), (0.006742664968084927, 0.0052486934455759585, 0.0),
                   (0.014221643587282937, 0.009628664559958942, 0.0), (0.005088008511139036, 0.004129516666313324, 0.0),
                   (0.028277546127060554, 0.013457583622320269, 0.0), (0.005789977074515499, 0.0045548151013672855, 0.0)],
    "Naive_Persistence": [
        (0.012047797888662701, 0.00672146831580997, 0.6033898305084746), (0.007893759972968265, 0.005756496473734462, 0.6370967741935484),
        (0.015505427587173447, 0.009490360484225685, 0.7391304347826086), (0.006540412831113099, 0.0051364459704505774, 0.5546875),
        (0.03585412320110141, 0.018855653057066595, 0.631578947368421), (0.009475088336981036, 0.007999704364664384, 0.2413793103448276)],
    "Naive_RollingMean_12": [
        (0.009695784605239512, 0.005418114782646376, 0.6338983050847458), (0.006427079419057595, 0.004846013388809513, 0.6693548387096774),
        (0.015410994224378196, 0.010923852723519008, 0.21739130434782608), (0.004902172344721945, 0.003943754127940029, 0.6328125),
        (0.028347942662580488, 0.013142344030673875, 0.6578947368421053), (0.005939429394923314, 0.0047762940324604965, 0.4827586206896552)],
}


@pytest.mark.skipif(not INDEX_CSV, reason="MONTHLY_INDEX_CSV names no file")
def test_published_statistics(spark):
    text = read_text_table(spark, INDEX_CSV)
    raw = load_univariate(text, start=None, end=None)
    change = make_stationary(raw, split_code_row(text)[1], "month").persist()
    for df, wanted in ((raw, RAW), (change, CHANGE)):
        for grain in ("month", None):
            row = describe(df, grain).first()
            for name, value in wanted.items():
                assert row[name] == pytest.approx(value, rel=1e-11), name
    row = adf(change, "month").first()
    assert (row.lags, row.n_obs, row.stationary) == (10, 791, True)
    assert row.adf_stat == pytest.approx(-7.297028888112367, abs=1e-9)
    scored = naive_benchmark(change, "month").orderBy("pos").collect()
    for model, rows in SCORES.items():
        got = [(r.rmse, r.mae, r.hit_rate) for r in scored if r.model == model]
        np.testing.assert_allclose(got, rows, rtol=1e-12)


def test_statistics_and_scores_of_a_series_made_by_rule(spark):
    """The published checks on a series that needs no file: all values against plain numpy and pandas."""
    import pandas as pd

    n = 240
    level = [100 + 0.3 * k + 7 * np.sin(k / 5) + 3 * np.cos(k * k / 11) for k in range(n)]
    change = pd.Series(np.diff(np.log(level)))
    months = pd.date_range("1990-02-01", periods=n - 1, freq="MS")
    raw = panel(spark, [float(v) for v in level], start="1990-01-01")
    df = transform(raw, "month", code=5).where(F.col("value").isNotNull())
    for rows, x in ((raw, pd.Series(level)), (df, change)):
        row = describe(rows, "month").first()
        wanted = {"count": len(x), "mean": x.mean(), "std": x.std(), "min": x.min(), "q25": x.quantile(0.25), "median": x.median(),
                  "q75": x.quantile(0.75), "max": x.max(), "variance": x.var(), "skewness": x.skew(), "kurtosis": x.kurt()}
        for name, value in wanted.items():
            assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-12), name
    cut = months[len(months) // 2]
    regimes = {"old": ("1900-01-01", str(cut.date())), "new": (str((cut + pd.Timedelta(days=1)).date()), "2100-01-01")}
    got = {(r.model, r.scope): (r.n, r.rmse, r.mae) for r in naive_benchmark(df, "month", None, None, regimes).collect()}
    forecasts = {"Naive_Zero": change * 0, "Naive_Persistence": change.shift(1), "Naive_RollingMean_12": change.expanding().mean().shift(1)}
    for model, forecast in forecasts.items():
        for scope, inside in (("full", months == months), ("old", months <= cut), ("new", months > cut)):
            error = (change - forecast)[inside].dropna()
            count, rmse, mae = got[model, scope]
            assert count == len(error)
            assert (rmse, mae) == pytest.approx((np.sqrt((error ** 2).mean()), error.abs().mean()), rel=1e-9)
