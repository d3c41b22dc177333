import datetime as dt

import numpy as np
import pytest
from helpers import panel
from pyspark.sql import functions as F

from lagmill.operators.describe import histogram
from lagmill.operators.panel import (
    densify, impute_middle, melt, over_series, running_mean_before, trim_leading_gap, with_positions,
)
from lagmill.operators.quantiles import exact_quantiles
from lagmill.operators.transforms import CODES, make_stationary, transform


def values(df, order="ts"):
    return [r.value for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("code", list(CODES))
@pytest.mark.parametrize("span", [1, 3])
def test_transforms_against_numpy(spark, code, span):
    x = np.exp(np.random.default_rng(1).normal(size=40).cumsum() / 10)

    def diff(a):
        return np.concatenate([np.full(span, np.nan), a[span:] - a[:-span]])

    growth = np.concatenate([np.full(span, np.nan), x[span:] / x[:-span] - 1])
    wanted = {1: x, 2: diff(x), 3: diff(diff(x)), 4: np.log(x), 5: diff(np.log(x)), 6: diff(diff(np.log(x))), 7: diff(growth)}
    got = values(transform(panel(spark, x.tolist()), "month", code=code, span=span))
    np.testing.assert_allclose([np.nan if v is None else v for v in got], wanted[code], atol=1e-12)


def test_logs_of_zero_and_negative_are_null(spark):
    assert values(transform(panel(spark, [1.0, 0.0, -1.0]), "month", code=4)) == [0.0, None, None]
    assert values(transform(panel(spark, [1.0, 0.0, 2.0, 3.0]), "month", code=7))[2:] == [None, None]


def test_unknown_code_is_an_error(spark):
    with pytest.raises(ValueError):
        transform(panel(spark, [1.0]), "month", code=9)
    codes = spark.createDataFrame([("s", 9)], "series_id string, tcode int")
    with pytest.raises(Exception, match="unknown transform code 9"):
        make_stationary(panel(spark, [1.0, 2.0]), codes, "month").collect()
    with pytest.raises(Exception, match="unknown transform code NULL"):
        make_stationary(panel(spark, [1.0, 2.0]), codes.where("false"), "month").collect()


def test_trim_keeps_later_gaps_and_all_rows_without_a_full_one(spark):
    rows = [(dt.date(2000, m, 1), a, b) for m, a, b in
            [(1, None, 1.0), (2, 1.0, None), (3, 1.0, 1.0), (4, None, 2.0), (5, 2.0, 2.0)]]
    df = spark.createDataFrame(rows, "ts date, a double, b double")
    assert trim_leading_gap(df, ["a", "b"]).count() == 3
    assert trim_leading_gap(df.where("a is null or b is null"), ["a", "b"]).count() == 3


def test_melt_turns_nan_into_null(spark):
    df = spark.createDataFrame([(1, float("nan"), 2.0)], "id int, `S&P 500` double, b double")
    assert {r.series_id: r.value for r in melt(df, ["id"]).collect()} == {"S&P 500": None, "b": 2.0}


@pytest.mark.parametrize("how", ["full", "expanding"])
def test_impute_needs_more_than_forty_rows(spark, how):
    x = [float(i) for i in range(41)]
    x[20] = x[5] = None
    with pytest.raises(Exception, match="more than 40 rows"):
        impute_middle(panel(spark, x[:40]), ["value"], "month", how=how).collect()
    got = values(impute_middle(panel(spark, x), ["value"], "month", how=how))
    known = [v for v in (x if how == "full" else x[:20]) if v is not None]
    assert got[5] is None and got[20] == pytest.approx(np.mean(known))


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_chunked_windows_equal_whole_series_windows(spark, chunk):
    x = np.random.default_rng(2).normal(size=50).tolist()
    whole = panel(spark, x)
    cut = with_positions(panel(spark, x, grain="second"), "second")

    def build(w):
        return {"a": F.lag("value", 4).over(w), "b": F.lead("value", 2).over(w),
                "c": F.stddev_samp("value").over(w.rowsBetween(-2, 0))}

    columns = ["value", "a", "b", "c", "m"]
    one = running_mean_before(over_series(whole, build, "month", 4, 2), "value", "m", "month")
    two = running_mean_before(over_series(cut, build, "second", 4, 2, chunk_rows=chunk), "value", "m", "second", chunk_rows=chunk)

    def table(df):
        return np.array([[np.nan if r[c] is None else r[c] for c in columns] for r in df.orderBy("ts").collect()])

    np.testing.assert_allclose(table(one), table(two), atol=1e-12)


def test_positions_across_periods(spark):
    rows = spark.createDataFrame(
        [("a", dt.datetime(2020, 1, d, h, 0, s)) for d in (1, 2, 5) for h in (0, 23) for s in (0, 30)],
        "series_id string, ts timestamp_ntz")
    got = with_positions(rows, "second").orderBy("ts").collect()
    assert [r.idx for r in got] == list(range(12)) and {r.n for r in got} == {12}


@pytest.mark.parametrize("x", [
    [3.0], [1.0, 2.0], [5.0] * 50, [1.0] * 30 + [2.0, 3.0], list(map(float, range(1000))),
    np.random.default_rng(3).normal(size=777).round(2).tolist(),
])
def test_quantiles_equal_numpy(spark, x):
    probs = {"lo": 0.0, "p01": 0.01, "q25": 0.25, "mid": 0.5, "q75": 0.75, "p99": 0.99, "hi": 1.0}
    df = spark.createDataFrame([("k", v) for v in [*x, None]], "k string, v double").repartition(3)
    row = exact_quantiles(df, ["k"], "v", probs).first()
    np.testing.assert_allclose([row[n] for n in probs], np.quantile(x, list(probs.values())), atol=1e-12)


def test_quantiles_of_uneven_groups(spark):
    rng = np.random.default_rng(7)
    x = {"hot": rng.normal(size=3000), "a": rng.normal(size=20), "b": np.ones(30)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs], "k string, v double").repartition(4)
    rows = exact_quantiles(df, ["k"], "v", {"q": 0.3, "p99": 0.99}).collect()
    assert len(rows) == 3
    for r in rows:
        np.testing.assert_allclose([r.q, r.p99], np.quantile(x[r.k], [0.3, 0.99]), atol=1e-12)


def test_histogram_of_constant_series(spark):
    rows = histogram(panel(spark, [2.0] * 5)).collect()
    assert len(rows) == 30 and sum(r["count"] for r in rows) == 5


def test_densify(spark):
    df = panel(spark, [1.0, 2.0, 3.0]).where("value <> 2")
    assert values(densify(df, "month")) == [1.0, None, 3.0]


def test_building_a_query_starts_no_job(spark):
    """Size-dependent choices are left to adaptive execution."""
    from lagmill.operators.describe import describe, kernel_density
    from lagmill.operators.views import dependence_curve

    facts = spark.range(1000).selectExpr("concat('s', id % 3) AS series_id", "date '2000-01-01' + cast(id AS int) AS ts", "cast(id AS double) AS value")
    records = facts.selectExpr("series_id", "'f_1' AS feature", "value AS feature_value", "value * 2 AS shap_value")
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        built = [describe(facts), kernel_density(facts), exact_quantiles(facts, ["series_id"], "value", {"m": 0.5}), dependence_curve(records)]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(df.count() for df in built)
