"""Descriptive statistics, distributions, correlograms and unit-root tests."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.panels import EVENT_REGIME_SQL, EVENT_REGIMES, G1, P2, P3, REGIME_SQL, REGIMES, S3, by_second, daily, growth, hourly, table
from catalog.registry import query
from lagmill.operators.correlogram import acf, pacf
from lagmill.operators.describe import describe, histogram, kernel_density, normal_curve, regime_stats
from lagmill.operators.quantiles import exact_quantiles
from lagmill.operators.unitroot import adf, non_stationary

_COLUMNS = "series_id, count:i, mean:6, std:6, varcof:6, min:6, q25:6, median:6, q75:6, max:6, variance:6, skewness:6, kurtosis:6"


def _describe_sql(source: str, key: str = "series_id", x: str = "value") -> str:
    return f"""SELECT {key} AS series_id, count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std,
 stddev_samp({x}) / nullif(avg({x}), 0) AS varcof, min({x}) AS min, quantile_cont({x}, 0.25) AS q25, median({x}) AS median,
 quantile_cont({x}, 0.75) AS q75, max({x}) AS max, var_samp({x}) AS variance, skewness({x}) AS skewness,
 kurtosis({x}) AS kurtosis FROM {source} GROUP BY 1"""


@query("a1_a18_describe_panel", _COLUMNS, f"WITH {G1} {_describe_sql('g1')}")
def describe_panel(spark, sf):
    return describe(growth(spark, sf), "month")


@query("a1_describe_facts", _COLUMNS.replace("variance:6", "variance:2"),
       _describe_sql("lineitem", "l_returnflag", "l_quantity * (1 - l_discount)"))
def describe_facts(spark, sf):
    """Rows of unknown number per group: quartiles by rank selection, not by one task per group."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("series_id"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("value"))
    return describe(rows)


@query("a9_quantiles_of_large_groups", "l_linestatus, p01:6, p50:6, p99:6", """
 SELECT l_linestatus, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS p50,
 quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1""")
def quantiles_of_large_groups(spark, sf):
    return exact_quantiles(table(spark, sf, "lineitem"), ["l_linestatus"], "l_extendedprice",
                           {"p01": 0.01, "p50": 0.5, "p99": 0.99})


@query("a2_f7_regime_stats", "series_id, pos:i, regime, count:i, mean:9, std:9", f"""
 WITH {G1}, {REGIME_SQL}, s AS (SELECT DISTINCT series_id FROM g1)
 SELECT s.series_id, pos - 1 AS pos, regime, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std
 FROM s CROSS JOIN regimes LEFT JOIN g1 ON g1.series_id = s.series_id AND ts BETWEEN starts AND ends GROUP BY 1, 2, 3""")
def by_regime(spark, sf):
    return regime_stats(growth(spark, sf), REGIMES)


@query("a2_regime_stats_of_hours", "series_id, pos:i, regime, count:i, mean:9, std:9", f"""
 WITH {P3}, {EVENT_REGIME_SQL}, s AS (SELECT DISTINCT series_id FROM p3)
 SELECT s.series_id, pos - 1 AS pos, regime, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std
 FROM s CROSS JOIN regimes LEFT JOIN p3 ON p3.series_id = s.series_id AND ts BETWEEN starts AND ends GROUP BY 1, 2, 3""")
def hours_by_regime(spark, sf):
    return regime_stats(hourly(spark, sf), EVENT_REGIMES)


@query("a14_histogram", "series_id, bin:i, left_edge:4, right_edge:4, count:i", f"""
 WITH {P2}, s AS (SELECT series_id, min(value) AS lo, max(value) AS hi FROM p2 GROUP BY 1),
 b AS (SELECT series_id, lo, hi, (hi - lo) / 30 AS w, unnest(range(1, 31)) AS bin FROM s),
 c AS (SELECT series_id, least(CAST(floor((value - lo) / (hi - lo) * 30) AS INT) + 1, 30) AS bin, count(*) AS c FROM p2 JOIN s USING (series_id) GROUP BY 1, 2)
 SELECT series_id, bin, lo + (bin - 1) * w AS left_edge, lo + bin * w AS right_edge, coalesce(c, 0) AS count
 FROM b LEFT JOIN c USING (series_id, bin)""")
def bins(spark, sf):
    return histogram(daily(spark, sf), "day")


_SPANS = """s AS (SELECT series_id, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_samp(value) AS sd,
 count(value) AS n FROM g1 GROUP BY 1)"""


@query("a14_normal_curve", "series_id, point:i, x:9, density:6", f"""
 WITH {G1}, {_SPANS}, x AS (SELECT *, point, lo + point * ((hi - lo) / 999) AS x FROM s, range(0, 1000) AS r(point))
 SELECT series_id, point, x, exp(-0.5 * ((x - m) / sd) ** 2) / (sd * sqrt(2 * pi())) * n * (hi - lo) / 30 AS density FROM x""")
def curve(spark, sf):
    return normal_curve(growth(spark, sf))


@query("a14_kernel_density", "series_id, point:i, x:9, density:6", f"""
 WITH {G1}, {_SPANS}, x AS (SELECT *, lo + point * ((hi - lo) / 199) AS x, sd * pow(n, -0.2) AS h FROM s, range(0, 200) AS r(point))
 SELECT x.series_id, point, x, sum(exp(-0.5 * ((x - value) / h) ** 2) / (h * sqrt(2 * pi())) * (hi - lo) / 30) AS density
 FROM x JOIN g1 USING (series_id) GROUP BY 1, 2, 3""")
def smooth(spark, sf):
    return kernel_density(growth(spark, sf), "month")


_ACF = """r AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i, value - avg(value) OVER (PARTITION BY series_id) AS d,
  count(*) OVER (PARTITION BY series_id) AS n FROM {0}),
 v AS (SELECT series_id, sum(d * d) AS v, max(n) AS n FROM r GROUP BY 1),
 a AS (SELECT v.series_id, k AS lag, v.n, coalesce((SELECT sum(x.d * y.d) FROM r x JOIN r y ON y.series_id = x.series_id AND y.i = x.i + k
   WHERE x.series_id = v.series_id), 0) / v AS acf FROM v, range(0, {1}) AS g(k))"""


@query("a15_acf", "series_id, lag:i, acf:8, band:6", f"""
 WITH {P3}, {_ACF.format('p3', 41)}
 SELECT a.series_id, a.lag, a.acf, CASE WHEN a.lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(
  (SELECT sum(b.acf * b.acf) FROM a b WHERE b.series_id = a.series_id AND b.lag BETWEEN 1 AND a.lag - 1), 0)) / a.n) END AS band FROM a""")
def correlogram(spark, sf):
    return acf(hourly(spark, sf), "hour")


@query("a15_acf_second_grain", "series_id, lag:i, acf:8", f"WITH {S3}, {_ACF.format('s3', 4)} SELECT * FROM a")
def correlogram_second_grain(spark, sf):
    """Series of unbounded length: chunks of positions, and per-series means by a checked join."""
    return acf(by_second(spark, sf), "second", lags=3)


@query("a14_histogram_of_facts", "series_id, bin:i, count:i", """
 WITH s AS (SELECT l_returnflag AS series_id, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
 c AS (SELECT series_id, least(CAST(floor((l_quantity - lo) / (hi - lo) * 30) AS INT) + 1, 30) AS bin, count(*) AS c FROM lineitem
  JOIN s ON l_returnflag = series_id GROUP BY 1, 2)
 SELECT series_id, bin, coalesce(c, 0) AS count FROM (SELECT series_id, unnest(range(1, 31)) AS bin FROM s) LEFT JOIN c USING (series_id, bin)""")
def bins_of_facts(spark, sf):
    facts = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_quantity").alias("value"))
    return histogram(facts)


@query("d1_dickey_fuller_second_grain", "series_id, adf_stat:5, lags:i, n_obs:i", f"""
 WITH {S3}, d AS (SELECT series_id, value - lag(value) OVER w AS y, lag(value) OVER w AS x FROM s3 WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
 m AS (SELECT series_id, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM d WHERE x IS NOT NULL GROUP BY 1)
 SELECT series_id, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS adf_stat, 0 AS lags, n AS n_obs FROM m""")
def dickey_fuller_second_grain(spark, sf):
    return adf(by_second(spark, sf), "second", maxlag=0, chunk_rows=1024)


@query("a16_pacf_three_lags", "series_id, lag:i, pacf:8", f"""
 WITH {P2}, {_ACF.format('p2', 4)}, w AS (SELECT series_id, max(acf) FILTER (lag = 1) AS r1, max(acf) FILTER (lag = 2) AS r2,
  max(acf) FILTER (lag = 3) AS r3 FROM a GROUP BY 1)
 SELECT series_id, 0 AS lag, 1.0 AS pacf FROM w UNION ALL SELECT series_id, 1, r1 FROM w
 UNION ALL SELECT series_id, 2, (r2 - r1 * r1) / (1 - r1 * r1) FROM w
 UNION ALL SELECT series_id, 3, (r3 - 2 * r1 * r2 + r1 ** 3 + r1 * r2 * r2 - r1 * r1 * r3) / (1 - 2 * r1 * r1 - r2 * r2 + 2 * r1 * r1 * r2) FROM w""")
def partial_three(spark, sf):
    return pacf(daily(spark, sf), "day", lags=3)


@query("a16_pacf", "series_id, lag:i, pacf:6")
def partial(spark, sf):
    return pacf(hourly(spark, sf), "hour")


@query("d1_dickey_fuller_without_lags", "series_id, adf_stat:6, lags:i, n_obs:i", f"""
 WITH {G1}, d AS (SELECT series_id, value - lag(value) OVER w AS y, lag(value) OVER w AS x FROM g1 WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
 m AS (SELECT series_id, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM d WHERE x IS NOT NULL GROUP BY 1)
 SELECT series_id, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS adf_stat, 0 AS lags, n AS n_obs FROM m""")
def dickey_fuller(spark, sf):
    return adf(growth(spark, sf), "month", maxlag=0)


_ONE_LAG = """l AS (SELECT series_id, ts, value AS v, lag(value) OVER w AS x FROM {0} WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
 d AS (SELECT series_id, v - x AS y, x, lag(v - x) OVER (PARTITION BY series_id ORDER BY ts) AS z FROM l),
 s0 AS (SELECT series_id, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS ssr
  FROM d WHERE x IS NOT NULL GROUP BY 1),
 c AS (SELECT series_id, count(*) AS m, regr_syy(y, x) AS yy, regr_sxx(y, x) AS xx, regr_sxy(y, x) AS xy, regr_sxx(y, z) AS zz,
  regr_sxy(y, z) AS zy, regr_sxy(x, z) AS zx FROM d WHERE z IS NOT NULL GROUP BY 1),
 p AS (SELECT *, yy - xy * xy / xx AS ssr0, xx - zx * zx / zz AS xxz, xy - zx * zy / zz AS xyz, yy - zy * zy / zz AS yyz FROM c),
 q AS (SELECT *, yyz - xyz * xyz / xxz AS ssr1 FROM p),
 k AS (SELECT *, m * ln(ssr1 / m) + 6 < m * ln(ssr0 / m) + 4 AS longer FROM q)
 SELECT series_id, CASE WHEN longer THEN xyz / xxz / sqrt(ssr1 / (m - 3) / xxz) ELSE b / sqrt(ssr / (n - 2) / sxx) END AS adf_stat,
  CASE WHEN longer THEN 1 ELSE 0 END AS lags, CASE WHEN longer THEN m ELSE n END AS n_obs FROM k JOIN s0 USING (series_id)"""


@query("d1_adf_up_to_one_lag", "series_id, adf_stat:6, lags:i, n_obs:i", f"""
 WITH {P2}, m AS (SELECT series_id, ts, value / 1e6 AS value FROM p2), {_ONE_LAG.format('m')}""")
def unit_root_one_lag(spark, sf):
    return adf(daily(spark, sf), "day", maxlag=1, chunk_rows=512)


@query("d1_adf_up_to_one_lag_of_persistent_series", "series_id, adf_stat:5, lags:i, n_obs:i", f"""
 WITH {G1}, r AS (SELECT series_id, ts, value + 0.7 * coalesce(lag(value, 1) OVER w, 0) + 0.5 * coalesce(lag(value, 2) OVER w, 0) AS value FROM g1
  WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
 {_ONE_LAG.format('r')}""")
def unit_root_persistent(spark, sf):
    w = W.partitionBy("series_id").orderBy("ts")
    smooth_value = F.col("value") + 0.7 * F.coalesce(F.lag("value", 1).over(w), F.lit(0.0)) + 0.5 * F.coalesce(F.lag("value", 2).over(w), F.lit(0.0))
    return adf(growth(spark, sf).withColumn("value", smooth_value), "month", maxlag=1)


@query("d1_adf", "series_id, adf_stat:6, p_value:6, lags:i, n_obs:i, stationary")
def unit_root(spark, sf):
    return adf(daily(spark, sf), "day")


_BOUND = """ WITH {P2}, q AS (SELECT series_id, ts, sum(value) OVER (PARTITION BY series_id ORDER BY ts) / 1e6 AS value FROM p2),
 d AS (SELECT series_id, value - lag(value) OVER w AS y, lag(value) OVER w AS x FROM q WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
 m AS (SELECT series_id, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM d WHERE x IS NOT NULL GROUP BY 1),
 t AS (SELECT series_id, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS stat FROM m)"""


@query("d2_d3_non_stationary_series", "series_id",
       _BOUND.format(P2=P2) + " SELECT series_id FROM t WHERE stat > -2.8624")
def unit_root_series(spark, sf):
    """Running totals have a unit root; the daily values do not."""
    w = W.partitionBy("series_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    totals = daily(spark, sf).withColumn("value", F.sum("value").over(w) / 1e6)
    return non_stationary(adf(totals, "day", maxlag=0))
