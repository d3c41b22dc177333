"""Stationarity transforms and row rules of a panel."""

from pyspark.sql import functions as F

from catalog.panels import P1, P2, P3, S3, W2, by_second, daily, hourly, monthly, wide
from catalog.registry import query
from lagmill.operators.panel import (
    date_slice, densify, impute_middle, over_series, running_mean_before, trim_leading_gap, with_positions,
)
from lagmill.operators.transforms import make_stationary, transform

_SQL = {
    1: "x", 2: "x - a", 3: "(x - a) - (a - b)", 4: "ln(x)", 5: "ln(x) - ln(a)",
    6: "(ln(x) - ln(a)) - (ln(a) - ln(b))", 7: "(x / nullif(a, 0) - 1) - (a / nullif(b, 0) - 1)",
}
_NAMES = {
    1: "level", 2: "first_difference", 3: "second_difference", 4: "log", 5: "log_difference",
    6: "second_log_difference", 7: "growth_difference",
}


def _lagged(span: int, source: str = "p1") -> str:
    w = "OVER (PARTITION BY series_id ORDER BY ts)"
    return f"SELECT series_id, ts, value AS x, lag(value, {span}) {w} AS a, lag(value, {2 * span}) {w} AS b FROM {source}"


for _code, _name in _NAMES.items():
    for _span in (1, 3):
        @query(f"t{_code}_{_name}_span{_span}", f"series_id, ts:t, value:{2 if _code < 4 else 9}",
               f"WITH {P1}, l AS ({_lagged(_span)}) SELECT series_id, ts, {_SQL[_code]} AS value FROM l")
        def transform_by(spark, sf, code=_code, span=_span):
            return transform(monthly(spark, sf), "month", code=code, span=span)


def _codes(spark, sf):
    """One code per priority: 2, 3, 5, 6 and 7."""
    code = F.expr("element_at(array(2, 3, 5, 6, 7), CAST(substr(series_id, 1, 1) AS INT))")
    return monthly(spark, sf).select("series_id").distinct().withColumn("tcode", code)


_CASE = "CASE substr(series_id, 1, 1) WHEN '1' THEN {} WHEN '2' THEN {} WHEN '3' THEN {} WHEN '4' THEN {} ELSE {} END".format(
    *[_SQL[c] for c in (2, 3, 5, 6, 7)])


@query("t8_j3_transform_by_code", "series_id, ts:t, value:6",
       f"WITH {P1}, l AS ({_lagged(1)}) SELECT series_id, ts, {_CASE} AS value FROM l")
def by_code(spark, sf):
    return transform(monthly(spark, sf).join(_codes(spark, sf), "series_id"), "month")


@query("t9_make_stationary", "series_id, ts:t, value:6", f"""
 WITH {P1}, l AS ({_lagged(3)}), t AS (SELECT series_id, ts, {_CASE} AS value FROM l),
 f AS (SELECT min(ts) AS first FROM (SELECT ts FROM t GROUP BY ts HAVING count(value) = (SELECT count(DISTINCT series_id) FROM t)))
 SELECT t.* FROM t, f WHERE first IS NULL OR ts >= first""")
def stationary(spark, sf):
    return make_stationary(monthly(spark, sf), _codes(spark, sf), "month", span=3)


@query("t2_first_difference_second_grain", "series_id, ts:t, value:6",
       f"WITH {S3}, l AS ({_lagged(1, 's3')}) SELECT series_id, ts, x - a AS value FROM l")
def difference_second_grain(spark, sf):
    return transform(by_second(spark, sf), "second", code=2)


@query("f5_impute_middle_by_mean", "series_id, ts:t, value:6", f"""
 WITH {P3}, g AS (SELECT series_id, ts, CASE WHEN hour(ts) <> 7 THEN value END AS value FROM p3),
 n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n,
  avg(value) OVER (PARTITION BY series_id) AS m FROM g)
 SELECT series_id, ts, CASE WHEN rn BETWEEN 21 AND n - 20 THEN coalesce(value, m) ELSE value END AS value FROM n""")
def impute(spark, sf):
    return impute_middle(_gappy(spark, sf), ["value"], "hour")


@query("f5_impute_middle_by_earlier_mean", "series_id, ts:t, value:6", f"""
 WITH {P3}, g AS (SELECT series_id, ts, CASE WHEN hour(ts) <> 7 THEN value END AS value FROM p3),
 n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY series_id) AS n,
  avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM g
  WINDOW w AS (PARTITION BY series_id ORDER BY ts))
 SELECT series_id, ts, CASE WHEN rn BETWEEN 21 AND n - 20 THEN coalesce(value, m) ELSE value END AS value FROM n""")
def impute_expanding(spark, sf):
    return impute_middle(_gappy(spark, sf), ["value"], "hour", how="expanding")


def _gappy(spark, sf):
    return hourly(spark, sf).withColumn("value", F.when(F.hour("ts") != 7, F.col("value")))


@query("f6_date_slice", "series_id, ts:t, value:2",
       f"WITH {P2} SELECT * FROM p2 WHERE ts BETWEEN DATE '1997-02-03' AND DATE '1998-11-30'")
def sliced(spark, sf):
    return date_slice(daily(spark, sf), "1997-02-03", "1998-11-30")


@query("f6_date_slice_of_hours", "series_id, ts:t, value:9",
       f"WITH {P3} SELECT * FROM p3 WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-18'")
def sliced_hours(spark, sf):
    """The end is a day: all its hours belong to the slice."""
    return date_slice(hourly(spark, sf), "2024-01-05", "2024-01-17")


@query("f10_trim_leading_gap", "ts:t, A:2, late:2, never_full:2", f"""
 WITH {W2}, v AS (SELECT ts, "A", CASE WHEN ts >= DATE '1996-05-05' AND day(ts) <> 13 THEN "N" END AS late, "R" AS never_full FROM w2),
 f AS (SELECT min(ts) AS first FROM v WHERE "A" IS NOT NULL AND late IS NOT NULL)
 SELECT v.* FROM v, f WHERE first IS NULL OR ts >= first""")
def trimmed(spark, sf):
    late = F.when((F.col("ts") >= F.lit("1996-05-05").cast("date")) & (F.dayofmonth("ts") != 13), F.col("N"))
    frame = wide(spark, sf).select("ts", "A", late.alias("late"), F.col("R").alias("never_full"))
    return trim_leading_gap(frame, ["A", "late"])


@query("f10_trim_without_full_row", "ts:t, A:2, empty:2",
       f'WITH {W2} SELECT ts, "A", CAST(NULL AS DOUBLE) AS empty FROM w2')
def trim_without_full_row(spark, sf):
    return trim_leading_gap(wide(spark, sf).select("ts", "A", F.lit(None).cast("double").alias("empty")), ["A", "empty"])


@query("w15_positions", "series_id, ts:t, idx:i, n:i", f"""
 WITH {P3} SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx,
 count(*) OVER (PARTITION BY series_id) AS n FROM p3""")
def positions(spark, sf):
    return with_positions(hourly(spark, sf), "hour")


@query("w15_positions_second_grain", "series_id, ts:t, idx:i, n:i", f"""
 WITH {S3} SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS idx,
 count(*) OVER (PARTITION BY series_id) AS n FROM s3""")
def positions_second_grain(spark, sf):
    return with_positions(by_second(spark, sf), "second")


@query("w3_w6_rolling_and_running_second_grain", "series_id, ts:t, spread:6, earlier_mean:6, next_value:6", f"""
 WITH {S3} SELECT series_id, ts, CASE WHEN count(value) OVER r = 3 THEN stddev_samp(value) OVER r END AS spread,
 avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_mean,
 lead(value) OVER (PARTITION BY series_id ORDER BY ts) AS next_value
 FROM s3 WINDOW r AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_second_grain(spark, sf):
    rows = with_positions(by_second(spark, sf), "second")

    def build(w):
        frame = w.rowsBetween(-2, 0)
        full = F.count("value").over(frame) == 3
        return {"spread": F.when(full, F.stddev_samp("value").over(frame)), "next_value": F.lead("value").over(w)}

    rolled = over_series(rows, build, "second", back=2, ahead=1, chunk_rows=256)
    return running_mean_before(rolled, "value", "earlier_mean", "second", chunk_rows=256)


@query("panel_densify", "series_id, ts:t, value:6", f"""
 WITH {P3}, e AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM p3 GROUP BY 1),
 s AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e)
 SELECT s.series_id, s.ts, value FROM s LEFT JOIN p3 USING (series_id, ts)""")
def dense(spark, sf):
    return densify(hourly(spark, sf), "hour")
