"""Regimes kept as a table: built from facts, overlapping, and of each series its own."""

from pyspark.sql import functions as F

from catalog.panels import G1, S3, by_second, growth, table
from catalog.registry import query
from catalog.scoring import _NAIVE, _SCORES
from lagmill.operators.intervals import evaluate_regime_table, regime_table_stats, with_regimes
from lagmill.operators.scoring import naive_forecasts

_PEAKS = """pk AS (SELECT o_orderpriority AS series_id, CAST(year(o_orderdate) AS VARCHAR) AS regime, CAST(o_orderdate AS DATE) AS starts,
  row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderdate DESC) AS rn FROM orders),
 regimes AS (SELECT series_id, regime, starts, CAST(starts + INTERVAL 400 DAY AS DATE) AS ends FROM pk WHERE rn = 1)"""
_SURGES = """sg AS (SELECT event_type AS series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS regime, ts AS starts,
  row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY value DESC, ts DESC) AS rn FROM events),
 regimes AS (SELECT series_id, regime, starts, starts + INTERVAL 30 HOUR AS ends FROM sg WHERE rn = 1)"""
_HELD = "regimes ON regimes.series_id = {0}.series_id AND ts BETWEEN starts AND ends"


def peaks(spark, sf):
    """One regime per priority and year: 400 days from the day of the year's largest order, into the next year's."""
    top = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").cast("string").alias("regime")).agg(
        F.max(F.struct("o_totalprice", "o_orderdate"))["o_orderdate"].cast("date").alias("starts"))
    return top.withColumn("ends", F.date_add("starts", 400))


def surges(spark, sf):
    """One regime per event type and day: 30 hours from the moment of the day's largest value."""
    top = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").cast("string").alias("regime")).agg(
        F.max(F.struct("value", "ts"))["ts"].alias("starts"))
    return top.withColumn("ends", F.expr("starts + INTERVAL 30 HOURS"))


@query("j2_regimes_of_a_table", "series_id, ts:t, regime, value:9",
       f"WITH {G1}, {_PEAKS} SELECT g1.series_id, ts, regime, value FROM g1 JOIN {_HELD.format('g1')}")
def held(spark, sf):
    return with_regimes(growth(spark, sf), peaks(spark, sf))


@query("j2_regimes_of_a_table_of_seconds", "series_id, ts:t, regime",
       f"WITH {S3}, {_SURGES} SELECT s3.series_id, ts, regime FROM s3 JOIN {_HELD.format('s3')}")
def held_seconds(spark, sf):
    return with_regimes(by_second(spark, sf), surges(spark, sf), bucket_days=1)


@query("a2_stats_of_a_regime_table", "series_id, regime, count:i, mean:9, std:9", f"""WITH {G1}, {_PEAKS}
 SELECT g1.series_id, regime, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std FROM g1 JOIN {_HELD.format('g1')} GROUP BY 1, 2""")
def stats(spark, sf):
    return regime_table_stats(growth(spark, sf), peaks(spark, sf))


@query("a4_scores_of_a_regime_table", "series_id, model, regime, n:i, rmse:9, mae:9, hit_rate:9", f"""
 WITH {G1}, {_NAIVE.format('g1')}, {_PEAKS}, ff AS (SELECT * FROM f WHERE forecast IS NOT NULL)
 SELECT ff.series_id, model, regime, count(*) AS n, {_SCORES} FROM ff JOIN {_HELD.format('ff')} GROUP BY 1, 2, 3""")
def scores(spark, sf):
    return evaluate_regime_table(naive_forecasts(growth(spark, sf), "month"), peaks(spark, sf))
