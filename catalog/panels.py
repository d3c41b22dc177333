"""Panels over the test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.operators.panel import exact_sum, panel_from_facts, truncate, widen
from lagmill.operators.transforms import transform
from lagmill.sources.wide_csv import to_text_table

#: Borders inside the events, whose grain is finer than a day.
EVENT_REGIMES = {"first": ("2024-01-01", "2024-01-10"), "second": ("2024-01-11", "2024-01-20"), "third": ("2024-01-21", "2024-12-31")}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FLAGS = ("A", "N", "R")
REGIMES = {
    "early": ("1900-01-01", "1997-06-30"),
    "middle": ("1997-07-01", "1999-12-31"),
    "late": ("2000-01-01", "2001-12-31"),
    "after": ("2002-01-01", "2100-01-01"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark, sf) -> DataFrame:
    """Monthly order value by priority."""
    return panel_from_facts(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", exact_sum(F.col("o_totalprice")), "month")


def growth(spark, sf) -> DataFrame:
    """Log growth of the monthly panel."""
    return transform(monthly(spark, sf), "month", code=5).where(F.col("value").isNotNull())


def daily(spark, sf) -> DataFrame:
    """Daily shipped value by return flag."""
    return panel_from_facts(table(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", exact_sum(F.col("l_extendedprice")), "day")


def event_mean():
    return exact_sum(F.col("value")) / F.count("value")


def hourly(spark, sf) -> DataFrame:
    """Hourly mean event value by type; hours without events are missing."""
    return panel_from_facts(table(spark, sf, "events"), "event_type", "ts", event_mean(), "hour")


def by_second(spark, sf) -> DataFrame:
    """Event value by type at second grain: series of unbounded length."""
    return panel_from_facts(table(spark, sf, "events"), "event_type", "ts", event_mean(), "second")


def entities(spark, sf) -> DataFrame:
    """Monthly frame per priority with three variables: order value in millions, order count, mean order value."""
    value = exact_sum(F.col("o_totalprice")) / 1e6
    orders = F.count(F.lit(1)).cast("double")
    return (
        table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), truncate(F.col("o_orderdate"), "month").alias("ts"))
        .agg(value.alias("sales"), orders.alias("orders"), (value / orders).alias("ticket")))


def wide(spark, sf) -> DataFrame:
    """Weekly wide table: one column per flag, a constant, a scaled copy, a column with 80% NULL and one with 20%."""
    a, day = F.col("A"), F.date_diff("ts", F.lit("1990-01-01").cast("date"))
    weekly = panel_from_facts(table(spark, sf, "lineitem"), "l_returnflag", "l_shipdate", exact_sum(F.col("l_extendedprice")), "week")
    return widen(weekly, FLAGS).withColumns({
        "flat": F.lit(1.0), "copy": a * 2 + 1, "sparse": F.when(day % 5 == 0, F.col("N")),
        "fifth": F.when(day % 5 != 0, F.col("R"))})


_CENTS = "CAST(SUM(CAST(round({0} * 100) AS BIGINT)) AS DOUBLE) / 100"
P1 = f"""p1 AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
  {_CENTS.format('o_totalprice')} AS value FROM orders GROUP BY 1, 2)"""
G1 = P1 + """, g0 AS (SELECT series_id, ts, ln(value) - lag(ln(value)) OVER (PARTITION BY series_id ORDER BY ts) AS value FROM p1),
 g1 AS (SELECT * FROM g0 WHERE value IS NOT NULL)"""
P2 = f"""p2 AS (SELECT l_returnflag AS series_id, CAST(date_trunc('day', l_shipdate) AS DATE) AS ts,
  {_CENTS.format('l_extendedprice')} AS value FROM lineitem GROUP BY 1, 2)"""
P3 = f"""p3 AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
  {_CENTS.format('value')} / count(value) AS value FROM events GROUP BY 1, 2)"""
S3 = f"""s3 AS (SELECT event_type AS series_id, date_trunc('second', ts) AS ts,
  {_CENTS.format('value')} / count(value) AS value FROM events GROUP BY 1, 2)"""
E1 = f"""e1 AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
  {_CENTS.format('o_totalprice')} / 1e6 AS sales, CAST(count(*) AS DOUBLE) AS orders,
  {_CENTS.format('o_totalprice')} / 1e6 / count(*) AS ticket FROM orders GROUP BY 1, 2)"""
W2 = P2.replace("p2 AS", "pw AS").replace("'day'", "'week'") + """, w0 AS (SELECT ts, max(value) FILTER (series_id = 'A') AS "A", max(value) FILTER (series_id = 'N') AS "N",
  max(value) FILTER (series_id = 'R') AS "R" FROM pw GROUP BY ts),
 w2 AS (SELECT *, 1.0::DOUBLE AS flat, "A" * 2 + 1 AS copy,
  CASE WHEN date_diff('day', DATE '1990-01-01', ts) % 5 = 0 THEN "N" END AS sparse,
  CASE WHEN date_diff('day', DATE '1990-01-01', ts) % 5 <> 0 THEN "R" END AS fifth FROM w0)"""
REGIME_SQL = "regimes AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}', DATE '{a}', DATE '{b}')" for i, (name, (a, b)) in enumerate(REGIMES.items(), 1)
) + ") AS r(pos, regime, starts, ends))"


EVENT_REGIME_SQL = "regimes AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}', TIMESTAMP '{a}', TIMESTAMP '{b}' + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND)"
    for i, (name, (a, b)) in enumerate(EVENT_REGIMES.items(), 1)) + ") AS r(pos, regime, starts, ends))"


def text_table(spark, sf) -> DataFrame:
    """The monthly panel as a text table with its code row."""
    return to_text_table(monthly(spark, sf), PRIORITIES, {p: 5 for p in PRIORITIES})
