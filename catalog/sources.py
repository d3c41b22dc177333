"""Reading, splitting and writing tables."""

from pyspark.sql import functions as F

from catalog.panels import E1, P1, PRIORITIES, entities, monthly, table, text_table
from catalog.registry import query
from lagmill.functions.columns import to_number
from lagmill.operators.panel import melt
from lagmill.plans.defaults import DATE_COLUMN
from lagmill.session import scratch_folder
from lagmill.sources.results import (
    display_name, is_forecast_file, model_class_of, model_type_of, output_prefix, read_forecast_files, read_results, write_results,
)
from lagmill.sources.wide_csv import (
    load_multivariate, load_univariate, read_text_table, split_code_row, typed_table, write_csv, write_panel,
)

PIVOT = ", ".join(f"max(value) FILTER (series_id = '{p}') AS \"{p}\"" for p in PRIORITIES)


def _folder(spark, name):
    """A new folder for each call."""
    return scratch_folder(spark, name)


@query("io1_io5_wide_csv_round_trip", "series_id, ts:t, value:2", f"WITH {P1} SELECT * FROM p1")
def wide_csv_round_trip(spark, sf):
    path = _folder(spark, "wide_csv")
    write_csv(text_table(spark, sf), path)
    data, _ = split_code_row(read_text_table(spark, path))
    return melt(typed_table(data), ["ts"], PRIORITIES).where(F.col("value").isNotNull())


@query("io2_io3_split_code_row", "series_id, tcode:i, pos:i",
       f"SELECT DISTINCT o_orderpriority AS series_id, 5 AS tcode, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS pos FROM orders")
def split_codes(spark, sf):
    return split_code_row(text_table(spark, sf))[1]


@query("io4_facts_and_codes_as_tables", "series_id, tcode:i, months:i, total:2",
       f"WITH {P1} SELECT series_id, 5 AS tcode, count(*) AS months, sum(value) AS total FROM p1 GROUP BY 1")
def facts_and_codes(spark, sf):
    path = _folder(spark, "panel")
    write_panel(monthly(spark, sf), split_code_row(text_table(spark, sf))[1], path)
    facts, codes = spark.read.parquet(f"{path}/facts"), spark.read.parquet(f"{path}/dim_series")
    totals = facts.groupBy("series_id").agg(F.count("value").alias("months"), F.sum("value").alias("total"))
    return totals.join(codes, "series_id")


@query("io6_load_univariate", "series_id, ts:t, value:2",
       f"WITH {P1} SELECT * FROM p1 WHERE series_id = '2-HIGH' AND ts BETWEEN DATE '1996-03-01' AND DATE '2000-09-01'")
def univariate(spark, sf):
    rows = load_univariate(text_table(spark, sf), "2-HIGH", start="1996-03-01", end="2000-09-01")
    return rows.where(F.col("value").isNotNull())


@query("io7_load_multivariate", "ts:t, " + ", ".join(f"{p}:2" for p in PRIORITIES), f"""WITH {P1},
 w AS (SELECT ts, {PIVOT} FROM p1 GROUP BY ts),
 g AS (SELECT ts, {', '.join(f'CASE WHEN month(ts) <> 6 THEN "{p}" END AS "{p}"' for p in PRIORITIES)} FROM w),
 n AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM g)
 SELECT * FROM (SELECT ts, {', '.join(f'CASE WHEN rn BETWEEN 21 AND n - 20 THEN coalesce("{p}", avg("{p}") OVER ()) ELSE "{p}" END AS "{p}"' for p in PRIORITIES)}
 FROM n) WHERE ts BETWEEN DATE '1996-01-01' AND DATE '2000-12-01'""")
def multivariate(spark, sf):
    text = text_table(spark, sf)
    june = F.col(DATE_COLUMN).startswith("6/")
    gappy = text.withColumns({p: F.when(~june, F.col(f"`{p}`")) for p in PRIORITIES})
    return load_multivariate(gappy, PRIORITIES[0], start="1996-01-01", end="2000-12-01")


@query("io8_results_of_one_type", "model_class, rows:i, total:6",
       """SELECT CASE l_returnflag WHEN 'A' THEN 'huber' WHEN 'N' THEN 'mlp' ELSE 'sgd' END AS model_class, count(*) AS rows,
  sum(l_discount) AS total FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def results_of_one_type(spark, sf):
    flag = F.col("l_returnflag")
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "univariate").otherwise("multivariate").alias("model_type"),
        F.when(flag == "A", "huber").when(flag == "N", "mlp").otherwise("sgd").alias("model_class"),
        F.col("l_discount").alias("forecast_logdiff"))
    path = _folder(spark, "results")
    write_results(rows, path)
    return read_results(spark, path, "univariate").groupBy("model_class").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("forecast_logdiff").alias("total"))


@query("io8_forecast_files_by_glob", "model_class, rows:i, origins:i, first:t, total:2, actuals:i", """
 SELECT CASE o_custkey % 2 WHEN 0 THEN 'huber' ELSE 'mlp' END AS model_class, count(*) AS rows, sum(o_orderkey % 1000) AS origins,
  CAST(min(o_orderdate) AS DATE) AS first, sum(o_totalprice) AS total, count(*) FILTER (o_orderkey % 3 <> 0) AS actuals
 FROM orders WHERE o_custkey % 4 < 2 GROUP BY 1""")
def forecast_files(spark, sf):
    """All rows as CSV files of two types, two classes each, read back by the name of one type."""
    key, day = F.col("o_custkey") % 4, F.col("o_orderdate").cast("date")
    rows = table(spark, sf, "orders").select(
        key.alias("key"), (F.col("o_orderkey") % 1000).alias("origin_idx"), day.alias("origin_date"), day.alias("forecast_date"),
        F.col("o_totalprice").alias("forecast_logdiff"), F.when(F.col("o_orderkey") % 3 != 0, 1.5).alias("actual_logdiff"))
    path = _folder(spark, "forecasts")
    for k, name in enumerate(("1_huber_univariate", "1_MLP_univariate", "1_sgd_multivariate", "1_huber_multivariate")):
        rows.where(F.col("key") == k).drop("key").write.option("header", True).csv(f"{path}/{name}_forecasts.csv")
    return read_forecast_files(spark, path, "univariate").groupBy("model_class").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("origin_idx").alias("origins"), F.min("origin_date").alias("first"),
        F.sum("forecast_logdiff").alias("total"), F.count("actual_logdiff").alias("actuals"))


_FILE = """concat('1_', CASE o_orderkey % 6 WHEN 0 THEN 'elasticnet' WHEN 1 THEN 'huber' WHEN 2 THEN 'lightgbm' WHEN 3 THEN 'MLP'
 WHEN 4 THEN 'sgd' ELSE 'other' END, CASE o_custkey % 4 WHEN 0 THEN '_univariate' WHEN 1 THEN '_multivariate'
 WHEN 2 THEN '_multivariate_domain' ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN '_shap_values.csv' ELSE '_forecasts.csv' END)"""


@query("io9_names_of_result_files", "file, model_type, model_class, display_name, prefix, in_domain, orders:i", f"""
 WITH f AS (SELECT {_FILE} AS file, count(*) AS orders FROM orders GROUP BY 1),
 p AS (SELECT *, CASE WHEN lower(file) LIKE '%multivariate_domain%' THEN 'multivariate_domain' WHEN lower(file) LIKE '%multivariate%' THEN 'multivariate'
   WHEN lower(file) LIKE '%univariate%' THEN 'univariate' END AS model_type,
  nullif(regexp_extract(lower(file), 'elasticnet|huber|sgd|lightgbm|mlp'), '') AS model_class FROM f)
 SELECT file, model_type, model_class, CASE WHEN model_class IS NULL THEN '' ELSE trim(concat(
  CASE model_type WHEN 'multivariate_domain' THEN 'DI-Multivariate ' WHEN 'multivariate' THEN 'Multivariate ' WHEN 'univariate' THEN 'Univariate ' ELSE '' END,
  CASE model_class WHEN 'elasticnet' THEN 'Elastic Net' WHEN 'huber' THEN 'Huber Regression' WHEN 'sgd' THEN 'SGD Regression'
   WHEN 'lightgbm' THEN 'LightGBM' ELSE 'MLP' END)) END AS display_name,
  replace(replace(file, '_forecasts.csv', ''), '.csv', '') AS prefix,
  file LIKE '%\\_multivariate\\_domain\\_forecasts.csv' ESCAPE '\\' AS in_domain, orders FROM p""")
def names_of_files(spark, sf):
    files = table(spark, sf, "orders").groupBy(F.expr(_FILE).alias("file")).agg(F.count(F.lit(1)).alias("orders"))
    name = F.col("file")
    return files.select(
        "file", model_type_of(name).alias("model_type"), model_class_of(name).alias("model_class"),
        display_name(name).alias("display_name"), output_prefix(name).alias("prefix"),
        is_forecast_file(name, "multivariate_domain").alias("in_domain"), "orders")


@query("f11_text_to_number", "event_type, numbers:i, bad:i, total:2", """
 WITH t AS (SELECT event_type, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS v FROM events),
 n AS (SELECT event_type, CASE WHEN NOT isnan(TRY_CAST(v AS DOUBLE)) THEN TRY_CAST(v AS DOUBLE) END AS x FROM t)
 SELECT event_type, count(x) AS numbers, count(*) - count(x) AS bad, sum(x) AS total FROM n GROUP BY 1""")
def text_to_number(spark, sf):
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, "").when(kind == 1, "n/a").when(kind == 2, "NaN").otherwise(F.col("value").cast("string"))
    x = to_number(text)
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(x).alias("numbers"), F.count_if(x.isNull()).alias("bad"), F.sum(x).alias("total"))


@query("r1_wide_to_long", "series_id, variable, ts:t, value:6",
       f"WITH {E1} SELECT series_id, variable, ts, value FROM (UNPIVOT e1 ON sales, orders, ticket INTO NAME variable VALUE value)")
def wide_to_long(spark, sf):
    frame = entities(spark, sf).withColumnRenamed("series_id", "entity")
    long = melt(frame, ["entity", "ts"], ["sales", "orders", "ticket"])
    return long.withColumnsRenamed({"series_id": "variable"}).withColumnRenamed("entity", "series_id")
