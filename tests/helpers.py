"""Small inputs the tests build."""

from pyspark.sql import functions as F


def panel(spark, values, series="s", start="2000-01-01", grain="month"):
    """One series of consecutive grain steps."""
    rows = spark.createDataFrame([(series, i, v) for i, v in enumerate(values)], "series_id string, i int, value double")
    if grain == "month":
        ts = F.add_months(F.lit(start).cast("date"), F.col("i"))
    else:
        ts = F.timestamp_seconds(F.col("i") + F.unix_timestamp(F.lit(start), "yyyy-MM-dd")).cast("timestamp_ntz")
    return rows.select("series_id", ts.alias("ts"), "value")
