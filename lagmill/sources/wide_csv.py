"""Wide text tables with one date column, one column per variable and a transform-code row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.functions.columns import quoted, require_columns, to_number
from lagmill.operators.panel import SERIES, date_slice, impute_middle
from lagmill.plans.defaults import DATE_COLUMN, SAMPLE_END, SAMPLE_START, TARGET

CODE_ROW = "Transform"
DATE_FORMAT = "M/d/yyyy"


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: no inference pass over the files."""
    return spark.read.option("header", True).csv(path)


def split_code_row(text: DataFrame, date: str = DATE_COLUMN) -> tuple[DataFrame, DataFrame]:
    """(data, dim_series). The code row is known by its text, since a distributed read has no first row.

    dim_series: (series_id, tcode, pos), pos being the column order of the table."""
    require_columns(text, [date])
    variables = [c for c in text.columns if c != date]
    is_code = F.trim(quoted(date)).startswith(CODE_ROW)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("series_id"), to_number(quoted(c)).cast("int").alias("tcode"), F.lit(i).alias("pos"))
        for i, c in enumerate(variables)])
    return text.where(~is_code | quoted(date).isNull()), text.where(is_code).select(F.inline(pairs))


def typed_table(data: DataFrame, date: str = DATE_COLUMN, date_format: str = DATE_FORMAT) -> DataFrame:
    """Date parsed into ``ts``, every variable a number or NULL; rows without a date are left out."""
    variables = [c for c in data.columns if c != date]
    ts = F.to_date(quoted(date), date_format)
    return data.where(quoted(date).isNotNull()).select(
        ts.alias("ts"), *[to_number(quoted(c)).alias(c) for c in variables])


def load_univariate(text: DataFrame, target: str = TARGET, date: str = DATE_COLUMN, start: str | None = SAMPLE_START,
                    end: str | None = SAMPLE_END) -> DataFrame:
    """Panel (series_id, ts, value) of the target inside [start, end]."""
    require_columns(text, [date, target])
    data, _ = split_code_row(text.select(quoted(date), quoted(target)), date)
    rows = date_slice(typed_table(data, date), start, end)
    return rows.select(F.lit(target).alias("series_id"), "ts", quoted(target).alias("value"))


def load_multivariate(text: DataFrame, target: str = TARGET, date: str = DATE_COLUMN, start: str | None = SAMPLE_START,
                      end: str | None = SAMPLE_END, entity: str = "all", impute: str = "full",
                      grain: str = "month") -> DataFrame:
    """Wide frame (series_id, ts, variables), the middle rows filled by means, then cut to [start, end].

    Means and the edge rows refer to the whole table, before the cut."""
    require_columns(text, [date, target])
    data, _ = split_code_row(text, date)
    wide = typed_table(data, date).withColumn("series_id", F.lit(entity))
    variables = [c for c in text.columns if c != date]
    filled = impute_middle(wide, variables, grain, how=impute).drop("idx", "n")
    return date_slice(filled, start, end).select("series_id", "ts", *[quoted(c) for c in variables])


def write_panel(panel: DataFrame, dim_series: DataFrame | None, path: str, fmt: str = "parquet") -> None:
    """Facts and series codes as two tables; codes never sit inside the facts."""
    options = {"header": True} if fmt == "csv" else {}
    panel.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/facts")
    if dim_series is not None:
        dim_series.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/dim_series")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_text_table(panel: DataFrame, variables: Sequence[str], codes: dict[str, int], date: str = DATE_COLUMN) -> DataFrame:
    """Panel as a text table with its code row, the input form of this module."""
    wide = panel.groupBy("ts").pivot(SERIES[0], list(variables)).agg(F.first("value", ignorenulls=True))
    data = wide.select(F.date_format("ts", DATE_FORMAT).alias(date), *[quoted(c).cast("string").alias(c) for c in variables])
    head = F.struct(F.lit(f"{CODE_ROW}:").alias(date), *[F.lit(str(float(codes[c]))).alias(c) for c in variables])
    code_row = panel.sparkSession.range(1).select(F.inline(F.array(head)))
    return data.unionByName(code_row)
