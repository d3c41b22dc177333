"""Result tables by model type and class, and names of forecast files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.plans.defaults import MODEL_NAMES, MODEL_TYPES, TYPE_NAMES

SUFFIXES = {"forecasts": "_forecasts.csv", "explanations": "_shap_values.csv", "tuned": "_best_params.csv"}


def file_stem(path: Column) -> Column:
    """File name without folder, in lower case."""
    return F.lower(F.element_at(F.split(path, "/"), -1))


def model_type_of(name: Column) -> Column:
    """Model type in a file name; the longer name is tested first, as it holds the shorter one."""
    name = F.lower(name)
    found = F.when(name.contains("multivariate_domain"), "multivariate_domain")
    return found.when(name.contains("multivariate"), "multivariate").when(name.contains("univariate"), "univariate")


def model_class_of(name: Column) -> Column:
    """First known model class in a file name."""
    return F.coalesce(*[F.when(F.lower(name).contains(key), key) for key in MODEL_NAMES])


def display_name(name: Column) -> Column:
    """'<type> <model>', or the model alone when the type is unknown."""
    types = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    models = F.create_map(*[F.lit(x) for pair in MODEL_NAMES.items() for x in pair])
    kind, model = types[model_type_of(name)], F.coalesce(models[model_class_of(name)], F.lit(""))
    return F.when(kind.isNotNull() & (model != ""), F.concat_ws(" ", kind, model)).otherwise(model)


def output_prefix(name: Column, suffix: str = SUFFIXES["forecasts"]) -> Column:
    """File name without the given suffix, or else without its extension."""
    cut = F.substring(name, F.lit(1), F.length(name) - len(suffix))
    return F.when(name.endswith(suffix), cut).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def is_forecast_file(name: Column, model_type: str) -> Column:
    if model_type not in MODEL_TYPES:
        raise ValueError(f"model type must be one of {', '.join(MODEL_TYPES)}")
    return name.endswith(f"_{model_type}{SUFFIXES['forecasts']}")


FORECAST_SCHEMA = "origin_idx int, origin_date date, forecast_date date, forecast_logdiff double, actual_logdiff double"


def read_forecast_files(spark: SparkSession, folder: str, model_type: str) -> DataFrame:
    """All forecast CSV files (or folders of part files) of a type in a folder, with the model class from the name."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"model type must be one of {', '.join(MODEL_TYPES)}")
    rows = spark.read.option("header", True).schema(FORECAST_SCHEMA).csv(f"{folder}/*_{model_type}{SUFFIXES['forecasts']}")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)_forecasts\.csv", 1)
    return rows.select("*", F.lit(model_type).alias("model_type"), model_class_of(name).alias("model_class"))


def write_results(table: DataFrame, path: str) -> None:
    """Partitioned by type and class, so that a reader of one type opens only its files."""
    table.write.mode("overwrite").partitionBy("model_type", "model_class").parquet(path)


def read_results(spark: SparkSession, path: str, model_type: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("model_type") == model_type)


