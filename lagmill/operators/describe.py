"""Descriptive statistics, regime statistics and distribution data of a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions.columns import normal_density, ratio, unbiased_kurtosis, unbiased_skewness, within
from lagmill.operators.panel import SERIES, is_bounded
from lagmill.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
#: Grid points of a density that are summed side by side.
BATCH = 20
STATISTICS = ("count", "mean", "std", "varcof", "min", "q25", "median", "q75", "max", "variance", "skewness", "kurtosis")


def _moments(x: Column) -> list[Column]:
    return [
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        ratio(F.stddev_samp(x), F.avg(x)).alias("varcof"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.var_samp(x).alias("variance"), unbiased_skewness(x).alias("skewness"),
        unbiased_kurtosis(x).alias("kurtosis"),
    ]


def describe(df: DataFrame, grain: str | None = None, keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Twelve statistics per series; quartiles are exact and interpolated.

    ``grain`` says that a series is bounded, and one aggregation does it all. Without it the rows are raw facts of
    unknown number: moments still aggregate in one pass, quartiles come from distributed rank selection."""
    keys, x = list(keys), F.col(value)
    if grain is not None and is_bounded(grain):
        rows = df.groupBy(*keys).agg(
            *_moments(x), F.percentile(x, F.array(*[F.lit(q) for q in QUARTILES.values()])).alias("_q"))
        return rows.select(*keys, *[_pick(s) for s in STATISTICS])
    moments = df.groupBy(*keys).agg(*_moments(x))
    joined = moments.join(exact_quantiles(df, keys, value, QUARTILES), keys, "left")
    return joined.select(*keys, *STATISTICS)


def _pick(statistic: str) -> Column:
    names = list(QUARTILES)
    return F.col("_q")[names.index(statistic)].alias(statistic) if statistic in names else F.col(statistic)


def regime_stats(panel: DataFrame, regimes: Mapping[str, tuple[str, str]], keys: Sequence[str] = SERIES,
                 value: str = "value", ts: str = "ts") -> DataFrame:
    """Count, mean and sample deviation per series and regime, empty regimes included: one conditional aggregation,
    neither a join nor a copy of rows."""
    aggs, rows = [], []
    for i, (name, (start, end)) in enumerate(regimes.items()):
        x = F.when(within(F.col(ts), start, end), F.col(value))
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        rows.append(F.struct(
            F.lit(i).alias("pos"), F.lit(name).alias("regime"), F.lit(start).alias("start"), F.lit(end).alias("end"),
            F.col(f"c{i}").alias("count"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")))
    return df_inline(panel.groupBy(*keys).agg(*aggs), keys, rows)


def df_inline(df: DataFrame, keys: Sequence[str], rows: Sequence[Column]) -> DataFrame:
    """One output row per struct in ``rows``."""
    return df.select(*keys, F.inline(F.array(*rows)))


def histogram(panel: DataFrame, grain: str | None = None, bins: int = 30, keys: Sequence[str] = SERIES,
              value: str = "value") -> DataFrame:
    """Counts over ``bins`` equal bins of [min, max], the last closed on the right; empty bins are listed.

    A constant series gets bins over [x - 0.5, x + 0.5]."""
    keys = list(keys)
    spans = _spans(panel, keys, value)
    low, high = F.col("_low"), F.col("_high")
    rows = panel.where(F.col(value).isNotNull()).select(*keys, value)
    placed = rows.join(spans, keys).select(
        *keys, F.least(F.width_bucket(F.col(value), low, high, F.lit(bins)), F.lit(bins)).cast("int").alias("bin"))
    counts = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    every = spans.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (high - low) / F.lit(float(bins))
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (low + (F.col("bin") - 1) * width).alias("left_edge"), (low + F.col("bin") * width).alias("right_edge"),
        F.coalesce("count", F.lit(0)).alias("count"))


def _spans(panel: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = F.col(value)
    stats = panel.where(x.isNotNull()).groupBy(*keys).agg(
        F.min(x).alias("_min"), F.max(x).alias("_max"), F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"),
        F.count(x).alias("_n"))
    flat = F.col("_min") == F.col("_max")
    return stats.withColumns({
        "_low": F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")),
        "_high": F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")),
    })


def normal_curve(panel: DataFrame, bins: int = 30, points: int = 1000, keys: Sequence[str] = SERIES,
                 value: str = "value") -> DataFrame:
    """Normal density with the series' mean and deviation on a grid over [min, max], scaled to histogram counts."""
    keys = list(keys)
    x = F.col("_min") + F.col("point") * ((F.col("_max") - F.col("_min")) / F.lit(float(points - 1)))
    bin_width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    grid = _spans(panel, keys, value).where(F.col("_std") > 0).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    return grid.select(
        *keys, "point", "x",
        (normal_density(F.col("x"), F.col("_mean"), F.col("_std")) * F.col("_n") * bin_width).alias("density"))


def kernel_density(panel: DataFrame, grain: str | None = None, bins: int = 30, points: int = 200,
                   keys: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Gaussian kernel density (bandwidth std * n^(-1/5)) on a grid over [min, max], scaled to histogram counts.

    Equal values are counted first; then one aggregation per (series, batch of points) sums the kernels of a batch side by side."""
    keys = list(keys)
    spans = _spans(panel, keys, value).where(F.col("_std") > 0)
    bandwidth = F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    step = (F.col("_max") - F.col("_min")) / F.lit(float(points - 1))
    bin_width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    counted = panel.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    placed = counted.join(spans, keys).select(
        *keys, "_times", F.col("_min"), step.alias("_step"), ((F.col(value) - F.col("_min")) / bandwidth).alias("_at"),
        (step / bandwidth).alias("_gap"), (bin_width / (bandwidth * F.sqrt(F.lit(2.0) * F.pi()))).alias("_scale"))
    # Few enough sums side by side for compiled code: a row meets one batch of points at a time.
    batches = placed.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(points - 1), F.lit(BATCH))))
    place = [F.col("_first") + F.lit(i) for i in range(BATCH)]
    z = [F.col("_at") - F.col("_gap") * p for p in place]
    sums = batches.groupBy(*keys, "_first").agg(F.first("_min").alias("_min"), F.first("_step").alias("_step"), F.first("_scale").alias("_scale"), *[
        F.sum(F.col("_times") * F.exp(z[i] * z[i] * F.lit(-0.5))).alias(f"_k{i}") for i in range(BATCH)])
    rows = [F.struct(place[i].alias("point"), (F.col("_min") + F.col("_step") * place[i]).alias("x"),
                     (F.col(f"_k{i}") * F.col("_scale")).alias("density")) for i in range(BATCH)]
    return df_inline(sums, keys, rows).where(F.col("point") < points)
