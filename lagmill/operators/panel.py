"""The panel: one row per (series_id, ts), and ordered operations over it that never need one task per series.

A panel is built by aggregating facts to a time grain, so a series holds at most one row per grain step. Up to the
hour grain a century is under 0.9 million rows, and a window over a whole series is a bounded task however many raw
facts the series has. Finer grains have no such bound: there, positions come from per-period counts and windows run
over chunks of ``CHUNK_ROWS`` positions, each with a copy of the few neighbouring rows its frame reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagmill.functions.columns import finite_or_null, from_start, quoted, require_columns, to_end

SERIES = ("series_id",)
WHOLE_SERIES_GRAINS = ("year", "quarter", "month", "week", "day", "hour")
CLOCK = ("hour", "minute", "second")
PERIOD_OF_GRAIN = {"minute": "month", "second": "day"}  # at most 44,640 and 86,400 rows per series and period
CHUNK_ROWS = 1 << 16


def is_bounded(grain: str) -> bool:
    """Whether a series of this grain is short enough for one window task."""
    if grain in WHOLE_SERIES_GRAINS:
        return True
    if grain in PERIOD_OF_GRAIN:
        return False
    raise ValueError(f"unknown grain {grain!r}")


def truncate(ts: Column, grain: str) -> Column:
    """Start of the grain step: a date up to the day grain, else a zone-less timestamp. No session time zone is used."""
    day = ts.cast("date")
    if grain == "day":
        return day
    if grain in ("year", "quarter", "month", "week"):
        return F.trunc(day, grain)
    if grain not in CLOCK:
        raise ValueError(f"unknown grain {grain!r}")
    kept = CLOCK.index(grain) + 1
    clock = [F.hour(ts), F.minute(ts), F.floor(F.second(ts))][:kept] + [F.lit(0)] * (3 - kept)
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), *clock)


def panel_from_facts(facts: DataFrame, series: Column | str, ts: Column | str, value: Column, grain: str) -> DataFrame:
    """Aggregate facts to (series_id, ts, value). Partial aggregation runs before the shuffle, so a series with a
    large share of all facts reaches the shuffle as one row per task and grain step."""
    series = F.col(series) if isinstance(series, str) else series
    ts = F.col(ts) if isinstance(ts, str) else ts
    return facts.groupBy(series.alias("series_id"), truncate(ts, grain).alias("ts")).agg(value.alias("value"))


def exact_sum(amount: Column, scale: int = 100) -> Column:
    """Sum of amounts with a fixed number of decimals, free of rounding order: the sum runs on integers."""
    return F.sum(F.rint(amount * F.lit(float(scale))).cast("bigint")).cast("double") / F.lit(float(scale))


def melt(wide: DataFrame, ids: Sequence[str], variables: Sequence[str] | None = None) -> DataFrame:
    """Wide table to long (ids..., series_id, value); NaN becomes NULL."""
    variables = [c for c in wide.columns if c not in ids] if variables is None else list(variables)
    require_columns(wide, [*ids, *variables])
    typed = wide.select(*[quoted(c) for c in ids], *[quoted(c).cast("double").alias(c) for c in variables])
    long = typed.unpivot([quoted(c) for c in ids], [quoted(c) for c in variables], "series_id", "value")
    return long.withColumn("value", finite_or_null(F.col("value")))


def widen(panel: DataFrame, variables: Sequence[str], ids: Sequence[str] = ("ts",), name: str = "series_id",
          value: str = "value") -> DataFrame:
    """Long table to one column per listed variable; the list is given, so no pass over the data finds it."""
    return panel.groupBy(*ids).pivot(name, list(variables)).agg(F.first(value, ignorenulls=True))


def date_slice(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows in [start, end], both inclusive, the whole last day too; a plain predicate, so it reaches the file scan."""
    if start is not None:
        df = df.where(from_start(F.col(ts), start))
    if end is not None:
        df = df.where(to_end(F.col(ts), end))
    return df


def with_positions(df: DataFrame, grain: str, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Add ``idx`` (0-based row position in the series) and ``n`` (rows of the series).

    Unbounded grains: rows are numbered inside a period, period counts are summed up on the small period table, and
    both meet on (keys, period), which is the partitioning the numbering left behind."""
    keys = list(keys)
    if is_bounded(grain):
        w = W.partitionBy(*keys)
        return df.withColumns({
            "idx": (F.row_number().over(w.orderBy(ts)) - 1).cast("bigint"),
            "n": F.count(F.lit(1)).over(w),
        })
    df = df.withColumn("_period", truncate(F.col(ts), PERIOD_OF_GRAIN[grain]))
    w = W.partitionBy(*keys)
    before = F.sum("_rows").over(w.orderBy("_period").rowsBetween(W.unboundedPreceding, -1))
    starts = (
        df.groupBy(*keys, "_period").agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_period", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_rows").over(w).alias("n"))
    )
    in_period = F.row_number().over(W.partitionBy(*keys, "_period").orderBy(ts)) - 1
    numbered = df.withColumn("_row", in_period).join(starts, [*keys, "_period"])
    return numbered.withColumn("idx", F.col("_start") + F.col("_row")).drop("_period", "_row", "_start")


def positioned(df: DataFrame, grain: str, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Positions where windows need them: on unbounded grains, unless they are there already."""
    return df if is_bounded(grain) or "idx" in df.columns else with_positions(df, grain, keys, ts)


def over_series(df: DataFrame, build: Callable[[W], dict[str, Column]], grain: str, back: int, ahead: int = 0,
                keys: Sequence[str] = SERIES, ts: str = "ts", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the columns ``build(window)`` returns; their frames reach at most ``back`` rows back and ``ahead`` on.

    Unbounded grains need ``idx``: each row goes to its own chunk of positions and to the chunks whose frames reach
    it, so a series of any length is spread over tasks and the result is that of one window over the series."""
    keys = list(keys)
    if is_bounded(grain):
        return df.withColumns(build(W.partitionBy(*keys).orderBy(ts)))
    require_columns(df, ["idx"], "panel of an unbounded grain")
    own = F.floor(F.col("idx") / F.lit(chunk_rows))
    first = F.floor(F.greatest(F.col("idx") - ahead, F.lit(0)) / F.lit(chunk_rows))
    last = F.floor((F.col("idx") + back) / F.lit(chunk_rows))
    spread = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    w = W.partitionBy(*keys, "_chunk").orderBy("idx")
    return spread.withColumns(build(w)).where(own == F.col("_chunk")).drop("_chunk")


def running_mean_before(df: DataFrame, value: str, name: str, grain: str, keys: Sequence[str] = SERIES,
                        ts: str = "ts", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean of all earlier non-NULL values of the series. Unbounded grains use chunk totals plus the running part
    inside a chunk."""
    keys = list(keys)
    if is_bounded(grain):
        w = W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.avg(value).over(w))
    df = df.withColumn("_chunk", F.floor(F.col("idx") / F.lit(chunk_rows)))
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        df.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
                F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"))
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    parts = df.withColumns({
        "_s1": F.coalesce(F.sum(value).over(inside), F.lit(0.0)),
        "_c1": F.count(value).over(inside),
    }).join(totals, [*keys, "_chunk"])
    count = (F.col("_c0") + F.col("_c1")).cast("double")
    mean = (F.col("_s0") + F.col("_s1")) / F.nullif(count, F.lit(0.0))
    return parts.withColumn(name, mean).drop("_chunk", "_s0", "_c0", "_s1", "_c1")


def trim_leading_gap(wide: DataFrame, variables: Sequence[str], ts: str = "ts") -> DataFrame:
    """Keep rows from the first one with no NULL in ``variables``; keep all rows if there is none."""
    complete = F.lit(True)
    for v in variables:
        complete = complete & quoted(v).isNotNull()
    first = wide.agg(F.min(F.when(complete, F.col(ts))).alias("_first"))
    return wide.join(F.broadcast(first), F.col("_first").isNull() | (F.col(ts) >= F.col("_first"))).drop("_first")


def impute_middle(df: DataFrame, variables: Sequence[str], grain: str, edge: int = 20, how: str = "full",
                  keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Fill NULLs by the mean of the variable, but not in the first and last ``edge`` rows of a series.

    ``how='full'`` takes the mean of the whole series (it looks ahead); ``how='expanding'`` takes earlier rows only.
    A series of at most 2 * edge rows is an error."""
    keys = list(keys)
    df = df if {"idx", "n"} <= set(df.columns) else with_positions(df, grain, keys, ts)
    short = F.raise_error(F.lit(f"series needs more than {2 * edge} rows to fill its middle"))
    df = df.withColumn("n", F.when(F.col("n") > 2 * edge, F.col("n")).otherwise(short.cast("bigint")))
    inner = (F.col("idx") >= edge) & (F.col("idx") < F.col("n") - edge)
    if how == "full":
        means = df.groupBy(*keys).agg(*[F.avg(quoted(v)).alias(f"_mean_{i}") for i, v in enumerate(variables)])
        df = df.join(means, keys)
    elif how == "expanding":
        for i, v in enumerate(variables):
            df = running_mean_before(df, v, f"_mean_{i}", grain, keys, ts)
    else:
        raise ValueError("how must be 'full' or 'expanding'")
    filled = {
        v: F.when(inner, F.coalesce(quoted(v), F.col(f"_mean_{i}"))).otherwise(quoted(v))
        for i, v in enumerate(variables)
    }
    return df.withColumns(filled).drop(*[f"_mean_{i}" for i in range(len(variables))])


def densify(panel: DataFrame, grain: str, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Add the missing grain steps between a series' first and last row, with NULL values."""
    keys = list(keys)
    if not is_bounded(grain):
        raise ValueError("densify needs a grain of an hour or coarser")
    step = F.expr(f"interval 1 {grain}")
    ends = panel.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    steps = ends.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias(ts))
    return steps.join(panel, [*keys, ts], "left")
