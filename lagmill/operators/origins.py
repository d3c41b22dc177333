"""Expanding-window forecast origins: which rows an origin sees, and the statistics fitted on them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagmill.operators.panel import is_bounded
from lagmill.operators.ranks import RankIndex

TAILS = (0.01, 0.99)
BACKGROUND_ROWS = 100


@dataclass(frozen=True)
class Expanding:
    """Origins start at row ``initial`` and move row by row; every ``interval`` origins form a tuning cycle."""

    initial: int = 100
    interval: int = 12
    horizon: int = 1
    max_train_rows: int | None = None
    tasks_per_series: int = 32
    #: Tasks of the fits of all series; by default as many as shuffles have, three per core at least. A run over very many
    #: series should name its number, some (series, block) groups a task.
    tasks: int | None = None

    def cycle_of(self, origin: Column) -> Column:
        return F.floor((origin - self.initial) / F.lit(self.interval)).cast("int")

    def cycles(self, n: int) -> int:
        """Number of tuning cycles of a series of n rows."""
        return max(0, -(-(n - self.horizon - self.initial + 1) // self.interval))

    def work(self, cycles):
        """Twice the rows that the origins of the first ``cycles`` cycles train on, in cycles of ``interval`` rows; a number
        or a column. A fit costs as many rows as it trains on, so that later cycles of an expanding window cost more."""
        return cycles * 2 if self.max_train_rows else cycles * (2 * self.initial + self.interval * (cycles - 1))

    def blocks(self, n: int) -> int:
        """Blocks of a series: at most ``tasks_per_series``, of two cycles of average work at least."""
        return max(1, min(self.tasks_per_series, -(-self.cycles(n) // 2)))

    def block_of(self, cycle: int, n: int) -> int:
        """Block of a cycle: the work of the cycles before it, as a share of all work, in equal parts."""
        return self.work(cycle) * self.blocks(n) // max(self.work(self.cycles(n)), 1)


def origin_table(features: DataFrame, plan: Expanding) -> DataFrame:
    """One row per (series, origin): date and position of the live row, forecast date, actual, training row count.

    ``features`` is the assembled form. Running windows give all of it; no row is paired with its origins. A live row
    with a NULL feature is replaced by the newest complete row before it, so an origin date can repeat."""
    w = W.partitionBy("series_id").orderBy("ts")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    known = w.rowsBetween(W.unboundedPreceding, -plan.horizon)
    usable = F.col("complete") & F.col("target").isNotNull()
    origin = F.col("idx") + 1
    table = features.select(
        "series_id", origin.cast("int").alias("origin_idx"), "n",
        F.last(F.when(F.col("complete"), F.col("ts")), ignorenulls=True).over(so_far).alias("origin_date"),
        F.last(F.when(F.col("complete"), F.col("idx")), ignorenulls=True).over(so_far).cast("int").alias("live_idx"),
        F.col("target_ts").alias("forecast_date"), F.col("target").alias("actual"),
        F.count(F.when(usable, 1)).over(known).cast("int").alias("train_rows"))
    cycle = plan.cycle_of(F.col("origin_idx"))
    start = (F.col("origin_idx") - plan.initial) % plan.interval == 0
    kept = table.where((F.col("origin_idx") >= plan.initial) & (F.col("origin_idx") <= F.col("n") - plan.horizon))
    return kept.drop("n").withColumns({"cycle": cycle, "tunes": start})


def carry_forward(choices: DataFrame, value: str = "choice", order: str = "cycle") -> DataFrame:
    """Replace a missing choice by the last one made before it."""
    w = W.partitionBy("series_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return choices.withColumn(value, F.last(value, ignorenulls=True).over(w))


def live_rows(features: DataFrame) -> DataFrame:
    """Newest complete feature row of each series."""
    complete = features.where(F.col("complete"))
    newest = F.max_by(F.struct("idx", F.col("ts").alias("origin_date"), "features"), "idx")
    return complete.groupBy("series_id").agg(newest.alias("_r")).select("series_id", "_r.*")


def background_rows(features: DataFrame, rows: int = BACKGROUND_ROWS) -> DataFrame:
    """The last ``rows`` training rows of each series."""
    usable = features.where(F.col("complete") & F.col("target").isNotNull())
    newest = W.partitionBy("series_id").orderBy(F.col("idx").desc())
    return usable.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= rows).drop("_rank")


def hv_folds(n: Column, n_splits: int = 1, h: int = 1, v: int = 24) -> Column:
    """Folds of gap-block cross-validation over rows 0..n-1 as array<struct<fold, train_end, val_start, val_end>>.

    Ends are exclusive. With at least two splits and enough rows: ``n_splits`` trailing blocks of ``v`` rows, each
    trained on the rows more than ``h`` before it. Otherwise one trailing block; no fold if nothing is left to train."""
    n = n.cast("bigint")

    def fold(i: int, start: Column, end: Column) -> Column:
        return F.struct(F.lit(i).alias("fold"), F.greatest(start - h, F.lit(0)).alias("train_end"),
                        start.alias("val_start"), end.alias("val_end"))

    start = F.greatest(n - v, F.lit(0))
    single = F.when(start - h > 0, F.array(fold(0, start, n))).otherwise(F.slice(F.array(fold(0, start, n)), 1, 0))
    if n_splits < 2:
        return single
    blocks = F.array(*[fold(i, n - (n_splits - i) * v, n - (n_splits - i - 1) * v) for i in range(n_splits)])
    return F.when(n >= n_splits * v + h + 1, blocks).otherwise(single)


def fold_slices(n: int, n_splits: int, h: int, v: int) -> list[tuple[slice, slice]]:
    """The folds of ``hv_folds`` for rows already in a task."""
    count = n_splits if n_splits >= 2 and n >= n_splits * v + h + 1 else 1
    starts = [max(0, n - (count - i) * v) for i in range(count)]
    return [(slice(0, s - h), slice(s, min(s + v, n))) for s in starts if s - h > 0]


def with_grid(df: DataFrame, points: Sequence[dict]) -> DataFrame:
    """Every row once per grid point, with ``grid_pos`` (the tie-break order) and the parameters as columns. The grid
    is a literal of the plan, so this is a generator and no join."""
    grid = F.array(*[
        F.struct(F.lit(i).alias("grid_pos"), *[F.lit(v).alias(k) for k, v in p.items()]) for i, p in enumerate(points)])
    return df.select("*", F.inline(grid))


def best_point(fold_scores: DataFrame, keys: Sequence[str] = ("series_id", "cycle")) -> DataFrame:
    """Grid point with the lowest mean fold error; the first one wins ties, NaN and NULL never win."""
    keys = list(keys)
    per_point = fold_scores.groupBy(*keys, "grid_pos").agg(
        F.avg("mae").alias("mae"), F.count_if(F.col("mae").isNull() | F.isnan("mae")).alias("_bad"))
    valid = per_point.where((F.col("_bad") == 0) & F.col("mae").isNotNull())
    best = F.min_by(F.struct("grid_pos", "mae"), F.struct("mae", "grid_pos")).alias("_b")
    return valid.groupBy(*keys).agg(best).select(*keys, "_b.grid_pos", "_b.mae")


def origin_blocks(features: DataFrame, plan: Expanding, grain: str) -> DataFrame:
    """Copy each feature row to the blocks of cycles that see it, keyed (series_id, block).

    A series is cut into at most ``tasks_per_series`` blocks of consecutive cycles of about equal work, so a row is copied at
    most that often instead of once per origin, and the largest series still fits over many tasks of equal length."""
    if not is_bounded(grain):
        raise ValueError("per-origin fits need a grain of an hour or coarser; aggregate the panel first")
    total = F.ceil((F.col("n") - plan.horizon - plan.initial + 1) / F.lit(plan.interval)).cast("long")
    blocks = F.least(F.lit(plan.tasks_per_series).cast("long"), F.ceil(total / F.lit(2)))
    first_cycle = F.greatest(F.floor((F.col("idx") - plan.initial + 1) / F.lit(plan.interval)), F.lit(0)).cast("long")

    def block_of(cycle: Column) -> Column:
        return F.floor((plan.work(cycle) * blocks) / F.greatest(plan.work(total), F.lit(1)))

    first, last = block_of(first_cycle), block_of(total - 1)
    # The actual of an origin is read from its newest row's target, so rows past the last origin are not needed.
    seen = features.where((total > 0) & (first_cycle < total))
    copied = seen.withColumn("block", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return spread_groups(copied, plan.tasks, "series_id", "block")


def spread_groups(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Hash-partition by the group keys into a given number of tasks. Groups of fits hold few bytes but much work, and
    adaptive execution, which sees bytes only, would merge them into a handful of tasks."""
    spark = df.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


class History:
    """Feature rows of one (series, block) group in position order, and what an origin may see of them."""

    def __init__(self, pdf: pd.DataFrame, plan: Expanding):
        pdf = pdf.sort_values("idx", kind="stable")
        self.plan = plan
        self.idx = pdf["idx"].to_numpy()
        self.ts = pdf["ts"].to_numpy()
        self.target_ts = pdf["target_ts"].to_numpy()
        self.y = pdf["target"].to_numpy(dtype=float)
        self.complete = pdf["complete"].to_numpy(dtype=bool)
        self.x = np.vstack(pdf["features"].to_numpy()).astype(float)
        self.n = int(pdf["n"].iloc[0])

    def origins(self, cycle: int) -> range:
        start = self.plan.initial + cycle * self.plan.interval
        return range(start, min(start + self.plan.interval, self.n - self.plan.horizon + 1))

    def cycles(self, block: int) -> range:
        total = self.plan.cycles(self.n)
        first = bisect_left(range(total), block, key=lambda c: self.plan.block_of(c, self.n))
        return range(first, bisect_left(range(total), block + 1, key=lambda c: self.plan.block_of(c, self.n)))

    @cached_property
    def usable(self) -> np.ndarray:
        """Rows that can be trained on."""
        return np.flatnonzero(self.complete & ~np.isnan(self.y))

    @cached_property
    def ranks(self) -> list[RankIndex]:
        """Order statistics of all features, and of the target at the end, over usable rows."""
        return [RankIndex(column) for column in (*self.x[self.usable].T, self.y[self.usable])]

    def spans(self, origins: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """First usable row, and the one after the last, that each origin trains on."""
        end = np.searchsorted(self.usable, np.searchsorted(self.idx, np.asarray(origins, np.int64) - self.plan.horizon))
        start = np.maximum(end - self.plan.max_train_rows, 0) if self.plan.max_train_rows else np.zeros_like(end)
        return start, end

    def rows(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        return self.x[self.usable[start:end]], self.y[self.usable[start:end]]

    def scalings(self, start: np.ndarray, end: np.ndarray, winsorize: bool = True) -> list[Scaling]:
        """``Scaling.fit`` of many spans of usable rows, none of them empty, by the rank indexes."""
        low, high, q25, median, q75 = (np.empty((len(start), self.x.shape[1])) for _ in range(5))
        for j, index in enumerate(self.ranks[:-1]):
            if winsorize:
                low[:, j], high[:, j] = (index.quantile(start, end, p) for p in TAILS)
            else:
                low[:, j], high[:, j] = -np.inf, np.inf
            q25[:, j], median[:, j], q75[:, j] = (index.quantile(start, end, p, low[:, j], high[:, j]) for p in (0.25, 0.5, 0.75))
        return [Scaling(*parts, _scale(q1, q3)) for *parts, q1, q3 in zip(low, high, median, q25, q75)]

    def target_limits(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.ranks[-1].quantile(start, end, p) for p in TAILS)

    def live(self, origin: int) -> int | None:
        rows = np.flatnonzero(self.complete[:np.searchsorted(self.idx, origin)])
        return int(rows[-1]) if len(rows) else None

    def newest(self, origin: int) -> int:
        return int(np.searchsorted(self.idx, origin - 1))


def _scale(q25: np.ndarray, q75: np.ndarray) -> np.ndarray:
    iqr = q75 - q25
    return np.where(iqr < 10 * np.finfo(float).eps, 1.0, iqr)


@dataclass
class Scaling:
    """Winsorizing limits and robust scale fitted on training rows; quantiles are exact and interpolated."""

    low: np.ndarray
    high: np.ndarray
    median: np.ndarray
    iqr: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, winsorize: bool = True) -> Scaling:
        if winsorize:
            low, high = np.quantile(x, TAILS, axis=0)
        else:
            low, high = np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf)
        q25, median, q75 = np.quantile(np.clip(x, low, high), (0.25, 0.5, 0.75), axis=0)
        return cls(low, high, median, _scale(q25, q75))

    def clip(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, self.low, self.high)

    def scale(self, clipped: np.ndarray) -> np.ndarray:
        return (clipped - self.median) / self.iqr


def clip_target(y: np.ndarray) -> np.ndarray:
    return np.clip(y, *np.quantile(y, TAILS))


LIMITS_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("origin_idx", T.IntegerType()),
    T.StructField("train_rows", T.IntegerType()), T.StructField("feature_pos", T.IntegerType()),
    T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("median", T.DoubleType()), T.StructField("iqr", T.DoubleType()),
    T.StructField("live_clipped", T.DoubleType()), T.StructField("live_scaled", T.DoubleType()),
    T.StructField("target_low", T.DoubleType()), T.StructField("target_high", T.DoubleType())])


def origin_limits(features: DataFrame, plan: Expanding, grain: str) -> DataFrame:
    """Per (series, origin, feature): 1st and 99th percentile, median and IQR of the training rows, and the live value
    clipped and scaled by them."""

    def limits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        history = History(pdf, plan)
        origins = [o for cycle in history.cycles(int(key[1])) for o in history.origins(cycle) if history.live(o) is not None]
        start, end = history.spans(origins)
        origins, start, end = np.array(origins, np.int64)[end > start], start[end > start], end[end > start]
        if not len(origins):
            return pd.DataFrame(columns=LIMITS_SCHEMA.names)
        scalings, k = history.scalings(start, end), history.x.shape[1]
        live = history.x[[history.live(o) for o in origins]]
        clipped = np.stack([s.clip(x) for s, x in zip(scalings, live)])
        scaled = np.stack([s.scale(x) for s, x in zip(scalings, clipped)])
        y_low, y_high = history.target_limits(start, end)
        flat = {name: np.concatenate([getattr(s, name) for s in scalings]) for name in ("low", "high", "median", "iqr")}
        return pd.DataFrame({
            "series_id": key[0], "origin_idx": np.repeat(origins, k), "train_rows": np.repeat(end - start, k),
            "feature_pos": np.tile(np.arange(k), len(origins)), **flat, "live_clipped": clipped.ravel(), "live_scaled": scaled.ravel(),
            "target_low": np.repeat(y_low, k), "target_high": np.repeat(y_high, k)})

    return origin_blocks(features, plan, grain).groupBy("series_id", "block").applyInPandas(limits, LIMITS_SCHEMA)
