"""Augmented Dickey-Fuller test (constant, lag order by AIC) of every series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lagmill.operators.panel import CHUNK_ROWS, is_bounded, with_positions

RESULT = T.StructType([
    T.StructField("adf_stat", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("lags", T.IntegerType()), T.StructField("n_obs", T.LongType())])
PARTIAL = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("head", T.ArrayType(T.DoubleType())),
    T.StructField("gram", T.ArrayType(T.DoubleType()))])

# Response surface of the test statistic's distribution (constant, one variable).
P_LEFT = (2.1659, 1.4412, 0.038269)
P_RIGHT = (1.7339, 0.93202, -0.12745, -0.010368)
P_SPLIT, P_MIN, P_MAX = -1.61, -18.83, 2.74


def p_value(stat: float) -> float:
    if stat > P_MAX:
        return 1.0
    if stat < P_MIN:
        return 0.0
    z = sum(c * stat ** i for i, c in enumerate(P_LEFT if stat <= P_SPLIT else P_RIGHT))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _regressors(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows [1, x(t-1), dx(t-1) .. dx(t-lags), dx(t)] for every t with all of them."""
    dx = np.diff(x)
    rows = len(dx) - lags
    if rows <= 0:
        return np.zeros((0, lags + 3))
    past = [dx[lags - k: lags - k + rows] for k in range(1, lags + 1)]
    return np.column_stack([np.ones(rows), x[lags: lags + rows], *past, dx[lags:]])


def _solve(gram: np.ndarray, lags: int, rows: float) -> tuple[float, float, float]:
    """Residual sum of squares, coefficient of x(t-1) and its variance factor for the first ``lags`` lags."""
    use = np.arange(2 + lags)
    inverse = np.linalg.inv(gram[np.ix_(use, use)])
    beta = inverse @ gram[use, -1]
    return float(gram[-1, -1] - beta @ gram[use, -1]), float(beta[1]), float(inverse[1, 1])


def _decide(gram: np.ndarray, head: np.ndarray, n: int, maxlag: int) -> tuple:
    common = n - 1 - maxlag
    scores = []
    for lags in range(maxlag + 1):
        ssr, _, _ = _solve(gram, lags, common)
        scores.append(common * math.log(ssr / common) + 2 * (2 + lags))
    best = int(np.argmin(scores))
    # The chosen order is fitted again on its own longer sample: the common rows plus the first ones of the series.
    use = [*range(2 + best), maxlag + 2]
    extra = _regressors(head, best)
    own = gram[np.ix_(use, use)] + extra.T @ extra
    rows = common + len(extra)
    ssr, slope, factor = _solve(own, best, rows)
    stat = slope / math.sqrt(ssr / (rows - 2 - best) * factor)
    return stat, p_value(stat), best, rows


@pandas_udf(RESULT)
def _test(gram: pd.Series, head: pd.Series, n: pd.Series, maxlag: pd.Series) -> pd.DataFrame:
    out = []
    for g, h, rows, lags in zip(gram, head, n, maxlag):
        try:
            k = int(lags) + 3
            full = np.zeros((k, k))
            full[np.triu_indices(k)] = g
            full = full + np.triu(full, 1).T
            result = _decide(full, np.asarray(h, dtype=float), int(rows), int(lags))
            out.append(result if np.isfinite(result[0]) else (None,) * 4)
        except (np.linalg.LinAlgError, ValueError, TypeError, ZeroDivisionError):
            out.append((None,) * 4)
    frame = pd.DataFrame(out, columns=RESULT.names)
    return frame.astype({"adf_stat": "float64", "p_value": "float64", "lags": "Int32", "n_obs": "Int64"})


def adf(panel: DataFrame, grain: str, alpha: float = 0.05, maxlag: int | None = None, value: str = "value",
        chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(series_id, adf_stat, p_value, lags, n_obs, stationary) per series; all NULL where the test is undefined.

    Long series are cut into chunks of positions with the lagged rows they need. A chunk adds up its moment matrix in
    numpy, matrices are summed per series, and one small solve per series tries every lag order: each shorter order is
    a leading block of the same matrix."""
    rows = with_positions(panel.where(F.col(value).isNotNull()), grain)
    stats = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    rule = F.ceil(F.lit(12.0) * F.pow(F.col("n") / 100.0, F.lit(0.25))) if maxlag is None else F.lit(maxlag)
    stats = stats.withColumn("_maxlag", F.least(F.floor(F.col("n") / 2) - 2, rule).cast("int"))
    testable = (F.col("_maxlag") >= 0) & (F.col("_std") > 0)
    placed = rows.select("series_id", "idx", value).join(stats.where(testable), "series_id")
    scaled = placed.select(
        "series_id", "idx", "_maxlag", ((F.col(value) - F.col("_mean")) / F.col("_std")).alias("x"))
    first = F.floor(F.col("idx") / F.lit(chunk_rows))
    last = F.floor((F.col("idx") + F.col("_maxlag") + 1) / F.lit(chunk_rows))
    spread = scaled.withColumn("chunk", F.explode(F.sequence(first, last)))

    def gram(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, lags = pdf["x"].to_numpy(), int(pdf["_maxlag"].iloc[0])
        if int(pdf["idx"].iloc[-1]) < int(key[1]) * chunk_rows:
            return pd.DataFrame(columns=PARTIAL.names)
        rows = _regressors(x, lags)
        head = x[:lags + 1] if key[1] == 0 else None
        return pd.DataFrame({"series_id": [key[0]], "head": [head],
                             "gram": [(rows.T @ rows)[np.triu_indices(lags + 3)]]})

    parts = spread.groupBy("series_id", "chunk").applyInPandas(gram, PARTIAL)
    cells = parts.select("series_id", "head", F.posexplode("gram").alias("pos", "cell"))
    summed = cells.groupBy("series_id", "pos").agg(
        F.sum("cell").alias("cell"), F.max(F.when(F.col("pos") == 0, F.col("head"))).alias("head"))
    matrices = summed.groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda c: c["cell"]).alias("gram"),
        F.max("head").alias("head"))
    tested = stats.join(matrices, "series_id", "left").select(
        "series_id", F.when(F.col("gram").isNotNull(), _test("gram", "head", "n", "_maxlag")).alias("_t"))
    return tested.select(
        "series_id", "_t.adf_stat", "_t.p_value", "_t.lags", "_t.n_obs",
        F.coalesce(F.col("_t.p_value") < alpha, F.lit(False)).alias("stationary"))


def non_stationary(tested: DataFrame) -> DataFrame:
    return tested.where(~F.col("stationary")).select("series_id")
