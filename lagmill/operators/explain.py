"""Additive explanations of forecasts as DataFrame jobs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def linear_contributions(live: DataFrame, background: DataFrame, weights: DataFrame,
                         keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, feature_pos, feature_value, shap_value, base_value): weight times distance from the background mean.

    ``live`` and ``background`` hold a ``features`` array, ``weights`` (keys, intercept, weights array)."""
    keys = list(keys)
    means = (
        background.select(*keys, F.posexplode("features").alias("feature_pos", "_x"))
        .groupBy(*keys, "feature_pos").agg(F.avg("_x").alias("_mean")))
    terms = live.select(*keys, F.posexplode("features").alias("feature_pos", "feature_value")).join(
        means, [*keys, "feature_pos"]).join(weights, keys)
    w = F.col("weights")[F.col("feature_pos")]
    parts = terms.select(
        *keys, "feature_pos", "feature_value", "intercept", (w * (F.col("feature_value") - F.col("_mean"))).alias(
            "shap_value"), (w * F.col("_mean")).alias("_at_mean"))
    base = parts.groupBy(*keys).agg((F.sum("_at_mean") + F.first("intercept")).alias("base_value"))
    return parts.join(base, keys).select(*keys, "feature_pos", "feature_value", "shap_value", "base_value")


@dataclass(frozen=True)
class Leaves:
    """Leaves of a sum of trees: a leaf adds ``value`` where every feature lies in its (``low``, ``high``]."""

    value: np.ndarray
    low: np.ndarray
    high: np.ndarray


_LINE = re.compile(r"^( *)(?:(If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict: (\S+)|Tree \d+ \(weight (\S+)\):)")


def ensemble_leaves(description: str, k: int) -> Leaves:
    """Leaves of an ensemble from its description, in which conditions are nested by indentation."""
    values, lows, highs, weight = [], [], [], 1.0
    path: list[tuple[int, int, str, float]] = []
    for line in description.splitlines():
        found = _LINE.match(line)
        if not found:
            continue
        indent, _, feature, sign, bound, value, tree = found.groups()
        path = [c for c in path if c[0] < len(indent)]
        if tree is not None:
            weight, path = float(tree), []
        elif value is None:
            path.append((len(indent), int(feature), sign, float(bound)))
        else:
            low, high = np.full(k, -np.inf), np.full(k, np.inf)
            for _, f, s, b in path:
                if s == "<=":
                    high[f] = min(high[f], b)
                else:
                    low[f] = max(low[f], b)
            values.append(weight * float(value))
            lows.append(low)
            highs.append(high)
    return Leaves(np.array(values), np.array(lows).reshape(-1, k), np.array(highs).reshape(-1, k))


def exact_tree_values(x: np.ndarray, background: np.ndarray, leaves: Leaves, chunk: int = 128) -> tuple[np.ndarray, float]:
    """(Shapley value of each feature, mean prediction of the background), exactly.

    A mix of a row and a background row reaches a leaf if it takes from the row the ``a`` conditions that only the row
    meets, and from the background the ``c`` conditions that only that meets. Over all orders of features, one of the former
    completes this with the weight (a - 1)! c! / (a + c)!, and one of the latter spoils it with a! (c - 1)! / (a + c)!."""
    k = len(x)
    count = np.arange(k + 1)
    log = np.array([lgamma(n + 1) for n in range(k + 1)])
    both = np.array([[lgamma(a + c + 1) for c in count] for a in count])
    gain = np.exp(np.append(0.0, log[:-1])[:, None] + log[None] - both) * (count[:, None] > 0)
    loss = np.exp(log[:, None] + np.append(0.0, log[:-1])[None] - both) * (count[None] > 0)
    values, base = np.zeros(k), 0.0
    for at in range(0, len(leaves.value), chunk):
        low, high, value = leaves.low[at:at + chunk], leaves.high[at:at + chunk], leaves.value[at:at + chunk]
        mine = (x > low) & (x <= high)
        theirs = (background[:, None] > low) & (background[:, None] <= high)
        only_mine, only_theirs = mine & ~theirs, ~mine & theirs
        reached = ~(~mine & ~theirs).any(axis=2) * value
        a, c = only_mine.sum(axis=2), only_theirs.sum(axis=2)
        values += np.einsum("blk,bl->k", only_mine, gain[a, c] * reached) - np.einsum("blk,bl->k", only_theirs, loss[a, c] * reached)
        base += float((theirs.all(axis=2) * value).sum())
    return values / len(background), base / len(background)


def tree_contributions(live: DataFrame, background: DataFrame, leaves: Leaves, keys: Sequence[str], group: str,
                       largest: int = 256 << 20) -> DataFrame:
    """(keys, feature_pos, shap_value, base_value): exact Shapley values of a sum of trees against background rows.

    ``live``: (keys, features), ``background``: (group, features), both with a bounded number of rows per group. The leaves,
    whose number the learner bounds, are broadcast; more than ``largest`` bytes of them are an error."""
    size = leaves.value.nbytes + leaves.low.nbytes + leaves.high.nbytes
    if size > largest:
        raise ValueError(f"an ensemble of {size} bytes is too large to broadcast")
    keys = list(keys)
    sent = live.sparkSession.sparkContext.broadcast(leaves)
    schema = T.StructType([*(f for f in live.schema if f.name in keys), T.StructField("feature_pos", T.IntegerType()),
                           T.StructField("shap_value", T.DoubleType()), T.StructField("base_value", T.DoubleType())])

    def explain(rows: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(rows) and len(back):
            table = np.array(back["features"].tolist(), float)
            for row in rows.itertuples(index=False):
                x = np.array(row.features, float)
                values, base = exact_tree_values(x, table, sent.value)
                parts.append(pd.DataFrame({**{c: [getattr(row, c)] * len(x) for c in keys}, "feature_pos": np.arange(len(x), dtype=np.int32),
                                           "shap_value": values, "base_value": base}))
        return pd.concat(parts) if parts else pd.DataFrame({f.name: [] for f in schema})

    return live.groupBy(group).cogroup(background.groupBy(group)).applyInPandas(explain, schema)
