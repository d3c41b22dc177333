"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000  # rank error of the approximation: one ten-thousandth of a group
MARGIN = 2.0 / ACCURACY


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One column per name in ``probs``, equal to sorting the group and interpolating linearly between two ranks.

    ``percentile`` would hold all distinct values of a group in one task. Here approximate quantiles just below and above
    each wanted one cut a group into cells, counts tell which cells hold the wanted ranks, and only those cells are ranked.
    The approximation decides the cell sizes, never the result: a rank that fell outside its slice is found in the cell
    that holds it. Only rows of wanted cells are shuffled, after counting equal values.

    A cut is a cell of its own, apart from the values between two cuts: a wanted rank is then either one value, however
    often it stands, or lies between its two cuts, which the rank error of the approximation holds to a thin slice.
    Cuts and wanted cells are joined without a hint: adaptive execution broadcasts them if they turn out small, else splits
    a key with a large share of the rows."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    edges = sorted({min(max(p + side * MARGIN, 0.0), 1.0) for p in probs.values() for side in (-1, 1)})
    cut = [f"_cut{i}" for i in range(len(edges))]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(ACCURACY)).alias("_c"))
    cuts = cuts.select(*keys, *[F.get("_c", F.lit(i)).alias(c) for i, c in enumerate(cut)])
    reached = [(F.col("_v") > F.col(c)).cast("int") + (F.col("_v") >= F.col(c)).cast("int") for c in cut]
    placed = rows.join(cuts, keys).select(*keys, "_v", sum(reached[1:], reached[0]).alias("_cell"))
    by_cell = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("rank"))
        for name, p in probs.items()])
    cell_totals = (
        placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumns({"_before": F.coalesce(F.sum("_rows").over(by_cell), F.lit(0)),
                      "_n": F.sum("_rows").over(W.partitionBy(*keys))})
    )
    last = F.col("_before") + F.col("_rows") - 1
    wanted = cell_totals.withColumn("_ranks", F.filter(
        ranks, lambda r: (F.ceil(r["rank"]) >= F.col("_before")) & (F.floor(r["rank"]) <= last)))
    wanted = wanted.where(F.size("_ranks") > 0).select(*keys, "_cell", "_before", "_ranks")
    cell = [*keys, "_cell"]
    counted = placed.join(wanted, cell, "left_semi").groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_times"))
    in_cell = W.partitionBy(*cell).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.join(wanted, cell).withColumn("_end", F.col("_before") + F.sum("_times").over(in_cell) - 1)
    ranked = ranked.withColumn("_start", F.col("_end") - F.col("_times") + 1)
    rank = F.col("_r.rank")
    hits = ranked.withColumn("_r", F.explode("_ranks"))

    def holds(position):
        return (position >= F.col("_start")) & (position <= F.col("_end"))

    picked = hits.groupBy(*keys, F.col("_r.name").alias("_name"), rank.alias("_rank")).agg(
        F.max(F.when(holds(F.floor(rank)), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(F.ceil(rank)), F.col("_v"))).alias("_hi"))
    part = F.col("_rank") - F.floor("_rank")
    quantile = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part
    return picked.withColumn("_q", quantile).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probs])
