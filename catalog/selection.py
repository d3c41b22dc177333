"""Column selection and screening of wide tables."""

from pyspark.sql import functions as F

from catalog.panels import E1, W2, entities, wide
from catalog.registry import query
from lagmill.operators.panel import melt
from lagmill.operators.screening import (
    column_stats, correlated_with_earlier, correlations, drop_columns, numeric_columns, select_domain, select_screened,
    select_univariate, target_first, too_flat, too_sparse,
)
from lagmill.operators.features import complete_rows, training_rows
from lagmill.functions.columns import is_finite, ratio

_PREDICTORS = ("A", "N", "R", "flat", "copy", "sparse", "fifth")
_STATS = " UNION ALL ".join(
    f"""SELECT {i} AS pos, '{c}' AS variable, avg(CASE WHEN "{c}" IS NULL THEN 1.0 ELSE 0.0 END) AS na_frac,
 var_samp("{c}") AS variance, avg("{c}") AS mean FROM w2""" for i, c in enumerate(_PREDICTORS))
_CORR = " UNION ALL ".join(
    f"""SELECT {i} AS i, {j} AS j, CASE WHEN stddev_pop("{a}") > 0 AND stddev_pop("{b}") > 0 THEN corr("{a}", "{b}") END AS corr
 FROM (SELECT * FROM w2 WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL)"""
    for i, a in enumerate(_PREDICTORS) for j, b in enumerate(_PREDICTORS) if i < j)


@query("f1_select_univariate", "ts:t, A:2", f'WITH {W2} SELECT ts, "A" FROM w2')
def univariate(spark, sf):
    return select_univariate(wide(spark, sf), "ts", "A")


@query("f2_select_listed_predictors", "ts:t, R:2, A:2, copy:2, fifth:2", f'WITH {W2} SELECT ts, "R", "A", copy, fifth FROM w2')
def listed(spark, sf):
    return select_domain(wide(spark, sf), "ts", "R", {"shipped": ("A",), "derived": ("copy", "fifth")})


@query("f3_f4_drop_and_reorder", "ts:t, R:2, A:2, N:2, flat:2, copy:2", f'WITH {W2} SELECT ts, "R", "A", "N", flat, copy FROM w2')
def reordered(spark, sf):
    return target_first(drop_columns(wide(spark, sf), ["sparse", "fifth"]), "ts", "R")


@query("f13_numeric_predictors", "variable, filled:i", f"""WITH {E1}
 SELECT 'orders' AS variable, count(orders) AS filled FROM e1 UNION ALL SELECT 'ticket', count(ticket) FROM e1""")
def numeric(spark, sf):
    frame = entities(spark, sf)
    names = numeric_columns(frame, exclude=("sales",))
    long = melt(frame.drop("series_id"), ["ts"], names).withColumnRenamed("series_id", "variable")
    return long.groupBy("variable").agg(F.count("value").alias("filled"))


@query("f8_complete_rows", "ts:t, A:2, sparse:2", f'WITH {W2} SELECT ts, "A", sparse FROM w2 WHERE "A" IS NOT NULL AND sparse IS NOT NULL')
def complete(spark, sf):
    return complete_rows(wide(spark, sf), ["A", "sparse"])


@query("f9_training_rows", "ts:t, A:2, target:2", f'WITH {W2} SELECT ts, "A", fifth AS target FROM w2 WHERE "A" IS NOT NULL AND fifth IS NOT NULL')
def training(spark, sf):
    return training_rows(wide(spark, sf).withColumnRenamed("fifth", "target"), ["A"])


@query("f12_finite_pairs", "ts:t, x:6, y:6", f"""WITH {W2} SELECT ts, x, y FROM (SELECT ts, "A" / nullif("N" - "N" * (day(ts) % 2), 0) AS x,
 CASE WHEN day(ts) % 3 <> 0 THEN "R" END AS y FROM w2) WHERE x IS NOT NULL AND y IS NOT NULL""")
def finite(spark, sf):
    even, day = F.col("N") - F.col("N") * (F.dayofmonth("ts") % 2), F.dayofmonth("ts")
    x = F.coalesce(ratio(F.col("A"), even), F.lit(float("inf")))
    y = F.when(day % 3 != 0, F.col("R")).otherwise(F.lit(float("nan")))
    pairs = wide(spark, sf).select("ts", x.alias("x"), y.alias("y"))
    return pairs.where(is_finite(F.col("x")) & is_finite(F.col("y")))


@query("a11_column_means", "variable, mean:4", f"WITH {W2} SELECT variable, mean FROM ({_STATS})")
def means(spark, sf):
    return column_stats(wide(spark, sf), _PREDICTORS)


@query("s1_too_many_missing", "variable, na_frac:6", f"WITH {W2} SELECT * FROM ({_STATS}) WHERE na_frac > 0.2 + 1e-12")
def sparse(spark, sf):
    return too_sparse(column_stats(wide(spark, sf), _PREDICTORS))


@query("s2_too_little_variance", "variable, variance:6", f"WITH {W2} SELECT * FROM ({_STATS}) WHERE variance <= 1e-6")
def flat(spark, sf):
    return too_flat(column_stats(wide(spark, sf), _PREDICTORS))


@query("s3_pair_correlations", "i:i, j:i, corr:6", f"WITH {W2} {_CORR}")
def pairs(spark, sf):
    frame = wide(spark, sf)
    centers = [r["mean"] for r in column_stats(frame, _PREDICTORS).orderBy("pos").collect()]
    return correlations(frame, _PREDICTORS, centers)


@query("s3_correlated_with_earlier", "pos:i", f"WITH {W2} SELECT DISTINCT j AS pos FROM ({_CORR}) WHERE abs(corr) > 0.95")
def correlated(spark, sf):
    return correlated_with_earlier(pairs(spark, sf))


@query("s4_screened_selection", "variable, filled:i, total:2", f"""
 WITH {W2}, drops AS (SELECT variable FROM ({_STATS}) WHERE na_frac > 0.2 + 1e-12 OR variance <= 1e-6),
 kept AS (SELECT * FROM ({_STATS}) WHERE variable NOT IN (SELECT variable FROM drops) AND variable <> 'A'),
 late AS (SELECT DISTINCT k2.variable FROM ({_CORR}) c JOIN kept k1 ON k1.pos = c.i JOIN kept k2 ON k2.pos = c.j WHERE abs(corr) > 0.95),
 l AS (UNPIVOT (SELECT ts, "A", "N", "R", copy, fifth FROM w2) ON "A", "N", "R", copy, fifth INTO NAME variable VALUE value)
 SELECT variable, count(value) AS filled, sum(value) AS total FROM l
 WHERE variable = 'A' OR (variable IN (SELECT variable FROM kept) AND variable NOT IN (SELECT variable FROM late) AND variable <> 'N') GROUP BY 1""")
def screened(spark, sf):
    """Target A: its scaled copy is kept, as correlation with the target does not count; N is dropped by name."""
    frame = select_screened(wide(spark, sf), "ts", "A", drop_first=("flat",), drop_last=("N",))
    long = melt(frame, ["ts"]).withColumnRenamed("series_id", "variable")
    return long.where(F.col("value").isNotNull()).groupBy("variable").agg(
        F.count("value").alias("filled"), F.sum("value").alias("total"))
