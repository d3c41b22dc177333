import datetime as dt
import random
from collections import Counter

import pytest

from lagmill.operators.intervals import regime_table_stats, with_regimes

DAY = dt.date(2000, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(n)


@pytest.mark.parametrize("bucket_days", [1, 7, 400])
@pytest.mark.parametrize("own", [True, False])
def test_rows_meet_exactly_the_regimes_that_hold_them(spark, bucket_days, own):
    rng = random.Random(3)
    rows = [("a" if k % 3 else "b", day(rng.randrange(900)), float(k)) for k in range(300)] + [("a", None, 1.0), (None, day(5), 1.0)]
    regimes = [(rng.choice("abc"), f"r{k}", day(rng.choice([None, rng.randrange(-50, 950)])), day(rng.choice([None, rng.randrange(-50, 950)])))
               for k in range(40)] + [("a", "r0", day(10), day(10))]
    panel = spark.createDataFrame(rows, "series_id string, ts date, value double").repartition(3)
    table = spark.createDataFrame(regimes, "series_id string, regime string, starts date, ends date")
    want = Counter((s, t, v, r) for s, t, v in rows if t and (s or not own) for z, r, a, b in regimes
                   if (z == s or not own) and (a is None or a <= t) and (b is None or t <= b))
    got = with_regimes(panel, table if own else table.drop("series_id"), ("series_id",) if own else (), bucket_days).collect()
    assert Counter(map(tuple, got)) == want


def test_days_are_whole_and_moments_exact(spark):
    at = lambda h, m=0: dt.datetime(2000, 1, 2, h, m)
    panel = spark.createDataFrame([("a", at(0), 1.0), ("a", at(23, 59), 3.0)], "series_id string, ts timestamp_ntz, value double")
    days = spark.createDataFrame([("a", "d", day(1), day(1))], "series_id string, regime string, starts date, ends date")
    moments = spark.createDataFrame([("a", "m", at(0), at(23))], "series_id string, regime string, starts timestamp_ntz, ends timestamp_ntz")
    assert [(r.regime, r["count"], r["mean"]) for r in regime_table_stats(panel, days).collect()] == [("d", 2, 2.0)]
    assert [(r.regime, r["count"], r["mean"]) for r in regime_table_stats(panel, moments).collect()] == [("m", 1, 1.0)]


def test_clashing_columns_and_empty_tables(spark):
    panel = spark.createDataFrame([("a", DAY, "old", 1.0)], "series_id string, ts date, regime string, value double")
    table = spark.createDataFrame([("a", "new", None, None, 5.0)], "series_id string, regime string, starts date, ends date, value double")
    assert [tuple(r) for r in with_regimes(panel, table).collect()] == [("a", DAY, 1.0, "new")]
    assert with_regimes(panel, table.limit(0)).count() == 0 and with_regimes(panel.limit(0), table).count() == 0
    with pytest.raises(ValueError, match="starts"):
        with_regimes(panel, table.drop("starts"))
