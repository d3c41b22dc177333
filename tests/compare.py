"""Run a query in Spark and its SQL in DuckDB and compare as multisets of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _row(values) -> tuple:
    out = []
    for v in values:
        if isinstance(v, float):
            v = "NaN" if math.isnan(v) else v
        out.append((v is None, str(v)))
    return tuple(out)


def differences(df, con, sql: str) -> list[str]:
    """Empty when column names, row count and values agree."""
    result = con.execute(sql)
    names = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(n) for n in names]
    theirs = sorted(_row(r[i] for i in order) for r in result.fetchall())
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)} != {names}"]
    ours = sorted(_row(r[n] for n in names) for r in df.collect())
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} != {len(theirs)}"]
    if not ours:
        return ["no rows"]
    bad = [f"{a} != {b}" for a, b in zip(ours, theirs) if a != b]
    return [f"{len(bad)} of {len(ours)} rows differ", *bad[:3]] if bad else []
