"""Order-insensitive comparison of a Spark result with a DuckDB oracle result
(column names sorted, values normalised, multiset equality)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

from clientlens.sources.tables import DRIVER_TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = df.columns
    s = rows_of(cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    d = rows_of(dcols, cur.fetchall())
    if sorted(cols) != sorted(dcols):
        return False, f"columns differ: {sorted(cols)} vs {sorted(dcols)}"
    if s != d:
        return False, f"values differ: only spark {list((s - d).elements())[:2]} only duck {list((d - s).elements())[:2]}"
    return True, f"{sum(s.values())} rows"
