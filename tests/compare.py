"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime as dt
import math
from collections import Counter


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def spark_vs_duck(df, con, query):
    s_cols, s_rows = canon(df.columns, df.collect())
    cur = con.execute(query)
    d_cols, d_rows = canon([d[0] for d in cur.description], cur.fetchall())
    return (s_cols, s_rows), (d_cols, d_rows)
