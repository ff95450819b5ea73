"""Runs a query in Spark and its SQL in DuckDB and tells how they differ."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    return str(v)


def difference(spark, con, run, sql, sf_dir):
    """'' if rows, columns and values agree, else a description."""
    df = run(spark, str(sf_dir))
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got)
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a, only_b = [x for x in a if x not in in_b][:3], [x for x in b if x not in in_a][:3]
        return f"{len(a)} and {len(b)} rows of {order}; only Spark {only_a}; only SQL {only_b}"
    return ""
