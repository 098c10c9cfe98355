"""Runs a registered query in Spark and its SQL in DuckDB and compares schema, row count and values."""

from __future__ import annotations

import math
import sys

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    try:
        import duckdb
    except ImportError:
        sys.path.append("/opt/oracle")
        import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
          "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(spark, con, fn, sql, sf_dir: str, strict_types: bool = True) -> str | None:
    """None when equal, else a description of the first difference."""
    df = fn(spark, sf_dir)
    got_types = {n: _TYPES.get(t, t) for n, t in df.dtypes}
    cur = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want_rows = cur.fetchall()
    if sorted(got_types) != sorted(want_types):
        return f"columns differ: spark {sorted(got_types)} sql {sorted(want_types)}"
    if strict_types:
        bad = {n: (got_types[n], want_types[n]) for n in got_types if got_types[n] != want_types[n]}
        if bad:
            return f"types differ: {bad}"
    names = sorted(got_types)
    order = list(want_types)
    got = sorted((tuple(_norm(r[n]) for n in names) for r in df.collect()), key=repr)
    want = sorted((tuple(_norm(r[order.index(n)]) for n in names) for r in want_rows), key=repr)
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} sql {len(want)}\n  spark {got[:3]}\n  sql   {want[:3]}"
    for a, b in zip(got, want):
        if a != b:
            return f"values differ ({names}):\n  spark {a}\n  sql   {b}"
    return None
