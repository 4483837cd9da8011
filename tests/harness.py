"""Runs a registered query and its reference SQL on the same tables and compares them."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(f))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=repr)


def compare(spark, queries, sql, name, sf_dir, con=None):
    """(ok, message) of one query."""
    df = queries[name](spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in sql:
        return len(got) > 0, f"rows {len(got)}"
    con = con or connect(sf_dir)
    res = con.execute(sql[name])
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return False, f"rows {len(got)} vs {len(want)}; first differences (ours, reference): {diff}"
    return True, f"rows {len(got)}"
