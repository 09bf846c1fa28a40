"""A query's rows against DuckDB's for its SQL."""

import glob
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def sql_rows(sql, sf_dir=SMALL):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c.execute(sql).fetchdf()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    return f"{v:.9g}" if isinstance(v, (int, float)) else str(v)


def table(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(map(plain, r)) for r in pdf.itertuples(index=False))
