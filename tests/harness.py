"""Run a registered Spark query and its DuckDB oracle on the same parquet tables and
compare row count, column names and order-insensitive values."""

from __future__ import annotations

import datetime as _dt
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).fetchdf()


def _norm(v):
    if v is None:
        return None
    import pandas as pd
    try:
        if pd.isna(v):  # NaN / NaT / pd.NA
            return None
    except (TypeError, ValueError):
        pass
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day).isoformat(sep=" ")
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isinf(v):
            return v
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_pdf, duck_pdf) -> tuple[bool, str]:
    sc, sr = _rows(spark_pdf)
    dc, dr = _rows(duck_pdf)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count spark={len(sr)} duck={len(dr)}"
    for a, b in zip(sr, dr):
        if a != b:
            return False, f"first differing row: spark={a} duck={b}"
    return True, f"{len(sr)} rows match"


def spark_pdf(df):
    rows = df.collect()
    import pandas as pd
    return pd.DataFrame([r.asDict() for r in rows], columns=df.columns)
