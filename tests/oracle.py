"""Rows of a DataFrame and of DuckDB's answer to the same question, ready to compare."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and np.isnan(value):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in value)
    if isinstance(value, (float, np.floating)):
        return float(f"{value:.9g}")
    return value.item() if hasattr(value, "item") else value


def rows_of(pdf):
    names = sorted(pdf.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in pdf[names].itertuples(index=False)), key=repr)


def answer(sql, sf_dir):
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        return rows_of(con.execute(sql).df())
