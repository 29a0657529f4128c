"""Runs queries on small tables and compares them with their SQL."""

import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def _plain(value):
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return "" if value != value else f"{float(value):.6g}"
    if value is None or value is pd.NaT or value is pd.NA:
        return ""
    if type(value).__name__.startswith(("int", "uint")):
        return str(int(value))
    return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(tuple(map(_plain, r)) for r in frame.itertuples(index=False))


def compare(spark, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SMALL}/{name}')")
    assert rows(query(spark, SMALL).toPandas()) == rows(con.execute(sql).df())


def altered_tables(spark, folder, how):
    """All small tables, altered by ``how`` (a function of a DataFrame), in ``folder``."""
    for name in os.listdir(SMALL):
        how(spark.read.parquet(f"{SMALL}/{name}")).write.parquet(f"{folder}/{name}")
    return str(folder)


def all_null(df):
    return df.sparkSession.createDataFrame([(None,) * len(df.columns)] * 3, df.schema)
