"""Runs registered queries in Spark and their SQL in DuckDB over the same parquet files."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return db


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return "null" if value is None else f"{type(value).__name__}:{value}"


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(spark, db, query, sql, folder):
    """Empty when both give the same columns and rows; else what differs."""
    frame = query(spark, folder)
    result = db.sql(sql)
    if sorted(frame.columns) != sorted(result.columns):
        return [("columns", sorted(frame.columns), sorted(result.columns))]
    ours = normalised(frame.columns, frame.collect())
    theirs = normalised(result.columns, result.fetchall())
    if ours == theirs:
        return []
    extra, missing = set(ours) - set(theirs), set(theirs) - set(ours)
    return [("rows", len(ours), len(theirs)), ("only spark", sorted(extra)[:3]), ("only sql", sorted(missing)[:3])]
