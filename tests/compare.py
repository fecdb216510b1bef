"""Compare a Spark result with its SQL twin: names, row count, values as a multiset."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    if value is None:
        return None
    if isinstance(value, (bool, np.bool_)):
        return ("bool", bool(value))
    if isinstance(value, (int, np.integer)):
        return ("int", int(value))
    if isinstance(value, (float, np.floating)):
        return ("float", "nan" if math.isnan(value) else repr(float(value)))
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, sql: str, db) -> str | None:
    """None when equal, else a short description."""
    found_rows = [tuple(r) for r in spark_df.collect()]
    cursor = db.execute(sql)
    wanted_names = [d[0] for d in cursor.description]
    wanted_rows = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(wanted_names):
        return f"columns {sorted(spark_df.columns)} != {sorted(wanted_names)}"
    found, wanted = as_rows(spark_df.columns, found_rows), as_rows(wanted_names, wanted_rows)
    if not found_rows:
        return "no rows"
    if found != wanted:
        extra, missing = found - wanted, wanted - found
        return (
            f"{len(found_rows)} rows against {len(wanted_rows)}; "
            f"only in Spark {sum(extra.values())}: {list(extra)[:2]}; "
            f"only in SQL {sum(missing.values())}: {list(missing)[:2]}"
        )
    return None
