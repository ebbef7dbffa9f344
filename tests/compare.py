"""Run registered queries next to their DuckDB SQL and report differences."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
         "float": "FLOAT"}


def difference(df, con, sql: str) -> str | None:
    """None when the results agree, else a short description."""
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = normal(expected_columns, result.fetchall())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    rows = normal(df.columns, df.collect())
    if len(rows) != len(expected):
        return f"{len(rows)} rows, expected {len(expected)}"
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(rows)} rows differ; first {wrong[0]}"[:600]
    odd = {c: (t, types[c]) for c, t in df.dtypes if KINDS.get(t) != types[c].upper()}
    return f"TYPES {odd}" if odd else None


if __name__ == "__main__":
    from wordtrail import plans
    from wordtrail.session import build_session

    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), plans.all_sql()
    for name, run in plans.all_queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            state = difference(df, con, sql[name]) if name in sql else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            state = f"ERROR {type(error).__name__}: {str(error)[:500]}"
        print(f"{'ok  ' if state is None else 'ROWS' if state.startswith('rows only') else 'FAIL'} {name} "
              f"{time.time() - start:.1f}s {state or ''}", flush=True)
