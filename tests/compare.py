"""Run registered queries against their SQL and report differences: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def key(row):
    return tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)


def difference(spark, con, name: str, sf_dir: str, queries: dict, oracles: dict) -> str | None:
    """None if rows, names and types agree; else what differs first."""
    df = queries[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=key)
    if name not in oracles:
        return None if rows else "no rows"
    cursor = con.execute(oracles[name])
    columns = [(d[0], str(d[1])) for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i][0])
    want = sorted((tuple(cell(r[i]) for i in order) for r in cursor.fetchall()), key=key)
    if [columns[i][0] for i in order] != names:
        return f"columns {names} / {[columns[i][0] for i in order]}"
    types = [(f, TYPES.get(df.schema[f].dataType.simpleString(), df.schema[f].dataType.simpleString())) for f in names]
    wrong = [(t, columns[i]) for t, i in zip(types, order) if t[1] != columns[i][1]]
    if wrong:
        return f"types {wrong}"
    if len(rows) != len(want):
        extra = list(set(map(str, rows)) - set(map(str, want)))[:2], list(set(map(str, want)) - set(map(str, rows)))[:2]
        return f"{len(rows)} rows / {len(want)}: {str(extra)[:600]}"
    for ours, theirs in zip(rows, want):
        if ours != theirs:
            return f"{names}: {str(ours)[:500]} / {str(theirs)[:500]}"
    return None if rows else "no rows on both sides"


def main() -> int:
    from seamark.plans.catalog import ORACLES, QUERIES
    from seamark.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                     "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in wanted:
        started = time.time()
        try:
            problem = difference(spark, con, name, sf_dir, QUERIES, ORACLES)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
