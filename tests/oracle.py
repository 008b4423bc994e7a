"""Runs registered queries beside their SQL in DuckDB and compares the rows.

python tests/oracle.py FOLDER [NAME or prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import logging
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opswell.sources.tables import SCHEMAS


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str, float)):
        return v
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return repr(v)


def sort_key(row):
    return [(type(v).__name__, str(v)) for v in row]


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(spark_df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"columns {cols}: {a} against {b}"
    return None


def main() -> int:
    import __spark_entry__
    from opswell import session

    folder, only = sys.argv[1], sys.argv[2:]
    spark = session.build("local[8]", "oracle", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    logging.disable(logging.ERROR)
    con = connect(folder)
    sqls = __spark_entry__.oracle_sql()
    bad = 0
    for name, run in __spark_entry__.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                result = compare(run(spark, folder), con, sqls[name])
                if result is None:
                    result = "ok"
            else:
                result = f"rows only: {run(spark, folder).count()}"
        except Exception as e:  # noqa: BLE001 - every failure is listed
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if not (result == "ok" or result.startswith("rows only")):
            bad += 1
        print(f"{name:10s} {time.time() - t0:6.2f}s {result}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
