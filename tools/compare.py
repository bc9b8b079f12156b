"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python tools/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodgelens.catalog import ORACLES, QUERIES  # noqa: E402
from lodgelens.session import build_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def spark_rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(r[i] for i in order) for r in cur.fetchall()]
    return sorted(names), sorted(rows, key=repr)


def difference(spark, con, name: str, folder: str) -> str | None:
    df = QUERIES[name](spark, folder)
    mine = spark_rows(df)
    if name not in ORACLES:
        return None if mine else "no rows"
    names, theirs = duck_rows(con, ORACLES[name])
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if repr(a) != repr(b):
            return f"{str(a)[:300]} != {str(b)[:300]}"
    return None


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            diff = difference(spark, con, name, folder)
        except Exception as exc:  # report and go on with the next query
            diff = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += diff is not None
        mark = "ok  " if diff is None else "FAIL"
        kind = "D" if name in ORACLES else "R"
        print(f"{mark} {kind} {name:24s} {time.time() - start:6.2f}s {diff or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
