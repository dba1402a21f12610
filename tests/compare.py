"""Run registered queries beside their SQL and compare values; also a command line tool: ``compare.py folder [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def canonical(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0) if value != int(value) or abs(value) > 1e15 else str(int(value)) + ".0"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def rows(columns: list[str], data: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in data)


def difference(spark, con, folder: str, fn, sql: str) -> str | None:
    """None if both sides agree, else a short description."""
    df = fn(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got == want:
        return None
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return f"rows {len(got)} vs {len(want)}; spark only {sorted(only_got)[:3]}; sql only {sorted(only_want)[:3]}"


def main(argv: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries

    from docledger.session import local_session

    folder, names = argv[0], argv[1:]
    spark, con = local_session(), connect(folder)
    qs, sql = queries(), oracle_sql()
    bad = 0
    for name in names or qs:
        if name not in qs:
            continue
        t = time.time()
        try:
            if name in sql:
                diff = difference(spark, con, folder, qs[name], sql[name])
                state = "ok" if diff is None else f"DIFF {diff}"
            else:
                state = f"rows only: {qs[name](spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            state = f"FAIL {type(e).__name__} {str(e)[:600]}"
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:24s} {time.time() - t:6.2f}s {state}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main(sys.argv[1:])
