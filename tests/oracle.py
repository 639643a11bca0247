"""Runs registered queries against their oracle SQL: ``python tests/oracle.py [-d folder] [prefix ...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, int):
        return float(f"{float(value):.15g}")
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def table_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    left = table_of(df.columns, df.collect())
    res = con.execute(sql)
    right = table_of([c[0] for c in res.description], res.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        ls, rs = set(map(repr, left[1])), set(map(repr, right[1]))
        return (
            f"rows {len(left[1])} vs {len(right[1])}; only spark {sorted(ls - rs)[:3]}; "
            f"only oracle {sorted(rs - ls)[:3]}"
        )
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from convolake.session import local_session

    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["-d"]:
        folder, argv = argv[1], argv[2:]
    spark = local_session()
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        spent = 0.0
        try:
            df = run(spark, folder)
            df.write.format("noop").mode("overwrite").save()
            spent = time.time() - start
            if name in sqls:
                verdict = compare(df, con, sqls[name]) or "ok"
            else:
                verdict = f"rows {df.count()} (no oracle)"
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if verdict != "ok" and not verdict.endswith("(no oracle)"):
            bad += 1
        if verdict != "ok" or spent > 3:
            print(f"{name:45s} {spent:6.2f}s {verdict[:1500]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
