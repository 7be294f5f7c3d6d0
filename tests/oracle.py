"""Run registered queries next to their SQL and compare all rows.

``python tests/oracle.py [sf] [name-prefix ...]``
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, (datetime.date, datetime.datetime)):
        return "time"
    return type(v).__name__


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if isinstance(v, float) and math.isnan(v):
                v = "NaN"
            cells.append("-" if v is None else (repr(v) if not isinstance(v, str) else v))
        out.append(tuple(cells))
    return sorted(out)


def compare(df, con, sql: str):
    """``(ok, message)`` for a Spark result against SQL."""
    got = [tuple(x) for x in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    for n in names:
        a = {kind(r[df.columns.index(n)]) for r in got} - {None}
        b = {kind(r[names.index(n)]) for r in want} - {None}
        if a != b:
            return False, f"kind of {n}: {a} != {b}"
    a, b = normal(got, df.columns), normal(want, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
    return True, f"{len(a)} rows"


def main():
    import __spark_entry__ as e
    from panelflow import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, sqls = e.queries(), e.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                ok, msg = True, f"{len(df.collect())} rows, no SQL"
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {msg}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
