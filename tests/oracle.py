"""Run the registered queries next to their SQL and compare rows, whatever their order.

    python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return 0.0 if v == 0 else float(v)
    return str(v)


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        return ("rows", len(mine[1]), [])
    cur = con.execute(sql)
    theirs = rows_of([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return ("COLUMNS", len(mine[1]), [mine[0], theirs[0]])
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return ("DIFFERENT", len(mine[1]), [len(theirs[1]), sorted(a - b, key=repr)[:3],
                                            sorted(b - a, key=repr)[:3]])
    return ("ok", len(mine[1]), [])


if __name__ == "__main__":
    import __spark_entry__ as entry

    from crowdcover.session import local_session, release

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(8, "oracle"), connect(folder)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            verdict, n, info = compare(spark, con, folder, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            verdict, n, info = "ERROR", 0, [f"{type(e).__name__}: {str(e)[:900]}"]
        print(f"{verdict:10} {name:28} {n:7} {time.time() - t:6.1f}s", *info, flush=True)
        release()
