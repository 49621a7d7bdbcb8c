"""Run registered queries beside their SQL and compare row by row.

``python -m checks.compare [sf_dir] [query ...]``
"""

from __future__ import annotations

import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in rows))


def compare(spark, con, name, build, sql, sf_dir):
    df = build(spark, sf_dir)
    mine = _key([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = _key(result.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return False, len(mine), f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine == theirs:
        return True, len(mine), ""
    a, b = set(mine), set(theirs)
    return False, len(mine), f"{len(mine)} and {len(theirs)} rows; only Spark {list(a - b)[:2]}; only SQL {list(b - a)[:2]}"


def main() -> None:
    from checks.oracle import build
    from checks.queries import QUERIES
    from checks.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con, sql = local_session(), duck(sf_dir), build()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, run in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        if name not in sql:
            print(f"{name:26s} no SQL, {run(spark, sf_dir).count()} rows", flush=True)
            continue
        try:
            ok, rows, why = compare(spark, con, name, run, sql[name], sf_dir)
        except Exception as error:  # report and go on with the other queries
            ok, rows, why = False, -1, str(error)[:700]
        bad += not ok
        print(f"{name:26s} {'ok ' if ok else 'BAD'} {rows:6d} rows {time.time() - start:6.1f} s {why}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
