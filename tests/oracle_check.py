"""Compare registered queries with their SQL: python tests/oracle_check.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, float) and value == int(value):
        return int(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    df = query(spark, folder)
    mine = _rows(df.columns, df.collect())
    relation = con.sql(sql)
    theirs = _rows(list(relation.columns), relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns), (df.columns, relation.columns)
    return mine, theirs


def main(folder, names):
    import __spark_entry__ as entry
    from marquee.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name not in oracle:
                n = queries[name](spark, folder).count()
                print(f"rows  {name}: {n} rows, {time.time() - start:.1f}s", flush=True)
                continue
            mine, theirs = compare(spark, folder, queries[name], oracle[name])
            same = mine == theirs
            bad += not same
            print(f"{'ok   ' if same else 'DIFF '} {name}: {len(mine)}/{len(theirs)} rows, {time.time() - start:.1f}s", flush=True)
            if not same:
                a, b = set(mine), set(theirs)
                print("  only spark:", sorted(a - b, key=repr)[:3], len(a - b))
                print("  only sql:  ", sorted(b - a, key=repr)[:3], len(b - a))
        except Exception as error:
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:1500]}", flush=True)
    print("all good" if not bad else f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
