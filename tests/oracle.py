"""Run registered queries beside their comparison SQL: python tests/oracle.py [sf_dir] [name...]"""

from __future__ import annotations

import collections
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([normal(x) for x in v])
    if isinstance(v, dict):
        return repr(sorted((normal(k), normal(x)) for k, x in v.items()))
    return repr(v)


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[str, int, float, float]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    left = [tuple(normal(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    t1 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    rows = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != names:
        return f"columns {names} != {sorted(cols)}", len(left), t1 - t0, t2 - t1
    order = [cols.index(n) for n in names]
    right = [tuple(normal(r[i]) for i in order) for r in rows]
    a, b = collections.Counter(left), collections.Counter(right)
    if a == b:
        return "ok", len(left), t1 - t0, t2 - t1
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    text = f"rows {len(left)}/{len(right)} differ {len(only_a)}/{len(only_b)} {names}\n   spark {sorted(only_a)[:3]}\n   duck  {sorted(only_b)[:3]}"
    return text, len(left), t1 - t0, t2 - t1


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master(f"local[{cpus}]").appName("spark_drift").config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def main() -> None:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = args[1:] or list(queries)
    bad = 0
    for name in wanted:
        try:
            if name in oracles:
                state, n, a, b = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                t0 = time.time()
                n = len(queries[name](spark, sf_dir).collect())
                state, a, b = "rows only", time.time() - t0, 0.0
        except Exception as e:  # report and go on
            state, n, a, b = f"ERROR {type(e).__name__}: {str(e)[:600]}", -1, 0.0, 0.0
        bad += state not in ("ok", "rows only")
        print(f"{name:32s} {n:8d} rows  spark {a:6.2f}s  duck {b:6.2f}s  {state}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} fine")


if __name__ == "__main__":
    main()
