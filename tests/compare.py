"""Runs queries and their SQL twins side by side: python tests/compare.py [names]. Values are compared as the driver does, rows in any order."""

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(x):
    import datetime

    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if hasattr(x, "as_tuple"):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return float(x) if isinstance(x, int) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differ(spark, con, run, sql, sf):
    df = run(spark, sf)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows"
    done = con.execute(sql)
    names = [c[0] for c in done.description]
    theirs = rows(names, done.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ: {bad[:2]}" if bad else None


def main(names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '2')}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or [q for q in queries if not q.startswith("op") and q != "pipeline"]:
        began = time.time()
        try:
            said = differ(spark, con, queries[name], oracle.get(name), sf)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        if said or time.time() - began > 8:
            print(name, round(time.time() - began, 1), said, flush=True)
    print("done", len(names or queries))


if __name__ == "__main__":
    main(sys.argv[1:])
