"""Run registered queries against DuckDB on the same parquet tables.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


TIMES: dict[str, float] = {}


def make_spark(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fieldaudit")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None if equal, else a message."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if TIMES is not None:
        TIMES[name] = time.time() - t0
    if sql is None:
        return None if got[1] else "no rows"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t) != types[c]]
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}; types {odd}"
    if odd:
        return f"types differ {odd}"
    return None


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    qs, sqls = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(qs)
    spark, con = make_spark(), connect(sf_dir)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            msg = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:900]}"
        bad += msg is not None
        rows = "" if sqls.get(n) else " (rows only)"
        print(f"{'FAIL' if msg else 'ok  '} {n}{rows} spark {TIMES.get(n, 0):.1f}s total {time.time() - t0:.1f}s {msg or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
