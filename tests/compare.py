"""Compare every query with its SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime.datetime):
        return value.date()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def spark_rows(df):
    return df.columns, rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, rows_of(names, cur.fetchall())


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    only = set(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, oracle = duck(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            names, got = spark_rows(query(spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ERROR {str(e)[:600]}")
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"{name:28s} {len(got):7d} rows {took:6.2f}s  (no SQL)")
            continue
        want_names, want = duck_rows(con, oracle[name])
        good = sorted(names) == sorted(want_names) and got == want
        print(f"{name:28s} {len(got):7d} rows {took:6.2f}s  {'same' if good else 'DIFFERENT'}")
        if not good:
            print("   columns", sorted(set(names) ^ set(want_names)), len(got), len(want))
            for a, b in [(a, b) for a, b in zip(got, want) if a != b][:3]:
                print("   spark", a, "\n   duck ", b)


if __name__ == "__main__":
    main()
