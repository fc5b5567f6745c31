"""Run a registered query in Spark and its SQL in DuckDB and compare whole results."""

import datetime
import decimal
import glob
import os
import sys
import time
import traceback

import duckdb

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir=SF_DIR):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", repr(round(v, 9) + 0.0))
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if v is None:
        return ("", "")
    return (type(v).__name__[0], str(v))


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir=SF_DIR):
    df = fn(spark, sf_dir)
    names, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    duck_names = [d[0] for d in rel.description]
    want_names, want = normal(duck_names, rel.fetchall())
    assert names == want_names, f"columns {names} != {want_names}"
    assert len(rows) == len(want), f"rows {len(rows)} != {len(want)}"
    for got, exp in zip(rows, want):
        assert got == exp, f"\nspark {str(got)[:1500]}\nduck  {str(exp)[:1500]}"
    assert rows, "empty result"
    return len(rows)


def main(patterns):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from conftest import session

    spark = session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect()
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if patterns and not any(p in name for p in patterns):
            continue
        start = time.time()
        try:
            if name in oracle:
                n = compare(spark, con, fn, oracle[name])
            else:
                n = len(fn(spark, SF_DIR).collect())
            print(f"ok   {name:34s} {n:8d} rows {time.time() - start:6.1f}s{'' if name in oracle else '  (no sql)'}", flush=True)
        except Exception as ex:
            bad.append(name)
            text = str(ex)
            if not isinstance(ex, AssertionError):
                text = text.split("JVM stacktrace")[0]
                if not text.startswith(("[", "Binder", "Parser", "Catalog")):
                    text += "\n" + "".join(traceback.format_tb(ex.__traceback__)[-2:])
            print(f"FAIL {name}: {text[:2500]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
