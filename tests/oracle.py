"""Holds registered queries against their SQL in DuckDB: python tests/oracle.py [--dir DIR] [NAME...]"""

import math
import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = str(Path(__file__).resolve().parents[1])


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}" if x != int(x) else str(int(x))
    if hasattr(x, "as_tuple"):
        return plain(float(x))
    return "" if x is None else f"{x}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """Empty if the rows are the same, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = rows_of([c[0] for c in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} and {len(want[1])}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return ""


def main(args):
    sys.path.insert(0, ROOT)
    os.environ["PYTHONPATH"] = ROOT
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        sf_dir, args = args[1], args[2:]
    spark = SparkSession.builder.master(f"local[{os.environ.get('CORES', 8)}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in args or list(queries):
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            said = difference(df, con, sqls[name]) if name in sqls else f"no SQL; {df.count()} rows"
        except Exception:  # noqa: BLE001 - reported
            said = "failed: " + traceback.format_exc().split("JVM stacktrace")[0][-700:]
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
