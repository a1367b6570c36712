"""Run every query against its SQL and report differences.

    python tests/check_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: float(x) if hasattr(x, "as_tuple") else x
    rows = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], rows


def compare(spark, con, sf_dir, name):
    """Empty text if equal, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"no SQL, {len(got[1])} rows"
    res = con.execute(sql)
    want = canonical([c[0] for c in res.description], res.fetchall())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"DIFF columns {got[0]} != {want[0]}"
    extra = [g for g in got[1] if g not in set(want[1])][:2] if len(got[1]) < 50_000 else []
    missing = [w for w in want[1] if w not in set(got[1])][:2] if len(want[1]) < 50_000 else []
    return f"DIFF {len(got[1])} vs {len(want[1])} rows; only here {str(extra)[:300]}; only SQL {str(missing)[:300]}"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            out = compare(spark, con, sf_dir, name)
        except Exception as e:
            out = f"DIFF {type(e).__name__} {str(e)[:400]}"
        bad += out.startswith("DIFF")
        print(f"{name:28s} {time.time() - t:6.2f}s {out or 'ok'}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
