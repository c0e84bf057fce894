"""Run registered queries against their oracle SQL and print the differences.

usage: python tools/parity.py [--sf 0.01] [--match regex] [--all]
"""

from __future__ import annotations

import argparse
import math
import os
import re
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def local_session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("parity")
             .config("spark.sql.shuffle.partitions", "8").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.bindAddress", "127.0.0.1")
             .config("spark.driver.host", "127.0.0.1").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(key(v) for v in value) + "]"
    return repr(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(key(row[i]) for i in order) for row in data)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--match", default="")
    ap.add_argument("--module", default="")
    args = ap.parse_args()
    from asofia.plans import catalog
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    spark = local_session()
    bad = 0
    for name, q in catalog().items():
        if args.module and q.build.__module__.split(".")[-1] not in args.module.split(","):
            continue
        if args.match and not re.search(args.match, name):
            continue
        try:
            t0 = time.time()
            df = q.build(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if q.sql is None:
                print(f"rows  {name:34s} {len(got):8d} {t1 - t0:6.2f}s", flush=True)
                continue
            cur = con.execute(q.sql)
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            gn, gr = rows(df.columns, got)
            wn, wr = rows(names, want)
            ok = gn == wn and gr == wr
            print(f"{'ok   ' if ok else 'DIFF '} {name:34s} {len(got):8d} {t1 - t0:6.2f}s {t2 - t1:6.2f}s", flush=True)
            if not got:
                print("      EMPTY")
            if not ok:
                bad += 1
                if gn != wn:
                    print("   columns", sorted(set(gn) ^ set(wn)))
                else:
                    a, b = set(gr), set(wr)
                    print("  ", gn, len(gr), len(wr))
                    print("   spark only", len(a - b), sorted(a - b)[:2])
                    print("   duck only ", len(b - a), sorted(b - a)[:2])
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL  {name}: {str(e)[:700]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
