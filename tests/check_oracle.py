"""Compare every query with its SQL: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from pricegrid.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    sqls, bad = oracle_sql(), []
    for name, fn in queries().items():
        if only and name not in only:
            continue
        try:
            start = time.time()
            df = fn(spark, sf_dir)
            mine = canonical([tuple(r) for r in df.collect()], df.columns)
            took = time.time() - start
            if name not in sqls:
                print(f"rows-only {name}: {len(mine)} rows {took:.2f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(sqls[name])
            names = [d[0] for d in cur.description]
            theirs = canonical(cur.fetchall(), names)
            sql_took = time.time() - start
            columns_ok = sorted(names) == sorted(df.columns)
            diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
            ok = columns_ok and len(mine) == len(theirs) and not diff and len(mine) > 0
            print(f"{'ok  ' if ok else 'FAIL'} {name}: {len(mine)}/{len(theirs)} rows, {len(diff)} differ, {took:.2f}s vs {sql_took:.2f}s", flush=True)
            if not ok:
                bad.append(name)
                if not columns_ok:
                    print("   columns", sorted(df.columns), sorted(names))
                for a, b in diff[:3]:
                    print("   ", a, "\n   ", b)
        except Exception:
            bad.append(name)
            print("ERROR", name, traceback.format_exc(limit=3)[-1500:], flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
