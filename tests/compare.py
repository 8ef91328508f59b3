"""Run named queries in Spark and their SQL in DuckDB; report differences.

Usage: python tests/compare.py [--sf 0.01] [name ...]
"""

import hashlib
import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(canon(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows={len(rows)} no-sql {t1 - t0:.1f}s", True
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    times = f"spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sorted(want_cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(want_cols)} {times}", False
    (h1, l1), (h2, l2) = digest(df.columns, rows), digest(want_cols, want)
    if h1 == h2:
        return f"ok rows={len(rows)} {times}", True
    s1, s2 = set(l1), set(l2)
    bad = [x for x in l1 if x not in s2][:3], [x for x in l2 if x not in s1][:3]
    return f"DIFF rows {len(l1)} vs {len(l2)} {times}\n   spark {bad[0]}\n   duck  {bad[1]}", False


def main():
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    import __spark_entry__ as entry
    from phasewise.session import local_session

    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    q, s = entry.queries(), entry.oracle_sql()
    names = [n for n in q if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = []
    for n in names:
        try:
            msg, ok = check(spark, con, n, q[n], s.get(n), sf_dir)
        except Exception as e:  # report and go on
            msg, ok = f"ERROR {type(e).__name__}: {str(e)[:600]}", False
        print(f"{n}: {msg}", flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} passed; failed: {failed}")


if __name__ == "__main__":
    main()
