"""Run registered Spark queries against their DuckDB oracle SQL and compare results.

Usage: ``python -m tests.oracle [--sf DIR] [name-prefix ...]``
Comparison: column names (sorted), row count, and the multiset of rows with doubles
rounded to 6 places (NaN and NULL both normalised to None).
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, int):
        return float(v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows]


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def type_mismatches(spark_df, description):
    st = {f.name.lower(): f.dataType.simpleString() for f in spark_df.schema.fields}
    out = []
    for name, dtype, *_ in description:
        want = SPARK_TO_DUCK.get(st.get(name.lower(), ""), "?")
        if str(dtype) != want:
            out.append(f"{name}: spark {st.get(name.lower())} vs duck {dtype}")
    return out


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    tm = type_mismatches(spark_df, cur.description)
    if tm:
        return False, "types differ: " + "; ".join(tm)
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, b = Counter(rows_of(s_cols, s_rows)), Counter(rows_of(d_cols, d_rows))
    if a != b:
        diff_a = list((a - b).elements())[:3]
        diff_b = list((b - a).elements())[:3]
        cols = sorted(s_cols)
        return False, f"values differ ({sum((a - b).values())} rows) cols={cols}\n spark: {diff_a}\n duck:  {diff_b}"
    return True, f"{len(s_rows)} rows"


def main(argv):
    sf = "/root/testdata/sf0.01"
    sql_only = False
    if argv and argv[0] == "--sql-only":
        sql_only, argv = True, argv[1:]
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    sys.path.insert(0, ".")
    from strata.session import build_session
    from strata.plans.catalog import load_all
    spark = build_session(shuffle_partitions=8)
    con = duck(sf)
    reg = load_all()
    names = [n for n in reg if (not argv or any(n.startswith(p) for p in argv)) and (reg[n].sql or not sql_only)]
    bad = 0
    for n in names:
        q = reg[n]
        t0 = time.time()
        try:
            df = q.fn(spark, sf)
            if q.sql is None:
                cnt = df.count()
                print(f"ROWS {n}: {cnt} rows ({time.time()-t0:.1f}s)", flush=True)
                continue
            ok, msg = compare(df, con, q.sql)
        except Exception as e:  # report and continue
            ok, msg = False, f"error {type(e).__name__}: {str(e)[:800]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {n}: {msg} ({time.time()-t0:.1f}s)", flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
