"""Run registered queries and their SQL twins side by side.

    python tests/compare.py [sf dir] [name prefix ...]
"""
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


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ == "str"), f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return a == b


def ordered(cols, rows):
    at = {c: i for i, c in enumerate(cols)}
    names = sorted(cols)
    return names, sorted((tuple(plain(r[at[c]]) for c in names) for r in rows), key=sort_key)


def check(spark, con, name, fn, sql, sf_dir):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    rows = df.collect()
    if sql is None:
        return None if df.columns else "no columns"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = ordered(cols, cur.fetchall())
    got_cols, got = ordered(df.columns, rows)
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {got_cols}: {bad[0][0]} vs {bad[0][1]}"
    exact = sum(g != w for g, w in zip(got, want))
    return None if not exact else f"near: {exact} of {len(got)} rows differ in the last digit"


def main():
    import __spark_entry__ as entry
    from pricemill.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            problem = check(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        n = fn(spark, sf_dir).count() if problem is None and "-n" in os.environ.get("COMPARE", "") else ""
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - t:.1f}s {n} "
              f"{'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
