"""Compare every query with its SQL on DuckDB, order-insensitively and to the last digit shown.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

import collections
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def compare(df, con, sql):
    """Empty text when both sides agree, otherwise what differs."""
    names = sorted(df.columns)
    rel = con.execute(sql)
    got_names = [d[0] for d in rel.description]
    if sorted(got_names) != names:
        return f"columns differ: {names} / {sorted(got_names)}"
    theirs = rel.fetchall()
    at = [got_names.index(n) for n in names]
    theirs = [tuple(tidy(r[i]) for i in at) for r in theirs]
    mine = [tuple(tidy(r[n]) for n in names) for r in df.collect()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows / {len(theirs)} rows"
    kinds = lambda rows: [
        sorted({type(v).__name__ for v in c if v is not None}) for c in zip(*rows)
    ]
    if kinds(mine) != kinds(theirs):
        bad = [(n, a, b) for n, a, b in zip(names, kinds(mine), kinds(theirs)) if a != b]
        return f"types differ: {bad}"
    a, b = collections.Counter(mine), collections.Counter(theirs)
    if a == b:
        return ""
    key = lambda r: tuple(str(v) for v in r)
    only_a, only_b = sorted((a - b).elements(), key=key), sorted((b - a).elements(), key=key)
    out = [f"{len(only_a)} of {len(mine)} rows differ; columns {names}"]
    for x, y in list(zip(only_a, only_b))[:3]:
        out.append(f"   spark {[v for v, w in zip(x, y) if v != w]}\n   duck  {[w for v, w in zip(x, y) if v != w]}  at {x[:2]}")
    return "\n".join(out)


def main(argv):
    from barwise.session import local_session
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    builders, sql = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(builders)
    spark = local_session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in names:
        start = time.time()
        try:
            df = builders[name](spark, sf_dir)
            if name in sql:
                note = compare(df, con, sql[name])
            else:
                note = "" if df.count() else "no rows"
        except Exception as e:  # report and go on
            note = f"{type(e).__name__}: {str(e)[:600]}"
        if note:
            bad.append(name)
        print(f"{name:28s} {time.time() - start:6.1f}s  {note or 'ok'}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} agree; differing: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
