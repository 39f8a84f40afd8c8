"""Compare queries with their SQL: python tests/check_sql.py [sf_dir] [name ...]"""

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, fn, sql, sf_dir):
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows(list(types), cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    off = {c: (t, types[c]) for c, t in df.dtypes if KINDS.get(t, t) != types[c]}
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; types {off}"
    for a, b in zip(got, want):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
            return f"values {bad[:4]}; types {off}"
    return f"types {off}" if off else None


if __name__ == "__main__":
    import __spark_entry__ as e
    from tripmart.session import build_session
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = connect(sf_dir), e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        t = time.time()
        try:
            why = compare(spark, con, fn, sqls[name], sf_dir) if name in sqls else f"no sql, {fn(spark, sf_dir).count()} rows"
        except Exception as ex:  # noqa: BLE001
            why = f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += bool(why)
        print(f"{'ok ' if not why else 'BAD'} {name} {time.time() - t:.1f}s {why or ''}", flush=True)
    print("bad:", bad)
