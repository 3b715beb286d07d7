"""Compare registered queries with DuckDB on the same parquet files."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 6)
        return int(value) if value == int(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, function, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    frame = function(spark, sf_dir)
    started = time.time()
    got = [tuple(r) for r in frame.collect()]
    took = time.time() - started
    if sql is None:
        return len(got) > 0, f"rows={len(got)} (rows only) {took:.1f}s"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}"
    a, b = normal(frame.columns, got), normal(names, expected)
    if a == b:
        return True, f"rows={len(a)} {took:.1f}s"
    only_a = [x for x in a if x not in b][:3] if len(a) < 20000 else a[:2]
    only_b = [x for x in b if x not in a][:3] if len(b) < 20000 else b[:2]
    return False, f"rows {len(a)} vs {len(b)}\n    spark {only_a}\n    duck  {only_b}"


def main(argv: list[str]) -> int:
    from conftest import make_session

    import __spark_entry__ as entry

    sf_dir, *names = argv
    spark, con = make_session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    bad = []
    for name in chosen:
        try:
            ok, text = compare(spark, con, queries[name], sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:700]}"
        if not ok:
            bad.append(name)
        print(("ok   " if ok else "BAD  ") + f"{name:28s} {text}", flush=True)
    print(f"{len(chosen) - len(bad)} of {len(chosen)} ok; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.path[:0] = ["/root/repo", "/root/repo/tests"]
    sys.exit(main(sys.argv[1:]))
